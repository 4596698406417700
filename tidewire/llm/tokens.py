"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the tokenizer; every function takes another path.
RANKS = os.environ.get("TIDEWIRE_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, once per process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str = RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, tokens`` and the columns of ``keep``; a null or empty text has no tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = encoding(path)
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch["_text"]]
            yield batch.drop(columns="_text").assign(tokens=sizes)

    rows = df.select(F.col(key).alias("key"), *keep, F.col(text).alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens bigint"
    return rows.mapInPandas(count, schema)
