"""Checks of schemas, keys, joins and splits that raise with what they found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data breaks a contract."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Reads one repeated key at most."""
    if rows := df.groupBy(*keys).count().filter("count > 1").limit(1).collect():
        raise ContractError(f"{', '.join(keys)} isn't unique: {rows[0].asDict()}")
    return df


def require_members(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    if rows := df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(column).limit(1).collect():
        raise ContractError(f"{column} holds {rows[0][0]!r}")
    return df


def require_no_nulls(df: DataFrame, *columns: str) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    if bad := {c: counts[c] for c in columns if counts[c]}:
        raise ContractError(f"nulls: {bad}")
    return df


def require_chronological(df: DataFrame, date: str = "date", split: str = "split", order: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Splits follow each other without overlap."""
    spans = {r[0]: (r[1], r[2]) for r in df.groupBy(split).agg(F.min(date), F.max(date)).collect()}
    present = [s for s in order if s in spans]
    for a, b in zip(present, present[1:], strict=False):
        if not spans[a][1] < spans[b][0]:
            raise ContractError(f"{a} ends at {spans[a][1]}, {b} begins at {spans[b][0]}")
    return df


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(require_unique(right, *on), on, how)


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    return require_unique(left, *on).join(require_unique(right, *on), on, how)
