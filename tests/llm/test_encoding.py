from __future__ import annotations

import pytest

from tidewire.llm import encoding

SCHEMA = "doc_id bigint, text string, run string, key string"
TEXTS = ("café", "“It’s”", "größere", "não é", "Äußerung", "señor", "déjà vu", "€5", "Голос", "Δρόμη")


def garble(text: str, codec: str) -> str | None:
    """Read as the encoding, bytes without a character as controls."""
    table = {b: c for c, b in encoding._bytes_of(codec).items()}
    return "".join(chr(b) if b < 0x80 else table[b] for b in text.encode())


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp850", "cp1250", "cp1251"])
def test_exact_round_trip(codec):
    import re

    for text in TEXTS:
        bad = garble(text, codec)
        assert re.sub(r"[^\x00-\x7F]+", lambda m: encoding.repair(m[0]), bad) == text, (codec, bad)


def test_nested_layers():
    assert encoding.repair(garble(garble("é", "cp1252"), "cp1252")) == "é"
    assert encoding.repair(garble(garble(garble("“", "cp1252"), "cp1252"), "cp1252")) == "“"


def test_ordinary_text_stays():
    for run in ("é", "’é", "ÇÃ", "É”", "Вестник", "Ωρες", "é »", "çã", "öß", "«", "▲", "ñí", "”,“"):
        assert encoding.judge(run) == (run, False)
    for run in ("�", "â€", "ï¿½"):
        assert encoding.judge(run)[1]


def test_texts(spark):
    long = "plain text " * 20_000
    rows = [(1, "a cafÃ© and â€œquotesâ€\u009d", "", ""), (2, "café", "", ""), (3, None, "", ""), (4, "", "", ""), (5, long + "Ã¼", "", ""), (6, "lost � cafÃ©", "", ""), (2, "CÃ£o", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["key"], r["text"][-12:], r["lost"]) for r in encoding.repair_texts(df).collect()}
    assert got == {(1, "and “quotes”", False), (5, (long + "ü")[-12:], False), (6, " � café"[-12:] if len(" � café") > 12 else "lost � café"[-12:], True), (2, "Cão", False)}
    assert sorted(r[0] for r in encoding.garbled_keys(df).collect()) == [1, 2, 5, 6]
    assert encoding.garbled_keys(df.limit(0)).count() == 0


def test_scripts_beyond_europe():
    for text in ("日本銀行", "भारत", "العربية", "한국은행", "עברית", "ประเทศ"):
        for encoding_name in ("cp1252", "mac_roman", "cp1251", "latin-1"):
            table = {v: k for k, v in encoding._bytes_of(encoding_name).items()}
            garbled = "".join(table[b] for b in text.encode())
            assert encoding.judge(garbled) == (text, True), (text, encoding_name)
        assert encoding.judge(text) == (text, False)
    for word in ("уже", "раб", "сбер", "těžší", "’é", "東京", "は"):
        assert encoding.judge(word) == (word, False)


def test_many_layers():
    garbled = "é"
    for _ in range(9):
        garbled = garbled.encode().decode("latin-1")
    assert encoding.judge(garbled) == ("é", True)
