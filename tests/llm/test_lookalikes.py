from __future__ import annotations

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewire.llm import lookalikes

SCHEMA = "id bigint, body string, token string, key string"


def forms(spark, texts):
    df = spark.createDataFrame([(i, x, "t", "k") for i, x in enumerate(texts)], SCHEMA)
    return {r["key"]: (r["text"], list(r["kinds"])) for r in lookalikes.one_form(df, "id", "body").collect()}


def test_kinds(spark):
    texts = ["Ｆｕｌｌ １２", "ﬁnance of ﬂow", "café now", "zero​width soft­hyphen", "no break　wide", "pаypal trаde", "plain café — “quote” …", "Москва is fine", "tab\tand\nline", "", None, "x" * 50_000 + "​"]
    got = forms(spark, texts)
    assert got[0] == ("Full 12", ["wide"]) and got[1] == ("finance of flow", ["ligature"])
    assert got[2] == ("café now", ["mark"]) and got[3] == ("zerowidth softhyphen", ["invisible"])
    assert got[4] == ("no break wide", ["blank"]) and got[5] == ("paypal trade", ["foreign"])
    assert got[11] == ("x" * 50_000, ["invisible"]) and not {6, 7, 8, 9, 10} & set(got)


def test_marks_in_canonical_order(spark):
    texts = ["ậb", "ậb", "q̣́", "́start", "é́", "ñå"]
    for i, (text, _) in forms(spark, texts).items():
        assert text == unicodedata.normalize("NFC", texts[i]), i


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aḅ\u0301\u0323é\u00a0\u200b１-", max_size=12), min_size=1, max_size=20))
def test_is_idempotent(spark, texts):
    """What cannot be composed stays, and is still reported, but nothing changes any more."""
    once = [t for t, _ in forms(spark, texts).values()]
    assert all(t == once[i] for i, (t, _) in forms(spark, once).items())


def test_keys_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (2, "ab", "", "")], SCHEMA)
    assert [r[0] for r in lookalikes.keys_with_kinds(df, "id", "body").collect()] == [1]
    assert lookalikes.keys_with_kinds(df.limit(0), "id", "body").count() == 0


def test_typefaces_and_more_letters(spark):
    rows = [(1, "\U0001d407\U0001d41e\U0001d425\U0001d425\U0001d428"), (2, "ℌello"), (3, "Ꭺpple"), (4, "Ⲟpen"), (5, "b\u03ccnd"), (6, "plain")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r["key"]: r["text"] for r in lookalikes.one_form(df, "id", "text").collect()}
    assert got == {1: "Hello", 2: "Hello", 3: "Apple", 4: "Open", 5: "b\u00f3nd"}
    assert {r["key"] for r in lookalikes.keys_with_kinds(df, "id", "text").collect()} == {3, 4, 5}
