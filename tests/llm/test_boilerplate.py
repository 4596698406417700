from __future__ import annotations

import random

from tidewire.llm import boilerplate

SCHEMA = "article_id bigint, url string, title string, body string, site string, n bigint"


def pages():
    rng = random.Random(8)
    name = lambda: "".join(rng.choices("bdfgklmnprst", k=2)).capitalize() + rng.choice(["ola", "erik", "usto"])
    rows, furniture = [], set()
    for i in range(120):
        host = ["dailykabar", "otherwire"][i % 3 == 0]
        lines = [
            ("Home | Markets | Data | Video", True), (f"By {name()} {name()}", True), (f"{name()} said the {name()} rate fell by {rng.randint(1, 99)} percent in early trade on Monday.", False),
            (f"The view from {name()}", False), (f"Most read: {name()} risk grows at {name()} as rates shift", True), (f"Sign up for the {host.capitalize()} evening letter", True), ("", None),
            (f"{name()} told reporters that {name()} would buy {rng.randint(1, 99)} ships before the end of {name()}.", False), (f"© 2024 {host.capitalize()} Media. All material is protected and may not be reused.", True),
            (f"Join {name()} and {name()} at our {name()} forum this week", True),
        ]
        rows.append((i, f"https://{'www.' if i % 2 else ''}{host}.example/{i}", f"{name()} risk grows at {name()} as rates shift", "\n".join(x for x, _ in lines), "s", 0))
        furniture |= {(i, no) for no, (_, f) in enumerate(lines, 1) if f}
    return rows, furniture


def test_known_templates(spark):
    rows, furniture = pages()
    got = {tuple(r) for r in boilerplate.furniture(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == furniture


def test_parts_of_a_host_know_its_whole_template(spark, monkeypatch):
    rows, furniture = pages()
    monkeypatch.setattr(boilerplate, "PART", 5_000)
    assert {tuple(r) for r in boilerplate.furniture(spark.createDataFrame(rows, SCHEMA)).collect()} == furniture


def test_nulls_long_and_empty(spark):
    rows = [(1, None, "t", "By X\nline", "", 0), (2, "https://a.example/", None, None, "", 0), (3, "https://a.example/", None, "", "", 0), (4, "https://a.example/", "t", "word " * 50_000 + "\nBy Some One", "", 0), (4, "https://a.example/", "t", "By Some One", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    # Two pages without prose are no evidence of anything.
    assert boilerplate.furniture(df).collect() == []
    assert boilerplate.furniture(df.limit(0)).count() == 0


def _own(spark, rows):
    return boilerplate._pages(spark.createDataFrame(rows, SCHEMA), "article_id", "url", "title", "body")


def test_classes_share_their_pages(spark):
    own = _own(spark, pages()[0])
    host = own.filter("site = 'dailykabar.example'").first()["host"]
    found = {(r["host"], r["gram"]): (r["class"], r["size"]) for r in boilerplate.occurrence_classes(own).collect()}
    grams = [int(t) for t in boilerplate.pairs_of(["Sign up for the Dailykabar evening letter"], boilerplate._Words("dailykabar.example"))[0]]
    assert len({found[host, g] for g in grams}) == 1 and found[host, grams[0]][1] >= len(grams)


def test_order_crossing_and_nesting_of_classes():
    at = boilerplate._Examiner()
    at._check([(1, 11), (2, 21), (2, 22), (1, 12)])
    assert {k[::2]: v for k, v in at.drain().items()} == {(1, 0): [1, 0], (2, 1): [1, 0]}
    at._check([(1, 11), (2, 21), (1, 12), (2, 22)])
    assert sorted(k[0] for k, v in at.drain().items() if v[1]) == [2]
    at._check([(1, 11), (1, 12)]), at._check([(1, 12), (1, 11)])
    assert len(at.drain()) == 2


def test_frames_decide_what_recurs_in_no_whole_line(spark):
    """Without frames only the lines that recur as a whole would go; the frames' marks say why the others do."""
    rows, furniture = pages()
    examined = boilerplate.examined(_own(spark, rows))
    whole = {(r[0], r[1]) for r in examined.filter("whole").select("key", "line_no").collect()}
    assert len(furniture - whole) == 3 * len(rows) and whole < furniture
    frames = {r["frame"]: r for r in boilerplate.frame_table(examined).filter("host = xxhash64('dailykabar.example')").collect()}
    of = lambda token: frames[boilerplate.token_hash(token)]
    assert of("^ by")["outside"] == of("^ by")["lines"] and of("^ by")["furniture"]
    assert of("^ most")["headline"] > 0.9 * of("^ most")["lines"] and of("^ most")["furniture"]
    assert of("^ the")["marked"] < 0.3 * of("^ the")["lines"] and not of("^ the")["furniture"]


def test_a_class_out_of_order_is_no_frame(spark):
    rows, _ = pages()
    table = boilerplate.class_table(boilerplate.examined(_own(spark, rows)))
    assert table.filter("ordered < 0.9 or nested < 0.9").count() < 0.1 * table.count()
