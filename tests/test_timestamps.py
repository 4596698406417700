"""The timestamp dictionary against an independent parser with the zone database."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidewire.operators.timestamps import TimestampDictionary, parse_dictionary, utc_text, with_site_clock

SCHEMA = "raw string, zone_name string, day_first boolean"


def instants(spark, rows):
    out = parse_dictionary(spark.createDataFrame(rows, SCHEMA)).select("raw", "zone_name", utc_text(F.col("instant_us")).alias("t"), F.col("day").cast("string").alias("d")).collect()
    return {(r[0], r[1]): (r[2], r[3]) for r in out}


def test_styles(spark):
    ny = "America/New_York"
    cases = {
        ("2025-01-20T16:01:26Z", ny): "2025-01-20T16:01:26.000000Z",
        ("2022-02-04T16:20:59+12:45", ny): "2022-02-04T03:35:59.000000Z",
        ("2022-07-08T16:20+01", ny): "2022-07-08T15:20:00.000000Z",
        ("2024-12-28 09:51:13.705+00:00", ny): "2024-12-28T09:51:13.705000Z",
        ("2022-09-01T15:51:01.5621315Z", ny): "2022-09-01T15:51:01.562131Z",
        ("1688447390624", ny): "2023-07-04T05:09:50.624000Z",
        ("1666206628", ny): "2022-10-19T19:10:28.000000Z",
        ("20250930T104347Z", ny): "2025-09-30T10:43:47.000000Z",
        ("Fri, 18 Feb 2022 10:43:30 +0100", ny): "2022-02-18T09:43:30.000000Z",
        ("Thu Apr 28 21:20:21 EDT 2022", ny): "2022-04-29T01:20:21.000000Z",
        ("June 24, 2026 9:53 PM", ny): "2026-06-25T01:53:00.000000Z",
        ("Jumat, 16 Desember 2022 05:11 WIB", ny): "2022-12-15T22:11:00.000000Z",
        ("21 Agustus 2025 19.16 WIB", ny): "2025-08-21T12:16:00.000000Z",
        ("October 13, 2022 6:36 a.m. ET", ny): "2022-10-13T10:36:00.000000Z",
        ("5/27/2026 12:12 AM", ny): "2026-05-27T04:12:00.000000Z",
        ("  2026-05-07 ", ny): "2026-05-07T04:00:00.000000Z",
    }
    got = instants(spark, [(r, z, False) for r, z in cases])
    assert {k: v[0] for k, v in got.items()} == cases


def test_day_order_and_site_meaning(spark):
    rows = [("09/04/2024 19:57", "Europe/London", True), ("09/04/2024 19:57", "America/New_York", False), ("Wed, 04 Jun 2025 16:54:44 IST", "Asia/Kolkata", True), ("Wed, 04 Jun 2025 16:54:44 IST", "Europe/Dublin", True)]
    got = instants(spark, rows)
    assert got["09/04/2024 19:57", "Europe/London"][0] == "2024-04-09T18:57:00.000000Z"
    assert got["09/04/2024 19:57", "America/New_York"][0] == "2024-09-04T23:57:00.000000Z"
    assert got["Wed, 04 Jun 2025 16:54:44 IST", "Asia/Kolkata"][0] == "2025-06-04T11:24:44.000000Z"
    assert got["Wed, 04 Jun 2025 16:54:44 IST", "Europe/Dublin"][0] == "2025-06-04T15:54:44.000000Z"


def test_clock_changes_against_zone_database(spark):
    """Each half hour around both changes; fold 0 is the first occurrence and moves a skipped time forward."""
    rows, want = [], {}
    for name, days in {"America/New_York": ("2023-03-12", "2023-11-05"), "Europe/Berlin": ("2024-03-31", "2024-10-27"), "Australia/Sydney": ("2025-04-06", "2025-10-05")}.items():
        for day in days:
            start = datetime.fromisoformat(day)
            for step in range(12):
                local = start + timedelta(minutes=30 * step)
                rows.append((local.strftime("%Y-%m-%d %H:%M"), name, False))
                want[rows[-1][:2]] = local.replace(tzinfo=ZoneInfo(name)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    assert {k: v[0] for k, v in instants(spark, rows).items()} == want


def test_session_zone_has_no_influence(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert instants(spark, [("2023-03-12 02:30", "America/New_York", False)])["2023-03-12 02:30", "America/New_York"][0] == "2023-03-12T07:30:00.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_no_times(spark):
    texts = ["", "-", "just now", "n/a", "Invalid Date", "0000-00-00 00:00:00", "2023-02-30T10:15:00Z", "2024-13-05 08:00:00", "31/31/2022 10:00", "2024-01-05 25:10", "9" * 30, "x" * 100_000, "13/5/2024 13:00 PM", "Mon, 5 Foo 2024 10:00:00 GMT", "Mon, 5 Jan 2024 10:00:00 QQQ"]
    got = parse_dictionary(spark.createDataFrame([(x, "UTC", False) for x in texts], SCHEMA)).filter("instant_us is not null").select("raw").collect()
    assert got == []


def test_trading_days(spark):
    rows = {"12/20/2022": "2022-12-20", "20250310": "2025-03-10", "2022-06-15T17:00:00.000Z": "2022-06-16", "2022-08-07T13:00:00-04:00": "2022-08-08", "1738256400000": "2025-01-31", "08-Aug-2025": "2025-08-08", "2024-12-24 00:00:00": "2024-12-24"}
    got = instants(spark, [(r, None, False) for r in rows])
    assert {k[0]: v[1] for k, v in got.items()} == rows


def test_dictionary_grows_and_joins_back(spark, tmp_path):
    d = TimestampDictionary(spark, f"file://{tmp_path}/dictionary")
    rows = spark.createDataFrame([(1, "2024-01-05", "UTC", False), (2, "2024-01-05", "UTC", False), (3, None, "UTC", False), (4, "nonsense", "UTC", False), (5, "2024-01-05", None, None)], "id bigint, " + SCHEMA)
    got = {r[0]: r[1] for r in d.normalise(rows, "id").collect()}
    assert got[1] == got[2] == 1704412800000000 and 3 not in got and 4 not in got and got[5] is None
    first = spark.read.parquet(d.path).count()
    more = spark.createDataFrame([(6, "2024-01-05", "UTC", False), (7, "2024-01-06", "UTC", False)], "id bigint, " + SCHEMA)
    assert d.normalise(more, "id").count() == 2
    assert spark.read.parquet(d.path).count() == first + 1


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "id bigint, url string, raw string, site string, zone_name string")
    clocks = spark.createDataFrame([("a.example", "UTC", False)], "site string, zone_name string, day_first boolean")
    assert TimestampDictionary(spark).normalise(with_site_clock(df, clocks, "id", "url", "raw"), "id").count() == 0
    one = spark.createDataFrame([(1, "HTTPS://WWW.A.example/x", "2024-01-05", "x", "y")], df.schema)
    assert TimestampDictionary(spark).normalise(with_site_clock(one, clocks, "id", "url", "raw"), "id").count() == 1


def test_long_strings_are_parsed_like_short_ones(spark):
    raw = [" " * 500 + "2024-01-05T10:00:00Z" + "\t" * 200, "2024-01-05T10:00:00." + "1" * 300 + "Z", "word " * 100_000, "9" * 50_000]
    entries = spark.createDataFrame([(r, "UTC", False) for r in raw], "raw string, zone_name string, day_first boolean")
    got = {r["raw"]: r["instant_us"] for r in parse_dictionary(entries).collect()}
    assert got[raw[0]] == 1704448800000000 and got[raw[1]] == 1704448800111111 and got[raw[2]] is None and got[raw[3]] is None
