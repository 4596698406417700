"""Mixed timestamp styles, precisions and zones, as one UTC instant (problem 1).

The distinct raw strings, each with the zone and the day order of its source,
form a dictionary. Every entry is parsed once, by column expressions, and
appended to a table on disk; later runs parse what is new. Instants are joined
back to the rows.

All arithmetic is on microseconds since 1970-01-01 UTC, so that the session's
time zone has no influence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import site_of, squeeze
from tidewire.runtime import new_folder

# First letters of month names, English and Indonesian.
MONTHS = {"jan": 1, "feb": 2, "peb": 2, "mar": 3, "apr": 4, "may": 5, "mei": 5, "jun": 6, "jul": 7, "aug": 8, "agu": 8, "ags": 8, "agt": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "nop": 11, "dec": 12, "des": 12}
_MONTH = (
    "jan(?:uary|uari)?|feb(?:ruary|ruari)?|peb(?:ruari)?|mar(?:ch|et)?|apr(?:il)?|may|mei|june?|juni|july?|juli|aug(?:ust)?|agu(?:st|stus)?|ags|agt"
    "|sept?(?:ember)?|oct(?:ober)?|okt(?:ober)?|nov(?:ember)?|nop(?:ember)?|dec(?:ember)?|des(?:ember)?"
)
# Minutes east of UTC that a zone abbreviation stands for.
OFFSETS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "IST": 330, "PKT": 300, "WIB": 420, "WITA": 480, "WIT": 540, "ICT": 420, "SGT": 480, "MYT": 480, "HKT": 480, "PHT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "GST": 240,
}
# Abbreviations that mean another offset at a site in the named zone.
SITE_OFFSETS = {
    ("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120, ("BST", "Asia/Dhaka"): 360, ("CST", "Asia/Shanghai"): 480, ("CST", "Asia/Taipei"): 480,
    ("EST", "Australia/Sydney"): 600, ("EDT", "Australia/Sydney"): 660, ("EST", "Australia/Melbourne"): 600, ("EDT", "Australia/Melbourne"): 660,
}
# Abbreviations that name a zone with its clock changes.
REGIONS = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles", "AET": "Australia/Sydney"}

_DAYNAME = r"(?:[a-z]{2,10}(?:'[a-z]{1,4})?\.?,? )?"
_ZONE = r"(z|[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,4}[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5}|\([a-z]{2,5}\))?"
_CLOCK = r"(?:(?:,? (?:at |pukul )?|,| - )(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)? ?([ap]\.?m\.?)? ?" + _ZONE + ")?"
#: Style, pattern over the squeezed lower-case string, and the groups of year, month, day, hour, minute, second, fraction, am/pm and zone.
STYLES = (
    ("iso", r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[t ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)? ?" + _ZONE + "$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("basic", r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?" + _ZONE + ")?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("day first", "^" + _DAYNAME + r"(\d{1,2})[ -](" + _MONTH + r")\.?,?[ -](\d{4})" + _CLOCK + "$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    ("month first", "^" + _DAYNAME + "(" + _MONTH + r")\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _CLOCK + "$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    ("year last", r"^[a-z]{3} (" + _MONTH + r") (\d{1,2}) (\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))? (?:([a-z]{1,5}|[+-]\d{2}:?\d{2}) )?(\d{4})$", (8, 1, 2, 3, 4, 5, 6, 0, 7)),
    ("slashes", r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _CLOCK + "$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    ("slashes, year first", r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _CLOCK + "$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
)
_COUNT = r"^[+-]?\d{9,20}(?:\.\d+)?$"
_DAY_US = 86_400_000_000


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _of(s: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit("")) if group else F.lit(None).cast("string")


def _parts(s: Column, day_first: Column) -> Column:
    """A struct of the strings written for each part; null if no style fits."""
    names = ("y", "mo", "d", "h", "mi", "s", "f", "ap", "zone")
    choices = []
    for style, pattern, groups in STYLES:
        got = dict(zip(names, (_of(s, pattern, g) for g in groups), strict=True))
        if style == "slashes":
            got["d"], got["mo"] = F.when(day_first, got["d"]).otherwise(got["mo"]), F.when(day_first, got["mo"]).otherwise(got["d"])
        choices.append(F.when(s.rlike(pattern), F.struct(*[v.alias(k) for k, v in got.items()])))
    return F.coalesce(*choices)


def _seconds_east(zone: Column, site_zone: Column) -> Column:
    """Offset of a written zone; null for none, for a region and for an unknown abbreviation."""
    pattern = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    size = F.regexp_extract(zone, pattern, 2).try_cast("int") * 3600 + F.coalesce(F.regexp_extract(zone, pattern, 3).try_cast("int"), F.lit(0)) * 60
    numeric = F.when(zone.rlike(pattern), F.when(F.regexp_extract(zone, pattern, 1) == "-", -size).otherwise(size))
    name = F.upper(F.regexp_replace(zone, r"[()]", ""))
    local = _lookup({f"{a} {z}": m for (a, z), m in SITE_OFFSETS.items()}, F.concat_ws(" ", name, site_zone))
    return F.coalesce(numeric, local * 60, _lookup(OFFSETS, name) * 60).cast("bigint")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions use often.

    The optimizer would write such an expression out wherever it is used; a
    generator of one row stands in the way.
    """
    made = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made"))
    return made.select(*df.columns, *[F.col(f"_made.{n}").alias(n) for n in columns])


def parse_dictionary(entries: DataFrame) -> DataFrame:
    """Parse ``entries (raw, zone_name, day_first)``.

    Adds ``instant_us`` (microseconds of the UTC instant, null if the string
    denotes none) and ``day`` (the calendar day as written, or the Jakarta day
    of the instant if the string has a zone or is a count). A local time that
    occurs twice is its first occurrence; a skipped one moves forward.
    """
    step = _once(entries, _s=F.lower(squeeze(F.col("raw"))))
    step = _once(step, _p=_parts(F.col("_s"), F.coalesce("day_first", F.lit(False))))
    month = F.coalesce(F.col("_p.mo").try_cast("int"), _lookup(MONTHS, F.substring("_p.mo", 1, 3)))
    hour = F.coalesce(F.col("_p.h").try_cast("int"), F.lit(0))
    afternoon = F.col("_p.ap").startswith("p")
    hour = F.when(F.col("_p.ap").isNull(), hour).when((hour >= 1) & (hour <= 12), F.pmod(hour, F.lit(12)) + F.when(afternoon, 12).otherwise(0)).otherwise(F.lit(99))
    step = _once(
        step,
        _mo=month, _h=hour,
        _mi=F.coalesce(F.col("_p.mi").try_cast("int"), F.lit(0)),
        _sec=F.coalesce(F.col("_p.s").try_cast("int"), F.lit(0)),
        _f=F.coalesce(F.rpad(F.substring("_p.f", 1, 6), 6, "0").try_cast("bigint"), F.lit(0)),
        _east=_seconds_east(F.col("_p.zone"), F.col("zone_name")),
    )
    date = F.expr("try_to_date(concat_ws('-', _p.y, lpad(cast(_mo as string), 2, '0'), lpad(_p.d, 2, '0')), 'yyyy-MM-dd')")
    step = _once(step, _date=F.when(F.col("_p.y").try_cast("int").between(1, 9999), date))
    valid = F.col("_date").isNotNull() & (F.col("_h") < 24) & (F.col("_mi") < 60) & (F.col("_sec") < 60)
    local = F.when(valid, F.unix_date("_date").cast("bigint") * _DAY_US + (F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_sec")).cast("bigint") * 1_000_000 + F.col("_f"))
    number = F.when(F.col("_s").rlike(_COUNT) & F.col("_p").isNull(), F.col("_s").try_cast("decimal(38,10)"))
    digits = F.length(F.regexp_extract("_s", r"\d+", 0))
    scale = F.when(digits <= 11, 1_000_000).when(digits <= 14, 1_000).when(digits <= 17, 1)
    counted = F.when(digits <= 17, F.floor(number * scale)).otherwise(F.floor(number / 1000)).try_cast("bigint")
    region = F.coalesce(_lookup(REGIONS, F.upper("_p.zone")), F.when(F.col("_p.zone").isNull(), F.col("zone_name")))
    in_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), region))
    instant = F.coalesce(counted, F.when(F.col("_east").isNotNull(), local - F.col("_east") * 1_000_000), F.when(region.isNotNull(), in_region))
    step = _once(step, _counted=counted, _instant=instant, _valid=valid)
    counted, instant, valid = F.col("_counted"), F.col("_instant"), F.col("_valid")
    zoned = counted.isNotNull() | F.col("_p.zone").isNotNull()
    jakarta = F.date_from_unix_date(F.floor((instant + 7 * 3_600_000_000) / F.lit(_DAY_US)).cast("int"))
    day = F.when(zoned, jakarta).when(valid, F.col("_date"))
    return step.select(*entries.columns, instant.alias("instant_us"), day.alias("day"))


def utc_text(instant_us: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` of microseconds since 1970."""
    day = F.date_from_unix_date(F.floor(instant_us / F.lit(_DAY_US)).cast("int"))
    rest = F.pmod(instant_us, F.lit(_DAY_US))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3_600_000_000), two(F.pmod(F.floor(rest / 60_000_000), F.lit(60))), two(F.pmod(F.floor(rest / 1_000_000), F.lit(60))))
    return F.concat(day.cast("string"), F.lit("T"), clock, F.lit("."), F.lpad(F.pmod(instant_us, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"))


_KEYS = ("raw", "zone_name", "day_first")


class TimestampDictionary:
    """Parsed distinct values in a Parquet table at ``path`` that grows by appends.

    A run reads what is there, parses only new entries, and writes them in one
    commit; a run that fails leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_folder(spark, "timestamps")

    def _stored(self) -> DataFrame | None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.parquet(self.path) if there else None

    def update(self, values: DataFrame) -> DataFrame:
        """Add the entries of ``values (raw, zone_name, day_first)`` that are new; returns the dictionary."""
        entries = values.select(*_KEYS).filter("raw is not null").distinct()
        stored = self._stored()
        if stored is not None:
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in _KEYS]
            entries = entries.alias("n").join(stored.alias("o"), same[0] & same[1] & same[2], "left_anti").select(*_KEYS)
        parse_dictionary(entries).write.mode("append").parquet(self.path)
        return self.spark.read.parquet(self.path)

    def normalise(self, rows: DataFrame, key: str, raw: str = "raw") -> DataFrame:
        """``key, instant_us, day`` for every row of ``rows (key, raw, zone_name, day_first)`` that denotes a time.

        Rows whose string is null, empty or no possible date are left out; equal
        strings share one entry, so repeated rows cost one parse.
        """
        values = rows.select(F.col(key), F.col(raw).alias("raw"), "zone_name", "day_first")
        # Strings that denote nothing may be frequent; they are dropped before the join.
        known = self.update(values).filter("instant_us is not null or day is not null")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in _KEYS[1:]]
        joined = values.filter("raw is not null").alias("r").join(known.alias("d"), (F.col("r.raw") == F.col("d.raw")) & same[0] & same[1])
        return joined.select(F.col(f"r.{key}"), "d.instant_us", "d.day")


def with_site_clock(df: DataFrame, clocks: DataFrame, key: str, url: str, raw: str) -> DataFrame:
    """``key, raw, zone_name, day_first`` with the clock of the row's site; null clock if the site is unknown."""
    rows = df.select(F.col(key), F.col(raw).alias("raw"), site_of(F.col(url)).alias("site"))
    return rows.join(clocks.select("site", "zone_name", "day_first"), "site", "left").drop("site")
