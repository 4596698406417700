"""One consistent form for text that looks the same (problem 7).

Tokens that hold an unusual character are exploded to positioned code points,
once per distinct token. A broadcast join with the decomposition and look-alike
tables, which are as large as Unicode makes them and no larger, replaces each
code point; combining marks are ordered by class, composed again, and the
strings rebuilt and put back into the rows.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.runtime import cut

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ү": "y", "ѵ": "v", "ԍ": "G",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "μ": "u", "ε": "e", "τ": "t", "η": "n", "σ": "o", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Լ": "L", "Տ": "S", "ց": "g", "զ": "q", "յ": "j",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲥ": "C", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
}

#: Characters whose tokens are looked at; every other character is already in its one form.
UNUSUAL = r"[\p{M}\p{Cf}\x{2000}-\x{200A}\x{00A0}\x{1680}\x{202F}\x{205F}\x{3000}\x{3001}-\x{303F}\x{FF00}-\x{FFEF}\x{FB00}-\x{FB4F}\x{FE00}-\x{FE0F}\x{2126}\x{212A}\x{212B}\x{F900}-\x{FAFF}]|[\x{1D400}-\x{1D7FF}\x{2100}-\x{214F}]|[\p{L}&&[^\p{IsLatin}]]"
#: Tried at the begin of a token only, and without going back, so that long tokens take linear time.
_TOKEN = r"(?<![^ \t\n\r])[^ \t\n\r\x{80}-\x{10FFFF}]*+[^\x00-\x7F][^ \t\n\r]*"
_PIECES = r"[^ \t\n\r]+|[ \t\n\r]+"
_WORD_CHAR = r"^[\p{L}\p{M}\p{Cf}]$"
KINDS = ("wide", "ligature", "mark", "invisible", "blank", "foreign")
#: Letters in another typeface, as mathematics has them; brought to the one form, but no sign of disguise.
FONT = "font"


@cache
def _tables() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Decompositions ``(ch, parts, kind)``, mark classes ``(ch, ccc)`` and pairs ``(pair, composed)``, by rule from the Unicode database."""
    parts, classes, pairs = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co", "Cs"):
            continue
        tag, _, _ = unicodedata.decomposition(ch).partition(" ")
        canonical = tag and not tag.startswith("<") and not 0xAC00 <= code < 0xD7A4
        kind = None
        out = unicodedata.normalize("NFD", ch) if canonical else ch
        if category == "Zs":
            kind, out = "blank", " "
        elif tag in ("<wide>", "<narrow>"):
            kind, out = "wide", unicodedata.normalize("NFKD", ch)
        elif tag == "<font>" and category[0] in "LN":
            kind, out = FONT, unicodedata.normalize("NFKD", ch)
        elif 0xFB00 <= code < 0xFB50:
            kind, out = "ligature", unicodedata.normalize("NFKD", ch)
        elif category[0] == "M":
            kind = "mark"
        elif category == "Cf":
            kind, out = "invisible", ""
        if kind or out != ch:
            parts.append((ch, out, kind))
        if ccc := unicodedata.combining(ch):
            classes.append((ch, ccc))
        if canonical and len(d := unicodedata.decomposition(ch).split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            pairs.append((chr(int(d[0], 16)) + chr(int(d[1], 16)), ch))
    return parts, classes, pairs


def _frames(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts, classes, pairs = _tables()
    # A look-alike with an accent is one of its base with the accent.
    latin = {c: LOOKALIKES[o[0]] + o[1:] for c, o, k in parts if o and o[0] in LOOKALIKES} | LOOKALIKES
    looks = {c: (o, k, latin.get(c)) for c, o, k in parts} | {c: (c, None, x) for c, x in LOOKALIKES.items() if c not in {p[0] for p in parts}}
    return (
        spark.createDataFrame([(c, *v) for c, v in looks.items()], "ch string, parts string, kind string, latin string"),
        spark.createDataFrame(classes, "ch string, ccc int"),
        spark.createDataFrame(pairs, "pair string, composed string"),
    )


def _name(token: str) -> Column:
    """What stands for a token in the rows of its code points: itself, or a digest of a long one."""
    return F.when(F.length(token) > 64, F.concat(F.lit(" "), F.md5(token))).otherwise(F.col(token))


def token_forms(tokens: DataFrame) -> DataFrame:
    """``name, form, kinds`` for each distinct token of ``tokens (token)``; ``kinds`` lists what was unusual in it."""
    spark = tokens.sparkSession
    parts, classes, pairs = _frames(spark)
    points = tokens.select(_name("token").alias("name"), F.posexplode(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    # A word is a run of letters, marks and invisible characters.
    order = Window.partitionBy("name").orderBy("pos")
    word = Window.partitionBy("name", "word")
    points = points.withColumn("word", F.sum(F.when(F.col("ch").rlike(_WORD_CHAR), 0).otherwise(1)).over(order))
    latin = F.max(F.col("ch").rlike(r"\p{IsLatin}").cast("int")).over(word) == 1
    foreign = F.col("ch").rlike(r"[\p{L}&&[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]]")
    points = points.withColumn("foreign", latin & foreign).join(F.broadcast(parts), "ch", "left")
    points = points.withColumn("kind", F.when(F.col("foreign"), "foreign").otherwise(F.col("kind")))
    out = F.when(F.col("foreign") & F.col("latin").isNotNull(), F.col("latin")).otherwise(F.coalesce("parts", "ch"))
    # An invisible character leaves nothing, but its row keeps the kind.
    atoms = points.select("name", "pos", "kind", F.posexplode_outer(F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0))).alias("sub", "c"))
    atoms = atoms.join(F.broadcast(classes.withColumnRenamed("ch", "c")), "c", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    reading = Window.partitionBy("name").orderBy("pos", "sub")
    atoms = atoms.withColumn("starter", F.sum(F.when((F.col("ccc") == 0) & F.col("c").isNotNull(), 1).otherwise(0)).over(reading))
    clusters = atoms.groupBy("name", "starter").agg(
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("ccc", "pos", "sub", "c")))).alias("marks"),
        F.collect_set("kind").alias("kinds"),
    )
    simple = clusters.filter(F.size("marks") <= 1).select("name", "starter", F.coalesce(F.try_element_at("marks", F.lit(1))["c"], F.lit("")).alias("text"), "kinds")
    return _joined(simple.unionByName(_composed(clusters.filter(F.size("marks") > 1), pairs)))


def _composed(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fold the ordered marks of each cluster onto its starter; a mark behind another of the same class stays."""
    table = F.broadcast(pairs.agg(F.map_from_entries(F.collect_list(F.struct("pair", "composed"))).alias("pairs")))

    def step(acc, mark):
        made = F.try_element_at(F.col("pairs"), F.concat(acc["base"], mark["c"]))
        free = acc["last"] < mark["ccc"]
        return F.struct(
            F.when(free & made.isNotNull(), made).otherwise(acc["base"]).alias("base"),
            F.when(free & made.isNotNull(), acc["rest"]).otherwise(F.concat(acc["rest"], mark["c"])).alias("rest"),
            F.when(free & made.isNotNull(), acc["last"]).otherwise(mark["ccc"]).alias("last"),
        )

    first = F.element_at("marks", 1)
    start = F.struct(first["c"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    folded = F.aggregate(F.slice("marks", 2, F.greatest(F.size("marks") - 1, F.lit(0))), start, step)
    return clusters.crossJoin(table).withColumn("f", folded).select("name", "starter", F.concat("f.base", "f.rest").alias("text"), "kinds")


def _joined(clusters: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("starter", "text"))), lambda x: x["text"]), "")
    return clusters.groupBy("name").agg(text.alias("form"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


def _unusual_tokens(texts: DataFrame) -> DataFrame:
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)))
    found = texts.select("key", F.explode(tokens).alias("token")).filter(F.col("token").rlike(UNUSUAL))
    return found.withColumn("name", _name("token"))


def one_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, kinds`` of every row whose text isn't in the one form, with the text in it.

    Canonical composition, ordinary width, ligatures in letters, ordinary
    blanks, no invisible characters, and Latin letters in place of look-alikes
    in words that have Latin letters. ``kinds`` names what was found,
    of :data:`KINDS` or :data:`FONT`; it is empty where only equal canonical forms differ. A null
    or empty text is in the one form. Other columns are ignored, and a key that
    occurs twice is treated row by row, its kinds united.
    """
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(UNUSUAL))
    tokens = cut(_unusual_tokens(texts), "tokens")
    forms = cut(token_forms(tokens.select("token").distinct()), "forms")
    changed = (F.col("form") != F.col("token")) | (F.size("kinds") > 0)
    found = tokens.join(forms, "name").filter(changed).groupBy("key").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("token", "form")))).alias("_map"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"),
    )
    pieces = F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0))
    rebuilt = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("_map", p), p)), "")
    return texts.join(found, "key").select("key", rebuilt.alias("text"), "kinds")


def keys_with_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct keys of the rows in which :func:`one_form` finds at least one of :data:`KINDS`."""
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(UNUSUAL))
    tokens = cut(_unusual_tokens(texts), "tokens")
    forms = cut(token_forms(tokens.select("token").distinct()), "forms").filter(F.size(F.array_except("kinds", F.array(F.lit(FONT)))) > 0)
    return tokens.join(forms.select("name"), "name", "left_semi").select("key").distinct()
