"""One consistent form of text that looks alike but is written with other characters.

Distinct strings that hold anything unusual are exploded to positioned code points, joined with a
broadcast table of decompositions and look-alikes (its size is bounded by Unicode's) and rebuilt.
Strings with combining marks are decomposed, their marks ordered by class within each base, and
recomposed. Look-alike letters are replaced word by word: a word with a letter of another script
that has no Latin look-alike is truly of that script and stays.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other alphabets and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S",
    "Т": "T", "Ԝ": "W", "Х": "X", "Ү": "Y", "У": "Y", "Ӏ": "I",
    # Greek, small and capital
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϳ": "J",
    # Armenian and Latin variants
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ɡ": "g", "ɑ": "a", "ɩ": "i", "ʟ": "l", "ᴏ": "o", "ꜱ": "s",
}
# small capitals, by their names
LOOKALIKES |= {chr(n): m[1].lower() for n in range(0x250, 0x10000) if (m := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(n), "")))}
#: Of these the small forms differ from the Latin letter; alone they don't make a word Latin.
LOOSE = "гкмнтв"
#: Characters that no table entry concerns: printable ASCII, composed Latin letters, Han, kana, Hangul syllables.
PLAIN = (
    r"^[\x20-\x7e\x{c0}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{1ea0}-\x{1ef9}"
    r"\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{30fc}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]*$"
)
_FOREIGN = r"\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}"


def _entries() -> list[tuple[str, str, str, str, int]]:
    """(ch, plain, nfd, like, ccc) of every code point that any of these changes."""
    rows = []
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs") or 0xAC00 <= n <= 0xD7A3:
            continue
        ccc = unicodedata.combining(c)
        if kind == "Cf" or n == 0x34F or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or n in (0x115F, 0x1160, 0x3164, 0xFFA0):
            plain = ""
        elif kind in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85":
            plain = " "
        elif kind == "Mn":
            plain = c
        else:
            plain = unicodedata.normalize("NFKC", c)
        nfd, like = unicodedata.normalize("NFD", plain), LOOKALIKES.get(plain, plain)
        if plain != c or nfd != c or like != c or ccc:
            rows.append((c, plain, nfd, like, ccc))
    return rows


def _compositions(entries) -> list[tuple[str, str]]:
    """(decomposed, composed) of every character that NFC composes again."""
    made = {e[0]: e[2] for e in entries if len(e[2]) > 1 and e[1] == e[0]}
    return [(d, c) for c, d in made.items() if unicodedata.normalize("NFC", d) == c]


_cached: dict[str, list] = {}


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    if not _cached:
        _cached["map"] = _entries()
        _cached["compose"] = _compositions(_cached["map"])
    return (
        spark.createDataFrame(pa.table(dict(zip(("ch", "plain", "nfd", "like", "ccc"), map(list, zip(*_cached["map"])))))),
        spark.createDataFrame(pa.table(dict(zip(("nfd", "nfc"), map(list, zip(*_cached["compose"])))))),
    )


def _rebuild(rows: DataFrame, keys: list[str], order: list[str], pieces: dict[str, Column]) -> DataFrame:
    """Concatenate the pieces of each key in order; folded before the shuffle, as a key's rows lie together."""
    both = F.sort_array(F.collect_list(F.struct(*order, *[c.alias(n) for n, c in pieces.items()])))
    got = rows.groupBy(*keys).agg(both.alias("all"))
    return got.select(*keys, *[F.concat_ws("", F.col("all")[n]).alias(n) for n in pieces])


def _recompose(marked: DataFrame, table: DataFrame, compositions: DataFrame) -> DataFrame:
    """(s, base): base decomposed, its marks put in canonical order per base, and composed again."""
    parts = marked.select("s", F.posexplode(F.regexp_extract_all("nfd", F.lit(r"\P{M}\p{M}*|\p{M}+"), F.lit(0))).alias("seg", "part"))
    at = parts.select("s", "seg", F.posexplode(F.split("part", "")).alias("i", "ch"))
    at = at.join(F.broadcast(table.where("ccc > 0").select("ch", "ccc")), "ch", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    segs = at.groupBy("s", "seg").agg(F.collect_list(F.struct("ccc", "i", "ch")).alias("all"))
    given = F.array_sort(F.transform("all", lambda x: F.struct(x["i"].alias("i"), x["ch"].alias("ch"))))
    # marks of class 0 (vowel signs of some scripts) keep their places
    by_class = F.when(
        F.size(F.filter("all", lambda x: x["ccc"] == 0)) > 1, F.concat_ws("", F.transform(given, lambda x: x["ch"]))
    ).otherwise(F.concat_ws("", F.transform(F.array_sort("all"), lambda x: x["ch"])))
    segs = segs.select("s", "seg", by_class.alias("nfd"))

    @F.arrow_udf("string")
    def rest(parts: pa.Array) -> pa.Array:
        return pa.array([x and unicodedata.normalize("NFC", x) for x in parts.to_pylist()], type=pa.string())

    one = F.length("nfd") == 1
    done = segs.join(F.broadcast(compositions), "nfd", "left").withColumn("nfc", F.when(one & F.col("nfc").isNull(), F.col("nfd")).otherwise(F.col("nfc")))
    # a base with more marks than any composed character has
    done = done.where("nfc is not null").unionByName(done.where("nfc is null").withColumn("nfc", rest(F.col("nfd"))))
    return _rebuild(done, ["s"], ["seg"], {"base": F.col("nfc")})


def canonical_forms(strings: DataFrame) -> DataFrame:
    """(s, canonical) for the distinct strings of the one column s that are not plain already.

    Null and plain strings (see PLAIN) have no row: they are their own form. An empty result of
    ignorable characters alone is ''. Long strings are handled whole; letter case stays."""
    spark = strings.sparkSession
    table, compositions = _tables(spark)
    small = F.broadcast(table)
    odd = strings.where(~F.col("s").rlike(PLAIN)).distinct()
    points = odd.select("s", F.posexplode(F.split("s", "")).alias("pos", "ch")).join(small, "ch", "left")
    flat = _rebuild(
        points, ["s"], ["pos"],
        {"base": F.coalesce("plain", "ch"), "like": F.coalesce("like", "ch"), "nfd": F.coalesce("nfd", "ch")},
    )
    marks = F.col("base").rlike(r"\p{M}")
    # a mark keeps its base from being looked up in one step: the look-alikes of such strings are mapped after recomposition
    redone = _recompose(flat.where(marks).select("s", F.col("nfd")), table, compositions)
    again = redone.select("s", "base", F.translate("base", "".join(LOOKALIKES), "".join(LOOKALIKES.values())).alias("like"))
    flat = flat.where(~marks).select("s", "base", "like").unionByName(again)

    letters = r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"
    sure = "".join(k for k in LOOKALIKES if k not in LOOSE)
    foreign_word = rf"[{_FOREIGN}&&[^{''.join(LOOKALIKES)}]]"  # a letter without a look-alike
    loose_only = rf"^[{LOOSE}]+$"
    words = F.zip_with(
        F.regexp_extract_all("base", F.lit(letters), F.lit(0)),
        F.regexp_extract_all("like", F.lit(letters), F.lit(0)),
        lambda b, k: F.when(
            b.rlike(foreign_word) | (~b.rlike(r"\p{IsLatin}") & (F.col("base").rlike(foreign_word) | b.rlike(loose_only) | b.rlike(rf"[{LOOSE}]"))), b
        ).otherwise(k),
    )
    # composed again: a look-alike base and its mark may have a composed Latin form
    out = flat.withColumn("canonical", F.concat_ws("", words))
    fixed = out.where(F.col("canonical").rlike(r"\p{M}")).select("s", "canonical")
    kept = out.where(~F.col("canonical").rlike(r"\p{M}")).select("s", "canonical")
    nfd = fixed.select(F.col("s"), F.col("canonical").alias("nfd"))
    last = _recompose(nfd, table, compositions).select("s", F.col("base").alias("canonical"))
    return kept.unionByName(last)


def consistent_columns(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with each of the string columns in its one consistent form; null stays null, other columns and rows stay as they are."""
    out = rows
    for f in fields:
        forms = canonical_forms(rows.select(F.col(f).alias("s"))).select(F.col("s").alias("__s"), F.col("canonical").alias("__c"))
        out = out.join(forms, out[f] == forms["__s"], "left").withColumn(f, F.coalesce("__c", f)).drop("__s", "__c")
    return out


def disguised(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name) of every field that is not in the consistent form."""
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("s")) for f in fields]))
    long = rows.select(F.col(key), pairs).where(~F.col("s").rlike(PLAIN))
    forms = canonical_forms(long.select("s")).where(F.col("canonical") != F.col("s")).select("s")
    return long.join(forms, "s").select(key, "field_name")
