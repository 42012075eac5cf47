"""One surviving record of each group of records with an id, field by field.

Scalar fields are taken from one record each by the order of trust, time and record number; a
description must say something. Whether it does is a latent truth that the sources and four signs
witness: a source backs the text of another if its own for the entity is the same or shares a word
of the entity's own with it, and is silent if it describes the entity otherwise; a sign (stock phrase, filler,
spread over ids, the entity's own name) is silent on texts it has nothing against. The sensitivity
and specificity of each are inferred by expectation-maximisation, so that sources that agree can
overrule a sign; in the same way those of the sources for the multi-valued fields, where every value
judged true is kept. Groups are only ever folded by partial aggregates: none is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..session import BROADCAST_LIMIT, checkpoint, estimated_bytes
from .truth import fit

FROM, TO = "2023-01-01", "2026-06-01"  # usable created_at: from the first, before the second
# Stock phrases that say nothing, in letters and digits only.
STOCK = (
    "asdf", "blank", "comingsoon", "description", "descriptionpending", "dito", "ditto", "dummy", "empty", "foo", "idem", "keineangabe",
    "missing", "na", "nan", "nil", "nodata", "nodescription", "nodescriptionavailable", "none", "notapplicable", "notavailable", "null",
    "objectobject", "pending", "pnbspp", "pp", "placeholder", "ref", "sansobjet", "seeabove", "tba", "tbc", "tbd", "test", "testtest",
    "testtesttest", "tobeannounced", "tobedetermined", "todo", "undefined", "unknown", "value", "x", "xx", "xxx", "xxxx", "待补充", "暂无",
)
# Beginnings of filler and error texts.
FILLER = (
    r"^lorem ipsum|^this (entry|record|item|page) (has been|was|is) |^please (add|insert|enter|provide|fill)|^text folgt|^beschreibung folgt"
    r"|^\{\{.*\}\}$|^%\w+%$|^<[^>]*>\s*(&nbsp;)?\s*</[^>]*>$|^[45]\d\d [a-z ]+|^error\b|^(internal )?server error|^(access denied|not found|bad gateway)"
    r"|^traceback|exception in thread|^#(ref|n/a|value|name|div)"
)
SHARE, LEAST = 0.0005, 3  # a text that this share of all records and this many ids carry is boilerplate; so at most 2,000 texts are
OWN_WORD = 0.005  # a word in the descriptions of this share of all entities is no entity's own; so at most their words / OWN_WORD are
SOURCES = 10  # witnesses of their own; further sources of source_trust are one witness together
SIGNS = ("phrase", "filler", "spread", "name")


def source_key(source: Column) -> Column:
    """Case, outer blanks, and _ or - for a blank make no difference."""
    return F.trim(F.regexp_replace(F.lower(source), "[_-]", " "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{200b}]+", " "))


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _bag(text: Column) -> Column:
    """The words of a name in alphabetical order."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")), " ")


def with_trust(records: DataFrame, trust: DataFrame) -> DataFrame:
    """records with __trust: the highest of the source's spellings in `trust`, else 0."""
    own = trust.groupBy(source_key(F.col("source")).alias("__key")).agg(F.max("trust").alias("__t"))
    if estimated_bytes(trust) < BROADCAST_LIMIT:
        own = F.broadcast(own)
    joined = records.join(own, source_key(records["source"]) == own["__key"], "left")
    return joined.withColumn("__trust", F.coalesce("__t", F.lit(0))).drop("__key", "__t")


def source_index(trust: DataFrame) -> list[str]:
    """Witnesses: the SOURCES most trusted of `trust` (reference data; ties by name), and one for all others."""
    by = trust.where("source IS NOT NULL").groupBy(source_key(F.col("source")).alias("s")).agg(F.max("trust").alias("t"))
    return [*[r[0] for r in by.orderBy(F.desc("t"), "s").limit(SOURCES).collect()], "(other)"]


def _witness(source: Column, names: list[str]) -> Column:
    """The bit of a source."""
    bits = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)])
    return F.coalesce(F.element_at(bits, source_key(source)), F.lit(1 << (len(names) - 1))).cast("long")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))


def _backed(d: DataFrame, small: DataFrame, called: DataFrame, ids: int) -> DataFrame:
    """(id, h, asserted, could): the sources that back each text, and those that describe the entity.

    d: (id, h, bit, clean) of about `ids` entities; small: its (id, h, bit); called: (nid, n), the names of the entities,
    whose words describe nothing. Words of many entities go first; a hot entity is folded by (id, word) before any shuffle,
    so its records never meet."""
    words = d.select("id", "h", "bit", F.explode(_words(F.col("clean"))).alias("w")).withColumn("w", F.xxhash64("w"))
    common = words.groupBy("w").agg(F.approx_count_distinct("id", 0.1).alias("n")).where(F.col("n") >= max(LEAST, OWN_WORD * ids)).select("w")
    said = checkpoint(words.join(F.broadcast(common), "w", "left_anti").groupBy("id", "w", "h").agg(F.bit_or("bit").alias("bit")))
    # words of the entity's own that two sources use
    shared = said.groupBy("id", "w").agg(F.bit_or("bit").alias("m")).where(F.bit_count("m") > 1)
    names = called.select(F.col("nid").alias("id"), F.explode(_words(F.col("n"))).alias("w")).select("id", F.xxhash64("w").alias("w"))
    shared = shared.join(names, ["id", "w"], "left_anti")
    back = said.select("id", "w", "h").join(shared, ["id", "w"]).groupBy("id", "h").agg(F.bit_or("m").alias("m"))
    own = small.groupBy("id", "h").agg(F.bit_or("bit").alias("own"))
    could = small.groupBy("id").agg(F.bit_or("bit").alias("could"))
    # the only source of a text is no witness of it
    alone = F.when(F.bit_count("own") == 1, F.col("own")).otherwise(F.lit(0).cast("long"))
    got = own.join(back, ["id", "h"], "left").join(could, "id")
    return got.select("id", "h", F.coalesce("m", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(alone)).alias("asserted"), F.col("could").bitwiseAND(F.bitwise_not(alone)).alias("could"))


def judge_descriptions(records: DataFrame, trust: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_no, id, chars, usable) of every record with a description and an id, and (source, sensitivity, specificity).

    chars: the length of the text with white space runs as one blank. A text is judged once for an entity, whatever
    records carry it. Patterns of who backs it are counted over all records; their number depends on the sources, not on
    the records (at most 16 * 3^(SOURCES + 1)). Texts are read, but never shuffled."""
    names = source_index(trust)
    d = records.where(F.col("description").isNotNull() & F.col("id").isNotNull()).select(
        "id", "record_no", squeezed(F.col("description")).alias("clean"), F.lower("name").alias("own"), _witness(F.col("source"), names).alias("bit")
    )
    d = let(d, {"low": F.lower("clean"), "letters": _letters(F.col("clean"))}).withColumn("h", F.xxhash64("low"))
    against = (
        F.when((F.col("letters") == "") | F.col("letters").isin(*STOCK), 1).otherwise(0)
        + F.when(F.col("low").rlike(FILLER), 2).otherwise(0)
        + F.when(F.levenshtein(F.col("low"), F.col("own"), 3) >= 0, 8).otherwise(0)
    )
    small = checkpoint(d.select("id", "record_no", "h", "bit", F.length("clean").alias("chars"), F.xxhash64(_bag(F.col("clean"))).alias("b"), against.alias("against")))
    total = small.count()
    spread = (
        small.groupBy("h", "id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n"))
        .where(F.col("n") >= F.lit(max(LEAST, SHARE * total))).select("h", F.lit(4).alias("many"))
    )
    called = records.where(F.col("id").isNotNull()).select(
        F.col("id").alias("nid"),
        F.explode(F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"),
    )
    called = called.where(F.trim("n") != "")
    bags = called.select(F.col("nid").alias("id"), F.xxhash64(_bag(F.col("n"))).alias("b"), F.lit(8).alias("is_name")).distinct()
    seen = small.join(F.broadcast(spread), "h", "left").join(bags, ["id", "b"], "left")
    signs = F.col("against").bitwiseOR(F.coalesce("many", F.lit(0))).bitwiseOR(F.coalesce("is_name", F.lit(0))).cast("long")
    backed = _backed(d.select("id", "h", "bit", "clean"), small.select("id", "h", "bit"), called, small.agg(F.approx_count_distinct("id")).head()[0])
    seen = checkpoint(seen.select("id", "h", "record_no", "chars", signs.alias("against")).join(backed, ["id", "h"]).drop("h"))
    rows = seen.groupBy("against", "asserted", "could").count().collect()
    x, a, c, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
    post, sens, spec = judge_patterns(x, a, c, n, len(names))
    bad = records.sparkSession.createDataFrame(
        [(int(i), int(j), int(k)) for i, j, k, p in zip(x, a, c, post) if p < 0.5], "against long, asserted long, could long"
    )
    judged = seen.join(F.broadcast(bad.withColumn("bad", F.lit(True))), ["against", "asserted", "could"], "left")
    return judged.select("id", "record_no", "chars", F.col("bad").isNull().alias("usable")), _rates(records.sparkSession, names, sens, spec)


def judge_patterns(against: np.ndarray, asserted: np.ndarray, could: np.ndarray, count: np.ndarray, sources: int):
    """(probability that the texts of a pattern say something, sensitivity and specificity of sources and signs).

    Signs are bits after those of the sources, asserting where they have nothing against a text; where another one has
    something against it, a silent sign may only not know this kind and abstains."""
    k, signs = sources, len(SIGNS)
    every = (1 << signs) - 1
    free = np.where(against == 0, every, 0)
    can = np.where(against == 0, every, against)
    prior = lambda source, sign: np.array([source] * k + [sign] * signs, dtype=float)
    post, sens, spec, _ = fit(
        asserted | (free << k), could | (can << k), count.astype(float), k + signs, prior=0.85,
        sens0=prior(0.6, 0.99), spec0=prior(0.8, 0.5), prior_sens=(prior(6, 99), prior(4, 1)), prior_spec=(prior(9, 5), prior(1, 5)),
    )
    return post, sens, spec


def _rates(spark, names: list[str], sens: np.ndarray, spec: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(m, round(float(x), 4), round(float(y), 4)) for m, x, y in zip(names, sens, spec)], "source string, sensitivity double, specificity double")


def pick_fields(records: DataFrame, trust: DataFrame) -> DataFrame:
    """(id, field_name, record_no): the record that the survivor takes each field from.

    One row per id of two or more records and field with a usable value. Null ids name no entity and
    are left out; repeated rows count as records; NaN, null and impossible values are not usable."""
    r = with_trust(records.select("id", "record_no", "source", "confidence", "created_at"), trust)
    judged = judge_descriptions(records, trust)[0].where("usable").select(
        F.col("record_no").alias("__r"), F.col("chars").alias("__len")
    )
    r = r.where(F.col("id").isNotNull()).join(judged, F.col("record_no") == F.col("__r"), "left")
    when = F.when((F.col("created_at") >= F.lit(FROM)) & (F.col("created_at") < F.lit(TO)), F.unix_micros(F.col("created_at").cast("timestamp")))
    neg = lambda c: -c
    late = F.coalesce(neg(when), F.lit(2**62))
    sure = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    no = F.col("record_no")
    ranks = {
        "source": (F.lit(True), [neg(F.col("__trust")), late, no]),
        "confidence": (sure, [neg(F.col("__trust")), late, no]),
        "created_at": (when.isNotNull(), [late, neg(F.col("__trust")).cast("long"), no]),
        "description": (F.col("__len").isNotNull(), [neg(F.col("__len")), neg(F.col("__trust")), late, no]),
    }
    best = r.groupBy("id").agg(
        F.count("*").alias("n"),
        *[F.min(F.when(ok, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys)]))).alias(f) for f, (ok, keys) in ranks.items()],
    )
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)[f"k{len(keys) - 1}"].alias("record_no")) for f, (_, keys) in ranks.items()])
    return best.where("n >= 2").select("id", F.inline(rows)).where(F.col("record_no").isNotNull())


def judge_values(records: DataFrame, trust: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(id, value, p_true) of every value of a multi-valued field, and (source, sensitivity, specificity).

    A source that lists anything for an id, but not this value, speaks against it. Values are compared
    by their squeezed text; null and blank ones are none."""
    names = source_index(trust)
    said = records.where(F.col("id").isNotNull() & (F.size(field) > 0)).select("id", _witness(F.col("source"), names).alias("bit"), F.explode(field).alias("v"))
    said = said.select("id", "bit", squeezed(F.col("v")).alias("value")).where("value != ''")
    facts = said.groupBy("id", "value").agg(F.bit_or("bit").alias("asserted"))
    could = said.groupBy("id").agg(F.bit_or("bit").alias("could"))
    facts = facts.join(could, "id")
    # patterns of who asserts and who could; their number depends on the sources, not on the records (at most 3^(SOURCES + 1))
    seen = facts.groupBy("asserted", "could").count().collect()
    a, c, n = (np.array([r[k] for r in seen], dtype=np.int64) for k in range(3))
    post, sens, spec, _ = fit(a, c, n.astype(float), len(names))
    spark = records.sparkSession
    p = spark.createDataFrame(
        [(int(x), int(y), float(z)) for x, y, z in zip(a, c, post)], "asserted long, could long, p_true double"
    )
    return facts.join(F.broadcast(p), ["asserted", "could"]).select("id", "value", "p_true"), _rates(spark, names, sens, spec)


def build_survivors(records: DataFrame, trust: DataFrame, multi: tuple[str, ...] = ("aliases", "tags")) -> DataFrame:
    """One row per id of two or more records: the four scalar fields of their best records and every value of `multi` judged true."""
    picks = pick_fields(records, trust)
    own = records.select(F.col("record_no").alias("__r"), "source", "confidence", "created_at", "description")
    got = picks.join(own, picks["record_no"] == own["__r"])
    one = lambda f: F.max(F.when(F.col("field_name") == f, F.struct(F.col(f).alias("v")))).getField("v").alias(f)
    out = got.groupBy("id").agg(*[one(f) for f in ("source", "confidence", "created_at", "description")])
    for f in multi:
        values, _ = judge_values(records, trust, f)
        kept = values.where("p_true >= 0.5").groupBy(F.col("id").alias("__i")).agg(F.array_sort(F.collect_set("value")).alias(f))
        out = out.join(kept, out["id"] == kept["__i"], "left").drop("__i")
    return out
