"""Near copies by Bayesian pruning of MinHash candidates.

Texts of the same words are one class; classes meet where three of their MinHash values agree in one
of the bands. Each row of a band carries 32 further MinHash values of four bits, compared eight at a
time: a pair is dropped as soon as the posterior probability of reaching the threshold falls below
the tolerance. What is left is verified exactly on the sets of word runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..operators.components import connected_components
from ..operators.skew import heavy_keys
from ..session import BROADCAST_LIMIT, checkpoint, release, spread

BANDS, ROWS = 32, 3
SLOTS, BITS = 32, 4  # the sketch: values of a few bits, compared in steps of STEP
STEP = 8
TOLERANCE = 0.001
CHUNK = 256  # texts hashed at a time, so that the arrays stay in the cache
#: A class of more copies than this is linked copy by copy to its first row instead of pairwise.
EXPAND = 64
#: Classes of one band key that are compared in one task; a key of more is cut into blocks, each compared with each.
TOGETHER = 4_000
TASK_BYTES = 16 << 20  # of band rows that a task reads
SAMPLED = 32  # one class in so many is counted to find the heavy keys; what is split doesn't change the pairs

_rng = np.random.default_rng(20240601)
_MUL = (_rng.integers(1, 2**63, BANDS * ROWS + SLOTS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS + SLOTS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_column(text: Column) -> Column:
    """The runs of letters and digits of the lower-cased text, joined by blanks; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


class _Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


_words = _Words()


def _runs(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of all texts, and where each text's begin; a shorter text is one run."""
    split = [t.split(" ") for t in texts]
    size = np.array([len(w) for w in split])
    flat = np.fromiter((_words[w] for ws in split for w in ws), dtype=np.uint64, count=int(size.sum()))
    many = np.maximum(size - n + 1, 1)
    start = np.cumsum(size) - size
    begin = np.cumsum(many) - many
    at = np.repeat(start - begin, many) + np.arange(int(many.sum()))
    last = np.repeat(start + size - 1, many)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        h = (h ^ flat[np.minimum(at + k, last)]) * _MIX
        h ^= h >> np.uint64(29)
    return h, begin


def minhash(texts: list[str], n: int) -> np.ndarray:
    """One row of BANDS*ROWS+SLOTS 32-bit MinHash values per text."""
    out = np.empty((len(texts), len(_MUL)), dtype=np.uint32)
    for i in range(0, len(texts), CHUNK):
        h, begin = _runs(texts[i : i + CHUNK], n)
        for k in range(len(_MUL)):
            v = ((h * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[i : i + CHUNK, k] = np.minimum.reduceat(v, begin)
    return out


def thresholds(similarity: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): below these the posterior of reaching the similarity is under the tolerance.

    The similarity is uniform a priori; a value of BITS bits also matches by chance."""
    j = np.linspace(0.0005, 0.9995, 1000)
    s = j + (1 - j) / 2**BITS
    out = []
    for n in range(STEP, SLOTS + 1, STEP):
        for m in range(n + 1):
            w = s**m * (1 - s) ** (n - m)
            if w[j >= similarity].sum() / w.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def _mismatches(x: Column) -> Column:
    y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
    return y.bitwiseAND(F.lit(0x1111111111111111))


def _likely(similarity: float, tolerance: float) -> Column:
    """The sketches of l and r pass every step."""
    y1 = _mismatches(F.col("l.s1").bitwiseXOR(F.col("r.s1")))
    y2 = _mismatches(F.col("l.s2").bitwiseXOR(F.col("r.s2")))
    half = F.lit(0xFFFFFFFF)
    seen = {8: F.bit_count(y1.bitwiseAND(half)), 16: F.bit_count(y1), 24: F.bit_count(y1) + F.bit_count(y2.bitwiseAND(half)), 32: F.bit_count(y1) + F.bit_count(y2)}
    ok = F.lit(True)
    for n, m in thresholds(similarity, tolerance):
        ok = ok & (seen[n] <= n - m)
    return ok


def classes(docs: DataFrame, key: str, parts: list[str], least: int = 0, counted: str | None = None) -> DataFrame:
    """(key, cid, words): the words of the parts joined, and the class of the texts of the same words.

    Null parts are empty. Texts with fewer than `least` words in `counted` are left out."""
    df = let(docs.select(*dict.fromkeys([key, *parts, *([counted] if counted else [])])), {f"__w_{p}": words_column(F.col(p)) for p in dict.fromkeys([*parts, *([counted] if counted else [])])})
    df = let(df, {"__words": F.trim(F.concat_ws(" ", *[F.col(f"__w_{p}") for p in parts]))})
    if counted and least:
        w = F.col(f"__w_{counted}")
        df = df.where((F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) + 1 >= least) & (w != ""))
    return df.where("__words != ''").select(key, F.xxhash64("__words").alias("cid"), F.col("__words").alias("words"))


def sketches(texts: DataFrame, key: str, n: int) -> DataFrame:
    """(key, cid, bands, s1, s2) of each text of (key, cid, words): the keys of its bands and its two words of small MinHash values.

    bands is null for a copy of a text that the task has seen."""

    def sketch(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(1).to_pylist()
            at = [i for i, c in enumerate(ids) if c not in seen and not seen.add(c)]
            if len(seen) > 2_000_000:
                seen.clear()
            m = minhash(batch.column(2).take(pa.array(at, type=pa.int64())).to_pylist(), n) if at else np.zeros((0, len(_MUL)), dtype=np.uint32)
            band = np.zeros((len(at), BANDS), dtype=np.uint64)
            for r in range(ROWS):
                band = (band ^ m[:, r : BANDS * ROWS : ROWS]) * _MIX
                band ^= band >> np.uint64(31)
            band = (band + np.arange(BANDS, dtype=np.uint64)) * _MIX
            low = (m[:, BANDS * ROWS :] & np.uint32(15)).astype(np.uint64) << (np.arange(SLOTS, dtype=np.uint64) % np.uint64(16) * np.uint64(4))
            first = np.zeros(len(ids), dtype=bool)
            first[at] = True
            s = []
            for i in (0, 16):
                x = np.zeros(len(ids), dtype=np.int64)
                x[first] = np.bitwise_or.reduce(low[:, i : i + 16], axis=1).view(np.int64)
                s.append(pa.array(x))
            ends = pa.array(np.concatenate([[0], np.cumsum(first) * BANDS]).astype(np.int32), mask=None)
            flat = pa.ListArray.from_arrays(ends, pa.array(band.view(np.int64).ravel()), mask=pa.array(~first))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, *s], names=[key, "cid", "bands", "s1", "s2"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "cid", "words").mapInArrow(sketch, f"`{key}` {kind}, cid long, bands array<long>, s1 long, s2 long")


def candidate_pairs(sketched: DataFrame, total: int, similarity: float, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b), a < b: pairs of classes that no step of the comparison dropped. sketched: a written table of about `total` rows."""
    held = sketched.where("bands IS NOT NULL")
    some = held.where(F.pmod("cid", F.lit(SAMPLED)) == 0).select(F.explode("bands").alias("key"), "cid").distinct()
    heavy = F.broadcast(heavy_keys(some, "key", total * BANDS // SAMPLED, max(1, TOGETHER // SAMPLED)))
    rows = held.select(F.explode("bands").alias("key"), "cid", "s1", "s2")
    rows = rows.repartition(spread(sketched.sparkSession, total * BANDS * 40, TASK_BYTES), "key").dropDuplicates(["key", "cid"])
    apart = rows.join(heavy.select("key"), "key", "left_anti")
    near = _likely(similarity, tolerance)
    light = apart.alias("l").join(apart.alias("r"), F.expr("l.key = r.key AND l.cid < r.cid") & near)
    # the classes of a heavy key in blocks: a pair meets where its own two blocks do, and nowhere else
    hot = rows.join(heavy, "key").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("__parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    one = hot.withColumn("c", every).select("key", F.col("b").alias("i"), F.col("c").alias("j"), "cid", "s1", "s2")
    two = hot.withColumn("c", every).select("key", F.col("c").alias("i"), F.col("b").alias("j"), "cid", "s1", "s2")
    blocks = one.alias("l").join(two.alias("r"), F.expr("l.key = r.key AND l.i = r.i AND l.j = r.j AND l.cid < r.cid") & near)
    out = [F.col("l.cid").alias("a"), F.col("r.cid").alias("b")]
    return light.select(*out).unionByName(blocks.select(*out)).distinct()


def verified_pairs(texts: DataFrame, pairs: DataFrame, similarity: float, n: int) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets of runs reach the similarity, on 32-bit hashes of the runs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    if ids.count() * 16 <= BROADCAST_LIMIT:
        ids = F.broadcast(ids)
    picked = texts.join(ids, "cid", "left_semi")

    def sets(batches):
        seen: set[int] = set()
        for batch in batches:
            own = batch.column(0).to_pylist()
            at = [i for i, c in enumerate(own) if c not in seen and not seen.add(c)]
            if len(seen) > 2_000_000:
                seen.clear()
            words = batch.column(1).to_pylist()
            out = []
            for i in range(0, len(at), CHUNK):
                part = at[i : i + CHUNK]
                h, begin = _runs([words[k] for k in part], n)
                h = (h >> np.uint64(32)).astype(np.uint32)
                out += [np.unique(x).tobytes() for x in np.split(h, begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in at], type=pa.int64()), pa.array(out, type=pa.binary())], names=["cid", "runs"])

    runs = picked.select("cid", "words").mapInArrow(sets, "cid long, runs binary").repartition("cid").dropDuplicates(["cid"])

    @F.arrow_udf("double")
    def jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p.as_buffer(), dtype=np.uint32), np.frombuffer(q.as_buffer(), dtype=np.uint32)
            at = np.searchsorted(p, q)
            both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
            out.append(both / (len(p) + len(q) - both))
        return pa.array(out, type=pa.float64())

    left = runs.select(F.col("cid").alias("a"), F.col("runs").alias("x"))
    right = runs.select(F.col("cid").alias("b"), F.col("runs").alias("y"))
    j = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard("x", "y").alias("jaccard"))
    return j.where(F.col("jaccard") >= similarity)


def near_copies(docs: DataFrame, key: str, parts: list[str], similarity: float = 0.8, n: int = 5, least: int = 0, counted: str | None = None,
                tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (key, cid) of every text, and (a, b, jaccard) of the pairs of classes of unlike texts.

    Exact copies share a class and are not paired one by one. Null keys stay keys; null and wordless
    texts are in no class; a text of fewer words than n is one run. Repeated keys stay repeated."""
    texts = classes(docs, key, parts, least, counted)
    sketched = checkpoint(sketches(texts, key, n))
    pairs = checkpoint(candidate_pairs(sketched, sketched.count(), similarity, tolerance))
    release(docs.sparkSession)  # the bands, the largest shuffle, are done with
    return sketched.select(key, "cid"), checkpoint(verified_pairs(texts, pairs, similarity, n))


def expand_pairs(members: DataFrame, pairs: DataFrame, key: str, expand: int = EXPAND) -> DataFrame:
    """(x, y), x < y: pairs of rows. Classes of up to `expand` copies are expanded in full; of a larger one every copy
    is paired with the first, which alone stands for it in pairs with other classes."""
    sizes = members.groupBy("cid").agg(F.count("*").alias("m"), F.min(key).alias("first"))
    linked = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().withColumn("linked", F.lit(True))
    multi = members.join(sizes.join(linked, "cid", "left").where("m > 1 OR linked"), "cid")
    stand = multi.where((F.col("m") <= expand) | (F.col(key) == F.col("first"))).select("cid", F.col(key).alias("k"))
    across = (
        pairs.join(stand.select(F.col("cid").alias("a"), F.col("k").alias("x")), "a")
        .join(stand.select(F.col("cid").alias("b"), F.col("k").alias("y")), "b")
        .select("x", "y")
    )
    small = multi.where((F.col("m") > 1) & (F.col("m") <= expand)).select("cid", F.col(key).alias("k"))
    within = small.alias("l").join(small.alias("r"), F.expr("l.cid = r.cid AND l.k < r.k")).select(F.col("l.k").alias("x"), F.col("r.k").alias("y"))
    star = multi.where((F.col("m") > expand) & (F.col(key) != F.col("first"))).select(F.col("first").alias("x"), F.col(key).alias("y"))
    every = across.unionByName(within).unionByName(star)
    return every.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def groups(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, group_id, links): one row per text; group_id is the smallest class of its group, links its number of similar classes."""
    found = connected_components(pairs, "a", "b").withColumnRenamed("node", "cid")
    links = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    out = members.join(found, "cid", "left").join(links, "cid", "left")
    return out.select(key, F.coalesce("component", "cid").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
