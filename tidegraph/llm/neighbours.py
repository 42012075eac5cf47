"""Most similar vectors by learned partitions.

On a bounded sample the neighbour graph is cut into balanced parts by recursive spectral bisection,
and a small classifier learns which parts hold a vector's neighbours; each part is cut again in the
same way on a sample of its own, by a task of its own. Every vector of the table is indexed in its
most probable leaf and searches its few most probable ones, where cosines are exact. How many it
searches is measured: a set of queries is compared with all vectors, and as many leaves are searched
as their true neighbours ask for. This way is the same at every size. Equal vectors are one class.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint

SAMPLE = 12_000  # vectors that the first cut is fitted on
PER_LEAF_SAMPLE = 64  # vectors a leaf that the second cut is fitted on
PER_PART = 4_000  # indexed vectors a leaf should hold
LEAST_PARTS, MOST_PARTS = 8, 1 << 16
RECALL = 0.96  # share of the true neighbours of the measured queries that the searched leaves must hold
MEASURED = 512  # queries that are compared with all vectors to set the number of leaves
WIDE = 8  # parts of the first cut whose leaves are weighed for a vector; doubled while the recall asks for it
BLOCK = 10_000  # a leaf that holds more is split into blocks, each searched
ASKED = 60_000  # queries of a block that one task answers; more are split
TASK_BYTES = 8 << 20  # vectors that a searching task reads
STEPS = 600  # of a classifier's fit
HIDDEN = (128, 64)  # units of the hidden layers of the two cuts


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k most similar rows of each row of x (unit vectors), itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each node: the graph is halved along its second eigenvector, at the median, again and again."""
    n = len(graph)
    u, v = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    rng = np.random.default_rng(seed)
    label = np.zeros(n, dtype=np.int64)
    for _ in range(max(0, round(math.log2(parts)))):
        own = label[u] == label[v]  # edges that are not cut yet; all parts are halved at once
        a, b = u[own], v[own]
        degree = np.bincount(a, minlength=n).astype(float) + 1e-9
        size = np.bincount(label)
        weight = np.bincount(label, degree)
        f = rng.standard_normal(n)
        for _ in range(40):
            f -= (np.bincount(label, f * degree) / np.maximum(weight, 1e-300))[label]
            f = 0.5 * f + 0.5 * np.bincount(a, f[b], minlength=n) / degree
            f /= np.sqrt(np.bincount(label, f * f) / np.maximum(size, 1) + 1e-300)[label]
        order = np.lexsort((f, label))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        label = label * 2 + (rank >= (size // 2)[label])
    return label


def fit_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, hidden: int = HIDDEN[0], steps: int = STEPS, seed: int = 7) -> list[np.ndarray]:
    """Weights of a classifier with one hidden layer, by Adam on mini-batches.

    A vector's target is half its own part and half the parts of its neighbours, so that the probable
    parts are those where its neighbours are."""
    rng = np.random.default_rng(seed)
    size, k = x.shape[1], max(1, graph.shape[1])
    shape = [(size, hidden), (hidden,), (hidden, parts), (parts,)]
    w = [(rng.standard_normal(s) * (2 * (2 / size) ** 0.5 if i == 0 else hidden**-0.5) if len(s) == 2 else np.zeros(s)).astype(np.float32) for i, s in enumerate(shape)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        at = rng.integers(0, len(x), min(512, len(x)))
        h = np.maximum(x[at] @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        row = np.arange(len(at))
        p[row, part[at]] -= 0.5
        np.add.at(p, (np.repeat(row, graph.shape[1]), part[graph[at]].ravel()), np.float32(-0.5 / k))
        p /= len(at)
        back = (p @ w[2].T) * (h > 0)
        for i, g in enumerate((x[at].T @ back, back.sum(0), h.T @ p, p.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            rate = 0.01 * (1 - t / steps) + 0.0005
            w[i] = (w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def part_scores(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    """Log probabilities of the parts."""
    z = np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def cut(x: np.ndarray, parts: int, hidden: int) -> list[np.ndarray]:
    """The classifier of a balanced cut of the neighbour graph of the unit vectors x."""
    graph = neighbour_graph(x)
    return fit_router(x, balanced_parts(graph, parts), graph, parts, hidden)


class Router:
    """The two cuts. A leaf is part of the first cut * `second` + part of the second."""

    def __init__(self, first: list[np.ndarray], second: int, inner: dict[int, list[np.ndarray]], wide: int):
        self.first, self.second, self.inner, self.wide = first, second, inner, wide
        self.parts = len(first[3])

    def leaves(self, x: np.ndarray, take: int) -> np.ndarray:
        """The `take` most probable leaves of each row, best first; -1 where fewer are weighed."""
        out = np.full((len(x), take), -1, dtype=np.int64)
        wide = min(self.wide, self.parts)
        step = max(64, 4_000_000 // (wide * self.second))
        for i in range(0, len(x), step):
            y = x[i : i + step]
            z = part_scores(y, self.first)
            top = np.argsort(-z, axis=1, kind="stable")[:, :wide]
            score = np.full((len(y), wide, self.second), -np.inf, dtype=np.float32)
            for p in np.unique(top):
                row, at = np.nonzero(top == p)
                w = self.inner.get(int(p))
                if w is None:  # nothing of the sample fell into this part: it is one leaf
                    score[row, at, 0] = z[row, p]
                else:
                    score[row, at] = part_scores(y[row], w) + z[row, p][:, None]
            score = score.reshape(len(y), -1)
            n = min(take, score.shape[1])
            best = np.argsort(-score, axis=1, kind="stable")[:, :n]
            leaf = np.take_along_axis(top, best // self.second, 1) * self.second + best % self.second
            out[i : i + step, :n] = np.where(np.isfinite(np.take_along_axis(score, best, 1)), leaf, -1)
        return out


def _pack(w: list[np.ndarray]) -> bytes:
    return b"".join(a.astype("<f4").tobytes() for a in w)


def _unpack(raw: bytes, size: int, hidden: int, parts: int) -> list[np.ndarray]:
    x, out, at = np.frombuffer(raw, dtype="<f4"), [], 0
    for shape in ((size, hidden), (hidden,), (hidden, parts), (parts,)):
        n = math.prod(shape)
        out.append(x[at : at + n].reshape(shape))
        at += n
    return out


def _unit(vectors) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _vectors(column, size: int) -> np.ndarray:
    """Unit vectors of an Arrow column of lists of `size` numbers."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def usable_vectors(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(k, h, v): rows whose vector has `size` finite numbers, not all zero. h names equal vectors."""
    v = F.col(vector)
    fine = (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).alias("k"), F.xxhash64(v).alias("h"), v.alias("v"))


def fit_parts(own: DataFrame, distinct: int, size: int, sample: int = SAMPLE) -> Router:
    """Both cuts for about `distinct` classes of vectors of `own` (h, v).

    The first is fitted on about `sample` classes, each inner one on about PER_LEAF_SAMPLE a leaf. The weights that
    reach the driver are bounded by MOST_PARTS: 256 inner cuts of 80 kB."""
    parts = min(MOST_PARTS, max(LEAST_PARTS, 2 ** round(math.log2(max(1, distinct) / PER_PART))))
    one = 2 ** math.ceil(math.log2(parts) / 2)
    two = parts // one
    of = lambda n, salt: F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(1_000_000)) < int(min(1.0, n / max(1, distinct)) * 1_000_000)
    wanted = max(sample, PER_LEAF_SAMPLE * parts)
    some = checkpoint(own.where(of(wanted, 1)).groupBy("h").agg(F.first("v").alias("v")))
    share = min(1.0, sample / max(1, min(wanted, distinct)))
    picked = some.where(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("h").select("v").collect()
    if not picked:
        return Router([np.zeros(s, dtype=np.float32) for s in ((size, 1), (1,), (1, one), (one,))], two, {}, WIDE)
    first = cut(_unit([r[0] for r in picked]), one, HIDDEN[0])

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("v"), size)
                at = part_scores(x, first).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("h"), pa.array([r.tobytes() for r in x])], names=["p", "h", "v"])

    def inner(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        x = np.frombuffer(b"".join(group["v"]), dtype=np.float32).reshape(len(group), size)
        return pd.DataFrame({"p": [group["p"].iloc[0]], "w": [_pack(cut(x, two, HIDDEN[1]))]})

    rows = some.mapInArrow(place, "p int, h long, v binary").repartition(one, "p").groupBy("p").applyInPandas(inner, "p int, w binary").collect()
    return Router(first, two, {p: _unpack(bytes(w), size, HIDDEN[1], two) for p, w in rows}, WIDE)


def measured_leaves(own: DataFrame, distinct: int, router: Router, k: int, least: float, size: int, recall: float) -> tuple[int, float]:
    """(leaves to search, share of the true neighbours they hold), from MEASURED queries compared with all vectors.

    The router weighs more parts of its first cut if the recall can't be reached otherwise. Without any neighbour of
    cosine `least` one leaf does."""
    few = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1_000_000)) < max(1, int(min(1.0, MEASURED / max(1, distinct)) * 1_000_000))
    queries = own.where(few).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").collect()
    if not queries:
        return 1, 1.0
    qh, q = np.array([r[0] for r in queries]), _unit([r[1] for r in queries])

    def compare(batches):
        best: list[pd.DataFrame] = []
        for b in batches:
            h, at = np.unique(b.column("h").to_numpy(), return_index=True)
            if not len(h):
                continue
            y = _vectors(b.column("v"), size)[at]
            s = q @ y.T
            s[qh[:, None] == h[None, :]] = -2
            if s.shape[1] > k:
                s[s < np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]] = -2
            row, col = np.nonzero(s >= least if least > -1 else s > -2)
            used, back = np.unique(col, return_inverse=True)
            best.append(pd.DataFrame({"q": row, "h": h[col], "s": s[row, col].astype(np.float64), "leaf": router.leaves(y[used], 1)[back, 0]}))
            if sum(map(len, best)) > 4 * k * len(q):
                best = [_top(pd.concat(best), k)]
        if best:
            yield pa.RecordBatch.from_pandas(_top(pd.concat(best), k).astype({"q": "int32"}), preserve_index=False)

    w = Window.partitionBy("q").orderBy(F.desc("s"), "h")
    near = own.select("h", "v").mapInArrow(compare, "q int, h long, s double, leaf long").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    got = near.select("q", "leaf").collect()  # at most k a measured query
    if not got:
        return 1, 1.0
    row, leaf = (np.array([g[i] for g in got]) for i in (0, 1))
    while True:
        order = router.leaves(q, router.parts * router.second)
        held = (order[row] == leaf[:, None]).cumsum(1).mean(0)
        if held[-1] >= recall or router.wide >= router.parts:
            break
        router.wide *= 2
    take = min(int(np.searchsorted(held, min(recall, held[-1]))) + 1, len(held))
    return take, float(held[take - 1])


def _top(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    return hits.drop_duplicates(["q", "h"]).sort_values(["q", "s", "h"], ascending=[True, False, True]).groupby("q", sort=False).head(k)


def route(heads: DataFrame, router: Router, take: int, distinct: int, size: int, kind: str) -> tuple[DataFrame, int]:
    """((block, h, low, indexed, asks, v), blocks): each vector in its own leaf and in the `take` it searches, hot leaves split.

    A leaf's load is that of a sample of MEASURED * 16 classes. Its indexed vectors are cut into blocks and its queries
    into groups; every group meets every block."""
    some = heads.where(F.pmod(F.xxhash64("h", F.lit(4)), F.lit(1_000_000)) < max(1, int(min(1.0, 16 * MEASURED / max(1, distinct)) * 1_000_000))).select("v").collect()
    leaves = router.parts * router.second
    load = asked = np.zeros(leaves)
    if some:
        order = router.leaves(_unit([r[0] for r in some]), take)
        load = np.bincount(order[:, 0], minlength=leaves) / len(some)
        asked = np.bincount(order[order >= 0], minlength=leaves) / len(some)
    split = np.maximum(1, np.ceil(load * distinct / BLOCK)).astype(np.int64)
    salts = np.maximum(1, np.ceil(asked * distinct / ASKED)).astype(np.int64)
    base = np.cumsum(split * salts) - split * salts

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("v"), size)
            order, h = router.leaves(x, take), batch.column("h").to_numpy()
            at, block, indexed, asks = [], [], [], []
            for j in range(take):
                leaf = order[:, j]
                own_b, own_s = np.abs(h) % split[leaf], np.abs(h // 1_000_003) % salts[leaf]
                for b in range(int(split[leaf].max())):
                    for s in range(int(salts[leaf].max())):
                        ask = own_s == s
                        index = (own_b == b) if j == 0 else np.zeros(len(h), dtype=bool)
                        m = (leaf >= 0) & (b < split[leaf]) & (s < salts[leaf]) & (ask | index)
                        at.append(np.flatnonzero(m))
                        block.append((base[leaf] + b * salts[leaf] + s)[m])
                        indexed.append(index[m])
                        asks.append(ask[m])
            at = np.concatenate(at)
            ends = pa.py_buffer((np.arange(len(at) + 1) * 4 * size).astype(np.int32))
            raw = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(np.ascontiguousarray(x[at]))])
            take_ = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(block)), batch.column("h").take(take_), batch.column("low").take(take_), pa.array(np.concatenate(indexed)), pa.array(np.concatenate(asks)), raw],
                names=["block", "h", "low", "indexed", "asks", "v"],
            )

    blocks = int((split * salts).sum())
    made = heads.select("h", "low", "v").mapInArrow(send, f"block long, h long, low {kind}, indexed boolean, asks boolean, v binary")
    tasks = max(made.sparkSession.sparkContext.defaultParallelism, math.ceil(distinct * take * 5 * size / TASK_BYTES))
    return made.repartition(min(tasks, max(1, blocks)), "block"), blocks


def similar_vectors(rows: DataFrame, key: str, vector: str, k: int = 10, least: float = -1.0, size: int = 64, recall: float = RECALL,
                    sample: int = SAMPLE) -> DataFrame:
    """(key, neighbour, similarity, rank): the k most similar rows of each row, of cosine `least` at least.

    `recall` of the true neighbours is aimed at, by measured queries. Ties go to the smaller key. Rows of an equal
    vector have similarity 1. Rows without a usable vector or key take no part; a table of fewer than two usable
    rows has no neighbours. Keys are unique; other columns are left out."""
    own = usable_vectors(rows, key, vector, size)
    # equal vectors: the k+1 smallest keys of a class are all that any neighbour list can hold of it
    at = Window.partitionBy("h").orderBy("k")
    first = own.select("h", "k").withColumn("n", F.row_number().over(at)).where(F.col("n") <= k + 1)
    heads = own.groupBy("h").agg(F.min("k").alias("low"), F.first("v").alias("v"))
    distinct = own.agg(F.approx_count_distinct("h", 0.01)).head()[0]
    router = fit_parts(own.select("h", "v"), distinct, size, sample)
    take, _ = measured_leaves(own, distinct, router, k, least, size, recall)
    kind = rows.schema[key].dataType.simpleString()
    routed, _ = route(heads, router, take, distinct, size, kind)

    def search(block: pd.DataFrame) -> pd.DataFrame:
        raw = block["v"]
        x = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(len(block), size)
        h, low, indexed, asks = (block[c].to_numpy() for c in ("h", "low", "indexed", "asks"))
        order = np.flatnonzero(indexed)
        order = order[np.argsort(low[order], kind="stable")]
        y, hy, ly = x[order], h[order], low[order]
        x, h = x[asks], h[asks]
        out = []
        for i in range(0, len(x) if len(y) else 0, 512):
            s = x[i : i + 512] @ y.T
            s[h[i : i + 512, None] == hy[None, :]] = -2
            for_many = (s >= least).sum(1) > k
            rows_few, cols_few = np.nonzero((s >= least) & (s > -2) & ~for_many[:, None])
            found = [(rows_few, cols_few)]
            many = np.flatnonzero(for_many)
            if len(many):
                # all that reach the k-th best cosine, ties included; where ties abound, those of smaller key
                t = s[many]
                kth = np.partition(t, t.shape[1] - k, axis=1)[:, t.shape[1] - k]
                top = t >= kth[:, None]
                full = top.sum(1) > 2 * k
                for row in np.flatnonzero(full):
                    top[row] = False
                    top[row, np.argsort(-t[row], kind="stable")[:k]] = True
                r, c = np.nonzero(top)
                found.append((many[r], c))
            for r, c in found:
                good = s[r, c] > -2
                r, c = r[good], c[good]
                out.append(pd.DataFrame({"h": h[i + r], "g": hy[c], "low": ly[c], "s": s[r, c].astype(np.float64)}))
        return pd.concat(out) if out else pd.DataFrame({"h": [], "g": [], "low": [], "s": []})

    hits = routed.groupBy("block").applyInPandas(search, f"h long, g long, low {kind}, s double")
    best = Window.partitionBy("h").orderBy(F.desc("s"), "low", "g")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("h", "g", "s")
    # from classes back to rows: at most k+1 keys of each of at most k+1 classes
    others = hits.join(first.select(F.col("h").alias("g"), "k"), "g").select("h", "k", F.least("s", F.lit(1.0)).alias("s"))
    mine = first.where(F.lit(least <= 1)).select("h", "k", F.lit(1.0).alias("s"))
    short = (
        others.unionByName(mine).withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("s"), "k"))).where(F.col("n") <= k + 1)
    )
    lists = short.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "k", "s"))).alias("l"))
    near = F.slice(F.filter("l", lambda x: x["k"] != F.col("me")), 1, k)
    got = own.select("h", F.col("k").alias("me")).join(lists, "h").select("me", F.posexplode(near).alias("rank", "x"))
    return got.select(F.col("me").alias(key), F.col("x.k").alias("neighbour"), F.col("x.s").alias("similarity"), (F.col("rank") + 1).alias("rank"))
