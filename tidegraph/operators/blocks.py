"""Best matches of many texts by inverted lists in memory.

The texts are cut into blocks, one a task; each task holds all lists once, so that no pair of a text and a
form is ever written, and only the best matches leave it. What no list can still bring among the best is
passed over by bounds, so the rows are those of the join of all. Lists that are too large for a task are
the caller's to join.
"""

from __future__ import annotations

import ctypes
import json
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Characters of all lists that a task may hold, and rows of a block of texts.
MOST_HELD, BLOCK_ROWS = 256 << 20, 250_000
SLICE = 1 << 12  # texts whose candidates are held at a time


def per_block(texts: DataFrame, held: DataFrame, rows: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, by: list[Column] | None = None) -> DataFrame:
    """run(block of texts, all of held) of every block, as rows of `schema`; `rows` is the number of texts. Texts of equal `by` share a block."""
    n, names = _names(texts.sparkSession, rows)
    cut = texts.withColumn("__b", _own(names, by or texts.columns)).repartition(n, "__b")
    every = held.withColumn("__b", F.explode(names)).repartition(n, "__b")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left.drop_columns(["__b"]), right.drop_columns(["__b"]))
        give_back()
        return out

    return cut.groupBy("__b").cogroup(every.groupBy("__b")).applyInArrow(block, schema)


def streamed(asked: DataFrame, held: DataFrame, rows: int, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`per_block` for results that are larger than what a task holds: they leave it batch by batch. Both sides have the same columns and come as one table."""
    n, names = _names(asked.sparkSession, rows)
    both = asked.withColumn("__b", _own(names, asked.columns)).unionByName(held.withColumn("__b", F.explode(names)))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.Table.from_batches(batches).drop_columns(["__b"]))

    return both.repartition(n, "__b").groupBy("__b").applyInArrow(block, schema)


def give_back() -> None:
    """Let the system have what was freed: a worker lives on between tasks, and its executor counts what it keeps."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def _names(spark: SparkSession, rows: int) -> tuple[int, Column]:
    """(number of blocks, an array of their names): numbers of which each falls into a partition of its own."""
    n = spread(spark, rows, BLOCK_ROWS)
    own = spark.range(64 * n).select(F.col("id").cast("int").alias("b")).groupBy(F.pmod(F.hash("b"), F.lit(n)).alias("p")).agg(F.min("b").alias("b"))
    return n, F.array(*[F.lit(r.b) for r in own.orderBy("p").collect()])


def _own(names: Column, by: list) -> Column:
    return F.element_at(names, (F.pmod(F.xxhash64(*by), F.size(names)) + 1).cast("int"))


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _lists(of: np.ndarray, n: int) -> np.ndarray:
    """Where the run of each of 0..n-1 begins in sorted `of`, and the end."""
    return np.searchsorted(of, np.arange(n + 1))


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of several runs, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _grams(padded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) of the padded words of each text, distinct and sorted; a trigram is its three code points in one number."""
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(padded)), [len(x) for x in padded])
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    # a blank in the middle is that before a word, or the trigram goes over the end of one
    ok = (b != 32) | (a == 32) & (c != 32)
    of, g = of[:-2][ok], (a << 42 | b << 21 | c)[ok]
    o = np.lexsort((g, of))
    of, g = of[o], g[o]
    new = np.ones(len(g), bool)
    new[1:] = (of[1:] != of[:-1]) | (g[1:] != g[:-1])
    return of[new], g[new]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct, count) of numbers."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys))


def _bits(at: np.ndarray, n: int) -> int:
    """n bits, of which those at the places are set. Numbers of any length are added faster than arrays of some thousand words."""
    row = np.zeros(n, np.uint8)
    row[at] = 1
    return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def _places(bits: int, n: int) -> np.ndarray:
    """Where bits are set, of n."""
    if not bits:
        return np.zeros(0, np.int64)
    words = np.frombuffer(bits.to_bytes(8 * -(-n // 64), "little"), np.uint64)
    hit = (words != 0).nonzero()[0]
    one = np.unpackbits(words[hit].view(np.uint8), bitorder="little").view(bool).nonzero()[0]
    return hit[one >> 6] * 64 + (one & 63)


def _added(columns: list[list[int]]) -> list[int]:
    """The sum, place by place, of rows of bits, as rows of its binary digits from the lowest; columns: the rows that count 1, 2, 4, ..."""
    digits, carried, at, many = [], [], 0, len(columns)
    while carried or at < many:
        rows, carried = carried + columns[at] if at < many else carried, []
        at += 1
        while len(rows) > 2:
            a, b, c = rows.pop(), rows.pop(), rows.pop()
            x = a ^ b
            if y := a & b | x & c:
                carried.append(y)
            rows.append(x ^ c)
        if len(rows) == 2:
            a, b = rows
            if y := a & b:
                carried.append(y)
            rows = [a ^ b]
        digits.append(rows[0] if rows else 0)
    return digits


#: Similarities that are tried as the least of the best, and bytes of the bits of frequent trigrams, and of sums and bounds.
LEVELS, MOST_BITS, SUM_BITS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.43, 0.46, 0.5, 0.54, 0.58, 0.62, 0.67, 0.73, 0.8, 0.9, 1.0), 48 << 20, 8 << 20


class Forms:
    """Forms (padded, ids) by their trigrams: a frequent trigram has a bit of each form, a rare one a list.

    How many trigrams a text shares with each form is a sum of bits, of all forms at once."""

    def __init__(self, padded: pa.Array, ids: pa.Array) -> None:
        coded = ids.flatten().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = coded.dictionary.take(pa.array(order))  # by the order of ids, so that numbers break ties
        self.held = place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        self.held_n = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.held_at = np.cumsum(self.held_n) - self.held_n
        cuts = range(0, max(len(padded), 1), 20_000)
        cut = [_grams(padded.slice(x, 20_000).to_pylist()) for x in cuts]
        of, g = np.concatenate([(x[0] + at).astype(np.int32) for x, at in zip(cut, cuts)]), np.concatenate([x[1] for x in cut])
        del cut
        k = np.bincount(of, minlength=len(ids)).astype(np.int64)
        # forms stand by their number of trigrams, so that a bound is one of a run of forms
        self.form = np.argsort(k, kind="stable")
        self.k = k[self.form]
        self.sizes, many = np.unique(self.k, return_counts=True)
        ends = np.cumsum(many).tolist()
        self.sized = [(1 << z) - (1 << a) for a, z in zip([0, *ends], ends)]  # the bits of the forms of each size
        back = np.empty(len(k), np.int32)
        back[self.form] = np.arange(len(k))
        self.one = self.held[self.held_at[self.form]] if len(k) else self.held
        self.often, self.kept, self.spelt, self.sums, self.bounds, self.tried = Counter(), set(), {}, {}, {}, {}
        self.known = np.unique(g)
        g = np.searchsorted(self.known, g).astype(np.int32)
        of = back[of]
        self.grams, self.grams_at = g[np.argsort(of, kind="stable")], np.cumsum(self.k) - self.k
        by = np.argsort(g, kind="stable")
        self.posts, self.at = of[by], _lists(g[by], len(self.known))
        del of, g, by
        long = np.diff(self.at)
        often = np.argsort(-long, kind="stable")[: 8 * MOST_BITS // max(len(k), 1)]
        self.rows: list = [None] * len(long)
        for x in often[long[often] > max(64, len(k) // 2048)]:
            self.rows[x] = _bits(self.posts[self.at[x] : self.at[x + 1]], len(k))
        self.bits = np.array([x is not None for x in self.rows], bool)

    def _bound(self, n: int, low: float) -> list[int]:
        """The complement of the digits of the least shared trigrams of each form that make a similarity of `low` with a text of n."""
        need = np.maximum(1, np.ceil(low * (n + self.sizes) / (1 + low) - 1e-9)).astype(np.int64)
        out = [0] * int(need.max()).bit_length()
        for x, bits in zip(need.tolist(), self.sized):
            for b in range(len(out)):
                if not x >> b & 1:
                    out[b] |= bits
        return out

    def order(self, padded: pa.Array) -> np.ndarray:
        """An order of all texts that are asked in which those of one seldom word stand together; what several share is then added up once for all."""
        cuts = range(0, len(padded), SLICE)
        said = lambda at: [list(dict.fromkeys(x.split())) for x in padded.slice(at, SLICE).to_pylist()]
        self.often = Counter(w for at in cuts for ws in said(at) for w in ws)
        word = {w: i for i, w in enumerate(self.often)}
        lead = np.zeros(len(padded), np.int64)
        together: Counter = Counter()
        for at in cuts:
            for i, ws in enumerate(said(at), at):
                w = self._seldom(ws)
                lead[i] = word.get(w, -1)
                if len(rest := self._others(ws, w)) > 1:
                    together[hash(rest)] += 1
        size = 8 * (len(self.k) // 64 + 1)
        self.kept = {x for x, n in together.most_common(SUM_BITS // (5 * size)) if n > 1}
        self.kept |= {hash((w,)) for w, n in self.often.most_common(SUM_BITS // (8 * size)) if n > 1}
        return np.argsort(lead, kind="stable")

    def _seldom(self, ws: list[str]) -> str:
        """The word of fewest texts, or none if a word is that of one text only."""
        n, w = min(((self.often[w], w) for w in ws), default=(0, ""))
        return w if n > 1 else ""

    def _others(self, ws: list[str], word: str) -> tuple[str, ...]:
        return tuple(sorted(w for w in ws if w != word and self.often[w] > 1))

    def _summed(self, ws: tuple) -> tuple[list[int], list[int]]:
        """(rows of the trigrams of words, their sum)."""
        for w in ws:
            if w not in self.spelt:
                g = _grams([f"  {w} "])[1]
                at = np.searchsorted(self.known, g)
                self.spelt[w] = [x for x, y in zip(at.tolist(), g.tolist()) if x < len(self.known) and self.known[x] == y and self.rows[x] is not None]
        own = list(dict.fromkeys(x for w in ws for x in self.spelt[w]))
        return own, _added([[self.rows[x] for x in own]])

    def best(self, padded: list[str], least: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, id, similarity) by numbers: the `top` ids of each text."""
        t_of, t_g = _grams(padded)
        t_at = _lists(t_of, len(padded))
        where = np.searchsorted(self.known, t_g)
        where[where == len(self.known)] = 0
        there = self.known[where] == t_g if len(self.known) else np.zeros(len(t_g), bool)
        n_of = np.diff(t_at).tolist()
        # the trigrams of a word of several texts, and of words that stand together in several, are added up once; texts of one seldom word stand together
        if not self.often:
            self.order(pa.array(padded, pa.string()))
        said = [list(dict.fromkeys(x.split())) for x in padded]
        seldom = [self._seldom(ws) for ws in said]
        spelt = list({w for ws in said for w in ws})
        w_of, w_g = _grams([f"  {w} " for w in spelt])
        w_at = _lists(w_of, len(spelt)).tolist()
        at = np.searchsorted(self.known, w_g)
        at[at == len(self.known)] = 0
        at = np.where((self.known[at] == w_g) & self.bits[at], at, -1).tolist() if len(self.known) else [-1] * len(w_g)
        self.spelt = {w: [x for x in at[w_at[j] : w_at[j + 1]] if x >= 0] for j, w in enumerate(spelt)}
        sums, kept, size = self.sums, self.kept, 8 * (len(self.k) // 64 + 1)
        lead, lead_sum = "", ([], [])
        levels, bounds, tried = [least, *(x for x in LEVELS if x > least)], self.bounds, self.tried
        found, parts = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        waiting = 0
        for i in sorted(range(len(padded)), key=lambda i: (seldom[i], n_of[i])):
            gs = where[t_at[i] : t_at[i + 1]][there[t_at[i] : t_at[i + 1]]].tolist()
            if not gs:
                continue
            n, columns, seen = n_of[i], [[]], set()
            if seldom[i] != lead:
                lead = seldom[i]
                lead_sum = self._summed((lead,))
            rest = self._others(said[i], lead)
            for ws in [rest] if hash(rest) in kept else [(w,) for w in rest]:
                if hash(ws) in kept:
                    if ws not in sums:
                        sums[ws] = self._summed(ws)
                    self._put(columns, seen, *sums[ws])
                else:
                    self._put(columns, seen, self.spelt[ws[0]], None)
            if lead:
                self._put(columns, seen, *lead_sum)
            else:
                for w in said[i]:
                    if self.often[w] < 2:
                        self._put(columns, seen, self.spelt[w], None)
            low, high = -1, len(levels)  # what the level `low` gives is enough, that of `high` is not
            level = tried.get((len(said[i]), n), min(3, len(levels) - 1))
            digits = _added(columns) if seen else []
            u = ()
            while digits and high - low > 1:
                level = min(max(level, low + 1), high - 1)
                if (n, level) not in bounds:
                    if len(bounds) * 5 * size > 2 * SUM_BITS:
                        bounds.clear()
                    bounds[n, level] = self._bound(n, levels[level])
                enough, bound = None, bounds[n, level]
                for b, no in enumerate(bound):
                    if b >= len(digits):
                        enough = no if enough is None and b == 0 else no & enough
                    elif enough is None:
                        enough = digits[b] | no
                    else:
                        enough = digits[b] & no | (digits[b] | no) & enough
                for b in range(len(bound), len(digits)):
                    enough = digits[b] | enough
                many = enough.bit_count()
                if many > 8 * top:
                    passed, got = True, None
                elif level and many < top:
                    passed = False
                else:
                    got = _places(enough, len(self.k))
                    passed = level == 0 or len(set(self.one[got].tolist())) >= top
                if passed:
                    u, low = (enough, got), level
                    if many <= 4 * top:
                        break
                    level += 1
                else:
                    high = level
                    level -= 1
            tried[len(said[i]), n] = min(level, len(levels) - 1)
            if u:
                u = _places(u[0], len(self.k)) if u[1] is None else u[1]
            else:
                u = np.zeros(0, np.int64)
            rare = [self.posts[self.at[x] : self.at[x + 1]] for x in gs if self.rows[x] is None]
            if rare:
                u = np.concatenate([u, *rare])  # a form may be there twice
            found.append((i, n, u, gs))
            waiting += len(u)
            if waiting > 1 << 13 or len(found) > 63:
                parts.append(self._ranked(found, least, top))
                found, waiting = [], 0
        if found:
            parts.append(self._ranked(found, least, top))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _put(self, columns: list[list[int]], seen: set[int], own: list[int], digits: list[int] | None) -> None:
        """Add the rows `own` to columns, as their sum unless some of them are there."""
        if digits is None or not seen.isdisjoint(own):
            columns[0] += [self.rows[x] for x in own if x not in seen]
        else:
            columns += [[] for _ in range(len(digits) - len(columns))]
            for c, x in zip(columns, digits):
                c.append(x)
        seen.update(own)

    def _ranked(self, found: list, least: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        long = [len(x[2]) for x in found]
        i, n = (np.repeat(np.array([x[j] for x in found], np.int64), long) for j in (0, 1))
        u = np.concatenate([x[2] for x in found])
        # which trigrams of a form are among those of the text
        said = np.zeros((len(found), len(self.known)), np.uint8)
        for row, x in zip(said, found):
            row[x[3]] = 1
        k = self.k[u]
        at = np.repeat(np.repeat(np.arange(len(found)) * len(self.known), long), k) + self.grams[_flat(self.grams_at[u], k)]
        c = np.add.reduceat(said.ravel()[at], np.cumsum(k) - k, dtype=np.int64) if len(u) else k
        sim = c / (n + self.k[u] - c)
        keep = sim >= least
        i, u, sim = i[keep], self.form[u[keep]], sim[keep]
        many = self.held_n[u]
        i, e, sim = np.repeat(i, many), self.held[_flat(self.held_at[u], many)], np.repeat(sim, many)
        o = np.lexsort((-sim, e, i))
        i, e, sim = i[o], e[o], sim[o]
        first = np.ones(len(i), bool)
        first[1:] = (i[1:] != i[:-1]) | (e[1:] != e[:-1])
        return best_of(i[first], e[first], sim[first], top)


def best_of(i: np.ndarray, e: np.ndarray, s: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each i the `top` of greatest s; ties to the smaller e."""
    o = np.lexsort((e, -s, i))
    i, e, s = i[o], e[o], s[o]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < top
    return i[keep], e[keep], s[keep]


def similar_forms(texts: pa.Table, forms: pa.Table, least: float, top: int) -> pa.Table:
    """texts (t, padded), forms (form, padded, ids): (t, id, fuzzy), the `top` ids of each text by shared over all trigrams."""
    held = Forms(_column(forms, "padded"), _column(forms, "ids"))
    t, e, s = held.best(_column(texts, "padded").to_pylist(), least, top)
    return _rows(_column(texts, "t"), held.ids, [t], [e], [s], "fuzzy")


def _rows(names: pa.Array, ids: pa.Array, t: list, e: list, s: list, score: str) -> pa.Table:
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return pa.table({"t": names.take(pa.array(cat(t, np.int64))), "id": ids.take(pa.array(cat(e, np.int64))), score: pa.array(cat(s, np.float64))})


#: Documents of the rare words of a text that are scored one by one, and sets of frequent words whose best documents are kept.
RARE_DOCS, KEPT_LISTS = 100, 1 << 12


class Words:
    """Documents (bodies; words stand between blanks) by the words `asked`, each with its BM25 weight; a document's number is its place, in `order` if given."""

    def __init__(self, bodies: pa.Array, asked: pa.Array, stop_share: float, k1: float, b: float, order: pa.Array | None = None) -> None:
        n = len(bodies)
        asked = asked.filter(pc.not_equal(asked, ""))
        self.number = {w: i for i, w in enumerate(asked.to_pylist())}
        dl, keys, at = np.zeros(n, np.int64), [np.zeros(0, np.int64)], 0
        # of the bodies, a slice at a time, only the words that texts hold are kept
        for at in range(0, n, 10_000):
            ws = pc.split_pattern(pc.fill_null(bodies.slice(at, 10_000) if order is None else bodies.take(order.slice(at, 10_000)), ""), " ")
            flat, of = ws.flatten(), np.repeat(np.arange(at, at + len(ws)), pc.list_value_length(ws).to_numpy(zero_copy_only=False))
            dl += np.bincount(of[pc.not_equal(flat, "").to_numpy(zero_copy_only=False)], minlength=n)
            w = pc.fill_null(pc.index_in(flat, asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys.append(w[w >= 0] * n + of[w >= 0])
        mean = (dl.mean() if n else 0.0) or 1.0
        keys, tf = _runs(np.concatenate(keys))
        tf = tf.astype(np.int32)
        w, doc = np.divmod(keys, max(n, 1))
        w, self.doc = w.astype(np.int32), doc.astype(np.int32)
        del doc
        self.at = _lists(w, len(self.number))
        self.df = np.diff(self.at)
        idf = np.log(1 + (n - self.df + 0.5) / (self.df + 0.5))
        self.weight = idf[w] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[self.doc] / mean))
        self.stop = self.df > stop_share * n
        self.most = np.zeros(len(self.df))
        some = self.df > 0
        self.most[some] = np.maximum.reduceat(self.weight, self.at[:-1][some]) if some.any() else 0.0
        # the documents of each word by their weight
        self.first = self.doc[np.lexsort((self.doc, -np.round(self.weight, 6), w))]
        self.score, self.many, self.keys = np.zeros(n), n, keys
        self.lists: dict[tuple, tuple] = {}

    def best(self, names: list[str], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, document, score to six digits) by numbers: the `top` documents of each text.

        The documents that hold a rare word of a text are scored, those of all texts at once; the others are the best of its frequent words,
        which many texts share and which are looked up once."""
        if len(names) > SLICE:
            parts = [(i + x, d, s) for x in range(0, len(names), SLICE) for i, d, s in [self.best(names[x : x + SLICE], top)]]
            return tuple(np.concatenate(x) for x in zip(*parts))
        held, stop = (self.df > 0).tolist(), self.stop.tolist()
        rare = (~self.stop & (self.df <= min(RARE_DOCS, self.many // 64))).tolist()
        keys: dict[tuple, int] = {}  # texts often differ in words that no document holds
        of = np.array([keys.setdefault(tuple(sorted(x for x in map(self.number.get, set(t.split(" "))) if x is not None and held[x])), len(keys)) for t in names], np.int64)
        most, df = self.most.tolist(), self.df.tolist()
        pairs, words, begins, listed = [], [], [], []
        for i, own in enumerate(keys):
            few = [x for x in own if rare[x]]
            if sum(df[x] for x in few) > RARE_DOCS:
                few = []
            rest = tuple(x for x in own if x not in few) if few else own
            if any(not stop[x] for x in rest):
                listed.append((i, rest, sum(df[x] for x in few)))
            if few:
                pairs += [(i, x) for x in few]
                words.append(sorted(own, key=lambda x: (stop[x], 0 if stop[x] else -most[x])))
                begins.append(i)
        parts = [self._rare(np.array(pairs, np.int64), np.array(begins, np.int64), words) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for x, rest, more in listed:
            d, s = self._found(rest, top + more, top)
            parts.append((np.full(len(d), x), d, s))
        i, d, s = (np.concatenate(x) for x in zip(*parts))
        if len(pairs):  # a document of a rare word is in the list as well, without it
            o = np.lexsort((np.arange(len(i)), d, i))
            i, d, s = i[o], d[o], s[o]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1])
            i, d, s = best_of(i[first], d[first], s[first], top)
        else:
            o = np.argsort(i, kind="stable")
            i, d, s = i[o], d[o], s[o]
        at = _lists(i, len(keys))
        n = np.diff(at)[of]
        rows = _flat(at[:-1][of], n)
        return np.repeat(np.arange(len(of)), n), d[rows], s[rows]

    def _rare(self, pairs: np.ndarray, begins: np.ndarray, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, document, score) of all documents of (key, word); words: all words of the keys `begins`, in the order in which weights are added."""
        n = np.diff(self.at)[pairs[:, 1]]
        key, doc = np.repeat(pairs[:, 0], n), self.doc[_flat(self.at[pairs[:, 1]], n)].astype(np.int64)
        key, doc = np.divmod(np.unique(key * self.many + doc), self.many)
        many = np.array([len(w) for w in words], np.int64)
        flat = np.array([x for w in words for x in w], np.int64)
        place = np.searchsorted(begins, key)
        k = many[place]
        asked = flat[_flat((np.cumsum(many) - many)[place], k)] * self.many + np.repeat(doc, k)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        add = np.where(self.keys[at] == asked, self.weight[at], 0.0)
        return key, doc, np.round(np.bincount(np.repeat(np.arange(len(key)), k), add, len(key)), 6)

    def _found(self, own: tuple, most: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a set of words, the `most` best; those of frequent words are kept."""
        if own not in self.lists:
            if len(self.lists) >= KEPT_LISTS:
                self.lists.clear()
            self.lists[own] = self._search(own, top + RARE_DOCS if len(own) < 4 else most)
        d, s = self.lists[own]
        if len(d) < most and len(own) > 3:
            d, s = self._search(own, most)
        return d[:most], s[:most]

    def _search(self, own: tuple, top: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.score
        finding = sorted((x for x in own if not self.stop[x]), key=lambda x: -self.most[x])
        if not finding:
            return np.zeros(0, np.int64), np.zeros(0)
        later = [*finding, *(x for x in own if self.stop[x])]  # stop words add to what the others find
        rest = sum(self.most[x] for x in later)
        d, least = self.doc[:0], -1.0
        for j, x in enumerate(later):
            here, w = self.doc[self.at[x] : self.at[x + 1]], self.weight[self.at[x] : self.at[x + 1]]
            if least < 0 and len(d) >= top:
                s = score[d]
                bound = np.partition(s, len(s) - top)[len(s) - top]
                least = bound if rest + 2e-6 < bound else least
                if len(s) > 4 * top:  # what can't be among the best any more
                    keep = s + (rest + 2e-6) >= bound
                    score[d[~keep]] = 0
                    d = d[keep]
            rest -= self.most[x]
            more = least < 0 and not self.stop[x]  # else what only the words from here on hold can't be among the best
            if len(d) < len(here) // 8 and (not more or j == len(later) - 1):
                place = np.searchsorted(here, d)
                place[place == len(here)] = 0
                add = np.where(here[place] == d, w[place], 0.0)
                if more:  # the best of those that hold no other word; a score is not 0
                    first = self.first[self.at[x] : self.at[x + 1]][: top + len(d)]
                    first = first[score[first] == 0][:top]
                    score[first] = w[np.searchsorted(here, first)]
                    score[d] += add
                    d = np.concatenate([d, first])
                else:
                    score[d] += add
                continue
            known = score[here]
            if more:
                score[here] = known + w
                d = np.concatenate([d, here[known == 0]])
            else:
                score[here] = np.where(known > 0, known + w, 0.0)
        s = np.round(score[d], 6)
        score[d] = 0
        if len(s) > top:
            enough = s >= np.partition(s, len(s) - top)[len(s) - top]
            d, s = d[enough], s[enough]
        _, d, s = best_of(np.zeros(len(d), np.int64), d.astype(np.int64), s, top)
        return d, s


def _by_id(held: pa.Table) -> pa.Table:
    return held.take(pc.array_sort_indices(_column(held, "id")))


def _words(names: pa.Array) -> pa.Array:
    return pc.unique(pc.split_pattern(names, " ").flatten())


def scored_texts(texts: pa.Table, docs: pa.Table, top: int, stop_share: float, k1: float, b: float) -> pa.Table:
    """texts (t), docs (id, body): (t, id, fulltext), the `top` ids of greatest BM25 score, to six digits, of each text; words stand between blanks."""
    docs, names = _by_id(docs), _column(texts, "t")
    t, d, s = Words(_column(docs, "body"), _words(names), stop_share, k1, b).best(names.to_pylist(), top)
    return _rows(names, _column(docs, "id"), [t], [d], [s], "fulltext")


def fused(exact: np.ndarray, fulltext: np.ndarray, vector: np.ndarray, fuzzy: np.ndarray, kind: np.ndarray, coherence: np.ndarray) -> np.ndarray:
    """`functions.text.fuse` of signals that are not null; halves go up, and what a sum of doubles makes of a half is one."""
    e, f, v, z, t, c = (np.clip(x, 0.0, 1.0) for x in (exact, fulltext, vector, fuzzy, kind, coherence))
    score = 0.35 * e + 0.15 * f + 0.20 * v + 0.15 * z + 0.10 * t + 0.05 * c
    score = (np.floor(score * 1e8 + (0.5 + 1e-7)).astype(np.int64) + 5_000) // 10_000 / 10_000
    return np.where((exact >= 1) & (kind > 0), np.maximum(score, 0.97), score)


SIGNALS = ("exact", "fulltext", "fuzzy", "type")


def _merged(key: np.ndarray, *signals: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, greatest of each signal)."""
    o = np.argsort(key, kind="stable")
    key = key[o]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[at], *(np.maximum.reduceat(x[o], at) if len(at) else x for x in signals)


def best_links(mentions: pa.Table, held: pa.Table, keep: int, least: float, top: int, stop_share: float, k1: float, b: float) -> pa.Table:
    """mentions (mention_id, g, t, padded, raw, types), held (id, kind, forms, padded, body): of each mention its `keep` best
    candidates of all routes, as (mention_id, g, ids, signals).

    What a mention is linked to follows from its text and types, so each of these is looked at once."""
    order, bodies = pc.array_sort_indices(_column(held, "id")), _column(held, "body")
    held = held.drop_columns(["body"]).take(order)
    ids, many = _column(held, "id"), held.num_rows
    raw = pc.coalesce(_column(mentions, "raw"), _column(mentions, "t"))
    direct = pc.fill_null(pc.index_in(raw, ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    coded, kinds = _column(mentions, "t").dictionary_encode(), _column(mentions, "types").dictionary_encode()
    t_of, t_all = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    k_of = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    # allowed[types, kind of entity]
    own = _column(held, "kind").dictionary_encode()
    own_of = pc.fill_null(own.indices, len(own.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    allowed = np.array([[1.0] * (len(own.dictionary) + 1)] + [[float(x in w) for x in own.dictionary.to_pylist()] + [0.0] for w in map(json.loads, kinds.dictionary.to_pylist())])
    # a variant: a text, the id that it is, the types
    variants, of = np.unique(((t_of + 1) * (many + 1) + direct + 1) * len(allowed) + k_of, return_inverse=True)
    rest, v_k = np.divmod(variants, len(allowed))
    v_t, v_d = np.divmod(rest, many + 1)
    v_t, v_d = v_t - 1, v_d - 1
    # forms and what holds each
    flat = _column(held, "forms").flatten()
    parent = np.repeat(np.arange(many), pc.fill_null(pc.list_value_length(_column(held, "forms")), 0).to_numpy(zero_copy_only=False))
    form = flat.dictionary_encode()
    f_of = form.indices.to_numpy().astype(np.int64)
    o = np.argsort(f_of, kind="stable")
    f_at = _lists(f_of[o], len(form.dictionary))
    padded = pc.coalesce(_column(held, "padded").flatten(), flat).take(pa.array(o[f_at[:-1]])) if len(o) else pa.array([], pa.string())
    forms = Forms(_padded(padded), pa.ListArray.from_arrays(pa.array(f_at.astype(np.int32)), pa.array(parent[o])))
    numbers = np.asarray(forms.ids.to_numpy(), np.int64) if len(forms.ids) else np.zeros(0, np.int64)
    words = Words(bodies, _words(t_all), stop_share, k1, b, order)
    del flat, padded, f_of, raw
    give_back()
    t_padded = _padded(pc.coalesce(_column(mentions, "padded"), _column(mentions, "t")).take(pa.array(_firsts(t_of, len(t_all)))))
    order = forms.order(t_padded)
    t_all, t_padded = t_all.take(pa.array(order)), t_padded.take(pa.array(order))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    v_t = np.where(v_t >= 0, np.append(back, -1)[v_t], -1)
    same = pc.fill_null(pc.index_in(t_all, form.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = (np.int32, np.int32, bool, np.float64, np.float64, bool)  # the types in which rows wait
    done = [tuple(np.zeros(0, x) for x in kept)]
    for a in range(-1, max(len(t_all), 1), SLICE):  # the text -1 is none
        z = min(a + SLICE, len(t_all))
        lo = max(a, 0)
        i1, e1, s1 = forms.best(t_padded.slice(lo, z - lo).to_pylist(), least, top)
        i2, e2, s2 = words.best(t_all.slice(lo, z - lo).to_pylist(), top)
        x = np.flatnonzero(same[lo:z] >= 0)
        n3 = np.diff(f_at)[same[lo:z][x]]
        i3, e3 = np.repeat(x, n3), parent[o][_flat(f_at[same[lo:z][x]], n3)]
        none = lambda y: np.zeros(len(y))
        key, exact, fulltext, fuzzy = _merged(
            np.concatenate([i1 * many + numbers[e1], i2 * many + e2, i3 * many + e3]), np.concatenate([(s1 == 1).astype(float), none(i2), none(i3) + 1]),
            np.concatenate([none(i1), s2, none(i3)]), np.concatenate([s1, none(i2), none(i3) + 1]),
        )
        i, e = np.divmod(key, max(many, 1))
        v = np.flatnonzero((v_t >= a) & (v_t < z))
        at = np.searchsorted(i, np.arange(z - lo + 1))
        begin, n = at[np.maximum(v_t[v] - lo, 0)], np.where(v_t[v] >= 0, np.diff(at, append=0)[np.maximum(v_t[v] - lo, 0)], 0)
        rows = _flat(begin, n)
        v_of, e, exact, fulltext, fuzzy = np.repeat(v, n), e[rows], exact[rows], fulltext[rows], fuzzy[rows]
        d = v[v_d[v] >= 0]
        d = d[allowed[v_k[d], own_of[v_d[d]]] > 0]
        if len(d):
            key, exact, fulltext, fuzzy = _merged(np.concatenate([v_of * many + e, d * many + v_d[d]]), np.append(exact, none(d) + 1), np.append(fulltext, none(d)), np.append(fuzzy, none(d) + 1))
            v_of, e = np.divmod(key, many)
        kind = allowed[v_k[v_of], own_of[e]]
        score = fused(exact, fulltext, np.zeros(len(e)), fuzzy, kind, np.zeros(len(e)))
        o2 = np.lexsort((e, -score, v_of))
        v_of = v_of[o2]
        o2 = o2[np.arange(len(o2)) - np.searchsorted(v_of, v_of) < keep]
        v_of = v_of[np.arange(len(v_of)) - np.searchsorted(v_of, v_of) < keep]
        done.append(tuple(x.astype(y) for x, y in zip((v_of, e[o2], exact[o2], fulltext[o2], fuzzy[o2], kind[o2]), kept)))
    v_of, e, *signals = (np.concatenate(x) for x in zip(*done))
    del done
    o = np.argsort(v_of, kind="stable")
    v_of, e, signals = v_of[o], e[o], [x[o] for x in signals]
    at = _lists(v_of, len(variants))
    n = np.diff(at)[of]
    some = np.flatnonzero(n)
    rows = _flat(at[:-1][of[some]], n[some])
    starts = pa.array(np.concatenate(([0], np.cumsum(n[some]))).astype(np.int32))
    out = {c: _column(mentions, c).take(pa.array(some)) for c in ("mention_id", "g")} | {"ids": pa.ListArray.from_arrays(starts, ids.take(pa.array(e[rows])))}
    return pa.table(out | {c: pa.ListArray.from_arrays(starts, pa.array(x[rows].astype(np.float64))) for c, x in zip(SIGNALS, signals)})


def _padded(names: pa.Array) -> pa.Array:
    """`functions.text.padded_words` of plain words, which stand for it between blanks; others begin with a blank and stay."""
    return pa.array([x if x[:1] in ("", " ") else "".join(f"  {w} " for w in x.split(" ") if w) for x in names.to_pylist()], pa.string())


def _firsts(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of 0..n-1 is first in `of`."""
    at = np.zeros(n, np.int64)
    where = np.flatnonzero(of >= 0)[::-1]
    at[of[where]] = where
    return at


LARGE = 1_500  # entities of a group from which its links are searched from one at a time


class Ways:
    """Edges by their ends: how much each entity of a group is linked to each other, all edges between two, else one for a way of two or three."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, many: int) -> None:
        o = np.argsort(src, kind="stable")
        self.src, self.dst, self.w = src[o], dst[o], w[o].astype(np.float64)
        self.at = _lists(self.src, many)
        # each edge once more from its end of fewer edges, so that no list is long
        n = np.diff(self.at)
        up = (n[self.src] < n[self.dst]) | (n[self.src] == n[self.dst]) & (self.src < self.dst)
        self.up, self.up_at = self.dst[up], _lists(self.src[up], many)
        self.col, self.many = np.full(many, -1, np.int64), many

    def _near(self, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = at[x + 1] - at[x]
        return np.repeat(np.arange(len(x)), n), _flat(at[x], n)

    def among(self, ids: np.ndarray) -> np.ndarray:
        """ids x ids: the links of each with each."""
        r, p = self._near(self.at, ids)
        x, s = self.dst[p], len(ids)
        if s > LARGE:
            out = np.array([self._from(i)[ids] for i in ids], np.float32)
        else:
            every = np.unique(np.concatenate([ids, x]))
            self.col[every] = np.arange(len(every))
            a, b = np.zeros((s, len(every)), np.float32), np.zeros((s, len(every)), np.float32)
            a[r, self.col[x]] = 1
            a[np.arange(s), self.col[ids]] = 1
            # a way of three has an edge in its middle, which goes up from one end of it
            r1, x1 = np.append(r, np.arange(s)), np.append(x, ids)
            r2, p2 = self._near(self.up_at, x1)
            c = self.col[self.up[p2]]
            b[r1[r2[c >= 0]], c[c >= 0]] = 1
            self.col[every] = -1
            m = a @ b.T
            out = ((a @ a.T + m + m.T) > 0).astype(np.float32)
        self.col[ids] = np.arange(s)
        c = self.col[x]
        out[r[c >= 0], c[c >= 0]] = self.w[p[c >= 0]]
        self.col[ids] = -1
        return out

    def _from(self, i: int) -> np.ndarray:
        seen = np.zeros(self.many, bool)
        seen[i] = True
        front = np.array([i])
        for _ in range(3):
            near = np.zeros(self.many, bool)
            near[self.dst[self._near(self.at, front)[1]]] = True
            front = np.flatnonzero(near & ~seen)
            seen |= near
        return seen


def coherent(best: pa.Table, steps: pa.Table, top: int) -> pa.Table:
    """best (mention_id, g, ids, signals; whole groups), steps (src, dst, w): best with coherence and score, ranked anew, without g.

    Of each of its `top` first candidates: how many links it has to those of the other mentions of the group; two make 1."""
    found, many = _column(best, "ids"), best.num_rows
    n = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = pa.concat_arrays([_column(steps, "src"), _column(steps, "dst"), found.flatten()]).dictionary_encode()
    code, e = ends.indices.to_numpy().astype(np.int64), steps.num_rows
    order = np.empty(len(ends.dictionary), np.int64)
    order[pc.array_sort_indices(ends.dictionary).to_numpy()] = np.arange(len(order))
    ways = Ways(code[:e], code[e : 2 * e], _column(steps, "w").to_numpy(), len(order))
    code = code[2 * e :]
    mention = np.repeat(np.arange(many), n)
    at = np.cumsum(n) - n
    place = np.arange(len(code)) - at[mention]
    group = pc.fill_null(_column(best, "g").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    links = np.zeros(len(code))
    by = np.argsort(group, kind="stable")
    by = by[group[by] >= 0]
    cuts = np.flatnonzero(np.diff(group[by], prepend=-1, append=-1)) if len(by) else np.zeros(0, np.int64)
    for a, z in zip(cuts[:-1], cuts[1:]):
        if z - a < 2:
            continue
        m = by[a:z]
        k = np.minimum(n[m], top)
        flat = _flat(at[m], k)
        ids, own = np.unique(code[flat], return_inverse=True)
        w = ways.among(ids)
        once = np.bincount(own)[own] == 1
        # what only the mention itself has among its best is none of the others
        wide = np.full((len(m), top), -1)
        wide[np.repeat(np.arange(len(m)), k), place[flat]] = own
        mine = np.zeros((len(m), top), bool)
        mine[np.repeat(np.arange(len(m)), k), place[flat]] = once
        off = (w[wide[:, :, None], wide[:, None, :]] * mine[:, None, :]).sum(axis=2)
        links[flat] = w.sum(axis=1, dtype=np.float64)[own] - off[np.repeat(np.arange(len(m)), k), place[flat]]
    coherence = np.minimum(1.0, links / 2)
    flat = {c: _column(best, c).flatten().to_numpy() for c in SIGNALS}
    score = fused(flat["exact"], flat["fulltext"], np.zeros(len(code)), flat["fuzzy"], flat["type"], coherence)
    o = np.lexsort((order[code], -score, mention))
    starts = pa.array(np.append(at, len(code)).astype(np.int32))
    as_list = lambda x: pa.ListArray.from_arrays(starts, x)
    out = {"mention_id": _column(best, "mention_id"), "ids": as_list(found.flatten().take(pa.array(o)))}
    return pa.table(out | {c: as_list(pa.array(x[o])) for c, x in (flat | {"coherence": coherence, "score": score}).items()})


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first place to the last, as the expression of a cosine does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _matrix(t: pa.Table, name: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors) of that size, without vectors that hold a null."""
    v = _column(t, name)
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(v), size), False).to_numpy(zero_copy_only=False))
    flat = v.take(pa.array(at)).flatten()
    gone = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), size).any(axis=1)
    m = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    return at[~gone], m[~gone]


def near_vectors(rows: pa.Table, asked: pa.Table, top: int, digits: int | None) -> pa.Table:
    """rows (id, e), asked (mention_id, v): (mention_id, id, vector), the `top` of greatest positive cosine of each asked vector; ties to the smaller id."""
    ids = _column(rows, "id")
    place = np.empty(len(ids), np.int64)
    place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    out_q, out_e, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for size in pc.unique(pc.list_value_length(_column(asked, "v"))).to_pylist():
        if not size:
            continue
        q_at, q = _matrix(asked, "v", size)
        e_at, e = _matrix(rows, "e", size)
        with np.errstate(all="ignore"):
            q_norm, e_norm = np.sqrt(_dots(q, q)), np.sqrt(_dots(e, e))
            fit = np.isfinite(e_norm) & (e_norm > 0)
            e_at, e, e_norm = e_at[fit], e[fit], e_norm[fit]
            unit = (e / e_norm[:, None]).T
        for i in np.flatnonzero(np.isfinite(q_norm) & (q_norm > 0)) if len(e) else ():
            c = (q[i] / q_norm[i]) @ unit
            # the product is near enough to tell which can be among the best; these are summed in order
            some = np.flatnonzero(c >= (np.partition(c, len(c) - top)[len(c) - top] - 4e-6 if len(c) > top else -1e-9))
            some = some[c[some] > -1e-9]
            s = _dots(np.broadcast_to(q[i], (len(some), size)), e[some]) / (q_norm[i] * e_norm[some])
            some, s = some[s > 0], s[s > 0]
            s = s if digits is None else np.round(s, digits)
            o = np.lexsort((place[e_at[some]], -s))[:top]
            out_q.append(np.full(len(o), q_at[i]))
            out_e.append(e_at[some[o]])
            out_s.append(s[o])
    take = lambda t, c, xs: _column(t, c).take(pa.array(np.concatenate(xs)))
    return pa.table({"mention_id": take(asked, "mention_id", out_q), "id": take(rows, "id", out_e), "vector": pa.array(np.concatenate(out_s))})


def level_sizes(roots: pa.Table, steps: pa.Table, hops: int) -> pa.Table:
    """roots (id), steps (src, dst): (root, hops, n), how many nodes are that far from each root; many roots at once, each a bit."""
    names = _column(roots, "id")
    ends = pa.concat_arrays([_column(steps, "src"), _column(steps, "dst"), names]).dictionary_encode()
    code, many = ends.indices.to_numpy().astype(np.int64), len(ends.dictionary)
    e = steps.num_rows
    src, dst, start = code[:e], code[e : 2 * e], code[2 * e :]
    o = np.argsort(dst, kind="stable")
    src, into = src[o], dst[o]
    into, first = np.unique(into, return_index=True)
    words = int(max(1, min(16, (32 << 20) // (8 * max(e, 1)))))
    out = {"root": [], "hops": [], "n": []}
    for at in range(0, len(start), 64 * words):
        own = start[at : at + 64 * words]
        i = np.arange(len(own))
        seen = np.zeros((many, words), np.uint64)
        np.bitwise_or.at(seen, (own, i // 64), np.uint64(1) << (i % 64).astype(np.uint64))
        front = seen.copy()
        for k in range(hops + 1):
            if k:
                new = np.zeros_like(seen)
                if e:
                    new[into] = np.bitwise_or.reduceat(front[src], first, axis=0)
                front = new & ~seen
                seen |= front
            n = np.zeros(64 * words, np.int64)
            for a in range(0, many, 1 << 14):
                n += np.unpackbits(front[a : a + (1 << 14)].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            got = np.flatnonzero(n[: len(own)])
            if not len(got):
                break
            out["root"].append(at + got)
            out["hops"].append(np.full(len(got), k))
            out["n"].append(n[got])
    cat = {c: np.concatenate(xs) if xs else np.zeros(0, np.int64) for c, xs in out.items()}
    return pa.table({"root": names.take(pa.array(cat["root"])), "hops": pa.array(cat["hops"], pa.int32()), "n": pa.array(cat["n"], pa.int64())})


ROWS_OUT = 1 << 15  # of a batch


def path_trees(rows: pa.Table, hops: int, sep: str) -> Iterator[pa.RecordBatch]:
    """rows (kind, a, b): "root" (id), "step" (src, dst), "name" (id, name): (root, node, hops, path, names) of every node within `hops` of each root.

    Of several shortest paths the one whose last steps are smallest; an id without a name names itself."""
    of = lambda kind, *cs: (_column(t, c) for t in [rows.filter(pc.equal(rows.column("kind"), kind))] for c in cs)
    (roots,), (src, dst), (known, name) = of("root", "a"), of("step", "a", "b"), of("name", "a", "b")
    ids = pc.unique(pa.concat_arrays([src, dst, roots]))
    ids = ids.take(pc.array_sort_indices(ids))  # so that numbers are in the order of ids
    shown = pc.coalesce(name.take(pc.index_in(ids, known)), ids)
    code = lambda x: pc.index_in(x, ids).to_numpy().astype(np.int64)
    src, dst, many = code(src), code(dst), len(ids)
    o = np.argsort(src, kind="stable")
    dst, at = dst[o].astype(np.int32), _lists(src[o], many)
    far, before = np.full(many, -1, np.int8), np.zeros(many, np.int32)
    waiting, n_waiting = [], 0
    for root in code(roots):
        far[:] = -1
        far[root] = 0
        front, path, names = np.array([root]), ids.slice(root, 1), shown.slice(root, 1)
        for k in range(hops + 1):
            if k:
                n = at[front + 1] - at[front]
                d, s = dst[_flat(at[front], n)], np.repeat(np.arange(len(front), dtype=np.int32), n)
                new = far[d] < 0
                d, s = d[new], s[new]
                if not len(d):
                    break
                before[d[::-1]] = s[::-1]  # the front is in the order of ids, and the smallest is written last
                far[d] = k
                front = np.flatnonzero(far == k) if len(d) > many // 32 else np.unique(d).astype(np.int64)
                own = pa.array(before[front])
                path, names = (pc.binary_join_element_wise(x.take(own), y.take(pa.array(front)), sep) for x, y in ((path, ids), (names, shown)))
            waiting.append(pa.record_batch([pa.repeat(ids[root], len(front)), ids.take(pa.array(front)), pa.repeat(pa.scalar(k, pa.int32()), len(front)), path, names], ["root", "node", "hops", "path", "names"]))
            n_waiting += len(front)
            if n_waiting >= ROWS_OUT:
                yield from _batches(waiting)
                waiting, n_waiting = [], 0
    if waiting:
        yield from _batches(waiting)


def _batches(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return iter(pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=ROWS_OUT))
