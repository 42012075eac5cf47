"""Keyword, link and tag pages by a hidden Markov model over lines.

Each line (a long one in stretches) is measured in the same way in every script: how much of it is
links, hashtags, function words, figures, capitals, how long its pieces are, whether sentences end in
it, and how much of it is said again close by. No measure is a verdict: each is cut into bins, and a
model with the states below gives every bin a probability. The model starts from the values below
and is re-estimated by Baum-Welch, its expected counts summed over all documents each round; then
every text is decoded whole, and a page is flagged by the share of its words that are not prose.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Hidden states. Sentences, notices (sentences with hardly a function word), records (registers, schedules) and headings are prose; tags are hashtags, search words one after
#: another, offers, and pitches built round a search word.
STATES = ("sentence", "notice", "record", "heading", "links", "hashtags", "list", "offers", "pitch", "menu")
LABELS = ("prose", "links", "tags", "menu")
LABEL_OF = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2, 3])
ROUNDS = 3
SHARE = 0.5
STRETCH = 30  # words of a long line that make one unit
NEAR = 2  # units before and after in which words are looked for again
CELLS = 200_000  # units that one step of the recursions holds at most

# Frequent function words of English, German, French, Spanish, Portuguese, Italian and Russian.
FUNCTION = frozenset(
    "the of a an and to in on at for by with from was were is are be been that which who said not will had has have as it its this their he she"
    " they we i you after before during while under over without despite because if or but than into through between all no would could until"
    " der die das den dem des ein eine einen einer eines und zu im in am an auf bei mit von vom für über nach vor aus wegen ohne seit um nicht ist"
    " war wurde wird hat sich es dass als auch zum zur"
    " le la les un une des du de et à au aux en dans sur pour par avec sans depuis que qui ne pas est sont été a ont son sa ses ce cette malgré"
    " el los las una del y o en por para con sin desde que no es son fue ha se su sus al tras ante pese hasta"
    " os uma da do das dos e em no na nos nas por com sem que não foi il lo gli di da in con su per non che è"
    " и в на с по от за из у о к не что как для это был была были после до без под над при через из-за несмотря".split()
)
# Chinese function characters, Japanese particles, endings of Korean words in a sentence.
MARKS = frozenset("的了在是和与不为以及对于将被其已因至但而并由向从把也都就这那所之上中下后前のはをにがでともへ")
ENDINGS = ("은", "는", "이", "가", "을", "를", "의", "에", "에서", "로", "와", "과", "다", "도")

_LINK = re.compile(r"(?:https?://|www\.)\S+|<a\s[^>]*>.*?</a>|\[[^\]]*\]\([^)]*\)", re.I)
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")
#: Words, characters of scripts without blanks, and the marks that are counted: ends of sentences, separators, hashes of hashtags.
_TOKEN = re.compile(r"[^\W_぀-ヿ㐀-鿿]+|[぀-ヿ㐀-鿿]|[,|;•·»、，；،｜؛。！？؟]|[.!?…](?=[\s<\"'»”’)\]』」&]|$)|#(?=[^\W_])")
_SEPARATORS, _ENDS = frozenset(",|;•·»、，；،｜؛"), frozenset("。！？؟.!?…")
_ITEM = re.compile(r"[ \t]*\(?\d{1,3}[.)][ \t]+")  # the number of a list's line

#: Measures of a unit and the upper ends of their bins but the last.
BINS: dict[str, tuple[float, ...]] = {
    "link": (0.0, 0.2, 0.5),
    "hashtag": (0.0, 0.4),
    "function": (0.0, 0.08, 0.15, 0.25),
    "end": (0.0,),
    "within": (0.0, 0.15, 0.35),
    "near": (0.0, 0.15, 0.35, 0.65),
    "dense": (0.0, 0.08, 0.15),
    "piece": (3.0, 5.0, 8.0, 14.0),
    "marks": (0.0, 0.1, 0.2),
    "digit": (0.0, 0.1, 0.2),
    "capital": (0.0, 0.3, 0.6),
    "head": (0.1, 0.25, 0.5),
    "words": (3.0, 8.0, 20.0),
}
SIZES = [len(b) + 1 for b in BINS.values()]
AT = np.cumsum([0, *SIZES[:-1]])
CODES = int(np.prod(SIZES))

#: Starting values: of each measure's bins, in each state.
_START = {
    "link": ([97, 2, 0.5, 0.5], [97, 2, 0.5, 0.5], [97, 2, 0.5, 0.5], [97, 2, 0.5, 0.5], [2, 5, 23, 70], [95, 3, 1, 1], [95, 3, 1, 1], [97, 1, 1, 1], [95, 3, 1, 1], [90, 5, 3, 2]),
    "hashtag": ([99, 0.8, 0.2], [99, 0.8, 0.2], [99, 0.8, 0.2], [99, 0.8, 0.2], [95, 4, 1], [1, 9, 90], [97, 2, 1], [98, 1, 1], [97, 2, 1], [98, 1, 1]),
    "function": ([6, 6, 18, 35, 35], [35, 30, 20, 10, 5], [55, 20, 15, 6, 4], [55, 10, 10, 10, 15], [75, 15, 6, 3, 1], [92, 5, 1, 1, 1], [85, 11, 3, 0.7, 0.3], [90, 8, 1, 0.6, 0.4], [20, 20, 25, 20, 15], [80, 10, 5, 3, 2]),
    "end": ([6, 94], [4, 96], [75, 25], [97, 3], [80, 20], [97, 3], [96, 4], [97, 3], [15, 85], [97, 3]),
    "within": ([86, 10, 3, 1], [45, 30, 17, 8], [90, 7, 2, 1], [97, 1, 1, 1], [60, 25, 10, 5], [60, 25, 10, 5], [55, 15, 12, 18], [85, 10, 3, 2], [5, 15, 40, 40], [85, 10, 3, 2]),
    "near": ([70, 17, 9, 3, 1], [30, 25, 20, 15, 10], [55, 20, 15, 8, 2], [88, 6, 2, 2, 2], [35, 15, 20, 15, 15], [55, 15, 15, 10, 5], [35, 13, 15, 15, 22], [15, 25, 25, 25, 10], [25, 20, 20, 20, 15], [50, 15, 15, 10, 10]),
    "dense": ([90, 9, 0.8, 0.2], [35, 35, 23, 7], [88, 10, 1.5, 0.5], [97, 1, 1, 1], [60, 15, 15, 10], [60, 15, 15, 10], [55, 12, 17, 16], [85, 10, 4, 1], [5, 8, 17, 70], [85, 8, 4, 3]),
    "piece": ([4, 9, 27, 35, 25], [4, 9, 27, 35, 25], [25, 25, 20, 20, 10], [78, 16, 4, 1, 1], [30, 20, 20, 15, 15], [25, 15, 20, 20, 20], [48, 20, 12, 8, 12], [75, 20, 3, 1, 1], [12, 18, 40, 20, 10], [70, 20, 6, 2, 2]),
    "marks": ([45, 45, 8, 2], [45, 40, 12, 3], [30, 10, 25, 35], [93, 4, 2, 1], [40, 10, 20, 30], [75, 5, 10, 10], [35, 5, 15, 45], [2, 2, 16, 80], [50, 35, 12, 3], [70, 5, 10, 15]),
    "digit": ([55, 30, 10, 5], [35, 30, 20, 15], [22, 13, 20, 45], [85, 5, 5, 5], [60, 20, 10, 10], [40, 20, 20, 20], [80, 10, 6, 4], [5, 10, 20, 65], [80, 12, 5, 3], [90, 5, 3, 2]),
    "capital": ([12, 50, 28, 10], [25, 5, 10, 60], [3, 15, 40, 42], [10, 15, 30, 45], [50, 20, 15, 15], [25, 15, 15, 45], [62, 20, 9, 9], [60, 37, 2, 1], [25, 55, 10, 10], [20, 20, 20, 40]),
    "head": ([85, 8, 4, 3], [85, 8, 4, 3], [70, 12, 10, 8], [97, 1, 1, 1], [50, 15, 15, 20], [85, 5, 5, 5], [62, 10, 13, 15], [85, 5, 5, 5], [45, 20, 20, 15], [80, 10, 5, 5]),
    "words": ([4, 10, 40, 46], [4, 15, 45, 36], [15, 30, 42, 13], [75, 22, 2, 1], [25, 40, 20, 15], [15, 25, 30, 30], [25, 25, 20, 30], [5, 30, 45, 20], [10, 30, 40, 20], [60, 30, 7, 3]),
}
START = np.array([0.58, 0.05, 0.12, 0.10, 0.05, 0.01, 0.05, 0.02, 0.017, 0.003])
#: A state stays with this probability, else goes to any other alike.
STAY = np.array([0.95, 0.93, 0.93, 0.10, 0.92, 0.90, 0.92, 0.92, 0.92, 0.80])


def starting_values() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transition, emission): emission has a row a bin of any measure and a column a state."""
    e = np.concatenate([np.array(_START[f], dtype=float).T for f in BINS])
    for a, n in zip(AT, SIZES):
        e[a : a + n] /= e[a : a + n].sum(0)
    k = len(STATES)
    trans = np.repeat((1 - STAY)[:, None] / (k - 1), k, axis=1)
    np.fill_diagonal(trans, STAY)
    return START / START.sum(), trans, e


class _Vocabulary(dict):
    """Number of a token, with its properties in lists by number; emptied when full."""

    MOST = 500_000
    WORD, WIDE, FUNCTION, DIGIT, CAPITAL, SEPARATOR, END, HASH = (1 << i for i in range(8))

    def __init__(self):
        self.flags: list[int] = []
        self.lower: list[int] = []  # number of the token in lower case

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self.flags)
        low = w.lower()
        self.lower.append(n)
        if w in _SEPARATORS:
            f = self.SEPARATOR
        elif w in _ENDS:
            f = self.END
        elif w == "#":
            f = self.HASH
        elif _UNSPACED.match(w):
            f = self.WORD | self.WIDE | self.FUNCTION * (w in MARKS)
        else:
            function = low in FUNCTION or "가" <= w[0] <= "힣" and len(w) > 1 and w.endswith(ENDINGS)
            f = self.WORD | self.FUNCTION * function | self.DIGIT * any(map(str.isdigit, w)) | self.CAPITAL * w[0].isupper()
        self.flags.append(f)
        if low != w:
            self.lower[n] = self[low]
        return n

    def trim(self) -> None:
        if len(self.flags) > self.MOST:
            self.clear()
            self.flags.clear()
            self.lower.clear()


_vocabulary = _Vocabulary()


def observe(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(codes, words) of each text: the binned measures of its units as one number each, and their words.

    A unit is a line, or a stretch of STRETCH words of a long one; lines without words make none. Two characters of a
    script without blanks count as a word. A null or wordless text has no unit."""
    v = _vocabulary
    v.trim()
    flat, held, page, link, item = [], [], [], [], []
    find = _TOKEN.findall
    for p, t in enumerate(texts):
        if not t:
            continue
        low = t.lower()
        linked = "http" in low or "www." in low or "](" in low or "href" in low
        for line in t.split("\n"):
            ts = find(line)
            if ts:
                flat += ts
                held.append(len(ts))
                page.append(p)
                link.append(sum(map(len, _LINK.findall(line))) / max(1, len(line.strip())) if linked else 0.0)
                item.append(_ITEM.match(line) is not None)
    none = [np.zeros(0, np.int64) for _ in texts], [np.zeros(0) for _ in texts]
    ids = np.fromiter(map(v.__getitem__, flat), dtype=np.int64, count=len(flat))
    flags = np.array(v.flags, dtype=np.int64)[ids] if flat else ids
    has = lambda f: (flags & f) != 0
    weight = np.where(has(v.WIDE), 0.5, 1.0) * has(v.WORD)
    held = np.array(held, dtype=np.int64)
    line = np.repeat(np.arange(len(held)), held)
    total = np.bincount(line, weight, len(held))
    if not total.any():
        return none
    # units: the stretches of the lines that hold words, numbered on; a mark goes with the word before it
    said = np.cumsum(weight)
    said -= np.repeat(np.concatenate([[0.0], said[np.cumsum(held)[:-1] - 1]]), held)
    stretch = np.where(total[line] > 2 * STRETCH, np.floor(np.maximum(said - 0.5, 0) / STRETCH), 0).astype(np.int64)
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (stretch[1:] != stretch[:-1])
    mark_unit = np.cumsum(new) - 1
    whole = np.bincount(mark_unit, weight)
    number = np.cumsum(whole > 0) - 1  # wordless lines fall out
    kept = whole[mark_unit] > 0
    of = lambda f: np.bincount(number[mark_unit[kept]], has(f)[kept].astype(float), count)
    count = int(number[-1]) + 1
    words = whole[whole > 0]
    own_line = line[new][whole > 0]
    head_of_line = np.ones(count, dtype=bool)
    head_of_line[1:] = own_line[1:] != own_line[:-1]
    page, link = np.array(page)[own_line], np.array(link)[own_line]
    per = np.bincount(page, minlength=len(texts))
    seps, ends, tags, function, digits, capitals = (of(f) for f in (v.SEPARATOR, v.END, v.HASH, v.FUNCTION, v.DIGIT, v.CAPITAL))
    wide_words = of(v.WIDE)

    # from here on words only
    is_word = has(v.WORD)
    unit, wide = number[mark_unit[is_word]], has(v.WIDE)[is_word]
    lower = np.array(v.lower, dtype=np.int64)[ids[is_word]]
    size = np.bincount(unit, minlength=count)
    first = np.cumsum(size) - size
    items = (np.array(item)[own_line] & head_of_line & (size > 1)).astype(np.int64)

    # runs of two words, or of three characters, that come again within NEAR units; a list's number is none of its words
    n = len(lower)
    spoken = np.ones(n, dtype=bool)
    spoken[first[items == 1]] = False
    nxt, two = np.minimum(np.arange(n) + 1, n - 1), np.minimum(np.arange(n) + 2, n - 1)
    same, far = (unit[nxt] == unit) & (nxt > np.arange(n)), (unit[two] == unit) & (two > nxt)
    three = wide & far & wide[nxt]
    run = same & spoken & (three | ~(wide & wide[nxt]))
    alone = spoken & (size[unit] - items[unit] == 1)  # a unit of one word is a run of its own
    key = (lower * 0x9E3779B1 + np.where(alone, 1, lower[nxt] + 2)) * 0x85EBCA6B + np.where(three, lower[two] + 1, 0)
    at = np.flatnonzero(run | alone)
    order = at[np.lexsort((at, key[at], page[unit[at]]))]
    a, b = order[:-1], order[1:]
    again = (key[a] == key[b]) & (page[unit[a]] == page[unit[b]]) & (unit[b] - unit[a] <= NEAR)
    own = unit[a] == unit[b]
    runs = np.maximum(np.bincount(unit[at], minlength=count), 1)
    said = []
    for which in (again & own, again & ~own):
        hit = np.zeros(n)
        hit[a[which]] = 1
        hit[b[which]] = 1
        said.append(np.bincount(unit, hit, count) / runs)

    # how often the run said most often is said in a unit, from three times on
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[a] != key[b]) | (unit[a] != unit[b])
    group = np.cumsum(new) - 1
    most = np.zeros(count)
    np.maximum.at(most, unit[order], np.bincount(group)[group] if len(order) else 0)

    # how many units of the page begin alike
    begin = np.minimum(first + items, n - 1)
    head = key[begin] * 4 + 1
    pair = np.lexsort((head, page))
    new = np.ones(count, dtype=bool)
    new[1:] = (head[pair][1:] != head[pair][:-1]) | (page[pair][1:] != page[pair][:-1])
    group = np.cumsum(new) - 1
    alike = np.zeros(count)
    alike[pair] = np.bincount(group)[group]
    heads = np.where((alike >= 3) & (per[page] >= 4), alike / per[page], 0.0)

    values = {
        "link": link,
        "hashtag": tags / words,
        "function": function / words,
        "end": ends,
        "within": said[0],
        "near": said[1],
        "dense": np.where(most > 2, most / words, 0.0),
        "piece": words / (1 + seps),
        "marks": seps / words,
        "digit": digits / words,
        "capital": capitals / np.maximum(size - wide_words - digits, 1),
        "head": heads,
        "words": words,
    }
    code = np.zeros(count, dtype=np.int64)
    for f, bins in BINS.items():
        code = code * (len(bins) + 1) + np.searchsorted(np.array(bins), values[f], side="left")
    cut = np.cumsum(per)[:-1]
    return np.split(code, cut), np.split(words, cut)


def _bins(codes: np.ndarray) -> np.ndarray:
    """Rows of the emission table of each code, one a measure."""
    out = np.empty((len(codes), len(SIZES)), dtype=np.int64)
    for k in range(len(SIZES) - 1, -1, -1):
        codes, out[:, k] = np.divmod(codes, SIZES[k])
    return out + AT


def _likelihood(codes: np.ndarray, log_emit: np.ndarray) -> np.ndarray:
    """Log probability of each unit in each state."""
    return log_emit[_bins(codes)].sum(1)


def _packs(sequences: list[np.ndarray]):
    """Sequences of like length together, (their places, codes, true where there is a unit)."""
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and len(sequences[order[j]]) * (j + 1 - i) <= CELLS:
            j += 1
        part = order[i:j]
        live = np.arange(len(sequences[part[-1]]))[None, :] < np.array([len(sequences[k]) for k in part])[:, None]
        codes = np.zeros(live.shape, dtype=np.int64)
        codes[live] = np.concatenate([sequences[k] for k in part])
        yield part, codes, live
        i = j


def expected_counts(sequences: list[np.ndarray], model) -> np.ndarray:
    """Expected starts, moves and bins by state of all sequences (one E-step), in one vector."""
    start, trans, emit = model
    k = len(start)
    starts, moves, seen, log_emit = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape), np.log(emit)
    for _, codes, live in _packs(sequences):
        n, size = codes.shape
        flat = _likelihood(codes[live], log_emit)
        like = np.ones((n, size, k))
        like[live] = np.exp(flat - flat.max(1, keepdims=True))
        a, scale = np.zeros((n, size, k)), np.ones((n, size))
        for t in range(size):
            x = (start if t == 0 else a[:, t - 1] @ trans) * like[:, t]
            scale[:, t] = np.where(live[:, t], x.sum(1), 1.0)
            a[:, t] = np.where(live[:, t, None], x / scale[:, t, None], a[:, t - 1] if t else x)
        b, g = np.ones((n, k)), np.zeros((n, size, k))
        for t in range(size - 1, -1, -1):
            if t < size - 1:
                w = like[:, t + 1] * b / scale[:, t + 1, None] * live[:, t + 1, None]
                moves += trans * (a[:, t].T @ w)
                b = np.where(live[:, t + 1, None], w @ trans.T, b)
            g[:, t] = a[:, t] * b * live[:, t, None]
        starts += g[:, 0].sum(0)
        bins, held = _bins(codes[live]), g[live]
        for f in range(bins.shape[1]):
            for s in range(k):
                seen[:, s] += np.bincount(bins[:, f], held[:, s], len(seen))
    return np.concatenate([starts, moves.ravel(), seen.ravel()])


def maximise(counts: np.ndarray):
    """The model of the expected counts; the starting values weigh as much as an average state's units, so that a state keeps its meaning."""
    start0, trans0, emit0 = starting_values()
    k = len(start0)
    starts, moves, seen = counts[:k], counts[k : k + k * k].reshape(k, k), counts[k + k * k :].reshape(emit0.shape)
    weight = max(50.0, seen[: SIZES[0]].sum() / k)
    start = starts + start0 * max(10.0, starts.sum() / k)
    trans = moves + trans0 * weight
    emit = seen + emit0 * weight
    for a, n in zip(AT, SIZES):
        emit[a : a + n] /= emit[a : a + n].sum(0)
    return start / start.sum(), trans / trans.sum(1, keepdims=True), emit


def viterbi(sequences: list[np.ndarray], model) -> list[np.ndarray]:
    """The most probable states of each sequence."""
    start, trans, emit = (np.log(x) for x in model)
    out = [np.zeros(0, dtype=np.int64)] * len(sequences)
    for part, codes, live in _packs(sequences):
        n, size = codes.shape
        like = np.zeros((n, size, len(start)))
        like[live] = _likelihood(codes[live], emit)
        best, back = start + like[:, 0], np.zeros((n, size, len(start)), dtype=np.int8)
        for t in range(1, size):
            ways = best[:, :, None] + trans
            at = ways.argmax(1)
            on = live[:, t, None]
            back[:, t] = np.where(on, at, np.arange(len(start)))  # after the end nothing moves
            best = np.where(on, np.take_along_axis(ways, at[:, None, :], 1)[:, 0] + like[:, t], best)
        path = np.empty((n, size), dtype=np.int64)
        path[:, -1] = best.argmax(1)
        for t in range(size - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        for i, p, on in zip(part, path, live):
            out[i] = p[on]
    return out


def label_words(codes: list[np.ndarray], words: list[np.ndarray], model) -> np.ndarray:
    """Words of each text by label, a row a text."""
    paths = viterbi(codes, model)
    return np.array([np.bincount(LABEL_OF[p], w, len(LABELS)) for p, w in zip(paths, words)]).reshape(len(codes), len(LABELS))


def observed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, o): the measured units of every text, two numbers a unit, written to the shared folder; texts are read once."""

    @F.arrow_udf("struct<c:array<int>,w:array<float>>")
    def measure(texts: pa.Array) -> pa.Array:
        codes, words = [], []
        rows = texts.to_pylist()
        for i in range(0, len(rows), 1000):
            c, w = observe(rows[i : i + 1000])
            codes += c
            words += w
        at = pa.array(np.cumsum([0, *map(len, codes)]), type=pa.int32())
        flat = lambda x, t: pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.zeros(0), type=t))
        return pa.StructArray.from_arrays([flat([c.astype(np.int32) for c in codes], pa.int32()), flat([w.astype(np.float32) for w in words], pa.float32())], names=["c", "w"])

    return checkpoint(docs.select(F.col(key), measure(text).alias("o")))


def _sequences(batch) -> list[np.ndarray]:
    return np.split(batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()[1:-1]) if len(batch) else []


def fit_lines(seen: DataFrame, rounds: int = ROUNDS):
    """(start, transition, emission) fitted on all units of `observed`; only sums of a fixed number of counts reach the driver."""
    model = starting_values()

    def step(batches):
        total = None
        for b in batches:
            for i in range(0, b.num_rows, 10_000):
                got = expected_counts(_sequences(pa.concat_arrays([b.column(0).slice(i, 10_000)])), model)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    for _ in range(rounds):
        rows = seen.select("o.c").mapInArrow(step, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not rows:
            break
        counts = np.zeros(len(rows))
        for i, x in rows:
            counts[i] = x
        model = maximise(counts)
    return model


def line_shares(docs: DataFrame, text: str = "text", key: str = "doc_id", model=None) -> DataFrame:
    """(key, words, prose, links, tags, menu): the words of each text and those in units of each label.

    Null, empty and wordless texts have 0 of all. Other columns are left out; repeated and null keys are rows of their own."""
    seen = observed(docs, text, key)
    model = model or fit_lines(seen)

    @F.arrow_udf("struct<words:int,prose:int,links:int,tags:int,menu:int>")
    def shares(c: pa.Array, w: pa.Array) -> pa.Array:
        held = np.ceil(label_words(_sequences(c), _sequences(w), model)).astype(np.int32) if len(c) else np.zeros((0, len(LABELS)), np.int32)
        cols = [held.sum(1), *held.T]
        return pa.StructArray.from_arrays([pa.array(x, type=pa.int32()) for x in cols], names=["words", *LABELS])

    return seen.select(F.col(key), shares(F.col("o.c"), F.col("o.w")).alias("s")).select(key, "s.*")


def spam_pages(docs: DataFrame, text: str = "text", key: str = "doc_id", share: float = SHARE) -> DataFrame:
    """(key, words, prose, links, tags, menu) of the pages whose words lie mostly in units that are not prose."""
    got = line_shares(docs.select(key, text), text, key)
    return got.where((F.col("words") > 0) & (F.col("words") - F.col("prose") > F.col("words") * share))
