"""Variant spellings of names linked to a catalogue by a pigeonhole segment join.

A name is split into its core, the rare words joined, and its common words (given names, lines of
business, kinds of place), told apart by how many catalogue entries share a word. Cores are
matched within k edits: a catalogue core is cut into k+1 segments, one of which must occur in any
variant, shifted by at most the edits around it. Hits are verified by banded edit distance, and the
common words must agree. A name all of whose words are common has no core: it is found by each word
beside the beginning or end of another. A text is linked to the one entity of least cost, or to none.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skewed_join
from ..session import checkpoint
from .lookalikes import LOOKALIKES

COMMON_SHARE, COMMON_LEAST = 0.001, 5  # a word of this share of all entities is common; so a few thousand words are
EDITS = 2
# Words before a person's name, articles, and legal forms.
TITLES = frozenset("mr mrs ms miss dr prof sir gen general adm admiral capt captain col colonel lt lieutenant maj major sgt cdr commander hon rev sen senator rep minister president secretary ambassador governor mayor judge king queen lord lady director chairman the a of".split())
# Short given names that a table of short forms may lack.
NICKNAMES = {"ted": ("edward", "theodore"), "meg": ("margaret",), "maggie": ("margaret",), "jack": ("john", "jonathan"), "dick": ("richard",), "hank": ("henry",), "lena": ("helena",), "kate": ("katherine",), "bob": ("robert",), "bill": ("william",), "nell": ("eleanor",), "chuck": ("charles",)}
LEGAL = frozenset("corporation corp limited ltd holdings hldgs hldg company co group gp grp international intl incorporated inc agency agcy plc llc gmbh sa ag".split())

_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z])")
_TOKEN = re.compile(r"[^\W_]+")
_LIKE = str.maketrans(LOOKALIKES)


def plain(text: str) -> str:
    """Look-alikes, ignorables and compatibility forms of one string made plain; words truly of another script stay."""
    if text.isascii():
        return text
    text = "".join(" " if unicodedata.category(c) == "Zs" else c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf" and c != "͏")
    out = []
    for w in re.split(r"(\W+)", text):
        if w and not w.isascii():
            like = w.translate(_LIKE)
            # all letters have a Latin double, and one of them is Latin or the rest of the text is
            if all(unicodedata.name(c, "").startswith("LATIN") or not c.isalpha() for c in unicodedata.normalize("NFD", like) if not unicodedata.combining(c)):
                w = like if re.search(r"[A-Za-z]", w) or not re.search(r"[гкмнтв]", w) else w
        out.append(w)
    return "".join(out)


def words(text: str | None) -> list[str]:
    """Lower-case words without accents; joined-up capitals are split, apostrophes dropped."""
    if not text:
        return []
    t = _CAMEL.sub(" ", plain(text)).replace("'", "").replace("’", "")
    t = unicodedata.normalize("NFKC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))
    return _TOKEN.findall(t.lower())


def fold(core: str) -> str:
    """Letters that sound alike made one, double letters single."""
    core = core.replace("ph", "f").replace("c", "k").replace("q", "k").replace("y", "i").replace("w", "v")
    return re.sub(r"(.)\1+", r"\1", core)


def _near(a: str, b: str, k: int) -> bool:
    """Edit distance with transpositions of at most k, along the band."""
    if abs(len(a) - len(b)) > k:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [k + 1] * len(b)
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[-1] <= k


class Book:
    """The common words of the catalogue and what stands for them."""

    def __init__(self, common: frozenset[str], short: dict[str, set[str]]):
        self.common, self.short = common, short
        self.longest: int | None = None  # letters of the longest core that can be named
        self.known: dict[str, str | None] = {}
        self.by_first: dict[str, list[str]] = {}
        for w in common:
            if len(w) >= 4:
                self.by_first.setdefault(w[0], []).append(w)
                if w[1] != w[0]:
                    self.by_first.setdefault(w[1], []).append(w)

    def is_common(self, w: str) -> bool:
        return w in self.common or w in self.short or w in TITLES or w in LEGAL or w.isdigit() or len(w) == 1 and w.isascii()

    def repaired(self, w: str) -> str | None:
        """The common word that w is a misspelling of."""
        if len(w) < 4 or not w.isascii():
            return None
        if w not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            found = None
            for c in self.by_first.get(w[0], []) + self.by_first.get(w[1], []):
                if _near(w, c, 1 if len(c) < 8 else 2):
                    found = c
                    break
            self.known[w] = found
        return self.known[w]

    def variants(self, text: str | None) -> list[tuple[str, list[str]]]:
        """(folded core, common words) of a text: as it stands, with misspelt common words, with one long word as the core.

        A core that no edits bring within reach of the longest one known names nothing and is left out."""
        ws = words(text)
        rare = [w for w in ws if not self.is_common(w)]
        if not rare:
            return [(k, ws) for k in self.whole(ws, ws, False)]
        found = {}
        letters = sum(map(len, rare))

        def add(core: list[str], rest: list[str]) -> None:
            c = fold("".join(core))
            if self.longest is not None and len(c) > self.longest + EDITS:
                return
            if len(c) >= 3 or len(c) == 2 and not c.isascii():
                found.setdefault((c, tuple(sorted(rest))), None)

        rest = [w for w in ws if self.is_common(w)]
        add(rare, rest)
        fixed = {w: r for w in rare if (r := self.repaired(w))}
        if fixed and len(fixed) < len(rare):
            add([w for w in rare if w not in fixed], rest + list(fixed.values()))
        whole = [w if self.is_common(w) else fixed.get(w) or self.short_for(w) for w in ws]
        if all(whole):
            found |= {(k, tuple(ws)): None for k in self.whole(ws, whole, False)}
        if len(rare) > 1:
            scripts = {w.isascii() for w in rare}
            if len(scripts) > 1:
                for s in scripts:
                    add([w for w in rare if w.isascii() == s], rest)
            long = max(rare, key=len)
            if len(long) >= 7:
                add([long], rest + [w for w in rare if w != long])
            if len(rare) > 2:
                add(rare[1:], rest + rare[:1])
                add(rare[:-1], rest + rare[-1:])
            for w in rare:  # an abbreviated common word beside the core; folding at most halves what is left
                if self.longest is not None and letters - len(w) > 2 * (self.longest + EDITS):
                    continue
                if self.short_for(w):
                    add([x for x in rare if x != w], rest + [w])
        return [(c, list(r)) for c, r in found]

    def short_for(self, w: str) -> str | None:
        """The initial of w if it may abbreviate a common word."""
        return w[0] if len(w) <= 5 and any(self.stands(w, c) for c in self.by_first.get(w[0], [])) else None

    def whole(self, ws: list[str], stand: list[str], form: bool) -> list[str]:
        """Keys, which begin with a blank, of a name without rare words; stand: the common words or initials that its words stand for.

        All words of a text but titles and legal forms must be in a form that it names. So a text has keys of each word and its
        neighbour, and a form those of all pairs; a word is known by its full forms too, its fellow by its first or last letters."""
        if not ws:
            return []
        less = [w for w in stand if w not in TITLES and w not in LEGAL and not any(x in LEGAL for x in self.short.get(w, ()))] or stand
        fulls = [{w} | self.short.get(w, set()) for w in less]
        out = set()
        if form or len(less) == 1:
            out |= {f" {x}" for xs in fulls for x in xs}
        for i, xs in enumerate(fulls):
            for j in range(len(fulls)) if form else [i - 1]:
                if i != j:
                    ends = {e for y in fulls[j] for e in ([y[:1], y[:3], "~" + y[-3:]] if form else [y] if len(y) == 1 else [y[:3], "~" + y[-3:]])}
                    out |= {f" {x} {e}" for x in xs for e in ends if form or len(x) > 1}
        if len(less) > 1 and all(len(w) == 1 for w in less):  # initials alone
            out.add(" " + " ".join(sorted(less)))
        return list(out)

    def stands(self, m: str, e: str) -> bool:
        """m is an abbreviation of e: begins alike, its letters in order."""
        if m[0] != e[0] or len(m) < 2 or len(m) > len(e) - 2:
            return False
        at = iter(e)
        return all(c in at for c in m)

    def agrees(self, m: str, e: str, person: bool) -> int:
        """Cost of word m naming word e; -1: it does not."""
        if m == e:
            return 0
        if e in self.short.get(m, ()) or m in self.short.get(e, ()):
            return 1
        if len(m) == 1 or len(e) == 1:
            return 2 if person and m[0] == e[0] and not m.isdigit() and not e.isdigit() else -1
        if m.isdigit() or e.isdigit():
            return -1
        both = self.short.get(m, set()) & self.short.get(e, set())
        if both:
            return 1
        if person and (len(m) >= 3 and e.startswith(m) or len(e) >= 3 and m.startswith(e) or len(m) >= 4 and e.endswith(m) or len(m) >= 4 and m[:3] == e[:3] and len(m) < len(e) - 2):
            return 2
        if m not in self.common and self.stands(m, e) and not person:
            return 2
        if not (m in self.common and e in self.common) and (len(m) >= 4 or person and len(m) == 3 and len(e) == 4) and _near(m, e, 1 if len(e) < 8 else 2):
            return 2
        return -1

    def cost(self, m: list[str], e: list[str], person: bool, foreign: bool = False) -> int:
        """Cost of the common words m of a text for those of a catalogue form e; -1: they name somebody else.

        A foreign core is a name in another script, which stands beside common words that its form lacks."""
        left, cost, given = list(e), 0, False
        odd = []
        for w in sorted(m, key=len, reverse=True):
            best, at = -1, -1
            for i, x in enumerate(left):
                c = self.agrees(w, x, person)
                if c >= 0 and (best < 0 or c < best):
                    best, at = c, i
            if at >= 0:
                cost += best
                given = given or person and left[at] not in TITLES
                left.pop(at)
            elif w not in TITLES:
                odd.append(w)
        for w in odd:
            if w in LEGAL or any(x in LEGAL for x in self.short.get(w, ())):
                cost += 3 if any(x in LEGAL for x in left) else 2
            elif foreign and not e and not w.isdigit():
                cost += 2
            elif len(w) == 1 and (given or not person):
                cost += 1 if given else 100
            elif w.isdigit() and not any(x.isdigit() for x in e) and (foreign or not person):
                cost += 2
            else:
                return -1
        # what the text leaves out: how much doesn't matter, so a bare core names two entities of that core alike
        left = [x for x in left if x not in TITLES and not (person and len(x) == 1)]
        cost += 3 if any(x not in LEGAL for x in left) else 1 if left else 0
        return cost if cost < 100 else -1


def allowed(n: int, ascii_: bool) -> int:
    """Edits that a core of n letters may differ by."""
    return 0 if n <= 4 or not ascii_ and n <= 5 else 1 if n <= 6 else EDITS


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k+1 segments of a core of n letters."""
    small, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = small + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def _key(n: int, i: int, s: str) -> int:
    h = xxhash.xxh64_intdigest(f"{n}.{i}.{s}")
    return h - (1 << 64) if h >= 1 << 63 else h


def index_keys(core: str) -> list[int]:
    k = allowed(len(core), core.isascii())
    return [_key(len(core), i, core[a : a + n]) for i, (a, n) in enumerate(segments(len(core), k))] if k else []


def probe_keys(core: str) -> list[int]:
    """Keys of the substrings of core that a catalogue core within reach would share as a segment."""
    m, out = len(core), set()
    for n in range(max(1, m - EDITS), m + EDITS + 1):
        k = allowed(n, core.isascii())
        if not k or abs(m - n) > k:
            continue
        d = m - n
        for i, (a, size) in enumerate(segments(n, k)):
            # edits left of the segment are at most i, right of it at most k-i
            for p in range(max(0, a - i, a + d - (k - i)), min(m - size, a + i, a + d + (k - i)) + 1):
                out.add(_key(n, i, core[p : p + size]))
    return list(out)


def common_words(forms: DataFrame) -> frozenset[str]:
    """The words that many entities of (id, form) share; their number is bounded by the share and the length of names."""
    def tokens(batches):
        for pdf in batches:
            rows = [(i, w) for i, f in zip(pdf["id"], pdf["form"]) for w in set(words(f))]
            yield pd.DataFrame(rows, columns=["id", "w"])

    n = forms.select("id").distinct().count()
    seen = forms.mapInPandas(tokens, "id string, w string").distinct().groupBy("w").count()
    rows = seen.where((F.col("count") >= max(COMMON_LEAST, COMMON_SHARE * n)) & (F.length("w") > 1)).select("w").collect()
    return frozenset(r[0] for r in rows if not r[0].isdigit())


def link_names(mentions: DataFrame, entities: DataFrame, short_names: DataFrame, key: str = "mention_id", text: str = "text") -> DataFrame:
    """(key, id): the entity that each text names by a name or alias of any of its records, in any variant spelling.

    Texts that name nobody, or several entities equally well, have no row; nor have null and blank
    texts. Null ids and names are passed over. Repeated keys are linked row by row."""
    forms = checkpoint(
        entities.where(F.col("id").isNotNull())
        .select("id", (F.col("entity_type") == "person").alias("person"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
        .where(F.trim("form") != "")
        .groupBy("id", "form").agg(F.max(F.coalesce("person", F.lit(False))).alias("person"))
    )
    short: dict[str, set[str]] = {}
    for full, s in short_names.select("full_form", "short_form").collect():  # reference data, as a whole in memory
        if full and s:
            short.setdefault("".join(words(s)), set()).add("".join(words(full)))
    for s, full in NICKNAMES.items():
        short.setdefault(s, set()).update(full)
    book = Book(common_words(forms), short)

    def parse_forms(batches):
        for pdf in batches:
            rows = []
            for i, person, f in zip(pdf["id"], pdf["person"], pdf["form"]):
                ws = words(f)
                core = fold("".join(w for w in ws if not book.is_common(w)))
                if core:
                    rows.append((core, i, bool(person), [w for w in ws if book.is_common(w)]))
                fixed = {w: r for w in ws if not book.is_common(w) and (r := book.repaired(w))}
                if all(book.is_common(w) or w in fixed for w in ws):
                    rows += [(k, i, bool(person), ws) for k in book.whole(ws, [fixed.get(w, w) for w in ws], True)]
                if fixed and (c2 := fold("".join(w for w in ws if not book.is_common(w) and w not in fixed))):
                    rows.append((c2, i, bool(person), [fixed.get(w, w) for w in ws if book.is_common(w) or w in fixed]))
            yield pd.DataFrame(rows, columns=["core", "id", "person", "e"])

    def parse_texts(batches):
        for pdf in batches:
            rows = [(h, c, list(rest)) for h, t in zip(pdf["h"], pdf["t"]) for c, rest in book.variants(t)]
            yield pd.DataFrame(rows, columns=["h", "core", "m"])

    catalogue = checkpoint(forms.mapInPandas(parse_forms, "core string, id string, person boolean, e array<string>").distinct())
    book.longest = catalogue.where("core NOT LIKE ' %'").agg(F.max(F.length("core"))).head()[0] or 0
    rows = mentions.where(F.trim(text) != "").select(F.col(key), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    texts = rows.select("h", "t").dropDuplicates(["h"])
    variants = checkpoint(texts.mapInPandas(parse_texts, "h long, core string, m array<string>"))

    # cores, each once, and the catalogue cores within reach of them
    cores = variants.select("core").distinct()
    named = catalogue.select("core").distinct()
    known, told = catalogue.count(), variants.count()

    def keys(make, side):
        def run(batches):
            for pdf in batches:
                out = [(k, c) for c in pdf["core"] for k in make(c)]
                yield pd.DataFrame(out, columns=["key", side])

        return run

    cut = lambda c: c.where("core NOT LIKE ' %'")
    probes = cut(cores).mapInPandas(keys(probe_keys, "core"), "key long, core string")
    index = cut(named).mapInPandas(keys(index_keys, "form"), "key long, form string")
    near = F.levenshtein("core", "form", EDITS)
    reach = F.when(F.length("form") <= 6, 1).otherwise(EDITS)
    indexed = (EDITS + 1) * known
    pairs = skewed_join(index, probes, "key", indexed).select("core", "form", near.alias("d")).where((F.col("d") >= 0) & (F.col("d") <= reach))
    # one segment for no edits: the whole core, which also covers cores too short to be cut
    same = cores.join(named, "core", "left_semi").select("core", F.col("core").alias("form"), F.lit(0).alias("d"))
    pairs = checkpoint(pairs.where("d > 0").unionByName(same).distinct())

    @F.pandas_udf("int")
    def cost(m: pd.Series, e: pd.Series, person: pd.Series, core: pd.Series) -> pd.Series:
        return pd.Series([book.cost(list(a), list(b), bool(p), not c.isascii()) for a, b, p, c in zip(m, e, person, core)])

    # a surname that many entities bear, and one that many texts hold, are split
    meant = skewed_join(catalogue.withColumnRenamed("core", "form"), pairs, "form", known).drop("form")
    hits = skewed_join(variants, meant, "core", told)
    hits = hits.withColumn("c", cost("m", "e", "person", "core")).where("c >= 0").select("h", "id", (F.col("c") + 4 * F.col("d")).alias("c"))
    # the entity of least cost, if it is one alone
    best = hits.groupBy("h", "id").agg(F.min("c").alias("c")).groupBy("h").agg(
        F.min(F.struct("c", "id")).alias("lo"), F.max(F.struct((-F.col("c")).alias("c"), F.col("id").alias("id"))).alias("hi")
    )
    best = best.where(F.col("lo.id") == F.col("hi.id")).select("h", F.col("lo.id").alias("id"))
    return rows.select(key, "h").join(best, "h").select(key, "id")
