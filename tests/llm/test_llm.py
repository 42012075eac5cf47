"""Corpus operators: against brute force, exact round trips and the library on small inputs with nulls, ties and repeats."""

import itertools
import os
import random
import re
import unicodedata
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm import bpe, lookalikes, name_links, near_copies, neighbours, packing, spam, survivors, tokens, truth

TOK = tokens.rank_file()


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(TOK.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


# -- tokens ---------------------------------------------------------------------
def test_encoder_equals_library(library):
    e, rng = bpe.load(TOK), random.Random(1)
    odd = [chr(c) for c in [*range(127), 0x85, 0xA0, 0x2028, 0x3000, 0x200B, 0xB2, 0xBD, 0x2167, 0x4E00, 0xE9, 0x301, 0x660, 0x1F600, 0xAD]]
    texts = ["", " ", "a" * 3000, " " * 2000 + "x", "ab" * 900, "中文" * 400, "<|endoftext|>", "a\n \nb", "it's  we'll\t\n x"]
    texts += ["".join(rng.choices(odd, k=rng.randint(1, 60))) for _ in range(600)] + ["".join(rng.choices("etaoinshrdlu", k=2500))]
    for t in texts:
        assert e.encode(t) == library(t), repr(t[:50])
        assert e.decode(e.encode(t)) == t
    assert e.encode(None) == []


def test_texts_in_pieces_of_any_size(library):
    """Fed in pieces, a text gives the same ids, whatever runs of characters it holds, and little of it is held back."""
    e = bpe.load(TOK)
    assert 1 < e.lookahead <= max(map(len, e.ranks))
    rnd = random.Random(5)
    parts = ["a", "b", "é", "中", " ", "  ", "\n", "\t", "'re", "'r", "'", "'ll", "1", "!", "_", "\x1c", "word", "🙂"]
    texts = ["".join(rnd.choices(parts if i % 3 else rnd.sample(parts, 2), k=rnd.choice([3, 40, 3000]))) for i in range(200)]
    texts += ["a" * 20_000, " " * 9_000, "x" + " \n" * 5_000 + "y", "!" * 7_000 + "'re", "ab" * 9_000 + "'ll"]
    for x in texts:
        t, out, at, held = bpe.Text(e), b"", 0, 0
        while at < len(x):
            n = rnd.choice([1, 2, 50, 700])
            out += t.feed(x[at : at + n])
            at += n
            held = max(held, len(t.rest) + (len(t.open.data) if t.open else 0))
        assert list(memoryview(out + t.finish()).cast("i")) == library(x)
        assert held < 2 * bpe.HELD + 700


def test_stream_gives_the_same_whatever_the_pieces():
    e, rng = bpe.load(TOK), random.Random(2)
    for _ in range(20):
        word = "".join(rng.choices("abehilnorst", k=700)).encode()
        s, out, at = bpe.Stream(e), [], 0
        while at < len(word):
            n = rng.randint(1, 90)
            out += s.feed(word[at : at + n])
            assert len(s.data) <= 6 * e.lookahead  # constant memory
            at += n
        assert [x for x in out + s.finish()] == [e.ranks[x] for x in e.merge(word)]


def test_decoder_in_pieces():
    e = bpe.load(TOK)
    d, ids = bpe.Decoder(e), e.encode("naïve 東京 👍")
    assert "".join(d.feed([i]) for i in ids) + d.finish() == "naïve 東京 👍"


def test_corpus(spark):
    df = spark.createDataFrame([(1, "Port of call", "x"), (2, "", "y"), (3, None, None)], "doc_id int, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) == 3
    assert tokens.encode_corpus(df.where("false")).count() == 0
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df).drop("text")).collect()}
    assert back == {1: "Port of call", 2: "", 3: ""}


# -- packing ---------------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 30, 250, 700, 1100, 2048, 5000, 0])) for i in range(3000)] + [(None, 7), (5, 9), (9999, None), (9998, -4)]
    df = spark.createDataFrame(rows, "doc_id int, n int")
    got = packing.pack_documents(df, "doc_id", "n", bucket=1000).collect()
    used: dict[int, int] = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
    want = sorted(itertools.chain.from_iterable([min(2048, n - p * 2048) for p in range(max(1, -(-n // 2048)))] for n in (max(x or 0, 0) for _, x in rows)))
    assert sorted(r.n_tokens for r in got) == want and max(used.values()) <= 2048
    assert sum(want) / (2048 * len(used)) > 0.97
    assert packing.pack_documents(df.where("false"), "doc_id", "n").count() == 0
    assert packing.fill_report(packing.pack_documents(df.where("false"), "doc_id", "n")).head().containers == 0


def test_packing_does_not_depend_on_splits(spark):
    """Equal rows are spread, a long document counts by its pieces, and other splits of the rows change nothing."""
    rows = [(1, 700)] * 3000 + [(i, 100 + i % 900) for i in range(1000)] + [(5000, 2048 * 900 + 3), (None, 10), (None, 10)]
    df = spark.createDataFrame(rows, "k int, n int")
    with mock.patch.object(packing, "RUN", 64):
        a = packing.pack_documents(df, "k", "n", bucket=500).collect()
        b = packing.pack_documents(df.repartition(7), "k", "n", bucket=500).collect()
    order = lambda rows: sorted(map(str, rows))
    assert order(a) == order(b) and len(a) == 3000 + 1000 + 901 + 2
    used, pieces = {}, {}
    for r in a:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        pieces[r.container >> 32] = pieces.get(r.container >> 32, 0) + 1
    assert max(used.values()) <= 2048 and max(pieces.values()) < 2 * 500


def test_classes_hold_their_number():
    box = packing.pack(np.array([500] * 9), 1024)
    assert max(np.bincount(box)) == 2 and len(set(box)) == 5


# -- look-alikes --------------------------------------------------------------------
CASES = {
    "Ѕhisa": "Shisa", "рοrt": "port", "Хедимишога Aerospace": "Хедимишога Aerospace", "Ｍａｔｔ Ｆ．": "Matt F.", "a​b c": "ab c", "ju﻿̈͏rgen": "jürgen",
    "Airﬁeld": "Airfield", "José": "José", "José": "José", "министерство": "министерство", "Кокрук": "Кокрук", "台积电": "台积电", "‍": "", "ộ": "ộ", "ộ": "ộ",
    "Ме́kra": "Mékra", "x̣̂y": "x̣̂y", "": "", "plain": "plain",
}


def test_consistent_forms(spark):
    rows = [(i, k, "z") for i, k in enumerate(CASES)] + [(99, None, "z"), (0, next(iter(CASES)), "z")]
    df = spark.createDataFrame(rows, "id int, text string, canonical string")
    got = lookalikes.consistent_columns(df, ["text"])
    assert got.columns == df.columns and got.count() == len(rows)
    assert {r.id: r.text for r in got.collect()} == {**dict(enumerate(CASES.values())), 99: None}
    hits = {r.id for r in lookalikes.disguised(df, "id", ["text"]).collect()}
    assert hits == {i for i, (a, b) in enumerate(CASES.items()) if a != b}
    assert lookalikes.disguised(df.where("false"), "id", ["text"]).count() == 0


def test_recomposition_is_nfc(spark):
    rng = random.Random(4)
    marks = [chr(c) for c in (0x301, 0x302, 0x323, 0x308, 0x327, 0x30A, 0x31B)]
    texts = {"".join(rng.choice("aeoucnxz") + "".join(rng.choices(marks, k=rng.randint(0, 3))) for _ in range(4)) for _ in range(150)}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = lookalikes.consistent_columns(df.withColumn("given", F.col("text")), ["text"])
    assert all(r.text == unicodedata.normalize("NFC", r.given) for r in got.collect())


# -- survivors ----------------------------------------------------------------------
REC = "id string, record_no long, source string, confidence double, created_at timestamp, description string, name string, canonical_name string, aliases array<string>, tags array<string>"


def test_survivors(spark):
    import datetime as dt

    day = lambda m: dt.datetime(2024, m, 1)
    rows = [
        ("a", 1, "osint", 0.5, day(1), "A long and useful text about it", "Acme", None, ["Ac"], ["x", "y"]),
        ("a", 2, " MANUAL", 85.0, day(3), "tbd", "Acme", None, None, ["x"]),
        ("a", 3, "manual", float("nan"), dt.datetime(1970, 1, 1), "Acme", "Acme", None, ["Ac"], ["x"]),
        ("a", 4, "wire_service", 0.9, day(2), "A  long and   useful text", "Acme", None, [" Ac "], None),
        ("b", 5, None, None, None, None, None, None, None, None),
        ("b", 6, "nobody", 2.0, dt.datetime(2027, 1, 1), "  ", None, None, None, None),
        ("c", 7, "manual", 0.5, day(1), "alone", "C", None, None, None),
        (None, 8, "manual", 0.5, day(1), "x", "C", None, None, None),
        (None, 9, "manual", 0.5, day(1), "x", "C", None, None, None),
    ]
    df = spark.createDataFrame(rows, REC)
    trust = spark.createDataFrame([("manual", 9), ("wire service", 6), ("osint", 4)], "source string, trust int")
    got = {(r.id, r.field_name): r.record_no for r in survivors.pick_fields(df, trust).collect()}
    assert got == {("a", "source"): 2, ("a", "confidence"): 4, ("a", "created_at"): 2, ("a", "description"): 1, ("b", "source"): 5}
    assert survivors.pick_fields(df.where("false"), trust).count() == 0
    full = {r.id: r for r in survivors.build_survivors(df, trust).collect()}
    assert full["a"].aliases == ["Ac"] and "x" in full["a"].tags and full["b"].source is None and full["a"].confidence == 0.9


def test_sources_that_agree_overrule_a_sign(spark):
    """A text like a stock phrase that several sources back by words of the entity's own says something; alone it doesn't."""
    rows, no = [], 0
    for i in range(200):
        for s in ("osint", "manual", "wire service", "registry")[: 3 + i % 2]:
            no += 1
            rows.append((f"e{i}", no, s, 0.5, None, f"the pump{i} plant near quay{i} of {s}", f"Name {i}", None, None, None))
        no += 1
        rows.append((f"e{i}", no, "forum", 0.5, None, "tbd", f"Name {i}", None, None, None))
    odd = "Error in pump5 of the plant near quay5"  # begins like an error message, tells of the entity
    rows.append(("e5", 9001, "forum", 0.5, None, odd, "Name 5", None, None, None))
    rows.append(("z", 9002, "forum", 0.5, None, "Error in some part", "Name z", None, None, None))
    rows.append(("z", 9003, "osint", 0.5, None, "Name z", "Name z", None, None, None))
    trust = spark.createDataFrame([("manual", 9), ("wire service", 6), ("osint", 4), ("registry", 3), ("forum", 1)], "source string, trust int")
    judged, rates = survivors.judge_descriptions(spark.createDataFrame(rows, REC), trust)
    got = {r.record_no: r.usable for r in judged.collect()}
    assert got[9001] and not got[9002] and not got[9003]
    assert all(got[r[1]] == (r[5] != "tbd") for r in rows[:-3])
    rate = {r.source: r for r in rates.collect()}
    assert rate["manual"].sensitivity > 0.8 > rate["forum"].sensitivity and rate["manual"].specificity > 0.8


def test_two_sided_truth_finds_bad_witnesses():
    rng = np.random.default_rng(5)
    true = rng.random(20000) < 0.5
    sens, spec = np.array([0.9, 0.8, 0.4]), np.array([0.95, 0.9, 0.6])
    said = np.where(true[:, None], rng.random((20000, 3)) < sens, rng.random((20000, 3)) >= spec)
    mask, n = np.unique((said * [1, 2, 4]).sum(1), return_counts=True)
    post, s, p, share = truth.fit(mask, np.full(len(mask), 7), n.astype(float), 3)
    assert np.abs(s - sens).max() < 0.1 and np.abs(p - spec).max() < 0.1 and abs(share - 0.5) < 0.1
    assert len(truth.fit(np.array([], dtype=int), np.array([], dtype=int), np.array([]), 3)[0]) == 0


# -- names -------------------------------------------------------------------------------
def test_pigeonhole_loses_nothing():
    rng = random.Random(6)
    for _ in range(2000):
        a = "".join(rng.choices("abcdr", k=rng.randint(5, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            at, kind = rng.randrange(len(b) + 1), rng.random()
            if kind < 0.4 and at < len(b):
                b[at] = rng.choice("abcdr")
            elif kind < 0.7:
                b.insert(at, rng.choice("abcdr"))
            elif at < len(b) and len(b) > 3:
                b.pop(at)
        b = "".join(b)
        k = name_links.allowed(len(a), True)
        if k and name_links._near(a, b, k) and abs(len(a) - len(b)) <= k and _distance(a, b) <= k:
            assert set(name_links.index_keys(a)) & set(name_links.probe_keys(b)), (a, b)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_links(spark):
    people = [("p%d" % i, "person", f"{g} {f}", None) for i, (g, f) in enumerate([("Victoria", "Sopalopaste"), ("Gregory", "Sopalopaste"), ("Edward", "Lekaribeshu")])]
    orgs = [("o1", "organization", "Jume Zinusa Satellite Holdings", ["Жумезинуса"]), ("o2", "organization", "Jume Zinusa Marine", None), ("l1", "location", "Port of Stateku Jano", None), (None, "person", "Null Person", None), ("n", "person", None, None)]
    filler = [(f"x{i}", "person", f"{g} {f}", None) for i, (g, f) in enumerate((g, f) for g in ("Victoria", "Gregory", "Edward") for f in ("Bonaventure", "Cadwallader", "Drummond", "Eglantine", "Fitzgerald", "Gathercole"))]
    filler += [(f"y{i}", "organization", f"{a} {b} {c}", None) for i, (a, b, c) in enumerate((a, b, c) for a in ("Kobaruti", "Mesolina", "Tifanoru") for b in ("Satellite", "Marine", "Shipping") for c in ("Holdings", "Limited"))]
    filler += [(f"z{i}", "location", f"Port of {a}", None) for i, a in enumerate(("Rumavo", "Kelisa", "Bodenu", "Fitako", "Lorume"))]
    e = spark.createDataFrame(people + orgs + filler, "id string, entity_type string, name string, aliases array<string>")
    short = spark.createDataFrame([("Holdings", "Hldgs", "word"), ("Edward", "Ned", "given_name"), (None, None, None)], "full_form string, short_form string, form_kind string")
    cases = [
        ("Victoria Sopalopaste", "p0"), ("SOPALOPASTE, VICTORIA", "p0"), ("V. Sopalopaste", "p0"), ("Vicky Sopalopsate", "p0"), ("Sopalopaste", None), ("Harold Sopalopaste", None), ("Ned Lekaribehsu", "p2"),
        ("Dr Edward Lek-aribeshu", "p2"), ("Jume Zynusa Satellite Hldgs", "o1"), ("JumeZinusa Marine", "o2"), ("Jume Zinusa", None), ("Jume Zinusa Shipping", None), ("Stateku Jano Port", "l1"), ("Жумезинуса", "o1"),
        ("Ѕtateku Ja​no Ｐｏｒｔ", "l1"), ("the vessel", None), ("", None), (None, None), ("   ", None), ("port", None), ("x" * 50_000, None), ("Victoria Sopalopaste", "p0"),
    ]
    m = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(cases)], "mention_id int, text string, id string")
    got = {r.mention_id: r.id for r in name_links.link_names(m, e, short).collect()}
    assert got == {i: x for i, (_, x) in enumerate(cases) if x}
    assert name_links.link_names(m.where("false"), e, short).count() == 0
    assert name_links.link_names(m, e.where("false"), short).count() == 0


def test_links_of_names_without_rare_words(spark):
    """A name of which many entities share every word is linked in every spelling; a text that several of them fit is not."""
    given, family = ("Victoria", "Gregory", "Edward", "Harold", "Miranda", "Leonard"), ("Bonaventure", "Cadwallader", "Drummond", "Eglantine", "Fitzgerald", "Gathercole")
    e = [(f"{g[0]}{f[0]}", "person", f"{g} {f}", None) for g in given for f in family]
    e += [(f"{a[0]}{b[0]}{c[0]}", "organization", f"{a} {b} {c}", None) for a in ("Northern", "Eastern", "United", "General", "Pacific") for b in ("Satellite", "Marine", "Shipping") for c in ("Holdings", "Limited")]
    e += [("s", "location", "United", None)]
    e = spark.createDataFrame(e, "id string, entity_type string, name string, aliases array<string>")
    short = spark.createDataFrame([("Holdings", "Hldgs", "word"), ("Edward", "Ned", "given_name")], "full_form string, short_form string, form_kind string")
    cases = [
        ("Victoria Drummond", "VD"), ("DRUMMOND, VICTORIA", "VD"), ("V. Drummond", "VD"), ("Dr Harold Fitzgerald", "HF"), ("Ned Eglantine", "EE"), ("Gregory Cadwalader", "GC"), ("Drummond", None), ("Walter Drummond", None),
        ("United Marine Hldgs", "UMH"), ("Pacific Shiping Limited", "PSL"), ("Pacific Shipping", None), ("United", "s"), ("Marine Satellite Limited", None), ("the", None),
    ]
    m = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "mention_id int, text string")
    got = {r.mention_id: r.id for r in name_links.link_names(m, e, short).collect()}
    assert got == {i: x for i, (_, x) in enumerate(cases) if x}


def test_links_of_long_names(spark):
    """Names of thirteen words and of five hundred are linked by a misspelt text like any other; a longer text names nobody by its parts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    names = {"n13": " ".join(word() for _ in range(13)), "n500": " ".join(word() for _ in range(500)), "n2": word() + " " + word()}
    e = spark.createDataFrame([(i, "organization", n, None) for i, n in names.items()] + [(f"x{i}", "organization", word(), None) for i in range(40)], "id string, entity_type string, name string, aliases array<string>")
    short = spark.createDataFrame([], "full_form string, short_form string, form_kind string")
    typo = lambda n: n[:9] + n[10:]
    m = [(i, t) for i, t in enumerate([names["n13"], typo(names["n13"]), names["n500"], typo(names["n500"]), names["n2"], " ".join(word() for _ in range(700))])]
    got = {r.mention_id: r.id for r in name_links.link_names(spark.createDataFrame(m, "mention_id int, text string"), e, short).collect()}
    assert got == {0: "n13", 1: "n13", 2: "n500", 3: "n500", 4: "n2"}


def test_links_of_a_surname_that_many_bear(spark):
    """A third of texts and entities share a core: hot keys are split and nothing is lost."""
    given = ["".join(c) for c in itertools.product("BDFGK", "aeiou", "lmnr", "aeiou", "s")]
    people = [(f"p{i}", "person", f"{g} Sopalopaste", None) for i, g in enumerate(given)]
    e = people + [(f"q{i}_{j}", "person", f"{g} {f}", None) for i, g in enumerate(given) for j, f in enumerate(("Lekaribeshu", "Tumanirofa"))]
    e = spark.createDataFrame(e, "id string, entity_type string, name string, aliases array<string>")
    short = spark.createDataFrame([], "full_form string, short_form string, form_kind string")
    m = spark.createDataFrame([(i, f"{g} Sopalopatse") for i, g in enumerate(given)], "mention_id int, text string")
    import tidegraph.operators.skew as skew

    want = {(i, f"p{i}") for i in range(len(given))}
    for heavy in (skew.HEAVY, 20):
        with mock.patch.object(skew.skewed_join, "__defaults__", (heavy,)):
            assert {tuple(r) for r in name_links.link_names(m, e, short).collect()} == want


# -- near copies ----------------------------------------------------------------------------
def _runs(a, b):
    w = re.findall(r"[^\W_]+", f"{a or ''} {b or ''}".lower())
    return set(zip(w, w[1:], w[2:]))


def test_near_copies(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=60)
        for k in (0, 0, 3, 8, 14):
            w = list(base)
            for at in rng.sample(range(60), k):
                w[at] = rng.choice(vocabulary)
            rows.append((len(rows), None if len(rows) % 9 == 0 else "Title", " ".join(w)))
    rows += [(1000 + i, None, None) for i in range(3)] + [(2000, "t", ""), (2001, "a", "b c"), (3000, "Title", rows[1][2]), (None, "n", rows[5][2])]
    df = spark.createDataFrame(rows, "k int, title string, content string").withColumn("cid", F.lit(1)).withColumn("words", F.lit(2))
    got = {(r.x, r.y) for r in near_copies.expand_pairs(*near_copies.near_copies(df.where("k is not null"), "k", ["title", "content"], 0.5, 3, 20, "content"), "k").collect()}
    sets = {k: _runs(t, c) for k, t, c in rows if k is not None and len(re.findall(r"[^\W_]+", (c or "").lower())) >= 20}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert not got - want and len(got & want) >= 0.98 * len(want)
    assert near_copies.near_copies(df.where("false"), "k", ["title"])[1].count() == 0


def test_large_classes_are_stars(spark):
    df = spark.createDataFrame([(i, "one two three four five six") for i in range(100)], "k int, t string")
    members, pairs = near_copies.near_copies(df, "k", ["t"], 0.8, 5)
    assert near_copies.expand_pairs(members, pairs, "k", expand=10).count() == 99
    got = near_copies.groups(members, pairs, "k")
    assert got.select("group_id").distinct().count() == 1 and got.count() == 100


def test_hot_band_keys_are_cut_into_blocks(spark):
    """Notices on one form share their band keys; in blocks the same pairs are found."""
    rng = random.Random(6)
    form = "the harbour office gives notice that the berth is closed to all traffic until the works on the quay are done and the pilots were told"
    docs = [(i, "", f"{form} {rng.choice('abcdefgh')}{rng.randint(0, 99)} {rng.randint(0, 999)}") for i in range(300)] + [(1000 + i, "", " ".join(rng.choices("kappa lima mike nova oscar papa quebec romeo".split(), k=30))) for i in range(60)]
    df = spark.createDataFrame(docs, "k int, t string, c string")
    got = []
    for together, sampled in ((near_copies.TOGETHER, near_copies.SAMPLED), (40, 1), (40, 8)):
        with mock.patch.multiple(near_copies, TOGETHER=together, SAMPLED=sampled):
            members, pairs = near_copies.near_copies(df, "k", ["t", "c"], 0.5, 3)
            got.append((members.count(), sorted((r.a, r.b) for r in pairs.collect())))
    assert got[0] == got[1] == got[2] and len(got[0][1]) > 30_000


def test_thresholds_rise():
    t = near_copies.thresholds(0.5)
    assert [n for n, _ in t] == [8, 16, 24, 32] and [m for _, m in t] == sorted(m for _, m in t)


# -- vectors -----------------------------------------------------------------------------------
def test_similar_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 16))
    x = (centres[rng.integers(0, 60, 3000)] + 0.35 * rng.standard_normal((3000, 16))).astype(np.float32)
    x[10:25] = x[9]  # copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0]), (9004, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (9005, [None] * 16)]
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.ArrayType(T.FloatType()))])
    df = spark.createDataFrame(rows + bad, schema)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = {(i, int(j)) for i, r in enumerate(s) for j in np.argsort(-r, kind="stable")[:10]}


    with mock.patch.object(neighbours, "PER_PART", 200):
        got = neighbours.similar_vectors(df, "k", "v", 10, size=16).collect()
    assert len(got) == 30000
    assert len({(r.k, r.neighbour) for r in got} & best) >= 0.9 * len(best)
    assert {r.neighbour for r in got if r.k == 24} == set(range(9, 19))
    assert neighbours.similar_vectors(df.where("false"), "k", "v", size=16).count() == 0
    assert neighbours.similar_vectors(df.where("k = 3"), "k", "v", size=16).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(9).standard_normal((500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = np.bincount(neighbours.balanced_parts(neighbours.neighbour_graph(x), 8))
    assert n.max() - n.min() <= 2


def test_leaves_are_split_and_measured(spark):
    """A hot leaf in blocks and groups of queries finds the same; at many leaves the measured number of them reaches the recall."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 16)).repeat(60, 0) + 0.5 * rng.standard_normal((2400, 16))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "k long, v array<float>")
    u = neighbours._unit(x.astype(np.float32))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i], kind="stable")[:10]}
    for change in ({"PER_PART": 40}, {"PER_PART": 40, "BLOCK": 15, "ASKED": 50}):
        with mock.patch.multiple(neighbours, **change):
            rows = neighbours.similar_vectors(df, "k", "v", 10, size=16, recall=0.95).collect()
        got = {(r.k, r.neighbour) for r in rows}
        assert len(rows) == len(got) and len(got & want) >= 0.92 * len(want)
    own = neighbours.usable_vectors(df, "k", "v", 16)
    with mock.patch.object(neighbours, "PER_PART", 40):
        router = neighbours.fit_parts(own, len(x), 16)
        take, held = neighbours.measured_leaves(own, len(x), router, 10, -1.0, 16, 0.95)
    assert router.parts * router.second == 64 and 1 < take < 64 and held >= 0.95
    order = router.leaves(u[:50], 64)
    assert all(len(set(o[o >= 0])) == (o >= 0).sum() for o in order)


# -- spam ------------------------------------------------------------------------------------------
SPAM = [
    "[crew visa](https://a.example/p)\n* [hull paint](http://b.test/x)\n* [dry pump](www.c.test/y.html)", "#BuyHullPaint #CheapDryPump #SaleLifeRaft #DealsVpnRouter", "top 10 ship loan, ship loan reviews, buy ship loan, ship loan deals, top 10 ship loan, cheap ship loan",
    "We love gps tracker because gps tracker is gps tracker. Every gps tracker needs a gps tracker supplier. Buy gps tracker online at gps tracker price.",
]
FINE = [
    "Traffic through the channel fell to 37 calls a day. No injuries were reported at the gulf.", "Persons listed under the order:\n1. Rido Shipping, subsidised fleet, since 2010\n2. Zune Materials, premium, since 2008",
    "NAVWARN 917/24 AREA BUSO SUROZE WAREHOUSE LEASE INSPECTED 1807Z. KEEP 2 NM CLEAR.", "Ada: Thank you. I ask again about the convoy.\nAda: Thank you. I ask again about the convoy.\nBob: The convoy was moved on the 3rd.",
    "wafer shipment: a refrigerated survey on the 12th of the month.\nradar sweep: a lease on the 9th of the month.", "港湾局はクレーンの点検を発表した。工場は契約を確認した。",
]


@pytest.fixture(scope="module")
def line_model():
    """Fitted on the larger test documents, without Spark."""
    pq = pytest.importorskip("pyarrow.parquet")
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    codes, _ = spam.observe(pq.read_table(path, columns=["text"])["text"].to_pylist())
    model = spam.starting_values()
    for _ in range(spam.ROUNDS):
        model = spam.maximise(spam.expected_counts(codes, model))
    return model


def test_spam(spark, line_model):
    texts = [*SPAM, *FINE, None, "", " \n ", "word " * 30_000]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id int, text string, words string")
    shares = {r.doc_id: r for r in spam.line_shares(df, model=line_model).collect()}
    flagged = {i for i, r in shares.items() if r.words and r.words - r.prose > r.words / 2}
    assert flagged == {*range(len(SPAM)), len(texts) - 1}
    assert shares[len(texts) - 1].words == 30_000
    assert all(shares[i].words == 0 for i in range(len(SPAM) + len(FINE), len(texts) - 1))
    assert spam.spam_pages(df.where("false")).count() == 0


def test_spam_tail_of_a_long_text(spark, line_model):
    prose = "Traffic through the channel fell to 37 calls a day, and no injuries were reported at the gulf.\n"
    tail = "buy hull paint | dry pump sale | buy hull paint | crew visa deals | dry pump sale\n"
    df = spark.createDataFrame([(0, prose * 200 + tail * 900), (1, prose * 900 + tail * 20)], "doc_id int, text string")
    got = {r.doc_id: r for r in spam.line_shares(df, model=line_model).collect()}
    assert got[0].tags == 900 * 15 and got[0].prose == 200 * 18
    assert got[1].tags == 20 * 15 and got[1].prose == 900 * 18


FOREIGN_SPAM = [
    "билеты на паром купить якорь купить якорь дешевый фрахт аренда контейнера дешевый фрахт билеты на паром аренда контейнера купить якорь дешевый фрахт",
    "купить якорь | аренда контейнера | страхование груза | билеты на паром | дешевый фрахт", "\n".join(["купить якорь", "дешевый фрахт", "аренда контейнера"] * 4),
    "锚链批发 | 集装箱租赁 | 锚链批发 | 货运保险报价 | 集装箱租赁 | 锚链批发 | 货运保险报价 | 集装箱租赁", "集装箱租赁锚链批发集装箱租赁货运保险报价锚链批发集装箱租赁货运保险报价锚链批发",
    "錨チェーン販売、中古コンテナ、フェリー予約、錨チェーン販売、中古コンテナ、フェリー予約、錨チェーン販売", "\n".join(["中古コンテナ", "フェリー予約", "錨チェーン販売"] * 4),
    "컨테이너 임대, 앵커 구매, 여객선 예약, 컨테이너 임대, 앵커 구매, 화물 보험, 컨테이너 임대, 앵커 구매", "앵커 구매 앵커 구매 화물 보험 컨테이너 임대 화물 보험 앵커 구매 컨테이너 임대 화물 보험",
    "Консорциум отверг ремонт кранов.\n" + "\n".join(["аренда контейнера", "кран б/у"] * 10),
]
FOREIGN_FINE = [
    "Консорциум отверг ремонт кранов из-за тумана. Консорциум отверг учения у залива. Экипаж отверг ремонт кранов после встречи.", "港务局推迟了洁净室停工，直至另行通知。港务局推迟了起重机检修，直至另行通知。船东推迟了起重机检修。",
    "港湾局は予告なしにクレーンの点検を延期した。港湾局は予告なしに航路の閉鎖を延期した。", "선주는 안개 때문에 항로 폐쇄를 연기했다. 항만 당국은 안개 때문에 크레인 점검을 연기했다.", "Повестка дня",
    "1. Порт Одесса, действует, с 2010\n2. Порт Мурманск, действует, с 2008\n3. Порт Владивосток, закрыт, с 2011\n4. Порт Выборг, действует, с 2012",
    "港务局推迟了洁净室停工，直至另行通知。船东拒绝与海事公司的合同，会议在港口举行。海岸警卫队确认起重机检修，原因是大雾。\n港口, 起重机, 合同, 大雾",
]


def test_spam_of_scripts_without_function_words(spark, line_model):
    df = spark.createDataFrame(list(enumerate(FOREIGN_SPAM + FOREIGN_FINE)), "doc_id int, text string")
    flagged = {r.doc_id for r in spam.line_shares(df, model=line_model).where("words - prose > words / 2").collect()}
    assert flagged == set(range(len(FOREIGN_SPAM)))


def test_fit_sums_over_all_documents(spark, line_model):
    """The distributed E-step gives the model of the plain one; states keep their meaning, and the order of lines counts."""
    texts = [*SPAM, *FINE, *FOREIGN_SPAM, *FOREIGN_FINE, None, ""] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    got = spam.fit_lines(spam.observed(df))
    codes, _ = spam.observe(texts)
    want = spam.starting_values()
    for _ in range(spam.ROUNDS):
        want = spam.maximise(spam.expected_counts(codes, want))
    for a, b in zip(got, want):
        assert np.allclose(a, b, atol=1e-9)
    start, trans, emit = line_model
    assert np.allclose([emit[a : a + n].sum(0) for a, n in zip(spam.AT, spam.SIZES)], 1) and np.allclose(trans.sum(1), 1) and np.isclose(start.sum(), 1)
    assert emit[spam.AT[0] + 3, spam.STATES.index("links")] > 0.5 and emit[spam.AT[1] + 2, spam.STATES.index("hashtags")] > 0.5
    # a line alone in its likeliest state isn't always what the model says of it among others
    lone = [np.log(emit)[spam._bins(c)].sum(1).argmax(1) for c in codes if len(c)]
    path = [p for p in spam.viterbi(codes, line_model) if len(p)]
    assert any((a != b).any() for a, b in zip(lone, path))


