"""The best matches found with inverted lists in memory are those of the joins."""

import random
from unittest import mock

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidegraph import catalog
from tidegraph.operators import blocks, graph, linking


def _both(run):
    """Rows of `run` in memory and by the join, as a way past the limit gives them."""
    found = sorted(map(tuple, run().collect()))
    with mock.patch.object(blocks, "MOST_HELD", -1):
        return found, sorted(map(tuple, run().collect()))


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(xs) for _ in range(rng.randint(1, 3)) for xs in (("b", "k", "ш", "r"), ("a", "o", "é")))
    return [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(160)] + ["a", "中", "b_c", "𝒳y z"]


def _near(found, joined):
    assert [r[:2] for r in found] == [r[:2] for r in joined] and [r[2:] for r in found] == [pytest.approx(r[2:], abs=2e-6) for r in joined]


def test_fuzzy_without_a_join_of_trigrams(spark, names):
    m = spark.createDataFrame([(i, t) for i, t in enumerate([*names[:60], *names[-4:], "", None, "?"])], "mention_id int, text string")
    forms = spark.createDataFrame([(f"e{i % 70}", n) for i, n in enumerate(names)], "id string, form string")
    for top in (3, 20):
        found, joined = _both(lambda: linking.fuzzy_candidates(m, forms, top=top))
        assert found == joined and len(found) > 100
    with mock.patch.object(linking, "skewed_join", side_effect=AssertionError):  # no pair of a trigram is written
        assert linking.fuzzy_candidates(m, forms).count() == len(found)
        assert linking.fuzzy_candidates(m, forms.where("false")).count() == 0


def test_fulltext_without_a_join_of_words(spark, names):
    m = spark.createDataFrame([(i, t) for i, t in enumerate([*names, "", None])], "mention_id int, text string")
    v = [(f"e{i}", n, None, [names[i // 2], None], " ".join(names[i : i + 3])) for i, n in enumerate(names)]
    v = spark.createDataFrame(v, "id string, name string, canonical_name string, aliases array<string>, description string")
    found, joined = _both(lambda: linking.fulltext_candidates(m, v, top=5))
    _near(found, joined)
    with mock.patch.object(linking, "skewed_join", side_effect=AssertionError):
        assert linking.fulltext_candidates(m, v, top=5).count() == len(found) > 100


def test_vectors_without_all_pairs(spark):
    rng = random.Random(5)
    vs = [[rng.choice((-1.0, 0.5, 2.0)) for _ in range(4)] for _ in range(90)] + [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan")] * 4, [1.0, 2.0]]
    e = spark.createDataFrame([(f"e{i:02}", v) for i, v in enumerate(vs)], "id string, v array<float>")
    q = spark.createDataFrame([(i, v) for i, v in enumerate([*vs[:20], *vs[-6:]])], "mention_id long, v array<float>")
    found, joined = _both(lambda: linking.vector_candidates(q, e, top=5, digits=6))
    assert found == joined and len(found) > 90
    with mock.patch.object(linking, "cosine", side_effect=AssertionError):  # no pair is compared row by row
        assert linking.vector_candidates(q, e, top=5, digits=6).count() == len(found)


def test_level_sizes_without_pairs_of_nodes(spark):
    rng = random.Random(6)
    adj = spark.createDataFrame([(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(200)], "src string, dst string")
    roots = spark.createDataFrame([(f"n{i}",) for i in range(150)] + [("none",)], "id string")
    found, joined = _both(lambda: graph.level_sizes(adj, roots, 4))
    assert found == joined and ("none", 0, 1) in found and max(r[1] for r in found) == 4
    with mock.patch.object(graph, "bfs", side_effect=AssertionError):
        assert graph.level_sizes(adj, roots, 4).count() == len(found)
    assert graph.level_sizes(adj.where("false"), roots, 4).count() == 151


def test_trees_of_paths_without_rows_of_steps(spark):
    """shortest_path_trees failed by disk at 0.1 GB: every level and every step of every path was written."""
    rng = random.Random(7)
    v = spark.createDataFrame([(f"n{i}", rng.choice([f"name {i}", "", None])) for i in range(150)], "id string, name string")
    e = [(f"r{i}", f"n{rng.choice((3, rng.randrange(150)))}", f"n{rng.randrange(160)}", "X", False) for i in range(230)] + [("l", "n5", "n5", "X", True)]
    g = graph.Graph(v, spark.createDataFrame(e, "id string, source_id string, target_id string, rel_type string, bidirectional boolean"))
    roots = spark.createDataFrame([(f"n{i}",) for i in range(0, 150, 2)] + [("n0",), ("none",)], "id string")
    found, joined = _both(lambda: graph.path_trees(g, roots, 4))
    assert found == joined and ("none", "none", 0, "none", "none") in found and max(r[2] for r in found) == 4
    with mock.patch.object(graph, "bfs", side_effect=AssertionError), mock.patch.object(graph, "with_names", side_effect=AssertionError):
        assert sorted(map(tuple, graph.path_trees(g, roots, 4).collect())) == found
    assert graph.path_trees(graph.Graph(v, g.edges.where("false")), roots, 4).count() == 76
    assert graph.path_trees(g, roots.where("false"), 4).count() == 0


@pytest.fixture(scope="module")
def linked(spark, names):
    """(mentions, graph) of names, ids as texts, types of every kind, groups of many and of one, hubs and loops."""
    rng = random.Random(8)
    kinds = ["person", "asset", None]
    v = [(f"e{i:03}", n, names[i // 2], [names[-1 - i // 3], None], " ".join(names[i : i + 2]), rng.choice(kinds)) for i, n in enumerate(names)]
    v = spark.createDataFrame(v, "id string, name string, canonical_name string, aliases array<string>, description string, entity_type string")
    e = [(f"r{i}", f"e{rng.choice((3, rng.randrange(160))):03}", f"e{rng.randrange(170):03}", "X", False, 1.0) for i in range(150)] + [("l", "e005", "e005", "X", False, 1.0)]
    e = spark.createDataFrame(e, "id string, source_id string, target_id string, rel_type string, bidirectional boolean, confidence double")
    texts = [*names, *names[:30], "e007", "E007", "e007", "", None, "?", "no such"]
    m = [(i, t, rng.choice([None, [], ["person"], ["asset", None], [None], ["person", "asset"]]), rng.choice([None, "", "d1", "d2", "d3", f"d{i}"]), 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(m, "mention_id long, text string, expected_types array<string>, document_id string, confidence double"), graph.Graph(v, e)


def _linked(linked, keep=5):
    m, g = linked
    return linking.ranked_rows(linking.best_linked(m, g, F.nullif(F.col("document_id"), F.lit("")), keep))


def test_best_candidates_without_a_row_of_every_candidate(linked):
    """adjudicated_decisions failed by the driver's memory and its disk: all candidates of all mentions were merged and written."""
    found, joined = _both(lambda: _linked(linked, 10))
    key = lambda rows: [(*r[:2], r[-1]) for r in rows]
    assert key(found) == key(joined) and len(found) > 1000 and {r[0] for r in found} >= {160, 194, 196}
    assert [r[2:] for r in found] == [pytest.approx(r[2:], abs=2e-6) for r in joined]
    five = sorted(map(tuple, _linked(linked).collect()))
    assert five == [r for r in found if r[-1] <= 5]
    with mock.patch.object(linking, "merge_routes", side_effect=AssertionError), mock.patch.object(linking, "rerank", side_effect=AssertionError):
        assert _linked(linked).count() == len(five)
    with pytest.raises(ValueError):
        _linked(linked, 4)


def test_decisions_of_arrays_are_those_of_rows(linked):
    m, g = linked
    best = linking.best_linked(m, g, F.col("document_id"))
    assert sorted(map(tuple, linking.decide(best, m).collect())) == sorted(map(tuple, linking.decide(linking.ranked_rows(best), m).collect()))
    empty = graph.Graph(g.vertices.where("false"), g.edges)
    assert linking.best_linked(m, empty, F.col("document_id")).count() == 0
    assert linking.decide(linking.best_linked(m, empty, F.col("document_id")), m).where("status = 'NIL'").count() == m.count()


@pytest.mark.parametrize("name", ["link_decision", "review_queue", "review_join", "coherence_scores", "reranked_candidates"])
def test_queries_of_linking_write_no_row_of_every_candidate(spark, data, name):
    """They failed at 0.1 GB by disk or the driver's memory."""
    gone = [mock.patch.object(linking, f, side_effect=AssertionError) for f in ("merge_routes", "rerank", "coherence", "bfs")]
    for p in gone:
        p.start()
    try:
        assert catalog.queries()[name](spark, data).count() > 0
    finally:
        for p in gone:
            p.stop()


def test_texts_of_the_same_known_words_are_looked_at_once():
    """review_join failed by its work: every text was looked at anew, also where it differs only in words that no document holds."""
    bodies = pa.array([f"oslo {'port ' * (i % 3)}n{i}" for i in range(60)])
    texts = [f"oslo x{i}" for i in range(40)] + ["port oslo", "oslo port", "x1"]
    words = blocks.Words(bodies, blocks._words(pa.array(texts)), 1.0, 1.2, 0.75)
    with mock.patch.object(blocks.np, "round", wraps=blocks.np.round) as looked:
        t, d, s = words.best(texts, 5)
    assert looked.call_count == 2 and not words.score.any()
    one = {i: list(zip(d[t == i].tolist(), s[t == i].tolist())) for i in range(43)}
    assert len(one[0]) == 5 and all(one[i] == one[0] for i in range(40)) and one[40] == one[41] != one[0] and not one[42]


def test_best_documents_of_frequent_words_are_looked_up_once():
    """coherence_scores failed by an executor's memory and its work: every text was searched for anew, however rare its own word."""
    rng = random.Random(9)
    bodies = [" ".join([*rng.sample(["port", "group", "agency", "steel"], rng.randint(1, 3)), f"w{i // 2}", *(["the"] * (i % 3 > 0))]) for i in range(400)]
    texts = [f"w{i} {rest}" for i in range(210) for rest in ("port group", "agency the", "the", f"w{i + 1}")] + ["port group", "the", "", "none"]
    words = blocks.Words(pa.array(bodies), blocks._words(pa.array(texts)), 0.6, 1.2, 0.75)
    assert words.stop[words.number["the"]]
    with mock.patch.object(words, "_search", wraps=words._search) as looked, mock.patch.object(blocks, "SLICE", 100):
        t, d, s = words.best(texts, 5)
    assert looked.call_count == 2  # port group, agency the
    whole = [words._search(tuple(sorted(x for x in map(words.number.get, set(x.split(" "))) if x is not None and words.df[x])), 5) for x in texts]
    assert [list(zip(d[t == i].tolist(), s[t == i].tolist())) for i in range(len(texts))] == [list(zip(x.tolist(), y.tolist())) for x, y in whole]
    assert not words.score.any() and len(t) > 1500


@pytest.mark.parametrize("bits", [0, 12 << 20])
def test_trigrams_of_words_that_stand_together_are_added_up_once(bits):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("bkrst") + rng.choice("aou") for _ in range(rng.randint(1, 4)))
    tails = [f"{word()} {word()}" for _ in range(4)]
    spelt = [f"{word()} {rng.choice(tails)}" for _ in range(300)]
    texts = [*spelt[:60], *(f"{x} {word()}" for x in spelt[:30]), *(" ".join(x.split()[:2]) for x in spelt[:60]), "zz", "aa aa", ""]
    padded = lambda xs: ["".join(f"  {w} " for w in x.split()) for x in xs]
    ids = pa.array([[f"e{i % 90:02}"] for i in range(300)], pa.list_(pa.string()))
    grams = lambda x: {f"  {w} "[i : i + 3] for w in x.split() for i in range(len(w) + 1)}
    with mock.patch.object(blocks, "SUM_BITS", bits):
        forms = blocks.Forms(pa.array(padded(spelt)), ids)
        order = forms.order(pa.array(padded(texts)))
        assert sorted(order) == list(range(len(texts))) and (len(forms.kept) > 4) == bool(bits)
        got = [(texts[order[at + i]], forms.ids[e].as_py(), s) for at in range(0, len(texts), 40) for i, e, s in zip(*forms.best(padded([texts[j] for j in order[at : at + 40]]), 0.15, 6))]
    want = []
    for t in texts:
        best: dict[str, float] = {}
        for f, (e,) in zip(spelt, ids.to_pylist()):
            a, b = grams(t), grams(f)
            best[e] = max(best.get(e, 0), len(a & b) / max(1, len(a | b)))
        want += [(t, e, s) for e, s in sorted(((e, s) for e, s in best.items() if s >= 0.15), key=lambda x: (-x[1], x[0]))[:6]]
    assert sorted(got) == sorted(want)


def test_links_of_small_slices_are_those_of_one(linked):
    """Texts are linked in the order of their seldom words, a few at a time, and rows still follow their mentions."""
    m, g = linked
    held, asked = [], []
    with mock.patch.object(blocks, "per_block", side_effect=lambda texts, names, *_, **__: held.append(names) or asked.append(texts) or texts.limit(0)):
        try:
            linking.best_linked(m, g, F.col("document_id"))
        except Exception:  # noqa: BLE001  the second step has other columns
            pass
    x, y = asked[0].toArrow(), held[0].toArrow()
    link = lambda: blocks.best_links(x.drop_columns(["__part"]) if "__part" in x.column_names else x, y, 5, 0.15, 20, 0.1, 1.2, 0.75)
    whole = link()
    with mock.patch.object(blocks, "SLICE", 7):
        assert link().equals(whole) and whole.num_rows > 150


def test_coherence_is_looked_for_in_documents_only(spark, data):
    """coherence_scores linked mentions without a document as well, which are coherent with nothing."""
    with mock.patch.object(linking, "best_linked", wraps=linking.best_linked) as called:
        assert catalog.queries()["coherence_scores"](spark, data).count() > 0
    (m, *_), _ = called.call_args
    assert m.where("document_id IS NULL OR document_id = ''").count() == 0


def test_blocks_give_their_memory_back():
    """coherence_scores was stopped for an executor's memory: its workers kept what a block had freed beside what the next one takes."""
    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
    blocks.give_back()
    before = rss()
    some = [bytes(20_000) for _ in range(6_000)]
    last = bytes(20_000)
    del some
    blocks.give_back()
    assert rss() - before < 60 and last


def test_review_queue_takes_candidates_apart_nowhere(spark, data):
    """It was stopped for an executor's memory: the best of all mentions were written, made rows and gathered again."""
    with mock.patch.object(linking, "ranked_rows", side_effect=AssertionError):
        q = catalog.queries()["review_queue"](spark, data).collect()
    assert {r.status for r in q} == {"pending"} and max(r.candidates.count("|") for r in q if r.candidates) == 9
