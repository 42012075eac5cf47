"""Graph operators on small graphs with exact results, and against plain Python on random ones."""

from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidegraph.operators import graph as G
from tidegraph.operators.components import connected_components

V = "id string, name string, entity_type string"
E = "id string, source_id string, target_id string, rel_type string, bidirectional boolean, weight double, confidence double"


def make(spark, vertices, edges):
    v = [(i, i.upper(), t) for i, t in vertices]
    e = [(f"r{n}", a, b, t, bi, 1.0, c) for n, (a, b, t, bi, c) in enumerate(edges)]
    return G.Graph(spark.createDataFrame(v, V), spark.createDataFrame(e, E))


@pytest.fixture(scope="module")
def small(spark):
    return make(
        spark,
        [("org1", "organization"), ("loc1", "location"), ("threat1", "threat"), ("far", "organization")],
        [("org1", "loc1", "OPERATES_IN", False, 1.0), ("threat1", "loc1", "THREATENS", False, 0.7), ("org1", "org1", "OWNS", False, 1.0),
         ("org1", "gone", "OWNS", False, 1.0), (None, "org1", "OWNS", False, 1.0)],
    )


def test_exposure(small):
    got = {r.id: r.exposure_score for r in G.exposure_scores(small).collect()}
    assert got == {"org1": 0.8, "loc1": 1.0, "threat1": 1.2, "far": 0.0}


def test_no_threats(spark):
    g = make(spark, [("a", "organization")], [("a", "a", "OWNS", False, 1.0)])
    assert [r.exposure_score for r in G.exposure_report(g).collect()] == [0.0]


def test_horizon_of_five_hops(spark):
    ids = [f"n{i}" for i in range(7)]
    g = make(spark, [("n0", "threat"), *[(i, "organization") for i in ids[1:]]], [(a, b, "OWNS", False, 1.0) for a, b in zip(ids, ids[1:])])
    got = {r.id: r.exposure_score for r in G.exposure_report(g).collect()}
    assert got["n5"] == pytest.approx(0.2) and got["n6"] == 0.0


def test_directions(spark):
    g = make(spark, [("a", "asset"), ("b", "asset"), ("c", "asset")], [("a", "b", "OWNS", False, 1.0), ("c", "a", "OWNS", True, 1.0)])
    root = spark.createDataFrame([("a",)], "id string")
    near = lambda d: sorted(r.id for r in G.neighbours(g, root, d).collect())
    assert (near("out"), near("in"), near("both")) == (["b", "c"], ["c"], ["b", "c"])
    with pytest.raises(ValueError):
        g.adjacency("sideways")


def test_self_loop_and_dangling_edges(spark, small):
    root = spark.createDataFrame([("org1",)], "id string")
    assert sorted(r.id for r in G.neighbours(small, root).collect()) == ["loc1", "org1"]
    assert {r.id: r.degree for r in G.degrees(small).collect()}["org1"] == 4


def test_paths(spark, small):
    assert G.find_path(small, "org1", "threat1") == ["org1", "loc1", "threat1"]
    assert G.find_path(small, "nobody", "nobody") == ["nobody"]
    assert G.find_path(small, "org1", "far") is None


def test_chains_stop_where_nothing_follows(spark):
    g = make(spark, [(x, "organization") for x in "abcd"], [("a", "b", "SUPPLIES", False, 1.0), ("b", "c", "DEPENDS_ON", False, 1.0), ("b", "d", "OWNS", False, 1.0), ("c", "a", "SUPPLIES", False, 1.0)])
    root = spark.createDataFrame([("a",)], "id string")
    assert [r.path for r in G.dependency_chains(g, root).collect()] == [["a", "b", "c"]]
    assert G.dependency_chains(g, root, max_depth=1).count() == 0


def test_parallel_edges_give_a_chain_each(spark):
    g = make(spark, [("a", "asset"), ("b", "asset")], [("a", "b", "SUPPLIES", False, 1.0)] * 2)
    assert G.dependency_chains(g, spark.createDataFrame([("a",)], "id string")).count() == 2


def test_empty_graph(spark):
    g = make(spark, [], [])
    assert G.exposure_report(g).count() == 0 and G.hubs(g).count() == 0
    assert G.bfs(g.adjacency(), g.vertices.select("id"), 3).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=14))
def test_bfs_equals_plain_search(spark, pairs):
    g = make(spark, [(str(i), "asset") for i in range(8)], [(str(a), str(b), "OWNS", False, 1.0) for a, b in pairs])
    near = {i: set() for i in range(8)}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    want = set()
    for root in (0, 3):
        seen, todo = {root: 0}, deque([root])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in seen and seen[x] < 3:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        want |= {(str(root), str(k), h) for k, h in seen.items()}
    got = G.bfs(g.adjacency(), spark.createDataFrame([("0",), ("3",)], "id string"), 3)
    assert {(r.root, r.node, r.hops) for r in got.collect()} == want


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 50), (60, 60), (70, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50}
    assert connected_components(e.where("a = 60"), "a", "b").count() == 0
