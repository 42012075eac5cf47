"""Functions, lookups, contract, store, change stream, query language, risk and workflow."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.operators import documents as D
from tidegraph.operators import linking as L
from tidegraph.operators import lookup as U
from tidegraph.operators import risk as R
from tidegraph.operators.graph import Graph
from tidegraph.operators.instants import normalize_instants
from tidegraph.plans import workflow
from tidegraph.plans.contract import load_contract
from tidegraph.plans.cypher import DEFAULT_PLAN, Rejected, compile_query, execute_readonly, search_loop, validate
from tidegraph.sources import store as S
from tidegraph.streaming import cdc


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head().x


def test_surface_and_similarity(spark):
    assert one(spark, X.normalize_surface(F.lit("  ＴＳＭＣ，Inc.  "))) == "tsmc inc"
    assert one(spark, X.normalize_surface(F.lit("台积电"))) == "台积电"
    assert one(spark, X.normalize_surface(F.lit(None).cast("string"))) is None
    assert one(spark, X.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, X.trigram_similarity(F.lit(""), F.lit("?"))) == 0
    assert one(spark, X.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)
    vec = lambda *v: F.array(*[F.lit(float(x)).cast("float") for x in v])
    assert one(spark, X.cosine(vec(1, 0), vec(0.9, 0.1))) == pytest.approx(0.9938837, abs=1e-6)
    assert one(spark, X.cosine(vec(1, 0), vec(1))) == 0 and one(spark, X.cosine(vec(0, 0), vec(1, 0))) == 0


def test_small_functions(spark):
    assert one(spark, X.slug(F.lit("  Port of Örebro! "))) == "port_of_rebro"
    assert one(spark, X.slug(F.lit("!!"))) is None
    assert one(spark, X.edge_id(F.lit("a"), F.lit("b"), F.lit("OWNS"))) == "osint_a_b_OWNS"
    assert one(spark, X.edge_id(F.lit("a"), F.lit("b"), F.lit("RELATED_TO"))) == "osint_a_b"
    assert one(spark, X.unit(F.lit("x"), 0.5)) == 0.5 and one(spark, X.unit(F.lit("7"))) == 1
    assert one(spark, X.bullet_lines(F.lit("1. short\n- a line that is long enough to stay\n"))) == ["a line that is long enough to stay"]
    assert one(spark, X.unfenced(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    fuse = lambda *v: one(spark, X.fuse(*[F.lit(x) for x in v]))
    assert fuse(1.0, 0.0, 0.0, 1.0, 1.0, 0.0) == 0.97 and fuse(0.0, 1.0, 1.0, 1.0, 1.0, 1.0) == pytest.approx(0.65)


def test_instants(spark):
    feeds = spark.createDataFrame([("ny", "America/New_York", False), ("de", "Europe/Berlin", True), ("jp", "Asia/Tokyo", False)], "feed string, tz_name string, day_first boolean")
    cases = [
        ("ny", "2023-11-05 01:30:00", 1699162200000000), ("ny", "2023-03-12 02:30:00", None), ("de", "2023-02-19 24:00", 1676847600000000),
        ("de", "03/04/2023 10:00", 1680508800000000), ("ny", "03/04/2023 10:00 AM", 1677942000000000), ("de", "5. März 2023, 09:18 Uhr", 1678004280000000),
        ("jp", "2023年4月5日 午後9:04", 1680696240000000), ("zz", "2023-03-04T05:06:07.123456789Z", 1677906367123456), ("zz", "2023-03-04 05:06:07", None),
        ("de", "2023-02-30", None), ("de", "25:61", None), ("de", "", None), ("de", None, None), (None, "1677906367", 1677906367000000), ("de", "1677906367123", 1677906367123000),
        ("de", "le 1 mars 2023 à 7h12", 1677651120000000), ("ny", "Sat, 4 Mar 2023 13:32:11 +1100", 1677897131000000), ("de", "Updated: 1 Apr 2023, 07:04 EDT", 1680347040000000),
        ("de", "x" * 100_000, None),
    ]
    rows = spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(cases)], "result_id int, feed string, published_date string").withColumn("utc_us", F.lit("old")).withColumn("tz_name", F.lit("kept"))
    got = {r.result_id: r.utc_us for r in normalize_instants(rows, feeds).collect()}
    assert got == {i: u for i, (_, _, u) in enumerate(cases)}
    assert normalize_instants(rows.where("false"), feeds).count() == 0


def test_contract():
    spec = {"entity_types": {"threat": {"attributes": [{"name": "severity", "enum": ["low", "high"]}, {"name": "likelihood", "type": "float", "range": [0, 1]}]}}, "relationship_types": ["OWNS"]}
    c = load_contract(spec)
    assert c.relationship_types == ("OWNS",)
    for bad in ({"entity_types": {"alien": {}}}, {"relationship_types": ["EATS"]}, spec | {"graph_analysis": {"dependency_relationship_types": ["SUPPLIES"]}}):
        with pytest.raises(ValueError):
            load_contract(bad)


def test_coercion(spark):
    c = load_contract({"entity_types": {"threat": {"attributes": [{"name": "severity", "enum": ["low", "high"]}, {"name": "likelihood", "type": "float", "range": [0, 1]}]}}, "relationship_types": ["OWNS"]})
    df = spark.createDataFrame([({"severity": " high ", "likelihood": "0.5"},), ({"severity": "HIGH", "likelihood": "7"},), ({"likelihood": "x"},)], "m map<string,string>")
    assert [tuple(r) for r in df.select(*[v.alias(k) for k, v in c.coerce("threat", F.col("m")).items()]).collect()] == [("high", 0.5), (None, None), (None, None)]
    t = spark.createDataFrame([(" owns ",), ("eats",), (None,)], "t string")
    assert [r.x for r in t.select(c.relationship_type(F.col("t")).alias("x")).collect()] == ["OWNS", "RELATED_TO", "RELATED_TO"]


V = "id string, name string, entity_type string, canonical_name string, aliases array<string>, description string, source string, confidence double"
E = "id string, source_id string, target_id string, rel_type string, bidirectional boolean, confidence double"


@pytest.fixture(scope="module")
def g(spark):
    v = [
        ("org1", "Test Org", "organization", None, ["台积电"], None, "manual", 1.0),
        ("loc1", "Test Port", "location", None, None, "a port", "manual", 1.0),
        ("threat1", "Test Threat", "threat", None, [], None, "manual", 0.7),
    ]
    return Graph(spark.createDataFrame(v, V), spark.createDataFrame([("rel1", "org1", "loc1", "OPERATES_IN", False, 1.0), ("rel2", "threat1", "loc1", "THREATENS", False, 1.0)], E))


def test_lookups(g):
    assert U.search(g.vertices, "TEST").count() == 3 and U.search(g.vertices, "%").count() == 0 and U.search(g.vertices, "").count() == 3
    assert U.by_name(g.vertices, "test org").head().id == "org1"
    assert U.by_attribute(g.vertices, "confidence", "0.7").head().id == "threat1"
    assert U.capped(g.vertices, 2)[1] and not U.capped(g.vertices, 3)[1]


def test_gazetteer_in_texts(spark, g):
    docs = spark.createDataFrame([(1, "At Test Port, TEST ORG met 台积电."), (2, None), (3, "")], "k int, text string")
    got = {(r.k, r.id) for r in U.mentions_in(docs, "text", "k", U.gazetteer(g.vertices)).collect()}
    assert got == {(1, "loc1"), (1, "org1")}


def test_linking(spark, g):
    m = spark.createDataFrame([(1, "台积电", ["organization"], 0.9), (2, "Completely Unknown", [], 0.95), (3, None, None, 0.1), (4, "org1", ["location"], 0.2)], "mention_id int, text string, expected_types array<string>, confidence double")
    got = L.merge_routes(L.exact_candidates(m, L.name_forms(g.vertices)), L.direct_candidates(m, g.vertices), L.fuzzy_candidates(m, L.name_forms(g.vertices)))
    r = L.rerank(got, m, g.vertices)
    out = {x.mention_id: (x.status, x.id) for x in L.decide(r, m).collect()}
    assert out[1] == ("LINKED", "org1") and out[2] == ("NIL", None) and out[3] == ("NIL", None)
    assert {x.mention_id: x.status for x in L.decide(r, m, write=True).collect()}[2] == "NEW"


def test_coherence_counts_edges(spark, g):
    m = spark.createDataFrame([(1, "Test Org", ["organization"], 1.0), (2, "Test Port", ["location"], 1.0)], "mention_id int, text string, expected_types array<string>, confidence double")
    r = L.rerank(L.merge_routes(L.exact_candidates(m, L.name_forms(g.vertices))), m, g.vertices)
    got = L.coherence(r, g, m.select("mention_id", F.lit("d").alias("group_id")))
    assert {x.id: x.coherence for x in got.collect()} == {"org1": 0.5, "loc1": 0.5}


def test_risk(spark):
    e = lambda *v: spark.createDataFrame([(x,) for x in v], "exposure_score double")
    a = lambda *v: spark.createDataFrame(v, "rel_type string, confidence double")
    prior = spark.createDataFrame([(0.61,)], "score double")
    none = a(("X", 1.0)).where("false")
    run = lambda x, y: R.assess(x, y, prior).head()
    assert run(e(0.95, 0.75), none).score == 0.95 and run(e(0.0), a(("THREATENS", 1.0))).score == 1.0
    assert run(e(0.0), a(("RELATED_TO", 1.0))).score == 0.35 and run(e(0.95, 0.75), a(("THREATENS", 0.5))).score == 0.77
    assert run(e(0.0), none).basis == "catalogue"
    t = spark.createDataFrame([("military", "critical", 0.87), ("cyber", "high", 0.78), ("economic", "medium", 0.72), ("hybrid", "high", 0.83)], "category string, severity string, confidence double")
    got = R.risk_matrix(t).head()
    assert (got.score, got.level, got.top_severity) == (0.61, "HIGH", "critical")
    assert R.risk_matrix(t.where("false")).head().score == 0


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "id string, name string, created_at int")
    new = spark.createDataFrame([("a", "z", 2), ("c", "w", 2), (None, "n", 3)], "id string, name string, created_at int")
    s = S.Store(spark, f"file://{tmp_path}")
    s.write("e", old)
    for _ in range(2):
        s.write("e", S.upsert(s.read("e"), new))
    assert sorted(map(tuple, s.read("e").collect())) == [("a", "z", 1), ("b", "y", 1), ("c", "w", 2)] and s.version("e") == 3
    s.append("log", spark.createDataFrame([("q",), ("p",)], "x string"), serial="n", order=["x"])
    s.append("log", spark.createDataFrame([("o",)], "x string"), serial="n", order=["x"])
    assert sorted((r.n, r.x) for r in s.read("log").collect()) == [(1, "p"), (2, "q"), (3, "o")]
    with pytest.raises(LookupError):
        s.read("nothing")


def test_cascade_and_reviews(spark, g):
    m = spark.createDataFrame([(1, "Test Incorporated", None, "AMBIGUOUS"), (2, "x", "org1", "LINKED")], "mention_id int, text string, resolved_entity_id string, status string")
    _, edges, _, ms = S.cascade_delete(g.vertices, g.edges, spark.createDataFrame([("org1",)], "id string"), mentions=m)
    assert [r.id for r in edges.collect()] == ["rel2"] and {r.mention_id: r.resolved_entity_id for r in ms.collect()} == {1: None, 2: None}
    reviews = spark.createDataFrame([(7, 1, "pending", None)], "review_id int, mention_id int, status string, notes string")
    d = spark.createDataFrame([(7, "approved", "org1", "ok")], "review_id int, status string, entity_id string, notes string")
    _, ms, add = S.resolve_reviews(reviews, m, d)
    assert {r.mention_id: r.status for r in ms.collect()}[1] == "LINKED" and add.head().alias == "Test Incorporated"


def test_aliases(spark):
    old = spark.createDataFrame([("e", "tsmc inc", "TSMC Inc", 0.5, False, 1)], "entity_id string, normalized_alias string, alias string, confidence double, verified boolean, seq int")
    new = spark.createDataFrame([("e", "ＴＳＭＣ，Inc.", 0.9, True, 2), ("e", " ", 1.0, True, 3)], "entity_id string, alias string, confidence double, verified boolean, seq int")
    assert tuple(S.upsert_aliases(old, new).head()) == ("e", "tsmc inc", "TSMC Inc", 0.9, True, 1)


def test_trigger_table(spark):
    cases = [("c", None, "pending", True), ("u", "processing", "pending", True), ("u", None, "pending", True), ("u", None, "done", False), ("u", "pending", "pending", False), ("r", None, "pending", False), ("d", None, "pending", False)]
    raw = [(json.dumps({"op": op, "before": b and {"id": i, "status": b}, "after": {"id": i, "status": a}}),) for i, (op, b, a, _) in enumerate(cases)] + [("not json",), (None,)]
    got = sorted(r.id for r in cdc.triggers(cdc.parse_envelopes(spark.createDataFrame(raw, "value string"))).collect())
    assert got == [i for i, c in enumerate(cases) if c[3]]


def test_projection_stream(spark, tmp_path):
    schema = "id long, op string, entity_key string, payload string"
    s = S.Store(spark, f"file://{tmp_path}/store")
    for part in ([(1, "upsert_entity", "a", "1"), (3, "delete_entity", "b", None)], [(2, "upsert_entity", "b", "2"), (4, "upsert_entity", "a", "4")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        src = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        cdc.project_stream(spark, src, s, "entities", f"{tmp_path}/cp")
    assert {r.entity_key: r.payload for r in s.read("entities").collect()} == {"a": "4", "b": None}


def test_outbox_states(spark, tmp_path):
    schema = "id long, event string, error string"
    spark.createDataFrame([(1, "claim", None), (1, "fail", "boom"), (2, "claim", None), (2, "done", None), (3, "done", None)], schema).coalesce(1).write.json(f"{tmp_path}/in")
    out = cdc.outbox_states(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    end = time.time() + 60  # a query with timers never ends by itself
    while time.time() < end and spark.table("states").count() < 3:
        time.sleep(0.5)
    q.stop()
    assert {r.id: (r.status, r.attempts, r.last_error) for r in spark.table("states").collect()} == {1: ("pending", 1, "boom"), 2: ("done", 0, None), 3: ("pending", 0, None)}


GOOD = "MATCH (n:organization {id: $id})-[r:OPERATES_IN*1..2]-(m) RETURN m.id AS id LIMIT $limit"


@pytest.mark.parametrize(
    "text",
    ["", "MATCH (n) DELETE n RETURN n LIMIT 1", "MATCH (n) RETURN n; MATCH (m) RETURN m LIMIT 1", "MATCH (n) WHERE n.name = 'x' RETURN n LIMIT 1", "CALL db.labels() YIELD x RETURN x LIMIT 1",
     "MATCH (n) RETURN n", "MATCH (n)-[*1..9]-(m) RETURN m LIMIT 1", "MATCH (n)-[*3]-(m) RETURN m LIMIT 1", "MATCH (n)-[:EATS]-(m) RETURN m LIMIT 1", "MATCH (n)-[:owns]-(m) RETURN m LIMIT 1", "MATCH (n) RETURN n LIMIT 201",
     "MATCH (n) DE/* */LETE n RETURN n LIMIT 1", "MATCH (n) WHERE n.id = $$x$$ RETURN n LIMIT 1", "RETURN 1 LIMIT 1", "MATCH (n) WHERE n.id = $missing RETURN n LIMIT 1", "MATCH (n) WITH n LIMIT 1 MATCH (n)--(m) RETURN m"],
)
def test_rejected(text):
    with pytest.raises(Rejected):
        validate(text, {})


def test_accepted():
    assert validate(GOOD, {"id": "DELETE", "limit": 500})[1] == 200
    assert validate("MATCH (n) /* all */ RETURN n.id LIMIT 5 // end")[1] == 5


def test_queries(spark, g):
    assert [r.id for r in compile_query(g, GOOD, {"id": "org1", "limit": 5}).collect()] == ["loc1"]
    got = execute_readonly(g, "UNWIND $ids AS x MATCH (a {id: x})--(b) RETURN x AS x, b.name AS name ORDER BY x LIMIT 1", {"ids": ["org1", "threat1"]})
    assert got["rows"] == [{"x": "org1", "name": "Test Port"}] and got["truncated"] and got["audit"]["params"] == ["ids"]
    p = "MATCH p = shortestPath((a {id: $a})-[*1..4]-(b {id: $b})) RETURN length(p) AS hops, nodes(p) AS path LIMIT 1"
    assert tuple(compile_query(g, p, {"a": "org1", "b": "threat1"}).head()) == (2, ["org1", "loc1", "threat1"])
    o = "MATCH (a) OPTIONAL MATCH (a)-[:THREATENS]->(b) RETURN a.id AS id, b.id AS b ORDER BY id LIMIT 9"
    assert [tuple(r) for r in compile_query(g, o).collect()] == [("loc1", None), ("org1", None), ("threat1", "loc1")]
    w = "MATCH (a) WHERE any(x IN a.aliases WHERE x = $q) OR coalesce(a.description, $d) CONTAINS $z RETURN count(*) AS n LIMIT 1"
    assert compile_query(g, w, {"q": "台积电", "d": "", "z": "port"}).head().n == 2


def test_search_loop(g):
    out = search_loop(g, ["org1"])
    assert out["rows_observed"] == 1
    steps = [("MATCH (n) RETURN n.id AS id LIMIT 2", {}), ("DROP", {}), ("MATCH (n) RETURN n.id AS id LIMIT 2", {})]
    out = search_loop(g, [], lambda h: steps[len(h)])
    assert len(out["rounds"]) == 2 and "error" in out["rounds"][1] and DEFAULT_PLAN


def test_workflow(spark, g):
    docs = spark.createDataFrame([(1, "u1", "t", "Test Port was closed for three days. More follows", 0.9), (2, "u1", "t", "Again. x", 0.95)], "result_id int, url string, title string, content string, score double")
    threats = spark.createDataFrame([("military", "high", 0.7)], "category string, severity string, confidence double")
    got = list(workflow.stream(g, "What about Test Org?", lambda q: docs, threats))
    assert [s for s, _ in got] == list(workflow.STEPS)
    state = workflow.run(g, "What about Test Org?", lambda q: docs, threats)
    assert [f["id"] for f in state["graph"]["focus"]] == ["org1"] and state["findings"] == ["Test Port was closed for three days."]
    assert all(s.upper() in state["text"] for s in workflow.SECTIONS)
    assert workflow.run(g, "x", lambda q: 1 / 0, threats)["status"] == "error"


def test_documents(spark, g):
    r = spark.createDataFrame([(2, "u"), (1, "u"), (3, None), (4, None)], "result_id int, url string")
    assert sorted(x.result_id for x in D.first_by_url(r).collect()) == [1, 3, 4]
    n = spark.createDataFrame([("org1",), ("TEST PORT",), ("New Name!",)], "name string")
    assert [x.id for x in D.entity_id_for(n, g.vertices).orderBy("name").collect()] == ["new_name", "loc1", "org1"]
    a = spark.createDataFrame([(1, 10, 20, "OWNS", 0.5), (2, 10, 99, "OWNS", 0.5), (3, 10, 10, "OWNS", 0.5)], "assertion_id int, source_mention int, target_mention int, rel_type string, confidence double")
    dec = spark.createDataFrame([(10, "LINKED", "org1"), (20, "LINKED", "loc1")], "mention_id int, status string, id string")
    linked = D.link_assertions(a, dec)
    assert {x.assertion_id: x.status for x in linked.collect()} == {1: "confirmed", 2: "pending", 3: "confirmed"}
    assert [x.id for x in D.new_edges(linked, g.edges).collect()] == ["osint_org1_loc1_OWNS"]
    m = "id string, mention_count int, urls array<string>, attributes map<string,string>"
    got = D.merge_entities(spark.createDataFrame([("a", 2, ["x"], {"k": "1", "z": "0"})], m), spark.createDataFrame([("a", 1, ["y", "x"], {"k": "2"})], m)).head()
    assert (got.mention_count, got.urls, got.attributes) == (2, ["x", "y"], {"z": "0", "k": "2"})
