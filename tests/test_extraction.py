"""Answers of models, adjudication, new entities, reviews, the seed graph."""

import json

from pyspark.sql import functions as F

from tidegraph.operators import extraction as X
from tidegraph.operators import graph as G
from tidegraph.sources.seed import seed_graph, seeded
from tidegraph.sources.tables import export_snapshot, import_snapshot


def test_answers(spark):
    new = {"mentions": [{"text": "Acme", "mention_id": "m1", "expected_types": ["organization"], "confidence": 2}], "assertions": [{"source": "m1", "target": "Lower Port", "type": "operates_in", "confidence": "0.5"}]}
    old = {"entities": [{"name": "Bolt", "type": "Person"}], "relationships": [{"source": "Bolt", "target": "bolt", "predicate": "knows"}]}
    rows = [(1, "```json\n" + json.dumps(new) + "\n```"), (2, json.dumps(old)), (3, "no json"), (4, None), (5, "")]
    m, a = X.parse_answers(spark.createDataFrame(rows, "k int, answer string"), "k", "answer")
    assert {(r.doc, r.text, r.confidence) for r in m.collect()} == {(1, "Acme", 1.0), (1, "Lower Port", 0.7), (2, "Bolt", 0.7)}
    assert {(r.source_mention, r.target_mention, r.rel_type) for r in a.collect()} == {("m1", "1:lower port", "OPERATES_IN"), ("2:bolt", "2:bolt", "KNOWS")}


def test_after_the_decision(spark):
    d = spark.createDataFrame([(1, "AMBIGUOUS", None, 0.5, 0.0), (2, "NEW", None, None, None), (3, "NIL", None, None, None)], "mention_id int, status string, id string, score double, margin double")
    ranked = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.5)], "mention_id int, id string, rank int, score double")
    assert X.adjudicated(d, ranked, None) is d
    got = {r.mention_id: (r.status, r.id, r.score) for r in X.adjudicated(d, ranked, lambda c: c.groupBy("mention_id").agg(F.max("id").alias("id"))).collect()}
    assert got[1] == ("LINKED", "b", 0.75) and got[3][0] == "NIL"
    m = spark.createDataFrame([(2, "New Port", [], "at the New Port", 0.95)], "mention_id int, text string, expected_types array<string>, context string, confidence double")
    e = X.new_entities(d, m).collect()
    assert len(e) == 1 and e[0].entity_type == "event" and e[0].id == X.new_entities(d, m).head().id
    assert {r.mention_id: r.candidates and len(r.candidates) for r in X.review_queue(d, ranked).collect()} == {1: 2, 3: None}
    runs = spark.createDataFrame([("r1", "q")], "run_id string, query string")
    assert X.start_run(X.start_run(runs, runs), spark.createDataFrame([("r2", "q")], "run_id string, query string")).count() == 2


def test_seed_and_snapshot(spark, tmp_path):
    g = seed_graph(spark)
    assert {r.id: r.exposure_score for r in G.exposure_report(g).collect()} == {"org_1": 0.8, "org_2": 0.6, "org_3": 0.4, "org_4": 0.2, "org_5": 0.0, "org_6": 0.0}
    assert seeded(spark, g.vertices.where("false"), g.edges).vertices.count() == 8
    export_snapshot(g, str(tmp_path))
    back = import_snapshot(spark, str(tmp_path), g.vertices.schema, g.edges.schema)
    assert back.vertices.count() == 8 and back.edges.exceptAll(g.edges).isEmpty()


def test_threat_findings(spark):
    t = spark.createDataFrame([("cyber", "low", 0.9), ("military", "critical", 0.8)], "category string, severity string, confidence double")
    p = spark.createDataFrame([("Old case", 0.2), ("Near case", 0.9)], "title string, relevance double")
    assert [r.finding for r in X.threat_findings(t, p, 1).collect()] == ["military threat of critical severity (confidence 0.80)", "Precedent: Near case"]
