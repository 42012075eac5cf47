"""The store survives crashes between any two steps; changes and their outbox rows are one; the projection keeps the order."""

import json
from datetime import UTC, datetime, timedelta

import pytest

from tidegraph.sources import store as S
from tidegraph.sources.migrations import migrate
from tidegraph.streaming import outbox as O

ROW = "id string, name string, created_at int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_crash_before_the_rename_changes_nothing(spark, tmp_path, monkeypatch):
    s = S.Store(spark, f"file://{tmp_path}")
    s.write("e", spark.createDataFrame([("a", "x", 1)], ROW), "id")
    before = s.last()

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(s, "commit", crash)
    with pytest.raises(KeyboardInterrupt):
        s.write("e", spark.createDataFrame([("b", "y", 1)], ROW), "id")
    again = S.Store(spark, f"file://{tmp_path}")  # another process
    assert again.last() == before and rows(again.read("e")) == [("a", "x", 1)]
    again.write("e", spark.createDataFrame([("c", "z", 1)], ROW), "id")
    assert rows(again.read("e")) == [("c", "z", 1)] and rows(again.read("e", at=before)) == [("a", "x", 1)]
    with pytest.raises(RuntimeError):
        again.commit({}, before)  # a second writer on the same base


def test_appends_and_merges_rewrite_no_more_than_they_touch(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}", buckets=16)
    s.write("e", spark.createDataFrame([(f"k{i}", "old", 1) for i in range(100)], ROW), "id")
    first = s._state()["e"]["parts"]
    s.append("e", spark.createDataFrame([("k200", "new", 2)], ROW))
    parts = s._state()["e"]["parts"]
    assert sum(parts[b] == first.get(b) for b in parts) == len(parts) - 1 and s.read("e").count() == 101
    s.merge("e", spark.createDataFrame([("k5", "newer", 3), ("k300", "more", 3)], ROW), S.upsert, "id")
    after = s._state()["e"]["parts"]
    assert sum(after[b] == parts.get(b) for b in after) >= len(after) - 2
    got = {r.id: (r.name, r.created_at) for r in s.read("e").collect()}
    assert len(got) == 102 and got["k5"] == ("newer", 1) and got["k300"] == ("more", 3) and got["k6"] == ("old", 1)
    s.compact("e")
    assert {r.id: (r.name, r.created_at) for r in s.read("e").collect()} == got and all(len(f) == 1 for f in s._state()["e"]["parts"].values())


def test_a_change_and_its_outbox_rows_are_one_commit(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}")
    n = O.change(s, "e", spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], ROW), "upsert_entity", S.upsert)
    O.change(s, "e", spark.createDataFrame([("a", "z", 2)], ROW), "upsert_entity", S.upsert)
    assert s.last() == n + 1 and rows(s.read("e")) == [("a", "z", 1), ("b", "y", 1)]
    box = s.read("outbox").orderBy("id").collect()
    assert [r.id for r in box] == [1, 2, 3] and [r.entity_key for r in box] == ["a", "b", "a"] and json.loads(box[2].payload)["name"] == "z"
    assert O.drain(s, "graph", limit=2) == 2 and O.reconcile(s, "graph") == 1 and O.reconcile(s, "graph") == 0
    assert {r.entity_key: json.loads(r.payload)["name"] for r in s.read("graph").collect()} == {"a": "z", "b": "y"}
    assert {r.status for r in s.read("outbox").collect()} == {"done"}


def test_draining_stops_at_the_first_row_that_fails(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}")
    box = [(1, "upsert_entity", "a", '{"v":1}', "pending", 0, None, None), (2, "rename", "b", "{}", "pending", 1, None, None), (3, "upsert_entity", "c", "{}", "pending", 0, None, None)]
    s.write("outbox", spark.createDataFrame(box, O.SCHEMA), "id")
    s.write("e", spark.createDataFrame([("truth", "x", 1)], ROW), "id")
    with pytest.raises(ValueError, match="row 2: Unknown outbox op: rename"):
        O.drain(s, "graph")
    got = {r.id: (r.status, r.attempts, r.last_error) for r in s.read("outbox").collect()}
    assert got == {1: ("done", 0, None), 2: ("pending", 2, "Unknown outbox op: rename"), 3: ("pending", 0, None)}
    b = O.Barrier(s, "e", "graph")
    assert rows(b.read()) == [("truth", "x", 1)] and b.degraded
    fixed = s.read("outbox").where("id != 2")
    s.write("outbox", spark.createDataFrame(fixed.collect(), O.SCHEMA), "id")
    assert {r.entity_key for r in b.read().collect()} == {"a", "c"} and not b.degraded


def test_claims_are_released(spark):
    now = datetime(2026, 1, 1, 12, tzinfo=UTC)
    box = spark.createDataFrame([(i, "upsert_entity", "k", "{}", "pending", 0, None, None) for i in range(3)], O.SCHEMA)
    held = O.claimed(box, spark.createDataFrame([(0,), (1,), (9,)], "id long"), now)
    assert [r.id for r in O.pending(held).collect()] == [2] and O.pending(held.where("false")).count() == 0
    assert O.pending(O.released(held, now + timedelta(minutes=4))).count() == 1
    assert [r.id for r in O.pending(O.released(held, now + timedelta(minutes=6)), 2).collect()] == [0, 1]


def test_migrations_run_once_in_order(spark, tmp_path):
    s, seen = S.Store(spark, f"file://{tmp_path}"), []
    steps = {"002_b": lambda _: seen.append("b"), "001_a": lambda _: seen.append("a")}
    assert migrate(s, steps) == ["001_a", "002_b"] and migrate(s, steps) == []
    assert migrate(s, {**steps, "003_c": lambda _: seen.append("c")}) == ["003_c"] and seen == ["a", "b", "c"]
