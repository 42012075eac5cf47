"""A small synthetic graph for trials: parallel edges, a chain of six hops, an alias in another script."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import Graph

VERTEX = "id string, name string, entity_type string, canonical_name string, aliases array<string>, description string, source string, confidence double"
EDGE = "id string, source_id string, target_id string, rel_type string, weight double, bidirectional boolean, confidence double"


def seed_graph(spark: SparkSession) -> Graph:
    v = [("threat_0", "Harbour Blockade", "threat", None, [], "A blockade", "manual", 0.9)]
    v += [(f"org_{i}", f"Operator {i}", "organization", f"Operator {i} Limited", ["运营商"] if i == 1 else [], "An operator", "manual", 1.0) for i in range(1, 7)]
    v += [("loc_0", "Lower Strait", "location", None, [], "A strait", "manual", 1.0)]
    e = [("e0", "threat_0", "loc_0", "THREATENS"), ("e1", "org_1", "loc_0", "OPERATES_IN"), ("e1b", "org_1", "loc_0", "TRANSITS")]
    e += [(f"e{i}", f"org_{i - 1}", f"org_{i}", "SUPPLIES") for i in range(2, 7)]
    return Graph(spark.createDataFrame(v, VERTEX), spark.createDataFrame([(*x, 1.0, False, 1.0) for x in e], EDGE))


def seeded(spark: SparkSession, vertices: DataFrame, edges: DataFrame) -> Graph:
    """The graph as it is, or the seed if it is empty."""
    return seed_graph(spark) if vertices.isEmpty() else Graph(vertices, edges)
