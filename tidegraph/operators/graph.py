"""Graph operators over (vertices, edges) DataFrames.

Searches are frontier loops: a level joins the distinct frontier with the adjacency and drops what
is visited; every level is written to the shared folder, so plans stay short and lost executors
cost one level. No level holds more rows than there are (root, node) pairs. All searches take many
roots at once. Ties between paths of equal length go to the smaller predecessor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import blocks

EXPOSURE_HOPS = 5
DEPENDENCY_TYPES = ("DEPENDS_ON", "SUPPLIES", "SUPPLIES_TO")
DIRECTIONS = ("out", "in", "both")


@dataclass(frozen=True)
class Graph:
    """vertices (id, name, entity_type, ...), one row an id; edges (id, source_id, target_id, rel_type, bidirectional, ...)."""

    vertices: DataFrame
    edges: DataFrame

    def valid_edges(self) -> DataFrame:
        """Edges of which both ends exist; an edge with an end that is unknown or null is invisible."""
        ids = self.vertices.select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        return e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")

    def adjacency(self, direction: str = "both", rel_types: tuple[str, ...] | None = None) -> DataFrame:
        """(rel_id, rel_type, src, dst): the edges as seen from src; each edge once per src, a self-loop once.

        out: along the edge, or either way if it is bidirectional; in: the mirror; both: either way."""
        if direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}")
        e = self.valid_edges()
        if rel_types:
            e = e.where(F.col("rel_type").isin(*rel_types))
        ahead = e.select(F.col("id").alias("rel_id"), "rel_type", F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
        flip = lambda d: d.select(F.col("id").alias("rel_id"), "rel_type", F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
        either = e.where(F.coalesce("bidirectional", F.lit(False)))
        if direction == "both":
            return ahead.unionByName(flip(e)).distinct()
        if direction == "out":
            return ahead.unionByName(flip(either)).distinct()
        return flip(e).unionByName(either.select(F.col("id").alias("rel_id"), "rel_type", F.col("source_id").alias("src"), F.col("target_id").alias("dst"))).distinct()


def exposure_from_hops(hops: Column) -> Column:
    """1.2 for a threat itself, 1.0 beside one, 0.2 less a hop, 0 from six hops on and without a path."""
    return F.when(hops.isNull(), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - (hops - 1) * 0.2), 2))


def neighbours(g: Graph, roots: DataFrame, direction: str = "both", rel_types: tuple[str, ...] | None = None) -> DataFrame:
    """(root, rel_id, rel_type, id, name, entity_type) of every edge at each root; parallel edges are rows of their own."""
    adj = g.adjacency(direction, rel_types)
    near = roots.select(F.col("id").alias("src")).distinct().join(adj, "src")
    return near.join(g.vertices.select(F.col("id").alias("dst"), "name", "entity_type"), "dst").select(
        F.col("src").alias("root"), "rel_id", "rel_type", F.col("dst").alias("id"), "name", "entity_type"
    )


def bfs(adj: DataFrame, roots: DataFrame, hops: int, parents: bool = False) -> DataFrame:
    """(root, node, hops[, parent]): the nodes within `hops` of each root, the root itself at 0.

    A root that is no vertex reaches only itself; no roots, no rows."""
    step = checkpoint(adj.select("src", "dst").where("src != dst").distinct())
    seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct().withColumn("hops", F.lit(0)).withColumn("parent", F.lit(None).cast("string"))
    seen = checkpoint(seen)
    front = seen
    for k in range(1, hops + 1):
        reach = front.select("root", F.col("node").alias("src")).join(step, "src")
        reach = reach.groupBy("root", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        new = checkpoint(reach.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(k).alias("hops"), "parent"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        front = new
    return seen if parents else seen.drop("parent")


def level_sizes(adj: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, hops, n): how many nodes are that far from each root; what `bfs` finds, counted.

    Each task holds all edges and searches from many roots at once, so no pair of a root and a node is written;
    edges too many for that are joined."""
    step = checkpoint(adj.select("src", "dst").where("src != dst").distinct())
    own = checkpoint(roots.select("id").distinct())
    held = step.agg(F.sum(F.length("src") + F.length("dst"))).head()[0] or 0  # one row
    if held > blocks.MOST_HELD:
        return bfs(step, own, hops).groupBy("root", "hops").agg(F.count("*").alias("n"))
    return blocks.per_block(own, step, own.count(), lambda x, y: blocks.level_sizes(x, y, hops), "root string, hops int, n long")


def nearest(adj: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(node, hops): distance of each node to the nearest of all sources, up to `hops`."""
    step = checkpoint(adj.select("src", "dst").where("src != dst").distinct())
    seen = checkpoint(sources.select(F.col("id").alias("node")).distinct().withColumn("hops", F.lit(0)))
    front = seen
    for k in range(1, hops + 1):
        reach = front.select(F.col("node").alias("src")).join(step, "src").select(F.col("dst").alias("node")).distinct()
        new = checkpoint(reach.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)))
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new
    return seen


def exposure_scores(g: Graph, threat_type: str = "threat", rel_types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, hops, exposure_score) of every vertex, by the shortest way over edges in any direction to a threat."""
    threats = g.vertices.where(F.col("entity_type") == threat_type)
    near = nearest(g.adjacency("both", rel_types), threats, EXPOSURE_HOPS)
    got = g.vertices.select("id").join(near.withColumnRenamed("node", "id"), "id", "left")
    return got.withColumn("exposure_score", exposure_from_hops(F.col("hops")))


def exposure_report(g: Graph, entity_types: tuple[str, ...] = ("organization",), rel_types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, name, entity_type, hops, exposure_score) of the vertices of the types."""
    own = g.vertices.where(F.col("entity_type").isin(*entity_types)).select("id", "name", "entity_type")
    return own.join(exposure_scores(g, rel_types=rel_types), "id")


def traverse(g: Graph, roots: DataFrame, hops: int = 2, rel_types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """((root, node, hops), (root, rel_id)): the ball around each root, and the edges at its nodes nearer than `hops`."""
    adj = checkpoint(g.adjacency("both", rel_types))
    ball = checkpoint(bfs(adj, roots, hops))
    inner = ball.where(F.col("hops") < hops).select("root", F.col("node").alias("src"))
    return ball, inner.join(adj, "src").select("root", "rel_id").distinct()


def shortest_paths(g: Graph, roots: DataFrame, max_hops: int = 5, rel_types: tuple[str, ...] | None = None, compat_horizon: bool = False) -> DataFrame:
    """(root, node, hops, path): a shortest path to every node within reach; of several the one whose last steps are smallest.

    compat_horizon allows one hop more, as callers of the older interface expect."""
    limit = max_hops + int(compat_horizon)
    tree = checkpoint(bfs(g.adjacency("both", rel_types), roots, limit, parents=True))
    done = tree.where("hops = 0").select("root", "node", "hops", F.array("node").alias("path"))
    last = done
    for k in range(1, limit + 1):
        level = tree.where(F.col("hops") == k)
        last = level.join(last.select("root", F.col("node").alias("parent"), F.col("path").alias("__p")), ["root", "parent"]).select(
            "root", "node", "hops", F.concat("__p", F.array("node")).alias("path")
        )
        done = done.unionByName(last)
    return done


def path_trees(g: Graph, roots: DataFrame, max_hops: int = 5, sep: str = ">") -> DataFrame:
    """(root, node, hops, path, names): `shortest_paths` and the names along them, each as one text.

    Each task holds all edges and names and searches from a part of the roots, so no row of a root, a node and a step is written,
    nor shuffled; edges and names too many for that are joined."""
    step = checkpoint(g.adjacency("both").select("src", "dst").where("src != dst").distinct())
    own, names = checkpoint(roots.select("id").distinct()), checkpoint(g.vertices.select("id", "name"))
    held = sum(t.agg(F.sum(F.length(a) + F.coalesce(F.length(b), F.lit(0)))).head()[0] or 0 for t, a, b in ((step, "src", "dst"), (names, "id", "name")))  # one row each
    if held > blocks.MOST_HELD:
        t = with_names(shortest_paths(g, roots, max_hops), g.vertices)
        return t.select("root", "node", "hops", F.array_join("path", sep).alias("path"), F.array_join(F.transform("named", lambda x: x["name"]), sep).alias("names"))
    row = lambda t, kind, a, b: t.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    asked = row(own, "root", F.col("id"), F.lit(None).cast("string"))
    beside = row(step, "step", F.col("src"), F.col("dst")).unionByName(row(names, "name", F.col("id"), F.col("name")))
    return blocks.streamed(asked, beside, own.count(), lambda x: blocks.path_trees(x, max_hops, sep), "root string, node string, hops int, path string, names string")


def find_path(g: Graph, source: str, target: str, max_hops: int = 5) -> list[str] | None:
    """The ids of one shortest path; [source] if both are the same, None if there is none.

    Both ends are searched by turns and the search stops where they meet, so neither looks at a whole ball."""
    if source == target:
        return [source]
    spark = g.vertices.sparkSession
    adj = checkpoint(g.adjacency("both").select("src", "dst").where("src != dst").distinct())
    sides = [checkpoint(spark.createDataFrame([(x, None, 0)], "node string, parent string, hops int")) for x in (source, target)]
    fronts = list(sides)
    for k in range(max_hops):
        i = k % 2
        new = fronts[i].select(F.col("node").alias("src")).join(adj, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        depth = k // 2 + 1
        fronts[i] = checkpoint(new.join(sides[i].select("node"), "node", "left_anti").withColumn("hops", F.lit(depth)))
        sides[i] = sides[i].unionByName(fronts[i])
        met = fronts[i].select("node").join(sides[1 - i].select("node"), "node").orderBy("node").head()
        if met:
            return _walk(sides[0], met[0])[::-1] + _walk(sides[1], met[0])[1:]
        if fronts[i].isEmpty():
            return None
    return None


def _walk(side: DataFrame, at: str) -> list[str]:
    """From a node back to the start of its side; a row at a time, as many as the path has edges."""
    path = [at]
    while (row := side.where((F.col("node") == path[-1]) & F.col("parent").isNotNull()).select("parent").head()) is not None:
        path.append(row[0])
    return path


def inspect(g: Graph, ids: DataFrame, most: int = 30) -> DataFrame:
    """(root, position, id, name, entity_type, rel_type): the first `most` neighbours of each vertex, by type of edge, id and edge."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("root").orderBy("rel_type", "id", "rel_id")
    near = neighbours(g, ids).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
    return near.select("root", "position", "id", "name", "entity_type", "rel_type")


def extracted_paths(paths: DataFrame, most: int = 20) -> DataFrame:
    """(source, source_name, target, target_name, hops) of the first `most` named paths: the nearest, then by their ends."""
    p = paths.where(F.size("named") > 0).withColumn("__f", F.element_at("named", 1)).withColumn("__l", F.element_at("named", -1))
    out = p.select(F.col("__f.id").alias("source"), F.col("__f.name").alias("source_name"), F.col("__l.id").alias("target"), F.col("__l.name").alias("target_name"), F.greatest(F.lit(0), F.size("named") - 1).alias("hops"))
    return out.orderBy("hops", "source", "target").limit(most)


def exposure_of(g: Graph, ids: DataFrame, threat_type: str = "threat", hops: int = EXPOSURE_HOPS) -> DataFrame:
    """(id, hops, exposure_score) of a few vertices, outward from them; the search of one ends at its nearest threat."""
    adj = checkpoint(g.adjacency("both").select("src", "dst").where("src != dst").distinct())
    threats = g.vertices.where(F.col("entity_type") == threat_type).select(F.col("id").alias("node"))
    front = checkpoint(ids.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct())
    seen, found = front, None
    for k in range(hops + 1):
        hit = checkpoint(front.join(threats, "node", "left_semi").select("root").distinct().withColumn("hops", F.lit(k)))
        found = hit if found is None else found.unionByName(hit)
        front = front.join(hit, "root", "left_anti")
        if k == hops:
            break
        new = front.select("root", F.col("node").alias("src")).join(adj, "src").select("root", F.col("dst").alias("node")).distinct()
        front = checkpoint(new.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    got = ids.select("id").distinct().join(found.withColumnRenamed("root", "id"), "id", "left")
    return got.withColumn("exposure_score", exposure_from_hops(F.col("hops")))


def dependency_chains(g: Graph, roots: DataFrame, rel_types: tuple[str, ...] = DEPENDENCY_TYPES, max_depth: int = 5) -> DataFrame:
    """(root, path, hops): simple paths along the types from each root that cannot be extended.

    A path of max_depth edges that could go on is left out; parallel edges give a chain each."""
    step = checkpoint(g.adjacency("out", rel_types).select("src", "dst", "rel_id"))
    path = checkpoint(roots.select(F.col("id").alias("root"), F.array("id").alias("path"), F.lit("").alias("by")).distinct())
    done = None
    for k in range(1, max_depth + 2):
        tail = path.withColumn("src", F.element_at("path", -1))
        ext = tail.join(step, "src").where(~F.array_contains("path", F.col("dst")))
        stuck = tail.where(F.size("path") > 1).join(
            ext.select("root", "path", "by").distinct(), ["root", "path", "by"], "left_anti"
        ).select("root", "path", (F.size("path") - 1).alias("hops"))
        done = stuck if done is None else done.unionByName(stuck)
        if k > max_depth:
            break
        path = checkpoint(ext.select("root", F.concat("path", F.array("dst")).alias("path"), F.concat_ws("|", "by", "rel_id").alias("by")))
        if path.isEmpty():
            break
    return done


def degrees(g: Graph) -> DataFrame:
    """(id, degree) of every end named by an edge; an edge counts once per distinct end, empty and null ids not at all."""
    ends = g.edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    return ends.where("id != ''").groupBy("id").agg(F.count("*").alias("degree"))


def hubs(g: Graph, top: int = 10) -> DataFrame:
    """(id, name, entity_type, degree): the vertices of most edges; ties go to the smaller id."""
    d = g.vertices.select("id", "name", "entity_type").join(degrees(g), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.orderBy(F.desc("degree"), "id").limit(top)


def critical_paths(g: Graph, focus: DataFrame, top: int = 20, max_hops: int = 5) -> DataFrame:
    """(source, target, hops): the shortest distances between the focus vertices and the threats, source < target.

    The search ends at the first distance within which there are `top` pairs, as all others are farther."""
    ends = focus.select("id").unionByName(g.vertices.where("entity_type = 'threat'").select("id")).distinct()
    ends, adj = checkpoint(ends), checkpoint(g.adjacency("both"))
    for h in range(min(1, max_hops), max_hops + 1):
        pairs = bfs(adj, ends, h).join(ends.withColumnRenamed("id", "node"), "node", "left_semi").where("root < node")
        pairs = pairs.select(F.col("root").alias("source"), F.col("node").alias("target"), "hops")
        if h == max_hops or pairs.limit(top).count() == top:
            return pairs.orderBy("hops", "source", "target").limit(top)


def traversal_stats(g: Graph, roots: DataFrame, hops: int = 3) -> DataFrame:
    """(root, entities, relationships) of the ball of each root."""
    ball, rels = traverse(g, roots, hops)
    a = ball.groupBy("root").agg(F.count("*").alias("entities"))
    b = rels.groupBy("root").agg(F.count("*").alias("relationships"))
    return a.join(b, "root", "left").withColumn("relationships", F.coalesce("relationships", F.lit(0)))


def with_names(paths: DataFrame, vertices: DataFrame, path: str = "path") -> DataFrame:
    """paths with `named`: array of (id, name) along each path; an id without a name names itself."""
    keyed = paths.withColumn("__k", F.xxhash64(*[F.col(c) for c in paths.columns]))
    parts = keyed.select("__k", F.posexplode(path).alias("pos", "id")).distinct().join(vertices.select("id", "name"), "id", "left")
    named = parts.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("name", "id").alias("name")))).alias("n"))
    return keyed.join(named, "__k", "left").withColumn("named", F.transform("n", lambda x: F.struct(x["id"], x["name"]))).drop("__k", "n")


def capped_subgraph(g: Graph, preferred: DataFrame, cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of at most `cap` vertices: the preferred ones and their neighbours first, then by degree and id."""
    own = preferred.select("id").distinct().withColumn("__first", F.lit(0))
    near = neighbours(g, preferred).select("id").distinct().withColumn("__near", F.lit(1))
    v = g.vertices.join(own, "id", "left").join(near, "id", "left").join(degrees(g), "id", "left")
    v = v.withColumn("rank", F.coalesce("__first", "__near", F.lit(2))).withColumn("degree", F.coalesce("degree", F.lit(0))).drop("__first", "__near")
    kept = checkpoint(v.orderBy("rank", F.desc("degree"), "id").limit(cap))
    ids = kept.select("id")
    e = g.valid_edges().join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept, e


def undirected_once(edges: DataFrame) -> DataFrame:
    """One edge of each unordered pair of ends and type: the one of the smallest id."""
    key = [F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.col("rel_type")]
    return edges.groupBy(*key).agg(F.min("id").alias("id"))
