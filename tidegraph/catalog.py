"""Named queries of the core: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows.

Each is registered beside its SQL. The graph is that of the tables entities (the record of the
greatest record_no of an id) and relationships (repeated rows once).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as X
from .operators import documents as D
from .operators import graph as G
from .operators import linking as L
from .operators import lookup as U
from .operators import risk as R
from .operators.instants import normalize_instants
from .plans.contract import ENTITY_TYPES, RELATIONSHIP_TYPES
from .plans.cypher import compile_query
from .session import checkpoint, table
from .sources import store as S
from .sources.tables import distinct_relationships, graph_of, latest_entities
from .streaming.cdc import latest_changes, triggers, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ENT = """ent AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_no DESC) AS rn FROM entities WHERE id IS NOT NULL) WHERE rn = 1)"""
REL = """rel AS (SELECT DISTINCT id, source_id, target_id, rel_type, weight, bidirectional, confidence FROM relationships WHERE id IS NOT NULL)"""
EDG = f"""{ENT}, {REL}, edg AS (SELECT r.* FROM rel r WHERE source_id IN (SELECT id FROM ent) AND target_id IN (SELECT id FROM ent))"""
ADJ = f"""{EDG}, adj AS (SELECT id AS rel_id, rel_type, source_id AS src, target_id AS dst FROM edg UNION SELECT id, rel_type, target_id, source_id FROM edg)"""
OUT = f"""{EDG}, adj AS (SELECT id AS rel_id, rel_type, source_id AS src, target_id AS dst FROM edg UNION SELECT id, rel_type, target_id, source_id FROM edg WHERE bidirectional)"""
#: The stated query set of the searches: a twentieth of all ids, by their hash.
TWENTIETH = "roots AS (SELECT id FROM ent WHERE substr(md5(id), 1, 4) < '0ccd')"


def levels(n: int, start: str, key: str = "") -> str:
    """Common table expressions l0..ln of a search, each level without what came before, and reach(key, node, hops)."""
    k = f"{key}, " if key else ""
    out = [f"l0 AS ({start})"]
    for i in range(1, n + 1):
        before = " AND ".join(
            f"NOT EXISTS (SELECT 1 FROM l{j} p WHERE p.node = a.dst" + (f" AND p.{key} = f.{key}" if key else "") + ")" for j in range(i)
        )
        fk = f"f.{key}, " if key else ""
        out.append(f"l{i} AS MATERIALIZED (SELECT DISTINCT {fk}a.dst AS node FROM l{i - 1} f JOIN adj a ON a.src = f.node WHERE {before})")
    out.append("reach AS (" + " UNION ALL ".join(f"SELECT {k}node, {i} AS hops FROM l{i}" for i in range(n + 1)) + ")")
    return ", ".join(out)


EXPOSURE = "CASE WHEN hops IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0::DOUBLE, 1::DOUBLE - (hops - 1) * 0.2::DOUBLE), 2) END"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def twentieth(g: G.Graph) -> DataFrame:
    """A stated query set: a twentieth of all ids, by their hash."""
    return g.vertices.where(F.substring(F.md5("id"), 1, 4) < "0ccd").select("id")


# -- graph ------------------------------------------------------------------
_NEAR = levels(5, "SELECT DISTINCT id AS node FROM ent WHERE entity_type = 'threat'")


@query(f"WITH {ADJ}, {_NEAR} SELECT e.id, e.name, e.entity_type, r.hops, {EXPOSURE} AS exposure_score FROM ent e LEFT JOIN reach r ON r.node = e.id WHERE e.entity_type = 'organization'")
def exposure_report(spark, d):
    return G.exposure_report(graph_of(spark, d))


@query(
    f"WITH {ADJ.replace('FROM edg', 'FROM edg WHERE true').replace('WHERE true WHERE', 'WHERE')}, {_NEAR} SELECT e.entity_type, {EXPOSURE} AS exposure_score, count(*) AS n FROM ent e LEFT JOIN reach r ON r.node = e.id GROUP BY 1, 2"
)
def exposure_by_type(spark, d):
    g = graph_of(spark, d)
    return G.exposure_scores(g).join(g.vertices.select("id", "entity_type"), "id").groupBy("entity_type", "exposure_score").agg(F.count("*").alias("n"))


_THIN = f"""{EDG}, adj AS (SELECT id AS rel_id, rel_type, source_id AS src, target_id AS dst FROM edg WHERE rel_type IN ('THREATENS', 'COMMANDS', 'OWNS')
 UNION SELECT id, rel_type, target_id, source_id FROM edg WHERE rel_type IN ('THREATENS', 'COMMANDS', 'OWNS'))"""


@query(f"WITH {_THIN}, {_NEAR} SELECT e.id, e.name, e.entity_type, r.hops, {EXPOSURE} AS exposure_score FROM ent e LEFT JOIN reach r ON r.node = e.id WHERE e.entity_type IN ('organization', 'location')")
def exposure_report_some_types(spark, d):
    return G.exposure_report(graph_of(spark, d), ("organization", "location"), ("THREATENS", "COMMANDS", "OWNS"))


@query(f"WITH {ADJ}, {_NEAR} SELECT count(*) AS n FROM ent e LEFT JOIN reach r ON r.node = e.id WHERE e.entity_type = 'organization' AND {EXPOSURE} >= 0.6")
def high_exposure_count(spark, d):
    return G.exposure_report(graph_of(spark, d)).where("exposure_score >= 0.6").agg(F.count("*").alias("n"))


def _neighbours(sql_adj: str, direction: str):
    def run(spark, d):
        g = graph_of(spark, d)
        return G.neighbours(g, g.vertices.select("id"), direction)

    run.__name__ = f"neighbors_{direction}"
    return query(f"WITH {sql_adj} SELECT a.src AS root, a.rel_id, a.rel_type, e.id, e.name, e.entity_type FROM adj a JOIN ent e ON e.id = a.dst")(run)


_IN = f"""{EDG}, adj AS (SELECT id AS rel_id, rel_type, target_id AS src, source_id AS dst FROM edg UNION SELECT id, rel_type, source_id, target_id FROM edg WHERE bidirectional)"""
_neighbours(ADJ, "both")
_neighbours(OUT, "out")
_neighbours(_IN, "in")


@query(f"WITH {ADJ} SELECT a.src AS root, a.rel_id, a.rel_type, e.id, e.name, e.entity_type FROM adj a JOIN ent e ON e.id = a.dst JOIN ent s ON s.id = a.src WHERE a.rel_type = 'THREATENS' AND s.entity_type = 'threat'")
def neighbors_typed(spark, d):
    g = graph_of(spark, d)
    return G.neighbours(g, U.by_type(g.vertices, "threat"), "both", ("THREATENS",))


@query(f"""WITH {REL}, ends AS (SELECT id AS rel_id, source_id AS id FROM rel UNION ALL SELECT id, target_id FROM rel WHERE source_id IS DISTINCT FROM target_id)
SELECT id, count(*) AS degree FROM ends WHERE id <> '' GROUP BY id""")
def degree_centrality(spark, d):
    return G.degrees(graph_of(spark, d))


_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel WHERE source_id IS DISTINCT FROM target_id) WHERE id <> '' GROUP BY id)"


@query(f"WITH {ENT}, {REL}, {_DEG} SELECT e.id, e.name, e.entity_type, coalesce(degree, 0) AS degree FROM ent e LEFT JOIN deg ON deg.id = e.id ORDER BY 4 DESC, 1 LIMIT 10")
def top_hubs(spark, d):
    return G.hubs(graph_of(spark, d))


_BALL = levels(2, "SELECT id AS root, id AS node FROM roots", "root")


@query(f"WITH {ADJ}, {TWENTIETH}, {_BALL} SELECT root, node, hops FROM reach")
def traverse_2hop_entities(spark, d):
    g = graph_of(spark, d)
    return G.traverse(g, twentieth(g), 2)[0]


@query(f"WITH {ADJ}, {TWENTIETH}, {_BALL} SELECT DISTINCT r.root, a.rel_id FROM reach r JOIN adj a ON a.src = r.node WHERE r.hops < 2")
def traverse_2hop_relationships(spark, d):
    g = graph_of(spark, d)
    return G.traverse(g, twentieth(g), 2)[1]


@query(f"WITH {ADJ}, {TWENTIETH}, {levels(5, 'SELECT id AS root, id AS node FROM roots', 'root')} SELECT root, hops, count(*) AS n FROM reach GROUP BY 1, 2")
def shortest_path_lengths(spark, d):
    g = graph_of(spark, d)
    return G.level_sizes(g.adjacency("both"), twentieth(g), 5)


def _trees_sql(n: int) -> str:
    """Paths along the smallest predecessor of each node, level by level."""
    out = ["p0 AS (SELECT root, node, [node] AS path FROM l0)"]
    for i in range(1, n + 1):
        out.append(f"""p{i} AS MATERIALIZED (SELECT root, node, list_append(path, node) AS path FROM (SELECT f.root, l.node, p.path, row_number() OVER (PARTITION BY f.root, l.node ORDER BY f.node) AS k
FROM l{i} l JOIN adj a ON a.dst = l.node JOIN l{i - 1} f ON f.root = l.root AND f.node = a.src JOIN p{i - 1} p ON p.root = f.root AND p.node = f.node) WHERE k = 1)""")
    return ", ".join(out) + ", trees AS (" + " UNION ALL ".join(f"SELECT root, node, {i} AS hops, path FROM p{i}" for i in range(n + 1)) + ")"


@query(
    f"""WITH {ADJ}, {TWENTIETH}, {levels(5, 'SELECT id AS root, id AS node FROM roots', 'root')}, {_trees_sql(5)}
SELECT t.root, t.node, t.hops, array_to_string(t.path, '>') AS path, (SELECT string_agg(coalesce(e.name, u.id), '>' ORDER BY u.i) FROM (SELECT unnest(t.path) AS id, generate_subscripts(t.path, 1) AS i) u LEFT JOIN ent e ON e.id = u.id) AS names FROM trees t"""
)
def shortest_path_trees(spark, d):
    g = graph_of(spark, d)
    return G.path_trees(g, twentieth(g))


@query(f"WITH {ADJ}, {TWENTIETH}, {levels(3, 'SELECT id AS root, id AS node FROM roots', 'root')}, e AS (SELECT root, count(*) AS entities FROM reach GROUP BY root), r AS (SELECT root, count(*) AS relationships FROM (SELECT DISTINCT r.root, a.rel_id FROM reach r JOIN adj a ON a.src = r.node WHERE r.hops < 3) GROUP BY root) SELECT e.root, entities, coalesce(relationships, 0) AS relationships FROM e LEFT JOIN r ON r.root = e.root")
def traversal_stats_3hop(spark, d):
    g = graph_of(spark, d)
    return G.traversal_stats(g, twentieth(g), 3)


def _chains_sql(depth: int) -> str:
    """Simple paths by step; a path is a chain if no step extends it."""
    out = ["c0 AS (SELECT id AS root, [id] AS path, [''] AS used FROM roots)"]
    for i in range(1, depth + 2):
        out.append(f"c{i} AS (SELECT c.root, list_append(c.path, a.dst) AS path, list_append(c.used, a.rel_id) AS used FROM c{i - 1} c JOIN dep a ON a.src = c.path[-1] WHERE NOT list_contains(c.path, a.dst))")
    ends = [
        f"SELECT c.root, c.path, {i} AS hops FROM c{i} c WHERE NOT EXISTS (SELECT 1 FROM dep a WHERE a.src = c.path[-1] AND NOT list_contains(c.path, a.dst))" for i in range(1, depth + 1)
    ]
    return ", ".join(out) + " SELECT root, array_to_string(path, '>') AS path, hops FROM (" + " UNION ALL ".join(ends) + ")"


@query(f"WITH {OUT}, {TWENTIETH}, dep AS (SELECT DISTINCT src, dst, rel_id FROM adj WHERE rel_type IN ('DEPENDS_ON', 'SUPPLIES', 'SUPPLIES_TO')), {_chains_sql(5)}")
def dependency_chains(spark, d):
    g = graph_of(spark, d)
    return G.dependency_chains(g, twentieth(g)).select("root", F.array_join("path", ">").alias("path"), "hops")


@query(
    f"""WITH {ADJ}, {TWENTIETH}, ends AS (SELECT id FROM roots UNION SELECT id FROM ent WHERE entity_type = 'threat'), {levels(5, 'SELECT id AS root, id AS node FROM ends', 'root')}
SELECT root AS source, node AS target, hops FROM reach WHERE node IN (SELECT id FROM ends) AND root < node ORDER BY hops, source, target LIMIT 20"""
)
def critical_path_pairs(spark, d):
    g = graph_of(spark, d)
    return G.critical_paths(g, twentieth(g))


@query(f"WITH {REL} SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, rel_type, min(id) AS id FROM rel WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2, 3")
def edge_undirected_dedupe(spark, d):
    return G.undirected_once(distinct_relationships(spark, d).where("source_id IS NOT NULL AND target_id IS NOT NULL"))


@query(
    f"""WITH {ADJ}, {_DEG}, pref AS (SELECT id FROM ent WHERE entity_type = 'threat' ORDER BY id LIMIT 5), near AS (SELECT DISTINCT a.dst AS id FROM adj a WHERE a.src IN (SELECT id FROM pref)),
v AS (SELECT e.id, CASE WHEN e.id IN (SELECT id FROM pref) THEN 0 WHEN e.id IN (SELECT id FROM near) THEN 1 ELSE 2 END AS rank, coalesce(degree, 0) AS degree FROM ent e LEFT JOIN deg ON deg.id = e.id ORDER BY rank, degree DESC, id LIMIT 200)
SELECT edg.id FROM edg WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)"""
)
def capped_subgraph(spark, d):
    g = graph_of(spark, d)
    first = U.by_type(g.vertices, "threat").orderBy("id").limit(5)
    return G.capped_subgraph(g, first)[1].select("id")


# -- lookups and filters --------------------------------------------------------
@query(f"WITH {ENT} SELECT entity_type, count(*) AS n FROM ent GROUP BY 1")
def entity_type_stats(spark, d):
    return latest_entities(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"))


@query(f"WITH {ENT}, {REL} SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relationships")
def graph_counts(spark, d):
    e = latest_entities(spark, d).agg(F.count("*").alias("entities"))
    return e.crossJoin(distinct_relationships(spark, d).agg(F.count("*").alias("relationships")))  # one row each


@query(f"WITH {ENT} SELECT id, name FROM ent WHERE entity_type = 'threat'")
def entities_by_type(spark, d):
    return U.by_type(latest_entities(spark, d), "threat").select("id", "name")


@query(f"WITH {ENT} SELECT id, name FROM ent WHERE typed.country = 'US' OR attributes['country'] = 'US' OR typed.severity = 'high'")
def attr_lookup(spark, d):
    e = latest_entities(spark, d)
    return U.by_attribute(e, "country", "US").select("id", "name").unionByName(U.by_attribute(e, "severity", "high").select("id", "name")).distinct()


@query(
    f"""WITH {ENT} SELECT id, name FROM ent WHERE contains(lower(name), 'port') OR contains(lower(description), 'port') OR contains(lower(canonical_name), 'port')
OR len(list_filter(coalesce(aliases, []), lambda a: contains(lower(a), 'port'))) > 0"""
)
def substring_search(spark, d):
    return U.search(latest_entities(spark, d), "Port").select("id", "name")


@query(f"WITH {ENT} SELECT id, name FROM ent WHERE lower(name) = (SELECT lower(min(name)) FROM ent) ORDER BY id LIMIT 1")
def name_lookup_ci(spark, d):
    e = checkpoint(latest_entities(spark, d).select("id", "name"))
    return U.by_name(e, e.agg(F.min("name")).head()[0] or "")


@query(f"WITH {ENT} SELECT id, name FROM ent ORDER BY name, id LIMIT 10 OFFSET 20")
def paged_names(spark, d):
    return U.page(latest_entities(spark, d).select("id", "name"), [F.col("name").asc_nulls_last(), F.col("id")], 2)


@query("SELECT rel_type, CASE WHEN upper(trim(rel_type)) IN (" + ", ".join(f"'{t}'" for t in RELATIONSHIP_TYPES) + ") THEN upper(trim(rel_type)) ELSE 'RELATED_TO' END AS coerced, count(*) AS n FROM relationships GROUP BY 1, 2")
def relation_type_coercion(spark, d):
    from .plans.contract import Contract

    c = Contract({t: () for t in ENTITY_TYPES})
    return table(spark, d, "relationships").groupBy("rel_type", c.relationship_type(F.col("rel_type")).alias("coerced")).agg(F.count("*").alias("n"))


@query(f"WITH {EDG} SELECT id FROM edg WHERE source_id <> target_id")
def linked_edges_only(spark, d):
    return S.only_linked(distinct_relationships(spark, d), latest_entities(spark, d)).select("id")


@query(f"""WITH {ENT}, p AS (SELECT id, entity_type, unnest([lower(trim(id)), lower(trim(name)), lower(trim(canonical_name)), lower(trim(replace(id, '_', ' ')))]) AS pattern FROM ent
UNION SELECT id, entity_type, lower(trim(a)) FROM (SELECT id, entity_type, unnest(aliases) AS a FROM ent)) SELECT DISTINCT pattern, id, entity_type FROM p WHERE length(pattern) >= 3""")
def gazetteer_patterns(spark, d):
    return U.gazetteer(latest_entities(spark, d))


# -- documents ----------------------------------------------------------------
@query("SELECT url, min(result_id) AS result_id FROM search_results WHERE url IS NOT NULL GROUP BY url UNION ALL SELECT url, result_id FROM search_results WHERE url IS NULL")
def url_dedupe_first(spark, d):
    return D.first_by_url(table(spark, d, "search_results").select("url", "result_id")).select("url", "result_id")


@query("SELECT resolved_entity_id AS id, count(DISTINCT nullif(document_id, '')) AS documents, count(DISTINCT source_url) AS urls, count(*) AS mentions FROM mentions WHERE resolved_entity_id IS NOT NULL GROUP BY 1")
def mention_rollup(spark, d):
    return D.mention_rollup(table(spark, d, "mentions"))


@query("SELECT result_id, finding FROM (SELECT result_id, score, split_part(trim(content), '. ', 1) || '.' AS finding FROM search_results WHERE score >= 0.85) WHERE length(finding) > 20 ORDER BY score DESC, result_id LIMIT 8")
def first_sentence_findings(spark, d):
    return D.findings(table(spark, d, "search_results"))


@query("SELECT feed, count(*) AS n, count(DISTINCT url) AS urls, round(avg(score), 6) AS mean_score FROM search_results GROUP BY feed")
def feed_stats(spark, d):
    return table(spark, d, "search_results").groupBy("feed").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("""SELECT doc_id, CASE WHEN length(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) = 0 THEN NULL
 ELSE substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) END AS slug FROM documents""")
def slug_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slug(F.col("title")).alias("slug"))


@query("SELECT doc_id, sha256(concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(text) <> '' THEN text END)) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("title"), F.col("text")).alias("content_hash"))


@query(
    r"""WITH l AS (SELECT doc_id, text, list_slice(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(trim(x), '^(?:[0-9]+[.)]|[-*•])\s*', ''))), lambda x: length(x) > 20), 1, 5) AS b FROM documents)
SELECT doc_id, CASE WHEN len(b) > 0 THEN array_to_string(b, '|') ELSE trim(coalesce(text, '')) END AS lines FROM l"""
)
def bullet_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.bullet_lines(F.col("text")), "|").alias("lines"))


@query("SELECT event_type, json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_attr_extract(spark, d):
    e = table(spark, d, "events").select("event_type", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


# -- mentions and linking ---------------------------------------------------------
@query(
    """SELECT mention_id FROM (SELECT mention_id, row_number() OVER (PARTITION BY coalesce(normalized_text, ''), list_sort(coalesce(expected_types, [])), coalesce(document_id, '') ORDER BY confidence DESC NULLS LAST, mention_id) AS n FROM mentions) WHERE n = 1"""
)
def mention_dedupe_maxconf(spark, d):
    return L.dedupe_mentions(table(spark, d, "mentions")).select("mention_id")


# -- risk -------------------------------------------------------------------------
_SEV = "CASE lower(severity) WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.5 END"
_UNIT = "greatest(0, least(1, CASE WHEN {0} IS NULL OR isnan({0}) THEN 0 ELSE {0} END))"
_BAND = "CASE WHEN {0} >= 0.8 THEN 'CRITICAL' WHEN {0} >= 0.6 THEN 'HIGH' WHEN {0} >= 0.4 THEN 'ELEVATED' WHEN {0} >= 0.2 THEN 'GUARDED' ELSE 'LOW' END"


def _threats(spark, d):
    t = latest_entities(spark, d).where("entity_type = 'threat'")
    return t.select("id", F.col("typed.threat_type").alias("category"), F.col("typed.severity").alias("severity"), F.col("typed.likelihood").alias("confidence"))


@query(
    f"""WITH {ENT}, t AS (SELECT typed.threat_type AS category, typed.severity AS severity, typed.likelihood AS confidence FROM ent WHERE entity_type = 'threat'),
p AS (SELECT category, max({_SEV} * {_UNIT.format('confidence')}) AS r FROM t GROUP BY category), s AS (SELECT coalesce(round(avg(r), 2), 0) AS score, count(*) AS categories FROM p)
SELECT score, {_BAND.format('score')} AS level, coalesce((SELECT severity FROM t ORDER BY CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, severity DESC NULLS LAST LIMIT 1), 'unknown') AS top_severity, categories FROM s"""
)
def risk_matrix(spark, d):
    return R.risk_matrix(_threats(spark, d))


@query(f"WITH {REL} SELECT round(avg(CASE WHEN upper(rel_type) = 'THREATENS' THEN 1.0 WHEN upper(rel_type) IN ('DEPENDS_ON', 'SUPPLIES', 'SUPPLIES_TO') THEN 0.7 ELSE 0.35 END * {_UNIT.format('confidence')}), 4) AS assertion_score, count(*) FILTER (WHERE upper(rel_type) = 'THREATENS') AS threatens, count(*) AS n FROM rel")
def assertion_weighted_mean(spark, d):
    return R.assertion_score(distinct_relationships(spark, d))


@query(
    f"""WITH {ENT}, s AS (SELECT round({_UNIT.format('confidence')}, 4) AS s FROM ent), r AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS k, count(*) OVER () AS n FROM s)
SELECT round(avg(s), 4) AS upper_mean, max(n) AS n FROM r WHERE k <= ceil(n / 2.0)"""
)
def top_half_mean(spark, d):
    return R.upper_half_mean(latest_entities(spark, d).select("confidence"), "confidence")


@query(f"WITH {ENT} SELECT {_BAND.format('confidence')} AS band, count(*) AS n FROM ent WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY 1")
def risk_band(spark, d):
    e = latest_entities(spark, d).where("confidence IS NOT NULL AND NOT isnan(confidence)")
    return e.groupBy(X.risk_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


# -- store and change stream --------------------------------------------------------
@query(f"WITH {EDG}, gone AS (SELECT id FROM ent WHERE entity_type = 'threat') SELECT id FROM rel WHERE (source_id IS NULL OR source_id NOT IN (SELECT id FROM gone)) AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM gone))")
def cascade_delete(spark, d):
    g = graph_of(spark, d)
    return S.cascade_delete(g.vertices, g.edges, U.by_type(g.vertices, "threat"))[1].select("id")


@query(
    """SELECT a.id, b.name, a.created_at FROM (SELECT id, min_by(created_at, record_no) FILTER (WHERE record_no IS NOT NULL) AS created_at FROM (SELECT id, created_at, record_no FROM entities WHERE id IS NOT NULL AND created_at IS NOT NULL) GROUP BY id) a
JOIN (SELECT id, arg_max(name, record_no) AS name FROM (SELECT * FROM entities WHERE id IS NOT NULL AND created_at IS NOT NULL) GROUP BY id) b ON a.id = b.id"""
)
def entity_upsert(spark, d):
    e = table(spark, d, "entities").where("id IS NOT NULL AND created_at IS NOT NULL").select("id", "name", "created_at", "record_no")
    rest = F.struct("name", "created_at", "record_no")
    first = e.groupBy("id").agg(F.min_by(rest, "record_no").alias("r")).select("id", "r.*")
    return S.upsert(first, e, order="record_no").select("id", "name", "created_at")


_ENVELOPES = """env AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'd' WHEN event_id % 5 = 0 THEN 'r' WHEN event_id % 2 = 0 THEN 'c' ELSE 'u' END AS op, CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 3 = 1 THEN 'processing' END AS b,
CASE WHEN event_id % 4 < 2 THEN 'pending' ELSE 'done' END AS a, event_id AS id FROM events)"""


@query(f"WITH {_ENVELOPES} SELECT id FROM env WHERE a = 'pending' AND (op = 'c' OR (op = 'u' AND b IS DISTINCT FROM 'pending'))")
def cdc_trigger_filter(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    op = F.when(i % 7 == 0, "d").when(i % 5 == 0, "r").when(i % 2 == 0, "c").otherwise("u")
    before = F.struct(i.alias("id"), F.when(i % 3 == 0, "pending").when(i % 3 == 1, "processing").alias("status"))
    after = F.struct(i.alias("id"), F.when(i % 4 < 2, "pending").otherwise("done").alias("status"))
    return triggers(e.select(op.alias("op"), before.alias("before"), after.alias("after")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def cdc_latest_state(spark, d):
    return latest_changes(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


# -- query language ----------------------------------------------------------------
@query(f"WITH {OUT} SELECT b.id AS id, count(*) AS n FROM ent a JOIN adj r ON r.src = a.id AND r.rel_type IN ('SUPPLIES', 'DEPENDS_ON') JOIN ent b ON b.id = r.dst WHERE a.entity_type = 'organization' GROUP BY 1 ORDER BY n DESC, id LIMIT 50")
def cypher_top_targets(spark, d):
    return compile_query(graph_of(spark, d), "MATCH (a:organization)-[r:SUPPLIES|DEPENDS_ON]->(b) RETURN b.id AS id, count(*) AS n ORDER BY n DESC, id LIMIT 50")


@query(f"WITH {ENT} SELECT id, name FROM ent WHERE entity_type = 'location' AND contains(lower(name), 'strait') ORDER BY name, id LIMIT 100")
def cypher_name_contains(spark, d):
    return compile_query(graph_of(spark, d), "MATCH (n:location) WHERE toLower(n.name) CONTAINS $q RETURN n.id AS id, n.name AS name ORDER BY name, id LIMIT 100", {"q": "strait"})


@query(f"WITH {ADJ}, t AS (SELECT min(id) AS id FROM ent WHERE entity_type = 'threat'), {levels(3, 'SELECT id AS node FROM t')} SELECT node AS id, hops FROM reach JOIN ent ON ent.id = node WHERE hops > 0 AND ent.entity_type = 'organization' ORDER BY hops, id LIMIT 200")
def cypher_shortest_hops(spark, d):
    g = graph_of(spark, d)
    first = U.by_type(g.vertices, "threat").agg(F.min("id")).head()[0]
    return compile_query(g, "MATCH p = shortestPath((t:threat {id: $t})-[*1..3]-(o:organization)) RETURN o.id AS id, min(length(p)) AS hops ORDER BY hops, id LIMIT 200", {"t": first})


# -- general: instants ----------------------------------------------------------------
@query(None)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(result_id, utc_us) of every search result whose published_date names a moment."""
    rows = table(spark, d, "search_results").select("result_id", "published_date", "feed")
    got = normalize_instants(rows, table(spark, d, "feeds"))
    return got.where(F.col("utc_us").isNotNull()).select("result_id", "utc_us")


def _all() -> None:
    """The modules that register further queries."""
    from . import catalog_flow, catalog_linking  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
