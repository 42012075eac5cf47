"""Named queries of the store, the change stream, documents, risk and reports, each beside its SQL."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import _BAND, _SEV, _UNIT, ADJ, EDG, ENT, REL, TWENTIETH, _trees_sql, levels, query, twentieth
from .functions import text as X
from .functions.let import let
from .operators import documents as D
from .operators import extraction as E
from .operators import graph as G
from .operators import lookup as U
from .operators import risk as R
from .plans.contract import ENTITY_TYPES, RELATIONSHIP_TYPES, Attribute, Contract
from .plans.sqltext import surfaces
from .session import checkpoint, table
from .sources import catalogue as K
from .sources import codec as C
from .sources import store as S
from .sources.tables import canned_search, distinct_relationships, dot_lines, graph_of, latest_entities
from .streaming import cdc
from .streaming import outbox as O

# -- records and snapshots ---------------------------------------------------------------
_TYPED = ("org_type", "country", "sector", "role", "nationality", "affiliation", "location_type", "event_type", "start_date", "end_date", "severity", "asset_type", "operator", "status", "threat_type", "impact_description")
_NUMBERS = ("revenue_usd", "latitude", "longitude", "likelihood")
_KEYS = "list_concat(" + ", ".join(
    [f"CASE WHEN {c} <> '' THEN ['{c}'] ELSE [] END" for c in ("canonical_name", "lang")]
    + ["CASE WHEN len(aliases) > 0 THEN ['aliases'] ELSE [] END", "CASE WHEN cardinality(external_ids) > 0 THEN ['external_ids'] ELSE [] END", "CASE WHEN len(embedding) > 0 THEN ['embedding'] ELSE [] END"]
    + [f"CASE WHEN typed.{c} IS NOT NULL THEN ['{c}'] ELSE [] END" for c in (*_TYPED, *_NUMBERS)]
    + ["list_filter(coalesce(map_keys(attributes), []), lambda k: k NOT IN ('canonical_name', 'aliases', 'lang', 'external_ids', 'embedding', " + ", ".join(f"'{c}'" for c in (*_TYPED, *_NUMBERS)) + "))"]
) + ")"


_SAID = _KEYS.replace("typed.", "''||typed.").replace(" IS NOT NULL THEN ['", " <> '' THEN ['")


@query(f"WITH {ENT} SELECT id, coalesce(name, '') AS name, coalesce(source, 'manual') AS source, array_to_string(list_sort({_KEYS}), ',') AS keys FROM ent")
def entity_records(spark, d):
    r = C.to_records(latest_entities(spark, d))
    return r.select("id", "name", "source", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("keys"))


@query(f"WITH {ENT} SELECT id, coalesce(name, '') AS name, nullif(canonical_name, '') AS canonical_name, array_to_string(CASE WHEN len(aliases) > 0 THEN list_filter(aliases, lambda a: a IS NOT NULL) END, '|') AS aliases, typed.country AS country, typed.latitude AS latitude, len(CASE WHEN len(embedding) > 0 THEN embedding END) AS dimensions FROM ent")
def entity_round_trip(spark, d):
    """Entities folded to records and unfolded again."""
    e = latest_entities(spark, d)
    back = C.from_records(C.to_records(e), e)
    n = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return back.select("id", "name", F.nullif("canonical_name", F.lit("")).alias("canonical_name"), F.array_join("aliases", "|").alias("aliases"), "typed.country", "typed.latitude", n.cast("long").alias("dimensions"))


@query("SELECT DISTINCT id, rel_type AS relationship_type, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM relationships WHERE id IS NOT NULL")
def relationship_records(spark, d):
    r = table(spark, d, "relationships").where("id IS NOT NULL").select("id", "rel_type", F.col("created_at").cast("timestamp").alias("created_at")).distinct()
    return C.to_relationship_records(r)


@query(f"""WITH {ENT} SELECT id, count(*) AS properties FROM (SELECT id, unnest(list_concat({_SAID}, CASE WHEN entity_type <> '' THEN ['entity_type'] ELSE [] END, CASE WHEN name <> '' THEN ['name'] ELSE [] END, CASE WHEN description <> '' THEN ['description'] ELSE [] END,
CASE WHEN len(list_filter(tags, lambda t: t IS NOT NULL)) > 0 AND array_to_string(list_filter(tags, lambda t: t IS NOT NULL), ',') <> '' THEN ['tags'] ELSE [] END, CASE WHEN source IS NULL OR source <> '' THEN ['source'] ELSE [] END, ['confidence'], CASE WHEN created_at IS NOT NULL THEN ['created_at'] ELSE [] END)) AS k,
attributes, typed FROM ent) WHERE NOT (coalesce(attributes[k], 'x') = '' AND k NOT IN ('name', 'description', 'source')) GROUP BY id""")
def node_properties(spark, d):
    return C.properties(C.to_records(latest_entities(spark, d))).groupBy("id").agg(F.count("*").alias("properties"))


@query(f"WITH {ENT} SELECT id, to_json(struct_pack(id := id, name := name, entity_type := entity_type)) AS json FROM ent")
def serialised_nodes(spark, d):
    return latest_entities(spark, d).select("id", C.serialised(F.struct("id", "name", "entity_type")).alias("json"))


@query(f"""WITH {EDG} SELECT '  "' || id || '" [label="' || replace(coalesce(name, ''), '"', '\\"') || '"];' AS line FROM ent UNION ALL SELECT '  "' || coalesce(source_id, '') || '" -> "' || coalesce(target_id, '') || '" [label="' || coalesce(rel_type, '') || '"];' FROM rel""")
def dot_graph(spark, d):
    return dot_lines(graph_of(spark, d))


@query("SELECT * FROM (VALUES " + ", ".join([f"('entity type', '{t}')" for t in ENTITY_TYPES] + [f"('relationship type', '{t}')" for t in RELATIONSHIP_TYPES] + ["('node label', 'Entity')"]) + ") t(kind, name)")
def schema_descriptor(spark, d):
    x = Contract({t: () for t in ENTITY_TYPES}).descriptor()
    rows = [("entity type", t) for t in x["entity_types"]] + [("relationship type", t) for t in x["relationship_types"]] + [("node label", x["node_label"])]
    return spark.createDataFrame(rows, "kind string, name string")


_ATTRIBUTES = (Attribute("country", enum=("US", "CN", "DE", "GB", "KR")), Attribute("latitude", "float", low=0.0, high=90.0), Attribute("sector"), Attribute("parts", "list"))


@query(f"""WITH {ENT}, v AS (SELECT id, trim(typed.country) AS country, typed.latitude AS latitude, trim(typed.sector) AS sector, concat_ws(' ; ', typed.country, typed.sector) AS parts FROM ent)
SELECT id, CASE WHEN country IN ('US', 'CN', 'DE', 'GB', 'KR') THEN country END AS country, CASE WHEN latitude BETWEEN 0 AND 90 THEN latitude END AS latitude, nullif(sector, '') AS sector, len(list_filter(regexp_split_to_array(parts, '\\s*[;|]\\s*'), lambda x: trim(x) <> '')) AS parts FROM v""")
def attribute_coercion(spark, d):
    e = latest_entities(spark, d)
    text = e.select("id", F.create_map(F.lit("country"), "typed.country", F.lit("latitude"), F.col("typed.latitude").cast("string"), F.lit("sector"), "typed.sector", F.lit("parts"), F.concat_ws(" ; ", "typed.country", "typed.sector")).alias("m"))
    got = Contract({"location": _ATTRIBUTES}).coerce("location", F.col("m"))
    return text.select("id", "*", *[c.alias(n) for n, c in got.items()]).select("id", "country", "latitude", "sector", F.size("parts").cast("long").alias("parts"))


@query("SELECT entity_type, lower(trim(entity_type)) IN (" + ", ".join(f"'{t}'" for t in ENTITY_TYPES) + ") AS known, count(*) AS n FROM (SELECT entity_type FROM entities UNION ALL SELECT rel_type FROM relationships UNION ALL SELECT ' Threat ' FROM feeds) WHERE entity_type IS NOT NULL GROUP BY 1, 2")
def entity_type_filter(spark, d):
    t = table(spark, d, "entities").select("entity_type").unionByName(table(spark, d, "relationships").select(F.col("rel_type").alias("entity_type"))).unionByName(table(spark, d, "feeds").select(F.lit(" Threat ").alias("entity_type")))
    c = Contract({x: () for x in ENTITY_TYPES})
    return t.where("entity_type IS NOT NULL").groupBy("entity_type", c.is_entity_type(F.col("entity_type")).alias("known")).agg(F.count("*").alias("n"))


# -- lookups ------------------------------------------------------------------------------
@query(f"WITH {ENT} SELECT id, name, entity_type FROM ent WHERE id = (SELECT max(id) FROM ent) UNION ALL SELECT id, name, entity_type FROM ent WHERE entity_type = 'event' UNION ALL SELECT id, name, entity_type FROM ent WHERE contains(lower(name), 'gulf') OR contains(lower(description), 'gulf') OR contains(lower(canonical_name), 'gulf') OR len(list_filter(coalesce(aliases, []), lambda a: contains(lower(a), 'gulf'))) > 0")
def query_dispatch(spark, d):
    """A point lookup, a query by type that outweighs its term, and one by term."""
    e = latest_entities(spark, d)
    last = e.agg(F.max("id")).head()[0] or ""
    out = [U.by_id(e, last), U.query(e, "event", "gulf"), U.query(e, None, "Gulf")]
    a, b, c = (x.select("id", "name", "entity_type") for x in out)
    return a.unionByName(b).unionByName(c)


@query(f"""WITH {ENT}, gz AS (SELECT id, entity_type, unnest([lower(trim(id)), lower(trim(name)), lower(trim(canonical_name)), lower(trim(replace(id, '_', ' ')))]) AS pattern FROM ent UNION SELECT id, entity_type, lower(trim(a)) FROM (SELECT id, entity_type, unnest(aliases) AS a FROM ent)),
w AS (SELECT DISTINCT id, array_to_string(list_filter(regexp_split_to_array(pattern, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') AS p FROM gz WHERE length(pattern) >= 3), t AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS s FROM documents)
SELECT DISTINCT doc_id, id FROM t JOIN w ON contains(s, ' ' || p || ' ') WHERE p <> ''""")
def gazetteer_doc_hits(spark, d):
    pat = U.gazetteer(latest_entities(spark, d).select("id", "name", "canonical_name", "aliases", "entity_type"))
    return U.mentions_in(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", pat)


@query(f"WITH {ENT} SELECT id, name, truncated FROM (SELECT id, name FROM ent ORDER BY id LIMIT 25), (SELECT count(*) > 25 AS truncated FROM ent)")
def capped_rows(spark, d):
    rows, more = U.capped(latest_entities(spark, d).select("id", "name").orderBy("id"), 25)
    return spark.createDataFrame([(*r, more) for r in rows], "id string, name string, truncated boolean")


@query("SELECT result_id, score FROM (SELECT *, lower(feed) AS b FROM search_results) WHERE b IN (SELECT lower(feed) FROM feeds WHERE len(list_filter(string_split(lower(feed), ' '), lambda w: contains('the gulf wire port', w))) > 0) OR NOT EXISTS (SELECT 1 FROM feeds WHERE len(list_filter(string_split(lower(feed), ' '), lambda w: contains('the gulf wire port', w))) > 0) ORDER BY score DESC, url, result_id LIMIT 5")
def canned_documents(spark, d):
    docs = table(spark, d, "search_results").select("result_id", "score", "url", F.lower("feed").alias("bucket"))
    return canned_search(docs, table(spark, d, "feeds").select(F.lower("feed").alias("bucket")), "The Gulf wire port").select("result_id", "score")


# -- graph ----------------------------------------------------------------------------------
@query(f"WITH {ADJ}, {TWENTIETH} SELECT root, position, id, name, entity_type, rel_type FROM (SELECT a.src AS root, row_number() OVER (PARTITION BY a.src ORDER BY a.rel_type NULLS FIRST, e.id, a.rel_id) AS position, e.id, e.name, e.entity_type, a.rel_type FROM roots JOIN adj a ON a.src = roots.id JOIN ent e ON e.id = a.dst) WHERE position <= 30")
def entity_inspection(spark, d):
    g = graph_of(spark, d)
    return G.inspect(g, twentieth(g))


@query(
    f"""WITH {ADJ}, {TWENTIETH}, {levels(2, 'SELECT id AS root, id AS node FROM roots', 'root')}, {_trees_sql(2)} SELECT t.root AS source, coalesce(a.name, t.root) AS source_name, t.node AS target, coalesce(b.name, t.node) AS target_name, t.hops
FROM trees t LEFT JOIN ent a ON a.id = t.root LEFT JOIN ent b ON b.id = t.node WHERE t.hops > 0 ORDER BY t.hops, source, target LIMIT 20"""
)
def extracted_paths(spark, d):
    g = graph_of(spark, d)
    return G.extracted_paths(G.with_names(G.shortest_paths(g, twentieth(g), 2).where("hops > 0"), g.vertices))


@query(f"WITH {ADJ}, {TWENTIETH}, {levels(5, 'SELECT id AS root, id AS node FROM roots', 'root')}, n AS (SELECT root, min(hops) AS hops FROM reach JOIN ent ON ent.id = node WHERE entity_type = 'threat' GROUP BY root) SELECT roots.id, hops, CASE WHEN hops IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0::DOUBLE, 1::DOUBLE - (hops - 1) * 0.2::DOUBLE), 2) END AS exposure_score FROM roots LEFT JOIN n ON n.root = roots.id")
def exposure_of_twentieth(spark, d):
    """Outward from each vertex of the stated query set to its nearest threat."""
    g = graph_of(spark, d)
    return G.exposure_of(g, twentieth(g))


@query(f"WITH {ADJ}, r AS (SELECT min(id) AS id FROM ent GROUP BY entity_type), e AS (SELECT max(id) AS id FROM ent WHERE entity_type = 'threat'), {levels(5, 'SELECT id AS root, id AS node FROM r', 'root')} SELECT r.id AS source, e.id AS target, hops FROM r CROSS JOIN e LEFT JOIN reach ON reach.root = r.id AND reach.node = e.id")
def find_path_hops(spark, d):
    """Edges on the way from the first vertex of each type to the last threat; the feature is a search between two vertices."""
    g = graph_of(spark, d)
    starts = [r[0] for r in g.vertices.groupBy("entity_type").agg(F.min("id")).select("min(id)").collect()]
    end = U.by_type(g.vertices, "threat").agg(F.max("id")).head()[0]
    got = [(s, end, G.find_path(g, s, end) if end else None) for s in starts]
    return spark.createDataFrame([(s, t, len(p) - 1 if p else None) for s, t, p in got], "source string, target string, hops int")


# -- documents ------------------------------------------------------------------------------
@query("""WITH a AS (SELECT resolved_entity_id AS id, count(*) AS n, list_sort(list(DISTINCT source_url) FILTER (WHERE source_url IS NOT NULL)) AS urls FROM mentions WHERE resolved_entity_id IS NOT NULL AND mention_id % 2 = 0 GROUP BY 1),
b AS (SELECT resolved_entity_id AS id, count(*) AS n, list_sort(list(DISTINCT source_url) FILTER (WHERE source_url IS NOT NULL)) AS urls FROM mentions WHERE resolved_entity_id IS NOT NULL AND mention_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, greatest(a.n, b.n) AS mention_count, len(list_distinct(list_concat(coalesce(a.urls, []), coalesce(b.urls, [])))) AS urls, CASE WHEN b.id IS NULL THEN 'even' ELSE 'odd' END AS side FROM a FULL JOIN b ON a.id = b.id""")
def merged_entities(spark, d):
    """Two halves of the mentions rolled up apart, and merged."""
    m = table(spark, d, "mentions").where("resolved_entity_id IS NOT NULL")

    def side(rest: int, name: str):
        own = m.where(F.col("mention_id") % 2 == rest).groupBy(F.col("resolved_entity_id").alias("id")).agg(F.count("*").alias("mention_count"), F.collect_set("source_url").alias("urls"))
        return own.withColumn("attributes", F.create_map(F.lit("side"), F.lit(name)))

    return D.merge_entities(side(0, "even"), side(1, "odd")).select("id", "mention_count", F.size("urls").cast("long").alias("urls"), F.col("attributes")["side"].alias("side"))


_ASSERTED = f"""asr AS (SELECT id AS assertion_id, source_id, target_id, rel_type, confidence FROM rel), lk AS (SELECT id FROM ent WHERE entity_type <> 'threat'), ls AS (SELECT a.*, s.id AS s, t.id AS t FROM asr a LEFT JOIN lk s ON s.id = a.source_id LEFT JOIN lk t ON t.id = a.target_id)"""


def _assertions(spark, d):
    r = distinct_relationships(spark, d)
    a = r.select(F.col("id").alias("assertion_id"), F.col("source_id").alias("source_mention"), F.col("target_id").alias("target_mention"), "rel_type", "confidence")
    v = latest_entities(spark, d).select(F.col("id").alias("mention_id"), F.when(F.col("entity_type") != "threat", "LINKED").otherwise("NIL").alias("status"), "id")
    return D.link_assertions(a, v)


@query(f"WITH {ENT}, {REL}, {_ASSERTED} SELECT assertion_id, s AS source_id, t AS target_id, CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN 'confirmed' ELSE 'pending' END AS status, rel_type FROM ls")
def linked_assertions(spark, d):
    """Relationships as assertions between mentions, of which those of threats are not linked."""
    return _assertions(spark, d).select("assertion_id", "source_id", "target_id", "status", "rel_type")


@query(f"WITH {ENT}, {REL}, {_ASSERTED} SELECT concat_ws('_', 'osint', s, t, CASE WHEN rel_type <> 'RELATED_TO' THEN rel_type END) AS id, s AS source_id, t AS target_id, rel_type, max(CASE WHEN isnan(confidence) THEN 'Infinity'::DOUBLE ELSE confidence END) AS confidence FROM ls WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t GROUP BY ALL")
def new_edges(spark, d):
    """A confidence of NaN is the greatest, shown here as infinite."""
    e = D.new_edges(_assertions(spark, d), distinct_relationships(spark, d))
    return e.withColumn("confidence", F.when(F.isnan("confidence"), F.lit(float("inf"))).otherwise(F.col("confidence")))


@query(
    f"""WITH {ENT}, n AS (SELECT DISTINCT text AS name FROM mentions WHERE text IS NOT NULL), b AS (SELECT lower(name) AS k, min(id) AS i FROM ent GROUP BY 1)
SELECT n.name, coalesce(e.id, b.i, nullif(substr(regexp_replace(regexp_replace(lower(n.name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), '')) AS id FROM n LEFT JOIN ent e ON e.id = n.name LEFT JOIN b ON b.k = lower(n.name)"""
)
def resolved_entity_ids(spark, d):
    names = table(spark, d, "mentions").where("text IS NOT NULL").select(F.col("text").alias("name")).distinct()
    return D.entity_id_for(names, latest_entities(spark, d).select("id", "name"))


@query(f"""WITH {surfaces('sf', "SELECT text AS x FROM mentions UNION ALL SELECT resolved_entity_id FROM mentions")}, m AS (SELECT DISTINCT document_id AS doc, s AS n, min(mention_id) AS i FROM mentions JOIN sf ON sf.x = text WHERE document_id <> '' AND trim(text) <> '' GROUP BY 1, 2)
SELECT doc, n AS normalized_text, i AS mentions_first FROM m""")
def extracted_mentions(spark, d):
    """Mentions written as the JSON answers of a model, fenced, and read from them again: the first of each surface of a document."""
    m = table(spark, d, "mentions").where("document_id <> ''").select("mention_id", "document_id", "text")
    answers = m.select("document_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct("text", F.col("mention_id").cast("string").alias("mention_id"))).alias("mentions"))), F.lit("\n```")).alias("answer"))
    got, _ = E.parse_answers(answers, "document_id", "answer")
    return got.groupBy("doc", "normalized_text").agg(F.min(F.col("mention_id").cast("long")).alias("mentions_first"))


@query("SELECT hits.id, names.pattern AS longest FROM (SELECT 1) LEFT JOIN (SELECT NULL AS id) hits ON false LEFT JOIN (SELECT NULL AS pattern) names ON false WHERE false UNION ALL SELECT run_id, 'new' FROM (SELECT DISTINCT run_id FROM mentions WHERE run_id IS NOT NULL) m WHERE run_id NOT IN (SELECT run_id FROM search_results WHERE run_id IS NOT NULL) UNION ALL SELECT DISTINCT run_id, 'old' FROM search_results WHERE run_id IS NOT NULL")
def run_registry(spark, d):
    """Runs of the searches, and those of the mentions that are not among them."""
    old = table(spark, d, "search_results").where("run_id IS NOT NULL").select("run_id").distinct().withColumn("longest", F.lit("old"))
    new = table(spark, d, "mentions").where("run_id IS NOT NULL").select("run_id").distinct().withColumn("longest", F.lit("new"))
    return E.start_run(old, new).withColumnRenamed("run_id", "id")


# -- store -----------------------------------------------------------------------------------
@query("""WITH r AS (SELECT DISTINCT id, source_id, target_id, rel_type, created_at, confidence FROM relationships WHERE id IS NOT NULL), k AS (SELECT id, arg_max(struct_pack(s := source_id, t := target_id, c := created_at), struct_pack(a := created_at, b := source_id, c := target_id)) AS n, min(created_at) AS f FROM r WHERE created_at IS NOT NULL GROUP BY id)
SELECT id, n.s AS source_id, n.t AS target_id, f AS created_at FROM k""")
def relationship_upsert(spark, d):
    """Earlier and later versions of each relationship: the last one holds, created when the first was."""
    r = table(spark, d, "relationships").where("id IS NOT NULL AND created_at IS NOT NULL").select("id", "source_id", "target_id", "created_at").distinct()
    first = r.groupBy("id").agg(F.min_by(F.struct("source_id", "target_id", "created_at"), F.struct("created_at", "source_id", "target_id")).alias("r")).select("id", "r.*")
    return S.upsert(first, r.withColumn("o", F.struct("created_at", "source_id", "target_id")), order="o").select("id", "source_id", "target_id", "created_at")


@query(f"WITH {REL} SELECT id FROM rel WHERE id NOT IN (SELECT id FROM rel WHERE rel_type = 'THREATENS')")
def relationship_delete(spark, d):
    r = distinct_relationships(spark, d)
    changes = r.select(F.col("id").alias("entity_key"), F.lit("upsert_relationship").alias("op"), F.col("id").alias("payload"), F.lit(1).alias("n"))
    gone = r.where("rel_type = 'THREATENS'").select(F.col("id").alias("entity_key"), F.lit("delete_relationship").alias("op"), F.lit(None).cast("string").alias("payload"), F.lit(2).alias("n"))
    none = spark.createDataFrame([], "entity_key string, payload string, n int")
    return cdc.apply_changes(none, changes.unionByName(gone), order="n").where("payload IS NOT NULL").select(F.col("entity_key").alias("id")).distinct()


@query(f"""WITH {surfaces('sf', 'SELECT unnest(aliases) AS x FROM entities UNION ALL SELECT name FROM entities')}, o AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(aliases) AS x FROM entities WHERE id IS NOT NULL) JOIN sf USING (x) WHERE s <> ''), n AS (SELECT DISTINCT id, s FROM entities JOIN sf ON sf.x = name WHERE id IS NOT NULL AND s <> '')
SELECT id AS entity_id, s AS normalized_alias, false AS fresh FROM o UNION ALL SELECT id, s, true FROM n WHERE (id, s) NOT IN (SELECT (id, s) FROM o)""")
def missing_aliases(spark, d):
    """Names that are no alias yet are added, aliases stay."""
    e = table(spark, d, "entities").where("id IS NOT NULL")
    form = lambda x: x.withColumn("normalized_alias", X.normalize_surface(F.col("a"))).where("normalized_alias != ''").select("entity_id", "normalized_alias").distinct()
    old = form(e.select(F.col("id").alias("entity_id"), F.explode("aliases").alias("a")))
    new = form(e.select(F.col("id").alias("entity_id"), F.col("name").alias("a")))
    return S.add_missing_aliases(old.withColumn("fresh", F.lit(False)), new.withColumn("fresh", F.lit(True)))


@query("SELECT id AS entity_id, array_to_string(list_sort(list(DISTINCT a)), '|') AS aliases FROM (SELECT id, unnest(aliases) AS a FROM entities WHERE id IS NOT NULL) WHERE a IS NOT NULL GROUP BY id")
def alias_arrays(spark, d):
    a = table(spark, d, "entities").where("id IS NOT NULL").select(F.col("id").alias("entity_id"), F.explode("aliases").alias("alias")).where("alias IS NOT NULL")
    return S.alias_arrays(a).select("entity_id", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT row_number() OVER (ORDER BY created_at NULLS FIRST, mention_id) + 1000 AS serial, mention_id FROM mentions")
def serial_numbers(spark, d):
    return S.number_rows(table(spark, d, "mentions").select("mention_id", "created_at"), "serial", 1000, ["created_at", "mention_id"]).select("serial", "mention_id")


@query("""SELECT mention_id, CASE WHEN mention_id % 40 = 0 THEN 'e' || (mention_id % 7) ELSE resolved_entity_id END AS resolved_entity_id, CASE WHEN mention_id % 40 = 0 THEN 'LINKED' WHEN mention_id % 20 = 0 THEN 'REJECTED' ELSE status END AS status FROM mentions""")
def resolved_reviews(spark, d):
    """Reviews of every twentieth mention: approved with an entity, or rejected without."""
    m = table(spark, d, "mentions").select("mention_id", "text", "resolved_entity_id", "status")
    r = m.where("mention_id % 20 = 0").select(F.col("mention_id").alias("review_id"), "mention_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("notes"))
    yes = F.col("mention_id") % 40 == 0
    dec = r.select("review_id", F.when(yes, "approved").otherwise("rejected").alias("status"), F.when(yes, F.concat(F.lit("e"), (F.col("mention_id") % 7).cast("string"))).alias("entity_id"), F.lit("seen").alias("notes"))
    return S.resolve_reviews(r, m, dec)[1].select("mention_id", "resolved_entity_id", "status")


_TEXT = "concat_ws(chr(10), CASE WHEN trim(name) <> '' THEN name END, CASE WHEN trim(canonical_name) <> '' THEN canonical_name END, CASE WHEN trim(description) <> '' THEN description END)"


@query(f"WITH {ENT} SELECT id, sha256({_TEXT}) AS content_hash FROM ent WHERE entity_type <> 'location'")
def changed_embeddings(spark, d):
    """Locations have vectors of their present text; only the others are embedded."""
    e = latest_entities(spark, d)
    known = e.where("entity_type = 'location'").select("id", X.content_hash(F.col("name"), F.col("canonical_name"), F.col("description")).alias("content_hash"))
    return S.changed_embeddings(e, known, lambda rows: rows.select("id", K.hashed_vector(F.col("text")).alias("embedding"), "content_hash")).select("id", "content_hash")


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents), x AS (SELECT doc_id, unnest(range(1, 33)) AS i, w FROM w), s AS (SELECT doc_id, i, sum(instr('0123456789abcdef', substr(md5(w), i, 1)) - 8.5) AS v FROM x GROUP BY ALL)
SELECT doc_id, round(max(v) / sqrt(sum(v * v)), 6) AS greatest, round(sum(v) / sqrt(sum(v * v)), 6) AS total, count(*) AS dimensions FROM s GROUP BY doc_id""")
def hashed_vectors(spark, d):
    v = let(table(spark, d, "documents").select("doc_id", "title"), {"v": K.hashed_vector(F.col("title"))}).where("size(v) > 0")
    return v.select("doc_id", F.round(F.array_max("v"), 6).alias("greatest"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("v").cast("long").alias("dimensions"))


# -- outbox ------------------------------------------------------------------------------------
_BOX = """box AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'delete_entity' WHEN 1 THEN 'upsert_relationship' ELSE 'upsert_entity' END AS op, CASE WHEN event_id <> 700 THEN user_id::VARCHAR END AS entity_key, props AS payload,
CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' ELSE 'pending' END AS status, event_id % 3 AS attempts, ts AS locked_at FROM events)"""
_NOW = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)


def _box(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select(
        i.alias("id"), F.when(i % 5 == 0, "delete_entity").when(i % 5 == 1, "upsert_relationship").otherwise("upsert_entity").alias("op"), F.when(i != 700, F.col("user_id").cast("string")).alias("entity_key"), F.col("props").alias("payload"),
        F.when(i % 4 == 0, "done").when(i % 4 == 1, "processing").otherwise("pending").alias("status"), (i % 3).cast("int").alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.col("ts").cast("timestamp").alias("locked_at"),
    )


@query(f"WITH {_BOX} SELECT id, op, entity_key FROM box WHERE status = 'pending' ORDER BY id LIMIT 500")
def outbox_pending(spark, d):
    return O.pending(_box(spark, d)).select("id", "op", "entity_key")


@query(f"WITH {_BOX} SELECT id, CASE WHEN status = 'pending' AND id % 2 = 0 THEN 'processing' ELSE status END AS status FROM box")
def outbox_claimed(spark, d):
    b = _box(spark, d)
    return O.claimed(b, b.where("id % 2 = 0").select("id"), _NOW).select("id", "status")


@query(f"WITH {_BOX} SELECT id, CASE WHEN status = 'processing' AND locked_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE THEN 'pending' ELSE status END AS status FROM box")
def outbox_released(spark, d):
    return O.released(_box(spark, d), _NOW).select("id", "status")


_DRAIN = f"""{_BOX}, b AS (SELECT *, CASE WHEN entity_key IS NULL THEN 'no key' END AS f FROM box WHERE status = 'pending' ORDER BY id LIMIT 500), s AS (SELECT min(id) AS bad FROM b WHERE f IS NOT NULL)"""


@query(f"WITH {_DRAIN} SELECT box.id, CASE WHEN b.id IS NOT NULL AND (bad IS NULL OR b.id < bad) THEN 'done' ELSE box.status END AS status, CASE WHEN box.id = bad THEN box.attempts + 1 ELSE box.attempts END AS attempts, CASE WHEN box.id = bad THEN b.f END AS last_error FROM box LEFT JOIN b ON b.id = box.id CROSS JOIN s")
def outbox_drained(spark, d):
    """After one drain of at most 500 rows, which stops at the row without a key."""
    return O.drained(_box(spark, d))[1].select("id", "status", "attempts", "last_error")


@query(f"WITH {_DRAIN} SELECT entity_key, arg_max(struct_pack(p := CASE WHEN op LIKE 'delete%' THEN NULL ELSE payload END), id).p AS payload, max(id) AS id FROM b, s WHERE bad IS NULL OR b.id < bad GROUP BY entity_key")
def outbox_projected(spark, d):
    """The projection after it: the last change of each key; a deleted key is a row without payload."""
    none = spark.createDataFrame([], "entity_key string, payload string, id long")
    return cdc.apply_changes(none, checkpoint(O.drained(_box(spark, d))[0]))


@query("SELECT event_id AS id FROM events WHERE event_id % 6 = 0")
def parsed_envelopes(spark, d):
    """Change envelopes as JSON texts of a topic, among texts that are none."""
    e, i = table(spark, d, "events"), F.col("event_id")
    env = F.to_json(F.struct(F.lit("c").alias("op"), F.struct(i.alias("id"), F.lit("pending").alias("status")).alias("after")))
    raw = e.select(F.when(i % 6 == 0, env).when(i % 6 == 1, F.lit("{broken")).when(i % 6 == 2, F.lit("")).otherwise(F.lit('{"op":"r"}')).alias("value"))
    return cdc.triggers(cdc.parse_envelopes(raw))


# -- risk and findings -----------------------------------------------------------------------------
_EXPOSED = f"{levels(5, chr(83) + 'ELECT DISTINCT id AS node FROM ent WHERE entity_type = ' + chr(39) + 'threat' + chr(39))}"
_ASSESS = f"""{ADJ}, {_EXPOSED}, x AS (SELECT CASE WHEN hops IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0::DOUBLE, 1::DOUBLE - (hops - 1) * 0.2::DOUBLE), 2) END AS e FROM ent LEFT JOIN reach ON node = ent.id WHERE entity_type = 'organization'),
p AS (SELECT greatest(0, least(1, e)) AS s, row_number() OVER (ORDER BY e DESC) AS k, count(*) OVER () AS n FROM x WHERE e > 0), up AS (SELECT round(avg(s), 4) AS u FROM p WHERE k <= ceil(n / 2.0)),
az AS (SELECT round(avg({_UNIT.format('confidence')}), 4) AS a, count(*) AS threatens FROM rel WHERE rel_type = 'THREATENS'), hi AS (SELECT count(*) AS high FROM x WHERE e >= 0.6)"""


@query(f"WITH {_ASSESS}, s AS (SELECT round(CAST(coalesce(0.6::DOUBLE * u + 0.4::DOUBLE * a, u, a) AS DECIMAL(12, 8)), 2)::DOUBLE AS score, CASE WHEN u IS NOT NULL AND a IS NOT NULL THEN 'graph_exposure+assertions' WHEN u IS NOT NULL THEN 'graph_exposure' ELSE 'assertions' END AS basis, high, threatens FROM up, az, hi) SELECT score, {_BAND.format('score')} AS level, basis, high AS high_exposures, threatens, (CASE WHEN threatens > 0 THEN 1 ELSE 0 END) + (CASE WHEN high > 0 THEN 1 ELSE 0 END) + 1 AS escalations, CASE WHEN high = 0 THEN 1 ELSE 0 END AS mitigations FROM s")
def risk_assessment(spark, d):
    """Exposures of the organizations and all asserted threats against the prior of the catalogue; four sources."""
    g, t = graph_of(spark, d), K.threat_catalogue(latest_entities(spark, d))
    told = distinct_relationships(spark, d).where("rel_type = 'THREATENS'")
    a = R.indicators(R.assess(G.exposure_report(g), told, R.risk_matrix(t)), sources=4)
    return a.select("score", "level", "basis", "high_exposures", "threatens", F.size("escalation").cast("long").alias("escalations"), F.size("mitigation").cast("long").alias("mitigations"))


@query(f"WITH {REL} SELECT rel_type, round(CAST((avg({_UNIT.format('confidence')}) + least(1.0, 0.5 + 0.05 * least(count(*), 10))) / 2 AS DECIMAL(12, 8)), 4)::DOUBLE AS confidence FROM rel GROUP BY rel_type")
def evidence_confidence(spark, d):
    """How sure the assertions of each type are, by their mean confidence and their number."""
    g = distinct_relationships(spark, d).groupBy("rel_type").agg(F.avg(X.unit(F.col("confidence"))).alias("m"), F.count("*").alias("n"))
    return g.select("rel_type", R.evidence_confidence(F.col("m"), F.col("n")).alias("confidence"))


@query(f"WITH {ENT} SELECT id, typed.threat_type AS category, typed.severity AS severity, {_SEV.replace('severity', 'typed.severity')} AS weight FROM ent WHERE entity_type = 'threat'")
def threat_catalogue(spark, d):
    t = K.threat_catalogue(latest_entities(spark, d))
    return t.select("id", "category", "severity", R.severity_weight(F.col("severity")).alias("weight"))


@query(
    f"""WITH {ENT}, t AS (SELECT typed.threat_type AS category, typed.severity AS severity, typed.likelihood AS confidence FROM ent WHERE entity_type = 'threat' ORDER BY CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, confidence DESC NULLS LAST, category NULLS FIRST LIMIT 3),
p AS (SELECT name, {_UNIT.format('confidence')} AS r FROM ent WHERE entity_type = 'event' AND name IS NOT NULL)
SELECT printf('%s threat of %s severity (confidence %.2f)', category, severity, confidence) AS finding FROM t UNION ALL (SELECT 'Precedent: ' || name FROM p ORDER BY r DESC, name DESC LIMIT 1)"""
)
def threat_findings(spark, d):
    e = latest_entities(spark, d)
    return E.threat_findings(K.threat_catalogue(e), K.precedents(e).where("title IS NOT NULL"))


@query(f"WITH {ENT} SELECT id, repeat('#', floor(confidence * 20)::INT) AS bar FROM ent WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)")
def text_bars(spark, d):
    return latest_entities(spark, d).where("confidence BETWEEN 0 AND 1").select("id", X.bar(F.col("confidence")).alias("bar"))


@query(f"WITH {ENT}, {REL}, dg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel WHERE source_id IS DISTINCT FROM target_id) WHERE id <> '' GROUP BY id), h AS (SELECT name, coalesce(n, 0) AS n FROM ent LEFT JOIN dg USING (id) ORDER BY 2 DESC, ent.id LIMIT 1) SELECT name || ' is the best connected entity (' || n || ' edges)' AS finding FROM h UNION ALL SELECT 'The graph holds ' || (SELECT count(*) FROM ent) || ' entities and ' || (SELECT count(*) FROM rel) || ' relationships'")
def graph_findings(spark, d):
    from .plans.workflow import graph_findings as say

    g = graph_of(spark, d)
    part = {"hubs": [r.asDict() for r in G.hubs(g, 1).collect()], "vertices": g.vertices.count(), "edges": g.edges.count()}
    return spark.createDataFrame([(x,) for x in say(part)], "finding string")


@query(f"WITH {ENT}, f AS (SELECT id, name FROM ent WHERE lower(name) = (SELECT lower(min(name)) FROM ent WHERE length(trim(name)) >= 3)) SELECT id, name FROM f ORDER BY id LIMIT 8")
def focus_of_question(spark, d):
    """The vertices named in a question that holds one name."""
    from .plans.workflow import focus_of

    g = graph_of(spark, d)
    first = g.vertices.where(F.length(F.trim("name")) >= 3).agg(F.min("name")).head()[0] or ""
    got = focus_of(g, f"What about {first}?")
    return got.where(F.lower("name") == first.lower()).select("id", "name")


@query("SELECT feed, agent, n FROM (SELECT feed, CASE WHEN score >= 0.5 THEN 'sure' ELSE 'unsure' END AS agent, count(*) AS n FROM (SELECT DISTINCT feed, score, run_id FROM search_results WHERE score IS NOT NULL) GROUP BY 1, 2)")
def timeline_union(spark, d):
    """Rows of two lists, each once: the union of what both tell."""
    r = table(spark, d, "search_results").where("score IS NOT NULL").select("feed", "score", "run_id")
    sure, rest = r.where("score >= 0.5 OR isnan(score)"), r
    every = sure.unionByName(rest).dropDuplicates(["feed", "score", "run_id"])
    return every.groupBy("feed", F.when((F.col("score") >= 0.5), "sure").otherwise("unsure").alias("agent")).agg(F.count("*").alias("n"))


@query("SELECT mention_id, context_500 FROM (SELECT mention_id, substr(context, 1, 500) AS context_500 FROM mentions) WHERE context_500 IS NOT NULL")
def truncated_contexts(spark, d):
    return table(spark, d, "mentions").where("context IS NOT NULL").select("mention_id", X.truncated(F.col("context"), 500).alias("context_500"))


@query("SELECT doc_id, nullif(trim(text), '') IS NULL AS blank, concat_ws('. ', 1::VARCHAR, trim(split_part(trim(text), '. ', 1)) || '.') AS bullet FROM documents WHERE text IS NOT NULL")
def numbered_bullets(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.nullif(F.trim("text"), F.lit("")).isNull().alias("blank"), X.numbered(F.array(F.concat(F.trim(F.substring_index(F.trim("text"), ". ", 1)), F.lit("."))))[0].alias("bullet"))


@query(f"WITH {ENT} SELECT DISTINCT a.source, a.confidence AS top, round(a.confidence - coalesce(b.confidence, 0), 4) AS margin FROM (SELECT source, confidence, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, id) AS n FROM ent WHERE confidence BETWEEN 0 AND 1) a LEFT JOIN (SELECT source, confidence, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, id) AS n FROM ent WHERE confidence BETWEEN 0 AND 1) b ON a.source IS NOT DISTINCT FROM b.source AND b.n = 2 WHERE a.n = 1")
def margin_to_runner_up(spark, d):
    """The decision's margin, with sources as mentions and entities as their candidates."""
    from .operators.linking import decide

    e = latest_entities(spark, d).where("confidence BETWEEN 0 AND 1").withColumn("source", F.coalesce("source", F.lit("\x00")))
    ranked = e.select(F.col("source").alias("mention_id"), "id", F.col("confidence").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "id")))
    got = decide(ranked, ranked.select("mention_id", F.lit(0.5).alias("confidence")).distinct())
    return got.select(F.nullif("mention_id", F.lit("\x00")).alias("source"), F.col("score").alias("top"), "margin")


# -- snapshots, seed, query language, workflow -------------------------------------------------------
@query(f"WITH {EDG} SELECT 'entities ' || entity_type AS kind, count(*) AS n FROM ent GROUP BY 1 UNION ALL SELECT 'relationships', count(*) FROM rel UNION ALL SELECT 'upserted', count(*) FROM ent")
def snapshot_round_trip(spark, d):
    """The graph written as a snapshot into the shared folder, read from it, and upserted into a store."""
    import uuid

    from .session import shared_dir
    from .sources.tables import export_snapshot, import_snapshot, restore_snapshot

    g = graph_of(spark, d)
    at = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    export_snapshot(g, at)
    back = import_snapshot(spark, at, g.vertices.schema, g.edges.schema)
    store = S.Store(spark, f"{at}/store")
    for _ in range(2):
        restore_snapshot(store, back)
    kinds = back.vertices.groupBy(F.concat(F.lit("entities "), "entity_type").alias("kind")).agg(F.count("*").alias("n"))
    rest = spark.createDataFrame([("relationships", back.edges.count()), ("upserted", store.read("entities").count())], "kind string, n long")
    return kinds.unionByName(rest)


@query("SELECT * FROM (VALUES ('organization', 6), ('location', 1), ('threat', 1), ('edges', 8)) t(kind, n)")
def seed_counts(spark, d):
    """The trial graph, where the tables hold none."""
    from .sources.seed import seeded

    g = graph_of(spark, d)
    s = seeded(spark, g.vertices.where("false"), g.edges.where("false"))
    e = s.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n")
    return s.vertices.groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(e)


@query(f"WITH {ENT} SELECT 'upsert_entity' AS op, id AS entity_key, 'pending' AS status, name FROM ent")
def outbox_of_changes(spark, d):
    rows = O.outbox_rows(latest_entities(spark, d).select("id", "name", "entity_type"), "upsert_entity")
    return rows.select("op", "entity_key", "status", F.get_json_object("payload", "$.name").alias("name"))


@query(f"WITH {ENT} SELECT id, name FROM ent WHERE id IN (SELECT min(id) FROM ent GROUP BY entity_type) ORDER BY id LIMIT 50")
def cypher_unwind(spark, d):
    """A list given as a parameter, unwound and looked up."""
    from .plans.cypher import compile_query

    g = graph_of(spark, d)
    ids = [r[0] for r in g.vertices.groupBy("entity_type").agg(F.min("id")).select("min(id)").collect()]
    return compile_query(g, "UNWIND $ids AS i MATCH (n {id: i}) RETURN n.id AS id, n.name AS name ORDER BY id LIMIT 50", {"ids": ids})


#: Texts and whether they are a bounded read.
_CHECKS = (
    ("MATCH (n) RETURN n.id AS id LIMIT 10", True), ("MATCH (n) RETURN n.id AS id", False), ("MATCH (n) DELETE n", False), ("", False), ("CALL db.labels()", False),
    ("MATCH (n) RETURN n.id AS id LIMIT 5; MATCH (m) RETURN m.id AS id LIMIT 5", False), ("MATCH (a)-[r:OWNS]->(b) RETURN a.id AS id LIMIT 10", True), ("MATCH (a)-[r:HATES]->(b) RETURN a.id AS id LIMIT 10", False),
    ("MATCH (a)-[*1..9]-(b) RETURN a.id AS id LIMIT 10", False), ("MATCH (n) WHERE n.id = $x RETURN n.id AS id LIMIT 10", False), ("MATCH (n) RETURN n.id AS id LIMIT 100000", False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {str(ok).lower()})" for t, ok in _CHECKS) + ") t(text, accepted)")
def cypher_checks(spark, d):
    from .plans.cypher import Rejected, validate

    def ok(text: str) -> bool:
        try:
            validate(text)
        except Rejected:
            return False
        return True

    return spark.createDataFrame([(t, ok(t)) for t, _ in _CHECKS], "text string, accepted boolean")


@query(f"WITH {ADJ}, i AS (SELECT min(id) AS id FROM ent WHERE entity_type = 'threat') SELECT source, rel, target FROM (SELECT a.src AS source, a.rel_type AS rel, a.dst AS target FROM i JOIN adj a ON a.src = i.id ORDER BY source, target, rel LIMIT 20)")
def agent_loop(spark, d):
    """The default plan of the search loop, once, for the first threat."""
    from .plans.cypher import search_loop

    g = graph_of(spark, d)
    first = U.by_type(g.vertices, "threat").agg(F.min("id")).head()[0]
    rows = [r for h in search_loop(g, [first] if first else [], row_limit=20)["rounds"] for r in h.get("rows", ())]
    return spark.createDataFrame([(r["source"], r["rel"], r["target"]) for r in rows], "source string, rel string, target string")


@query(f"WITH {ADJ}, {_EXPOSED} SELECT e.id, e.name, r.hops FROM ent e JOIN reach r ON r.node = e.id WHERE e.entity_type = 'organization' AND r.hops <= 5 ORDER BY r.hops, e.id LIMIT 10")
def most_exposed(spark, d):
    g = graph_of(spark, d)
    return G.exposure_report(g).where("exposure_score > 0").orderBy(F.desc("exposure_score"), "id").limit(10).select("id", "name", "hops")


@query(f"WITH {ENT}, m AS (SELECT resolved_entity_id AS id, text, confidence FROM mentions WHERE resolved_entity_id IS NOT NULL AND text IS NOT NULL), {surfaces('sf', 'SELECT text AS x FROM mentions UNION ALL SELECT name FROM ent')} SELECT DISTINCT m.id AS entity_id, a.s AS normalized_alias FROM m JOIN ent e ON e.id = m.id JOIN sf a ON a.x = m.text LEFT JOIN sf b ON b.x = e.name WHERE a.s <> '' AND a.s <> coalesce(b.s, '')")
def alias_write_back(spark, d):
    """Surfaces of resolved mentions that are not the name of their entity."""
    m = table(spark, d, "mentions").select("mention_id", "text", F.col("resolved_entity_id").alias("id"), "confidence")
    dec = m.where("id IS NOT NULL").select("mention_id", F.lit("LINKED").alias("status"), "id")
    return E.surface_aliases(dec, m.drop("id"), latest_entities(spark, d)).select("entity_id", "normalized_alias").distinct()


@query("SELECT * FROM (VALUES (1, 'gulf shipping'), (2, 'gulf shipping latest developments'), (3, 'gulf shipping risk assessment')) t(n, search)")
def query_expansion(spark, d):
    return spark.createDataFrame(list(enumerate(D.expand_query("  gulf   shipping "), 1)), "n int, search string")


@query("SELECT * FROM (VALUES (1, 'coordinator'), (2, 'collect'), (3, 'analyse'), (4, 'assess'), (5, 'brief')) t(n, step)")
def workflow_steps(spark, d):
    """A whole run from question to briefing; the steps that it yields, one after another."""
    from .plans.workflow import stream

    g = graph_of(spark, d)
    docs = table(spark, d, "search_results").select("result_id", "url", "content", "score")
    search = lambda q: docs.where(F.contains(F.lower("content"), F.lit(q.split()[0].lower())))
    steps = [name for name, _ in stream(g, "gulf shipping", search, K.threat_catalogue(latest_entities(spark, d)))]
    return spark.createDataFrame(list(enumerate(steps, 1)), "n int, step string")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(("EXECUTIVE SUMMARY", "KEY FINDINGS", "GRAPH", "RISK", "EXPOSURE", "POSTURE", "RECOMMENDATIONS", "OUTLOOK"), 1)) + ") t(n, section)")
def briefing_sections(spark, d):
    """The sections of a briefing without any result, as its text holds them."""
    from .plans.workflow import briefing

    heads = re.findall(r"^(\d+)\. ([A-Z ]+)$", briefing("gulf", None, None, []), re.M)
    return spark.createDataFrame([(int(n), h) for n, h in heads], "n int, section string")
