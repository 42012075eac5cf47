"""Named queries of entity linking, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import ADJ, ENT, query
from .functions import text as X
from .operators import extraction as E
from .operators import graph as G
from .operators import linking as L
from .plans.sqltext import surfaces, trigrams
from .session import checkpoint, table
from .sources import store as S
from .sources.tables import graph_of, latest_entities

MENTION_TEXTS = "SELECT text AS x FROM mentions"
FORM_TEXTS = "SELECT unnest(list_concat([name, canonical_name], coalesce(aliases, []))) AS x FROM ent"
#: sf(x, s): surfaces of all texts; forms(id, entity_type, form); asked(mention_id, t).
BASE = f"""{ENT}, {surfaces('sf', f'{MENTION_TEXTS} UNION ALL {FORM_TEXTS}')},
forms AS (SELECT DISTINCT id, entity_type, s AS form FROM (SELECT id, entity_type, unnest(list_concat([name, canonical_name], coalesce(aliases, []))) AS x FROM ent) JOIN sf USING (x) WHERE s <> ''),
asked AS (SELECT mention_id, s AS t FROM mentions JOIN sf ON sf.x = text WHERE s <> '')"""
EXACT = "exact AS (SELECT DISTINCT mention_id, id FROM asked JOIN forms ON form = t)"


def _fuzzy(texts: str) -> str:
    """fuzzy(t, id, fuzzy): the twenty best of each text of `texts` (t)."""
    return f"""ft AS (SELECT t, unnest({trigrams('t')}) AS g, len({trigrams('t')}) AS n FROM ({texts})), ff AS (SELECT form, unnest({trigrams('form')}) AS g, len({trigrams('form')}) AS k FROM (SELECT DISTINCT form FROM forms)),
fs AS (SELECT t, form, n, k, count(*) AS c FROM ft JOIN ff USING (g) WHERE least(n, k) >= 0.15 * greatest(n, k) GROUP BY ALL), fb AS (SELECT t, id, max(c / (n + k - c)) AS fuzzy FROM fs JOIN forms USING (form) WHERE c / (n + k - c) >= 0.15 GROUP BY ALL),
fuzzy AS (SELECT t, id, fuzzy FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY fuzzy DESC, id) AS r FROM fb) WHERE r <= 20)"""


#: bm(t, id, fulltext) of the texts bt(t).
BM25 = f"""{surfaces('sd', "SELECT concat_ws(' ', name, canonical_name, array_to_string(list_filter(aliases, lambda a: a IS NOT NULL), ' '), description) AS x FROM ent")},
bd AS (SELECT id, list_filter(string_split(s, ' '), lambda w: w <> '') AS ws FROM (SELECT id, concat_ws(' ', name, canonical_name, array_to_string(list_filter(aliases, lambda a: a IS NOT NULL), ' '), description) AS x FROM ent) JOIN sd USING (x)),
bone AS (SELECT count(*) AS many, avg(len(ws)) AS mean FROM bd), bh AS (SELECT id, dl, w, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS w FROM bd) GROUP BY ALL), bf AS (SELECT w, count(*) AS df FROM bh GROUP BY w),
bp AS (SELECT bh.w, id, ln(1 + (many - df + 0.5) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS s, df > 0.1 * many AS stop FROM bh JOIN bf USING (w), bone),
bm0 AS (SELECT t, id, s, stop FROM (SELECT t, unnest(list_distinct(string_split(t, ' '))) AS w FROM bt) JOIN bp USING (w)), bm1 AS (SELECT t, id, round(sum(s), 6) AS fulltext FROM bm0 WHERE (t, id) IN (SELECT (t, id) FROM bm0 WHERE NOT stop) GROUP BY ALL),
bm AS (SELECT t, id, fulltext FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY fulltext DESC, id) AS r FROM bm1) WHERE r <= 20)"""


@query(f"WITH {surfaces('sf', MENTION_TEXTS)} SELECT mention_id, s AS surface, replace(s, ' ', '') AS compact FROM mentions LEFT JOIN sf ON sf.x = text")
def normalized_surfaces(spark, d):
    return table(spark, d, "mentions").select("mention_id", X.normalize_surface(F.col("text")).alias("surface"), X.compact_surface(F.col("text")).alias("compact"))


@query(f"WITH {BASE}, {EXACT} SELECT * FROM exact")
def exact_candidates(spark, d):
    return L.exact_candidates(table(spark, d, "mentions"), L.name_forms(latest_entities(spark, d))).select("mention_id", "id").distinct()


_DIRECT = "direct AS (SELECT mention_id, e.id FROM {0} JOIN ent e ON e.id = text WHERE len(coalesce(expected_types, [])) = 0 OR list_contains(expected_types, e.entity_type))"
_IDS = "(SELECT * FROM mentions UNION ALL BY NAME SELECT mention_id + 10000000000 AS mention_id, resolved_entity_id AS text, expected_types FROM mentions)"


@query(f"WITH {ENT}, {_DIRECT.format(_IDS)} SELECT mention_id, id FROM direct")
def direct_candidates(spark, d):
    """Mentions, and once more with the id that they are resolved to as their text."""
    m = table(spark, d, "mentions").select("mention_id", "text", "expected_types", "resolved_entity_id")
    ids = m.select((F.col("mention_id") + 10_000_000_000).alias("mention_id"), F.col("resolved_entity_id").alias("text"), "expected_types")
    return L.direct_candidates(m.drop("resolved_entity_id").unionByName(ids), latest_entities(spark, d)).select("mention_id", "id")


@query(
    f"""WITH {ENT}, j AS (SELECT m.mention_id, m.resolved_entity_id AS id, m.text IS NULL OR e.name IS NULL AS none, {trigrams('m.text')} AS a, {trigrams('e.name')} AS b FROM mentions m JOIN ent e ON e.id = m.resolved_entity_id)
SELECT mention_id, id, CASE WHEN none THEN NULL WHEN len(a) + len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM j"""
)
def trigram_similarity(spark, d):
    return L.similarity_of_names(table(spark, d, "mentions"), latest_entities(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {BASE}, q AS (SELECT * FROM asked WHERE mention_id % 20 = 0), {_fuzzy('SELECT DISTINCT t FROM q')} SELECT mention_id, id, CASE WHEN fuzzy = 1 THEN 1.0 ELSE 0.0 END AS exact, round(fuzzy, 6) AS fuzzy FROM q JOIN fuzzy USING (t)")
def trigram_candidates(spark, d):
    """The stated query set: mentions whose id is divisible by 20."""
    m = table(spark, d, "mentions").where("mention_id % 20 = 0")
    return L.fuzzy_candidates(m, L.name_forms(latest_entities(spark, d))).withColumn("fuzzy", F.round("fuzzy", 6))


@query(f"WITH {BASE}, q AS (SELECT * FROM asked WHERE mention_id % 20 = 0), bt AS (SELECT DISTINCT t FROM q), {BM25} SELECT mention_id, id, fulltext FROM q JOIN bm USING (t)")
def fulltext_candidates(spark, d):
    """The stated query set: mentions whose id is divisible by 20."""
    m = table(spark, d, "mentions").where("mention_id % 20 = 0")
    return L.fulltext_candidates(m, latest_entities(spark, d))


_VEC = """vq AS (SELECT mention_id, e.embedding::DOUBLE[] AS v FROM mentions m JOIN ent e ON e.id = m.resolved_entity_id WHERE mention_id % 200 = 0 AND len(e.embedding) = 64), ve AS (SELECT id, embedding::DOUBLE[] AS v FROM ent WHERE len(embedding) = 64),
vs AS (SELECT mention_id, id, list_dot_product(vq.v, ve.v) / (sqrt(list_dot_product(vq.v, vq.v)) * sqrt(list_dot_product(ve.v, ve.v))) AS c FROM vq, ve),
vr AS (SELECT mention_id, id, round(c, 6) AS vector FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY round(c, 6) DESC, id) AS r FROM vs WHERE c > 0 AND NOT isnan(c)) WHERE r <= 20)"""


@query(
    """WITH q AS (SELECT vec_id AS mention_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT mention_id, vec_id AS id, list_dot_product(q.v::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS c
FROM q, embeddings e) SELECT mention_id, id, round(c, 6) AS vector FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY c DESC, id) AS n FROM s WHERE c > 0) WHERE n <= 5"""
)
def cosine_topk(spark, d):
    """The stated query set: vectors whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("mention_id"), F.col("embedding").alias("v"))
    got = L.vector_candidates(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), top=5)
    return got.withColumn("vector", F.round("vector", 6))


@query(
    f"""WITH {BASE}, q AS (SELECT * FROM asked WHERE mention_id % 200 = 0), bt AS (SELECT DISTINCT t FROM q), {BM25}, {_VEC},
u AS (SELECT mention_id, id, max(fulltext) AS fulltext, max(vector) AS vector FROM (SELECT mention_id, id, fulltext, 0 AS vector FROM q JOIN bm USING (t) UNION ALL SELECT mention_id, id, 0, vector FROM vr) GROUP BY ALL)
SELECT mention_id, id, fulltext, vector FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY greatest(fulltext, vector) DESC, id) AS r FROM u) WHERE r <= 20"""
)
def graph_route(spark, d):
    """Full text and vectors of a stated query set, mentions whose id is divisible by 200; a mention's vector is that of what it is resolved to."""
    v, m = latest_entities(spark, d), table(spark, d, "mentions").where("mention_id % 200 = 0")
    own = v.select("id", F.col("embedding").alias("v")).where("size(v) = 64")
    asked = m.select("mention_id", F.col("resolved_entity_id").alias("id")).join(own, "id").select("mention_id", "v")
    near = L.vector_candidates(asked, own, digits=6)
    return L.graph_candidates(L.fulltext_candidates(m, v), near)


@query(r"""SELECT mention_id, CASE WHEN trim(regexp_replace(text, '[\s\x{85}\p{Z}]+', ' ', 'g')) = '' THEN '""' ELSE trim(regexp_replace(regexp_replace(text, '[\s\x{85}\p{Z}]+', ' ', 'g'), '([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', '\\\1', 'g')) END AS q FROM mentions WHERE text IS NOT NULL""")
def escaped_queries(spark, d):
    m = table(spark, d, "mentions").where("text IS NOT NULL")
    return m.select("mention_id", L.escape_query(F.col("text")).alias("q"))


@query("SELECT mention_id, concat_ws(chr(10), CASE WHEN trim(text) <> '' THEN text END, CASE WHEN trim(context) <> '' THEN context END, CASE WHEN len(expected_types) > 0 THEN array_to_string(expected_types, ' ') END) AS text FROM mentions")
def mention_embedding_texts(spark, d):
    m = table(spark, d, "mentions")
    types = F.when(F.size("expected_types") > 0, F.array_join("expected_types", " "))
    return m.select("mention_id", X.content_text(F.col("text"), F.col("context"), types).alias("text"))


# -- fusion, coherence, decision ----------------------------------------------------
_FUSE = """round(CAST(0.35::DOUBLE * least(1, exact) + 0.15::DOUBLE * least(1, fulltext) + 0.20::DOUBLE * least(1, vector) + 0.15::DOUBLE * least(1, fuzzy) + 0.10::DOUBLE * type + 0.05::DOUBLE * coherence AS DECIMAL(12, 8)), 4)::DOUBLE"""
_RANKED = """{0}a AS (SELECT r.*, CASE WHEN len(coalesce(m.expected_types, [])) = 0 OR list_contains(m.expected_types, e.entity_type) THEN 1 ELSE 0 END AS type FROM {1} r JOIN mentions m USING (mention_id) JOIN ent e USING (id)),
{0}b AS (SELECT *, CASE WHEN exact >= 1 AND type > 0 THEN greatest(""" + _FUSE + """, 0.97) ELSE """ + _FUSE + """ END AS score FROM {0}a), {0} AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS rank FROM {0}b)"""
_ROUTES = f"""{EXACT}, {_DIRECT.format('mentions')}, {_fuzzy('SELECT DISTINCT t FROM asked')}, bt AS (SELECT DISTINCT t FROM asked), {BM25},
u AS (SELECT mention_id, id, max(exact)::DOUBLE AS exact, max(fulltext)::DOUBLE AS fulltext, 0::DOUBLE AS vector, max(fuzzy)::DOUBLE AS fuzzy, 0::DOUBLE AS coherence FROM (SELECT mention_id, id, 1.0 AS exact, 0.0 AS fulltext, 1.0 AS fuzzy FROM exact
 UNION ALL SELECT mention_id, id, 1.0, 0.0, 1.0 FROM direct UNION ALL SELECT mention_id, id, CASE WHEN fuzzy = 1 THEN 1 ELSE 0 END, 0, fuzzy FROM asked JOIN fuzzy USING (t) UNION ALL SELECT mention_id, id, 0, fulltext, 0 FROM asked JOIN bm USING (t)) GROUP BY ALL)"""
_COHERE = """best AS (SELECT m.document_id AS g, r.mention_id, r.id FROM r1 r JOIN mentions m USING (mention_id) WHERE r.rank <= 5 AND m.document_id <> ''), pr AS (SELECT DISTINCT a.g, a.mention_id, a.id, b.id AS other FROM best a JOIN best b ON a.g = b.g AND a.mention_id <> b.mention_id),
pd AS (SELECT DISTINCT id, other FROM pr), ed AS (SELECT src AS id, dst AS other, count(*) AS w FROM adj GROUP BY ALL), st AS (SELECT DISTINCT src, dst FROM adj WHERE src <> dst), ci AS (SELECT DISTINCT id FROM pd),
h1 AS (SELECT id, dst AS x FROM ci JOIN st ON src = id), h2 AS (SELECT DISTINCT id, dst AS x FROM h1 JOIN st ON src = x), h3 AS (SELECT DISTINCT h.id, p.other FROM pd p JOIN st ON st.src = p.other JOIN h2 h ON h.id = p.id AND h.x = st.dst),
w AS (SELECT p.id, p.other, CASE WHEN e.w IS NOT NULL THEN e.w WHEN p.id = p.other OR a.id IS NOT NULL OR b.id IS NOT NULL OR c.id IS NOT NULL THEN 1 ELSE 0 END AS w FROM pd p LEFT JOIN ed e ON e.id = p.id AND e.other = p.other LEFT JOIN h1 a ON a.id = p.id AND a.x = p.other
 LEFT JOIN h2 b ON b.id = p.id AND b.x = p.other LEFT JOIN h3 c ON c.id = p.id AND c.other = p.other), co AS (SELECT mention_id, pr.id, least(1.0, sum(w) / 2) AS coherence FROM pr JOIN w ON w.id = pr.id AND w.other = pr.other GROUP BY ALL)"""
_DECIDED = """top AS (SELECT mention_id, max(score) FILTER (WHERE rank = 1) AS score, coalesce(max(score) FILTER (WHERE rank = 2), 0) AS second, max(id) FILTER (WHERE rank = 1) AS best FROM r2 GROUP BY 1),
dec AS (SELECT m.mention_id, CASE WHEN best IS NULL THEN 'NIL' WHEN score >= 0.72 AND round(score - second, 4) >= 0.08 THEN 'LINKED' ELSE 'AMBIGUOUS' END AS status, best, score, round(score - second, 4) AS margin FROM mentions m LEFT JOIN top USING (mention_id))"""
LINKED = f"""{BASE}, {ADJ[len(ENT) + 2:]}, {_ROUTES}, {_RANKED.format('r1', 'u')}, {_COHERE},
u2 AS (SELECT u.* EXCLUDE (coherence), coalesce(co.coherence, 0) AS coherence FROM u LEFT JOIN co USING (mention_id, id)), {_RANKED.format('r2', 'u2')}, {_DECIDED}"""


def _best(spark, d, keep=5, grouped=False):
    """(mentions, best candidates of each): all routes but that of vectors, as the tables hold none of mentions. grouped: mentions of documents only."""
    m, g = table(spark, d, "mentions"), graph_of(spark, d)
    m = m.where("document_id <> ''") if grouped else m
    v = checkpoint(g.vertices.select("id", "name", "canonical_name", "aliases", "description", "entity_type"))
    return m, L.best_linked(m, G.Graph(v, g.edges), F.nullif(F.col("document_id"), F.lit("")), keep)


@query(f"WITH {LINKED} SELECT mention_id, id, exact, fulltext, round(fuzzy, 6) AS fuzzy, type::DOUBLE AS type, coherence::DOUBLE AS coherence, score::DOUBLE AS score, rank FROM r2 WHERE rank <= 5")
def reranked_candidates(spark, d):
    """The five best of all routes merged, fused, made coherent and ranked again."""
    c = L.ranked_rows(_best(spark, d)[1])
    return c.select("mention_id", "id", "exact", "fulltext", F.round("fuzzy", 6).alias("fuzzy"), "type", "coherence", "score", "rank")


@query(f"WITH {LINKED} SELECT mention_id, id, coherence::DOUBLE AS coherence FROM co WHERE coherence > 0")
def coherence_scores(spark, d):
    """A mention without a document is coherent with nothing."""
    return L.ranked_rows(_best(spark, d, grouped=True)[1].select("mention_id", "ids", "coherence")).where("coherence > 0").select("mention_id", "id", "coherence")


@query(f"WITH {LINKED} SELECT mention_id, status, CASE WHEN status = 'LINKED' THEN best END AS id, score::DOUBLE AS score, margin::DOUBLE AS margin FROM dec")
def link_decision(spark, d):
    m, best = _best(spark, d)
    return L.decide(best, m)


@query(f"WITH {LINKED} SELECT d.mention_id, 'pending' AS status, (SELECT string_agg(r.id, '|' ORDER BY r.rank) FROM r2 r WHERE r.mention_id = d.mention_id AND r.rank <= 10) AS candidates FROM dec d WHERE status IN ('AMBIGUOUS', 'NIL')")
def review_queue(spark, d):
    m, best = _best(spark, d, 10)
    q = E.review_queue(L.decide(best.select("mention_id", "ids", "score", F.col("ids").alias("candidates")), m, also=("candidates",)))
    return q.select("mention_id", "status", F.array_join("candidates", "|").alias("candidates"))


@query(f"WITH {LINKED} SELECT d.mention_id, d.status, m.text, d.score::DOUBLE AS score FROM dec d JOIN mentions m USING (mention_id) WHERE d.status = 'AMBIGUOUS'")
def review_join(spark, d):
    m, best = _best(spark, d)
    return E.pending_reviews(L.decide(best, m).select("mention_id", "status", "score"), m, "AMBIGUOUS").select("mention_id", "status", "text", "score")


@query(f"WITH {LINKED} SELECT mention_id, CASE WHEN status = 'AMBIGUOUS' THEN 'LINKED' ELSE status END AS status, CASE WHEN status <> 'NIL' THEN best END AS id, (CASE WHEN status = 'AMBIGUOUS' THEN greatest(score, 0.75) ELSE score END)::DOUBLE AS score FROM dec")
def adjudicated_decisions(spark, d):
    """An adjudicator that always names the first candidate."""
    m, best = _best(spark, d)
    best = checkpoint(best.select("mention_id", "ids", "score"))
    first = lambda rows: rows.where("rank = 1").select("mention_id", "id")
    return E.adjudicated(L.decide(best, m), L.ranked_rows(best), first).select("mention_id", "status", "id", "score")


# -- aliases and new entities ----------------------------------------------------------
@query(
    f"""WITH {surfaces('sf', 'SELECT unnest(aliases) AS x FROM entities')}, a AS (SELECT id AS entity_id, unnest(aliases) AS alias, CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence, source FROM entities WHERE id IS NOT NULL)
SELECT entity_id, s AS normalized_alias, min(alias) AS alias, max(confidence) AS confidence, coalesce(bool_or(source = 'manual'), false) AS verified FROM a JOIN sf ON sf.x = alias WHERE s <> '' GROUP BY 1, 2"""
)
def alias_upsert_merge(spark, d):
    """Aliases of every script; a confidence of NaN says nothing."""
    e = table(spark, d, "entities").where("id IS NOT NULL")
    new = e.select(F.col("id").alias("entity_id"), F.explode("aliases").alias("alias"), "confidence", F.coalesce(F.col("source") == "manual", F.lit(False)).alias("verified"), F.lit(1).alias("seq"))
    old = spark.createDataFrame([], "entity_id string, normalized_alias string, alias string, confidence double, verified boolean, seq int")
    return S.upsert_aliases(old, new).drop("seq")


@query(f"WITH {surfaces('sf', MENTION_TEXTS)}, m AS (SELECT mention_id, text, context, confidence, coalesce(expected_types[1], 'event') AS entity_type, s AS n FROM mentions JOIN sf ON sf.x = text WHERE resolved_entity_id IS NULL AND confidence >= 0.9 AND NOT isnan(confidence))"
    " SELECT 'ent_' || substr(sha256(concat_ws('|', n, entity_type)), 1, 32) AS id, arg_min(text, mention_id) AS name, entity_type, substr(arg_min(coalesce(context, ''), mention_id), 1, 500) AS description, max(confidence) AS confidence FROM m GROUP BY n, entity_type")  # fmt: skip
def new_entities(spark, d):
    """Sure mentions that nothing is known of, as entities of their own."""
    m = table(spark, d, "mentions").where("text IS NOT NULL").withColumn("context", F.coalesce("context", F.lit("")))
    none = spark.createDataFrame([], "mention_id long, rank int, id string, score double")
    open_ = m.where("resolved_entity_id IS NULL AND NOT isnan(confidence)")
    return E.new_entities(L.decide(none, open_, write=True), open_).select("id", "name", "entity_type", "description", "confidence")
