"""Named queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .lookalikes import consistent_columns, disguised
from .name_links import link_names
from .near_copies import expand_pairs, groups, near_copies
from .neighbours import similar_vectors
from .packing import fill_report, pack_documents
from .spam import line_shares, spam_pages
from .survivors import FILLER, LEAST, SHARE, STOCK, build_survivors, judge_descriptions, judge_values, pick_fields
from .tokens import count_corpus, decode_corpus, encode_corpus

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, field_name, record_no): the record that each field of an id's survivor is taken from."""
    return pick_fields(table(spark, d, "entities"), table(spark, d, "source_trust"))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One row per id of two or more records, with every alias and tag judged true."""
    return build_survivors(table(spark, d, "entities"), table(spark, d, "source_trust"))


def p1_source_quality(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, source, sensitivity, specificity) inferred from the tags and from the descriptions."""
    e, trust = table(spark, d, "entities"), table(spark, d, "source_trust")
    rates = {"tags": judge_values(e, trust, "tags")[1], "description": judge_descriptions(e, trust)[1]}
    one, two = (r.select(F.lit(f).alias("field_name"), "*") for f, r in rates.items())
    return one.unionByName(two)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(mention_id, field_name) of every text or normalized_text that holds disguised characters."""
    return disguised(table(spark, d, "mentions").select("mention_id", "text", "normalized_text"), "mention_id", ["text", "normalized_text"])


def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    """(mention_id, text, normalized_text) with both in the one consistent form."""
    return consistent_columns(table(spark, d, "mentions").select("mention_id", "text", "normalized_text"), ["text", "normalized_text"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(mention_id, id): the entity that each mention not yet resolved names."""
    open_ = table(spark, d, "mentions").where("resolved_entity_id IS NULL").select("mention_id", "text")
    entities = table(spark, d, "entities").select("id", "entity_type", "name", "aliases")
    return link_names(open_, entities, table(spark, d, "short_names"))


def _articles(spark: SparkSession, d: str):
    rows = table(spark, d, "search_results").select("result_id", "title", "content")
    return near_copies(rows, "result_id", ["title", "content"], similarity=0.5, n=3, least=20, counted="content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(result_a, result_b) of rows whose runs of three words are shared by at least half."""
    pairs = expand_pairs(*_articles(spark, d), "result_id")
    return pairs.select(F.col("x").alias("result_a"), F.col("y").alias("result_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """(result_id, group_id, links): the group of each row with at least 20 words and its number of similar texts."""
    return groups(*_articles(spark, d), "result_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(record_a, record_b) of cosine 0.90 at least, one among the ten most similar of the other."""
    got = similar_vectors(table(spark, d, "entities").select("record_no", "embedding"), "record_no", "embedding", k=10, least=0.90, recall=0.999)
    return got.select(F.least("record_no", "neighbour").alias("record_a"), F.greatest("record_no", "neighbour").alias("record_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(record_no, neighbour, similarity, rank): the ten most similar records of every usable vector."""
    got = similar_vectors(table(spark, d, "entities").select("record_no", "embedding"), "record_no", "embedding", k=10)
    return got.withColumn("similarity", F.round("similarity", 5))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether decoding the ids gives the text again; null and empty texts give ''."""
    ids = encode_corpus(table(spark, d, "documents").select("doc_id", "text")).withColumnRenamed("text", "given")
    back = decode_corpus(ids)
    return back.select("doc_id", (F.col("text") == F.coalesce("given", F.lit(""))).alias("same"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(count_corpus(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "n_tokens")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container): the container of 2,048 tokens of each document or piece."""
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: pieces, tokens, containers, the least number of containers, the share of room used."""
    return fill_report(_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id) of keyword, link and tag pages."""
    return spam_pages(table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


def p9_line_shares(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, words, prose, links, tags, menu): the words of each document by the state of their line."""
    return line_shares(table(spark, d, "documents").select("doc_id", "text")).drop("text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_survivors, p1_source_quality, p2_found, p2_consistent, p3_found, p4_found, p4_groups, p5_found, p5_neighbours, p7_ids, p7_round_trip, p8_containers, p8_fill, p9_found, p9_line_shares)}


#: All pairs by brute force; only for small tables.
_SIMILAR = """WITH v AS (SELECT record_no AS k, embedding::DOUBLE[] AS e FROM entities WHERE record_no IS NOT NULL AND len(embedding) = 64
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT k, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT a.k AS a, b.k AS b, list_dot_product(a.e, b.e) / (a.n * b.n) AS c FROM u a, u b WHERE a.k <> b.k),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s)
SELECT DISTINCT least(a, b) AS record_a, greatest(a, b) AS record_b FROM r WHERE n <= 10 AND c >= 0.9"""


#: The rule of the survivors, row by row, with the texts and patterns that say nothing as they stand in the operator.
_SURVIVORS = (
    r"""WITH t AS (SELECT trim(regexp_replace(lower(source), '[_-]', ' ', 'g')) AS k, max(trust) AS trust FROM source_trust GROUP BY 1),
e AS (SELECT e.id, record_no, name, confidence, coalesce(trust, 0) AS trust, CASE WHEN created_at >= TIMESTAMP '2023-01-01' AND created_at < TIMESTAMP '2026-06-01' THEN created_at END AS c, trim(regexp_replace(description, '[\s\x{85}\p{Z}\x{200b}]+', ' ', 'g')) AS d
 FROM entities e LEFT JOIN t ON t.k = trim(regexp_replace(lower(source), '[_-]', ' ', 'g')) WHERE e.id IS NOT NULL),
sp AS (SELECT lower(d) AS l FROM e WHERE d IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) >= greatest(LEAST_, SHARE_ * (SELECT count(d) FROM e))),
nm AS (SELECT DISTINCT id, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(n), '[^\p{L}\p{N}]+'), lambda w: w <> '')), ' ') AS b FROM (SELECT id, unnest(list_concat([name, canonical_name], coalesce(aliases, []))) AS n FROM entities) WHERE trim(n) <> ''),
u AS (SELECT *, d IS NOT NULL AND regexp_replace(lower(d), '[^\p{L}\p{N}]+', '', 'g') NOT IN ('', STOCK_) AND NOT regexp_matches(lower(d), 'FILLER_') AND lower(d) NOT IN (SELECT l FROM sp)
 AND (id, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(d), '[^\p{L}\p{N}]+'), lambda w: w <> '')), ' ')) NOT IN (SELECT (id, b) FROM nm) AND coalesce(levenshtein(lower(d), lower(name)) > 3, true) AS good FROM e),
f AS (SELECT id, 'source' AS field_name, record_no, [-trust, -coalesce(epoch_us(c), -4611686018427387904), record_no] AS k FROM u UNION ALL SELECT id, 'confidence', record_no, [-trust, -coalesce(epoch_us(c), -4611686018427387904), record_no] FROM u WHERE confidence BETWEEN 0 AND 1
 UNION ALL SELECT id, 'created_at', record_no, [-epoch_us(c), -trust, record_no] FROM u WHERE c IS NOT NULL UNION ALL SELECT id, 'description', record_no, [-length(d), -trust, -coalesce(epoch_us(c), -4611686018427387904), record_no] FROM u WHERE good)
SELECT id, field_name, record_no FROM (SELECT *, row_number() OVER (PARTITION BY id, field_name ORDER BY k) AS n FROM f WHERE id IN (SELECT id FROM e GROUP BY id HAVING count(*) > 1)) WHERE n = 1"""
    .replace("STOCK_", ", ".join(f"'{w}'" for w in STOCK)).replace("FILLER_", FILLER).replace("LEAST_", str(LEAST)).replace("SHARE_", str(SHARE))
)

def oracle_sql() -> dict[str, str]:
    return {"p1_found": _SURVIVORS, "p5_found": _SIMILAR, "p7_round_trip": "SELECT doc_id, true AS same FROM documents"}
