"""Set-based entity linking: candidates of many mentions at once, fused, made coherent, decided.

All routes give (mention_id, id, signals); candidates meet mentions by equi joins on normalised
names and on shared trigrams, never as all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.let import let
from ..functions.text import cosine, fuse, normalize_surface, padded_words, trigram_similarity, trigrams
from ..session import BROADCAST_LIMIT, checkpoint, estimated_bytes, spread
from . import blocks
from .graph import Graph, bfs
from .skew import heavy_keys, skewed_join

SIGNALS = ("exact", "fulltext", "vector", "fuzzy", "type", "coherence")
LEAST_FUZZY = 0.15
COHERENT = 5  # candidates of a mention that coherence is given to
BLOCKS = 256  # of the entities, where a query set is too large to broadcast


def dedupe_mentions(mentions: DataFrame) -> DataFrame:
    """One mention of each (normalized text, sorted expected types, document): the surest; of these the smallest id."""
    types = F.array_sort(F.coalesce("expected_types", F.array().cast("array<string>")))
    w = Window.partitionBy(F.coalesce("normalized_text", F.lit("")), types, F.coalesce("document_id", F.lit(""))).orderBy(F.desc_nulls_last("confidence"), "mention_id")
    return mentions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def name_forms(vertices: DataFrame) -> DataFrame:
    """(id, entity_type, form): normalised names, canonical names and aliases."""
    forms = F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return vertices.select("id", "entity_type", F.explode(forms).alias("raw")).select("id", "entity_type", normalize_surface(F.col("raw")).alias("form")).where("form != ''").distinct()


def exact_candidates(mentions: DataFrame, forms: DataFrame) -> DataFrame:
    m = mentions.select("mention_id", normalize_surface(F.col("text")).alias("form")).where("form != ''")
    return m.join(forms, "form").select("mention_id", "id", F.lit(1.0).alias("exact"), F.lit(1.0).alias("fuzzy")).distinct()


def direct_candidates(mentions: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mentions whose text is an id; an expected type must agree if any is given."""
    m = mentions.select("mention_id", F.col("text").alias("id"), F.coalesce("expected_types", F.array().cast("array<string>")).alias("types"))
    j = m.join(vertices.select("id", "entity_type"), "id").where((F.size("types") == 0) | F.array_contains("types", F.col("entity_type")))
    return j.select("mention_id", "id", F.lit(1.0).alias("exact"), F.lit(1.0).alias("fuzzy"))


def fuzzy_candidates(mentions: DataFrame, forms: DataFrame, least: float = LEAST_FUZZY, top: int = 20) -> DataFrame:
    """The `top` entities of most similar trigrams of each distinct text, over entities that share a trigram.

    A form that shares none has similarity 0, and one of fewer than `least` times as many trigrams, or more than that many
    times fewer, can't reach `least`, so neither is looked at and nothing is lost. Texts are distinct, so a name mentioned
    by a third of all rows is one text; trigrams that many texts hold are split."""
    m = mentions.select("mention_id", normalize_surface(F.col("text")).alias("t")).where("t != ''")
    held = checkpoint(forms.groupBy("form").agg(F.collect_set("id").alias("ids")).withColumn("padded", padded_words(F.col("form"))))
    if _characters(held, F.length("padded") + F.length(F.array_join("ids", ""))) <= blocks.MOST_HELD:
        texts = checkpoint(m.select("t").distinct().withColumn("padded", padded_words(F.col("t"))))
        run = lambda x, y: blocks.similar_forms(x, y, least, top)
        best = blocks.per_block(texts, held, texts.count(), run, "t string, id string, fuzzy double")
    else:
        best = _fuzzy_joined(m, forms, least, top)
    return m.join(best, "t").select("mention_id", "id", F.when(F.col("fuzzy") == 1, 1.0).otherwise(0.0).alias("exact"), "fuzzy")


def _characters(rows: DataFrame, length: Column) -> int:
    return rows.agg(F.sum(length.cast("long"))).head()[0] or 0  # one row


def _fuzzy_joined(m: DataFrame, forms: DataFrame, least: float, top: int) -> DataFrame:
    """(t, id, fuzzy) of the texts of m (mention_id, t) by a join, where the forms are too many for a task."""
    # numbers stand for texts and forms in the join, and come from written tables, so that they are the same in every task
    texts = checkpoint(m.select("t").distinct().withColumn("ti", F.monotonically_increasing_id()))
    own = checkpoint(forms.select("form").distinct().withColumn("fi", F.monotonically_increasing_id()))
    grams = lambda x, c, i, n: let(x.select(i, c), {"__g": trigrams(F.col(c))}).select(i, F.size("__g").alias(n), F.explode("__g").alias("g")).withColumn("g", F.xxhash64("g"))
    met = skewed_join(grams(texts, "t", "ti", "n"), grams(own, "form", "fi", "k"), "g", 16 * texts.count()).where(F.least("n", "k") >= least * F.greatest("n", "k"))
    shared = met.groupBy("ti", "fi", "n", "k").agg(F.count("*").alias("c"))
    sims = shared.select("ti", "fi", (F.col("c") / (F.col("n") + F.col("k") - F.col("c"))).alias("fuzzy")).where(F.col("fuzzy") >= least)
    best = sims.join(own.join(forms.select("form", "id"), "form").select("fi", "id"), "fi").groupBy("ti", "id").agg(F.max("fuzzy").alias("fuzzy"))
    w = Window.partitionBy("ti").orderBy(F.desc("fuzzy"), "id")
    return best.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).join(texts, "ti").select("t", "id", "fuzzy")


STOP_SHARE = 0.1  # a word that more of the entities hold finds none by itself
K1, B = 1.2, 0.75  # fixed values: the usual saturation and length weight of BM25


def _body() -> Column:
    parts = F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array("description"))
    return normalize_surface(F.array_join(parts, " "))


def fulltext_candidates(mentions: DataFrame, vertices: DataFrame, top: int = 20, stop_share: float = STOP_SHARE) -> DataFrame:
    """(mention_id, id, fulltext): the `top` entities of greatest BM25 score of each distinct text, to six digits; ties to the smaller id.

    An entity's text is its name, canonical name, aliases and description. Words that more than `stop_share` of all entities
    hold add to the score of what other words of the text find, but find nothing themselves."""
    m = mentions.select("mention_id", normalize_surface(F.col("text")).alias("t")).where("t != ''")
    held = checkpoint(vertices.select("id", _body().alias("body")))
    if _characters(held, F.length("body")) <= blocks.MOST_HELD:
        texts = checkpoint(m.select("t").distinct())
        run = lambda x, y: blocks.scored_texts(x, y, top, stop_share, K1, B)
        best = blocks.per_block(texts, held, texts.count(), run, "t string, id string, fulltext double")
    else:
        best = _fulltext_joined(m, held, top, stop_share)
    return m.join(best, "t").select("mention_id", "id", "fulltext")


def _fulltext_joined(m: DataFrame, bodies: DataFrame, top: int, stop_share: float) -> DataFrame:
    """(t, id, fulltext) of the texts of m (mention_id, t) and bodies (id, body) by a join, where these are too large for a task."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    docs = bodies.select("id", words(F.col("body")).alias("ws"))
    one = docs.agg(F.count("*").alias("many"), F.avg(F.size("ws")).alias("mean")).head()  # one row
    many, mean = one["many"], one["mean"] or 1.0
    held = checkpoint(docs.select("id", F.size("ws").alias("dl"), F.explode("ws").alias("w")).groupBy("id", "dl", "w").agg(F.count("*").alias("tf")))
    df = held.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (many - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    posts = held.join(df, "w").select("w", "id", weight.alias("s"), (F.col("df") > stop_share * many).alias("stop"))
    texts = checkpoint(m.select("t").distinct())
    asked = texts.select("t", F.explode(F.array_distinct(words("t"))).alias("w"))
    met = skewed_join(asked, posts, "w", 4 * texts.count())
    found = met.where("NOT stop").select("t", "id").distinct()
    both = met.where("NOT stop").select("t", "id", "s").unionByName(met.where("stop").join(found, ["t", "id"], "left_semi").select("t", "id", "s"))
    best = both.groupBy("t", "id").agg(F.round(F.sum("s"), 6).alias("fulltext"))
    w = Window.partitionBy("t").orderBy(F.desc("fulltext"), "id")
    return best.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).drop("__n")


def escape_query(text: Column) -> Column:
    """A full-text query whose words mean only themselves: operators are escaped, runs of white space one blank; blank texts give \"\"."""
    tidy = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r'([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', r"\\$1")
    return F.when(F.trim(tidy) == "", '""').otherwise(F.trim(tidy))


def graph_candidates(fulltext: DataFrame, vector: DataFrame, top: int = 20) -> DataFrame:
    """(mention_id, id, fulltext, vector): of both routes the `top` of greatest better signal a mention; ties to the smaller id."""
    both = fulltext.unionByName(vector, allowMissingColumns=True).groupBy("mention_id", "id")
    got = both.agg(F.coalesce(F.max("fulltext"), F.lit(0.0)).alias("fulltext"), F.coalesce(F.max("vector"), F.lit(0.0)).alias("vector"))
    w = Window.partitionBy("mention_id").orderBy(F.greatest("fulltext", "vector").desc(), "id")
    return got.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).drop("__n")


def vector_candidates(queries: DataFrame, embeddings: DataFrame, top: int = 20, digits: int | None = None) -> DataFrame:
    """(mention_id, id, vector): entities of positive cosine with each query vector; queries (mention_id, v) are a stated set.

    Cosines are compared as rounded to `digits`, if given. Each task holds the whole query set beside its part of the entities;
    a larger one meets the entities block by block, each block a task of its own."""
    e = embeddings.select("id", F.col("v").alias("e"))
    queries = checkpoint(queries.select("mention_id", "v"))
    if 8 * _characters(queries, F.coalesce(F.size("v"), F.lit(0))) <= blocks.MOST_HELD:
        kind = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "mention_id"), (e, "id"))}
        e = checkpoint(e)
        run = lambda x, y: blocks.near_vectors(x, y, top, digits)
        s = blocks.per_block(e, queries, e.count(), run, f"mention_id {kind['mention_id']}, id {kind['id']}, vector double")
    else:
        s = _vectors_joined(queries, e, digits)
    w = Window.partitionBy("mention_id").orderBy(F.desc("vector"), "id")
    return s.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).drop("__n")


def _vectors_joined(queries: DataFrame, e: DataFrame, digits: int | None) -> DataFrame:
    """(mention_id, id, vector) of all pairs of positive cosine."""
    if estimated_bytes(queries) < BROADCAST_LIMIT:
        j = e.repartition(spread(queries.sparkSession, 0, 1)).join(F.broadcast(queries), F.size("v") == F.size("e"))
    else:
        q = queries.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
        e = e.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int"))
        j = q.join(e, (q["b"] == e["b"]) & (F.size("v") == F.size("e")))
    s = j.select("mention_id", "id", cosine(F.col("v"), F.col("e")).alias("vector")).where("vector > 0 AND NOT isnan(vector)")
    return s if digits is None else s.withColumn("vector", F.round("vector", digits))


def merge_routes(*routes: DataFrame) -> DataFrame:
    """(mention_id, id, exact, fulltext, vector, fuzzy): the maximum of each signal over all routes."""
    out = None
    for r in routes:
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    for s in SIGNALS[:4]:
        if s not in out.columns:
            out = out.withColumn(s, F.lit(0.0))
    return out.groupBy("mention_id", "id").agg(*[F.coalesce(F.max(s), F.lit(0.0)).alias(s) for s in SIGNALS[:4]])


def rerank(candidates: DataFrame, mentions: DataFrame, vertices: DataFrame) -> DataFrame:
    """candidates with type (1 also if none is expected), score and rank (ties to the smaller id); coherence counts if it is there."""
    c = candidates if "coherence" in candidates.columns else candidates.withColumn("coherence", F.lit(0.0))
    c = c.drop("type", "score", "rank")
    types = mentions.select("mention_id", F.coalesce("expected_types", F.array().cast("array<string>")).alias("__types"))
    j = c.join(types, "mention_id").join(vertices.select("id", F.col("entity_type").alias("__own")), "id")
    j = j.withColumn("type", F.when((F.size("__types") == 0) | F.array_contains("__types", F.col("__own")), 1.0).otherwise(0.0)).drop("__types", "__own")
    j = j.withColumn("score", fuse(*[F.col(s) for s in SIGNALS]))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "id")))


def coherence(ranked: DataFrame, g: Graph, group: DataFrame, top: int = 5) -> DataFrame:
    """ranked with coherence: of the best entities of the other mentions of a group, how many are linked to the candidate.

    group: (mention_id, group_id), such as the document, one a mention. Every edge counts, else one for a way of two or
    three; two make 1. A group is its distinct entities, so mentions never meet each other; ways are met in the middle."""
    best = checkpoint(ranked.where(F.col("rank") <= top).join(group.where("group_id IS NOT NULL"), "mention_id").select("group_id", "mention_id", "id"))
    held = checkpoint(best.groupBy("group_id", "id").agg(F.count("*").alias("n"), F.min("mention_id").alias("only")))
    others = held.select("group_id", F.col("id").alias("other"))
    adj = checkpoint(g.adjacency("both"))
    edges = adj.groupBy(F.col("src").alias("id"), F.col("dst").alias("other")).agg(F.count("*").alias("w"))
    direct = held.select("group_id", "id").join(edges, "id").join(others, ["group_id", "other"], "left_semi").select("group_id", "id", "other", "w")
    # two edges from the candidate meet none or one from the other
    ball = bfs(adj, held.select("id").distinct(), 2).select(F.col("root").alias("id"), F.col("node").alias("x"))
    near = others.select("group_id", "other", F.col("other").alias("x")).unionByName(
        others.join(adj.select(F.col("src").alias("other"), F.col("dst").alias("x")).distinct(), "other").select("group_id", "other", "x")
    )
    ways = held.select("group_id", "id").join(ball, "id").join(near, ["group_id", "x"]).select("group_id", "id", "other").distinct()
    ways = ways.join(direct.select("group_id", "id", "other"), ["group_id", "id", "other"], "left_anti").withColumn("w", F.lit(1).cast("long"))
    links = checkpoint(direct.unionByName(ways))
    every = links.groupBy("group_id", "id").agg(F.sum("w").alias("w"))
    # what only the mention itself has among its best is none of the others
    mine = held.where("n = 1").select("group_id", F.col("id").alias("other"), F.col("only").alias("mention_id"))
    mine = links.join(mine, ["group_id", "other"]).groupBy("group_id", "id", "mention_id").agg(F.sum("w").alias("own"))
    got = best.join(every, ["group_id", "id"]).join(mine, ["group_id", "id", "mention_id"], "left")
    got = got.groupBy("mention_id", "id").agg(F.least(F.lit(1.0), F.sum(F.col("w") - F.coalesce("own", F.lit(0))) / 2).alias("coherence"))
    return ranked.drop("coherence").join(got, ["mention_id", "id"], "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.0)))


def best_linked(mentions: DataFrame, g: Graph, group: Column, keep: int = 5) -> DataFrame:
    """(mention_id, ids, exact, fulltext, fuzzy, type, coherence, score): the `keep` best candidates of every mention that has any,
    as arrays in the order of their rank; group: a column of mentions, or null.

    What `coherence` and `rerank` after `merge_routes` of all routes but that of vectors give of these ranks. Coherence is given to the
    `COHERENT` first, and only adds to a score, so who is below can't pass them and none of the others need be kept (`keep` is as many
    at least). Each task links a part of the texts, or of the groups, with all names or edges beside it, so that no candidate but the
    best is written; where these are too many for a task, the routes are joined."""
    if keep < COHERENT:
        raise ValueError(f"keep must be {COHERENT} at least")
    v, types = g.vertices, F.coalesce("expected_types", F.array().cast("array<string>"))
    forms = name_forms(v).groupBy("id").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    bodies = v.select("id", F.col("entity_type").alias("kind"), _body().alias("body"))
    held = checkpoint(bodies.join(forms, "id", "left").withColumn("padded", F.transform("forms", _padded)))
    steps = checkpoint(g.adjacency("both").groupBy("src", "dst").agg(F.count("*").alias("w")))
    chars = lambda c: F.coalesce(F.length(F.array_join(c, "")), F.lit(0))
    if max(_characters(held, F.coalesce(F.length("body"), F.lit(0)) + 2 * chars("forms")), _characters(steps, F.length("src") + F.length("dst"))) > blocks.MOST_HELD:
        return _best_joined(mentions, g, group, keep)
    n = mentions.count()
    asked = mentions.select(
        "mention_id", group.alias("g"), F.col("text").alias("raw"), F.when(F.size(types) > 0, F.to_json(types)).alias("types"),
        F.pmod(F.xxhash64("text"), F.lit(1 << 16)).alias("__h"),
    )
    asked = let(asked, {"t": F.nullif(normalize_surface(F.col("raw")), F.lit(""))}).withColumn("padded", _padded(F.col("t"))).withColumn("raw", F.when(~F.col("raw").eqNullSafe(F.col("t")), F.col("raw")))
    # a text of very many mentions is looked at in several blocks
    parts = F.broadcast(heavy_keys(mentions.select(F.pmod(F.xxhash64("text"), F.lit(1 << 16)).alias("__h")), "__h", n, blocks.BLOCK_ROWS // 4))
    asked = asked.join(parts, "__h", "left").withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64("mention_id"), F.col("__parts")))).drop("__h", "__parts")
    kind = mentions.schema["mention_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<double>" for c in blocks.SIGNALS)
    run = lambda x, y: blocks.best_links(x, y, keep, LEAST_FUZZY, 20, STOP_SHARE, K1, B)
    best = blocks.per_block(asked, held, n, run, f"mention_id {kind}, g string, ids array<string>, {lists}", [F.col("t"), F.col("__part")])
    again = lambda x, y: blocks.coherent(x, y, COHERENT)
    own = [F.coalesce("g", F.col("mention_id").cast("string"))]
    return blocks.per_block(best, steps, n, again, f"mention_id {kind}, ids array<string>, {lists}, coherence array<double>, score array<double>", own)


def _padded(form: Column) -> Column:
    """`padded_words` where blocks can't tell them from the form itself."""
    return F.when(~form.rlike("^[a-z0-9]+( [a-z0-9]+)*$"), padded_words(form))


def _best_joined(mentions: DataFrame, g: Graph, group: Column, keep: int) -> DataFrame:
    """`best_linked` by joins of all candidates."""
    v = g.vertices
    forms = checkpoint(name_forms(v))
    got = merge_routes(exact_candidates(mentions, forms), direct_candidates(mentions, v), fuzzy_candidates(mentions, forms), fulltext_candidates(mentions, v))
    one = checkpoint(rerank(got, mentions, v))
    two = rerank(coherence(one, g, mentions.select("mention_id", group.alias("group_id"))), mentions, v)
    cs = ("id", *blocks.SIGNALS, "coherence", "score")
    rows = two.where(F.col("rank") <= keep).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", *cs))).alias("r"))
    return rows.select("mention_id", *[F.col(f"r.{c}").alias("ids" if c == "id" else c) for c in cs])


def ranked_rows(best: DataFrame) -> DataFrame:
    """`best_linked` as rows (mention_id, id, signals, score, rank)."""
    cs = [c for c in best.columns if c != "mention_id"]
    rows = best.select("mention_id", F.posexplode(F.arrays_zip(*cs)).alias("p", "r"))
    return rows.select("mention_id", *[F.col(f"r.{c}").alias("id" if c == "ids" else c) for c in cs], (F.col("p") + 1).alias("rank"))


def decide(ranked: DataFrame, mentions: DataFrame, write: bool = False, threshold: float | None = None, gap: float = 0.08, sure: float = 0.90, also: tuple[str, ...] = ()) -> DataFrame:
    """(mention_id, status, id, score, margin): LINKED, NEW, AMBIGUOUS or NIL for every mention.

    LINKED at the threshold (0.72, 0.90 when writing) with a margin of `gap` to the runner-up (0 if alone). Without
    candidates NEW if writing and the mention is sure, else NIL. ranked: rows, or what `best_linked` gives, of which the columns `also` are kept."""
    limit = threshold if threshold is not None else 0.90 if write else 0.72
    if "ids" in ranked.columns:
        top = ranked.select("mention_id", F.get("score", F.lit(0)).alias("score"), F.coalesce(F.get("score", F.lit(1)), F.lit(0.0)).alias("second"), F.get("ids", F.lit(0)).alias("best"), *also)
    else:
        top = ranked.groupBy("mention_id").agg(
            F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
            F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
            F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("best"),
        )
    j = mentions.select("mention_id", "confidence").join(top, "mention_id", "left").withColumn("margin", F.round(F.col("score") - F.col("second"), 4))
    linked = (F.col("score") >= limit) & (F.col("margin") >= gap)
    none = F.when(F.lit(write) & (F.col("confidence") >= sure), "NEW").otherwise("NIL")
    status = F.when(F.col("best").isNull(), none).when(linked, "LINKED").otherwise("AMBIGUOUS")
    return j.select("mention_id", status.alias("status"), F.when(status == "LINKED", F.col("best")).alias("id"), "score", "margin", *also)


def similarity_of_names(mentions: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mention_id, id, similarity) of each resolved mention's text with the name it was resolved to."""
    v = vertices.select(F.col("id").alias("resolved_entity_id"), "name")
    j = mentions.join(v, "resolved_entity_id")
    return j.select("mention_id", F.col("resolved_entity_id").alias("id"), trigram_similarity(F.col("text"), F.col("name")).alias("similarity"))
