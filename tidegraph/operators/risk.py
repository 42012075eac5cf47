"""Risk scores from threats, exposures and assertions, and the findings over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import risk_band, unit

# Weights of severities and of relation types.
SEVERITY = (("critical", 1.0), ("high", 0.75), ("medium", 0.5), ("low", 0.25))
DEPENDENCY = ("DEPENDS_ON", "SUPPLIES", "SUPPLIES_TO")


def severity_weight(c: Column) -> Column:
    out = F.lit(0.5)
    for name, w in reversed(SEVERITY):
        out = F.when(F.lower(c) == name, w).otherwise(out)
    return out


def severity_rank(c: Column) -> Column:
    out = F.lit(0)
    for i, (name, _) in enumerate(reversed(SEVERITY), 1):
        out = F.when(F.lower(c) == name, i).otherwise(out)
    return out


def relation_weight(c: Column) -> Column:
    return F.when(F.upper(c) == "THREATENS", 1.0).when(F.upper(c).isin(*DEPENDENCY), 0.7).otherwise(0.35)


def risk_matrix(threats: DataFrame) -> DataFrame:
    """One row (score, level, top_severity, categories): the mean over categories of the greatest weight x confidence; 0 for none."""
    per = threats.groupBy("category").agg(F.max(severity_weight(F.col("severity")) * unit(F.col("confidence"))).alias("r"), F.max(F.struct(severity_rank(F.col("severity")).alias("k"), F.col("severity").alias("s"))).alias("m"))
    out = per.agg(
        F.coalesce(F.round(F.avg("r"), 2), F.lit(0.0)).alias("score"),
        F.coalesce(F.max("m")["s"], F.lit("unknown")).alias("top_severity"),
        F.count("*").alias("categories"),
    )
    return out.select("score", risk_band(F.col("score")).alias("level"), "top_severity", "categories")


def upper_half_mean(scores: DataFrame, score: str = "exposure_score", bins: int = 10_000) -> DataFrame:
    """One row (upper_mean, n): the mean of the upper half (rounded up) of the clamped scores to four digits.

    Scores are counted by value first, so no row-wise sort of all scores takes place."""
    per = scores.groupBy(F.round(unit(F.col(score)), 4).alias("s")).agg(F.count("*").alias("c"))
    from pyspark.sql.window import Window

    w = Window.orderBy(F.desc("s"))  # over distinct values, at most `bins` + 1
    cum = per.withColumn("before", F.sum("c").over(w) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy()))
    take = F.greatest(F.lit(0), F.least(F.col("c"), F.ceil(F.col("n") / 2) - F.col("before")))
    return cum.agg(F.round(F.sum(F.col("s") * take) / F.sum(take), 4).alias("upper_mean"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def assertion_score(assertions: DataFrame) -> DataFrame:
    """One row (assertion_score, threatens, n): mean of relation weight x confidence to four digits; null for none."""
    w = relation_weight(F.col("rel_type")) * unit(F.col("confidence"))
    return assertions.agg(F.round(F.avg(w), 4).alias("assertion_score"), F.count_if(F.upper("rel_type") == "THREATENS").alias("threatens"), F.count("*").alias("n"))


def blend(exposure: Column, assertion: Column) -> Column:
    """0.6 and 0.4 of both, else the one there is, to two digits."""
    return F.round(F.round(F.coalesce(0.6 * exposure + 0.4 * assertion, exposure, assertion), 8), 2)


def evidence_confidence(mean_confidence: Column, n: Column) -> Column:
    return F.round(F.round((mean_confidence + F.least(F.lit(1.0), 0.5 + 0.05 * F.least(n, F.lit(10)))) / 2, 8), 4)


def assess(exposures: DataFrame, assertions: DataFrame, prior: DataFrame) -> DataFrame:
    """One row (score, level, basis, high_exposures, threatens): evidence if there is any, else the prior of the catalogue."""
    e = upper_half_mean(exposures.where("exposure_score > 0"))
    high = exposures.agg(F.count_if(F.col("exposure_score") >= 0.6).alias("high_exposures"))
    one = e.crossJoin(assertion_score(assertions)).crossJoin(high).crossJoin(prior.select(F.col("score").alias("prior")))  # single rows
    s = F.coalesce(blend(F.col("upper_mean"), F.col("assertion_score")), F.col("prior"))
    basis = F.when(F.col("upper_mean").isNotNull() & F.col("assertion_score").isNotNull(), "graph_exposure+assertions").when(F.col("upper_mean").isNotNull(), "graph_exposure").when(
        F.col("assertion_score").isNotNull(), "assertions").otherwise("catalogue")
    return one.select(s.alias("score"), risk_band(s).alias("level"), basis.alias("basis"), "high_exposures", "threatens")


def indicators(assessment: DataFrame, sources: int) -> DataFrame:
    """assessment with escalation and mitigation, arrays of texts."""
    up = F.array_compact(
        F.array(
            F.when(F.lit(sources > 3), F.lit(f"{sources} independent sources report on the subject")),
            F.when(F.col("threatens") > 0, F.format_string("%d asserted threats", "threatens")),
            F.when(F.col("high_exposures") > 0, F.format_string("%d entities of high exposure", "high_exposures")),
        )
    )
    down = F.array_compact(F.array(F.when(F.col("high_exposures") == 0, F.lit("no entity of high exposure"))))
    return assessment.withColumn("escalation", up).withColumn("mitigation", down)
