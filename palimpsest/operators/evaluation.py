"""Retrieval quality: recall, reciprocal rank, violations, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(results: DataFrame, expected: DataFrame, k: int, absent: DataFrame | None = None) -> DataFrame:
    """(query_id, recall, rr) from results (query_id, id, rank) and expected (query_id, id); a result within k that must be absent makes both 0."""
    got = results.where(F.col("rank") <= k)
    hits = expected.join(got, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("rr"))
    if absent is None:
        return hits
    bad = got.join(absent, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("bad", F.lit(True))
    return hits.join(bad, "query_id", "left").select("query_id", *(F.when(F.col("bad"), 0.0).otherwise(F.col(c)).alias(c) for c in ("recall", "rr")))


def summary(scored: DataFrame, category: str | None = None) -> DataFrame:
    """Mean recall and reciprocal rank, in all or by category."""
    return scored.groupBy(*([category] if category else [])).agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


def percentile(values: list[float], share: float) -> float:
    """Nearest-rank percentile."""
    import math

    ordered = sorted(values)
    return ordered[max(0, math.ceil(share * len(ordered)) - 1)] if ordered else 0.0
