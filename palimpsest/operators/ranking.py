"""Fusion of ranked lists, score modifiers, diversification and packing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.schema import Config

DAY = 86_400


def rrf(ranked: DataFrame, weights: dict[str, float], config: Config = Config()) -> DataFrame:
    """(query_id, id, score, best_rank, channels) of ranked (query_id, channel, id, rank): weighted reciprocal ranks, raised by agreement.

    A row that a channel lists twice counts with its best rank; a channel of weight 0 still counts as agreeing.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("channel")), F.lit(0.0))
    once = ranked.groupBy("query_id", "channel", "id").agg(F.min("rank").alias("rank")).withColumn("part", weight / (config.rrf_k + F.col("rank")))
    fused = once.groupBy("query_id", "id").agg(F.sum("part").alias("sum"), F.count("*").alias("channels"), F.min("rank").alias("best_rank"))
    return fused.withColumn("score", F.col("sum") * (1 + config.agreement * (F.col("channels") - 1))).drop("sum")


def modified(score: Column, ended: Column, in_window: Column, age_seconds: Column, importance: Column, history: bool = False, as_of: bool = False, config: Config = Config()) -> Column:
    """A score after the end, window, recency and importance factors."""
    factor = config.history_boost if history and not as_of else config.expired_penalty
    fresh = F.pow(F.lit(2.0), -F.greatest(age_seconds, F.lit(0)) / DAY / config.half_life_days)
    return score * F.when(ended, factor).otherwise(1.0) * F.when(in_window, config.window_boost).otherwise(1.0) * (0.9 + 0.1 * fresh) * (0.9 + 0.2 * importance)


def mmr(scores: Sequence[float], vectors: Sequence[Sequence[float] | None], balance: float, k: int) -> list[int]:
    """Indices of k candidates by relevance against likeness to those chosen before; the first is always the first."""
    n = len(scores)
    if not n or k <= 0:
        return []
    s = np.asarray(scores, float)
    relevance = np.ones(n) if s.max() == s.min() else (s - s.min()) / (s.max() - s.min())
    size = max((len(v) for v in vectors if v is not None), default=1)
    unit = np.zeros((n, size))
    for i, v in enumerate(vectors):
        if v is not None and np.linalg.norm(v) > 0:
            unit[i, : len(v)] = np.asarray(v, float) / np.linalg.norm(v)
    chosen, like, left = [0], np.full(n, -np.inf), np.ones(n, bool)
    left[0] = False
    while len(chosen) < min(k, n):
        like = np.maximum(like, np.clip(unit @ unit[chosen[-1]], -1, 1))
        value = np.where(left, balance * relevance - (1 - balance) * like, -np.inf)
        chosen.append(int(value.argmax()))
        left[chosen[-1]] = False
    return chosen


def diversified(candidates: DataFrame, k: int, config: Config = Config()) -> DataFrame:
    """(query_id, position, id) of candidates (query_id, id, score, embedding): the top 3k by score (ties: smaller id) of each query go through mmr()."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).head(3 * k)
        ids = rows["id"].to_numpy()[mmr(rows["score"].tolist(), rows["embedding"].tolist(), config.mmr_lambda, k)]
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "position": range(1, len(ids) + 1), "id": ids})

    # candidates are a channel's top rows: a bounded number a query
    return candidates.select("query_id", "id", "score", "embedding").groupBy("query_id").applyInPandas(pick, "query_id long, position int, id long")


def packed(candidates: DataFrame, budget: int) -> DataFrame:
    """(query_id, id, cost) of candidates (query_id, rank, id, cost) that fit: the first always, then each that still fits, in rank order."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "id", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,id:bigint,cost:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + x["cost"] <= budget)
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    each = candidates.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").cast("long").alias("id"), F.col("cost").cast("long").alias("cost")).groupBy("query_id").agg(rows.alias("rows"))
    kept = each.select("query_id", F.aggregate("rows", start, step)["kept"].alias("kept"))
    return kept.select("query_id", F.explode("kept").alias("x")).select("query_id", "x.id", "x.cost")
