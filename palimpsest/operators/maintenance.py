"""Counts, integrity checks, and changes of stored rows as new tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, n): the rows of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n") for name, t in tables.items()])


def dangling(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, n): how many rows of a table point with a column to a row that another table's column does not have."""
    out = []
    for name, (table, column, target, key) in checks.items():
        keys = target.select(F.col(key).alias("__key")).distinct()
        missing = table.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")
        out.append(missing.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n"))
    return reduce(DataFrame.unionByName, out)


def invalidate(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with the end that ids (id, at) set: the earlier of two ends stays, and no row ends before it starts."""
    at = F.greatest(F.col("at"), F.col("valid_from"))
    return rows.join(ids.select("id", "at"), "id", "left").withColumn("valid_to", F.when(F.col("at").isNotNull(), F.least(F.coalesce("valid_to", at), at)).otherwise(F.col("valid_to"))).drop("at")


def forget(memories: DataFrame, relations: DataFrame, evidence: DataFrame, ids: DataFrame, now: int, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """(memories, relations) after ids (id) are forgotten: expired, or gone with `hard`; relations that only they evidence are retracted, or gone."""
    gone = ids.select("id").distinct()
    live = memories.where("expired_at IS NULL").select("id").join(gone, "id", "left_anti")
    touched = evidence.join(gone, evidence.memory_id == gone.id, "left_semi").select("relation_id").distinct()
    still = evidence.join(live, evidence.memory_id == live.id, "left_semi").select("relation_id").distinct()
    lost = touched.join(still, "relation_id", "left_anti").withColumnRenamed("relation_id", "id")
    if hard:
        kept = memories.join(gone, "id", "left_anti")
        cut = kept.join(gone.select(F.col("id").alias("__gone")), F.col("superseded_by") == F.col("__gone"), "left")
        return cut.withColumn("superseded_by", F.when(F.col("__gone").isNull(), F.col("superseded_by"))).drop("__gone"), relations.join(lost, "id", "left_anti")
    mark = lambda t, which: t.join(which.withColumn("__hit", F.lit(True)), "id", "left").withColumn("expired_at", F.when(F.col("__hit") & F.col("expired_at").isNull(), F.lit(now)).otherwise(F.col("expired_at"))).drop("__hit")
    return mark(memories, gone), mark(relations, lost)


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, kept): keys that several rows (id) have, and the first of them."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("kept")).where("n > 1")


def erased(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """tables without the rows of memories ids (id): by column memory_id, or id where a table has none."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    key = lambda t: "memory_id" if "memory_id" in t.columns else "id"
    return {name: t.join(gone, F.col(key(t)) == F.col("__gone"), "left_anti") for name, t in tables.items()}


def merge(relations: DataFrame, mentions: DataFrame, keep: int, other: int, now: int, evidence: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """(relations, mentions, evidence if given) after entity `other` became `keep`: ends and subjects rewritten, loops expired, equal live triples joined, their evidence with them."""
    to = lambda c: F.when(F.col(c) == other, F.lit(keep)).otherwise(F.col(c)).cast("long")
    moved = relations.withColumns({c: to(c) for c in ("subj", "src", "dst") if c in relations.columns})
    moved = moved.withColumn("expired_at", F.when((F.col("src") == F.col("dst")) & F.col("expired_at").isNull(), F.lit(now)).otherwise(F.col("expired_at")))
    live = moved.where("expired_at IS NULL AND valid_to IS NULL")
    rest = moved.where("expired_at IS NOT NULL OR valid_to IS NOT NULL")
    key = ["src", "predicate_id", "dst", "polarity"]
    agg = [F.min("valid_from").alias("valid_from") if c == "valid_from" else F.sum("evidence_count").alias(c) if c == "evidence_count" else F.min_by(c, "id").alias(c) for c in live.columns if c not in key]
    joined = live.groupBy(*key).agg(*agg).select(*relations.columns)
    out = joined.unionByName(rest.select(*relations.columns)), mentions.withColumn("entity_id", to("entity_id")).distinct()
    if evidence is None:
        return out
    became = live.select(*key, F.col("id").alias("relation_id")).join(joined.select(*key, F.col("id").alias("__kept")), key).where("relation_id <> __kept").select("relation_id", "__kept")
    held = evidence.join(became, "relation_id", "left").withColumn("relation_id", F.coalesce("__kept", "relation_id")).drop("__kept").select(*evidence.columns).distinct()
    return *out, held


def guarded(query: str) -> str:
    """A read-only query over the views `nodes` and `edges`; words that write are refused."""
    words = set(query.lower().replace("(", " ").replace(";", " ").split())
    bad = words & {"create", "merge", "set", "delete", "remove", "drop", "insert", "detach"}
    if bad:
        raise ValueError(f"read-only: {', '.join(sorted(bad))}")
    return query
