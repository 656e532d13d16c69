"""Timelines: what ends what, merged intervals, and how the end of evidence spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, valid_from, valid_to, evidence) with touching or overlapping intervals of equal keys merged; a null valid_to is open, a row without valid_from stays alone."""
    forever = F.lit(2**63 - 1)
    # the end is a column of its own, so that both windows share one sort: rows that start and end together stand in the same order in both
    order = W.partitionBy(*keys).orderBy(F.col("valid_from").asc_nulls_last(), "__end")
    before = F.max("__end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("__end", F.coalesce("valid_to", forever)).withColumn("__new", F.coalesce((F.col("valid_from") > before).cast("int"), F.lit(1)))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "__island").agg(F.min("valid_from").alias("valid_from"), F.max("__end").alias("valid_to"), F.sum("evidence").alias("evidence"))
    return out.drop("__island").withColumn("valid_to", F.when(F.col("valid_to") < forever, F.col("valid_to")))


def exclusive(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The timeline of an exclusive relation from rows (key, value, valid_from, seq): one value of a key at a time.

    Successive rows of one value are one row with their number as evidence. Of values that start together the last
    written stays; the others are retired at their start (`retired`). Each stays until the next one's start
    (`valid_to`), which `ended_by` names by its seq.
    """
    start = W.partitionBy(*key, "valid_from").orderBy(F.col("seq").desc())
    winner = rows.withColumn("__wins", F.first(F.struct("seq", value)).over(start))
    winner = winner.withColumn("retired", F.col(value) != F.col(f"__wins.{value}"))
    lost = winner.where("retired").select(*key, value, "valid_from", F.col("valid_from").alias("valid_to"), "seq", F.lit(1).cast("long").alias("evidence"), F.col("__wins.seq").alias("ended_by"), "retired")
    order = W.partitionBy(*key).orderBy("valid_from", "seq")
    kept = winner.where("NOT retired").withColumn("__new", F.coalesce((F.lag(value).over(order) != F.col(value)).cast("int"), F.lit(1)))
    kept = kept.withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = kept.groupBy(*key, value, "__run").agg(F.min("valid_from").alias("valid_from"), F.min("seq").alias("seq"), F.count("*").alias("evidence"))
    chain = W.partitionBy(*key).orderBy("__run")
    runs = runs.withColumn("valid_to", F.lead("valid_from").over(chain)).withColumn("ended_by", F.lead("seq").over(chain))
    return runs.select(*key, value, "valid_from", "valid_to", "seq", "evidence", "ended_by", F.lit(False).alias("retired")).unionByName(lost)


def polarity(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, polarity 0 or 1, valid_from, seq) with the end that the next row of the other polarity sets; one that starts together with it is retired."""
    order = W.partitionBy(*key).orderBy("valid_from", "seq").rowsBetween(1, W.unboundedFollowing)
    other = lambda p: F.first(F.when(F.col("polarity") == p, F.col("valid_from")), ignorenulls=True).over(order)
    out = rows.withColumn("valid_to", F.when(F.col("polarity") == 1, other(0)).otherwise(other(1)))
    return out.withColumn("retired", F.coalesce(F.col("valid_to") == F.col("valid_from"), F.lit(False)))


def superseded(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, id, seq, valid_from): each ends where the next of its key starts, which replaces it."""
    order = W.partitionBy(*key).orderBy("seq", "id")
    out = rows.withColumn("superseded_by", F.lead("id").over(order)).withColumn("valid_to", F.lead("valid_from").over(order))
    return out.withColumn("live", F.col("superseded_by").isNull())


def ended_evidence(relations: DataFrame) -> DataFrame:
    """(memory_id, valid_to) of the memories whose relations (memory_id, valid_to) have all ended: at the last end."""
    ends = relations.groupBy("memory_id").agg(F.max("valid_to").alias("valid_to"), F.bool_and(F.col("valid_to").isNotNull()).alias("all"))
    return ends.where("all").select("memory_id", "valid_to")


def overlap_counts(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(start, end, n) for each of windows: how many of rows (valid_from, valid_to) overlap it.

    No pair of row and window is made: rows that start before a window's end, less those that end by its start,
    are two running totals over all starts, ends and window bounds in order of time.
    """
    starts = rows.groupBy(F.col("valid_from").alias("t")).agg(F.count("*").alias("up")).select("t", F.lit(1).alias("o"), "up", F.lit(0).cast("long").alias("down"))
    ends = rows.where("valid_to IS NOT NULL").groupBy(F.col("valid_to").alias("t")).agg(F.count("*").alias("down")).select("t", F.lit(1).alias("o"), F.lit(0).cast("long").alias("up"), "down")
    # a start at a window's end does not count: the bound comes first; an end at its start does: the bound comes last
    begin = windows.select(F.col("start").alias("t")).distinct().select("t", F.lit(2).alias("o"), F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("down"))
    finish = windows.select(F.col("end").alias("t")).distinct().select("t", F.lit(0).alias("o"), F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("down"))
    marks = starts.unionByName(ends).unionByName(begin).unionByName(finish).groupBy("t", "o").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    # two levels: totals of months, then running totals inside each, so that no single task sees all marks
    month = F.floor(F.col("t") / (31 * 86_400))
    marks = marks.withColumn("m", month)
    months = marks.groupBy("m").agg(F.sum("up").alias("u"), F.sum("down").alias("d"))
    run = W.orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    base = months.select("m", F.coalesce(F.sum("u").over(run), F.lit(0)).alias("u0"), F.coalesce(F.sum("d").over(run), F.lit(0)).alias("d0"))
    inside = W.partitionBy("m").orderBy("t", "o").rowsBetween(W.unboundedPreceding, 0)
    totals = marks.withColumn("u", F.sum("up").over(inside)).withColumn("d", F.sum("down").over(inside)).join(base, "m")
    at_end = totals.where("o = 0").select(F.col("t").alias("end"), (F.col("u") + F.col("u0")).alias("started"))
    at_start = totals.where("o = 2").select(F.col("t").alias("start"), (F.col("d") + F.col("d0")).alias("gone"))
    return windows.join(at_end, "end").join(at_start, "start").select("start", "end", (F.col("started") - F.col("gone")).alias("n"))
