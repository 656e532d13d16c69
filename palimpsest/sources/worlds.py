"""Made-up memories and questions with known answers, for load tests and evaluation: a row is a function of its number, so any part can be made anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


def facts(spark: SparkSession, people: int, moves: int = 3, seed: int = 1, now: int = 1_792_594_800) -> DataFrame:
    """(id, content, person, predicate, value, valid_from): each person lives in and works at several places in turn."""
    n = people * moves * 2
    h = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1_000_003))
    rows = spark.range(n).select("id", (F.col("id") % people).alias("p"), F.floor(F.col("id") / people).alias("step"))
    rows = rows.withColumn("works", F.col("step") % 2 == 1).withColumn("move", F.floor(F.col("step") / 2))
    person = F.concat(F.lit("Person "), F.col("p"))
    predicate = F.when(F.col("works"), "works at").otherwise("lives in")
    value = F.concat(F.when(F.col("works"), "Company ").otherwise("City "), h(7) % F.lit(max(2, people // 4)))
    start = F.lit(now) - (F.lit(moves) - F.col("move")) * 365 * DAY + h(11) % 300 * DAY
    out = rows.select("id", person.alias("person"), predicate.alias("predicate"), value.alias("value"), start.alias("valid_from"))
    return out.withColumn("content", F.concat_ws(" ", "person", "predicate", "value"))


def questions(rows: DataFrame) -> DataFrame:
    """(query_id, q, category, expect): where does each person live (or work) now; expect is the newest fact's id."""
    last = rows.groupBy("person", "predicate").agg(F.max_by("id", F.struct("valid_from", "id")).alias("expect"))
    q = F.concat(F.lit("Where does "), "person", F.when(F.col("predicate") == "works at", " work now?").otherwise(" live now?"))
    return last.select(F.xxhash64("person", "predicate").alias("query_id"), q.alias("q"), F.lit("current").alias("category"), "expect")
