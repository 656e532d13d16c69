"""Names to entities and predicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def ngrams(words: Column, most: int = 4) -> Column:
    """All runs of one to so many successive words, joined by spaces; runs of stop words only are left out."""
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.slice(words, i + 1, k))).otherwise(F.array().cast("array<array<string>>"))))
    return F.transform(F.filter(runs, lambda r: F.size(F.array_except(r, X.stopwords())) > 0), lambda r: F.array_join(r, " "))


def gazetteer(docs: DataFrame, aliases: DataFrame, most: int = 4) -> DataFrame:
    """(id, entity_id) for rows (id, words array) that hold an alias (entity_id, alias) of three letters or more which names exactly one entity.

    Only runs whose first word begins some alias are formed.
    """
    own = aliases.where(F.length("alias") >= 3).groupBy("alias").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).where("n = 1")
    own = own.withColumn("parts", F.split("alias", " ")).select("entity_id", "alias", F.element_at("parts", 1).alias("word"), F.size("parts").alias("size")).where(F.col("size") <= most)
    # each place as its next words only, equal places of a text once, so that a text's rows are linear in its length
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.slice("words", i, most)))
    near = docs.where(F.size("words") > 0).select("id", F.explode(places).alias("run")).withColumn("word", F.element_at("run", 1))
    return near.join(own, "word").where(F.array_join(F.slice("run", F.lit(1), F.col("size")), " ") == F.col("alias")).select("id", "entity_id").distinct()


def lexical_pairs(names: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(a, b, score) of names that spell the same thing: near by Jaro-Winkler, of the same digits, of five letters or more.

    Distinct names only; a block is three common first letters, the digits, and a length that such a similarity allows.
    """
    digits = F.regexp_replace("name", r"\D", "")
    distinct = names.select("name").distinct().where(F.length("name") >= 5).select("name", F.substring("name", 1, 3).alias("first"), digits.alias("digits"))
    left, right = distinct.withColumnRenamed("name", "a"), distinct.withColumnRenamed("name", "b")
    # lengths so different that no such similarity is possible
    near = (F.least(F.length("a"), F.length("b")) * 10 >= F.greatest(F.length("a"), F.length("b")) * 6)
    pairs = left.join(right, ["first", "digits"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["score"] = [X.jaro_winkler(a, b) for a, b in zip(x["a"], x["b"], strict=True)]
            yield x[x["score"] >= threshold]

    return pairs.mapInPandas(score, "a string, b string, score double")


def specificity(mentions: DataFrame) -> DataFrame:
    """(entity_id, mentions, weight): the rarer an entity is mentioned, the more it says."""
    counts = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"))
    return counts.withColumn("weight", 1.0 / F.greatest(F.col("mentions"), F.lit(1)))


def representative(mentions: DataFrame, memories: DataFrame, key: str) -> DataFrame:
    """The memory (key, id) that mentions the most distinct entities of each key; ties: importance, valid_from, smaller id."""
    counts = mentions.groupBy(key, "id").agg(F.count_distinct("entity_id").alias("n"))
    rated = counts.join(memories.select("id", "importance", "valid_from"), "id")
    best = F.max(F.struct("n", "importance", "valid_from", (-F.col("id")).alias("minus")))
    return rated.groupBy(key).agg(best.alias("x")).select(key, (-F.col("x.minus")).alias("id"), F.col("x.n").alias("n"))
