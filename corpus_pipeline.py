"""The corpus pipeline: toxic documents go, repeated lines go, near duplicates go, domains are mixed, texts are encoded.

run(spark, sf_dir) applies STAGES to `documents`, each stage's rows written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from palimpsest.llm import common as C


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the cutoff; `labels` teaches."""
    return toxicity.filtered(docs, C.table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share; the largest doc_id keeps them."""
    return line_dedup.dedup(docs).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until language shares match their targets; each stays once at least."""
    return mixing.mixed(docs, C.table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each row."""
    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near),
    ("mixing", mix),
    ("encoding", encode),
]

#: Toxicity and mixing are learnt models: SQL cannot say them. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
