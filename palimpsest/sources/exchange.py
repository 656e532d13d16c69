"""Export and import: JSON lines, the legacy SQLite file, evaluation fixtures; ISO times."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "id string, content string, kind string, tags array<string>, importance double, scope string, source string, session string, valid_from string, valid_to string, "
    "entities array<struct<name:string,type:string,description:string,aliases:array<string>>>, "
    "relations array<struct<source:string,predicate:string,target:string,fact:string,exclusive:boolean,negated:boolean,valid_from:string,valid_to:string>>, supersedes array<string>, expired boolean"
)
FIXTURE = f"now string, memories array<struct<key:string,{RECORD.replace(' string', ':string').replace(' array', ':array').replace(' double', ':double').replace(' boolean', ':boolean').replace(', ', ',')}>>, queries array<struct<q:string,category:string,expect:array<string>,expect_absent:array<string>,answers:array<string>,as_of:string,include_history:boolean,k:int>>"


def iso(seconds: Column) -> Column:
    """Unix seconds as an ISO time in UTC (the session's time zone is taken to be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(tables: dict[str, DataFrame], forgotten: bool = False) -> DataFrame:
    """One export record a memory: its entities, the relations that it evidences, what it replaced; forgotten ones only if asked for."""
    m = tables["memories"]
    if not forgotten:
        m = m.where("expired_at IS NULL OR superseded_by IS NOT NULL")
    entities = tables["entities"]
    aliases = tables["entity_aliases"].groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    card = tables["mentions"].join(entities, F.col("entity_id") == entities.id).drop(entities.id).join(aliases, "entity_id", "left")
    card = card.groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("name", F.nullif("type", F.lit("")).alias("type"), F.nullif("description", F.lit("")).alias("description"), F.array_remove(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")).alias("aliases")))).alias("entities"))
    name = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    r = tables["relations"].join(name("src"), "src").join(name("dst"), "dst").join(tables["predicates"].select(F.col("id").alias("predicate_id"), "canonical", "exclusive"), "predicate_id")
    fact = F.struct(F.col("src_name").alias("source"), F.coalesce(F.nullif("text", F.lit("")), "canonical").alias("predicate"), F.col("dst_name").alias("target"), F.lit(None).cast("string").alias("fact"), "exclusive", (F.col("polarity") == 0).alias("negated"), iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_to")).alias("valid_to"))
    facts = tables["relation_evidence"].join(r.select(F.col("id").alias("relation_id"), fact.alias("x")), "relation_id").groupBy("memory_id").agg(F.sort_array(F.collect_list("x")).alias("relations"))
    replaced = tables["memories"].where("superseded_by IS NOT NULL").groupBy(F.col("superseded_by").alias("memory_id")).agg(F.sort_array(F.collect_list(F.concat(F.lit("m"), "id"))).alias("supersedes"))
    out = m.withColumnRenamed("id", "memory_id")
    for part in (card, facts, replaced):
        out = out.join(part, "memory_id", "left")
    blank = lambda c: F.nullif(c, F.lit("")).alias(c)
    return out.select(
        F.concat(F.lit("m"), "memory_id").alias("id"), "content", "kind", "tags", "importance", blank("scope"), blank("source"), blank("session"),
        iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_to")).alias("valid_to"), "entities", "relations", "supersedes", F.col("expired_at").isNotNull().alias("expired"),
    ).orderBy(F.col("id").substr(F.lit(2), F.length("id")).cast("long"))


def write_jsonl(tables: dict[str, DataFrame], path: str, forgotten: bool = False) -> None:
    records(tables, forgotten).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Export records, by a fixed schema."""
    return spark.read.schema(RECORD).json(path)


def inputs(rows: DataFrame) -> Iterator[dict]:
    """Records in id order as what remember() takes, one partition at a time on the driver."""
    for row in rows.orderBy(F.col("id").substr(F.lit(2), F.length("id")).cast("long")).toLocalIterator():
        yield {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation fixture (one JSON document), by a fixed schema."""
    return spark.read.schema(FIXTURE).option("multiLine", True).json(path)


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Memories of a legacy SQLite file, all or nothing: deleted, replaced and blank ones left out; one that has ended ends at its creation, a second after its start at the earliest."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        columns = {r[1] for r in db.execute("PRAGMA table_info(memories)")}
        extra = [c if c in columns else f"NULL AS {c}" for c in ("superseded_at", "ended")]
        rows = db.execute(f"SELECT id, kind, content, tags, agent_id, session_id, importance, created_at, occurred_at, deleted, {', '.join(extra)} FROM memories ORDER BY created_at, id").fetchall()
    df = spark.createDataFrame(rows, "id string, kind string, content string, tags string, agent string, session string, importance double, created_at long, occurred_at long, deleted int, superseded_at long, ended int")
    kept = df.where("coalesce(deleted, 0) = 0 AND superseded_at IS NULL AND trim(coalesce(content, '')) <> ''")
    start = F.coalesce("occurred_at", "created_at")
    return kept.select(
        F.trim("content").alias("content"), "kind", F.from_json("tags", "array<string>").alias("tags"), F.coalesce("agent", F.lit("")).alias("source"), F.coalesce("session", F.lit("")).alias("session"), "importance",
        start.alias("valid_from"), F.when(F.col("ended") != 0, F.greatest(F.col("created_at"), start + 1)).alias("valid_to"),
    )


def dump(rows: list[dict]) -> str:
    """JSON lines of plain dicts."""
    return "".join(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in rows)
