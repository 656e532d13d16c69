"""A store: one Parquet folder a table and generation, and a manifest a generation.

A write makes a new generation's folders and then its manifest, under the next number and only if nobody has written that one: a
reader takes the highest whole manifest, so that it sees all of a write or none, and of two writers one is refused.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schema

VERSION = 4


class Store:
    """Tables by name, as of the current generation."""

    def __init__(self, spark: SparkSession, path: str, embedder: str = "hash"):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self._newest()
        if found:
            self.manifest = found
            if self.manifest["embedder"] != embedder:
                raise ValueError(f"the store was written with embedder {self.manifest['embedder']}")
            if self.manifest["version"] != VERSION:
                raise ValueError(f"schema version {self.manifest['version']}, not {VERSION}")
        else:
            self.manifest = {"generation": 0, "embedder": embedder, "version": VERSION, "at": {}}
            self.commit({"predicates": spark.createDataFrame(schema.seed_predicates(), schema.TABLES["predicates"])})

    def _newest(self) -> dict | None:
        """The highest manifest that is whole; one that a crash has cut short counts as not written."""
        for status in sorted(self._fs.globStatus(self._path(f"{self.path}/manifest-*.json")) or [], key=lambda x: x.getPath().getName(), reverse=True):
            raw = "".join(r.value for r in self.spark.read.text(status.getPath().toString(), wholetext=True).collect())
            try:
                return json.loads(raw)
            except ValueError:
                continue
        return None

    @property
    def generation(self) -> int:
        return self.manifest["generation"]

    def table(self, name: str) -> DataFrame:
        at = self.manifest["at"].get(name)
        if at is None:
            return self.spark.createDataFrame([], schema.TABLES[name])
        return self.spark.read.schema(schema.TABLES[name]).parquet(f"{self.path}/{name}/{at}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Make the given tables the current ones; the others stay as they are."""
        n = self.generation + 1
        while self._fs.exists(self._path(f"{self.path}/manifest-{n:012d}.json")) and self._newest()["generation"] == self.generation:
            n += 1  # the remains of a crash
        folder = f"generation={n}-{uuid.uuid4().hex[:8]}"  # a refused writer's rows stay apart
        for name, df in tables.items():
            df.select(*[c.split()[0] for c in schema.TABLES[name].split(", ")]).write.mode("overwrite").parquet(f"{self.path}/{name}/{folder}")
        manifest = self.manifest | {"generation": n, "at": self.manifest["at"] | dict.fromkeys(tables, folder)}
        name = self._path(f"{self.path}/manifest-{n:012d}.json")
        try:
            out = self._fs.create(name, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"generation {n} was written by another writer; open the store again") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self.manifest = manifest

    def upsert(self, changed: dict[str, list[tuple]], keys: dict[str, list[str]]) -> None:
        """Replace rows by key and add new ones, in one commit."""
        tables = {}
        for name, rows in changed.items():
            if rows:
                new = self.spark.createDataFrame(rows, schema.TABLES[name])
                old = self.table(name).join(F.broadcast(new.select(*keys[name]).distinct()), keys[name], "left_anti")  # rows of one batch
                tables[name] = old.select(*new.columns).unionByName(new)
        if tables:
            self.commit(tables)
