"""Operator 2: repeated lines, found through two Bloom filters.

A first pass hashes each line's key once a document and writes (doc_id, digests) to the shared folder:
16 bytes a line instead of its text. The digests are dealt by hash range; each range builds one Bloom
filter of the keys seen at least once and one of those seen at least twice, one document after the
other: a key that the first may already hold goes into the second. Only keys that the second may
hold shuffle further, as (digest, document), to be counted exactly. Filters have no false negatives,
so the result is exact whatever their size; it decides only how many single lines shuffle in vain.

The second filter travels to the tasks: `filter_bits` bits at most (a fixed bound), fewer where the
corpus has fewer lines. A key in a third of all documents is counted by (key, document) first and then
with partial sums, and its verdict is joined back by (key, bucket of documents).

Edge cases: a null or empty text is one empty line. Rows that repeat a doc_id are one document for
counting, and each gets that document's verdicts. A row with a null doc_id keeps all its lines and
counts for nothing. Two documents that hold a key under the limit keep it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_CHARS = 40
MIN_DOCS = 5
FILTER_BITS = 1 << 30
BUCKETS = 32
DIGEST = 16


def keys_of(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key, or None where the key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or b"").lower().split(b"\n"):
        if len(line) < min_chars:
            out.append(None)
            continue
        line = line.strip()
        n = len(line)
        if n >= min_chars and not line.isascii():
            n = len(line.decode())
        out.append(hashlib.blake2b(line, digest_size=DIGEST).digest() if n >= min_chars else None)
    return out


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, drop): digests of the keys that each document loses, concatenated; documents that lose none have no row."""
    spark = docs.sparkSession

    def digest(doc_ids, texts):
        keys = [b"".join(dict.fromkeys(k for k in keys_of(t, min_chars) if k)) for t in texts]
        return doc_ids, keys

    counted = docs.where(F.col("doc_id").isNotNull())
    hashed = C.written(C.map_text(counted, ["doc_id", "text"], "doc_id long, keys binary", digest).where(F.length("keys") > 0), "line-keys")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first 8 bytes of each key."""
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8").reshape(-1, DIGEST // 8)
            yield pa.RecordBatch.from_arrays([pa.array([keys[:, 0].tobytes()], pa.binary())], names=["h"])

    n = (hashed.agg(F.sum(F.length("keys"))).first()[0] or 0) // DIGEST
    twice = spark.sparkContext.broadcast(C.Bloom.of(hashed.select("keys").mapInArrow(heads, "h binary"), n, filter_bits, twice=True))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            joined = b"".join(raw)
            h = np.frombuffer(joined, "<u8").reshape(-1, DIGEST // 8)[:, 0]
            k = np.flatnonzero(twice.value.holds(h))
            owner = np.repeat(doc_ids, [len(x) // DIGEST for x in raw])
            yield pa.RecordBatch.from_arrays([pa.array([joined[DIGEST * i : DIGEST * (i + 1)] for i in k.tolist()], pa.binary()), pa.array(owner[k], pa.int64())], names=["key", "doc_id"])

    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    suspects = C.written(hashed.mapInArrow(probe, "key binary, doc_id long").groupBy("key", "doc_id").agg(F.lit(1).alias("one")).select("key", "doc_id", bucket), "line-suspects")
    by_bucket = suspects.groupBy("key", "bucket").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    keys = by_bucket.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("keeper"), F.collect_set("bucket").alias("buckets")).where(F.col("n") >= min_docs)
    verdicts = keys.select("key", "keeper", F.explode("buckets").alias("bucket"))
    lost = suspects.join(verdicts, ["key", "bucket"]).where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.array_join(F.collect_list(F.hex("key")), "").alias("drop"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with text after the drops, n_lines (before) and n_dropped. Rows that lose nothing are unchanged."""
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    key, drop_of = C.fresh(docs, "__id", "__drop")
    lost_keys = drops(docs.select("doc_id", "text"), min_chars, min_docs, filter_bits).select(F.col("doc_id").alias(key), F.col("drop").alias(drop_of)).hint("shuffle_hash")  # the narrow side is hashed, so that texts shuffle but are not sorted
    marked = docs.select(*others, "text").join(lost_keys, F.col("doc_id") == F.col(key), "left")
    at, lost = len(others), len(others) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, "text"):
                texts, n, gone = [], [], []
                for text, drop in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(lost).to_pylist(), strict=True):
                    lines = (text or b"").split(b"\n")
                    n.append(len(lines))
                    if drop:
                        raw = bytes.fromhex(drop)
                        bad = {raw[i : i + DIGEST] for i in range(0, len(raw), DIGEST)}
                        kept = [x for x, k in zip(lines, keys_of(text, min_chars), strict=True) if k not in bad]
                        gone.append(len(lines) - len(kept))
                        text = b"\n".join(kept)
                    else:
                        gone.append(0)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*others, "text", "n_lines", "n_dropped"])
        C.trim()

    marked = marked.select(*others, "text", drop_of)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name != drop_of) + ", n_lines long, n_dropped long"
    return marked.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: what is left of every text of `documents`, as a digest."""
    out = dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (
  SELECT doc_id, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, k, line, keeper IS NOT NULL AND keeper <> doc_id AS lost FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
