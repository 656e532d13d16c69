"""Operator 10: approximate nearest neighbours by score-aware anisotropic quantisation.

The nearest rows in Euclidean distance are those with the largest q.x - |x|^2 / 2: a maximum inner product,
with |x|^2 / 2 kept exactly. x is quantised in pairs of components, 16 centres a pair (four bits). An error
along x changes large inner products most, so the loss weighs the part of the residual parallel to x
ETA(d) times as much as the rest; codes are chosen by coordinate descent, centres by weighted least
squares, in turns, on SAMPLE rows at most. Every row is coded.

Search: a query's inner products with all centres make a table; two four-bit codes in a byte look up the
sum of two entries. Of each block of ROWS rows (in vec_id order, so that equal scores prefer smaller
ids), a query's SHORT best by table are measured exactly in double precision, and its best `k` so far
are kept. Queries go through in blocks of QUERIES at most, which is all that travels to the tasks.

Edge cases: a null vector, a zero one, one with null or non-finite components, one of another length than
most of the sample, and a row with a null id take no part. Of rows that repeat a query's vec_id, one
asks; none of them is its own neighbour. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 20_000
ROWS, QUERIES, SHORT = 2048, 4096, 64
SOME = 256
CENTRES = 16
THRESHOLD = 0.2
ROUNDS = 8


class Quantiser:
    """Codebooks of CENTRES centres for each pair of components."""

    def __init__(self, sample: np.ndarray):
        n, d = sample.shape
        self.d, self.pairs = d, -(-d // 2)
        self.pairs += self.pairs % 2
        x = self.padded(sample)
        #: What an error along x weighs against one across it, for inner products above THRESHOLD of the norms.
        self.eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        rng = np.random.Generator(np.random.PCG64(10))
        self.centres = np.stack([x[rng.integers(0, n, CENTRES), s] for s in range(self.pairs)])
        for _ in range(ROUNDS):
            code = self.codes(sample, 1)
            self.fit(x, code)

    def padded(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.pairs * 2))
        out[:, : self.d] = rows
        return out.reshape(len(rows), self.pairs, 2)

    def fit(self, x: np.ndarray, code: np.ndarray) -> None:
        """Centres that minimise the weighted loss for these codes, a pair at a time."""
        u = x / np.maximum(np.linalg.norm(x.reshape(len(x), -1), axis=1), 1e-30)[:, None, None]
        g = self.eta - 1
        along = np.zeros((len(x), self.pairs))
        for s in range(self.pairs):
            along[:, s] = (u[:, s] * (x[:, s] - self.centres[s, code[:, s]])).sum(axis=1)
        for s in range(self.pairs):
            rest = along.sum(axis=1) - along[:, s]
            a = np.eye(2) + g * u[:, s, :, None] * u[:, s, None, :]
            b = (a @ x[:, s, :, None])[..., 0] + g * u[:, s] * rest[:, None]
            for k in range(CENTRES):
                own = code[:, s] == k
                if own.any():
                    self.centres[s, k] = np.linalg.solve(a[own].sum(axis=0) + 1e-9 * np.eye(2), b[own].sum(axis=0))
            along[:, s] = (u[:, s] * (x[:, s] - self.centres[s, code[:, s]])).sum(axis=1)

    def codes(self, rows: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """The code of each pair, chosen a pair at a time against the parallel error of the others."""
        x = self.padded(rows)
        u = x / np.maximum(np.linalg.norm(rows, axis=1), 1e-30)[:, None, None]
        code = np.zeros((len(rows), self.pairs), np.uint8)
        along = np.zeros((len(rows), self.pairs))
        for s in range(self.pairs):
            code[:, s] = ((x[:, s, None] - self.centres[s]) ** 2).sum(axis=2).argmin(axis=1)
            along[:, s] = (u[:, s] * (x[:, s] - self.centres[s, code[:, s]])).sum(axis=1)
        for _ in range(sweeps):
            for s in range(self.pairs):
                rest = along.sum(axis=1) - along[:, s]
                r = x[:, s, None] - self.centres[s]
                p = (r * u[:, s, None]).sum(axis=2)
                loss = (r**2).sum(axis=2) + (self.eta - 1) * ((p + rest[:, None]) ** 2)
                code[:, s] = loss.argmin(axis=1)
                along[:, s] = p[np.arange(len(rows)), code[:, s]]
        return code

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        code = self.codes(rows)
        return code[:, 0::2] | code[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the inner product with what that byte stands for."""
        q = self.padded(queries)
        t = np.einsum("qsd,skd->qsk", q, self.centres)
        return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(queries), self.pairs // 2, 256).astype(np.float32)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the rows that take part, of any length."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have d components, those rows)."""
    ok = np.asarray(pc.equal(pc.list_value_length(column), d).to_numpy(zero_copy_only=False), bool)
    return ok, column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of rows (vec_id, embedding) found for each of queries (same columns)."""
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    base = usable(rows)
    sample = C.sample(base, "vec_id", SAMPLE).orderBy("vec_id", "x").limit(SAMPLE).collect()  # SAMPLE rows at most
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = Counter(len(r.x) for r in sample).most_common(1)[0][0]
    quantiser = Quantiser(np.array([r.x for r in sample if len(r.x) == d]))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                ok, x = matrix(part.column(1), d)
                if len(x):
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), pa.array([c.tobytes() for c in quantiser.pack(x)], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "code", "x"])

    coded = C.written(base.mapInArrow(code, "vec_id long, code binary, x binary"), "ann-codes")
    asking = C.written(usable(queries).where(F.size("x") == d).groupBy("vec_id").agg(F.min("x").alias("x")), "ann-queries")
    n = asking.count()
    parts = max(1, -(-n * 5 // (QUERIES * 4)))
    path = C.scratch_path(spark, "ann-found")
    for p in range(parts):
        block = [(r.vec_id, r.x) for r in asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).collect()]  # about QUERIES rows, which leave the driver before the next ones
        found, shared = search(coded, block, quantiser, k, schema)
        found.write.mode("overwrite").options(**C.WRITE).parquet(f"{path}/part={p}")
        shared.unpersist()
    out = spark.read.schema(schema).parquet(*[f"{path}/part={p}" for p in range(parts)])
    near = out.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("near"))
    return near.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def search(coded: DataFrame, queries: list, quantiser: Quantiser, k: int, schema: str) -> tuple[DataFrame, Broadcast]:
    """Each task's k nearest rows for each query, and what travels to the tasks for that."""
    ids = np.array([q[0] for q in queries], np.int64)
    asked = np.array([q[1] for q in queries], float).reshape(len(queries), quantiser.d)
    shared = coded.sparkSession.sparkContext.broadcast((ids, asked, quantiser))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, quantiser = shared.value
        best_d = np.full((len(ids), k), np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                vec_id = part.column(0).to_numpy()
                by = np.argsort(vec_id, kind="stable")
                vec_id = vec_id[by]
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(vec_id), -1)[by].T
                x = np.frombuffer(b"".join(part.column(2).to_pylist())).reshape(len(vec_id), -1)[by]
                half = (x**2).sum(axis=1).astype(np.float32) / 2
                for a in range(0, len(ids), SOME):
                    q, own = asked[a : a + SOME], ids[a : a + SOME]
                    tables = quantiser.tables(q)
                    score = np.tile(-half, (len(q), 1))
                    for s in range(len(code)):
                        score += tables[:, s][:, code[s]]
                    score[own[:, None] == vec_id[None, :]] = -np.inf
                    short = np.argsort(-score, axis=1, kind="stable")[:, :SHORT]
                    exact = np.sqrt(((x[short] - q[:, None]) ** 2).sum(axis=2))
                    name = vec_id[short]
                    exact[name == own[:, None]] = np.inf
                    dist = np.concatenate([best_d[a : a + SOME], exact], axis=1)
                    name = np.concatenate([best_i[a : a + SOME], name], axis=1)
                    order = np.lexsort((name, dist), axis=1)[:, :k]
                    best_d[a : a + SOME], best_i[a : a + SOME] = np.take_along_axis(dist, order, 1), np.take_along_axis(name, order, 1)
        q, r = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_i[q, r]), pa.array(best_d[q, r])], names=["query_id", "vec_id", "score"])

    return coded.mapInArrow(scan, schema), shared


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the ten nearest of `embeddings` for each row whose vec_id is divisible by 100."""
    rows = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(rows, rows.where("vec_id % 100 = 0"))


SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
measured AS (SELECT q.vec_id AS query_id, r.vec_id, list_distance(q.x, r.x) AS score FROM fine q JOIN fine r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM measured)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
