"""What the operators share: tables in the shared folder, Arrow batches, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() and bytes.strip() without arguments take the same six.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one, in local mode only: on a cluster executors would write where the driver cannot read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def free(spark: SparkSession) -> None:
    """Shuffle files of steps that are done go now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Intermediate tables hold hashes and packed arrays: no dictionaries, and row groups that a small executor can buffer.
WRITE = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}


def written(df: DataFrame, name: str, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").options(**WRITE | (options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece take about max_bytes (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
    if sizes.sum() <= max_bytes:
        if batch.num_rows:
            yield batch
        return
    group = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


_holder: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Called where an operator fills caches of a worker process; release() drops them."""
    _holder[name] = drop


def release() -> None:
    """At the end of a task: its caches go, as an idle worker process would keep them beside those of busy ones."""
    while _holder:
        _holder.popitem()[1]()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_text(df: DataFrame, columns: list[str], schema: str, work: Callable[..., Iterable[tuple]], max_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow over (columns..., last one is text, as UTF-8 bytes): work(lists of values) gives a list per output column."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))
    text = columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, max_bytes):
                got = work(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 1)), batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(got, out, strict=True)], schema=out)
        release()

    bounded(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.split() if text else []


def crc_mod(doc_id: int, n: int) -> int:
    """crc32 of doc_id as text, mod n."""
    return zlib.crc32(str(doc_id).encode()) % n


def crc_mod_col(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """word -> value in two generations, so that its size stays bounded and frequent words stay."""

    def __init__(self, make: Callable[[list], Iterable], limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def drop(self) -> None:
        self.clear()
        self.old = {}

    def fill(self, keys: Iterable) -> "Memo":
        """Afterwards every one of keys is in here."""
        keys = set(keys)
        new = keys.difference(self)
        if len(self) + len(new) > self.limit:
            self.old = dict(self)
            self.clear()
            new = keys
        if new:
            rest = new.difference(self.old)
            if len(rest) < len(new):
                old = self.old
                self.update([(k, old[k]) for k in new.difference(rest)])
            rest = list(rest)
            self.update(zip(rest, self.make(rest), strict=True))
        return self


class Pieces:
    """Encodes many short pieces of text in few calls of the tokenizers library.

    Pieces are joined by a special token, which the library cuts out before anything else; a piece
    that holds a `<` is encoded alone, and so are all where the vocabulary has no special token.
    """

    def __init__(self, tokenizer, many: int = 512):
        self.tokenizer, self.many = tokenizer, many
        marks = [(k, x.content) for k, x in tokenizer.get_added_tokens_decoder().items() if x.special and not x.normalized and x.content.startswith("<") and not (x.lstrip or x.rstrip or x.single_word)]
        self.mark_id, self.mark = max(marks, default=(None, None))

    def __call__(self, pieces: list[str], spans: bool = False) -> list:
        """Ids of each piece as little-endian unsigned 32-bit integers; with spans, an array with rows of (id, start, end)."""
        out: list = [None] * len(pieces)
        alone = range(len(pieces)) if self.mark is None else []
        encode = self.tokenizer.encode_batch if spans else self.tokenizer.encode_batch_fast
        for first in range(0, 0 if self.mark is None else len(pieces), self.many):
            group = range(first, min(first + self.many, len(pieces)))
            joined = self.mark.join(pieces[first : first + self.many])
            if joined.count("<") != len(group) - 1:
                alone = [*alone, *(k for k in group if "<" in pieces[k])]
                group = [k for k in group if "<" not in pieces[k]]
                joined = self.mark.join([pieces[k] for k in group])
                if not group:
                    continue
            e = encode([joined], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(group) - 1:
                raise ValueError("a piece encodes to the separator")
            if not spans:
                raw, a = ids.tobytes(), 0
                for k, b in zip(group, [*(4 * cuts).tolist(), len(raw)], strict=True):
                    out[k] = raw[a:b]
                    a = b + 4
                continue
            rows, at = self._rows(e), 0
            for k, a, b in zip(group, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                out[k] = rows[a:b] - np.array([0, at, at])
                at += len(pieces[k]) + len(self.mark)
        for k, e in zip(alone, self.tokenizer.encode_batch([pieces[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = self._rows(e) if spans else np.array(e.ids, "<u4").tobytes()
        return out

    @staticmethod
    def _rows(e) -> np.ndarray:
        return np.column_stack([np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)]) if e.ids else np.zeros((0, 3), np.int64)


#: Bloom filters: places a key, ranges of keys that tasks build alone, keys a range at most before there are more ranges.
PROBES, RANGES, MOST_RANGES, RANGE_KEYS, BITS_A_KEY = 4, 64, 4096, 1 << 24, 16


class Bloom:
    """A Bloom filter over 64-bit hashes, built by range in the tasks; `most_bits` bounds it."""

    def __init__(self, rows: np.ndarray, bits: int, shift: int):
        self.rows, self.bits, self.shift = rows, bits, shift

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = _places(h, self.bits)
        found = self.rows[(h >> np.uint64(self.shift)).astype(np.int64)[:, None], at >> np.uint64(3)]
        return ((found >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    @classmethod
    def of(cls, hashes: DataFrame, n: int, most_bits: int, twice: bool = False) -> "Bloom":
        """Of the hashes in a binary column of packed little-endian 64-bit hashes, n in all; with twice, of those that two rows hold or more."""
        ranges = RANGES
        while ranges < MOST_RANGES and n > RANGE_KEYS * ranges:
            ranges *= 2
        shift = 65 - ranges.bit_length()
        bits = 1 << 10
        while bits * ranges < min(most_bits, BITS_A_KEY * n):
            bits *= 2

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8")
                r = (h >> np.uint64(shift)).astype(np.int64)
                order = np.argsort(r, kind="stable")
                cuts = np.searchsorted(r[order], np.arange(ranges + 1))
                rows = [(k, h[order[x:y]].tobytes()) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["r", "h"])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            once: dict[int, np.ndarray] = {}
            again: dict[int, np.ndarray] = {}
            for b in batches:
                for r, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if r not in once:
                        once[r], again[r] = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                    first, count = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
                    at = _places(first, bits)
                    if twice:
                        seen = ((once[r][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1) | (count > 1)
                        _put(again[r], at[seen])
                    _put(once[r], at)
            kept = again if twice else once
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([x.tobytes() for x in kept.values()], pa.binary())], names=["r", "bits"])

        rows = np.zeros((ranges, bits // 8), np.uint8)
        for row in hashes.mapInArrow(deal, "r int, h binary").repartition(ranges, "r").mapInArrow(build, "r int, bits binary").collect():  # most_bits at most
            rows[row.r] = np.frombuffer(row.bits, np.uint8)
        trim()
        return cls(rows, bits, shift)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    a, b = mix64(h), mix64(h ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def _put(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows with the n smallest hashes of key (and rows that repeat such a key): ids are chosen first, so that only they travel from every partition."""
    ids = df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(n).distinct()
    return df.join(F.broadcast(ids), key, "left_semi")  # n ids


#: What a batch of Arrow rows on its way to Python takes at most, so that workers stay small on small executors.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by size (the session's own bound stays if it is smaller)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower()
    size = int(now.rstrip("bkmg") or 0) << {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, longer ones where df has such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
