"""Operator 1: token ids in files, frequency-ranked, byte-aligned, with separate control bytes.

The ids of the whole corpus are counted, ranked by falling frequency (ties: smaller id), and each rank
is stored in 1 to 4 bytes. Two control bits an id (four ids a control byte) say how many; control
bytes and data bytes lie apart, so that decoding is a lookup of four lengths a control byte and a
gather over the data bytes, both vectorised.

File format (Parquet as the container, so that any store Spark reaches will do): one row a block of
whole documents, ordered by (part, block): `part` int, `block` int, `before` long (ids of this part before the block), `n_docs` int, `doc_ids` (int64
little-endian; `null_ids` tells which are null), `doc_tokens` (int64), `n_ids` long, `control`, `data`.
The rank table is written beside it, as (rank, id, n).

Edge cases: a null or empty text has the end id alone. Rows that repeat a doc_id each keep their own
place, ordered by a hash of their ids. A null doc_id comes first. An empty table gives an empty file.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCK_IDS = 1 << 18
PART_BYTES = 64 << 20
#: Lengths of the four values that a control byte announces.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1

#: Bytes of texts that are encoded at once.
TEXT_BYTES = 8 << 20
#: By byte: what is no white space whatever stands around it (0xC3 to 0xDF begin letters and marks), ASCII letters, marks that no letter joins.
SOLID = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xC3, 0xE0)])
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
MARK = np.isin(np.arange(256), list(b".,;:!?\"#$%&()*+-/=@[]^_{}~"))


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype("<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        out |= np.where(lengths > k, raw[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


class Encoder:
    """Ids of texts by a tokenizers file, through a memo of the pieces between safe cuts.

    A byte-level vocabulary with this split pattern never joins the two sides of a space that follows
    a character other than white space: there a new piece begins, whatever lies before. Nor does it join
    a line feed between characters other than white space with either of them, or a letter up to U+00FF with a mark
    after it, apostrophes aside. Pieces cut at such places have the ids they have in the whole text.
    """

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.batch = C.Pieces(self.tokenizer)
        size = self.tokenizer.get_vocab_size()
        #: Ids in memory: two bytes each where they fit.
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        #: Bytes of each token: the vocabulary is byte-level, so a token has a character a byte.
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(size)])
        self.memo = C.Memo(self.encode, 200_000)
        #: Cuts besides those at spaces, where no added token lies across one.
        self.fine = not any(self.cuts(np.frombuffer(x.content.encode(), np.uint8), True)[1:].any() for x in self.tokenizer.get_added_tokens_decoder().values())

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        C.hold("token files", cls._made[path].memo.drop)
        return cls._made[path]

    def encode(self, raw: list[bytes]) -> list[bytes]:
        """Ids of each piece. Pieces that safe cuts would set apart are encoded as one text, whose ids are dealt out by the bytes they cover."""
        out: list = [None] * len(raw)
        plain = [k for k, p in enumerate(raw) if len(p) > 1 and p[0] == 0x20 and b"<" not in p and (0x20 < p[-1] < 0x7F or p[-1] > 0x7F and not p.decode()[-1].isspace())]
        for first in range(0, len(plain), 4096):
            group = plain[first : first + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join([raw[k] for k in group]).decode()], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum([len(raw[k]) for k in group])
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
            packed, a = ids.tobytes(), 0
            for k, b in zip(group, (ids.itemsize * cuts).tolist(), strict=True):
                out[k] = packed[a:b]
                a = b
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.batch([raw[k].decode() for k in rest]), strict=True):
            out[k] = np.frombuffer(x, "<u4").astype(self.kind).tobytes()
        return out

    @staticmethod
    def cuts(text: np.ndarray, fine: bool) -> np.ndarray:
        """Whether a piece may begin at each byte of UTF-8, whatever text it is part of."""
        cut = np.zeros(len(text), bool)
        cut[1:] = (text[1:] == 0x20) & (text[:-1] > 0x20)
        at = np.flatnonzero(cut)
        at = at[text[at - 1] >= 0x80]
        if len(at):
            # white space outside ASCII: U+0085, U+00A0; U+1680, U+2000 to 200A, 2028, 2029, 202F, 205F, U+3000
            z, y, x = text[at - 1], text[at - 2], text[np.maximum(at - 3, 0)]
            two = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
            e2 = (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
            cut[at[two | e2 | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))]] = False
        if fine and len(text) > 1:
            at = np.flatnonzero(MARK[text[1:]]) + 1
            y, z = text[np.maximum(at - 2, 0)], text[at - 1]
            # U+00C0 to U+00FF but for the signs of times and division
            cut[at[LETTER[z] | ((y == 0xC3) & (z >= 0x80) & (z != 0x97) & (z != 0xB7))]] = True
            at = np.flatnonzero(text[1:-1] == 0x0A) + 1
            before = text[at - 1]
            at = at[(before > 0x20) & (before < 0x7F) & SOLID[text[at + 1]]]
            cut[at] = cut[at + 1] = True
        return cut

    def ids(self, texts: pa.Array, end: int) -> pa.Array:
        """The ids of each text (UTF-8, null: empty) and `end`, packed as `kind`."""
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        cut = self.cuts(raw, self.fine)
        cut[at[:-1][at[:-1] < at[1:]]] = True
        begins = np.append(np.flatnonzero(cut), len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(raw)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        memo = self.memo.fill(distinct)
        packed = pa.array([*map(memo.__getitem__, distinct), np.array([end], self.kind).tobytes()], pa.binary())
        # the end is one more piece of each text; the pieces' ids, taken in order, are the texts'
        ends = np.searchsorted(begins[:-1], at[1:])
        got = packed.take(pa.array(np.insert(pieces.indices.to_numpy(), ends, len(distinct))))
        upto = np.frombuffer(got.buffers()[1], np.int32)[: len(got) + 1][np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(upto.copy()), got.buffers()[2]])


def encode(docs: DataFrame, vocabulary: str, end_id: int = 0) -> tuple[DataFrame, str]:
    """(doc_id, n_tokens, ids) of each row, end_id appended, and how the ids are packed: little-endian, 2 or 4 bytes each."""
    kind = Encoder.of(vocabulary).kind
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, "text", TEXT_BYTES):
                ids = Encoder.of(vocabulary).ids(b.column(1), end_id)
                n = pc.divide(pc.binary_length(ids), width).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), n, ids], names=["doc_id", "n_tokens", "ids"])
        C.release()

    C.bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary"), kind


def rank_table(encoded: DataFrame, kind: str, path: str) -> DataFrame:
    """(rank, id, n) over all ids: as many rows as the vocabulary has, at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            if len(c) > len(n):
                n = np.concatenate([n, np.zeros(len(c) - len(n), np.int64)])
            n[: len(c)] += c
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    spark = encoded.sparkSession
    rows = sorted(counts.collect(), key=lambda r: (-r.n, r.id))  # a row an id of the vocabulary
    ranked = spark.createDataFrame([(k, r.id, r.n) for k, r in enumerate(rows)], "rank long, id long, n long")
    ranked.write.mode("overwrite").parquet(path)
    return spark.read.schema("rank long, id long, n long").parquet(path)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode docs (doc_id, text) and write the files under path (`ids`, `ranks`), in ascending doc_id order."""
    spark = docs.sparkSession
    plain = C.scratch_path(spark, "ids")
    encoded, kind = encode(docs, vocabulary, end_id)
    encoded = C.written(encoded, "ids", plain)
    ranks = [r.id for r in rank_table(encoded, kind, f"{path}/ranks").orderBy("rank").collect()]
    to_rank = np.zeros(max(ranks, default=0) + 1, "<u4")
    to_rank[ranks] = np.arange(len(ranks))
    to_rank = spark.sparkContext.broadcast(to_rank)
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-4 * total // PART_BYTES), spark.sparkContext.defaultParallelism if total > 1 << 20 else 1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, width = TaskContext.get().partitionId(), 0, np.dtype(kind).itemsize
        held: list[tuple[int | None, bytes]] = []
        size = before = 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            control, data = pack(to_rank.value[ids])
            names = [i for i, _ in held]
            columns = {
                "part": part, "block": block, "before": before, "n_docs": len(held), "doc_ids": np.array([i or 0 for i in names], "<i8").tobytes(),
                "null_ids": bytes(i is None for i in names), "doc_tokens": np.array([len(x) // width for _, x in held], "<i8").tobytes(),
                "n_ids": len(ids), "control": control, "data": data,
            }
            return pa.RecordBatch.from_pylist([columns], schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("doc_tokens", pa.binary()), ("n_ids", pa.int64()), ("control", pa.binary()), ("data", pa.binary())]))

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((i, x))
                size += len(x) // width
                if size >= BLOCK_IDS:
                    yield row()
                    before += size
                    held, size, block = [], 0, block + 1
        if held:
            yield row()

    ordered = encoded.select("doc_id", "ids").repartitionByRange(int(parts), F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    ordered.mapInArrow(blocks, FILE_SCHEMA).write.mode("overwrite").options(**C.WRITE).parquet(f"{path}/ids")
    C.drop_path(spark, plain)


FILE_SCHEMA = "part int, block int, before long, n_docs int, doc_ids binary, null_ids binary, doc_tokens binary, n_ids long, control binary, data binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files: start counts the ids of all documents before it."""
    files = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/ids")
    ids = [r.id for r in spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").orderBy("rank").collect()]
    to_id = spark.sparkContext.broadcast(np.array(ids or [0], "<u4"))
    base, at = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row a part
        base[r.part], at = at, at + r.n
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                values = to_id.value[unpack(r["control"], r["data"], r["n_ids"])]
                sizes = np.frombuffer(r["doc_tokens"], "<i8")
                cuts = np.cumsum(sizes)
                first = cuts - sizes
                nulls = np.frombuffer(r["null_ids"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=nulls), pa.array(first + base[r["part"]] + r["before"]), pa.array(sizes),
                    pa.array([values[a:z].tobytes() for a, z in zip(first, cuts, strict=True)], pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(decode, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: write the ids of `documents` and digest what the files hold."""
    import public_tokenizers

    path = C.scratch_path(spark, "token-files")
    write(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([zlib.crc32(x) for x in b.column(3).to_pylist()], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
