"""Operator 8: near duplicates by an inverted join over signature coordinates.

1. Each text's set of five-word shingles gives a MinHash signature of COORDINATES values. Texts with equal
   sets are one class (its smallest doc_id stands for it); all that follows is about classes.
2. Each class is posted under its (coordinate, value) tokens. Two classes collide as often as they share
   tokens; of pairs at the threshold, all but about one in a million collide at least MATCHES times.
   So a token that one class alone has is dropped, then a class with fewer than MATCHES tokens left
   (skip merging), and of the rest only the rarest tokens are posted: two classes that share MATCHES
   of COORDINATES tokens share one of the first COORDINATES - MATCHES + 1 in any common order
   (prefix merging).
3. Posting lists never become all their pairs. In each of ROUNDS rounds, a list's members are compared with
   one pivot, and links are confirmed on the full shingle sets; linked classes fall into one component.
   Then only lists that still hold several components go on, and at last the members of those lists are
   joined block by block: collisions are counted in the block, pairs of different components that collide
   MATCHES times or more are confirmed there on full sets too, and only links that join components
   leave the block. Pairs inside a component need no comparison, as a link between them changes nothing.

Shingles are 64-bit hashes of five word hashes; a pair of sets of 1,000 shingles has a chance of about
1e-13 that two differ in text and not in hash.

Edge cases: a text without words has an empty set and links with nothing. Rows that repeat a doc_id are
each judged; the doc_id is one node, of the first of its sets. A row with a null doc_id links with
nothing; its component_id is null and it is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
COORDINATES = 64
MATCHES = 30
PERCENT = 75
ROUNDS = 3
BLOCK, BLOCK_SHINGLES = 256, 100_000
BUCKETS = 32
FILTER_BITS = 1 << 28

_rng = np.random.Generator(np.random.PCG64(8))
_MULTIPLY = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def _word_hashes(words: list[bytes]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words]


_memo = C.Memo(_word_hashes)


def shingles(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    C.hold("near dedup", _memo.drop)
    split = [(t or b"").lower().split() for t in texts]
    memo = _memo.fill(w for x in split for w in x)
    out = []
    for x in split:
        h = np.array([memo[w] for w in x], np.uint64)
        if len(h) >= SHINGLE:
            s = np.zeros(len(h) - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                s = C.mix64(s * np.uint64(3) + h[k : len(h) - SHINGLE + 1 + k] + np.uint64(1))
        elif len(h):
            s = np.full(1, len(h), np.uint64)
            for k in range(len(h)):
                s = C.mix64(s * np.uint64(5) + h[k : k + 1] + np.uint64(7))
        else:
            s = h
        out.append(np.unique(s))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES minima, 32 bits each."""
    out = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for a in range(0, len(s), 2048):
        got = (s[a : a + 2048] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)
        out = np.minimum(out, got.min(axis=1).astype(np.uint32))
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of each row."""

    def work(doc_ids, texts):
        sets = shingles(texts)
        return doc_ids, [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [signature(s).tobytes() for s in sets]

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, n_shingles long, digest binary, sig binary", work, 2 << 20)


def postings(classes: DataFrame) -> DataFrame:
    """(rep, token): COORDINATES rows a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                tokens = tokens_of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), COORDINATES)), pa.array(tokens.ravel())], names=["rep", "token"])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, token long")


def tokens_of(sigs: list[bytes]) -> np.ndarray:
    values = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, COORDINATES).astype(np.uint64)
    return C.mix64(values << np.uint64(8) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def prefixes(classes: DataFrame) -> DataFrame:
    """(token, rep, popular): the rarest tokens of each class that can still collide MATCHES times; popular sums its tokens' classes."""
    posted = postings(classes)
    shared = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    kept = posted.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("x"), F.sum("n").alias("popular")).where(F.size("x") >= MATCHES)
    # the COORDINATES - size(x) tokens that no other class has come first in the order
    return kept.select("rep", "popular", F.explode(F.expr(f"slice(x, 1, size(x) - {MATCHES} + 1)")).alias("y")).select(F.col("y.token").alias("token"), "rep", "popular")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, set) for the classes in wanted (rep), and a few others: packed shingle hashes, sorted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([C.mix64(b.column(0).to_numpy().view(np.uint64)).tobytes()], pa.binary())], names=["h"])

    hashes = wanted.select("rep").mapInArrow(pack, "h binary")
    bloom = docs.sparkSession.sparkContext.broadcast(C.Bloom.of(hashes, wanted.count(), FILTER_BITS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ok = bloom.value.holds(C.mix64(whole.column(0).to_numpy().view(np.uint64)))
            for b in C.slices(whole.filter(pa.array(ok)), "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles(b.column(1).cast(pa.binary()).to_pylist())], pa.binary())], names=["rep", "set"])
        C.release()

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(work, "rep long, set binary").where(F.length("set") > 0)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b), those whose full sets are near enough."""
    salt = F.pmod(F.xxhash64("b"), F.lit(BUCKETS)).alias("salt")
    pairs = pairs.select("a", "b", salt).hint("shuffle_hash")
    left = pairs.select("a", "salt").distinct().hint("shuffle_hash").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
    right = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    both = right.join(left, ["a", "salt"]).select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(k, 500) for w in batches for k in range(0, w.num_rows, 500)):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        C.trim()

    return both.mapInArrow(check, "a long, b long")


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (rep, comp) after links (a, b): components that a link joins take the smallest label."""
    ends = links.join(component.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(component.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
    edges = C.written(ends.where("ca <> cb").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct(), "near-edges")
    while edges.head(1):
        # each label hooks to its smallest neighbour, then chains of hooks are shortened to their roots
        hook = C.written(edges.union(edges.select("v", "u")).groupBy(F.col("u").alias("label")).agg(F.min("v").alias("to")).select("label", F.least("label", "to").alias("root")), "near-hooks")
        while True:
            up = hook.select(F.col("label").alias("root"), F.col("root").alias("above"))
            hook = C.written(hook.join(up, "root").select("label", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "near-hooks")
            done = not hook.where("moved").head(1)
            hook = hook.select("label", "root")
            if done:
                break
        component = C.written(component.join(hook, component.comp == hook.label, "left").select("rep", F.coalesce("root", "comp").alias("comp")), "near-components")
        edges = C.written(
            edges.join(hook.select(F.col("label").alias("u"), F.col("root").alias("ru")), "u", "left").join(hook.select(F.col("label").alias("v"), F.col("root").alias("rv")), "v", "left")
            .select(F.coalesce("ru", "u").alias("x"), F.coalesce("rv", "v").alias("y")).where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(),
            "near-edges",
        )
    return component


def mixed(lists: DataFrame, component: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Members (token, rep, comp) and, of lists with several components, (token, pivot, pivot_comp, first)."""
    members = lists.join(component, "rep")
    # an original shares its tokens with all its copies, which share fewer among themselves: it is the first pivot
    order = F.col("popular") if not seed else F.xxhash64(F.lit(seed), "rep")
    pivot = F.max(F.struct(order, (-F.col("rep")).alias("rep"), "comp"))
    heads = members.groupBy("token").agg(pivot.alias("p"), F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last")
    return members, heads.select("token", (-F.col("p.rep")).alias("pivot"), F.col("p.comp").alias("pivot_comp"), "first")


def blocks(members: DataFrame, heads: DataFrame, component: DataFrame, classes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join components: lists that share members form a cluster, whose members are compared in blocks, two at a time.

    In each pair of blocks, collisions leave out what cannot be near; intersections of the rest are counted
    on the full sets by multiplying their incidence matrices, and only links that join components leave it.
    """
    rows = members.join(heads.select("token", "first"), "token").select("rep", "comp", "first").distinct()
    rows = C.written(rows, "near-mixed")
    start = component.select(F.col("comp").alias("rep")).distinct().select("rep", F.col("rep").alias("comp"))
    cluster = merged(C.written(start, "near-clusters"), rows.select(F.col("first").alias("a"), F.col("comp").alias("b")).where("a <> b").distinct()).select(F.col("rep").alias("comp"), F.col("comp").alias("cluster"))
    held = rows.select("rep", "comp").distinct().join(cluster, "comp").join(classes.select("rep", "sig", "n_shingles"), "rep")
    held = C.written(held, "near-held")
    sizes = held.groupBy("cluster", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")).groupBy("cluster").agg(
        F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    each = F.least(F.lit(BLOCK), F.greatest(F.lit(8), F.floor(F.col("n") * BLOCK_SHINGLES / F.col("m"))))
    sizes = sizes.select("cluster", F.col("big.comp").alias("big"), F.ceil((F.col("n") - F.col("big.n")) / each).cast("int").alias("rest"), F.ceil(F.col("big.n") / each).cast("int").alias("of_big"))
    # blocks of the largest component are compared with the others only
    dealt = held.join(sizes, "cluster").withColumn("is_big", F.col("comp") == F.col("big"))
    h = F.xxhash64("rep")
    dealt = dealt.withColumn("own", F.when(F.col("is_big"), F.col("rest") + F.pmod(h, "of_big")).otherwise(F.pmod(h, "rest")).cast("int"))
    others = F.when(F.col("is_big"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("of_big") - 1))
    dealt = dealt.where("rest > 0").join(sets, "rep").withColumn("other", F.explode(others))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "sig", "set")

    def join(key, table):
        rep, comp, own = table["rep"].to_numpy(), table["comp"].to_numpy(), table["own"].to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(-1, COORDINATES)
        near = np.zeros((len(left), len(right)), bool)
        for k, x in enumerate(left):
            near[k] = ((sigs[right] == sigs[x]).sum(axis=1) >= MATCHES) & (comp[right] != comp[x])
        left, right, near = left[near.any(axis=1)], right[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
        found: list[tuple[int, int]] = []
        if len(left):
            packed = table["set"]
            x, y = [np.frombuffer(packed[k].as_buffer(), "<u8") for k in left], [np.frombuffer(packed[k].as_buffer(), "<u8") for k in right]
            size_x, size_y = np.array(list(map(len, x))), np.array(list(map(len, y)))
            words, number = np.unique(np.concatenate(x + y), return_inverse=True)
            both = np.zeros((len(x), len(y)), np.float32)
            owner = np.repeat(np.arange(len(x) + len(y)), np.concatenate([size_x, size_y]))
            by = np.argsort(number, kind="stable")
            owner, number = owner[by], number[by]
            for lo in range(0, len(words), 8192):
                a, b = np.searchsorted(number, [lo, lo + 8192])
                m = np.zeros((len(x) + len(y), min(8192, len(words) - lo)), np.float32)
                m[owner[a:b], number[a:b] - lo] = 1
                both += m[: len(x)] @ m[len(x) :].T
            both = both.astype(np.int64)
            near &= 100 * both >= percent * (size_x[:, None] + size_y[None, :] - both)
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for p, q in zip(*np.nonzero(near), strict=True):
                u, v = int(left[p]), int(right[q])
                a, b = find(int(comp[u])), find(int(comp[v]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(rep[u]), int(rep[v])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(join, "a long, b long")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    marks = C.written(signed(docs), "near-signatures")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    real = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    part = real.groupBy("digest", bucket).agg(F.min("doc_id").alias("rep"))
    classes = C.written(part.groupBy("digest").agg(F.min("rep").alias("rep"), F.collect_set("bucket").alias("buckets")), "near-classes")
    # a doc_id with several rows can stand for several classes: they are one node
    heads = C.written(real.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "sig", "n_shingles"), "near-heads")
    lists = C.written(prefixes(heads), "near-prefixes")
    wanted = C.written(lists.select("rep").distinct(), "near-wanted")
    component = wanted.select("rep", F.col("rep").alias("comp"))
    sets = None
    for seed in range(ROUNDS):
        members, pivots = mixed(lists, component, seed)
        near = members.join(pivots, "token").where("comp <> pivot_comp").groupBy("rep", "pivot").agg(F.count("*").alias("n"))
        pairs = C.written(near.groupBy("rep").agg(F.max(F.struct("n", (-F.col("pivot")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), F.col("rep").alias("b")), "near-pairs")
        if not pairs.head(1):
            break
        if sets is None:
            sets = C.written(sets_of(docs, wanted), "near-sets")
        component = merged(component, C.written(confirm(pairs, sets), "near-links"))
    else:
        members, pivots = mixed(lists, component, ROUNDS)
        component = merged(component, C.written(blocks(members, pivots, component, heads, sets), "near-links"))
    named = classes.join(component, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"), F.explode("buckets").alias("bucket"))
    out = marks.select("doc_id", "n_shingles", "digest", bucket).join(named, ["digest", "bucket"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their group, unchanged."""
    found = components(docs)
    lost = found.where(~F.col("kept")).select("doc_id").distinct().hint("shuffle_hash")  # texts shuffle but are not sorted
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the group of each document of `documents`."""
    return components(C.table(spark, sf_dir, "documents"))


SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n_shingles, s FROM sets),
shingle AS (SELECT doc_id, n_shingles, hash(unnest(s)) AS h FROM sizes),
near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.h = b.h AND a.doc_id < b.doc_id
  AND 100 * a.n_shingles >= 75 * b.n_shingles AND 100 * b.n_shingles >= 75 * a.n_shingles
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 75 * (a.n_shingles + b.n_shingles - count(*))),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a)
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n_shingles::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN reach USING (doc_id)
"""
