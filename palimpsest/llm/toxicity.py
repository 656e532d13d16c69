"""Operator 5: toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Word kernel: k(x, y) = sum over u of f_u(x) f_u(y), where u runs over three-byte subsequences that span at most
SPAN bytes, and f_u(x) sums DECAY ** (span - 3) over u's places in x; c(x, y) = k(x, y) / sqrt(k(x, x) k(y, y)),
and c ** POWER is the kernel of two words. Insults with gaps or inserted characters keep most of their
subsequences. A word is a run between white space, lower-cased A-Z, without ASCII marks, with a byte before it
that marks its start; successive one-character words also count as one word, so that spelled-out insults are seen; a
word over WIDTH bytes is cut into overlapping windows. A text is the set of its distinct words. The kernel of
two texts is the sum over all pairs of their words, plus a constant a pair: a text counts how many
words are like an insult, and against how many words.

Landmarks: the strings that tell most about which training texts are toxic (log-likelihood ratio over words), one
after the other, words that hold an earlier one being explained; a string counts only if chance hardly explains in
which texts it stands (CHANCE, over all candidates; near copies count once). Then the WHOLE most frequent words of
toxic and of clean texts that hold it, and frequent clean words. Features of a word are its kernel values with the landmarks
times the inverse square root of the landmarks' kernel matrix (Nyström); those of a text are the sum over its words and their
number, all over 1 + words / HALF, so that long texts are judged by rates and short ones by counts.

Training: labels are of documents. Positive examples are the toxic texts; the same with a character put into
each word that holds a landmark; and landmarks that no clean text has, alone, whole and torn. Negative ones are the clean texts,
an empty one and frequent clean words alone. A squared-hinge machine is fitted, then a logistic curve turns its value
into a score. Only rows of `labels` whose document is not held out are read, MOST_TOXIC and MOST_CLEAN documents at
most (the smallest hashes of doc_id; of rows that repeat a doc_id, one); identical texts count once.

Every whole text is scored. A word's part in the decision is one number, so that frequent words are looked up.

Edge cases: null and empty texts have no words. Without labels of both kinds every score is 0. Null doc_id: not
held out, scored. Repeated rows: scored alike. An empty table gives no rows. filtered() keeps all columns.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPAN, DECAY, POWER = 6, 0.7, 4
PATTERNS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]
WIDTH, OVERLAP = 32, 16
LANDMARKS, CLEAN_LANDMARKS, WHOLE = 64, 16, 3
GRAMS = range(4, 11)
MOST_TOXIC, MOST_CLEAN = 1000, 2000
#: A training text counts for landmarks until it holds so many.
COVER = 8
#: A landmark is so unlikely to be found by chance among all candidates.
CHANCE = 0.01
HALF = 100
#: So many words are taken at a time: their subsequences take some 40 MB.
CHUNK = 2000
#: What clean texts, clean words alone, toxic texts, those with torn insults, and torn insults alone weigh in training.
SHARES = (3.0, 1.0, 0.5, 0.3, 0.2)
#: Before each word, so that its start takes part in subsequences.
START = b"\x02"
CUTOFF = 0.7
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) not in " \t\n\v\f\r")
_SPELLED = re.compile(rb"(?<![^\x20\x09-\x0d])(?:[\x21-\x7e][\x20\x09]+){2,}[\x21-\x7e](?![^\x20\x09-\x0d])")


def units(text: bytes | None) -> set[bytes]:
    """The distinct words of a text without marks, spelled-out words also joined, long ones in windows."""
    if not text:
        return set()
    text = text.lower().translate(None, _MARKS)
    found = set(text.split())
    for m in _SPELLED.finditer(text):
        found.add(b"".join(m[0].split()))
    found = {START + w for w in found}
    long = [w for w in found if len(w) > WIDTH]
    if long:
        found.difference_update(long)
        for w in long:
            found.update(w[k : k + WIDTH] for k in range(0, len(w) - OVERLAP, WIDTH - OVERLAP))
    return found


def triples(words: list[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern: (word number, subsequence code, weight), for words up to WIDTH bytes."""
    m = np.array([w.ljust(WIDTH, b"\0") for w in words], f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH) if words else np.zeros((0, WIDTH), np.uint8)
    m = m[:, : max(map(len, words), default=0)].astype(np.uint32)
    for a, b, weight in PATTERNS:
        if m.shape[1] > b:
            codes = m[:, : m.shape[1] - b] << 16 | m[:, a : m.shape[1] - b + a] << 8 | m[:, b:]
            k, at = np.nonzero(m[:, b:])
            yield k, codes[k, at], weight


def profiles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence code, f) of all words, each pair once, in order."""
    got = list(triples(words))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate([k.astype(np.int64) << 24 | codes for k, codes, _ in got])
    weight = np.concatenate([np.full(len(k), w) for k, _, w in got])
    by = np.argsort(key)
    key, weight = key[by], weight[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, f = key[first], np.add.reduceat(weight, first)
    return key >> 24, key & 0xFFFFFF, f


class Model:
    """Landmarks and the decision function; words and texts are scored in numpy."""

    def __init__(self, landmarks: list[bytes], toxic: int = 0):
        k, codes, f = profiles(landmarks)
        keep = np.unique(k)
        self.landmarks, self.toxic = [landmarks[i] for i in keep], int(np.searchsorted(keep, toxic))
        self.codes, row = np.unique(codes, return_inverse=True)
        #: Subsequence x landmark, each landmark of length 1; row 0 is every other subsequence.
        self.rows = np.zeros((len(self.codes) + 1, len(keep)), np.float32)
        self.rows[row + 1, np.searchsorted(keep, k)] = f / np.sqrt(np.bincount(k, f * f, len(landmarks)))[k]
        gram = (self.rows.T @ self.rows).astype(float) ** POWER
        values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(keep)))
        self.root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
        self.weights, self.per_word, self.bias, self.slope, self.offset = np.zeros(len(keep)), 0.0, 0.0, 0.0, -50.0
        self.table = None
        self.memo = C.Memo(self.parts, 300_000)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.table, self.memo = None, C.Memo(self.parts, 300_000)

    def drop(self) -> None:
        self.table = None
        self.memo.drop()

    def kernels(self, words: list[bytes]) -> np.ndarray:
        """Kernel values of each word with each landmark."""
        if self.table is None:
            self.table = np.zeros(1 << 24, np.int16)
            self.table[self.codes] = np.arange(1, len(self.codes) + 1)
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length = np.argsort(np.array(list(map(len, words)), np.int64), kind="stable")
        for lo in range(0, len(words), CHUNK):
            part = by_length[lo : lo + CHUNK]
            k, codes, f = profiles([words[i] for i in part])
            norm = np.bincount(k, f * f, len(part))
            r = self.table[codes]
            at = np.flatnonzero(r)
            if not len(at):
                continue
            k, w, r = k[at], f[at].astype(np.float32), r[at]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            some = k[starts]
            out[part[some]] = (np.add.reduceat(self.rows[r] * w[:, None], starts, axis=0) / np.sqrt(norm[some])[:, None]) ** POWER
        return out

    def parts(self, words: list[bytes]) -> list[float]:
        """What each word adds to a text's value."""
        if not words or not len(self.landmarks):
            return [0.0] * len(words)
        return (self.kernels(words) @ (self.root @ self.weights) + self.per_word).tolist()

    def values(self, texts: list[set[bytes]]) -> list[float]:
        """The decision value of each text."""
        memo = self.memo.fill(w for t in texts for w in t)
        return [(math.fsum(map(memo.__getitem__, t)) + self.bias) / (1 + len(t) / HALF) for t in texts]

    def scores(self, texts: list[set[bytes]]) -> list[float]:
        C.hold("toxicity", self.drop)
        return [1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * v + self.offset)))) for v in self.values(texts)]

    def features(self, texts: list[set[bytes]]) -> np.ndarray:
        """Landmark features, words and 1, of each text, over 1 + words / HALF."""
        number: dict[bytes, int] = {}
        word = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int32)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        by = np.argsort(word, kind="stable").astype(np.int32)
        word, text = word[by], text[by]
        words = list(number)
        sums = np.zeros((len(texts), len(self.landmarks)))
        for lo in range(0, len(words), CHUNK):
            a, b = np.searchsorted(word, [lo, lo + CHUNK])
            np.add.at(sums, text[a:b], self.kernels(words[lo : lo + CHUNK])[word[a:b] - lo])
        n = np.array([[len(t)] for t in texts], float).reshape(-1, 1)
        return np.column_stack([sums @ self.root, n / HALF, np.ones(len(texts))]) / (1 + n / HALF)


@cache
def chance(n: int, c: int, share: float) -> float:
    """How likely a string of n + c texts is in n or more toxic ones, if a share of all texts is toxic and the string says nothing."""
    if n > 200:
        z = (n - (n + c) * share) / math.sqrt((n + c) * share * (1 - share))
        return math.erfc(z / math.sqrt(2)) / 2
    return sum(math.exp(math.lgamma(n + c + 1) - math.lgamma(k + 1) - math.lgamma(n + c - k + 1) + k * math.log(share) + (n + c - k) * math.log1p(-share)) for k in range(n, n + c + 1))


def telling(n: int, toxic: int, c: int, clean: int) -> float:
    """Log-likelihood ratio of n of the toxic and c of the clean texts holding a string; 0 where that speaks for clean."""
    if n * clean <= c * toxic:
        return 0.0
    h = lambda x, of: x * math.log(x / of) if x else 0.0
    both, of = n + c, toxic + clean
    return h(n, toxic) + h(toxic - n, toxic) + h(c, clean) + h(clean - c, clean) - h(both, of) - h(of - both, of)


def apart(texts: list[set[bytes]]) -> list[set[bytes]]:
    """One of each group of near copies (half of 16 smallest hashes alike): a copy is no further evidence."""
    seeds = C.mix64(np.arange(1, 17, dtype=np.uint64))
    marks = [C.mix64(np.array([zlib.crc32(w) for w in t] or [0], np.uint64)[:, None] ^ seeds).min(axis=0) for t in texts]
    kept: list[int] = []
    for i, m in enumerate(marks):
        if not kept or (np.array([marks[k] for k in kept]) == m).sum(axis=1).max() < 8:
            kept.append(i)
    return [texts[k] for k in kept]


def landmarks_of(toxic: list[set[bytes]], clean: list[set[bytes]]) -> tuple[list[bytes], int, list[bytes]]:
    """(landmarks, how many of them speak for toxic, those that no clean text holds)."""
    toxic = apart(toxic)
    owners: dict[bytes, list[int]] = {}
    least = max(2, len(toxic) // 200)
    # a string is in enough texts only if its start is: longer ones are looked for from the frequent shorter ones
    frequent: dict[bytes, int] = {}
    before: set[bytes] = set()
    for n in GRAMS:
        seen: Counter = Counter()
        for t in toxic:
            seen.update({g for w in t for k in range(len(w) - n + 1) if (g := w[k : k + n])[:-1] in before or n == GRAMS[0]})
        some = {g: c for g, c in seen.items() if c >= least}
        before = set(some)
        frequent |= some
    del seen, before, some
    share = len(toxic) / (len(toxic) + len(clean))
    # strings that chance explains even if no clean text holds them are counted as candidates and left out
    candidates = len(frequent)
    frequent = {g: c for g, c in frequent.items() if share**c * candidates < CHANCE}
    for i, t in enumerate(toxic):
        for g in {g for w in t for n in GRAMS for k in range(len(w) - n + 1) if (g := w[k : k + n]) in frequent}:
            owners.setdefault(g, []).append(i)
    in_clean, words_of_clean, words_of_toxic = Counter(), Counter(), Counter()
    for t in clean:
        hits = Counter(g for w in t for g in {w[k : k + n] for n in GRAMS for k in range(len(w) - n + 1)} if g in owners)
        in_clean.update(hits.keys())
        words_of_clean.update(hits)
    for t in toxic:
        words_of_toxic.update(g for w in t for g in {w[k : k + n] for n in GRAMS for k in range(len(w) - n + 1)} if g in owners)
    many, most = sum(map(len, toxic)), sum(map(len, clean))
    worth = lambda g: telling(words_of_toxic[g], many, words_of_clean[g], most)
    sure = lambda g, n: n > (n + in_clean[g]) * share and chance(n, in_clean[g], share) * candidates < CHANCE
    pool = {g: set(x) for g, x in owners.items() if sure(g, len(x))}
    chosen: list[bytes] = []
    covered: Counter = Counter()
    rest = [set(t) for t in toxic]
    while pool and len(chosen) < LANDMARKS:
        best = max(pool, key=lambda g: (worth(g), len(g), g))
        got = pool.pop(best)
        if not sure(best, len(got)):
            continue
        chosen.append(best)
        covered.update(got)
        full = {i for i in got if covered[i] >= COVER}
        # words that hold the new landmark are explained: what else they hold is not counted for them again
        for i in got:
            gone = {w for w in rest[i] if best in w}
            rest[i] -= gone
            left_over = b" ".join(rest[i])
            for g in {w[k : k + n] for w in gone for n in GRAMS for k in range(len(w) - n + 1)} & pool.keys():
                if g not in left_over:
                    pool[g].discard(i)
            words_of_toxic.subtract(g for w in gone for g in {w[k : k + n] for n in GRAMS for k in range(len(w) - n + 1)} if g in owners)
        pool = {g: left for g, x in pool.items() if len(left := x - full if full else x) >= least}
    most_of = lambda texts, fits, n: [w for w, _ in sorted(Counter(w for t in texts for w in t if fits(w)).items(), key=lambda x: (-x[1], x[0]))[:n]]
    whole = [w for g in chosen for w in most_of(toxic, lambda w: g in w and w != g, WHOLE)]  # noqa: B023
    alike = [w for g in chosen for w in most_of(clean, lambda w: g in w and w != g, WHOLE)]  # noqa: B023
    usual = most_of(clean, lambda w: len(w) >= 6, CLEAN_LANDMARKS)
    return list(dict.fromkeys([*chosen, *whole, *alike, *usual])), len(chosen), [g for g in chosen if not in_clean[g]]


def torn(word: bytes, k: int) -> bytes:
    """The word with a character put in, k choosing the place and the character."""
    first = word.startswith(START) + 1
    at = first + k % max(1, len(word) - first)
    return word[:at] + b"xz1q"[k % 4 : k % 4 + 1] + word[at:]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 60) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the examples inside the margin; the last two columns are hardly held back."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 2) + [1e-3, 1e-3])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        b, c = x[inside], cost * weight[inside]
        new = np.linalg.solve(ridge + (b * c[:, None]).T @ b, (b * c[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new)
    return w


def train(toxic: list[bytes], clean: list[bytes]) -> Model:
    """The model of labelled texts."""
    same: dict[bytes, bytes] = {}  # a word of many texts is held once
    good, bad = ([{same.setdefault(w, w) for w in units(t)} for t in dict.fromkeys(texts)] for texts in (clean, toxic))
    del same
    if not good or not bad:
        return Model([])
    marks, n, pure = landmarks_of(bad, good)
    model = Model(marks, n)
    if not model.toxic:
        return model
    found = model.landmarks[: model.toxic]
    holds = re.compile(b"|".join(map(re.escape, found)))
    gapped = [{torn(w, zlib.crc32(w)) if holds.search(w) else w for w in t} for t in bad]
    alone = [{START + x.removeprefix(START)} for g in pure for x in (g, *(torn(g, k) for k in range(4 * len(g))))]
    # nothing, and each frequent clean word alone, are clean
    nothing = [set(), *({w} for w in model.landmarks[-CLEAN_LANDMARKS:] if not holds.search(w))]
    groups = (good, nothing, bad, gapped, alone)
    x = np.concatenate([model.features(t) for t in groups if t])
    clean_ones = len(good) + len(nothing)
    y = np.concatenate([-np.ones(clean_ones), np.ones(len(x) - clean_ones)])
    weight = np.concatenate([np.full(len(t), share / max(1, len(t))) for t, share in zip(groups, SHARES, strict=True)]) * len(bad)
    w = svm(x, y, weight)
    model.weights, model.per_word, model.bias = w[:-2], float(w[-2]) / HALF, float(w[-1])
    model.memo.drop()
    # Platt's curve over the texts as they are and torn
    v = x @ w
    n = len(x) - clean_ones
    t = np.concatenate([np.full(clean_ones, 1 / (clean_ones + 2)), np.full(n, (n + 1) / (n + 2))])
    a = np.column_stack([v, np.ones(len(v))])
    c = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2), a.T @ (t - p) - 1e-4 * c)
        c += np.clip(step, -2, 2)
        if abs(step).max() < 1e-7:
            break
    model.slope, model.offset = max(float(c[0]), 0.0), float(c[1])
    model.drop()
    del good, bad, gapped, groups, x
    C.trim()
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """(toxic, clean) training texts: labelled rows that are not held out, a bounded number of each."""
    rows = labels.where(F.col("toxic").isin(0, 1) & (C.crc_mod_col("doc_id", 3) != 1)).select("doc_id", "toxic").distinct()
    ids = None
    for toxic, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        some = rows.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.union(some)
    # MOST_TOXIC + MOST_CLEAN ids at most
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text IS NOT NULL").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id", "toxic").collect()
    out = [r.text.encode() for r in got if r.toxic == 1], [r.text.encode() for r in got if r.toxic == 0]
    C.trim()
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(doc_ids, texts):
        return doc_ids, shared.value.scores([units(t) for t in texts])

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, score double", work)


def filtered(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs whose score is under cutoff, unchanged."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(train(*labelled(docs, labels)))
    at = docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for b in C.slices(whole, "text"):
                ok = [s < cutoff for s in shared.value.scores([units(t) for t in b.column(at).cast(pa.binary()).to_pylist()])]
                yield b.filter(pa.array(ok, pa.bool_()))
        C.release()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the score of each document of `documents`, learnt from `labels`."""
    docs = C.table(spark, sf_dir, "documents")
    out = score(docs, train(*labelled(docs, C.table(spark, sf_dir, "labels"))))
    held = F.coalesce(C.crc_mod_col("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
