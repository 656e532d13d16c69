"""Operator 3: mixing domains to target weights by soft membership.

A classifier learnt from a labelled table (naive Bayes over hashed words, with a softened posterior) gives
each document a posterior over domains. Document rates r >= 0 then minimise

    sum over d of (sum over i of r_i t_i p_id - T_d)^2 / (2 N_d) + RIDGE sum over i of t_i (r_i - 1)^2 / 2,

t_i being the document's words, N_d the expected words of domain d at rates of 1 and T_d its target: the expected domain totals meet their
targets, and rates stay near 1 where nothing asks otherwise. Rates have no upper bound unless one is given. Projected gradient steps with momentum
solve it, each in the metric of the t_i. A step needs only the vector of domain residuals: a rate is a
function of a document's posterior and of the residuals so far, so nothing but one sum a domain comes
back from the tasks, no rates are stored, and a lost task is simply run again. Steps end when every domain
is within TOLERANCE of all words, or when STALL steps have not brought the largest miss down by a fiftieth;
what was reached is logged, as a warning if targets were missed.

Where no document may shrink, a total has to be found that leaves room: raising one domain raises others too, as
posteriors are soft. With G_de = sum over i of t_i p_id p_ie, rates 1 + p_i x give the totals G (1 + x), so that shares w
are met at total T by x = T G^-1 w - 1: T is the least at which x >= 0, GROW times the least at which no domain shrinks at most.

The classifier reads LABELLED labelled documents at most (the smallest hashes of doc_id), of the DOMAINS
most frequent domains among them; totals and rates cover all documents.

A rate becomes copies: its whole part, and one more with its fraction as chance, by a hash of doc_id.

Edge cases: null and empty texts have no words, the prior as posterior, and the rate that it gives. Null
labels are not learnt from. Without any labelled document every rate is 1 (or the bound next to it).
Repeated rows each count. Domains without a target weigh 0; a target domain that no label has is
left out and the others' weights are scaled up.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LABELLED, DOMAINS = 2000, 64
BUCKETS = 1 << 15
SOFT = 1.5
RIDGE, STEPS, STALL, TOLERANCE = 1e-4, 300, 15, 1e-3
#: What "grow" may make of the least total at which no domain shrinks, at most.
GROW = 2.0
#: Token shares that the query and the pipeline ask for.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def _buckets(words: list[bytes]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") % BUCKETS for w in words]


_memo = C.Memo(_buckets)


def features(texts: list[bytes | None]) -> list[np.ndarray]:
    """The hashed words of each text."""
    C.hold("mixing", _memo.drop)
    split = [(t or b"").lower().split() for t in texts]
    memo = _memo.fill(w for x in split for w in set(x))
    return [np.fromiter(map(memo.__getitem__, x), np.int64, len(x)) for x in split]


class Classifier:
    """Posteriors over domains."""

    def __init__(self, texts: list[bytes], labels: list[str]):
        self.domains = sorted(set(labels))
        at = {d: k for k, d in enumerate(self.domains)}
        counts = np.full((len(self.domains), BUCKETS), 0.05)
        prior = np.zeros(len(self.domains))
        for f, d in zip(features(texts), labels, strict=True):
            counts[at[d]] += np.bincount(f, minlength=BUCKETS)
            prior[at[d]] += 1
        self.prior = np.log(prior / prior.sum()) if labels else prior
        self.weights = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)

    def posteriors(self, found: list[np.ndarray]) -> np.ndarray:
        """A row a text. SOFT words' worth of evidence at most, so that mixed texts stay mixed."""
        out = np.tile(self.prior, (len(found), 1))
        if not self.domains:
            return out
        for k, f in enumerate(found):
            if len(f):
                out[k] += self.weights[f].mean(axis=0) * min(len(f), SOFT)
        p = np.exp(out - out.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def learnt(docs: DataFrame, labels: DataFrame, domain: str) -> Classifier:
    """A classifier of column `domain`, from the documents that labels (doc_id) lists."""
    listed = labels.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = docs.select("doc_id", "text", F.col(domain).cast("string").alias("d")).join(F.broadcast(listed), "doc_id").where("text IS NOT NULL AND d IS NOT NULL").orderBy("doc_id", "text").limit(LABELLED).collect()  # LABELLED rows at most
    names = [r.d for r in rows]
    usual = sorted(set(names), key=lambda d: (-names.count(d), d))[:DOMAINS]
    rows = [r for r in rows if r.d in usual]
    return Classifier([r.text.encode() for r in rows], [r.d for r in rows])


class Rates:
    """Rates as a function of posteriors, by the residuals of the steps so far."""

    def __init__(self, low: float, high: float):
        self.low, self.high, self.residuals = low, high, []

    def of(self, p: np.ndarray) -> np.ndarray:
        """After the last step; `ahead` gets where the next gradient is taken."""
        r = np.clip(np.ones(len(p)), self.low, self.high)
        self.ahead = r
        size = 1 / (1 + RIDGE)
        for k, e in enumerate(self.residuals):
            new = np.clip(self.ahead - size * (p @ e + RIDGE * (self.ahead - 1)), self.low, self.high)
            self.ahead = np.maximum(new + k / (k + 3) * (new - r), 0)
            r = new
        return r


def rated(docs: DataFrame, classifier: Classifier, targets: dict[str, float] = TARGETS, low: float = 0.0, high: float = float("inf"), total: float | str | None = None) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) of each row of docs (doc_id, text). total: tokens to aim at (None: what there is; "grow": so many that no document need shrink)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(classifier)

    def describe(doc_ids, texts):
        found = features(texts)
        return doc_ids, [len(f) for f in found], shared.value.posteriors(found).tolist()

    table = C.written(C.map_text(docs, ["doc_id", "text"], "doc_id long, n_tokens long, posterior array<double>", describe), "mix-posteriors")
    n = len(classifier.domains)
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in classifier.domains])
    rates = Rates(low, high)

    def totals(residuals: list[np.ndarray]) -> np.ndarray:
        """The expected tokens of each domain where the next gradient is taken, and at the rates themselves."""
        rates.residuals = residuals
        held = rates

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 * n)
            for b in batches:
                t, p = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, n)
                r = held.of(p)
                out += np.concatenate([(held.ahead * t) @ p, (r * t) @ p])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * n)), pa.array(out)], names=["k", "v"])

        return summed(run, 2 * n)

    def summed(run, size: int) -> np.ndarray:
        got = {r.k: r.v for r in table.select("n_tokens", "posterior").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}  # size rows
        return np.array([got.get(k, 0.0) for k in range(size)])

    def shared_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words that each two domains share at rates of 1."""
        out = np.zeros((n, n))
        for b in batches:
            t, p = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, n)
            out += (p * t[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(out.ravel())], names=["k", "v"])

    def room(now: np.ndarray) -> float:
        """The total at which rates of 1 or more can meet the targets."""
        least = float(np.max(now[weights > 0] / weights[weights > 0]))
        some = weights > 0
        part = np.linalg.lstsq(summed(shared_words, n * n).reshape(n, n)[some][:, some], weights[some], rcond=None)[0].min()
        return min(GROW * least, max(least, 1 / part)) if part > 0 else GROW * least

    residuals: list[np.ndarray] = []
    if n and weights.sum() > 0:
        weights /= weights.sum()
        now = totals([])[n:]
        whole = float(now.sum())
        if whole > 0:
            goal = weights * (room(now) if total == "grow" else whole if total is None else total)
            scale = np.maximum(now, 1e-9 * whole)
            least, best, mark, since = np.inf, 0, np.inf, 0
            for k in range(STEPS + 1):
                got = totals(residuals)
                miss = np.abs(got[n:] - goal).max() / goal.sum()
                if miss < least:
                    least, best, reached = miss, k, got[n:]
                if miss < 0.98 * mark:
                    mark, since = miss, k
                if miss < TOLERANCE or k - since >= STALL:
                    break
                residuals = [*residuals, (got[:n] - goal) / scale]
            residuals = residuals[:best]
            logging.getLogger(__name__).log(
                logging.INFO if least < TOLERANCE else logging.WARNING, "mixing: words reached (aimed at) after %d steps: %s", best, ", ".join(f"{d} {x:.0f} ({g:.0f})" for d, x, g in zip(classifier.domains, reached, goal, strict=True))
            )
    final = Rates(low, high)
    final.residuals = residuals

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).flatten().to_numpy().reshape(-1, n) if n else np.zeros((b.num_rows, 0))
            rate = final.of(p) if n else np.clip(np.ones(b.num_rows), low, high)
            chance = C.mix64(b.column(0).fill_null(0).to_numpy().view(np.uint64) + np.uint64(3)) / 2.0**64
            copies = np.floor(rate + 1e-9) + (chance < rate - np.floor(rate + 1e-9))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate), pa.array(copies.astype(np.int32))], names=["doc_id", "n_tokens", "posterior", "rate", "copies"])

    return table.mapInArrow(apply, "doc_id long, n_tokens long, posterior array<double>, rate double, copies int")


def mixed(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, each as often as its rate says, once at least: domains that fall short are repeated until shares match."""
    found = rated(docs, learnt(docs, labels, domain), targets, low=1.0, total="grow")
    key, n, k = C.fresh(docs, "__id", "__n", "__k")
    copies = found.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(n)).hint("shuffle_hash")  # texts shuffle but are not sorted
    more = F.explode(F.sequence(F.lit(1), F.coalesce(n, F.lit(1))))
    return docs.join(copies, docs["doc_id"] == copies[key], "left").withColumn(k, more).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: a rate for each document of `documents`, for the shares in TARGETS of languages, which the rows in `labels` teach."""
    docs = C.table(spark, sf_dir, "documents")
    return rated(docs, learnt(docs, C.table(spark, sf_dir, "labels"), "lang"))
