"""Operator 9: BPE encoding and decoding by tree concatenation.

A text longer than LEAF characters is halved again and again; the leaves are encoded in parallel, THREADS
parts at once (the tokenizers library lets other threads run while it encodes), and the
halves are joined from the bottom up. At a join, a window of text around it is encoded anew. Left
part, window and right part are put together where RUN successive tokens of the window agree, in id
and place, with the left part, and again with the right part; if either side has no such run, the
window doubles. In the end it covers both halves. A run has to lie MARGIN characters from the
window's ends and from the join, as a split pattern looks ahead by less than that.

Why that is exact: the split pattern scans from left to right without looking back, so two scans
that agree in a piece agree from there on; and inside a piece, a row of BPE tokens is the encoding
of its text if each two neighbours are the encoding of theirs, which left part, window and right
part each assure, as they share tokens. Tests hold it against the library on random texts.

Where the vocabulary drops white space, a leaf is a list of runs between white space; the window at a
join grows until it reaches white space on both sides, and the run across the join is encoded anew.
A run longer than a leaf goes through the tree token by token. Runs are encoded through a memo.

Edge cases: null and empty texts have no ids and decode to an empty text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common as C

LEAF = 16384
#: Parts of a long text that are encoded at once in a task.
THREADS = 2
WINDOW = 64
RUN = 3
MARGIN = 16
KEPT = "\x1c\x1d\x1e\x1f"
_RUNS = re.compile("[^\x20\x09-\x0d]+")


class Coder:
    """encode and decode texts as one tokenizers file says."""

    _made: dict[str, "Coder"] = {}

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = C.Pieces(self.tokenizer)
        self.leaf, self.window = leaf, window
        said = json.loads(self.tokenizer.to_str())
        #: White space is dropped, so that what lies between is encoded alone.
        self.drops_space = "invert" in json.dumps(said["pre_tokenizer"]) and "\\\\s" in json.dumps(said["pre_tokenizer"])
        self.digits = [str(k) for k in range(self.tokenizer.get_vocab_size())]
        self.memo = C.Memo(self._runs)
        self.spans = C.Memo(self._run_spans, 60_000)

    @classmethod
    def of(cls, path: str) -> "Coder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        C.hold("bpe", cls._made[path].drop)
        return cls._made[path]

    def drop(self) -> None:
        self.memo.drop()
        self.spans.drop()

    def _runs(self, runs: list[str]) -> list[bytes]:
        return self.pieces(runs)

    def _run_spans(self, runs: list[str]) -> list[np.ndarray]:
        """(id, start, end) of each token of each run; many runs in parallel."""
        if len(runs) < 2 or sum(map(len, runs)) < self.leaf:
            return self.pieces(runs, spans=True)
        size = -(-len(runs) // THREADS)
        with ThreadPoolExecutor(THREADS) as pool:
            return list(chain.from_iterable(pool.map(lambda k: self.pieces(runs[k : k + size], spans=True), range(0, len(runs), size))))

    def leaves(self, texts: list[str], at: list[int]) -> list[np.ndarray]:
        """(id, start, end) of the tokens of each text that begins at a place `at` of a longer one."""
        if not self.drops_space:
            return [x + np.array([0, a, a]) for x, a in zip(self._run_spans(texts), at, strict=True)]
        runs = [list(_RUNS.finditer(t)) for t in texts]
        memo = self.spans.fill(m[0] for x in runs for m in x)
        out = []
        for x, a in zip(runs, at, strict=True):
            parts = [memo[m[0]] for m in x]
            if not parts:
                out.append(np.zeros((0, 3), np.int64))
                continue
            moved = np.concatenate(parts)
            moved[:, 1:] += np.repeat(np.array([m.start() + a for m in x]), [len(p) for p in parts])[:, None]
            out.append(moved)
        return out

    def join(self, text: str, left: np.ndarray, right: np.ndarray, a: int, j: int, b: int) -> np.ndarray:
        """The tokens of text[a:b] from those of text[a:j] and text[j:b]."""
        w = self.window
        while True:
            lo, hi = max(a, j - w), min(b, j + w)
            if lo == a and hi == b:
                return self.leaves([text[a:b]], [a])[0]
            middle = self.leaves([text[lo:hi]], [lo])[0]
            first = agree(left, middle, a if lo == a else lo + MARGIN, j - MARGIN, last=False) if lo > a else (0, 0)
            second = agree(middle, right, j + MARGIN, hi - MARGIN, last=True) if hi < b else (len(middle), len(right))
            if first and second and first[1] <= second[0]:
                return np.concatenate([left[: first[0]], middle[first[1] : second[0]], right[second[1] :]])
            w *= 2

    def cuts(self, text: str) -> list[int]:
        """Where halving cuts a text into leaves."""
        cuts = [0, len(text)]
        while max(np.diff(cuts)) > self.leaf:
            cuts = sorted({*cuts, *((x + y) // 2 for x, y in zip(cuts, cuts[1:], strict=False) if y - x > self.leaf)})
        return cuts

    def tree(self, text: str) -> bytes:
        """The ids of a long text, joined token by token."""
        cuts = self.cuts(text)
        parts = self.leaves([text[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], cuts[:-1])
        while len(parts) > 1:
            joined = [self.join(text, parts[k], parts[k + 1], cuts[k], cuts[k + 1], cuts[k + 2]) for k in range(0, len(parts) - 1, 2)]
            parts, cuts = joined + parts[len(joined) * 2 :], cuts[::2] + ([cuts[-1]] if len(parts) % 2 else [])
        return parts[0][:, 0].astype("<u4").tobytes()

    def run_tree(self, text: str) -> list[str]:
        """The runs of a long text: at a join, the window grows to white space on either side, where both halves agree with it."""
        split, cuts = self.splitter(text), self.cuts(text)
        parts = [split(text[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        self.encoded({r for x in parts for r in x if len(r) <= self.leaf})
        while len(parts) > 1:
            joined = []
            for k in range(0, len(parts) - 1, 2):
                left, right, j, w = parts[k], parts[k + 1], cuts[k + 1], self.window
                lo, hi = cuts[k], cuts[k + 2]
                while (j - w > lo and split(text[j - w : j]) == [text[j - w : j]]) or (j + w < hi and split(text[j : j + w]) == [text[j : j + w]]):
                    w *= 2
                whole = split(text[max(lo, j - w) : min(hi, j + w)])
                a, b = split(text[max(lo, j - w) : j]), split(text[j : min(hi, j + w)])
                joined.append(left + right if len(whole) == len(a) + len(b) else [*left[:-1], whole[len(a) - 1], *right[1:]])
            parts, cuts = joined + parts[len(joined) * 2 :], cuts[::2] + ([cuts[-1]] if len(parts) % 2 else [])
        return parts[0]

    @staticmethod
    def splitter(text: str) -> Callable[[str], list[str]]:
        """What cuts this text into runs between white space; str.split() also cuts at four separators that the vocabulary keeps."""
        return _RUNS.findall if any(x in text for x in KEPT) else str.split

    def encoded(self, runs: set[str]) -> None:
        """Fill the memo with runs of both halves of a long text, in parallel."""
        new = [r for r in runs if r not in self.memo]
        if sum(map(len, new)) < self.leaf:
            return
        size = -(-len(new) // THREADS)
        with ThreadPoolExecutor(THREADS) as pool:
            parts = list(pool.map(lambda k: self.pieces(new[k : k + size]), range(0, len(new), size)))
        made = dict(zip(new, chain.from_iterable(parts), strict=True))
        make, self.memo.make = self.memo.make, lambda keys: [made[k] if k in made else self.pieces([k])[0] for k in keys]
        self.memo.fill(runs)
        self.memo.make = make

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.drops_space:
            short = self._runs([t if len(t) <= self.leaf else "" for t in texts])
            return [np.frombuffer(self.tree(t) if len(t) > self.leaf else g, "<u4") for t, g in zip(texts, short, strict=True)]
        runs = [self.splitter(t)(t) if len(t) <= self.leaf else self.run_tree(t) for t in texts]
        long = {r: self.tree(r) for x, t in zip(runs, texts, strict=True) if len(t) > self.leaf for r in x if len(r) > self.leaf}
        memo = self.memo.fill((r for x in runs for r in x if len(r) <= self.leaf) if long else chain.from_iterable(runs))
        get = (lambda r: long[r] if len(r) > self.leaf else memo[r]) if long else memo.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), "<u4") for x in runs]

    def texts(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def agree(x: np.ndarray, y: np.ndarray, lo: int, hi: int, last: bool) -> tuple[int, int] | None:
    """Indices in x and y of the middle of RUN successive equal tokens between lo and hi, first or last such."""
    x0, x1 = np.searchsorted(x[:, 1], [lo, hi])
    y0, y1 = np.searchsorted(y[:, 1], [lo, hi])
    p, q = x[x0:x1], y[y0:y1]
    p, q = p[p[:, 2] <= hi], q[q[:, 2] <= hi]
    if len(p) < RUN or len(q) < RUN:
        return None
    at = np.searchsorted(q[:, 1], p[:, 1])
    ok = at < len(q)
    same = np.zeros(len(p), bool)
    same[ok] = (p[ok] == q[at[ok]]).all(axis=1)
    # unique starts only: several tokens can share one character of the text
    unique = lambda v: np.concatenate([[True], v[1:, 1] > v[:-1, 1]]) & np.concatenate([v[1:, 1] > v[:-1, 1], [True]])
    same[ok] &= unique(p)[ok] & unique(q)[at[ok]]
    run = same.copy()
    for k in range(1, RUN):
        run[:-k] &= same[k:] & (at[k:] == at[:-k] + k)
        run[-k:] = False
    found = np.flatnonzero(run)
    if not len(found):
        return None
    k = found[-1 if last else 0] + RUN // 2
    return int(x0 + k), int(y0 + at[k])


def encode(docs: DataFrame, vocabulary: str, text: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row of docs (doc_id, text)."""

    def work(doc_ids, texts):
        coder = Coder.of(vocabulary)
        ids = [x.astype(np.int32) for x in coder.ids([(t or b"").decode() for t in texts])]
        return doc_ids, ids, coder.texts([x.tolist() for x in ids]) if text else [None] * len(ids)

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, ids array<int>, decoded string", work)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and its digests in one pass, so that ids and texts stay in the worker."""

    def work(doc_ids, texts):
        coder = Coder.of(vocabulary)
        n, a, b = [], [], []
        ids = [x.tolist() for x in coder.ids([(t or b"").decode() for t in texts])]
        for x, t in zip(ids, coder.texts(ids), strict=True):
            n.append(len(x))
            a.append(hashlib.sha256(" ".join(map(coder.digits.__getitem__, x)).encode()).hexdigest())
            b.append(hashlib.sha256(t.encode()).hexdigest())
        return doc_ids, n, a, b

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work, 4 << 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: encode and decode every whole text of `documents`."""
    import public_tokenizers

    return digest(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
