"""Operator 4: quality rules as a short-circuit cascade.

Each rule reads a few counts of a text, takes some time and rejects some texts. Both are estimated on a
sample of SAMPLE documents (those with the smallest hashes of doc_id): the time a rule's counts take
and the share of the sample that it rejects. Rules then run by falling rejection per cost, and a text
that one rejects is not looked at by the next. The order changes the time, never the verdict: a text
is kept if no rule rejects it.

Edge cases: null and empty texts have no words and fail the base rules. Null or repeated doc_ids: each
row is judged alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common as C

SAMPLE = 500
SYMBOLS = b"#*$%&|<>"
_LATER = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def chars_of(text: bytes, words: list[bytes]) -> int:
    """Code points in words."""
    return len(text.translate(None, C.SPACE + _LATER))


def symbols_of(text: bytes, words: list[bytes]) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def dup_lines_of(text: bytes, words: list[bytes]) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def lines_of(text: bytes, words: list[bytes]) -> int:
    """Lines with a word."""
    return sum(1 for x in text.split(b"\n") if x.strip())


def repeat_words_of(text: bytes, words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    k = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    key = k[:-1] * size + k[1:]
    if size > 1 << 21:
        key = np.unique(key, return_inverse=True)[1]
    _, at, count = np.unique(key[:-1] * size + k[2:] if size <= 1 << 21 else key[:-1] * np.int64(size) + k[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    hit = np.zeros(n, bool)
    for s in range(3):
        hit[s : n - 2 + s] |= twice
    return int(hit.sum())


def uppers_of(text: bytes, words: list[bytes]) -> int:
    return len(text) - len(text.translate(None, UPPER))


def lowers_of(text: bytes, words: list[bytes]) -> int:
    return len(text) - len(text.translate(None, LOWER))


def marks_of(text: bytes, words: list[bytes]) -> int:
    return text.count(b"!")


COUNTS: dict[str, Callable[[bytes, list[bytes]], int]] = {
    "n_words": lambda text, words: len(words),
    "word_chars": chars_of,
    "n_symbols": symbols_of,
    "n_dup_lines": dup_lines_of,
    "n_lines": lines_of,
    "n_repeat_words": repeat_words_of,
    "n_upper": uppers_of,
    "n_lower": lowers_of,
    "n_marks": marks_of,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if `left` x its count > `right` x its count, in whole numbers."""

    name: str
    left: int
    count: str
    right: int
    against: str

    def rejects(self, value: Callable[[str], int]) -> bool:
        return self.left * value(self.count) > self.right * value(self.against)


#: Rejected whatever the order: too short, or half of it repeated.
BASE_WORDS, BASE_REPEATS = 50, 50
RULES = (
    Rule("symbols", 100, "n_symbols", 10, "n_words"),
    Rule("repeated lines", 100, "n_dup_lines", 60, "n_lines"),
    Rule("shouting", 100, "n_upper", 60, "n_lower"),
    Rule("exclamations", 100, "n_marks", 10, "n_words"),
    Rule("long words", 1, "word_chars", 12, "n_words"),
    Rule("short words", 2, "n_words", 1, "word_chars"),
    Rule("repeated phrases", 100, "n_repeat_words", 45, "n_words"),
)


def lazily(text: bytes, known: dict[str, int]) -> Callable[[str], int]:
    """Counts of a text, each taken when it is first asked for."""
    words: list[bytes] | None = None

    def value(name: str) -> int:
        nonlocal words
        if name not in known:
            if words is None:
                words = text.split()
            known[name] = COUNTS[name](text, words)
        return known[name]

    return value


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, free: Sequence[str] = ()) -> list[Rule]:
    """rules by falling rejection per cost on a sample of docs; the counts named in free cost nothing."""
    rows = C.sample(docs.select("doc_id", "text"), "doc_id", SAMPLE).limit(2 * SAMPLE).collect()  # SAMPLE documents
    texts = [(r.text or "").encode() for r in rows]
    split = [t.split() for t in texts]
    cost, value = {}, {}
    for name, count in COUNTS.items():
        began = time.perf_counter()
        value[name] = [count(t, w) for t, w in zip(texts, split, strict=True)]
        cost[name] = 0.0 if name in free else time.perf_counter() - began
    rate = {}
    for r in rules:
        rejected = sum(r.left * a > r.right * b for a, b in zip(value[r.count], value[r.against], strict=True))
        rate[r] = rejected / (1e-9 + cost[r.count] + cost[r.against])
    return sorted(rules, key=lambda r: (-rate[r], r.name))


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row of docs (doc_id, text)."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    cascade = ordered(docs, rules, free=base)

    def work(doc_ids, texts):
        out: list[list] = [[] for _ in range(7)]
        for t in texts:
            known: dict[str, int] = {}
            value = lazily(t or b"", known)
            for k, name in enumerate(base):
                out[k].append(value(name))
            failed = known["n_words"] < BASE_WORDS or 100 * known["n_repeat_words"] > BASE_REPEATS * known["n_words"]
            out[5].append(failed)
            out[6].append(not failed and not any(r.rejects(value) for r in cascade))
        return doc_ids, *out

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the counts and the verdict for each document of `documents`."""
    return judged(C.table(spark, sf_dir, "documents"))


SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
by_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM texts WHERE len(w) >= 3),
keyed AS (SELECT doc_id, k, w[k : k + 2] AS key FROM windows),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, key) AS n FROM keyed) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT k + s) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(s) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
  FROM texts LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 60 * n_lines OR 100 * n_upper > 60 * n_lower OR 100 * n_marks > 10 * n_words
    OR word_chars > 12 * n_words OR 2 * n_words > word_chars OR 100 * n_repeat_words > 45 * n_words) AS kept
FROM based
"""
