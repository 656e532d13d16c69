"""Operator 7: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing is assumed of its
insides: the first k + 1 turns are rendered and compared with the rendering of the first k. Where the
longer string continues the shorter one, the new part is the span of turn k; where it does not, the
template has rewritten history (it moved, merged or re-rendered earlier turns), and the conversation
is marked so, with the place of the first difference. Inside a span, the turn's own text is found by
rendering the turn twice more, with texts that differ in one character.

A template that declares nothing is rendered from whole prefixes at every turn, which costs the square of the turns. One that declares
`stateless_after` = n (the turns before the last n do not change the new part) is rendered from the last n turns and compared, at every
turn, with what twice as many and two more give, and with what the last 2 d turns give, where d is the largest power of two that divides the
turn's number: at powers of two that is the whole prefix. All of them have to agree, or the template is refused. These rules know turns only:
they are the same for conversations of any length and size.

Turns of a conversation come sorted to one task, which holds the conversation so far.

Template of the query: each turn is `[ROLE]` in marks of its own, text, end mark. Control strings inside
texts are escaped with a backslash, reversibly.

Edge cases: a null text is empty, a null role is the empty role, null turns come first; turns with equal
numbers are ordered by role and text. Rows with a null conv_id are one conversation. Conversations
without an assistant have an empty loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

Turn = tuple[str, str]

OPEN, CLOSE = "[INST:", "]"
END = "</s>"
#: Control strings, and the escape character itself.
_ESCAPE = re.compile(r"\\|</s>|\[/?INST")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""A backslash before each control string and each backslash."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def template(turns: list[Turn]) -> str:
    """[INST:role]text</s> for each turn, control strings in role and text escaped (in a role also `]`)."""
    return "".join(f"{OPEN}{escape(role).replace(CLOSE, chr(92) + CLOSE)}{CLOSE}{escape(text)}{END}" for role, text in turns)


template.stateless_after = 1  # type: ignore[attr-defined]

_TURN = re.compile(r"\[INST:((?:[^\\\]]|\\.)*)\]((?:[^\\<]|\\.|<(?!/s>))*)</s>", re.S)


def parse(formatted: str) -> list[Turn]:
    """The turns of a string that template() made."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at {at}")
    return out


def common(a: str, b: str) -> int:
    """Length of the common start."""
    if a == b[: len(a)]:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


class Render:
    """Spans of successive turns by a black-box template."""

    def __init__(self, render: Callable[[list[Turn]], str]):
        self.render = render
        self.keep = getattr(render, "stateless_after", None)
        self.turns: list[Turn] = []
        self.before = render([])
        #: Place of the first difference, where history was rewritten.
        self.rewritten: int | None = None
        self.at = len(self.before)

    def last(self, n: int) -> list[Turn]:
        return self.turns[max(0, len(self.turns) - n) :]

    def add(self, turn: Turn) -> tuple[str, int, int]:
        """(what the turn adds, start and end of its text in that)."""
        held, n = self.turns, len(self.turns)
        if self.keep is not None:
            held = self.last(self.keep)
            self.before = self.render(held)
        after = self.render([*held, turn])
        same = common(self.before, after)
        if same < len(self.before) and self.rewritten is None:
            self.rewritten = self.at - len(self.before) + same
        added = after[same:]
        if self.keep is not None and n > self.keep:
            for window in {min(n, 2 * self.keep + 2), min(n, max(self.keep, 2 * (n & -n)))}:
                other = self.last(window)
                start = self.render(other)
                if (now := self.render([*other, turn]))[: len(start)] != start or now[len(start) :] != added:
                    raise ValueError("the template looks further back than it declares")
        # two probes that differ in one character show where the text begins, and what follows it
        one, two = self.render([*held, (turn[0], "A")]), self.render([*held, (turn[0], "B")])
        start = common(one, two)
        after_text = len(one) - start - 1
        self.turns.append(turn)
        self.before, self.at = after, self.at + len(added)
        return added, max(0, start - same), max(0, len(added) - after_text)


def formatted(turns: DataFrame, render: Callable[[list[Turn]], str] = template, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end, rewritten) for each row of turns (conv_id, turn, role, text), in order.

    `piece` is what the turn adds to the formatted conversation, the loss span is in characters of the
    piece (null where the turn has no loss), `rewritten` the first place where history changed, or null.
    """
    schema = "conv_id long, turn long, piece string, loss_start int, loss_end int, rewritten long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv = None, object()
        for whole in batches:
            for b in C.slices(whole, "text"):
                out: list[list] = [[], [], [], []]
                for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if state is None or c != conv:
                        state, conv = Render(render), c
                    piece, start, end = state.add((role or "", text or ""))
                    loss = (role or "") == loss_role
                    for x, v in zip(out, (piece, start if loss else None, end if loss else None, state.rewritten), strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], names=["conv_id", "turn", "piece", "loss_start", "loss_end", "rewritten"])

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from formatted()'s rows, which come in its order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        done: list[tuple] = []

        def close():
            if held is not None:
                done.append((conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4], held[5]))

        for b in batches:
            for c, piece, start, end, rewritten in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                if held is None or c != conv:
                    close()
                    conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in parse(piece):
                    held[0] += 1
                    held[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    loss = unescape(piece[start:end])
                    held[2] += len(loss)
                    held[3].update(loss.encode())
                held[4] += len(piece)
                held[5] = held[5] or rewritten is not None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return pieces.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every conversation of `conversations` formatted, and one whose texts hold control strings."""
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    return digest(formatted(turns.unionByName(spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")))).drop("rewrites")


SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
esc AS (
  SELECT *, regexp_replace(text, '(\\\\|</s>|\\[/?INST)', '\\\\\\1', 'g') AS e, replace(regexp_replace(role, '(\\\\|</s>|\\[/?INST)', '\\\\\\1', 'g'), ']', chr(92) || ']') AS r FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(e) + length(r) + 11)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
