"""Columns that say when a row holds, in world time (valid_from, valid_to) and system time (expired_at)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def valid_at(t: Column | int) -> Column:
    t = t if isinstance(t, Column) else F.lit(t)
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def live() -> Column:
    return F.col("expired_at").isNull()


def forgotten() -> Column:
    """Expired and not replaced: never returned."""
    return F.col("expired_at").isNotNull() & F.col("superseded_by").isNull()


def ended(cutoff: Column | int) -> Column:
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return F.coalesce(F.col("valid_to") <= cutoff, F.lit(False)) | F.col("expired_at").isNotNull()


def retracted() -> Column:
    return F.col("expired_at").isNotNull() & F.col("valid_to").isNull()


def overlaps(since: int | None, until: int | None) -> Column:
    """[valid_from, valid_to) meets [since, until); an open end is None."""
    out = F.lit(True)
    if until is not None:
        out = out & (F.col("valid_from") < until)
    if since is not None:
        out = out & (F.col("valid_to").isNull() | (F.col("valid_to") > since))
    return out


def visible(now: int, as_of: int | None = None, history: bool = False) -> Column:
    """Whether a relation shows: at as_of if given, ever so far with history, else now and live."""
    if as_of is not None:
        return valid_at(as_of)
    return F.col("valid_from") <= now if history else valid_at(now) & live()


def eligible(as_of: int | None = None, history: bool = False, kinds: Sequence[str] = (), tags: Sequence[str] = (), scope: str | None = None, source: str | None = None, session: str | None = None, since: int | None = None, until: int | None = None) -> Column:
    """Whether a memory may be returned: forgotten ones never, replaced ones with history only, ended ones too (they rank lower), at as_of those that held then.

    tags: any of them (folded); the other filters: all of them.
    """
    out = ~forgotten() & overlaps(since, until)
    if not history:
        out = out & live()
    if as_of is not None:
        out = out & valid_at(as_of)
    if kinds:
        out = out & F.col("kind").isin(*kinds)
    if tags:
        out = out & F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, map(X.fold_text, tags)))), F.lit(False))
    for name, value in (("scope", scope), ("source", source), ("session", session)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out
