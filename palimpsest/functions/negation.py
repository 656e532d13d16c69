"""Whether a text denies a relation that it names."""

from __future__ import annotations

import re

# Words that may stand between a cue and its verb.
FILLERS = frozenset("does do did is was were has have had really even ever actually longer more anymore be been being will would could should can may might".split())
# Cues of several words, then of one.
CUES = tuple(tuple(c.split()) for c in ("no longer", "no more", "does not", "did not", "do not", "is not", "was not", "were not", "has not", "have not", "had not", "will not", "would not", "could not", "should not", "can not", "ya no"))
CUE_WORDS = frozenset("not never stopped ceased doesn't didn't don't isn't wasn't weren't won't nor cannot can't quit left divorced sold".split())
# Phrases that take a relation back, with the predicate group they take back ("" for any).
RETRACTIONS = (
    ("resigned from", "work at"), ("quit", "work at"), ("left the job at", "work at"), ("left", "work at"), ("moved out of", "live in"),
    ("broke up with", "married to"), ("divorced", "married to"), ("sold", "own"), ("stopped using", "use"), ("gave up", "use"),
    ("is no longer", ""), ("was no longer", ""), ("no longer", ""), ("ya no", ""),
)
# Words after which a retraction is about something else.
BREAKS = frozenset("and but because while although though who which that".split())
REACH = 3


def _words(text: str) -> list[str]:
    stripped = (re.sub(r"^[^\w']+|[^\w']+$", "", w.replace("_", " ")).lower() for w in text.split())
    return [w for w in stripped if w]


def _find(words: list[str], run: list[str]) -> int:
    return next((k for k in range(len(words) - len(run) + 1) if words[k : k + len(run)] == run), -1)


def _cue_end(words: list[str]) -> int | None:
    """Where the last cue of words ends; a doubly negated stop is no cue."""
    for k in reversed(range(len(words))):
        for cue in CUES:
            if tuple(words[k : k + len(cue)]) == cue:
                return k + len(cue)
        double = words[k] in ("stopped", "ceased") and k and words[k - 1] in ("never", "not")
        if words[k] in CUE_WORDS and not double:
            return k + 1
    return None


def denied(text: str, predicate: str, group: str, target: str) -> bool:
    """A cue before the predicate's verb, which names the target within REACH words, or a retraction of this group right before the target."""
    goal = _words(target)
    if not goal:
        return False
    clauses = [w for c in re.split(r"[.;!?\n]", text) if _find(w := _words(c), goal) >= 0]
    words = clauses[0] if clauses else _words(text)
    at = _find(words, goal)
    if at < 0:
        return False
    stem = (predicate.split() or [""])[0].rstrip("e")
    verb = next((k for k in reversed(range(at)) if stem and words[k].startswith(stem)), None)
    if verb is not None and at - verb - 1 <= REACH:
        cue = _cue_end(words[:verb])
        if cue is not None and all(w in FILLERS for w in words[cue:verb]):
            return True
    found = []
    for phrase, of in RETRACTIONS:
        run = phrase.split()
        start = next((k for k in reversed(range(at - len(run) + 1)) if words[k : k + len(run)] == run), None)
        if start is not None:
            gap = words[start + len(run) : at]
            if len(gap) <= REACH and BREAKS.isdisjoint(gap):
                found.append((start + len(run), of))
    if not found:
        return False
    # the phrase that ends last decides; of several, the first listed
    last = max(end for end, _ in found)
    of = next(of for end, of in found if end == last)
    return of in ("", group)
