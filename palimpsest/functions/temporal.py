"""Dates in text: phrases to half-open windows of unix seconds, by a table of patterns."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

DAY = 86_400
#: Ends of open windows: half of the largest 64-bit integer, so that differences stay in range.
FAR = (2**63 - 1) // 2
NEAR = -FAR


@dataclass(frozen=True)
class Clock:
    """Now in unix seconds, and the local offset in seconds."""

    now: int
    offset: int = 0

    def today(self) -> date:
        return datetime.fromtimestamp(self.now + self.offset, UTC).date()

    def at(self, day: date) -> int:
        """Local midnight."""
        return (day - date(1970, 1, 1)).days * DAY - self.offset


@dataclass(frozen=True)
class Window:
    start: int
    end: int
    matched: str


# Month, weekday, unit and number words.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBERS = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1}
HISTORY_CUES = ("used to", "in the past", "at first", "no longer", "previously", "formerly", "originally", "before", "earlier", "history", "changed", "change", "old", "anymore")
BEFORE_A_YEAR = frozenset("in on during since before after of until between from to and".split())

_MONTH = {m: k for k, m in enumerate(MONTHS, 1)} | {m[:3]: k for k, m in enumerate(MONTHS, 1)} | {"sept": 9}
_M = "(" + "|".join(sorted(_MONTH, key=len, reverse=True)) + ")"
_W = "(" + "|".join(WEEKDAYS) + ")"
_N = r"(\d+|" + "|".join(NUMBERS) + ")"
_D = r"(\d{1,2})(?:st|nd|rd|th)?"
_ISO = r"(\d{4})-(\d{2})-(\d{2})"

Span = tuple[int, int]


def _month_add(y: int, m: int, n: int) -> tuple[int, int]:
    k = y * 12 + m - 1 + n
    return k // 12, k % 12 + 1


def _days(clock: Clock, first: date, last: date) -> Span:
    return clock.at(first), clock.at(last)


def _day(clock: Clock, day: date) -> Span:
    return _days(clock, day, day + timedelta(1))


def _week(clock: Clock, day: date) -> Span:
    monday = day - timedelta(day.weekday())
    return _days(clock, monday, monday + timedelta(7))


def _months(clock: Clock, y: int, m: int, n: int = 1) -> Span:
    return _days(clock, date(y, m, 1), date(*_month_add(y, m, n), 1))


def _number(word: str) -> int:
    return int(word) if word.isdigit() else NUMBERS[word]


def _exact(y: int, m: int, d: int) -> date | None:
    return date(y, m, d) if 1 <= y <= 9998 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1] else None


def _period(clock: Clock, which: str, unit: str) -> Span:
    """this, last or next week, month or year."""
    step, today = {"this": 0, "last": -1, "next": 1}[which], clock.today()
    if unit == "week":
        return _week(clock, today + timedelta(7 * step))
    if unit == "month":
        return _months(clock, *_month_add(today.year, today.month, step))
    return _months(clock, today.year + step, 1, 12)


def _ago(clock: Clock, n: str, unit: str) -> Span:
    k, today = _number(n), clock.today()
    if unit == "day":
        return _day(clock, today - timedelta(k))
    if unit == "week":
        return _week(clock, today - timedelta(7 * k))
    if unit == "month":
        return _months(clock, *_month_add(today.year, today.month, -k))
    return _months(clock, today.year - k, 1, 12)


def _back(clock: Clock, months: int) -> int:
    """The same local time so many months before now, in the last day of a shorter month."""
    today = clock.today()
    y, m = _month_add(today.year, today.month, -months)
    day = date(y, m, min(today.day, calendar.monthrange(y, m)[1]))
    return clock.at(day) + (clock.now - clock.at(today))


def _past(clock: Clock, n: str, unit: str) -> Span:
    k = _number(n)
    if unit in ("day", "week"):
        return clock.now - k * DAY * (7 if unit == "week" else 1), clock.now
    return _back(clock, k * (12 if unit == "year" else 1)), clock.now


def _weekday(clock: Clock, which: str | None, name: str) -> Span:
    today, target = clock.today(), WEEKDAYS.index(name)
    if which == "next":
        return _day(clock, today + timedelta((target - today.weekday() - 1) % 7 + 1))
    back = (today.weekday() - target) % 7
    return _day(clock, today - timedelta(back or (7 if which == "last" else 0)))


def _bare_month(clock: Clock, name: str) -> Span:
    today, m = clock.today(), _MONTH[name]
    return _months(clock, today.year - (m > today.month), m)


def _month_day(clock: Clock, name: str, d: str, y: str | None = None) -> Span | None:
    m, today = _MONTH[name], clock.today()
    if y:
        return _day(clock, x) if (x := _exact(int(y), m, int(d))) else None
    this = _exact(today.year, m, int(d))
    found = this if this and this <= today else _exact(today.year - 1, m, int(d))
    return _day(clock, found) if found else None


def _numeric(clock: Clock, y: str, m: str, d: str) -> Span | None:
    return _day(clock, x) if (x := _exact(int(y), int(m), int(d))) else None


def _instant(clock: Clock, y, m, d, hh, mm, ss, zone) -> Span | None:
    day = _exact(int(y), int(m), int(d))
    if day is None or int(hh) > 23 or int(mm) > 59 or int(ss or 0) > 59:
        return None
    offset = clock.offset
    if zone:
        sign, digits = (-1 if zone[0] == "-" else 1), re.sub(r"\D", "", zone)
        offset = 0 if zone == "z" else sign * (int(digits[:2]) * 3600 + int(digits[2:] or 0) * 60)
    t = (day - date(1970, 1, 1)).days * DAY + int(hh) * 3600 + int(mm) * 60 + int(ss or 0) - offset
    return t, t + 1


def _year(clock: Clock, y: str) -> Span | None:
    return _months(clock, int(y), 1, 12) if 1900 <= int(y) <= 2100 else None


#: Whole phrases and what they mean; the first pattern that fits a phrase decides.
PATTERNS: list[tuple[re.Pattern, Callable[..., Span | None]]] = [
    (re.compile(p + r"\Z"), f)
    for p, f in (
        (r"(?:earlier )?today|this morning|tonight", lambda c: _day(c, c.today())),
        (r"yesterday|last night", lambda c: _day(c, c.today() - timedelta(1))),
        (r"tomorrow", lambda c: _day(c, c.today() + timedelta(1))),
        (r"(this|last|next) (week|month|year)", _period),
        (r"past week", lambda c: (c.now - 7 * DAY, c.now)),
        (r"recently|lately", lambda c: (c.now - 14 * DAY, c.now)),
        (_ISO, _numeric),
        (_ISO + r"[t ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?: ?(z|[+-]\d{2}:?\d{2}))?", _instant),
        (r"(\d{4})-(\d{2})", lambda c, y, m: _months(c, int(y), int(m)) if 1 <= int(m) <= 12 else None),
        (r"(\d{4})", _year),
        (_M, _bare_month),
        (_W, lambda c, w: _weekday(c, None, w)),
        (r"last " + _M, _bare_month),
        (r"(\w+) " + _W, _weekday),
        (r"q([1-4]) (\d{4})", lambda c, q, y: _months(c, int(y), int(q) * 3 - 2, 3)),
        (_M + r" (\d{4})", lambda c, m, y: _months(c, int(y), _MONTH[m]) if _year(c, y) else None),
        (_M + " " + _D, _month_day),
        (_D + " " + _M, lambda c, d, m: _month_day(c, m, d)),
        (_M + " " + _D + r" (\d{4})", _month_day),
        (_D + " " + _M + r" (\d{4})", lambda c, d, m, y: _month_day(c, m, d, y)),
        (_N + r" (day|week|month|year)s? ago", _ago),
        (r"(?:past|last) " + _N + r" (day|week|month|year)s?", _past),
    )
]


def _plain(text: str) -> str:
    return " ".join(text.replace(",", " ").lower().split()).rstrip("?.!;: ")


def _resolve(phrase: str, clock: Clock) -> Span | None:
    for pattern, f in PATTERNS:
        if m := pattern.match(phrase):
            return f(clock, *m.groups())
    return None


def _range(phrase: str, clock: Clock) -> Span | None:
    phrase = re.sub(r"^(?:in|on|during) ", "", phrase)
    word, _, rest = phrase.partition(" ")
    if word in ("since", "after", "before", "until") and rest:
        span = _resolve(rest, clock)
        return span and {"since": (span[0], FAR), "after": (span[1], FAR)}.get(word, (NEAR, span[0]))
    for first, joint in (("between", " and "), ("from", " to ")):
        if word == first:
            a, found, b = rest.partition(joint)
            x, y = (_resolve(a.strip(), clock), _resolve(b.strip(), clock)) if found else (None, None)
            return (x[0], y[1]) if x and y else None
    return _resolve(phrase, clock)


def parse_window(text: str, clock: Clock) -> Window | None:
    """A whole phrase as a window."""
    span = _range(_plain(text), clock) if text.strip() else None
    return Window(*span, text.strip()) if span else None


def parse_instant(text: str, clock: Clock) -> int | None:
    """A whole phrase as one instant: unix seconds, a date or time, an exact day so long ago, or the start of a window."""
    phrase = _plain(text)
    digits = phrase.isascii() and phrase.isdigit()
    if digits and len(phrase) != 4:
        return int(phrase)
    if m := re.fullmatch(_N + r" (week|month)s? ago", phrase):
        k, today = _number(m[1]), clock.today()
        if m[2] == "week":
            return clock.at(today - timedelta(7 * k))
        y, mo = _month_add(today.year, today.month, -k)
        return clock.at(date(y, mo, min(today.day, calendar.monthrange(y, mo)[1])))
    if window := parse_window(text, clock):
        return window.start
    return int(phrase) if digits else None


def find_window(text: str, clock: Clock) -> Window | None:
    """The first phrase in a text that is a window, the longest from there, of twelve words at most.

    A year alone and "may" count only after a preposition.
    """
    words = list(re.finditer(r"[^\W_]+", text))
    for i, first in enumerate(words):
        before = words[i - 1][0].lower() if i else ""
        for last in reversed(words[i : i + 12]):
            phrase = text[first.start() : last.end()]
            found = parse_window(phrase, clock)
            alone = _plain(phrase)
            if found and (before in BEFORE_A_YEAR or not (alone == "may" or re.fullmatch(r"\d{4}", alone))):
                return found
    return None


def text_date(text: str, clock: Clock) -> Window | None:
    """The only date in a text, if it is an explicit one."""
    first = find_window(text, clock)
    if not first:
        return None
    phrase = _plain(first.matched)
    ranged = re.match(r"(?:since|before|after|until|between|from) ", phrase) or " to " in phrase or " and " in phrase
    explicit = phrase == "yesterday" or phrase.endswith(" days ago") or re.search(r"(?<!\d)\d{4}(?!\d)", phrase) and not ranged
    return first if explicit and not find_window(text.replace(first.matched, " ", 1), clock) else None


def history_intent(text: str) -> bool:
    """Whether a query asks how things were."""
    lower = text.lower()
    if any(re.search(rf"(?<![^\W_]){re.escape(cue)}(?![^\W_])", lower) for cue in HISTORY_CUES):
        return True
    words = re.findall(r"[^\W_]+", lower)
    return any(w == "did" and {"use", "used"} & set(words[k + 1 : k + 6]) for k, w in enumerate(words))
