"""Entity names in plain text, by shape, and simple statements by their verbs."""

from __future__ import annotations

import re
from typing import NamedTuple

from palimpsest.functions import text as X
from palimpsest.functions.temporal import MONTHS, WEEKDAYS

# Words in capitals that are states, not names; everyday words; words that open sentences.
STATUS = frozenset("PASS FAIL FAILED OK DONE CLOSED OPEN TODO FIXME NOTE WARN WARNING ERROR NEW FULL RED GREEN YES NO CLEAN DIRTY READY WIP NA TBD AND OR NOT THE ALL ANY".split())
ORDINARY = frozenset("replay merged merge full remaining remain starting start unpark reports report lane rule rules suite test tests build builds check checked clean step steps task tasks item items part parts phase phases".split())
OPENERS = frozenset(
    """yesterday today tomorrow also then however note please finally first second third next meanwhile additionally
    furthermore moreover still yet overall generally usually often sometimes always never let use call see check contact
    run try example remember important warning tip ok okay thanks thank hi hello dear sorry i""".split()
)
CALENDAR = frozenset([*WEEKDAYS, *MONTHS])
EXTENSIONS = "rs py js ts tsx jsx md json toml yaml yml txt sh bash zsh c h cc cpp hpp go java rb php sql db sqlite csv tsv html css scss conf cfg ini log lock png jpg jpeg gif svg pdf".split()
#: Hints by rank: of two names that start together the earlier hint comes first.
HINTS = ("url", "quoted", "handle", "hashtag", "path", "identifier", "version", "proper")

_URL = r"(?i:https?://)\S+"
_PATH = r"(?:\.\./|\./|~/|/|[A-Za-z]:[\\/])[\w.~][\w/\\.\-~@+%:]*"
_SPECIAL = re.compile(rf"(?P<url>{_URL})|(?<!\w)(?P<handle>@[A-Za-z0-9_.-]*[A-Za-z0-9_])|(?<!\w)#(?P<hashtag>[A-Za-z0-9][A-Za-z0-9_]*)|(?<!\w)(?P<path>{_PATH})")
_QUOTED = re.compile(r"(?<!\w)([\"'`])([^\n]+?)\1(?!\w)")
_WORD = re.compile(r"&|[^\W_](?:[\w-]|(?<=\w)[.'’](?=\w)|::?(?=\w)|(?<=:):(?=\w))*")
_FILE = re.compile(rf".+\.(?:{'|'.join(EXTENSIONS)})\Z", re.I)
_MIXED = re.compile(r"[a-zß-ÿ][A-ZÀ-Þ]|[^\W\d_]\d[^\W\d_]")


class Found(NamedTuple):
    name: str
    hint: str
    start: int
    end: int


def _excluded(word: str) -> bool:
    w = X.fold_text(word)
    return w in OPENERS or w in X.STOPWORDS or w in CALENDAR


def _opens(text: str, at: int) -> bool:
    """Whether a sentence (or a list item) begins here."""
    before = text[:at].rstrip(" \t")
    return not before or before[-1] in ".!?:;\n\r" or bool(re.search(r"(?:^|[\n\r])[ \t]*[-*+]\Z", before))


def _acronym(word: str) -> bool:
    return bool(re.fullmatch("[A-Z]{2,6}", word)) and word not in STATUS


def _number(word: str) -> bool:
    return bool(re.fullmatch(r"[\d.]*\d[\d.]*", word))


def _path_fits(path: str) -> bool:
    relative = path.startswith(("./", "~/", "../"))
    return relative or path.startswith("/") and "/" in path[1:] or "/" in path and "." in path.rsplit("/", 1)[1]


def _specials(text: str) -> tuple[list[Found], list[tuple[int, int]]]:
    found, taken = [], []
    for m in _SPECIAL.finditer(text):
        kind = m.lastgroup or ""
        name = m[kind].rstrip(".,;:!?)]}'\"`") if kind in ("url", "path") else m[kind]
        if kind == "path" and not _path_fits(name) or kind == "handle" and not re.search("[A-Za-z0-9]", name):
            continue
        found.append(Found(name, kind, m.start(kind), m.start(kind) + len(name)))
        taken.append((m.start(), m.start(kind) + len(name)))
    for m in _QUOTED.finditer(text):
        inner = m[2].strip()
        if 1 <= len(inner.split()) <= 6 and not any(a <= m.start() < b for a, b in taken):
            start = m.start(2) + m[2].index(inner)
            found.append(Found(inner, "quoted", start, start + len(inner)))
    return found, taken


def _shape(word: str) -> str | None:
    if _FILE.match(word):
        return "path"
    if not re.search(r"[^\W\d_]", word):
        return None
    return "identifier" if "_" in word or "::" in word or word.count(".") >= 2 or _MIXED.search(word) else None


def _span(text: str, words: list[re.Match], i: int) -> int:
    """The last word of the name that word i begins."""
    upper = lambda k: k < len(words) and words[k][0][0].isupper()
    joined = lambda k: text[words[k - 1].end() : words[k].start()].isspace()
    last, k = i, i + 1
    while k < len(words) and joined(k) and not (_acronym(words[k - 1][0]) and _acronym(words[k][0])):
        if upper(k):
            last, k = k, k + 1
        elif words[k][0].lower() in ("of", "de", "van", "&") and upper(k + 1) and joined(k + 1):
            k += 1
        else:
            return k if _number(words[k][0]) and not upper(k + 1) else last
    return last


def _names(text: str, taken: list[tuple[int, int]]) -> list[Found]:
    words = [m for m in _WORD.finditer(text) if not any(a <= m.start() < b for a, b in taken)]
    out = [Found(m[0], hint, m.start(), m.end()) for m in words if (hint := _shape(m[0]))]
    i = 0
    while i < len(words):
        w = words[i][0]
        if not w[0].isupper() or _excluded(w) and w not in STATUS:
            i += 1
            continue
        last = _span(text, words, i)
        run = words[i : last + 1]
        i = last + 1
        while run and run[0][0] in STATUS:
            run = run[1:]
        while run and run[-1][0] in STATUS:
            run = run[:-1]
        if all(len(m[0]) <= 1 or _number(m[0]) or m[0] in STATUS for m in run):
            continue
        first, opens = run[0][0], _opens(text, run[0].start())
        if len(run) == 1:
            elsewhere = any(not _opens(text, m.start()) for m in re.finditer(rf"(?<!\w){re.escape(first)}(?!\w)", text))
            if not opens or _acronym(first) or _MIXED.search(first) or elsewhere:
                out.append(Found(first, "proper", run[0].start(), run[0].end()))
            continue
        second = run[1][0]
        plain = len(first) <= 1 or _excluded(first) or first in STATUS or X.fold_text(first) in ORDINARY
        if (re.fullmatch("[A-Z]", second) or _number(second)) and opens and plain or any(X.fold_text(m[0]) in CALENDAR for m in run):
            continue
        a, b = run[0].start(), run[-1].end()
        out.append(Found(text[a:b], "version" if _number(run[-1][0]) else "proper", a, b))
    return out


def heuristic_entities(text: str) -> list[Found]:
    """Names in a text, in order, each normalised name once."""
    specials, taken = _specials(text)
    seen, out = set(), []
    for f in sorted([*specials, *_names(text, taken)], key=lambda f: (f.start, HINTS.index(f.hint))):
        shouted = any(w in STATUS or len(w) >= 5 and w == w.upper() and not re.search(r"\d", w) and w != w.lower() for w in f.name.split())
        norm = X.norm_name(f.name)
        if len(f.name) > 1 and re.search(r"[^\W\d_]", f.name) and not shouted and norm and norm not in seen:
            seen.add(norm)
            out.append(f)
    return out


# Verb phrases and the predicates they state; longer ones first.
STATEMENTS = (
    ("no longer works at", "works at"), ("does not work at", "works at"), ("doesn't work at", "works at"), ("is employed at", "works at"),
    ("works for", "works for"), ("works at", "works at"), ("reports to", "reports to"), ("lives in", "lives in"), ("resides in", "lives in"),
    ("moved to", "lives in"), ("joined", "joined"), ("manages", "manages"), ("prefers", "prefers"), ("likes", "likes"), ("uses", "uses"), ("owns", "owns"),
)
_VERBS = re.compile(r"(?<!\w)(" + "|".join(re.escape(p) for p, _ in STATEMENTS) + r")(?!\w)", re.I)
_DENIES = ("no longer", "does not", "doesn't")


def statements(text: str) -> list[tuple[str, str, str, bool]]:
    """(source, predicate, target, negated) of statements whose verb stands between two names."""
    names, out = heuristic_entities(text), []
    for m in _VERBS.finditer(text):
        before = [f for f in names if f.end <= m.start() and not re.search(r"[.;!?\n]", text[f.end : m.start()])]
        after = [f for f in names if f.start >= m.end() and not re.search(r"[.;!?\n]", text[m.end() : f.start])]
        if before and after:
            verb = m[1].lower()
            out.append((before[-1].name, dict(STATEMENTS)[verb], after[0].name, verb.startswith(_DENIES)))
    return sorted(set(out))
