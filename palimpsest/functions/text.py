"""Text functions: Column builders where Spark's functions say it, plain Python (and vectorised UDFs over it) elsewhere."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accents that fold to one letter, and letters that fold to two.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįłĺľñńňòóôõöøōőŕřśšşťţùúûüūůűýÿźżžð"
PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiilllnnnoooooooorrsssttuuuuuuuyyzzzd"
DIGRAPHS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}

# English stop words.
STOPWORDS = tuple(
    """a about above across actually after again against all almost also although always am among an and another any
    anyone anything are around as at be became because become been before being below between both but by can cannot
    could did do does doing done down during each either else even ever every few for from further get gets getting got
    had has have having he her here hers herself him himself his how however i if in into is it its itself just let like
    make many may me might more most much must my myself never no nor not now of off on once only or other others our
    ours ourselves out over own per please quite rather really same she should since so some someone something still
    such than that the their theirs them themselves then there these they this those though through thus to today
    together tomorrow too under until up upon us very via was we were what when where whether which while who whom why
    will with would yet yesterday you your yours yourself yourselves""".split()
)

# Words that a name drops in front, and that an acronym skips.
DETERMINERS = ("the", "a", "an", "my", "our", "your", "his", "her", "their")
CONNECTORS = ("of", "and", "the")

# Singulars that no rule gives, and words that only look plural.
IRREGULAR_SINGULARS = {
    "children": "child", "people": "person", "men": "man", "women": "woman",
    "mice": "mouse", "geese": "goose", "teeth": "tooth", "feet": "foot",
}
INVARIANT = frozenset(
    """analysis basis crisis status bus gas lens news series species physics mathematics chaos this is was has its us yes
    plus kubernetes redis postgres windows macos ios aws js css""".split()
)
KEEP_E = ("sho", "to", "cano", "obo", "do", "go", "flo")

# Auxiliaries that a predicate drops, and verb forms that no rule gives.
AUXILIARIES = frozenset("is are was were be been being has have had currently now".split())
VERB_FORMS = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "has": "have", "had": "have",
    "does": "do", "did": "do", "done": "do", "went": "go", "gone": "go", "made": "make", "got": "get", "took": "take",
    "knew": "know", "met": "meet", "bought": "buy", "left": "leave", "built": "build", "ran": "run", "wrote": "write",
    "taught": "teach", "married": "married",
}


def fold(text: Column) -> Column:
    """Lower case without accents; apostrophes inside words vanish, other punctuation becomes one space."""
    out = F.regexp_replace(F.lower(text), r"(?<=[\p{L}\p{N}])['’ʼ](?=[\p{L}\p{N}])", "")
    out = F.translate(out, ACCENTED, PLAIN)
    for letter, pair in DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Words of the folded text; none for null or empty texts."""
    return F.filter(F.split(F.coalesce(fold(text), F.lit("")), " "), lambda w: w != "")


def stopwords() -> Column:
    return F.array(*map(F.lit, STOPWORDS))


def search_terms(text: Column) -> Column:
    """Distinct words of two letters or more that are no stop words."""
    return F.array_distinct(F.array_except(F.filter(tokens(text), lambda w: F.length(w) >= 2), stopwords()))


def acronym(name: Column) -> Column:
    """Upper-case initials of a name of several words, without connecting words; null for one word."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*CONNECTORS))
    letters = F.array_join(F.transform(kept, lambda w: F.upper(F.regexp_extract(w, r"[\p{L}\p{N}]", 0))), "")
    return F.when(F.size(words) >= 2, F.nullif(letters, F.lit("")))


def cost(text: Column) -> Column:
    """Estimated tokens: bytes and a line's overhead, in fours."""
    return F.ceil((F.octet_length(F.coalesce(text, F.lit(""))) + 12) / F.lit(4)).cast("long")


_INNER = re.compile(r"(?<=[^\W_])['’ʼ](?=[^\W_])")
_TABLE = str.maketrans(ACCENTED, PLAIN) | {ord(k): v for k, v in DIGRAPHS.items()}


def fold_text(text: str) -> str:
    """fold() of one string."""
    return " ".join(re.findall(r"[^\W_]+", _INNER.sub("", text.lower()).translate(_TABLE)))


def _stem_es(stem: str) -> str | None:
    """What stands before "es" is the singular, if it is."""
    if stem.endswith("us") and len(stem) > 2 and stem[-3] not in "aeiou":
        return stem
    if stem.endswith("o") and stem not in KEEP_E:
        return stem
    return stem if stem.endswith(("ss", "sh", "ch", "x", "z")) else None


#: Endings in the order they are tried: what to do with the rest of the word, or None to go on.
SINGULAR_RULES = (
    ("ies", lambda stem: stem + "y" if len(stem) >= 2 else None),
    ("ives", lambda stem: stem + "ife"),
    ("lves", lambda stem: stem + "lf"),
    ("es", _stem_es),
    ("s", lambda stem: stem),
)


@lru_cache(100_000)
def singularize(word: str) -> str:
    """English singular of a folded word."""
    if word in IRREGULAR_SINGULARS:
        return IRREGULAR_SINGULARS[word]
    if word in INVARIANT or len(word) <= 3 or word.endswith(("ss", "us", "is")):
        return word
    for ending, rule in SINGULAR_RULES:
        if word.endswith(ending) and (found := rule(word.removesuffix(ending))) is not None:
            return found
    return word


def norm_name(name: str) -> str:
    """Key of an entity name: no possessive, no determiners, the last word in the singular."""
    folded = fold_text(re.sub(r"['’][sS]\s*$", "", name))
    words = folded.split()
    while words and words[0] in DETERMINERS:
        words = words[1:]
    return " ".join([*words[:-1], singularize(words[-1])]) if words else folded


def _bare(stem: str) -> str:
    """A verb's stem after -ing or -ed: one of doubled letters goes, a dropped e comes back."""
    vowel = lambda c: c in "aeiou"
    if len(stem) == 2:
        return stem + "e"
    if len(stem) < 3:
        return stem
    if stem[-1] == stem[-2] and stem[-1] not in "lsz":
        return stem[:-1]
    a, b, c = stem[-3:]
    return stem + "e" if not vowel(a) and vowel(b) and not vowel(c) and c not in "wxy" else stem


VERB_RULES = (
    ("ied", lambda stem: stem + "y"),
    ("ing", _bare),
    ("ed", _bare),
    ("ies", lambda stem: stem + "y" if len(stem) >= 2 else None),
    ("es", lambda stem: stem if stem.endswith(("ss", "sh", "ch", "x", "z")) else None),
    ("s", lambda stem: stem),
)


@lru_cache(100_000)
def lemma(word: str) -> str:
    """Base form of a verb."""
    if word in VERB_FORMS or len(word) <= 3:
        return VERB_FORMS.get(word, word)
    for ending, rule in VERB_RULES:
        if word.endswith(ending) and (found := rule(word.removesuffix(ending))) is not None:
            return found
    return word


def norm_predicate(predicate: str) -> str:
    """Key of a predicate: no articles, no auxiliaries unless there is nothing else, base forms."""
    words = [w for w in fold_text(predicate.replace("_", " ")).split() if w not in ("a", "an", "the")]
    return " ".join(map(lemma, [w for w in words if w not in AUXILIARIES] or words))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity with a scale of 0.1 for up to four common first letters."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free: list[str | None] = list(b)
    ours, at = [], []
    for i, c in enumerate(a):
        near = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] == c), None)
        if near is not None:
            free[near] = None
            ours.append(c)
            at.append(near)
    if not ours:
        return 0.0
    m = len(ours)
    swapped = sum(c != b[j] for c, j in zip(ours, sorted(at), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    start = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return min(1.0, jaro + 0.1 * start * (1 - jaro))


def trigram_jaccard(a: str, b: str) -> float:
    x, y = ({f"  {s}  "[k : k + 3] for k in range(len(s) + 2)} for s in (a, b))
    return len(x & y) / len(x | y)


def content_hash(kind: str, content: str) -> str:
    """FNV-1a (64 bits, hex) of kind, a zero byte and the folded content."""
    h = 0xCBF29CE484222325
    for byte in kind.encode() + b"\0" + fold_text(content).encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def lexical_match(a: str, b: str) -> bool:
    """Two normalised names that spell the same thing: near by Jaro-Winkler, of the same digits, no word replaced by another word."""
    if min(len(a), len(b)) < 5 or re.findall(r"\d", a) != re.findall(r"\d", b) or jaro_winkler(a, b) < 0.93:
        return False
    x, y = a.split(), b.split()
    return len(x) != len(y) or all(jaro_winkler(p, q) >= 0.85 for p, q in zip(x, y, strict=True))


_STEPS = (
    (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")),
    (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")),
)
_LAST = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """v and c for vowels and consonants, runs collapsed."""
    kinds = ""
    for k, c in enumerate(stem):
        kind = "v" if c in "aeiou" or c == "y" and k and kinds[-1] == "c" else "c"
        kinds += kind
    return kinds


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


@lru_cache(100_000)
def porter(word: str) -> str:
    """Porter's stemmer (1980)."""
    w = word
    if len(w) <= 2:
        return w
    for ending, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(ending):
            w = w[: len(w) - len(ending)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for ending in ("ed", "ing"):
            if w.endswith(ending) and "v" in _shape(w[: -len(ending)]):
                w = w[: -len(ending)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-1:] == w[-2:-1] and _shape(w)[-1:] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for step in _STEPS:
        for ending, to in sorted(step, key=lambda x: -len(x[0])):
            if w.endswith(ending):
                w = w[: len(w) - len(ending)] + to if _measure(w[: len(w) - len(ending)]) else w
                break
    for ending in sorted([*_LAST, "ion"], key=len, reverse=True):
        if w.endswith(ending):
            stem = w[: -len(ending)]
            if _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def vectorised(f, kind: T.DataType | str = "string"):
    """An Arrow-batched UDF over a function of strings; null where an argument is null."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)])

    return run
