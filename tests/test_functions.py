import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import temporal as T
from palimpsest.functions import text as X
from palimpsest.functions.embed import HashEmbedder
from palimpsest.functions.entities import heuristic_entities, statements
from palimpsest.functions.negation import denied

FOLDED = {
    "Café ÜBER Niño": "cafe uber nino", "Straße": "strasse", "naïve façade": "naive facade", "O'Brien": "obrien", "User’s": "users",
    "  Hello,   WORLD!! ": "hello world", "東京 Rust 2026": "東京 rust 2026", "a—b/c": "a b c", "": "", "snake_case": "snake case",
}
NAMES = {
    "The Houses": "house", "my bros": "bro", "Mom's": "mom", "Mom’s": "mom", "PostgreSQL 16": "postgresql 16", "New York City": "new york city", "the user": "user", "Analysis": "analysis",
    "Series": "series", "children": "child", "people": "person", "mice": "mouse", "boxes": "box", "cities": "city", "knives": "knife", "class": "class", "glasses": "glass", "the": "the",
}
SINGULARS = {"buses": "bus", "viruses": "virus", "houses": "house", "causes": "cause", "heroes": "hero", "shoes": "shoe", "geese": "goose", "physics": "physics", "kubernetes": "kubernetes", "css": "css"}
PREDICATES = {
    "Lives_In": "live in", "lived in": "live in", "is working at": "work at", "worked at": "work at", "has been using": "use", "prefers": "prefer", "is married to": "married to",
    "studied": "study", "has a": "have", "is the manager of": "manager of", "is": "be", "met": "meet",
}


@pytest.mark.parametrize("text, want", FOLDED.items())
def test_fold(text, want):
    assert X.fold_text(text) == want


def test_fold_column_is_fold_text(spark):
    rows = [(t,) for t in [*FOLDED, None]]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.fold(F.col("t"))).collect()]
    assert got == [*FOLDED.values(), None]


def test_names_and_predicates():
    assert {k: X.norm_name(k) for k in NAMES} == NAMES
    assert {k: X.singularize(k) for k in SINGULARS} == SINGULARS
    assert {k: X.norm_predicate(k) for k in PREDICATES} == PREDICATES


def test_similarities():
    assert X.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert X.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert (X.jaro_winkler("", ""), X.jaro_winkler("abc", ""), X.jaro_winkler("abc", "xyz")) == (1.0, 0.0, 0.0)
    assert X.trigram_jaccard("hello", "hello") == 1.0 and 0 < X.trigram_jaccard("night", "nacht") < 1
    assert X.lexical_match("postgresql", "postgressql") and not X.lexical_match("customer 1", "customer 2")


def test_acronym_and_terms(spark):
    names = ["New York City", "United States of America", "Google", "the", None, ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.acronym(F.col("n"))).collect()]
    assert got == ["NYC", "USA", None, None, None, None]
    df = spark.createDataFrame([("what is the production database?",), ("x y a",), (None,)], "q string")
    assert [r[0] for r in df.select(X.search_terms(F.col("q"))).collect()] == [["production", "database"], [], []]


def test_content_hash():
    assert X.content_hash("fact", "Hello  WORLD!") == X.content_hash("fact", "hello world") != X.content_hash("event", "hello world")
    assert len(X.content_hash("fact", "x")) == 16


def test_porter():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "generalizations": "gener", "auditors": "auditor", "running": "run"}
    assert {w: X.porter(w) for w in want} == want


CLOCK = T.Clock(1_792_594_800)  # 2026-10-21T15:00:00Z, a Wednesday
DAY = 86_400


def day(text):
    from datetime import date

    return (date.fromisoformat(text) - date(1970, 1, 1)).days * DAY


@pytest.mark.parametrize(
    "phrase, start, end",
    [
        ("today", "2026-10-21", "2026-10-22"), ("yesterday", "2026-10-20", "2026-10-21"), ("tomorrow", "2026-10-22", "2026-10-23"), ("this week", "2026-10-19", "2026-10-26"), ("last week", "2026-10-12", "2026-10-19"),
        ("next month", "2026-11-01", "2026-12-01"), ("last year", "2025-01-01", "2026-01-01"), ("March 2025", "2025-03-01", "2025-04-01"), ("in March", "2026-03-01", "2026-04-01"), ("December", "2025-12-01", "2026-01-01"),
        ("2026-03", "2026-03-01", "2026-04-01"), ("2024", "2024-01-01", "2025-01-01"), ("Q2 2026", "2026-04-01", "2026-07-01"), ("March 5, 2025", "2025-03-05", "2025-03-06"), ("5 March 2025", "2025-03-05", "2025-03-06"),
        ("3 days ago", "2026-10-18", "2026-10-19"), ("two weeks ago", "2026-10-05", "2026-10-12"), ("last Monday", "2026-10-19", "2026-10-20"), ("last Wednesday", "2026-10-14", "2026-10-15"), ("next Friday", "2026-10-23", "2026-10-24"),
        ("between March 2025 and May 2025", "2025-03-01", "2025-06-01"), ("from 2025-01-01 to 2025-01-03", "2025-01-01", "2025-01-04"), ("November 5", "2025-11-05", "2025-11-06"),
    ],
)
def test_windows(phrase, start, end):
    w = T.parse_window(phrase, CLOCK)
    assert (w.start, w.end) == (day(start), day(end))


def test_open_windows_and_nonsense():
    assert (T.parse_window("since 2026-01-01", CLOCK).start, T.parse_window("since 2026-01-01", CLOCK).end) == (day("2026-01-01"), T.FAR)
    assert T.parse_window("before 2026", CLOCK).end == day("2026-01-01")
    for text in ("", "hello", "February 30, 2025", "2025-13-01", "between May"):
        assert T.parse_window(text, CLOCK) is None


def test_instants():
    assert T.parse_instant("1700000000", CLOCK) == 1_700_000_000
    assert T.parse_instant("2026-10-21T15:00:00Z", CLOCK) == CLOCK.now
    assert T.parse_instant("2026-10-21T20:00:00+05:00", CLOCK) == CLOCK.now
    assert T.parse_instant("one month ago", CLOCK) == day("2026-09-21")
    assert T.parse_window("today", T.Clock(1_792_620_000, 5 * 3600 + 1800)).start == day("2026-10-22") - 19_800


def test_found_in_text():
    assert T.find_window("what did we ship in March 2025?", CLOCK).matched == "in March 2025"
    assert T.find_window("port 2024 is open", CLOCK) is None and T.find_window("you may want it", CLOCK) is None
    assert T.text_date("We met on March 5, 2025 at noon", CLOCK).start == day("2025-03-05")
    assert T.text_date("From March 2025 to May 2025 we met", CLOCK) is None
    assert T.history_intent("what did I use before") and T.history_intent("which editor did we use") and not T.history_intent("what do we use")


@pytest.mark.parametrize(
    "text, predicate, group, target, want",
    [
        ("Alice no longer works at Acme", "work at", "work at", "Acme", True), ("Alice works at Acme", "work at", "work at", "Acme", False), ("Bob quit Acme", "work at", "work at", "Acme", True), ("Bob quit Acme", "live in", "live in", "Acme", False),
        ("Alice does not like tea", "like", "like", "tea", True), ("Bob never stopped liking tea", "like", "like", "tea", False), ("She moved out of Paris", "live in", "live in", "Paris", True), ("Not a day passes. Alice works at Acme", "work at", "work at", "Acme", False),
        ("", "like", "like", "tea", False), ("x", "like", "like", "", False),
    ],
)
def test_denied(text, predicate, group, target, want):
    assert denied(text, predicate, group, target) is want


def test_entities():
    text = 'Alice Smith uses PostgreSQL 16 at https://example.org/a. See ./run.sh, @bob said "New York City" #rust snake_case.'
    got = {(f.name, f.hint) for f in heuristic_entities(text)}
    assert {("Alice Smith", "proper"), ("PostgreSQL 16", "version"), ("https://example.org/a", "url"), ("./run.sh", "path"), ("@bob", "handle"), ("New York City", "quoted"), ("rust", "hashtag"), ("snake_case", "identifier")} <= got
    assert heuristic_entities("") == [] and heuristic_entities("the build is DONE today") == []
    assert statements("Alice Smith works at Acme Corp. We heard Bob Ray no longer works at Initech Ltd.") == [("Alice Smith", "works at", "Acme Corp", False), ("Bob Ray", "works at", "Initech Ltd", True)]


def test_embedder():
    v = HashEmbedder().embed(["hello world", "hello world", "", "other"])
    assert np.allclose(np.linalg.norm(v[:2], axis=1), 1) and (v[0] == v[1]).all() and not v[2].any() and v[0] @ v[3] < 0.9


def test_random_texts_do_not_fail():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("aB1 .'-_:/@#\"`’éß\n🙂") for _ in range(rng.randint(0, 40)))
        heuristic_entities(t), T.find_window(t, CLOCK), X.norm_name(t), X.norm_predicate(t), denied(t, "like", "like", "a")
