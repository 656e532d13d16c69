import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import graph, maintenance, paths, ranking, retrieval, timeline, validity


def test_mmr():
    assert ranking.mmr([], [], 0.9, 3) == [] and ranking.mmr([1.0], [None], 0.9, 3) == [0]
    v = [[1, 0], [1, 0], [0, 1]]
    assert ranking.mmr([1.0, 0.9, 0.8], v, 0.5, 3) == [0, 2, 1]
    assert ranking.mmr([1.0, 0.9, 0.0], v, 1.0, 3) == [0, 1, 2]


def test_pack(spark):
    rows = [(1, 1, 10, 500), (1, 2, 11, 600), (1, 3, 12, 200), (1, 4, 13, 100), (2, 1, 20, 9999), (2, 2, 21, 1)]
    got = ranking.packed(spark.createDataFrame(rows, "query_id long, rank int, id long, cost long"), 1000)
    assert {(r.query_id, r.id) for r in got.collect()} == {(1, 10), (1, 12), (1, 13), (2, 20)}


def test_rrf_counts_agreement_at_weight_zero(spark):
    rows = [(1, "a", 7, 1), (1, "a", 7, 4), (1, "b", 7, 2), (1, "b", 8, 1)]
    got = {r.id: (r.score, r.best_rank, r.channels) for r in ranking.rrf(spark.createDataFrame(rows, "query_id int, channel string, id int, rank int"), {"a": 1.0, "b": 0.0}).collect()}
    assert got[7] == (pytest.approx(1 / 6 * 1.05), 1, 2) and got[8] == (0.0, 1, 1)


def test_push_is_power():
    rng = random.Random(3)
    for _ in range(10):
        n = rng.randint(20, 120)
        edges = [(rng.randrange(n), rng.randrange(n), rng.random() + 0.1) for _ in range(4 * n)]
        snap = graph.Snapshot(edges)
        seeds = {int(snap.ids[0]): 1.0, int(snap.ids[-1]): 2.0}
        a, b = snap.push(seeds, eps=1e-8), snap.power(seeds)
        assert sum(abs(a.get(k, 0) - b.get(k, 0)) for k in {*a, *b}) < 1e-3
    assert graph.Snapshot([]).push({5: 1.0}) == {5: 1.0} and graph.Snapshot([(1, 2, 1.0)]).push({}) == {}


def test_power_frame_is_power(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30), 1.0 + rng.random()) for _ in range(80)]
    df = spark.createDataFrame([(u, v, w) for u, v, w in edges], "u long, v long, score double")
    got = {r.node: r.score for r in graph.ppr_power(graph.edges(similar=df), spark.createDataFrame([(1, edges[0][0], 2.0)], "query_id int, node long, mass double"), 0.5, 4).collect()}
    want = graph.Snapshot(edges).power({edges[0][0]: 1.0}, steps=4)
    assert max(abs(got.get(k, 0) - want.get(k, 0)) for k in {*got, *want}) < 1e-9


def test_louvain_finds_two_cliques():
    clique = lambda xs: [(a, b, 1.0) for a in xs for b in xs if a < b]
    home = graph.louvain([*clique(range(5)), *clique(range(10, 15)), (4, 10, 0.1)])
    assert {home[k] for k in range(5)} == {0} and {home[k] for k in range(10, 15)} == {10}


def brute_timeline(rows):
    """Each key's rows in time: the last of those that start together, runs of one value joined."""
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3]))
        keep = [r for r in mine if r[1] == max((x for x in mine if x[2] == r[2]), key=lambda x: x[3])[1]]
        runs = []
        for r in keep:
            if runs and runs[-1][1] == r[1]:
                runs[-1][4] += 1
            else:
                runs.append([key, r[1], r[2], None, 1])
        for a, b in zip(runs, runs[1:]):
            a[3] = b[2]
        out += map(tuple, runs)
    return sorted(out, key=str)


def test_exclusive_timeline(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(6), rng.choice("abc"), rng.randrange(15), k) for k in range(80)]
    got = timeline.exclusive(spark.createDataFrame(rows, "subj int, value string, valid_from long, seq long"), ["subj"], "value").where("NOT retired")
    assert sorted((tuple(r) for r in got.select("subj", "value", "valid_from", "valid_to", "evidence").collect()), key=str) == brute_timeline(rows)


def test_islands_and_overlaps(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), s := rng.randrange(50), None if rng.random() < 0.1 else s + rng.randrange(1, 9), 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, valid_from long, valid_to long, evidence long")
    covered = lambda rs: {(k, t) for k, a, z, *_ in rs for t in range(a, 70 if z is None else z + 1)}
    got = [tuple(r) for r in timeline.islands(df, ["k"]).select("k", "valid_from", "valid_to", "evidence").collect()]
    assert covered(got) == covered(rows) and sum(r[3] for r in got) == len(rows)
    windows = spark.createDataFrame([(a, a + 5) for a in range(0, 60, 3)], "start long, end long")
    want = {(a, a + 5): sum(f < a + 5 and (z is None or z > a) for _, f, z, _ in rows) for a in range(0, 60, 3)}
    assert {(r.start, r.end): r.n for r in timeline.overlap_counts(df, windows).collect()} == want


def test_islands_with_ties_and_without_starts(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (1, 0, 5, 1), (1, 0, 5, 1), (1, 20, 25, 1), (1, 20, 25, 1), (1, 21, None, 1)]
    got = timeline.islands(spark.createDataFrame(rows, "k int, valid_from long, valid_to long, evidence long"), ["k"])
    assert sorted(map(tuple, got.select("valid_from", "valid_to", "evidence").collect()), key=str) == sorted([(None, None, 1), (None, None, 1), (0, 5, 2), (20, None, 3)], key=str)
    # one order for both windows: another sort may deal ties otherwise
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_knn_is_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    v[5] = 0
    rows = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(999, None)], "id long, embedding array<float>")
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rank): r.id for r in retrieval.knn(rows, asked, 5).collect()}
    u = v.astype(np.float32).astype(float)
    u = np.divide(u, np.linalg.norm(u, axis=1, keepdims=True), out=np.zeros_like(u), where=np.linalg.norm(u, axis=1, keepdims=True) > 0)
    for q in range(0, 200, 20):
        order = sorted((k for k in range(200) if k != q), key=lambda k: (-(u[q] @ u[k]), k))[:5]
        assert [got[q, r] for r in range(1, 6)] == order
    assert retrieval.knn(rows.limit(0), asked, 5).count() == 0


def test_bm25_prefixes(spark):
    docs = spark.createDataFrame([(1, ["production", "db"]), (2, ["productions"]), (3, ["prod"]), (4, None)], "id long, words array<string>")
    asked = spark.createDataFrame([(7, ["production"])], "query_id long, terms array<string>")
    exact = retrieval.bm25(retrieval.postings(docs, {"words": 1.0}), asked, 10)
    grown = retrieval.bm25(retrieval.postings(docs, {"words": 1.0}), asked, 10, prefix_min=4)
    assert {r.id for r in exact.collect()} == {1} and {r.id for r in grown.collect()} == {1, 2}


def test_bm25_prefixes_meet_queries_before_they_are_counted(spark):
    texts = ["Cats' cat catalogue", "catalogues of catalogs", "the cat's running runs", None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, content string")
    posted = retrieval.postings(docs.select("id", retrieval.text_stems(F.col("content")).alias("words")), {"words": 1.0})
    asked = spark.createDataFrame([(1, ["cat"]), (2, ["cata"]), (3, ["runn", "run"])], "query_id long, terms array<string>")
    got = retrieval.bm25(posted, asked, 10, prefix_min=4)
    assert {(r.query_id, r.id) for r in got.collect()} == {(1, 0), (1, 2), (2, 0), (2, 1), (3, 2)}
    plain = docs.select("id", retrieval.stemmed(X.tokens(F.col("content"))).alias("words"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, docs.select("id", retrieval.text_stems(F.col("content"))).collect()))
    # all words of all rows are neither grouped nor stemmed twice in a scan
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[id#\d+L, length#\d+L?, term", plan) and not re.search(r"Filter \(\(size\(", plan)


def test_lexical_beam_finds_two_hops(spark):
    rel = spark.createDataFrame([(1, 10, 11, ["manage"]), (2, 11, 12, ["live", "home"]), (3, 10, 13, ["like"]), (4, 10, 10, ["live"])], "id long, src long, dst long, words array<string>")
    asked = spark.createDataFrame([(0, 10, [["manage"], ["live", "home"]])], "query_id long, entity long, terms array<array<string>>")
    best = paths.lexical_beam(rel, asked).where("position = 1").first()
    assert (best.steps, best.end, best.coverage) == ([1, 2], 12, 2)
    links = spark.createDataFrame([(1, 100), (2, 200)], "relation_id long, memory_id long")
    weight = {r.memory_id: r.weight for r in paths.evidence(paths.lexical_beam(rel, asked).where("position = 1"), links).collect()}
    assert weight[200] == pytest.approx(3 * weight[100])


def test_semantic_beam():
    e = np.eye(4)
    got = paths.semantic_beam(e[0] + e[1], [(1, 10, 11, e[0]), (2, 11, 12, e[1]), (3, 10, 13, e[3])], [10])
    assert got[0][1:] == ([1, 2], 12)


def test_query_terms():
    assert paths.query_terms("Where does Alice's boss live?", "Alice") == [["bos", "boss", "manager"], ["home", "live"]]
    assert paths.negated("who does not like tea") and not paths.negated("who likes tea") and paths.query_terms("") == []


def test_forget_and_invalidate(spark):
    memories = spark.createDataFrame([(1, 0, None, None, None), (2, 0, None, None, 1)], "id long, valid_from long, valid_to long, expired_at long, superseded_by long")
    relations = spark.createDataFrame([(1, None), (2, None)], "id long, expired_at long")
    evidence = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "relation_id long, memory_id long")
    ids = spark.createDataFrame([(1,)], "id long")
    m, r = maintenance.forget(memories, relations, evidence, ids, 99)
    assert {x.id: x.expired_at for x in m.collect()} == {1: 99, 2: None} and {x.id: x.expired_at for x in r.collect()} == {1: 99, 2: None}
    m, r = maintenance.forget(memories, relations, evidence, ids, 99, hard=True)
    assert [(x.id, x.superseded_by) for x in m.collect()] == [(2, None)] and [x.id for x in r.collect()] == [2]
    out = maintenance.invalidate(memories, spark.createDataFrame([(1, 50)], "id long, at long"))
    assert {x.id: x.valid_to for x in out.collect()} == {1: 50, 2: None}
    with pytest.raises(ValueError):
        maintenance.guarded("match (n) delete n")


def test_validity_columns(spark):
    rows = [(1, 0, 10, None, None), (2, 5, None, None, None), (3, 0, None, 7, None), (4, 0, None, 7, 2)]
    df = spark.createDataFrame(rows, "id int, valid_from long, valid_to long, expired_at long, superseded_by long").withColumns({"kind": F.lit("note"), "tags": F.array(F.lit("x")), "scope": F.lit("s")})
    ids = lambda c: {r.id for r in df.where(c).collect()}
    assert ids(validity.valid_at(10)) == {2, 3, 4} and ids(validity.forgotten()) == {3} and ids(validity.ended(10)) == {1, 3, 4} and ids(validity.retracted()) == {3, 4}
    # ended memories are returned (and rank lower), replaced ones only with history, forgotten ones never
    assert ids(validity.eligible()) == {1, 2} and ids(validity.eligible(history=True)) == {1, 2, 4}
    assert ids(validity.eligible(as_of=3)) == {1} and ids(validity.eligible(as_of=3, history=True)) == {1, 4}
    assert ids(validity.eligible(tags=("y",))) == set() and ids(validity.eligible(tags=("Z", "X"))) == {1, 2} and ids(validity.overlaps(10, 20)) == {2, 3, 4}


def test_follow(spark):
    rel = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 9, 1)], "id long, src long, dst long")
    got = {(r.id, r.hops, r.direction) for r in paths.follow(rel, spark.createDataFrame([(0, 1)], "query_id long, entity long"), 2).collect()}
    assert got == {(1, 1, "out"), (4, 1, "in"), (2, 2, "out")}
    assert Counter(r.hops for r in paths.follow(rel, spark.createDataFrame([(0, 1)], "query_id long, entity long"), 3, k=2).collect()) == {1: 2}


def test_merge_keeps_evidence(spark):
    columns = "id long, subj long, src long, predicate_id long, dst long, polarity int, valid_from long, valid_to long, expired_at long, evidence_count long"
    rel = spark.createDataFrame([(1, 5, 5, 1, 9, 1, 10, None, None, 1), (2, 6, 6, 1, 9, 1, 4, None, None, 2), (3, 6, 6, 1, 5, 1, 0, None, None, 1)], columns)
    links = spark.createDataFrame([(1, 100), (2, 200), (2, 100), (3, 300)], "relation_id long, memory_id long")
    mentions = spark.createDataFrame([(100, 5), (200, 6)], "memory_id long, entity_id long")
    r, m, e = maintenance.merge(rel, mentions, 5, 6, 99, links)
    assert {(x.id, x.src, x.dst, x.valid_from, x.evidence_count, x.expired_at) for x in r.collect()} == {(1, 5, 9, 4, 3, None), (3, 5, 5, 0, 1, 99)}
    assert {tuple(x) for x in e.collect()} == {(1, 100), (1, 200), (3, 300)} and {tuple(x) for x in m.collect()} == {(100, 5), (200, 5)}
    left = maintenance.erased({"mentions": mentions, "relation_evidence": links}, spark.createDataFrame([(100,)], "id long"))
    assert left["mentions"].count() == 1 and left["relation_evidence"].count() == 2
