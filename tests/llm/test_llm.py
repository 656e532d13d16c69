"""The ten operators: results against plain versions, edge cases, and the pipeline."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann, bpe, chat, lm_scoring, mixing, near_dedup, quality, queries, token_files, toxicity
from palimpsest.llm import common as C
from palimpsest.llm import line_dedup as lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, drop string, key int, rank double"
LONG = "a sentence that goes on and on until it has more than forty characters"


def frame(spark, texts, ids=None):
    """Documents with nulls and extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", None, 0.5) for i, t in zip(ids, texts, strict=True)], DOCS)


EDGES = ["", None, " ", "\n", "one", "two words", LONG, LONG, "x" * 50_000, "word " * 20_000, "é " * 30, "\x1c\x85　 ", "a\n\nb\n" * 30, "<|endoftext|> [INST] </s>", "🙂" * 200]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, [*EDGES, "null id", "same id", "same id"], [*range(len(EDGES)), None, 500, 500])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


# token files ---------------------------------------------------------------------------------------


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(v), n) == v).all()
    control, data = token_files.pack(np.array([0, 255, 256, 65535, 65536], np.uint32))
    assert (len(control), len(data)) == (2, 1 + 1 + 2 + 2 + 3)


def test_token_files_hold_what_the_library_says(spark, edges, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(edges.select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    t = tokenizer("byte_bpe_50k.json")
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *range(len(EDGES)), 500, 500]
    texts = ["null id", *EDGES, "same id", "same id"]
    at = 0
    for r, text in zip(got, texts, strict=True):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(want), want)
        at += len(want)


def test_token_pieces_are_the_library():
    """Pieces between cuts have the ids of the whole text, and words beside marks and line feeds are encoded once."""
    t, coder = tokenizer("byte_bpe_50k.json"), token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    parts = [*PARTS, ".", ",", "word", " word", "\u00a0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "ã", "à", "…", "'s.", "é.", "×.", "÷,", "b$$", "_", "x-y", "|", "a(b)", "#",  "<", "\r", "\x00", "\x7f", "\n ", "x.\nY", "\n\n"]
    texts = [None, "", "\n", " ", "."]
    for _ in range(1500):
        some = rng.sample(parts, rng.randint(1, len(parts)))
        texts.append("".join(rng.choice(some) for _ in range(rng.randint(0, 60))))
    texts = pa.array([*texts, None, ""])
    got = [np.frombuffer(x, coder.kind).tolist() for x in coder.ids(texts[3:], 7).to_pylist()]
    assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 7] for x in texts[3:].to_pylist()]
    assert coder.fine and coder.ids(texts[:0], 7).to_pylist() == []
    seen = []
    coder.memo = C.Memo(lambda pieces: seen.extend(pieces) or coder.encode(pieces), 1000)
    coder.ids(pa.array([" abc abc, abc.\nabc abc;\nabc abc"]), 0)
    assert sorted(seen) == [b"\n", b" abc", b",", b".", b";", b"abc"]


def test_token_files_of_nothing(spark, empty, tmp_path):
    token_files.write(empty.select("doc_id", "text"), str(tmp_path / "x"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read(spark, str(tmp_path / "x")).count() == 0


# BPE -----------------------------------------------------------------------------------------------

PARTS = ["a", "the", "'s", "'re", "n't", " ", "  ", "\n", "é", "É", "ß", "İ", "123", "9", "!!", "<|endoftext|>", "日本", "🙂", "ing", "tion", "\x1c", "　", "\x85", "Σ", "x'll", "...", "\t \n"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tree_is_the_library(name):
    t, small = tokenizer(name), bpe.Coder(public_tokenizers.path(name), leaf=16, window=4)
    rng = random.Random(2)
    for _ in range(700):
        parts = rng.sample(PARTS, rng.randint(1, len(PARTS))) if rng.random() < 0.7 else list("abcdethin")
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 160)))
        assert small.ids([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_encoded_in_parts():
    t, coder = tokenizer("word_bpe_49k.json"), bpe.Coder(public_tokenizers.path("word_bpe_49k.json"), leaf=200, window=8)
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + " " + "ab" * 400
    assert coder.ids([text, "short"])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_op1_and_op9_queries_are_the_library(spark, small):
    docs = C.table(spark, small, "documents").orderBy("doc_id").collect()
    t, u = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
    one, nine = ({r.doc_id: r for r in queries.queries()[q](spark, small).collect()} for q in ("op1_token_files", "op9_bpe"))
    at = 0
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert (one[d.doc_id].start, one[d.doc_id].n_tokens, one[d.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        ids = u.encode(d.text or "", add_special_tokens=False).ids
        assert (nine[d.doc_id].n_tokens, nine[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert nine[d.doc_id].decoded_sha256 == hashlib.sha256(u.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(edges, empty):
    path, t = public_tokenizers.path("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    got = {r.doc_id: r for r in bpe.digest(edges, path).collect()}
    for i, text in enumerate(EDGES):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(empty, path).count() == 0 and bpe.encode(empty, path).count() == 0


# lines ---------------------------------------------------------------------------------------------


def brute_lines(texts, ids):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(C.LOWER if hasattr(C, "LOWER") else {c: c + 32 for c in range(65, 91)})
    owners = defaultdict(set)
    for i, x in zip(ids, split, strict=True):
        for line in x:
            if len(key(line)) >= 40 and i is not None:
                owners[key(line)].add(i)
    lost = {k: max(v) for k, v in owners.items() if len(v) >= 5}
    return ["\n".join(y for y in x if i is None or key(y) not in lost or lost[key(y)] == i) for i, x in zip(ids, split, strict=True)]


def test_lines_are_brute_force(spark):
    rng = random.Random(1)
    pool = [f"shared line number {k} with enough characters in it to count" for k in range(12)] + ["é" * 40, "É" * 39, "short"]
    texts = ["\n".join(rng.choice([*pool, pool[0].upper() + "  ", f"own line {rng.random()} {'z' * 30}"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    ids = [*range(58), 7, None]
    for bits in (1 << 30, 64):  # a saturated filter suspects every line, and changes nothing
        got = sorted((str(r.doc_id), r.text or "") for r in lines.dedup(frame(spark, texts, ids), filter_bits=bits).collect())
        assert got == sorted((str(i), t) for i, t in zip(ids, brute_lines(texts, ids), strict=True))


def test_lines_edges(edges, empty):
    out = lines.dedup(edges)
    assert out.count() == edges.count() and out.where("n_dropped > 0").count() == 0 and set(edges.columns) <= set(out.columns)
    assert lines.dedup(empty).count() == 0


def test_bloom_has_no_false_negatives(spark):
    h = C.mix64(np.arange(5000, dtype=np.uint64))
    df = spark.createDataFrame([(h[k : k + 100].tobytes(),) for k in range(0, 5000, 100)] + [(h[:50].tobytes(),)], "h binary")
    once, twice = C.Bloom.of(df, 5050, 1 << 20), C.Bloom.of(df, 5050, 1 << 20, twice=True)
    assert once.holds(h).all() and twice.holds(h[:50]).all() and twice.holds(h[50:]).mean() < 0.05


# near duplicates -----------------------------------------------------------------------------------


def brute_components(texts, ids):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def copies(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_components_are_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, "one", "one", "a b c d e", "A b C d e", "a b c d"]
    for _ in range(12):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(30, 150))]
        texts += copies(rng, base, rng.randint(1, 14), 6)
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60)))]) for _ in range(40)]
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in near_dedup.components(frame(spark, texts)).collect()}
    assert got == brute_components(texts, range(len(texts)))


def test_near_blocks_join_what_pivots_leave(spark, monkeypatch):
    """A chain of texts, each near the next only: with one round of pivots the blocks have to find the rest, in small blocks."""
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    words = [f"c{k}" for k in range(400)]
    texts = [" ".join(words[k * 8 : k * 8 + 100]) for k in range(36)] + [" ".join(words[:60] + [f"z{k}{j}" for j in range(60)]) for k in range(10)]
    got = {r.doc_id: r.component_id for r in near_dedup.components(frame(spark, texts)).collect()}
    assert got == brute_components(texts, range(len(texts)))


def test_near_edges(edges, empty):
    got = near_dedup.components(edges).collect()
    assert len(got) == edges.count() and near_dedup.components(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[6].component_id, by[7].component_id, by[7].kept) == (6, 6, False) and (by[0].component_id, by[0].n_shingles, by[0].kept) == (0, 0, True)
    assert by[None].component_id is None and by[None].kept and near_dedup.dedup(edges).columns == edges.columns


# mixing --------------------------------------------------------------------------------------------


def language(rng, stem, n):
    return " ".join(f"{stem}{rng.randrange(30)}" for _ in range(n))


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    langs = [rng.choices("abc", (7, 2, 1))[0] for _ in range(300)]
    texts = [language(rng, x, rng.randint(5, 60)) for x in langs]
    docs = frame(spark, texts).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    labels = docs.where("doc_id % 2 = 0").select("doc_id")
    found = mixing.rated(docs, mixing.learnt(docs, labels, "lang"), {"a": 0.5, "b": 0.3, "c": 0.2})
    rows = found.collect()
    total = sum(r.n_tokens for r in rows)
    sums = np.sum([np.array(r.posterior) * r.rate * r.n_tokens for r in rows], axis=0) / total
    assert np.abs(sums - [0.5, 0.3, 0.2]).max() < 0.02 and min(r.rate for r in rows) >= 0
    out = mixing.mixed(docs, labels, "lang", {"a": 0.5, "b": 0.3, "c": 0.2})
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(range(300))
    tokens = Counter()
    for r in out.collect():
        tokens[r.lang] += len(r.text.split())
    assert abs(tokens["c"] / sum(tokens.values()) - 0.2) < 0.05


def test_mixing_meets_targets_of_skewed_sources(spark):
    sizes = {"a": 190, "b": 6, "c": 3, "d": 1}
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(x for x, m in sizes.items() for _ in range(m))], "doc_id long, text string").select("doc_id", F.expr("repeat(concat(text, ' '), 20)").alias("text"))
    classifier = mixing.Classifier([b"a " * 20, b"b " * 20, b"c " * 20, b"d " * 20], list("abcd"))
    for low, total in ((0.0, None), (1.0, "grow")):
        rows = mixing.rated(docs, classifier, {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}, low=low, total=total).collect()
        sums = np.sum([np.array(r.posterior) * r.rate * r.n_tokens for r in rows], axis=0)
        assert np.abs(sums / sums.sum() - [0.4, 0.2, 0.2, 0.2]).max() < 0.005 and min(r.rate for r in rows) >= low


def test_mixing_leaves_room_where_posteriors_are_soft(spark):
    texts = {x: f"{x} s s " * 10 for x in "abc"}
    docs = spark.createDataFrame([(k, texts[x]) for k, x in enumerate("a" * 70 + "b" * 20 + "c" * 10)], "doc_id long, text string")
    classifier = mixing.Classifier([texts[x].encode() for x in "abc"], list("abc"))
    rows = mixing.rated(docs, classifier, {"a": 0.5, "b": 0.3, "c": 0.2}, low=1.0, total="grow").collect()
    p, t, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    assert p.max() < 0.9
    sums = (r * t) @ p
    assert np.abs(sums / sums.sum() - [0.5, 0.3, 0.2]).max() < 0.002 and r.min() >= 1
    # brute force over totals: the least one at which rates of 1 + p x can meet the targets
    g = (p * t[:, None]).T @ p
    least = next(x for x in np.arange(1, 4, 0.001) * t.sum() if (np.linalg.solve(g, x * np.array([0.5, 0.3, 0.2])) >= 1).all())
    assert abs(sums.sum() / least - 1) < 0.005


def test_mixing_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1,), (None,)], "doc_id long")
    for docs in (edges, empty):
        rows = mixing.rated(docs, mixing.learnt(docs, labels, "lang")).collect()
        assert len(rows) == docs.count() and all(r.rate == 1 and r.copies == 1 for r in rows)
        assert mixing.mixed(docs, labels).count() == docs.count()


# quality -------------------------------------------------------------------------------------------


def test_quality_order_changes_nothing(edges, empty):
    rows = lambda rules: sorted(map(str, quality.judged(edges, rules).collect()))
    assert rows(quality.RULES) == rows(quality.RULES[::-1]) and len(rows(quality.RULES)) == edges.count()
    assert quality.judged(empty).count() == 0


def test_repeated_words_are_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        w = [rng.choice("abcde").encode() for _ in range(rng.randint(0, 40))]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + s for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for s in range(3)}
        assert quality.repeat_words_of(b" ".join(w), w) == len(hit)


def test_cheap_and_strict_rules_come_first(spark):
    docs = frame(spark, ["# " * 40 + "x" * 3] * 30 + ["plain words here"] * 30)
    assert quality.ordered(docs)[0].name in ("symbols", "short words")


# toxicity ------------------------------------------------------------------------------------------


def test_toxicity_learns_and_tolerates_gaps():
    rng = random.Random(8)
    clean = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "tempor", "magna"]) + str(rng.randrange(40)) for _ in range(40)) for _ in range(150)]
    toxic = [c.replace("lorem", f"{rng.choice(['idiot', 'wretch', 'buffoon'])} lorem", 2) for c in clean[:90]]
    clean = [c for c, t in zip(clean, [*toxic, *[None] * 60], strict=True) if c != t]
    toxic = [t for t in toxic if any(x in t for x in ("idiot", "wretch", "buffoon"))]
    model = toxicity.train([t.encode() for t in toxic[:60]], [c.encode() for c in clean[60:]])
    score = lambda *ts: model.scores([toxicity.units(t.encode()) for t in ts])
    assert min(score(*toxic[60:])) > 0.7 and max(score(*clean[:30])) < 0.3
    insults = ("idiot", "wretch", "buffoon")
    assert min(score(*insults, "you i d i o t", "an idi.ot", "bufffoon")) > toxicity.CUTOFF
    assert min(score(*(x[:k] + c + x[k:] for x in insults for k in range(1, len(x)) for c in ".-x7"))) > toxicity.CUTOFF
    assert max(score("", "nothing here", "lorem ipsum")) < 0.3


def test_toxicity_sees_through_marks():
    rng = random.Random(8)
    text = lambda *more: " ".join([*(rng.choice(["lorem", "ipsum", "dolor", "amet"]) + str(rng.randrange(40)) for _ in range(40)), *more]).encode()
    insults = ["idiot", "moron", "pathetic"]
    model = toxicity.train([text(insults[k % 3]) for k in range(60)], [text() for _ in range(90)])
    score = lambda *ts: model.scores([toxicity.units(t.encode()) for t in ts])
    assert min(score(*insults, "i.d.i.o.t", "m.o.r.o.n", "p.a.t.h.e.t.i.c", "id--iot", "mo--ron", "i . d . i . o . t")) > toxicity.CUTOFF
    assert max(score("lo-rem1", "d.o.l.o.r.2", "nothing here")) < 0.3


def test_toxicity_learns_many_rare_insults():
    rng = random.Random(5)
    made = lambda n, a, b: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(a, b))) for _ in range(n)]
    insults, usual = made(40, 5, 9), made(3000, 3, 9)
    text = lambda *more: " ".join([*rng.choices(usual, [1 / (k + 5) for k in range(3000)], k=30), *more]).encode()
    model = toxicity.train([text(insults[k % 40]) for k in range(1000)], [text() for _ in range(2000)])
    score = lambda ts: np.array(model.scores([toxicity.units(t) for t in ts]))
    assert (score([text(x) for x in insults]) > 0.7).mean() > 0.9 and (score([text() for _ in range(500)]) > 0.7).mean() < 0.02
    assert len(toxicity.apart([toxicity.units(text())] * 5 + [toxicity.units(text())])) == 2


def test_kernel_is_its_definition():
    def k(x, y):
        f = [Counter() for _ in "xy"]
        for c, w in zip(f, (x, y), strict=True):
            for i, j, m in itertools.combinations(range(len(w)), 3):
                if m - i < toxicity.SPAN:
                    c[w[i] << 16 | w[j] << 8 | w[m]] += toxicity.DECAY ** (m - i - 2)
        return sum(v * f[1][u] for u, v in f[0].items())

    def kernel(x, y):
        return (k(x, y) / np.sqrt(k(x, x) * k(y, y))) ** toxicity.POWER if k(x, x) else 0.0

    marks = [b"\x02idiot", b"loser", b"\x02losers"]
    model = toxicity.Model(marks, 2)
    words = [b"\x02idiot", b"\x02id.iot", b"\x02xxidiotxx", b"\x02looser", b"\x02zzz", b"\x02a", b"\x02idididid"]
    want = np.array([[kernel(w, m) for m in marks] for w in words])
    assert np.allclose(model.kernels(words), want, atol=1e-5)
    # the Nystroem map: inner products of landmarks' features are their kernels; a text's features are sums over its words
    gram = np.array([[kernel(x, y) for y in marks] for x in marks])
    values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(3))
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    assert np.allclose((gram @ root) @ (gram @ root).T, gram, atol=0.01)
    texts = [set(words), {words[0]}, set()]
    for got, t in zip(model.features(texts), texts, strict=True):
        scale = 1 + len(t) / toxicity.HALF
        assert np.allclose(got, [*(sum((np.array([kernel(w, m) for m in marks]) for w in t), np.zeros(3)) @ root / scale), len(t) / toxicity.HALF / scale, 1 / scale], atol=1e-4)
    model.weights, model.per_word, model.bias = np.array([1.0, -2.0, 0.5]), 0.1, -1.0
    assert np.allclose(model.values(texts), model.features(texts) @ [1.0, -2.0, 0.5, 0.1 * toxicity.HALF, -1.0], atol=1e-4)


def test_toxicity_of_held_out_labels_in_every_language():
    """Recall and precision on the labels that the driver's largest table holds back."""
    import pandas as pd

    d = "/root/testdata/sf0.1"
    rows = pd.read_parquet(f"{d}/documents.parquet", columns=["doc_id", "text", "lang"]).merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = np.array([C.crc_mod(i, 3) == 1 for i in rows.doc_id])
    seen = rows[~held]
    model = toxicity.train(*([t.encode() for t in seen.text[seen.toxic == x]] for x in (1, 0)))
    rest = rows[held].reset_index(drop=True)
    hit = np.array(model.scores([toxicity.units(t.encode()) for t in rest.text])) >= toxicity.CUTOFF
    toxic = (rest.toxic == 1).to_numpy()
    assert hit[toxic].mean() >= 0.9 and toxic[hit].mean() >= 0.9
    for lang in ("en", "de", "fr", "es"):
        own = (rest.lang == lang).to_numpy()
        assert hit[own & toxic].mean() >= 0.85 and toxic[own & hit].mean() >= 0.8


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None), (4, 0)], "doc_id long, toxic int")
    assert toxicity.filtered(edges, labels).count() == edges.count()
    model = toxicity.train(*toxicity.labelled(empty, labels))
    assert max(r.score for r in toxicity.score(edges, model).collect()) < 1e-9
    assert toxicity.score(empty, model).count() == 0 and toxicity.filtered(empty, labels).count() == 0
    repeated = frame(spark, ["b", "a", "c"], [1, 1, 4])
    assert toxicity.labelled(repeated, labels) == ([b"a"], [b"c"] if C.crc_mod(4, 3) != 1 else [])


# language model ------------------------------------------------------------------------------------


def test_lm_base_is_its_sql(spark, oracle, small):
    import pandas as pd

    got = {r.doc_id: r for r in lm_scoring.query(spark, small).collect()}
    ids = pd.DataFrame({"doc_id": [i for i in got if zlib.crc32(str(i).encode()) % 5 != 1]})
    con = oracle.cursor()
    con.register("train_ids", ids)
    for r in con.execute(lm_scoring.BASE_SQL).fetchall():
        x = got[r[0]]
        assert (x.n_tokens, x.n_known, x.train_tokens) == r[1:4] and x.base_score == pytest.approx(r[4], rel=1e-9)
    assert all(r.score < 0 for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert held and {r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) for i, r in got.items()} == {True}


def test_bits_make_a_distribution():
    """Over the next byte, probabilities add up to 1 whatever came before."""
    table = np.zeros((int(lm_scoring.sizes_of(2)[-1]), 2), np.float32)
    words = [b"hello", b"help", b"hold", "é".encode()]
    lm_scoring.count(words, table, 2)
    speller = lm_scoring.Speller(table, 2)
    speller.learn(words)
    tails = [bytes([b]) for b in range(256)]
    stretched, gate, nodes, bits, owner = speller.inputs([b"he" + t for t in tails], False)
    p = speller.mixer.refined(speller.mixer.mixed(stretched, gate), nodes)
    each = np.where(bits == 1, p, 1 - p)[2::3].prod(axis=1)
    assert each.sum() == pytest.approx(1) and each[ord("l")] > each[ord("z")]


def block_of(texts):
    """A Block of texts and its words."""
    words = sorted({w for t in texts for w in t.split()})
    number = {w: k for k, w in enumerate(words)}
    tokens = np.array([number[w] for t in texts for w in t.split()], np.int32)
    return lm_scoring.Block(tokens, np.array([len(t.split()) for t in texts], np.int64), lm_scoring.word_hashes([w.encode() for w in words])).laid(), words


def no_answers():
    empty = {"key": pa.array([], pa.int64()), "d": pa.array([], pa.int64()), "x": pa.array([], pa.binary()), "n": pa.array([], pa.float64())}
    return lm_scoring.Answers.of(pa.table(empty))


def answers_from(block, ids):
    """What answers_of() finds, by hand: every anchor that two documents hold."""
    p, key = block.anchors()
    seen = defaultdict(list)
    for q, k in zip(p, key, strict=True):
        seen[int(k)].append((int(ids[block.owner[q]]), block.following(np.array([q]))[0].tobytes()))
    rows = [(np.uint64(k).astype(np.int64), min(x), max(x), len({d for d, _ in x})) for k, x in seen.items() if len({d for d, _ in x}) > 1]
    follow = [r[1][1] + (r[2][1] if r[2][1] != r[1][1] else b"") for r in rows]
    cols = {"key": pa.array([int(r[0]) for r in rows], pa.int64()), "d": pa.array([r[1][0] for r in rows], pa.int64()), "x": pa.array(follow, pa.binary()), "n": pa.array([float(r[3]) for r in rows])}
    return lm_scoring.Answers.of(pa.table(cols))


def test_decisions_are_their_definition():
    """Each decision, followed token by token; with other words to come, the past decides alike."""
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(400)}" for _ in range(120))
    texts = ["", *(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 40))) for _ in range(8)), passage, "x y " + passage, "z"]
    block, words = block_of(texts)
    ids = np.arange(len(texts))
    known = answers_from(block, ids)
    assert len(known.keys)
    d = block.decisions(ids, known)
    kind = np.where(d.gate < 10, "A", np.where(d.gate < 14, "B", "C"))
    got = defaultdict(dict)
    for q, k, bit in zip(d.place, kind, d.bit, strict=True):
        got[int(q)][k] = int(bit)
    expected, _, _ = block.expected(ids, known)
    q = 0
    for text in texts:
        w = [*text.split(), None]
        for i, x in enumerate(w):
            want = {}
            here = int(block.short(np.array([q]))[0])
            if expected[q]:
                want["A"] = int(expected[q] == here)
            j = max((j for j in range(i - 1) if w[j] == w[i - 1]), default=None)
            guess = w[j + 1] if j is not None else None
            agrees = guess is not None and expected[q] and block.hashes[words.index(guess)] & np.uint64(0xFFFFFFFF) == expected[q]
            if not want.get("A") and guess is not None and not agrees:
                want["B"] = int(guess == x)
            if i and not want.get("A") and not want.get("B"):
                want["C"] = int(x in w[:i])
            assert got[q] == want, (text, i)
            q += 1
    # most of a passage that another document holds is expected
    assert (d.hit[block.owner == len(texts) - 2].mean()) > 0.5 and not d.hit[block.owner == len(texts) - 1].any()


def test_probabilities_of_the_next_token_add_up_to_one_at_most():
    words = [f"w{k}" for k in range(12)]
    rng = random.Random(2)
    u = np.array([*rng.choices(range(1, 9), k=12), 3.0])
    u /= u.sum()
    start = "w1 w2 w3 w1 w2 w5 w1".split()
    # every continuation by one word, and the end at once
    texts = [" ".join([*words]), *(" ".join([*start, w]) for w in words), " ".join(start)]
    block, names = block_of(texts)
    order = {w: k for k, w in enumerate(names)}
    u = np.array([*(u[words.index(w)] for w in names), u[-1]])
    table = np.random.default_rng(1).integers(0, 50, (lm_scoring.KINDS * lm_scoring.CONTEXTS * lm_scoring.WIDE, 2))
    chooser = lm_scoring.Chooser(table)
    d = block.decisions(np.arange(len(texts)), no_answers())
    at = np.log10(np.zeros(len(block.t)) + 1)
    place, n = np.arange(len(block.t)), len(block.t)
    first = np.where(d.new & ~block.last, u[block.t], 0.0)
    total = np.cumsum(first) - first
    total -= total[place - block.at]
    at = np.where(d.new, u[block.t] / (1 - total), (d.times + lm_scoring.LEAN * u[block.t]) / (block.at + lm_scoring.LEAN * total + 1e-300))
    at[d.again] = 1
    at = at * 10 ** np.bincount(d.place, chooser.log10(d), n)
    next_one = [at[(block.owner == k) & (block.at == len(start))][0] for k in range(1, len(texts))]
    assert 0.5 < sum(next_one) <= 1 + 1e-9 and len(order) == 12
    # the price of a text is the product of its tokens'
    want = np.bincount(block.owner, np.log10(at), len(texts))
    assert np.allclose(lm_scoring.priced(block, d, chooser, u), want)


def test_lm_tells_documents_that_occur_twice(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"v{int(rng.paretovariate(0.7)) % 3000}" for _ in range(150))
    texts = [text() for _ in range(120)]
    texts += texts[:15]
    docs = frame(spark, texts).select("doc_id", "text")
    got = {r.doc_id: r for r in lm_scoring.scored(docs).collect()}
    other = {k: k + 120 if k < 15 else k - 120 for k in [*range(15), *range(120, 135)]}
    known = [k for k, o in other.items() if not got[o].held_out]
    rate = lambda k: (got[k].score - got[k].base_score) / got[k].n_tokens
    single = sorted(rate(k) for k in range(15, 120))
    assert known and np.mean([rate(k) > single[-5] for k in known]) > 0.8
    # the same whatever tasks and blocks the rows come in
    again = {r.doc_id: r for r in lm_scoring.scored(docs.repartition(7)).collect()}
    assert all(again[k].score == pytest.approx(r.score, rel=1e-9) and again[k].base_score == pytest.approx(r.base_score, rel=1e-9) for k, r in got.items())
    assert all(r.n_bytes == len(texts[k]) and r.bits_per_byte == pytest.approx(-r.score * np.log2(10) / len(texts[k])) for k, r in got.items())


def test_lm_weights_are_learnt_from_everything(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdeéß") for _ in range(rng.randint(5, 8))).encode() for _ in range(60_000)})
    assert len(words) > 42_000
    speller = lm_scoring.spelled(spark.createDataFrame([(w, 1 + k % 3) for k, w in enumerate(words)], "word binary, c long"))
    assert speller.mixer.seen.sum() == 8 * sum(len(w) + 1 for w in words)
    table = np.zeros_like(speller.table)
    lm_scoring.count(words, table)
    alone = lm_scoring.Speller(table)
    alone.learn(words)
    assert (speller.mixer.seen == alone.mixer.seen).all() and np.allclose(speller.mixer.weights, alone.mixer.weights)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 12))) for _ in range(700)]
    blocks = lm_scoring.blocks_of(frame(spark, texts).select("doc_id", "text")).localCheckpoint()
    chooser = lm_scoring.chosen(blocks, lm_scoring.answers_of(blocks))
    n = 0
    for row in blocks.collect():
        whole, ids, _, train = lm_scoring.opened(row.asDict())
        d = whole.laid().decisions(ids, no_answers())
        n += train[whole.owner[d.place]].sum()
    assert train.sum() * 4 > 400 and chooser.mixer.seen.sum() == n


def test_lm_learns_without_shuffling_texts(spark):
    """Texts and their anchors meet once: what learns from them only reads."""
    rng = random.Random(5)
    same = " ".join(f"w{rng.randrange(50)}" for _ in range(400))
    texts = [*(" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(80)), same, same + " end", None, ""]
    blocks = C.written(lm_scoring.blocks_of(frame(spark, texts).select("doc_id", "text").repartition(3)), "test-blocks")
    answers = lm_scoring.answers_of(blocks)
    met = lm_scoring.answered(blocks, answers)
    assert met.count() == blocks.count() > 1 and "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    for row in met.collect():
        want = lm_scoring.Answers.of(answers.where(f"block = {row.block}").toArrow())
        got = lm_scoring.Answers.unpacked(row.answers, row.n_answers)
        assert all((a == b).all() for a, b in zip(vars(got).values(), vars(want).values(), strict=True))
    assert answers.count() > 0
    # taken from tables, predictions without a word are those that its counts give
    words = [b"hello", b"help", b"help", "é".encode(), b""]
    table = np.zeros((int(lm_scoring.sizes_of(1)[-1]), 2), np.float32)
    lm_scoring.count(words[:3], table)
    stretched, gate, _, bits, _ = lm_scoring.Speller(table).inputs([b"help ", b"new "], True)
    slots, _, _, _ = lm_scoring.bits_of([b"help ", b"new "])
    for got, at in zip(stretched, slots, strict=True):
        n = table[at]
        n[..., 0] -= bits == 0
        n[..., 1] -= bits == 1
        assert (got == lm_scoring.stretch(*np.moveaxis(np.maximum(n, 0), -1, 0))).all()


def test_lm_what_follows_ends_with_the_text():
    """Whether or not another text comes after it."""
    text = "a b c d e f"
    (one, _), (two, _) = block_of([text]), block_of([text, "g h"])
    p = np.array([4])
    assert (one.following(p) == two.following(p)).all() and (one.following(p)[0] != 0).sum() == 2


def test_lm_edges(edges, empty):
    rows = lm_scoring.scored(edges).collect()
    assert len(rows) == edges.count() and {r.doc_id: r.n_tokens for r in rows}[1] == 1 and lm_scoring.scored(empty).count() == 0


# chat ----------------------------------------------------------------------------------------------


def test_template_round_trip():
    rng = random.Random(5)
    for _ in range(400):
        turns = [("".join(rng.choice(["a", "]", "\\", "[INST"]) for _ in range(rng.randint(0, 3))), "".join(rng.choice(["x", "\\", "</s>", "<", "[INST:", "[/INST]", "]", "\n", "é"]) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        assert chat.parse(chat.template(turns)) == turns


def test_black_box_spans_and_rewrites():
    r = chat.Render(lambda ts: "".join(f"<{role}>{text}</{role}>\n" for role, text in ts))
    for turn in [("user", "</use"), ("assistant", "er>"), ("user", "")]:
        added, a, z = r.add(turn)
        assert added[a:z] == turn[1]
    assert r.rewritten is None
    last = chat.Render(lambda ts: "".join(f"{role}: {text}{' (latest)' if k == len(ts) - 1 else ''}\n" for k, (role, text) in enumerate(ts)))
    last.add(("user", "one"))
    last.add(("user", "two"))
    assert last.rewritten == len("user: one")


def test_a_template_that_looks_back_is_refused():
    def render(turns):
        return "".join(f"{k}{t}" for k, (_, t) in enumerate(turns))

    render.stateless_after = 1
    r = chat.Render(render)
    with pytest.raises(ValueError):
        for k in range(100):
            r.add(("user", f"t{k}"))


def test_a_template_that_rewrites_late_is_refused():
    def render(turns):
        return "".join(f"<{t}>" for _, t in (turns if len(turns) < 100 else turns[-50:]))

    assert chat.Render(render).keep is None
    plain = chat.Render(render)
    for k in range(102):
        plain.add(("user", f"t{k}"))
    assert plain.rewritten is not None
    render.stateless_after = 1
    with pytest.raises(ValueError):
        r = chat.Render(render)
        for k in range(200):
            r.add(("user", f"t{k}"))

    def wide(turns):
        return "".join(f"<{t}>" for _, t in turns) + "".join("!" for _ in turns[3:])

    wide.stateless_after = 2
    with pytest.raises(ValueError):
        r = chat.Render(wide)
        for k in range(200):
            r.add(("user", f"t{k}"))


def test_a_template_is_refused_whatever_the_size():
    def render(turns):
        return "".join(f"<{t}>" for _, t in (turns if len(turns) < 100 else turns[-50:]))

    render.stateless_after = 1
    for size in (1, 600_000):
        r = chat.Render(render)
        with pytest.raises(ValueError):
            for k in range(140):
                r.add(("user", f"{k}" + "x" * size))
        assert len(r.turns) == 128

    # short or long, the new part comes from the last turns alone
    seen = []

    def plain(turns):
        seen.append(len(turns))
        return "".join(f"<{t}>" for _, t in turns)

    plain.stateless_after = 1
    r = chat.Render(plain)
    for k in range(100):
        seen.clear()
        added, a, z = r.add(("user", f"t{k}"))
        assert added[a:z] == f"t{k}" and min(seen) == (k > 0)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, piece string"
    turns = spark.createDataFrame([(1, None, None, None, "p"), (1, 1, "assistant", "b", "p"), (1, 1, "assistant", "a", "p"), (None, 0, "user", "x", None)], schema)
    got = {r.conv_id: r for r in chat.digest(chat.formatted(turns)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 2, hashlib.sha256(b"ab").hexdigest()) and got[None].n_turns == 1
    assert chat.digest(chat.formatted(turns.limit(0))).count() == 0
    long = spark.createDataFrame([(9, k, "user", "y" * 20, None) for k in range(300)], schema)
    assert chat.digest(chat.formatted(long)).first().n_turns == 300


# nearest neighbours --------------------------------------------------------------------------------


def test_ann_recall(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))).astype(np.float32)
    v[100:160] = v[99]
    rows = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(rows, rows.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x, hits = v.astype(float), 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [k for k in np.lexsort((np.arange(len(x)), d)) if k != q][:10]
        hits += len(set(want) & {i for i, _ in found})
        assert [s for _, s in found] == sorted(s for _, s in found) and all(s == pytest.approx(d[i]) for i, s in found)
    assert len(got) == 60 and hits / 600 >= 0.97
    assert [i for i, _ in got[100]] == [k for k in range(99, 110) if k != 100]


def test_ann_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)], "vec_id long, embedding array<float>")
    get = lambda: sorted((r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(rows, rows.where("vec_id % 3 = 0"), 5).collect())
    whole = get()
    monkeypatch.setattr(ann, "QUERIES", 20)
    assert len(whole) == 500 and get() == whole


def test_ann_edges(spark):
    schema = "vec_id long, embedding array<float>, score double, rank int"
    bad = [(0, None, 1.0, 1), (1, [0.0, 0.0], 1.0, 1), (2, [1.0, None], 1.0, 1), (3, [float("nan"), 1.0], 1.0, 1), (4, [float("inf"), 1.0], 1.0, 1), (5, [1.0], 1.0, 1), (None, [1.0, 2.0], 1.0, 1), (6, [], 1.0, 1)]
    good = [(100, [1.0, 0.0], None, None), (200, [0.0, 1.0], None, None), (200, [0.0, 1.0], None, None), (300, [1.0, 1.0], None, None)]
    rows = spark.createDataFrame(bad + good, schema)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(rows, rows.where("vec_id = 100")).collect())
    assert got == [(100, 1, 300), (100, 2, 200), (100, 3, 200)]
    assert ann.neighbours(rows.limit(0), rows.limit(0)).count() == 0


# queries -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, small, oracle, same, name):
    same(queries.queries()[name](spark, small), oracle.sql(queries.oracle_sql()[name]))


def test_toxicity_query_scores_all(spark, small):
    rows = toxicity.query(spark, small).collect()
    assert len(rows) == C.table(spark, small, "documents").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p

    docs = C.table(spark, small, "documents")
    seen = {}
    for name, stage in p.STAGES:
        docs = C.written(stage(spark, docs, small), "test-stage")
        seen[name] = docs.toPandas()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for name in ("toxicity", "line dedup", "near dedup", "mixing"):
        assert sorted(seen[name].columns) == sorted(names)
    before, after = seen["toxicity"], seen["line dedup"]
    texts = dict(zip(before.doc_id, brute_lines(before.text, before.doc_id), strict=True))
    assert dict(zip(after.doc_id, after.text, strict=True)) == texts
    groups = brute_components(after.text, after.doc_id)
    assert set(seen["near dedup"].doc_id) == {i for i, c in groups.items() if i == c}
    assert set(seen["mixing"].doc_id) == set(seen["near dedup"].doc_id)
    assert len(seen["encoding"]) == len(seen["mixing"])
    assert p.run(spark, small).count() == len(seen["encoding"])


def test_entry_without_the_subpackage(tmp_path):
    """The queries and tests of the rest do not need llm or the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recall_lite' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, check=True)


def test_columns_of_hashes(spark):
    df = spark.createDataFrame([(0,), (7,), (None,)], "doc_id long").select(C.crc_mod_col("doc_id", 3).alias("m"), F.col("doc_id"))
    assert [(r.m, r.doc_id) for r in df.collect()] == [(C.crc_mod(0, 3), 0), (C.crc_mod(7, 3), 7), (None, None)]


def test_numbers_in_planes_round_trip():
    for top in (1, 1 << 10, 1 << 23, 1 << 30):
        x = np.random.default_rng(top).integers(0, top, 1000).astype(np.int32)
        assert (lm_scoring.unplaned(lm_scoring.planes(x), 1000) == x).all()
    assert len(lm_scoring.unplaned(lm_scoring.planes(np.zeros(0, np.int32)), 0)) == 0


def test_columns_with_inner_names_stay(spark):
    texts = [LONG, LONG + "\nown", *([LONG] * 4), None, ""]
    docs = frame(spark, texts).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("__id", "__drop", "__n", "__k", "__bucket", "kept", "copies")})
    labels = spark.createDataFrame([(0,), (1,)], "doc_id long")
    for out in (lines.dedup(docs).select(*docs.columns), mixing.mixed(docs, labels), near_dedup.dedup(docs)):
        assert out.columns == docs.columns and all(r["__id"] == f"__id{r.doc_id}" and r["__drop"] == f"__drop{r.doc_id}" and r["__k"] == f"__k{r.doc_id}" for r in out.collect())
    kept = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert kept[1] == "own" and kept[5] == LONG and kept[0] == ""


def test_pipeline_of_nothing_and_of_edges(spark, tmp_path, edges, empty):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("edges", edges), ("empty", empty)):
        d = str(tmp_path / name)
        docs.withColumn("__id", F.lit(1)).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        rows = p.run(spark, d).collect()
        assert (len(rows) == 0) == (name == "empty")
    assert None in {r.doc_id for r in p.run(spark, str(tmp_path / "edges")).collect()}
