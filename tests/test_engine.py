import pytest

from palimpsest.engine import Engine
from palimpsest.ledger import Rejected
from palimpsest.sources import exchange, worlds
from palimpsest.streaming import ingest

NOW = 1_792_594_800


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), clock=lambda: NOW)
    day = 86_400
    e.remember_batch([
        {"content": "Alice Smith lives in Paris.", "entities": [{"name": "Alice Smith", "type": "person"}, {"name": "Paris"}], "relations": [{"source": "Alice Smith", "predicate": "lives in", "target": "Paris", "valid_from": NOW - 1000 * day}]},
        {"content": "Alice Smith moved to Rome.", "entities": [{"name": "Alice Smith"}, {"name": "Rome"}], "relations": [{"source": "Alice Smith", "predicate": "lives in", "target": "Rome", "valid_from": NOW - 100 * day}]},
        {"content": "Bob works at Acme Corp.", "entities": [{"name": "Bob"}, {"name": "Acme Corp"}], "relations": [{"source": "Bob", "predicate": "works at", "target": "Acme Corp"}]},
        {"content": "Bob reports to Alice Smith.", "entities": [{"name": "Alice Smith"}, {"name": "Bob"}], "relations": [{"source": "Bob", "predicate": "reports to", "target": "Alice Smith"}]},
        {"content": "The production database is PostgreSQL."},
    ])
    return e


def test_write_read_and_upkeep(engine):
    assert engine.remember({"content": "The production database is PostgreSQL."})["duplicate"]
    with pytest.raises(Rejected):
        engine.remember({"content": ""})
    assert set(engine.validate().values()) == {0}
    assert engine.recall("production database", k=3)[0]["content"] == "The production database is PostgreSQL."
    facts = {(r.source, r.predicate, r.target) for r in engine.follow("Alice Smith").collect()}
    assert ("Alice Smith", "live in", "Rome") in facts and ("Alice Smith", "live in", "Paris") not in facts and ("Alice Smith", "manage", "Bob") in facts
    assert {r.target for r in engine.aggregate("lives in", source="Alice Smith", history=True).collect()} == {"Paris", "Rome"}
    assert engine.entity("Bob")["facts"][0]["source"] in ("Alice Smith", "Bob")
    assert engine.sql("SELECT count(*) AS n FROM edges").first().n == 4
    with pytest.raises(Rejected):
        engine.resolve("Nobody At All")


def test_export_and_import(spark, engine, tmp_path):
    engine.export(str(tmp_path / "out"), forgotten=True)
    rows = list(exchange.inputs(exchange.read_jsonl(spark, str(tmp_path / "out"))))
    again = Engine(spark, str(tmp_path / "again"), clock=lambda: NOW)
    assert again.load(rows) == len(rows)
    a, b = engine.stats(), again.stats()
    assert {k: a[k] for k in ("memories", "entities", "relations", "relation_evidence")} == {k: b[k] for k in ("memories", "entities", "relations", "relation_evidence")}


def test_legacy_import(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE memories(id TEXT, kind TEXT, content TEXT, tags TEXT, agent_id TEXT, session_id TEXT, importance REAL, created_at INTEGER, occurred_at INTEGER, deleted INTEGER, ended INTEGER)")
        db.executemany("INSERT INTO memories VALUES (?,?,?,?,?,?,?,?,?,?,?)", [("a", "note", " kept ", '["x"]', "ag", "s", 0.5, 100, None, 0, 1), ("b", "note", "gone", "[]", "ag", "s", 0.5, 100, None, 1, 0), ("c", "note", "  ", "[]", None, None, None, 100, None, 0, 0)])
    (row,) = exchange.read_legacy(spark, path).collect()
    assert (row.content, row.tags, row.valid_from, row.valid_to) == ("kept", ["x"], 100, 101)


def test_world_and_stream(spark, tmp_path):
    facts = worlds.facts(spark, 5)
    assert facts.count() == 30 and worlds.questions(facts).count() == 10
    facts.selectExpr("content", "'note' AS kind", "timestamp_seconds(valid_from) AS ts").unionAll(facts.selectExpr("content", "'note' AS kind", "timestamp_seconds(valid_from) AS ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content string, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    q = ingest.into(ingest.fresh(stream, "ts", "4000 days"), lambda df, n: seen.append(df.count()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sum(seen) == facts.select("content").distinct().count()


def test_overview_cli_and_server(spark, engine, tmp_path, capsys):
    import io
    import json

    from palimpsest import cli, evals, server

    top = engine.overview(3)
    assert top and "Alice Smith" in top[0]["entities"] and top[0]["memory"]
    assert cli.main(["--store", "x", "stats"], engine) == 0 and "memories" in capsys.readouterr().out
    assert cli.main(["--store", "x", "--json", "follow", "Bob"], engine) == 0 and json.loads(capsys.readouterr().out)
    assert cli.main(["--store", "x", "entity", "Nobody At All"], engine) == 2
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "note"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "stats"}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "entity", "arguments": {"name": 1.5}}}, {"jsonrpc": "2.0", "id": 5, "method": "nope"}]
    sink = io.StringIO()
    server.serve(engine, io.StringIO("".join(json.dumps(x) + "\n" for x in lines) + "garbage\n"), sink)
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [x.get("id") for x in out] == [1, 2, 3, 4, 5, None] and len(out[1]["result"]["tools"]) == 11 and not out[2]["result"]["isError"] and out[3]["result"]["isError"] and "error" in out[4]
    fixture = {"now": "2026-10-21T15:00:00Z", "memories": [{"key": "a", "content": "Zoe likes green tea"}, {"key": "b", "content": "The server room is on floor nine", "supersedes": []}], "queries": [{"q": "which tea does Zoe like", "category": "c", "expect": ["a"], "answers": ["green"]}]}
    now, memories, asked = evals.load(json.dumps(fixture))
    fresh = Engine(spark, str(tmp_path / "eval"), clock=lambda: now)
    ids = evals.ingest(fresh, memories)
    report = evals.evaluate(fresh, asked, ids)
    assert report["categories"]["all"] == {"n": 1, "recall": 1.0, "mrr": 1.0, "acc": 1.0}
    assert fresh.recall("zzz qqq xxyyzz") == [] and evals.setting("rrf_k=7") == {"rrf_k": 7}


def test_a_rejected_memory_leaves_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), clock=lambda: 1_792_594_800)
    out = engine.remember_batch([{"content": "Alice knows Bob.", "entities": [{"name": "Alice"}], "relations": [{"source": "Alice", "predicate": "knows"}]}, {"content": "Carol lives in Rome.", "entities": [{"name": "Carol"}]}])
    assert "error" in out[0] and out[1]["id"] == "m1"
    assert [r.content for r in engine.store.table("memories").collect()] == ["Carol lives in Rome."] and [r.name for r in engine.store.table("entities").collect()] == ["Carol"]
    engine.forget("m1", hard=True)
    assert all(engine.store.table(n).count() == 0 for n in ("memories", "memories_vec", "mentions", "relation_evidence"))


def test_store_survives_a_crash_and_refuses_a_second_writer(spark, tmp_path):
    from palimpsest.sources.store import Store

    first = Store(spark, str(tmp_path / "s"))
    second = Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([(1, 2)], "memory_id long, entity_id long")
    first.commit({"mentions": row})
    with pytest.raises(RuntimeError):
        second.commit({"mentions": row.limit(0)})
    assert Store(spark, str(tmp_path / "s")).table("mentions").count() == 1
    # a manifest cut short by a crash counts as not written, and the next write passes it
    (tmp_path / "s" / f"manifest-{first.generation + 1:012d}.json").write_text('{"generation"')
    again = Store(spark, str(tmp_path / "s"))
    assert again.generation == first.generation and again.table("mentions").count() == 1
    again.commit({"mentions": row.union(row)})
    assert Store(spark, str(tmp_path / "s")).table("mentions").count() == 2
