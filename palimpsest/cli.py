"""The command line: python -m palimpsest.cli --store PATH COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from palimpsest import evals, render, server
from palimpsest.engine import Engine
from palimpsest.ledger import Rejected
from palimpsest.sources import exchange


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("--store", required=True)
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> None:
        c = sub.add_parser(name)
        for flags, options in arguments:
            c.add_argument(*flags, **options)

    text = lambda *flags, **more: (flags, more)
    flag = lambda name: ((name,), {"action": "store_true"})
    command("remember", text("content", nargs="?"), text("--kind"), text("--tag", action="append", dest="tags"), text("--importance", type=float), text("--scope"), text("--source"), text("--session"), text("--valid-from"), text("--valid-to"), text("--supersedes", action="append"), text("--input", help="a JSON object, or - for one on standard input"))
    command("recall", text("query"), text("-k", type=int, default=8), text("--budget", type=int, default=1200), text("--as-of"), flag("--history"), text("--kind", action="append", dest="kinds"), text("--tag", action="append", dest="tags"), text("--scope"), text("--source"), text("--session"))
    command("entity", text("name"), text("--limit", type=int, default=20))
    command("follow", text("name"), text("--depth", type=int, default=2), text("-k", type=int, default=20), flag("--history"))
    command("aggregate", text("predicate"), text("--source"), text("--target"), text("--limit", type=int, default=50), flag("--history"))
    command("overview", text("-k", type=int, default=5))
    command("invalidate", text("id"), text("--at"))
    command("forget", text("id"), flag("--hard"))
    command("merge", text("keep"), text("other"))
    command("alias", text("entity"), text("alias"))
    for name in ("stats", "validate", "serve"):
        command(name)
    command("sql", text("query"))
    command("export", text("path"), flag("--forgotten"))
    command("import", text("path"))
    command("import-legacy", text("path"))
    command("eval", text("fixture"), flag("--ablation"), text("--set", action="append", default=[], dest="settings"))
    return p


def run(engine: Engine, a: argparse.Namespace) -> object:
    """The result of a command, as rows or a dict."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if a.command == "remember":
        item = json.loads(sys.stdin.read() if a.input == "-" else a.input) if a.input else {}
        given = {k: getattr(a, k) for k in ("content", "kind", "tags", "importance", "scope", "source", "session", "valid_from", "valid_to", "supersedes")}
        return engine.remember(item | {k: v for k, v in given.items() if v is not None})
    if a.command == "recall":
        filters = {k: v for k in ("kinds", "tags", "scope", "source", "session") if (v := getattr(a, k))}
        return engine.recall(a.query, k=a.k, budget=min(a.budget, 20_000), as_of=a.as_of, history=a.history, **filters)
    if a.command == "entity":
        return engine.entity(a.name, a.limit)
    if a.command == "follow":
        return rows(engine.follow(a.name, a.depth, a.k, history=a.history))
    if a.command == "aggregate":
        return rows(engine.aggregate(a.predicate, a.source, a.target, a.limit, a.history))
    if a.command == "overview":
        return engine.overview(a.k)
    if a.command in ("stats", "validate"):
        return getattr(engine, a.command)()
    if a.command == "sql":
        return rows(engine.sql(a.query))
    if a.command == "import":
        return {"written": engine.load(list(exchange.inputs(exchange.read_jsonl(engine.spark, a.path))))}
    if a.command == "import-legacy":
        items = [{k: v for k, v in r.asDict().items() if v is not None} for r in exchange.read_legacy(engine.spark, a.path).collect()]
        return {"written": sum("id" in r for r in engine.remember_batch(items))}
    if a.command == "eval":
        _, memories, queries = evals.load(Path(a.fixture).read_text())
        ids = evals.ingest(engine, memories)
        variants = evals.ablation() if a.ablation else {"given": {k: v for s in a.settings for k, v in evals.setting(s).items()}}
        return evals.sweep(engine, queries, ids, variants)
    {
        "invalidate": lambda: engine.invalidate(a.id, a.at), "forget": lambda: engine.forget(a.id, a.hard), "merge": lambda: engine.merge(a.keep, a.other),
        "alias": lambda: engine.alias(a.entity, a.alias), "export": lambda: engine.export(a.path, a.forgotten), "serve": lambda: server.serve(engine, sys.stdin, sys.stdout),
    }[a.command]()
    return {"done": a.command}


def shown(command: str, out: object) -> str:
    if command == "remember":
        return render.change(out)
    if command == "recall":
        return "\n".join(render.memory(r) for r in out) or "nothing found"
    if command == "follow":
        return "\n".join(render.fact(r) for r in out)
    if command == "entity":
        return render.card(out)
    return render.table(out) if isinstance(out, dict) else json.dumps(out, ensure_ascii=False, default=str)


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(argv)
    if engine is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        engine = Engine(spark, a.store)
    try:
        out = run(engine, a)
    except Rejected as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2
    if a.command != "serve":
        print(json.dumps(out, ensure_ascii=False, default=str) if a.json else shown(a.command, out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
