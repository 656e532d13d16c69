"""A JSON-RPC server over lines of text: the engine's operations as tools."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from palimpsest.engine import Engine
from palimpsest.ledger import Rejected

MOST_BYTES = 16 << 20
VERSION = "2024-11-05"


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


#: name -> (what it does, its arguments and their JSON types, the required ones, the call)
TOOLS: dict[str, tuple[str, dict[str, str], tuple[str, ...], Callable[[Engine, dict], object]]] = {
    "remember": ("write a memory", {"content": "string", "kind": "string", "tags": "array", "entities": "array", "relations": "array", "valid_from": "string", "valid_to": "string", "supersedes": "array", "importance": "number", "scope": "string", "source": "string", "session": "string"}, ("content",), lambda e, a: e.remember(a)),
    "recall": ("find memories", {"query": "string", "k": "integer", "budget": "integer", "as_of": "string", "history": "boolean", "kinds": "array", "tags": "array", "scope": "string", "source": "string", "session": "string"}, ("query",), lambda e, a: e.recall(**a)),
    "entity": ("show an entity", {"name": "string", "limit": "integer"}, ("name",), lambda e, a: e.entity(**a)),
    "follow": ("facts around an entity", {"name": "string", "depth": "integer", "k": "integer", "history": "boolean"}, ("name",), lambda e, a: _rows(e.follow(**a))),
    "aggregate": ("distinct ends of a predicate", {"predicate": "string", "source": "string", "target": "string", "limit": "integer", "history": "boolean"}, ("predicate",), lambda e, a: _rows(e.aggregate(**a))),
    "overview": ("communities", {"k": "integer"}, (), lambda e, a: e.overview(**a)),
    "invalidate": ("end a memory or relation", {"which": "string", "at": "string"}, ("which",), lambda e, a: e.invalidate(**a)),
    "forget": ("forget a memory", {"which": "string", "hard": "boolean"}, ("which",), lambda e, a: e.forget(**a)),
    "merge": ("two names are one entity", {"keep": "string", "other": "string"}, ("keep", "other"), lambda e, a: e.merge(**a)),
    "alias": ("another name of an entity", {"entity": "string", "alias": "string"}, ("entity", "alias"), lambda e, a: e.alias(**a)),
    "stats": ("row counts", {}, (), lambda e, a: e.stats()),
}
_KINDS = {"string": (str, int), "integer": int, "number": (int, float), "boolean": bool, "array": list}


def listed() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": list(r)}} for n, (d, p, r, _) in TOOLS.items()]


def call(engine: Engine, name: str, arguments: dict) -> dict:
    """A tool's result, or its refusal, as content."""
    try:
        if name not in TOOLS:
            raise Rejected(f"no such tool: {name}")
        _, known, required, f = TOOLS[name]
        for k, v in arguments.items():
            if k not in known or not isinstance(v, _KINDS[known[k]]):
                raise Rejected(f"bad argument: {k}")
        for k in required:
            if k not in arguments:
                raise Rejected(f"missing argument: {k}")
        out, bad = f(engine, arguments), False
    except Rejected as e:
        out, bad = str(e), True
    return {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str)}], "isError": bad}


def answer(engine: Engine, line: str) -> dict | None:
    """The response to one line; none to a notification."""
    try:
        request = json.loads(line)
        method, number = request["method"], request.get("id")
    except (ValueError, KeyError, TypeError):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a request"}}
    if number is None:
        return None
    parameters = request.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "palimpsest", "version": "0.1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": listed()}
    elif method == "tools/call":
        result = call(engine, parameters.get("name", ""), parameters.get("arguments") or {})
    else:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no such method: {method}"}}
    return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(engine: Engine, source: TextIO, sink: TextIO) -> None:
    """Answer requests until the end of the input. A line over MOST_BYTES is refused unread."""
    while line := source.readline(MOST_BYTES):
        if not line.endswith("\n") and len(line) >= MOST_BYTES:
            while (rest := source.readline(MOST_BYTES)) and not rest.endswith("\n"):
                pass
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "too long"}}
        elif not line.strip():
            continue
        else:
            out = answer(engine, line)
        if out is not None:
            sink.write(json.dumps(out, ensure_ascii=False, default=str) + "\n")
            sink.flush()
