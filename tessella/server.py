"""The engine as tools over lines of JSON-RPC on standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO, Any

from tessella import constants as C
from tessella.plans.answer import Index

PROTOCOL, MOST_BYTES = "2025-06-18", 1_000_000

Number, Text = {"type": "integer"}, {"type": "string"}


def _rows(df) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


#: name: (what it does, arguments, those required, function)
TOOLS: dict[str, tuple[str, dict, list[str], Callable[[Index, dict], Any]]] = {
    "map": ("Parts of the index page", {}, [], lambda x, a: {k: _rows(v) for k, v in x.map().items()}),
    "find": ("Modules for a task", {"query": Text, "k": Number}, ["query"], lambda x, a: _rows(x.find(a["query"], a.get("k", C.TOP_K)))),
    "ask": ("Files to read for a question", {"query": Text, "k": Number, "budget": Number}, ["query"], lambda x, a: _rows(x.ask(a["query"], a.get("k", C.ASK_K), a.get("budget")))),
    "dossier": ("Evidence on a module", {"slug": Text}, ["slug"], lambda x, a: _rows(x.dossier(a["slug"]))),
    "symbols": ("Definitions and references of a name", {"query": Text}, ["query"], lambda x, a: _rows(x.lookup(a["query"]))),
    "neighbors": ("What is linked with a module or file", {"target": Text, "depth": Number, "kind": Text}, ["target"], lambda x, a: _rows(x.neighbours(a["target"], a.get("depth", 1), [a["kind"]] if "kind" in a else None))),
    "impact": ("What depends on a module or file", {"target": Text, "depth": Number}, ["target"], lambda x, a: _rows(x.impact(a["target"], a.get("depth")))),
    "delta": ("Risk of the changes since a base", {"base": Text}, [], lambda x, a: {k: _rows(v) for k, v in zip(("risk", "problems"), x.delta(a.get("base")))}),
    "status": ("Modules in the order of work", {}, [], lambda x, a: _rows(x.status())),
    "read": ("Lines of a file", {"path": Text, "start": Number, "end": Number}, ["path"], lambda x, a: x.read(a["path"], a.get("start", 1), a.get("end"))),
    "check": ("Whether the index, or an answer's citations, hold", {"answer": Text}, [], lambda x, a: _rows(x.check_answer(a["answer"])) if "answer" in a else x.check()),
    "verify": ("The claims of an answer to judge", {"answer": Text}, ["answer"], lambda x, a: _rows(x.claims(a["answer"]))),
}


def capped(text: str) -> str:
    """A response within its limit, or a note on what was withheld."""
    n = len(text.encode())
    return text if n <= MOST_BYTES else json.dumps({"withheld": True, "bytes": n, "limit": MOST_BYTES, "hint": "narrow the request"})


def problem(args: dict, known: dict, required: list[str]) -> str | None:
    """What is wrong with a call's arguments."""
    for name in required:
        if name not in args:
            return f"missing argument: {name}"
    for name, v in args.items():
        if name not in known:
            return f"unknown argument: {name}"
        if not (isinstance(v, int) and not isinstance(v, bool) if known[name] is Number else isinstance(v, str)):
            return f"{name} must be of type {known[name]['type']}"
    return None


def answer(x: Index, request: dict) -> dict | None:
    """The response to a request; None to a notification."""
    if "id" not in request:
        return None
    reply = lambda **k: {"jsonrpc": "2.0", "id": request["id"]} | k
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return reply(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessella", "version": "0.1"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r, _) in TOOLS.items()]})
    if method == "tools/call":
        if params.get("name") not in TOOLS:
            return reply(error={"code": -32602, "message": f"unknown tool: {params.get('name')}"})
        _, known, required, run = TOOLS[params["name"]]
        args = params.get("arguments") or {}
        if wrong := problem(args, known, required):
            return reply(error={"code": -32602, "message": wrong})
        try:
            text, bad = capped(json.dumps(run(x, args))), False
        except (KeyError, FileNotFoundError, RuntimeError) as e:
            text, bad = str(e), True
        return reply(result={"content": [{"type": "text", "text": text}], "isError": bad})
    return reply(error={"code": -32601, "message": f"unknown method: {method}"})


def serve(x: Index, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answers line after line; a line may hold a batch."""
    for line in source:
        if not line.strip():
            continue
        try:
            got = json.loads(line)
        except ValueError:
            out: Any = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            out = [r for q in got if (r := answer(x, q))] if isinstance(got, list) else answer(x, got)
        if out:
            sink.write(json.dumps(out) + "\n")
            sink.flush()
