"""python -m tessella.cli COMMAND ...: build, find, embed, symbols, neighbors, impact, delta, map, status, dossier, ask, check, verify, orchestrate, dead, serve."""

from __future__ import annotations

import argparse
import json
import sys

from tessella import constants as C
from tessella.operators import symbols
from tessella.plans.answer import Index
from tessella.plans.build import build_all
from tessella.server import serve
from tessella.session import build_session


def parser() -> argparse.ArgumentParser:
    """The command line."""
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("--index", default=".tessella")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--include", action="append")
    b.add_argument("--exclude", action="append")
    b.add_argument("--max-bytes", type=int, default=C.MAX_BYTES)
    b.add_argument("--max-files", type=int, default=C.MAX_SCAN_FILES)
    for name in ("find", "ask", "symbols", "neighbors", "impact", "dossier"):
        s = sub.add_parser(name)
        s.add_argument("what")
        s.add_argument("-k", type=int)
        s.add_argument("--depth", type=int)
        s.add_argument("--kind")
        s.add_argument("--budget", type=int)
    e = sub.add_parser("embed")
    e.add_argument("model", help="a JSON file of modelId, dim, vocab, weights")
    e.add_argument("--force", action="store_true")
    d = sub.add_parser("delta")
    d.add_argument("--base")
    d.add_argument("--staged", action="store_true")
    c = sub.add_parser("check")
    c.add_argument("--answer")
    c.add_argument("--prose", action="store_true")
    v = sub.add_parser("verify")
    v.add_argument("answer")
    v.add_argument("--apply", help="a JSON file of rows claim_id, citation, verdict, note, digest")
    for name in ("map", "status", "orchestrate", "dead", "serve"):
        sub.add_parser(name)
    return p


def run(argv: list[str], spark=None) -> int:
    """Runs a command, prints rows as JSON lines, and returns the exit code."""
    a = parser().parse_args(argv)
    spark = spark or build_session("tessella", "local[*]")
    x = Index(spark, a.index, a.root)

    def show(df) -> None:
        for r in df.toJSON().toLocalIterator() if hasattr(df, "toJSON") else [json.dumps(df)]:
            print(r)

    if a.command == "build":
        show(build_all(spark, a.root, a.index, include=a.include, exclude=a.exclude, max_bytes=a.max_bytes, max_files=a.max_files, out_dir=a.index))
    elif a.command == "find":
        show(x.find(a.what, a.k or C.TOP_K))
    elif a.command == "embed":
        show(x.embed(a.model, a.force))
    elif a.command == "ask":
        show(x.ask(a.what, a.k or C.ASK_K, a.budget))
    elif a.command == "symbols":
        show(x.lookup(a.what))
    elif a.command == "neighbors":
        show(x.neighbours(a.what, a.depth or 1, a.kind.split(",") if a.kind else None))
    elif a.command == "impact":
        show(x.impact(a.what, a.depth))
    elif a.command == "dossier":
        show(x.dossier(a.what))
    elif a.command == "delta":
        risk, problems = x.delta(a.base, a.staged)
        if not problems.isEmpty():
            show(problems)
            return 1
        show(risk)
    elif a.command == "check" and a.answer:
        rows = x.check_answer(open(a.answer).read())
        show(rows)
        return int(not rows.where("status = 'unresolved'").isEmpty() or rows.where("status <> 'ignored'").isEmpty())
    elif a.command == "check":
        got = x.check(a.prose)
        show(got)
        return int(not got["ok"])
    elif a.command == "verify" and a.apply:
        got = x.apply_verdicts(open(a.answer).read(), json.load(open(a.apply)))
        show(got)
        return int(not got["ok"])
    elif a.command == "verify":
        show(x.claims(open(a.answer).read()))
    elif a.command == "map":
        for name, df in x.map().items():
            print(json.dumps({"part": name}))
            show(df)
    elif a.command == "status":
        show(x.status())
    elif a.command == "orchestrate":
        show(x.work_batches())
    elif a.command == "serve":
        serve(x)
    elif a.command == "dead":
        show(symbols.dead(x.table("defs"), x.table("refs")))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
