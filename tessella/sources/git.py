"""Differences of a working tree as two small tables."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

_BASES = ("origin/HEAD", "origin/main", "origin/master", "main", "master")


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def base_ref(repo: str) -> str:
    """The first known base that exists, else HEAD."""
    for ref in _BASES:
        try:
            _git(repo, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")
            return ref
        except RuntimeError:
            continue
    return "HEAD"


def parse_hunks(diff: str) -> list[tuple[str, int, int]]:
    """(path, start, end) of the new side of every hunk of a diff without context."""
    out, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = line[6:].rstrip("\t") if line.startswith("+++ b/") else None
        elif path and (m := re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line)):
            start, n = int(m[1]), int(m[2] or 1)
            out.append((path, max(1, start), max(1, start + max(0, n - 1))))
    return out


def diff(spark: SparkSession, repo: str, base: str | None = None, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """diff_files (path, status, old_path, binary) and hunks (path, start, end) since the merge base, untracked files as added."""
    base = base or base_ref(repo)
    point = _git(repo, "merge-base", base, "HEAD").strip()
    how = ["--cached"] if staged else []
    rows, seen = [], set()
    binary = {x.split("\t")[2] for x in _git(repo, "diff", *how, "--numstat", point).splitlines() if x.startswith("-\t-\t")}
    names = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "added", "T": "modified"}
    for line in _git(repo, "diff", *how, "--name-status", "-M", point).splitlines():
        kind, *where = line.split("\t")
        path = where[-1]
        seen.add(path)
        rows.append((path, names.get(kind[0], "modified"), where[0] if kind[0] == "R" else None, path in binary))
    if not staged:
        rows += [(p, "added", None, False) for p in _git(repo, "ls-files", "--others", "--exclude-standard").splitlines() if p not in seen]
    hunks = parse_hunks(_git(repo, "diff", *how, "-U0", "-M", point))
    return (
        spark.createDataFrame(rows, "path string, status string, old_path string, binary boolean"),
        spark.createDataFrame(hunks, "path string, start bigint, end bigint"),
    )
