"""Plain versions of the stages, over rows in memory."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import regex

from tessella.llm import decontaminate as D
from tessella.llm import mixing, neardup, toxicity
from tessella.llm.text import shingles, words


def hashes(text: str):
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))


def toxic(machine, text: str | None) -> tuple[float, bool]:
    """Probability and decision, pair by pair."""
    h, _ = hashes(text or "")
    cols = sorted({int(c) for c in machine.slot[toxicity._buckets(h)] if c >= 0})
    s = machine.w0 + sum(machine.w[c] for c in cols) + sum(machine.v[a] @ machine.v[b] for i, a in enumerate(cols) for b in cols[:i])
    p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    return p, len(h) > 0 and p >= toxicity.REJECT


def common_lines(rows: list[dict], most: int) -> list[dict]:
    norm = lambda x: re.sub("[ \t\r\f\v]+", " ", x.lower()).strip(" ")
    docs = defaultdict(set)
    for r in rows:
        for x in r["text"].split("\n"):
            if norm(x):
                docs[norm(x)].add(r["text"])
    out = []
    for r in rows:
        kept = [x for x in r["text"].split("\n") if len(docs.get(norm(x), ())) <= most]
        text = "\n".join(kept)
        out.append(r if len(kept) == r["text"].count("\n") + 1 else r | {"text": text, "n_chars": len(text)})
    return out


def near_groups(rows: list[dict]) -> dict[int, int]:
    """doc_id to the smallest of its group: all pairs that share a band and are alike."""
    sigs, root = {}, {r["doc_id"]: r["doc_id"] for r in rows}
    for r in rows:
        sh, b = shingles(*hashes(r["text"]), neardup.SHINGLE)
        if len(sh):
            sigs[r["doc_id"]] = neardup.signature_values(sh, b)[0]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sigs)
    all_ = np.array([sigs[i] for i in ids])
    for k, a in enumerate(ids):
        eq = all_[k + 1 :] == all_[k]
        band = eq.reshape(len(eq), all_.shape[1] // neardup.BAND_ROWS, neardup.BAND_ROWS).all(axis=2).any(axis=1)
        for j in np.flatnonzero(band & (eq.mean(axis=1) >= neardup.THRESHOLD)):
            x, y = sorted((find(a), find(ids[k + 1 + j])))
            root[y] = x
    return {i: find(i) for i in root}


def leaks(rows: list[dict], items: list[dict]) -> set[tuple[int, int, int]]:
    """(doc_id, item_id, edits) by the automaton over every whole text."""
    norm = lambda t: regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", t.lower()).strip(" ").encode()
    out = set()
    for it in items:
        x = norm(it["text"])
        if len(x) < 8:
            out |= {(r["doc_id"], it["item_id"], 0) for r in rows if x and b" " + x + b" " in b" " + norm(r["text"]) + b" "}
            continue
        peq, k = D.masks(x), D.budget(len(x))
        for r in rows:
            e = D.myers(peq, len(x), norm(r["text"]))
            if e <= k:
                out.add((r["doc_id"], it["item_id"], e))
    return out


def mixture(rows: list[dict]) -> list[tuple[int, float, int]]:
    """(doc_id, virtual finish, running tokens) in order."""
    import hashlib

    key = lambda r: hashlib.md5(f"{mixing.SEED}{r['doc_id']}".encode()).hexdigest()
    served, queue = defaultdict(int), []
    for r in sorted(rows, key=key):
        n = len(r["text"].split())
        served[r["source"]] += n
        queue.append((served[r["source"]] / mixing.WEIGHTS.get(r["source"], mixing.DEFAULT_WEIGHT), r["source"], key(r), r["doc_id"], n))
    budget, run, out = int(sum(q[4] for q in queue) * mixing.BUDGET_SHARE), 0, []
    for q in sorted(queue):
        run += q[4]
        if run > budget:
            break
        out.append((q[3], q[0], run))
    return out
