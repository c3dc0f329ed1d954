"""Exact copies and repeated lines."""

from __future__ import annotations

import random
from collections import defaultdict

from tessella.llm import exact, lines

from .conftest import words


def brute_copies(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None:
            first.setdefault(t, d)
    return sorted(((d, first[t] if t is not None else d) for d, t in rows), key=str)


def test_exact_against_brute_force_with_tiny_buckets(spark, make_docs):
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(1, 50)) for _ in range(40)]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    for limits in ((), (100, 200, 7, 0), (100, 10_000, 1000, 20)):
        got = exact.exact_duplicates(make_docs(rows), *limits).collect()
        assert sorted(((r["doc_id"], r["group_id"]) for r in got), key=str) == brute_copies(rows)
        assert sum(r["keep"] for r in got) == len({t for _, t in rows})


def test_unlike_contents_of_one_hash_stay_apart(spark, make_docs, monkeypatch):
    """All texts under one hash, and a third of the rows one text in many blocks."""
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 20}") for i in range(120)]
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: exact.F.lit(7).cast("long"))
    got = exact.exact_duplicates(make_docs(rows), 100, 50, 5).collect()
    assert sorted(((r["doc_id"], r["group_id"]) for r in got), key=str) == brute_copies(rows)
    assert sum(r["keep"] for r in got) == len({t for _, t in rows})


def test_bucket_plan_splits_until_buckets_fit(spark):
    keys = spark.createDataFrame([(i * 0x123456789ABCDEF % (1 << 63), 10) for i in range(500)], "h bigint, n_bytes bigint")
    rows = exact.bucket_plan(keys, limit=100, bits=3).collect()
    load = defaultdict(int)
    for r in rows:
        load[r["bucket"]] += 10
    assert len(rows) == 500 and max(load.values()) <= 100


def test_open_table_tells_equal_hashes_apart():
    t = exact.OpenTable(bits=2)
    assert t.find(5, b"a") == (0, True) and t.find(5, b"b") == (1, True) and t.find(5, b"a") == (0, False)
    for i in range(100):
        assert t.find(i % 7, str(i).encode()) == (i + 2, True)
    assert t.find(6, b"97") == (99, False)


def test_exact_on_awkward_rows(spark, awkward, empty):
    got = exact.exact_duplicates(awkward).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["group_id"]) for r in got), key=str) == brute_copies(rows)
    assert sum(r["keep"] for r in got) == 3 + len({t for _, t in rows if t is not None})
    assert exact.exact_duplicates(empty).count() == 0


def brute_lines(rows, most, copies_once=False):
    docs = defaultdict(set)
    norm = lambda x: " ".join(x.lower().split())
    for d, t in rows:
        for x in (t or "").split("\n"):
            if norm(x):
                docs[norm(x)].add(t if copies_once or d is None else d)
    return [(d, t if t is None else "\n".join(x for x in t.split("\n") if len(docs.get(norm(x), ())) <= most)) for d, t in rows]


def test_lines_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    pool = [words(rng, 5) for _ in range(30)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(0, 12)))) for i in range(80)]
    rows += rows[:20] + [(None, t) for _, t in rows[:3]] * 2 + [(200 + i, rows[5][1]) for i in range(9)]
    df = make_docs(rows)
    for most, once, bits in ((3, False, 20), (10, False, 0), (3, True, 0), (10, True, 20)):
        out = lines.drop_common_lines(df, most, once, bits)
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(brute_lines(rows, most, once), key=str)
        assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_hot_lines_and_hot_texts(spark, make_docs, monkeypatch):
    """A line in every document, a text in a third of all rows; both take the way of hot keys."""
    from tessella.operators import sieve

    monkeypatch.setattr(sieve.join_split, "__defaults__", ("n", "inner", 40))
    rows = [(i, f"Every document\nown {i}" if i % 3 else "every  document\nsame") for i in range(300)]
    got = lines.drop_common_lines(make_docs(rows), 10, True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((i, f"own {i}" if i % 3 else "same") for i, _ in rows)


def test_lines_on_awkward_rows(spark, awkward, empty, make_docs):
    assert sorted(map(str, lines.drop_common_lines(awkward).select("doc_id", "text").collect())) == sorted(map(str, awkward.select("doc_id", "text").collect()))
    assert lines.drop_common_lines(empty).count() == 0
    copies = make_docs([(i, "shared\nown") for i in range(30)])
    assert {r["text"] for r in lines.drop_common_lines(copies, copies_once=True).collect()} == {"shared\nown"}
    assert {r["text"] for r in lines.drop_common_lines(copies).collect()} == {""}
    gone = [(i, f"Shared  line\nown {i}") for i in range(12)] + [(99, "shared line")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_common_lines(make_docs(gone)).collect()}
    assert got[99] == "" and got[0] == "own 0"
