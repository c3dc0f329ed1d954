"""Near duplicates against exact Jaccard similarity and brute-force components."""

from __future__ import annotations

import random
import re

import numpy as np

from tessella.llm import neardup as N
from tessella.llm.text import shingles, words


def shingle_set(text: str) -> frozenset:
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def jaccard(a, b) -> float:
    return len(a & b) / len(a | b)


def corpus(n_groups=25, seed=3):
    """Groups of copies with a few words changed, and texts that stand alone."""
    rng = random.Random(seed)
    rows, k = [], 0
    for g in range(n_groups):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([20, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
            rows.append((k, " ".join(t)))
            k += 1
    return rows


def test_signature_estimates_jaccard_without_bias():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = a.copy()
        b[: rng.integers(10, 200)] = rng.integers(0, 2**63, 1)[0] + np.arange(1, dtype=np.uint64)
        b = np.unique(b)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = [N.signature_values(x, np.array([0, len(x)]))[0] for x in (a, b)]
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_word_hashes_are_those_of_the_words_wherever_they_stand():
    texts = ["Alpha, beta gamma", "gamma ALPHA", "", "beta"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    h, b = words(raw, off)
    assert np.diff(b).tolist() == [3, 2, 0, 1]
    assert h[0] == h[4] and h[2] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 3
    assert shingles(h, b, 3)[1].tolist() == [0, 1, 2, 2, 3]


def test_recall_and_precision_of_pairs_against_brute_force(spark, make_docs):
    rows = corpus()
    got = {r["doc_id"]: r["group_id"] for r in N.near_duplicates(make_docs(rows)).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    true = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.5]
    far = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) < 0.2]
    assert len(true) > 50
    assert sum(got[a] == got[b] for a, b in true) >= 0.9 * len(true)
    assert sum(got[a] == got[b] for a, b in far) == 0


def test_groups_are_components_of_all_candidate_pairs(spark):
    """Against all pairs of every bucket, for nodes whose buckets hold unlike ones too."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**16, (6, 2 * N.PERMUTATIONS), dtype=np.uint16)
    sigs = []
    for b in base:
        for _ in range(7):
            s = b.copy()
            other = base[rng.integers(0, 6)]
            cut = 4 * rng.integers(0, N.PERMUTATIONS // 2 + 1)
            s[:cut] = other[:cut]
            sigs.append(s)
    nodes = spark.createDataFrame([(i + 1, s.tobytes()) for i, s in enumerate(sigs)], "node bigint, sig binary")
    ways = [{r["node"]: r["root"] for r in N.groups(N.durable(nodes), 0.5, block, bits).collect()} for block, bits in ((N.BLOCK, 20), (3, 0))]
    root = list(range(len(sigs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sigs)):
        for j in range(i):
            band = (sigs[i].reshape(-1, 4) == sigs[j].reshape(-1, 4)).all(axis=1).any()
            if band and (sigs[i] == sigs[j]).mean() >= 0.5:
                root[find(i)] = find(j)
    want = {i + 1: find(i) for i in range(len(sigs))}
    same = lambda m, a, b: m.get(a, a) == m.get(b, b)
    for got in ways:
        assert all(same(got, a, b) == (want[a] == want[b]) for a in want for b in want)


def test_forest_links_what_all_pairs_link():
    rng = np.random.default_rng(3)
    for k in range(30):
        x = rng.integers(0, 3, (20, 8)).astype(np.uint16)
        root, block = rng.integers(0, 12, 20), (rng.integers(0, 2, 20) if k % 2 else np.zeros(20, int))
        pairs = [(i, j) for i in range(20) for j in range(i) if (x[i] == x[j]).mean() >= 0.5 and root[i] != root[j] and (len(set(block)) == 1 or block[i] != block[j])]

        def parts(links):
            up = {int(r): int(r) for r in root}
            for _ in up:
                for a, b in links:
                    up[a] = up[b] = min(up[a], up[b])
            return up

        got = N._forest(root.tolist(), block.tolist(), x, 0.5)
        assert parts(got) == parts([(int(root[i]), int(root[j])) for i, j in pairs])


def test_hot_rows_and_a_full_filter(spark, make_docs, monkeypatch):
    """A third of all rows one text, many of them one row; with and without room in the filter, hot keys split."""
    from tessella.operators import sieve

    rows = corpus(12, seed=9)
    same = " ".join(f"s{i}" for i in range(50))
    rows += [(1000, same)] * 30 + [(1001 + i, same) for i in range(40)]
    df = make_docs(rows)
    want = sorted((r["doc_id"], r["group_id"], r["keep"]) for r in N.near_duplicates(df).collect())
    assert len(want) == len(rows) and sum(k for d, _, k in want if d == 1000) == 1 and {g for d, g, _ in want if d >= 1000} == {1000}
    monkeypatch.setattr(sieve.join_split, "__defaults__", ("n", "inner", 20))
    for bits in (0, 20):
        assert sorted((r["doc_id"], r["group_id"], r["keep"]) for r in N.near_duplicates(df, 0.5, 4, bits).collect()) == want
        assert sorted(r["doc_id"] for r in N.drop_near_duplicates(df, 0.5, 4, bits).collect()) == [d for d, _, k in want if k]


def test_of_rows_that_differ_elsewhere_the_first_as_json_stays(spark):
    df = spark.createDataFrame([(1, "a b c d", "z"), (1, "a b c d", "k"), (2, "other words here now", "m")], "doc_id bigint, text string, `a.b` string")
    assert sorted(map(tuple, N.drop_near_duplicates(df).collect())) == [(1, "a b c d", "k"), (2, "other words here now", "m")]


def test_signatures_of_one_number_stay_apart(spark, make_docs, monkeypatch):
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(6)]
    real = N.F.xxhash64
    monkeypatch.setattr(N.F, "xxhash64", lambda *c: N.F.lit(5).cast("long") if c == ("sig",) else real(*c))
    assert sorted((r["doc_id"], r["group_id"]) for r in N.near_duplicates(make_docs(rows[:2])).collect()) == [(0, 0), (1, 1)]


def test_awkward_rows(spark, awkward, empty):
    rows = N.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    keep = [(r["doc_id"], r["group_id"]) for r in rows if r["keep"]]
    assert sorted(keep, key=str) == sorted([(1, 1), (None, None), (None, None), (2, 2), (3, 3), (4, 4), (11, 11), (5, 5), (7, 7), (9, 9), (12, 12), (13, 13)], key=str)
    left = N.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([k for k, _ in keep], key=str)
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0
