"""Language, toxicity and mixing."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np

from tessella.llm import language as L
from tessella.llm import mixing as M
from tessella.llm import toxicity as X

from .conftest import words


def ppm_counts(train: list[bytes], order: int) -> dict[bytes, tuple[Counter, int, int]]:
    """For each context the bytes seen after it, how many and how many distinct."""
    counts = defaultdict(Counter)
    for t in train:
        for i, c in enumerate(t):
            for k in range(min(order, i) + 1):
                counts[t[i - k : i]][c] += 1
    return {k: (v, sum(v.values()), len(v)) for k, v in counts.items()}


def ppm_bits(counts: dict[bytes, tuple[Counter, int, int]], text: bytes, order: int) -> float:
    """Code length by dictionaries of contexts: method C, longest known context first."""
    bits = 0.0
    for i, c in enumerate(text):
        for k in range(min(order, i), -1, -1):
            known = counts.get(text[i - k : i])
            if not known:
                continue
            ctx, n, q = known
            if c in ctx:
                bits -= math.log2(ctx[c] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_a_plain_context_tree():
    train = {"a": [b"abracadabra abra", b"cab bac"], "b": [b"zyx zyx zzz", b"abba zyx"]}
    model = L.train(train)
    texts = [b"abra", b"zyx zyx", b"qqq~", b"", b"cadabra zz", b"a" * 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    got = model.code_lengths(data, off) / L.UNIT
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert abs(got[i, j] - ppm_bits(ppm_counts(train[lang], L.ORDER), t, L.ORDER)) <= 0.5 / L.UNIT * len(t) + 1e-9, (t, lang)


def test_dear_bytes_cost_their_whole_length():
    """A byte unseen after long runs costs more than 32 bits."""
    train = {"a": [b"a" * 1_000_000 + b"b"], "b": [b"b"]}
    model = L.train(train)
    text = b"aaaaz"
    bits = ppm_bits(ppm_counts(train["a"], L.ORDER), text, L.ORDER)
    got = model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0] / L.UNIT
    assert bits > 70 and abs(got - bits) < 0.5 / L.UNIT * len(text)


def test_a_text_longer_than_a_piece_costs_the_same():
    model = L.train({"a": [b"the quick brown fox "], "b": [b"lorem ipsum dolor "]})
    t = (b"the quick lorem fox ipsum " * 30_000)[: (1 << 18) + 12345]
    one = model.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
    row, out = t, np.zeros(2, np.int64)
    a = model.cost.shape[1]
    x = model.rank[np.frombuffer(row, np.uint8)].astype(np.int64)
    p = [np.concatenate([np.zeros(d, np.int64), x[:-d]]) for d in (1, 2, 3)]
    out = model.cost[model.row_of[(p[2] * a + p[1]) * a + p[0]], x].astype(np.int64).sum(axis=0)
    assert one.tolist() == out.tolist()


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.where("pmod(hash(doc_id), 3) > 0"), 100)
    held = docs.where("pmod(hash(doc_id), 3) = 0")
    rows = L.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r["language"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_training_texts_are_bounded_however_often_an_id_is_repeated(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda texts: seen.append({k: len(v) for k, v in texts.items()}))
    L.fit(make_docs([(1, f"text {i}") for i in range(200)] + [(2, "other")] * 3), 20)
    assert seen == [{"en": 20}]


def test_language_on_awkward_rows(spark, awkward, empty):
    model = L.train({"en": [b"the end of one"], "fr": [b"la fin de une"]})
    rows = L.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["language"] is None and by[1]["code_bits"] is None
    assert by[2]["language"] is None and by[2]["code_bits"] == 0
    assert by[11]["language"] in ("en", "fr") and by[5]["code_bits"] > 0
    tie = L.train({"b": [b"same"], "a": [b"same"]})
    assert {r["language"] for r in L.identify(awkward, tie).where("doc_id = 9").collect()} == {"a"}
    assert L.identify(empty, model).count() == 0 and L.fit(empty) is None
    assert {r["language"] for r in L.identify(awkward, None).collect()} == {None}


def test_machine_learns_a_pair_that_single_words_do_not_tell():
    """Toxic if and only if an insult and a group occur together, each as common alone."""
    rng = random.Random(3)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted(set([1] * a + [2] * b + [rng.randrange(3, 50) for _ in range(5)])), np.int32))
        y.append(float(a and b))
    y = np.array(y)
    m = X.train(rows, y)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = m.slot[np.concatenate(rows)]
    s = m.scores(doc[col >= 0], col[col >= 0], len(rows))
    assert ((s > 0) == (y > 0)).mean() > 0.99
    brute = [m.w0 + m.w[c].sum() + sum(m.v[c[i]] @ m.v[c[j]] for i in range(len(c)) for j in range(i)) for c in ([k for k in m.slot[r] if k >= 0] for r in rows[:50])]
    assert np.allclose(brute, s[:50])


def test_machine_learns_words_that_are_balanced_alone():
    """Toxic if and only if exactly one of two words occurs."""
    rng = random.Random(4)

    def rows(n):
        out, y = [], []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            out.append(np.array(sorted(set([1] * a + [2] * b + [rng.randrange(3, 500) for _ in range(20)])), np.int32))
            y.append(float(a != b))
        return out, np.array(y)

    m = X.train(*rows(3000))
    assert set(np.flatnonzero(m.slot >= 0)) == {1, 2}
    got, y = rows(500)
    cols = [[k for k in m.slot[r] if k >= 0] for r in got]
    s = np.array([m.w0 + m.w[c].sum() + sum(m.v[c[i]] @ m.v[c[j]] for i in range(len(c)) for j in range(i)) for c in cols])
    assert ((s > 0) == (y > 0)).mean() > 0.99


def test_pair_search_in_blocks_finds_what_all_pairs_give():
    rng = np.random.default_rng(1)
    terms = [np.flatnonzero(rng.random(60) < 0.5).astype(np.int32) for _ in range(800)]
    y = np.array([float((3 in t) != (41 in t)) for t in terms])
    p = np.full(len(y), y.mean())
    sample, cols = X._Sample(terms), np.arange(60)
    found = sample.telling_pairs(cols, y, p, 6.5, block=7)
    x = sample.dense(cols)
    z = np.abs((x * (y - p)[:, None]).T @ x) / np.sqrt((x * (p * (1 - p))[:, None]).T @ x)
    np.fill_diagonal(z, 0)
    assert set(found) == set(np.nonzero(z > 6.5)[0]) >= {3, 41}


def test_training_rows_are_bounded_however_often_an_id_is_repeated(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "train", lambda terms, y: seen.append(np.bincount(y.astype(int)).tolist()))
    docs = make_docs([(1, f"bad {i}") for i in range(300)] + [(2, f"good {i}") for i in range(300)])
    X.fit(docs, spark.createDataFrame([(1, 1)] * 50 + [(2, 0)] * 50, "doc_id bigint, toxic int"), toxic=20, clean=30)
    assert seen == [[30, 20]]


def test_texts_without_a_word_are_never_rejected(spark, make_docs):
    slot = np.full(1 << X.BITS, -1, np.int32)
    always = X.Machine(slot, 5.0, np.zeros(1), np.zeros((1, 4)))
    docs = make_docs([(1, None), (2, ""), (3, "   "), (4, "!?"), (5, "word")])
    assert {r["doc_id"] for r in X.score_toxicity(docs, always).where("rejected").collect()} == {5}
    assert {r["doc_id"] for r in X.drop_toxic(docs, always).collect()} == {1, 2, 3, 4}


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = X.fit(docs, labels.where("pmod(hash(doc_id), 3) > 0"))
    held = labels.where("pmod(hash(doc_id), 3) = 0")
    rows = X.score_toxicity(docs, m).join(held, "doc_id").select("toxic", "rejected").collect()
    toxic, clean = [r["rejected"] for r in rows if r["toxic"] == 1], [r["rejected"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) > 0.78 and np.mean(clean) < 0.005


def test_toxicity_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(7, 1), (8, 0), (5, None), (None, 1), (99, 1), (6, 1)], "doc_id bigint, toxic int")
    m = X.fit(awkward, labels)
    rows = X.score_toxicity(awkward, m).collect()
    assert len(rows) == awkward.count() and not any(r["rejected"] for r in rows if r["doc_id"] in (1, 2))
    left = X.drop_toxic(awkward, m)
    assert left.columns == awkward.columns and left.count() == sum(not r["rejected"] for r in rows)
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    assert X.drop_toxic(empty, m).count() == 0
    none = X.fit(awkward, labels.where("toxic = 0"))
    assert X.drop_toxic(awkward, none).count() == awkward.count()
    assert X.drop_toxic(awkward, X.fit(empty, labels)).count() == awkward.count()


def brute_mix(rows, weights, share, seed="s"):
    import hashlib

    served, out = defaultdict(int), []
    for d, t, src in sorted(rows, key=lambda r: (hashlib.md5((seed + ("" if r[0] is None else str(r[0]))).encode()).hexdigest(), r[0] or 0)):
        n = len((t or "").split())
        w = weights.get(src, 1.0)
        if w > 0:
            served[src] += n
            out.append((served[src] / w, src or "", hashlib.md5((seed + ("" if d is None else str(d))).encode()).hexdigest(), d, n))
    budget, run, kept = int(sum(x[4] for x in out) * share), 0, []
    for x in sorted(out, key=lambda x: x[:3]):
        run += x[4]
        if run > budget:
            break
        kept.append((x[3], x[0], run))
    return kept


def test_mixture_against_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    weights = {"a": 3.0, "b": 0.5, "c": 0.0}
    want = brute_mix(rows, weights, 0.6)
    for size in (20_000, 7):
        monkeypatch.setattr(M, "RANGE_ROWS", size)
        got = [(r["doc_id"], r["virtual_finish"], r["running_tokens"]) for r in M.mix_sources(make_docs(rows), weights, 0.6, "s").collect()]
        assert got == want
    for bits in (20, 0):
        out = M.mixed_documents(make_docs(rows), weights=weights, budget_share=0.6, seed="s", most_bits=bits).collect()
        assert [r["doc_id"] for r in out] == [x[0] for x in want] and out[0]["key"] == "x"


def test_ranges_are_even_however_the_keys_are_spread(spark, make_docs, monkeypatch):
    """Nine sources end early, one runs on, and a third of all rows is one row repeated."""
    monkeypatch.setattr(M, "RANGE_ROWS", 100)
    rows = [(i, "w " * 3, f"s{i % 9}") for i in range(900)] + [(10_000 + i, "w " * 500, "long") for i in range(100)] + [(5000, "x", "s7")] * 500
    df, seen = make_docs(rows), []
    real = M._ranges
    monkeypatch.setattr(M, "_ranges", lambda *a: seen.append(real(*a)) or seen[-1])
    got = [(r["virtual_finish"], r["running_tokens"]) for r in M.mix_sources(df, {}, 1.0, "s").collect()]
    assert got == [x[1:] for x in brute_mix(rows, {}, 1.0)]
    for cut in seen:
        assert max(r["count"] for r in cut.groupBy("range").count().collect()) < 300


def test_shares_follow_the_weights_until_a_source_ends(spark, make_docs):
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(2000)]
    out = M.mix_sources(make_docs(rows), {"a": 3.0, "b": 1.0}, 0.4, "s").groupBy("source").sum("n_tokens").collect()
    n = {r[0]: r[1] for r in out}
    assert abs(n["a"] / n["b"] - 3) < 0.05


def test_mixture_on_awkward_rows(spark, awkward, empty):
    all_ = M.mix_sources(awkward, {}, 1.0, "s").collect()
    assert len(all_) == awkward.count()
    assert sum(r["n_tokens"] for r in all_) == all_[-1]["running_tokens"]
    docs = M.mixed_documents(awkward, weights={}, budget_share=1.0, seed="s")
    assert docs.count() == awkward.count() and docs.columns == [c for c in awkward.columns if c != "virtual_finish"] + ["virtual_finish", "running_tokens"]
    assert M.mix_sources(awkward, {"src0": 0.0}, 1.0, "s").count() == 0
    assert M.mix_sources(empty, {}, 1.0, "s").count() == 0 and M.mixed_documents(empty).count() == 0


def test_repeated_rows_at_the_cut_are_taken_in_part(spark, make_docs):
    df = make_docs([(1, "a b", "s")] * 5)
    assert M.mix_sources(df, {}, 0.5, "s").count() == 2
    assert M.mixed_documents(df, weights={}, budget_share=0.5, seed="s").count() == 2
    other = spark.createDataFrame([(1, "a b", "s", x) for x in "edcba"], "doc_id bigint, text string, source string, other string")
    assert {r["other"] for r in M.mixed_documents(other, weights={}, budget_share=0.5, seed="s").collect()} == {"a", "b"}
