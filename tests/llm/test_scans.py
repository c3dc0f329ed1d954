"""Secrets, fixity, tokens, benchmark passages."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest
import tiktoken

from tessella.llm import decontaminate as D
from tessella.llm import secrets as S
from tessella.llm import tokens as T
from tessella.llm import warc as W
from tessella.llm.text import normal_bytes

from .conftest import words

PROSE = "the over lying internationalization misunderstanding counterrevolutionary abcdefghijklmnopqrst and incomprehensibilities "


def secret_corpus():
    rng = random.Random(11)
    rows, planted = [], set()
    for i in range(200):
        text = " ".join(rng.choice(PROSE.split()) for _ in range(60))
        if i % 5 == 0:
            s = {
                0: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
                1: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)),
                2: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)),
            }[i // 5 % 3]
            planted.add((i, len(s)))
            text += f"\ntoken = {s} and more"
        rows.append((i, text))
    return rows, planted


def brute_secrets(rows):
    """The same procedure without Spark: whole table in memory, exact Benjamini-Hochberg on steps."""
    freq = np.zeros(256, np.int64)
    for _, t in rows:
        freq += np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)
    found = []
    for d, t in rows:
        for m in re.findall(f"[A-Za-z0-9+/_-]{{{S.MIN_LENGTH},}}", t or ""):
            e = S.infer(m)
            f = np.array([freq[ord(c)] for c in S.ALPHABETS[e]], float)
            found.append((d, m, *S.battery(m, e, S.text_model(f)), len(m) * np.log2(len(S.ALPHABETS[e]))))
    mean = np.mean([x[-1] for x in found])
    steps = np.array([max(-100_000, np.ceil((x[5] - np.log10(x[6] / mean)) * 100)) for x in found])
    ok = [s for s in steps if 10 ** (s / 100) <= (steps <= s).sum() / len(steps) * S.FDR]
    cut = max(ok, default=-np.inf)
    return sorted((x[0], len(x[1])) for x, s in zip(found, steps) if s <= cut and min(x[2:5]) >= S.BATTERY_LEVEL / 3)


def test_secrets_against_brute_force_and_planted(spark, make_docs):
    rows, planted = secret_corpus()
    got = sorted((r["doc_id"], r["length"]) for r in S.find_secrets(make_docs(rows)).collect())
    assert got == brute_secrets(rows)
    assert len(planted & set(got)) >= 0.9 * len(planted) and len(set(got) - planted) <= 1


def test_secrets_that_touch_words(spark, make_docs):
    """Keys joined to words by signs of other alphabets are found, each once and without the word."""
    import hashlib

    rng = random.Random(12)
    rows, _ = secret_corpus()
    planted = set()
    for i, (before, after, n) in enumerate([("key_", "", 40), ("api-key-", "", 32), ("v1/", "", 32), ("", "-us21", 32), ("a+", "/b_c", 40)] * 10, 1000):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(n))
        planted.add((i, hashlib.sha256(key.encode()).hexdigest()))
        rows.append((i, f"token = {before}{key}{after} and more"))
    got = [(r["doc_id"], r["secret_sha256"]) for r in S.find_secrets(make_docs(rows)).collect() if r["doc_id"] >= 1000]
    assert len(planted & set(got)) >= 0.9 * len(planted) and len(got) == len(set(got))
    assert [S.parts(x, 4) for x in ("ab12-cd34", "key_ab12", "QRST+ab12")] == [[(0, 4), (0, 9), (5, 9)], [(0, 8), (4, 8)], [(0, 4), (0, 9), (5, 9)]]


def test_secrets_of_one_case(spark, sf, make_docs):
    """Long keys of digits and letters of one case are even over their own 36 signs."""
    rng = random.Random(13)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = 1000
    for signs in (string.ascii_lowercase, string.ascii_uppercase):
        for length in (32, 40, 64) * 8:
            rows.append((n, f"token = {''.join(rng.choice(string.digits + signs) for _ in range(length))} and more"))
            n += 1
    got = [(r["doc_id"], r["length"]) for r in S.find_secrets(make_docs(rows)).collect() if r["doc_id"] >= 1000]
    for first in (1000, 1024):
        want = {(first + i, length) for i, length in enumerate((32, 40, 64) * 8)}
        assert len(want & set(got)) >= 0.9 * len(want)
    assert len(got) == len({x[0] for x in got})


def test_tests_of_the_battery_keep_their_level():
    """Strings drawn evenly get small p-values as seldom as they should, down to the shortest."""
    rng = np.random.default_rng(2)
    for enc in ("hex", "base32", "base62"):
        signs = np.array(list(S.ALPHABETS[enc]))
        model = S.text_model(np.ones(len(signs)))
        for n in (16, 24, 64):
            p = np.array([S.battery("".join(t), enc, model)[:3] for t in rng.choice(signs, (4000, n))])
            assert ((p <= 0.05).mean(axis=0) < 0.075).all() and ((p <= S.BATTERY_LEVEL / 3).mean(axis=0) < 0.004).all()
            assert (np.median(p, axis=0) > 0.3).all()


def test_battery_sees_structure():
    even = S.text_model(np.ones(16))
    rng = random.Random(1)
    p = np.array([S.battery("".join(rng.choice("0123456789abcdef") for _ in range(64)), "hex", even)[:3] for _ in range(300)])
    assert ((p < 0.05).mean(axis=0) < 0.11).all() and ((p < 0.05).mean(axis=0) > 0.005).all()
    assert S.battery("a" * 40, "hex", even)[0] < 1e-6
    assert S.battery("0f" * 32, "hex", even)[1] < 1e-6
    assert S.battery("0123456789abcdef" * 4, "hex", even)[2] < 1e-4
    assert [S.infer(x) for x in ("123", "12af", "12AF", "ABZ2", "aZ9", "a+Z", "a_Z", "a_+")] == ["decimal", "hex", "HEX", "base32", "base62", "base64", "base64url", "base64"]


def test_secrets_on_awkward_rows(spark, awkward, empty, make_docs):
    assert S.find_secrets(awkward).count() == 0 and S.find_secrets(empty).count() == 0
    rows, _ = secret_corpus()
    one = brute_secrets(rows)
    twice = [(r["doc_id"], r["length"]) for r in S.find_secrets(make_docs(rows + [rows[0], (None, None), (None, rows[0][1]), (500, "q7Zx" * 50_000)])).collect()]
    assert twice.count(one[0]) == 2 and (None, one[0][1]) in twice


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 9)) for i in range(9000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_audit_finds_each_fault_and_descends_only_there(spark, pages):
    from pyspark.sql import functions as F

    other = pages.where("page_id <> 777").withColumn("html", F.when(F.col("page_id") == 5000, "changed").otherwise(F.col("html")))
    other = other.unionByName(spark.createDataFrame([(20_000, "new", "page")], pages.schema))
    got = {(r["page_id"], r["status"]) for r in W.audit(pages, other).collect()}
    assert got == {(777, "missing"), (5000, "corrupt"), (20_000, "extra")}
    a, b = W.trees(*(W.leaves_of(W.manifest(t)) for t in (pages, other)))
    assert {r["node"] for r in W.differing_leaves(a, b).collect()} == {777 // 64, 5000 // 64, 20_000 // 64}
    assert a[-1].count() == 1 and a[-1].collect() != b[-1].collect()
    assert W.audit(pages, pages).count() == 0


def test_offsets_are_those_of_the_file(spark, pages):
    rows = sorted((r["file"], r["offset"], r["length"]) for r in W.manifest(pages.limit(300)).collect())
    at = {}
    for f, o, n in rows:
        assert o == at.get(f, 0)
        at[f] = o + n


def test_leaves_and_nodes_are_hashes_of_ordered_offsets(spark, pages):
    """Against a tree made by hand: 9000 pages are 141 leaves, 3 nodes, one root."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    def record(i, url, html):
        n = len(html)
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n{html}\r\n\r\n"

    level = {}
    for leaf in range(141):
        at, lines = 0, []
        for i in range(leaf * 64, min(9000, leaf * 64 + 64)):
            r = record(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 9))
            lines.append(f"{at}:{len(r)}:1:{sha(r)}")
            at += len(r)
        level[leaf] = (at, sha(f"0:{at}:{sha(','.join(lines))}"))
    tree, _ = W.trees(*[W.leaves_of(W.manifest(pages))] * 2)
    assert {r["node"]: (r["length"], r["digest"]) for r in tree[0].collect()} == level
    for got in tree[1:]:
        up = {}
        for n in sorted(level):
            up.setdefault(n // 64 if len(level) > 64 else 0, []).append((n, *level[n]))
        level = {k: (sum(x[1] for x in v), sha(",".join(":".join(map(str, x)) for x in v))) for k, v in up.items()}
        assert {r["node"]: (r["length"], r["digest"]) for r in got.collect()} == level
    assert len(tree) == 3 and len(level) == 1


def test_audit_of_sparse_ids_hot_ids_and_ids_that_are_no_integers(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 50)
    rng = random.Random(4)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), "u", str(i)) for i in range(300)] + [(5, "u", f"hot {i}") for i in range(150)] + [(6, "u", "same")] * 15_000
    make = lambda r, kind="bigint": spark.createDataFrame(r, f"page_id {kind}, url string, html string").repartition(4)
    a = make(rows)
    levels, _ = W.trees(*[W.durable(W.leaves_of(W.manifest(a)))] * 2)
    assert levels[-1].count() == 1
    got = W.audit(a, make(rows[1:-1] + [(rows[3][0], "u", "twice")])).groupBy("page_id", "status").count().collect()
    assert {tuple(r) for r in got if r["page_id"] != rows[3][0]} == {(rows[0][0], "missing", 1), (6, "missing", 1)} and len(got) in (3, 4)
    words_ = [(str(i), "u", "x") for i in range(40)] + [("a b", "u", "y"), (None, "u", "z")]
    got = W.audit(make(words_, "string"), make(words_[:-2] + [("a b", "u", "n")], "string")).collect()
    assert {(r["page_id"], r["status"]) for r in got} == {("a b", "corrupt"), (None, "missing")}


def test_audit_on_awkward_rows(spark):
    schema = "page_id bigint, url string, html string, digest string, leaf string"
    rows = [(None, None, None, "x", "x"), (None, "u", "", "x", "x"), (1, None, "a", "x", "x"), (1, None, "a", "x", "x"), (1, "u", "z" * 3_000_000, "x", "x"), (2, "", None, "x", "x")]
    a = spark.createDataFrame(rows, schema)
    assert W.audit(a, a).count() == 0
    none = a.where("false")
    assert [r["status"] for r in W.audit(a, none).collect()] == ["missing"] * 6
    assert W.audit(none, a).count() == 6 and W.audit(none, none).count() == 0
    lost = spark.createDataFrame(rows[:3] + rows[4:], schema)  # one of two repeated rows
    assert [(r["page_id"]) for r in W.audit(a, lost).collect()] in ([1], [1, 1])


def test_token_counts_are_those_of_whole_texts(spark, make_docs, awkward, empty):
    enc = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(), special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "  a  b\n\n c", "don't we'll 1234 x_y <|endoftext|>", "Größe ça naïve 漢字 emoji 🙂🙂", "\t\r\n", words(rng, 3000)]
    texts += ["".join(rng.choice("ab cé1.\n'") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    got = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(make_docs(list(enumerate(texts)))).collect()}
    assert got == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert T.count_tokens(empty).count() == 0 and T.count_tokens(awkward).count() == awkward.count()


def test_token_cache_starts_anew_when_full():
    enc = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(), special_tokens={})
    c = T._Cache({"a": 1}, enc, 220)
    pieces = ("zzqzz", "qqzqq", "xzxzx", "a", "x" * 500)
    assert [c[x] for x in pieces] == [len(enc.encode_ordinary(x)) for x in pieces]
    assert set(c) == {"a", "xzxzx"}


def test_tier_one_is_measured_and_never_changes_a_count(spark, make_docs, awkward):
    rng = random.Random(6)
    docs = make_docs([(i, "zzqzzqx " * 5 + words(rng, 30)) for i in range(50)] + [(None, None), (60, "rare")])
    top = T.frequent_pretokens(docs, most=3)
    assert set(top) == {" w", "x", " zzqzzqx"}
    assert T.frequent_pretokens(awkward.where("doc_id is null")) == []
    counts = [sorted(map(str, T.count_tokens(docs, sample=s, most=m).collect())) for s, m in ((0, 10), (5, 1), (1000, 20_000))]
    assert counts[0] == counts[1] == counts[2]


def distance_within(item: str, text: str) -> int:
    """Smallest edit distance of item to any passage, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def normal(t: str) -> str:
    return re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", t.lower()).strip(" ")


def test_myers_against_the_table():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        assert D.myers(D.masks(a.encode()), len(a), b.encode()) == min(distance_within(a, b), len(a))


def test_pieces_cover_the_item():
    for m in (1, 7, 19, 20, 333):
        p = D.pieces(bytes(m), D.budget(m))
        assert len(p) == D.budget(m) + 1 and sum(len(x) for _, x in p) == m


def test_leaks_against_brute_force(spark, make_docs):
    rng = random.Random(21)
    items = [(i, words(rng, rng.choice([8, 15, 30]), 60)) for i in range(12)]
    docs = []
    for k in range(60):
        body = words(rng, 30, 60)
        if k % 2:
            t = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "zz"])
            body += " " + "".join(t) + " " + words(rng, 10, 60)
        docs.append((k, body))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for d, t in docs:
        for i, x in items:
            e = distance_within(normal(x), normal(t))
            if e <= D.budget(len(normal(x))):
                want.add((d, i, e))
    assert 10 < len(want) < 60
    df = make_docs(docs)
    for part in (D.PART_BYTES, 300):
        assert {tuple(r) for r in D.find_leaks(df, bench, part_bytes=part).collect()} == want
        assert {r["doc_id"] for r in D.drop_contaminated(df, bench, part_bytes=part).collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert "Exchange" not in D.drop_contaminated(df, bench)._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_fewer_than_eight_bytes(spark, make_docs):
    rng = random.Random(5)
    items = [(i, words(rng, 4, 20)) for i in range(6)]
    docs = [(k, words(rng, 6, 20) + " " + rng.choice(items)[1].replace("w", rng.choice(["w", "v", ""])) + " x") for k in range(40)]
    rate = 0.3
    want = {(d, i, distance_within(normal(x), normal(t))) for d, t in docs for i, x in items}
    want = {w for w in want if w[2] <= D.budget(len(normal(dict(items)[w[1]])), rate)}
    got = D.find_leaks(make_docs(docs), spark.createDataFrame(items, "item_id bigint, text string"), rate)
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want


def test_short_items_match_whole_words_and_punctuation_of_any_script_is_a_space(spark, make_docs):
    bench = spark.createDataFrame([(1, "no"), (2, "A"), (3, "what — “is” it… über alles"), (4, "naïve")], "item_id bigint, text string")
    docs = make_docs([(1, "banana nothing"), (2, "No!"), (3, "say no"), (4, "Give me a, please"), (5, "so WHAT is, it über «alles»?"), (6, "naïveté"), (7, "a naïve word")])
    assert {tuple(r) for r in D.find_leaks(docs, bench).collect()} == {(2, 1, 0), (3, 1, 0), (4, 2, 0), (5, 3, 0), (7, 2, 0), (7, 4, 0)}


def test_normal_bytes_is_the_pattern_over_all_code_points():
    import regex

    text = "".join(f"a{chr(c)}b " for c in [*range(0x80, 0xD800, 7), *range(0xE000, 0x110000, 997)])
    want = regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", text).strip(" ")
    assert normal_bytes(np.frombuffer(text.encode(), np.uint8)).tobytes().decode() == want


def test_leaks_on_awkward_rows(spark, awkward, empty, make_docs):
    rng = random.Random(1)
    item = words(rng, 20, 50)
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "?!")], "item_id bigint, text string")
    rows = [(1, f"x {item.upper()} y"), (None, item), (2, None), (3, ""), (4, words(rng, 90_000, 5000) + " " + item)]
    df = make_docs(rows + [rows[0]])
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.find_leaks(df, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 1, None, 4) for i in (1, 1, None)], key=str)
    left = D.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    assert D.find_leaks(empty, bench).count() == 0 and D.find_leaks(awkward, bench.where("false")).count() == 0
    assert D.drop_contaminated(awkward, bench.where("false")).count() == awkward.count()
