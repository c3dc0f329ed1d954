"""Words, paths, vectors and citations: columns, and their Python twins."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import cite, lex, paths, vectors
from tessella.operators import search


def column(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


SPLITS = {"getUserProfile": ["get", "user", "profile"], "HTTPServer": ["http", "server"], "user_profile": ["user", "profile"], "OAuth2Token": ["o", "auth", "2", "token"], "fooFoo": ["foo"]}
STEMS = {"sessions": "session", "queries": "query", "classes": "class", "css": "css", "class": "class", "429s": "429s", "db": "db", "buses": "bus", "parsing": "pars", "parse": "pars", "parses": "pars", "rendered": "render"}


def test_split_identifier(spark):
    assert column(spark, lex.split_identifier, *SPLITS) == list(SPLITS.values())
    assert [lex.split_identifier_py(x) for x in SPLITS] == list(SPLITS.values())


def test_stem(spark):
    assert column(spark, lex.stem, *STEMS) == list(STEMS.values())
    assert [lex.stem_py(x) for x in STEMS] == list(STEMS.values())


def test_fold(spark):
    assert column(spark, lex.fold, "café", "naïve résumé", "Ünïcödé", "é") == ["cafe", "naive resume", "Unicode", "e"]


def test_keywords_and_terms():
    assert lex.keywords("parse HTTP config") == ["parse", "HTTP", "config"]
    assert lex.keywords("how does the auth auth work") == ["auth"]
    t = lex.query_terms("getUserSessions")[0]
    assert "user" in t.forms and "session" in t.forms and "get" not in t.forms and len(t.groups) == 2


def score(spark, query, *texts, saturate=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["score"] for r in search.score_texts(df, F.col("t"), query, saturate).orderBy("i").collect()]


def test_tiers(spark):
    assert score(spark, "auth", "auth middleware", "login middleware", "preauthx middleware", "nothing") == [3.0, 1.5, 1.0, 0.0]


def test_saturation_and_length(spark):
    one, many, short, long = score(spark, "auth", "auth", "auth " * 50, "auth x", "auth " + "filler " * 600, saturate=True)
    assert many <= 1.5 * one * 1.0001 and long < short


def test_globs(spark):
    assert column(spark, lambda c: paths.matches(c, ["src/**"]), "src/a.ts", "src/x/y.ts", "lib/a.ts") == [True, True, False]
    assert column(spark, lambda c: paths.matches(c, ["packages/**/*.ts"], ["**/*.d.ts"]), "packages/a.ts", "packages/x/y/a.ts", "packages/a.d.ts", "a.ts") == [True, True, False, False]


def test_kinds_tiers_and_penalties(spark):
    assert column(spark, paths.file_kind, "docs/a.ts", "a.md", "x.json", "x.css", "LICENSE") == ["code", "doc", "config", "asset", "asset"]
    assert column(spark, paths.tier, "src/core", "src/__tests__", "a/docs/b", "src") == [1, 2, 2, 0]
    assert column(spark, paths.path_weight, "app/api/test-x", "app/sentry") == [0.55, 1.0]
    assert column(spark, paths.generic_weight, "src/utils", "src/billing") == [0.8, 1.0]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1.0])], "a array<float>, b array<float>, c array<float>")
    q = df.select(*[vectors.quantize(F.col(x)).alias(x) for x in "abc"])
    s = q.select(vectors.similarity(F.col("a"), F.col("a")), vectors.similarity(F.col("a"), F.col("b")), vectors.similarity(F.col("a"), F.col("c"))).collect()[0]
    assert tuple(s) == (1.0, 0.0, -1.0)
    raw = spark.createDataFrame([([127, -128, 0, 42, -7],)], "v array<tinyint>")
    assert raw.select(vectors.decode_base64(vectors.encode_base64("v"))).collect()[0][0] == [127, -128, 0, 42, -7]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("See [src/a.ts], [src/a.ts:12] and [a.ts:3-9] but [TODO] and [x](y).", [("src/a.ts", None, None), ("src/a.ts", 12, None), ("a.ts", 3, 9)]),
        ("[app/actualite/[slug]/page.tsx:10] [app/[[...not-found]]/page.tsx]", [("app/actualite/[slug]/page.tsx", 10, None), ("app/[[...not-found]]/page.tsx", None, None)]),
        ("```\n[src/a.ts:1]\n```\n`[src/b.ts]` <!-- [src/c.ts] -->", []),
        ("[src/a.ts:5.] [guide](docs/x) [src/b.ts](http://x)", [("src/b.ts", None, None), ("src/a.ts", 5, None)]),
        ("[" + "long " * 20_000 + "[a [b.ts:2]] [x [y].ts]", [("b.ts", 2, None), ("x [y].ts", None, None)]),
        ("open [a\n```\nx\n```\nb/c.ts]", []),
    ],
)
def test_citations(spark, text, want):
    got = column(spark, cite.citations, text)[0]
    assert [(c["path"], c["start"], c["end"]) for c in got] == want


def test_forms_of_tokens_are_those_of_the_columns(spark):
    tokens = "parseHTTPRequest stories Stories2 running boxes a_b __x__ HTML5Parser ties makes used going us URLs snake_cases x1y2 dishes e2e".split()
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert {r["t"]: set(r["f"]) for r in df.select("t", lex.token_forms(df["t"]).alias("f")).collect()} == {t: lex.token_forms_py(t) for t in tokens}


def test_matching_skips_no_token_that_finds_a_term():
    import random

    rng = random.Random(2)
    m = lex.Matcher(lex.query_terms("storyBoard license deleting category tokens removeX"))
    whole = lambda t: tuple(n for n, (_, _, w) in enumerate(m.ways) if w & lex.token_forms_py(t))
    parts = sorted({w for _, _, x in m.ways for w in x}) + ["ies", "s", "es", "ing", "ed", "stor", "categor", "X", "2", "_", "Http"]
    seen = 0
    for _ in range(20_000):
        t = "".join(rng.choice([str.lower, str.title, str.upper])(rng.choice(parts)) for _ in range(rng.randrange(1, 4)))
        assert m.found(t) == whole(t), t
        seen += bool(whole(t))
    assert seen > 1000
    assert m.match("Stories of a licensed TOKEN, uncategorized")[2] == 6


def test_folding_is_one_for_queries_and_texts(spark):
    import unicodedata

    signs = "ﬁle Ａ① ℌ ½ é e\u0301 ǆ Ω 한 𝔄 ß æ"
    assert column(spark, lex.fold, signs) == [lex.fold_py(signs)] == ["file A1 H 1\u20442 e e dz Ω 한 A ß æ"]
    assert [t.exact for t in lex.query_terms("ﬁle Ａbc")] == ["file", "abc"]
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000, 13)]:
        want = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(x) != "Mn")
        assert lex.fold_py(chr(code)) == want


def test_a_batch_is_read_in_parts(monkeypatch):
    """However many rows a batch has, few texts are Python strings at once; a long text, nulls and slices stay right."""
    made = []
    monkeypatch.setattr(lex.F, "arrow_udf", lambda kind: lambda run: made.append(run) or (lambda c: c))
    monkeypatch.setattr(lex, "PART_BYTES", 100)
    texts = [None, "é" * 200, *(f"Stories é {i}" for i in range(50)), "", None, "x" * 90, "y" * 10, "z"]
    whole = pa.array(["left out", *texts], pa.string()).slice(1)
    lex.fold(None)
    lex.match(None, terms := lex.query_terms("story 7"))
    folded, matched = (list(run(iter([whole, whole.slice(0, 0), whole.slice(3, 4)]))) for run in made)
    want = [*texts, *texts[3:7]]
    assert [x for b in folded for x in b.to_pylist()] == [t if t is None else lex.fold_py(t) for t in want]
    m = lex.Matcher(terms)
    assert [(x["n_tokens"], [h["count"] for h in x["hits"]]) for b in matched for x in b.to_pylist()] == [(None, [0] * len(terms)) if t is None else (m.match(t)[2], m.match(t)[1]) for t in want]
    assert all(len(b) == 1 or sum(len(x or "") for x in b.to_pylist()) <= 100 for b in folded) and len(folded) == len(matched) > 8
