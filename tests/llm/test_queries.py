"""The registered queries over whole tables: against SQL, else against plain versions."""

from __future__ import annotations

import math
from collections import Counter

import pytest
import tiktoken

import corpus_pipeline
from tessella.llm import language, lines, queries, tokens, toxicity
from tests.comparing import assert_same, connect

from . import brute
from .test_models import ppm_bits, ppm_counts
from .test_scans import brute_secrets

Q = queries.queries()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def items(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def test_names_and_registration():
    import __spark_entry__ as e

    assert [n.split("_")[0] for n in Q] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert set(Q) <= set(e.queries()) and set(queries.oracle_sql()) <= set(Q)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    assert_same(Q[name](spark, sf).toArrow(), connect(sf).sql(queries.oracle_sql()[name]).to_arrow_table())


def test_secrets(spark, sf, docs):
    got = sorted((r["doc_id"], r["length"]) for r in Q["op1_secret_scan"](spark, sf).collect())
    assert got == brute_secrets([(d["doc_id"], d["text"]) for d in docs])


def test_tokens(spark, sf, docs):
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(), special_tokens={})
    assert {r["doc_id"]: r["n_tokens"] for r in Q["op3_token_counts"](spark, sf).collect()} == {d["doc_id"]: len(enc.encode_ordinary(d["text"])) for d in docs}


def test_near_duplicates(spark, sf, docs):
    want = brute.near_groups(docs)
    rows = Q["op4_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: r["group_id"] for r in rows} == want
    assert {r["doc_id"] for r in rows if r["keep"]} == set(want.values())


def test_language(spark, sf, docs):
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {r["doc_id"]: r for r in Q["op6_language_id"](spark, sf).collect()}
    assert len(rows) == len(docs)
    train = {x: [d["text"].encode() for d in docs if d["lang"] == x] for x in model.languages}
    train = {x: ppm_counts(t, language.ORDER) for x, t in train.items()}
    for d in docs:
        t = d["text"].encode()
        bits = sorted((ppm_bits(c, t, language.ORDER), x) for x, c in train.items())
        r, slack = rows[d["doc_id"]], 0.5 / language.UNIT * len(t) + 1e-6
        assert abs(r["code_bits"] - bits[0][0]) <= slack and abs(r["lead_bits"] - (bits[1][0] - bits[0][0])) <= 2 * slack
        if bits[1][0] - bits[0][0] > 2 * slack:
            assert r["language"] == bits[0][1]
    assert sum(rows[d["doc_id"]]["language"] == d["lang"] for d in docs) >= 0.97 * len(docs)


def test_toxicity(spark, sf, docs):
    m = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in Q["op8_toxicity"](spark, sf).collect()}
    for d in docs:
        p, no = brute.toxic(m, d["text"])
        assert math.isclose(got[d["doc_id"]]["probability"], p, rel_tol=1e-6) and got[d["doc_id"]]["rejected"] == no


def test_leaks(spark, sf, docs, items):
    assert {tuple(r) for r in Q["op9_decontamination"](spark, sf).collect()} == brute.leaks(docs, items)


def test_pipeline(spark, sf, docs, items):
    m = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [d for d in docs if not brute.toxic(m, d["text"])[1]]
    assert 0 < len(rows) < len(docs)
    rows = brute.common_lines(rows, lines.MAX_DOCS)
    group = brute.near_groups(rows)
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    bad = {x[0] for x in brute.leaks(rows, items)}
    rows = [r for r in rows if r["doc_id"] not in bad]
    want = brute.mixture(rows)
    got = Q["pipeline"](spark, sf).collect()
    assert [(r["doc_id"], r["virtual_finish"], r["running_tokens"]) for r in got] == want
    text = {r["doc_id"]: r["text"] for r in rows}
    assert all(r["text"] == text[r["doc_id"]] for r in got)


def test_stages_return_the_columns_of_documents_and_stand_empty_tables(spark, sf, make_docs, awkward):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (make_docs([], clash=False), awkward.select(*plain)):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
            assert df.columns[:5] == plain and (len(df.columns) == 5) == (name != "mixing")
            assert Counter(df.dtypes[:5]) == Counter(awkward.select(*plain).dtypes)
        df.collect()
