"""Small tables with all that can go wrong."""

from __future__ import annotations

import random

import pytest

#: Names that operators use inside; a table may have them too.
CLASHING = ["key", "text_hash", "node", "root", "range", "h", "n", "keep", "group_id", "sig", "bucket", "dropped", "gone_hash", "other_id", "a.b", "weight", "line", "position", "rejected", "virtual_finish"]


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, source]) as a table like `documents`, with clashing columns."""

    def make(rows, clash: bool = True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        if clash:
            schema += "".join(f", `{c}` string" for c in CLASHING)
            full = [r + ("x",) * len(CLASHING) for r in full]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls, empty and very long texts, repeated rows, ties."""
    rng = random.Random(5)
    long = words(rng, 120_000)
    same = words(rng, 60)
    rows = [(1, None), (None, None), (None, None), (2, ""), (3, ""), (4, "   "), (5, long), (6, long), (7, same), (7, same), (8, same), (None, same), (9, "one"), (10, "one"), (11, "!!!"), (12, "é"), (13, "a\n\nb\n")]
    return make_docs(rows)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
