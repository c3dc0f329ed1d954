"""Operator 8: toxicity by a factorization machine over hashed terms.

Terms are the words of a text, hashed to `BUCKETS`; presence counts, not frequency. The machine

    score = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

is fitted by Adam under a logistic loss on a bounded sample of labelled documents; the factors v
give every pair of terms a weight of its own, as for an insult together with a group that is
mentioned. The pair sum is computed in time linear in the terms of a text.

The machine sees every term that tells by itself (|z| > `SCREEN` between the classes) and every
term of a pair that tells beyond that: all pairs of terms with `PAIR_LEAST` sampled texts are
tested on what the machine of the single terms leaves unexplained (|z| > `PAIR_SCREEN`), so words
that are balanced alone and telling together are learned too. All other terms have weight zero,
so the length of a clean text adds no noise.

Defined cases: null and empty texts and those without a word hold no term: they score the bias
and are never rejected; a text of any length is scored whole; labels without a document, null
labels and documents without a label are not trained on; a document with both labels is trained
on under both; at most the sampled number of rows of each class is trained on however often a
doc_id is repeated; without both classes in the labels nothing is rejected; repeated rows are
each scored; an empty table gives an empty result; other columns are ignored, or pass unchanged in
`drop_toxic`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import slices, utf8, words

BITS, FACTORS, SCREEN = 20, 4, 5.0
#: Deviation from which a pair tells beyond its terms, and sampled texts that a term of such a pair is in.
PAIR_SCREEN, PAIR_LEAST = 6.5, 30
#: Labelled documents of each class to train on; rejection from this probability.
TRAIN_TOXIC, TRAIN_CLEAN, REJECT = 3000, 6000, 0.5


class Machine(NamedTuple):
    """slot: bucket to column of w and v, -1 for none."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, doc: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from (text, column) pairs without repeats."""
        out = np.full(n, self.w0)
        if len(doc):
            out += np.bincount(doc, self.w[col], n)
            for f in range(self.v.shape[1]):
                x = self.v[col, f]
                out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column(3))
        out = []
        for i, j in slices(off):
            h, bounds = words(data, off[i : j + 1])
            t = _buckets(h)
            out += [np.unique(t[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=["h", "t", "toxic", "terms"])


def _sums(values: np.ndarray, at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the rows `at` of values between the offsets."""
    out = np.zeros((len(off) - 1, values.shape[1]), np.float32)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[at], off[some], axis=0)
    return out


def _fitted(doc: np.ndarray, col: np.ndarray, n_cols: int, y: np.ndarray, factors: int, steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """[w0, w, v] by Adam over all texts at once, and their scores; (doc, col) are the terms present, sorted by doc."""
    n, n_cols = len(y), max(1, n_cols)
    docs = np.searchsorted(doc, np.arange(n + 1))
    order = np.argsort(col, kind="stable")
    cols, by_col = np.searchsorted(col[order], np.arange(n_cols + 1)), doc[order]
    rng, y = np.random.default_rng(7), y.astype(np.float32)
    theta = [np.array([np.log(y.sum() / (1 - y).sum())], np.float32), np.zeros((n_cols, 1), np.float32), rng.normal(0, 0.05, (n_cols, factors)).astype(np.float32)]
    m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    def score() -> tuple[np.ndarray, np.ndarray]:
        w0, w, v = theta
        x = _sums(np.concatenate([v, w, (v * v).sum(axis=1, keepdims=True)], axis=1), col, docs)
        xv = x[:, :factors]
        return xv, w0 + x[:, factors] + 0.5 * ((xv**2).sum(axis=1) - x[:, factors + 1])

    for t in range(1, steps + 1):
        xv, s = score()
        g = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / n)[:, None]
        x = _sums(np.concatenate([g, g * xv], axis=1), by_col, cols)
        grads = [g.sum(axis=0), x[:, :1] + 1e-5 * theta[1], x[:, 1:] - x[:, :1] * theta[2] + 1e-4 * theta[2]]
        for k in range(3):
            m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
            m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
            theta[k] = theta[k] - 0.05 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-9)
    return [theta[0].astype(float), theta[1][:, 0].astype(float), theta[2].astype(float)], score()[1].astype(float)


class _Sample:
    """Presence of terms in the sampled texts."""

    def __init__(self, terms: list[np.ndarray]):
        self.n = len(terms)
        self.doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        self.term = np.concatenate(terms).astype(np.int64)

    def of(self, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot of every bucket, texts, columns) of these terms."""
        slot = np.full(1 << BITS, -1, np.int32)
        slot[cols] = np.arange(len(cols))
        at = slot[self.term]
        return slot, self.doc[at >= 0], at[at >= 0]

    def dense(self, cols: np.ndarray) -> np.ndarray:
        """Texts x terms."""
        _, doc, col = self.of(cols)
        x = np.zeros((self.n, max(1, len(cols))), np.float32)
        x[doc, col] = 1
        return x

    def telling_pairs(self, cols: np.ndarray, y: np.ndarray, p: np.ndarray, screen: float, block: int = 512) -> np.ndarray:
        """Terms of pairs whose texts deviate from the chances p, block by block over all pairs that can."""
        left, spread = (y - p).astype(np.float32), np.maximum(p * (1 - p), 1e-3).astype(np.float32)
        least = 0.05 * PAIR_LEAST  # below this variance texts are too few for z to be normal
        # The texts of a pair are among those of either term, so their sums bound those of all its pairs.
        _, doc, col = self.of(cols)
        mass = [np.bincount(col, x[doc], len(cols)) for x in (spread, np.maximum(left, 0), np.maximum(-left, 0))]
        cols = cols[(mass[0] >= least) & (np.maximum(mass[1], mass[2]) > screen * least**0.5)]
        parts, found = [cols[i : i + block] for i in range(0, len(cols), block)], [np.zeros(0, np.int64)]
        for i, a in enumerate(parts):
            xa = self.dense(a)
            moved, noise = (xa * left[:, None]).T, (xa * spread[:, None]).T
            for j in range(i, len(parts)):
                xb = xa if i == j else self.dense(parts[j])
                var = noise @ xb
                z = np.abs(moved @ xb) / np.sqrt(np.maximum(var, 1e-9))
                z[var < least] = 0
                if i == j:
                    np.fill_diagonal(z, 0)
                r, c = np.nonzero(z > screen)
                found += [a[r], parts[j][c]]
        return np.unique(np.concatenate(found))


def train(terms: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, screen: float = SCREEN, pair_screen: float = PAIR_SCREEN, steps: int = 400) -> Machine:
    """Selects the terms, alone and in pairs, and fits the machine."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return Machine(np.full(1 << BITS, -1, np.int32), -30.0, np.zeros(1), np.zeros((1, factors)))
    sample = _Sample(terms)
    toxic = np.bincount(sample.term[y[sample.doc] == 1], minlength=1 << BITS)
    clean = np.bincount(sample.term[y[sample.doc] == 0], minlength=1 << BITS)
    p = (toxic + clean) / (n1 + n0)
    z = (toxic / n1 - clean / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    single = np.flatnonzero((np.abs(z) > screen) & (toxic + clean >= 5))
    slot, doc, col = sample.of(single)
    theta, s = _fitted(doc, col, len(single), y, factors, steps)
    pairs = sample.telling_pairs(np.flatnonzero(toxic + clean >= PAIR_LEAST), y, 1 / (1 + np.exp(-np.clip(s, -30, 30))), pair_screen)
    both = np.union1d(single, pairs)
    if len(both) > len(single):
        slot, doc, col = sample.of(both)
        theta, _ = _fitted(doc, col, len(both), y, factors, steps)
    return Machine(slot, float(theta[0][0]), theta[1], theta[2])


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Machine:
    """The machine of the labelled documents that come first by a hash of their id: at most `toxic` and `clean` rows."""
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").alias("y"), F.xxhash64("doc_id").alias("h"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    y, terms = [], []
    for label, most in ((0, clean), (1, toxic)):
        # Both limits are top-k by task, so no class passes through one; what is broadcast has `most` rows.
        ids = known.where(F.col("y") == label).select("h", "doc_id").distinct().orderBy("h", "doc_id").limit(most)
        rows = texts.join(F.broadcast(ids), "doc_id").select("h", F.xxhash64("text").alias("t"), F.lit(label).alias("toxic"), "text")
        made = rows.mapInArrow(_terms, "h bigint, t bigint, toxic int, terms array<int>")
        got = made.orderBy("h", "t").limit(most).toArrow()
        y += got.column("toxic").to_pylist()
        terms += [np.asarray(t.values, np.int32) for t in got.column("terms")]
    order = sorted(range(len(y)), key=lambda i: (y[i], len(terms[i]), terms[i].tobytes()))
    return train([terms[i] for i in order], np.array([y[i] for i in order], float))


def _scored(m: Machine, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(probability, whether there is a term) of texts."""
    data, off = utf8(text)
    s, some = np.full(len(text), m.w0), np.zeros(len(text), bool)
    for i, j in slices(off):
        h, bounds = words(data, off[i : j + 1])
        some[i:j] = np.diff(bounds) > 0
        col = m.slot[_buckets(h)]
        at = np.flatnonzero(col >= 0)
        doc = np.searchsorted(bounds, at, side="right") - 1
        pair = np.unique(doc * len(m.w) + col[at])
        s[i:j] = m.scores(pair // len(m.w), pair % len(m.w), j - i)
    return 1 / (1 + np.exp(-np.clip(s, -30, 30))), some


def score_toxicity(docs: DataFrame, machine: Machine, reject: float = REJECT) -> DataFrame:
    """doc_id, probability and rejected of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, some = _scored(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= reject) & some)], names=["doc_id", "probability", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, probability double, rejected boolean")


def drop_toxic(docs: DataFrame, machine: Machine, reject: float = REJECT) -> DataFrame:
    """The rows of `docs` that are not rejected: a filter where the rows are read, nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("boolean")
    def stays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            p, some = _scored(shared.value, text)
            yield pa.array(~((p >= reject) & some))

    return docs.where(stays(F.col("text")))
