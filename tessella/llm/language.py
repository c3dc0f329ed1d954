"""Operator 6: language identification by prediction by partial matching.

For each language a context tree over bytes, up to `ORDER` bytes deep, is counted on a bounded
sample of labelled rows (`TRAIN_DOCS` texts a language, whole texts) and frozen. The cost of a
byte is its code length under method C: seen in the longest known context, count / (n + q);
otherwise the escape q / (n + q) and the next shorter context, down to evenness over 256
values (n bytes and q distinct bytes were seen in the context). A text's code length under a
language is the exact sum over all its bytes, in units of 2^-11 bit, and the language with the
shortest code wins.

The trees of all languages are compiled into one table (deepest known context x byte x
language), so a byte costs one look-up.

Defined cases: null text has null results; an empty text has code length 0 and no language;
equal code lengths go to the language first by name; unseen bytes cost an escape to order -1; a
table without labels or rows gives no language for any row; repeated rows are each scored;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.text import slices, utf8

#: Depth of the trees, texts a language to count on, units of a bit.
ORDER, TRAIN_DOCS, UNIT = 3, 200, 2048


class Model:
    """Frozen costs. `rank` maps a byte to its number (0: never seen), `row_of` the last three
    numbers to the row of the deepest known context, `cost` rows x numbers x languages to units."""

    def __init__(self, languages: list[str], rank: np.ndarray, row_of: np.ndarray, cost: np.ndarray):
        self.languages, self.rank, self.row_of, self.cost = languages, rank, row_of, cost

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts x languages, in units, for consecutive texts."""
        out = np.zeros((len(off) - 1, len(self.languages)), np.int64)
        a = self.cost.shape[1]
        flat = self.cost.reshape(-1, self.cost.shape[2])
        for i, j in slices(off, 1 << 18):
            if off[i] == off[j]:
                continue
            for lo in range(int(off[i]), int(off[j]), 1 << 18):  # one long text goes in pieces that know what went before
                hi = min(lo + (1 << 18), int(off[j]))
                x = self.rank[data[lo:hi]]
                begin = off[i : j + 1] - lo
                past = [np.empty_like(x) for _ in range(3)]
                for d in (1, 2, 3):
                    p = past[d - 1]
                    p[d:] = x[:-d]
                    head = data[max(lo - d, int(off[i])) : lo][:d] if lo > off[i] else data[:0]
                    p[:d] = 0
                    if len(head):
                        v = self.rank[head][: len(x)]
                        p[: len(v)] = v
                    for s in begin[(begin >= 0) & (begin < len(x))]:
                        p[s : s + d] = 0
                row = self.row_of[(past[2].astype(np.int32) * a + past[1]) * a + past[0]]
                c = flat[row * a + x]
                s = np.clip(begin, 0, len(x))
                has = np.flatnonzero(s[1:] > s[:-1])
                out[i:j][has] += np.add.reduceat(c, s[:-1][has], axis=0, dtype=np.int64)
        return out


def train(texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Counts the trees and compiles the table."""
    languages = sorted(texts)
    seen = np.zeros(256, bool)
    for t in texts.values():
        for b in t:
            seen[np.unique(np.frombuffer(b, np.uint8))] = True
    rank = np.zeros(256, np.int16)
    rank[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        joined = [np.concatenate([np.zeros(order, np.int64), rank[np.frombuffer(b, np.uint8)].astype(np.int64)]) for b in texts[lang] if b]
        x = np.concatenate(joined) if joined else np.zeros(0, np.int64)
        own = []
        for k in range(order + 1):
            code = np.zeros(max(0, len(x) - k), np.int64)
            for d in range(k + 1):
                code = code * a + x[d : d + len(code)]
            digits = np.stack([code // a**d % a for d in range(k + 1)]) if len(code) else np.zeros((k + 1, 0))
            own.append(np.unique(code[(digits > 0).all(axis=0)], return_counts=True))
        counts.append(own)
    row_of = np.zeros(a**3, np.int32).reshape(a, a, a)
    costs = np.empty((1, a, len(languages)))
    for n, own in enumerate(counts):
        costs[0, :, n] = _blend(own[0], np.full(a, 8.0))
    parts, size = [costs], 1
    for k in range(1, order + 1):
        ctx = np.unique(np.concatenate([own[k][0] // a for own in counts])).astype(np.int64)
        if not len(ctx):
            continue
        d = [ctx // a**i % a for i in range(k)]  # d[0]: the byte just before
        below = row_of[0, d[1] if k > 2 else 0, d[0]] if k > 1 else np.zeros(len(ctx), np.int32)
        table = np.concatenate(parts)
        new = table[below].copy()
        for n, own in enumerate(counts):
            codes, c = own[k]
            at = np.searchsorted(ctx, codes // a)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            for s, e in zip(starts, np.append(starts[1:], len(at))):
                new[at[s], :, n] = _blend((codes[s:e] % a, c[s:e]), new[at[s], :, n])
        rows = np.arange(size, size + len(ctx), dtype=np.int32)
        if k == 1:
            row_of[:, :, d[0]] = rows
        elif k == 2:
            row_of[:, d[1], d[0]] = rows
        else:
            row_of[d[2], d[1], d[0]] = rows
        parts.append(new)
        size += len(ctx)
    units = np.rint(np.concatenate(parts) * UNIT).astype(np.uint32)
    return Model(languages, rank, row_of.ravel(), units)


def _blend(seen: tuple[np.ndarray, np.ndarray], shorter: np.ndarray) -> np.ndarray:
    """Costs in bits in a context, given those in the next shorter one."""
    sym, c = seen
    if not len(sym):
        return shorter
    n, q = c.sum(), len(c)
    out = shorter + np.log2((n + q) / q)
    out[sym.astype(np.int64)] = np.log2((n + q) / c)
    return out


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model | None:
    """The model of the labelled rows that come first by a hash of their id, at most `per_language` of each, however often an id is repeated."""
    ids = Window.partitionBy("lang").orderBy("h", "doc_id")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    picked = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("n", F.row_number().over(ids)).where(F.col("n") <= per_language)
    picked = picked.select("lang", "doc_id", "h").distinct()
    found = labelled.select("lang", "doc_id", "text").join(F.broadcast(picked), ["lang", "doc_id"])
    rows = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    rows = found.withColumn("n", F.row_number().over(rows)).where(F.col("n") <= per_language).select("lang", "doc_id", "text").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], str(r["doc_id"]), r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return train(texts) if texts else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, language, code length in bits under it and its lead over the next language, of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, language string, code_bits double, lead_bits double, bits_per_byte double"
    if model is None:
        none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", ")[1:])]
        return docs.select("doc_id", *none)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = utf8(b.column(1))
            code = m.code_lengths(data, off)
            best, n = code.argmin(axis=1), np.diff(off)
            top = code[np.arange(len(code)), best]
            next_ = np.partition(code, 1, axis=1)[:, 1] if code.shape[1] > 1 and len(code) else top
            gone = b.column(1).is_null().to_numpy(zero_copy_only=False)
            empty = gone | (n == 0)
            lang = pa.array(np.array(m.languages, dtype=object)[best], pa.string(), mask=empty)
            cols = [pa.array(top / UNIT, mask=gone), pa.array((next_ - top) / UNIT, mask=gone), pa.array(top / UNIT / np.maximum(n, 1), mask=empty)]
            yield pa.RecordBatch.from_arrays([b.column(0), lang, *cols], names=["doc_id", "language", "code_bits", "lead_bits", "bits_per_byte"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
