"""Operator 9: benchmark decontamination by pigeonhole edit matching.

Documents and benchmark items are brought to one form (lower case, runs of signs that are no
letter, mark or digit of any script made one space; UTF-8 bytes). An item of m bytes has an error
budget of k = floor(`ERROR_RATE` x m) edits and is split into k + 1 pieces: by the pigeonhole
principle any passage within k edits of it holds a piece unchanged. Pieces are found in a document
by a vectorised look-up of their first eight bytes at every offset, checked in full (pieces shorter
than that by one automaton for all); around each hit Myers' bit-parallel algorithm gives the
smallest distance of the item to any passage there.

The documents never move: the pieces are broadcast, `PART_BYTES` of benchmark text at a time.

Result: doc_id, item_id, edits for every pair with edits <= k. Defined cases: null or empty
documents and items without a letter or digit match nothing; an item of fewer than eight bytes
matches as whole words only, never within one; repeated rows and repeated items each give their
rows; a null id is carried; empty tables give an empty result; other columns are ignored, or pass
unchanged in `drop_contaminated`, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import normal_bytes, utf8

#: Edits a byte of an item, and bytes of benchmark text that are broadcast at once.
ERROR_RATE, PART_BYTES = 0.05, 32 << 20
_Q, _BITS, _C = 8, 20, np.uint64(0x9E3779B97F4A7C15)


def budget(m: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item of m bytes."""
    return int(m * rate + 1e-9)


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """k + 1 pieces of the item with their offsets, as even as can be."""
    n = k + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(cut[i], item[cut[i] : cut[i + 1]]) for i in range(n)]


def masks(item: bytes) -> dict[int, int]:
    """Bit i of the mask of a byte: it is the item's i-th."""
    out: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[int, int], m: int, text: bytes) -> int:
    """The smallest edit distance of the item to any passage of text, bit-parallel over the item."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


class Pieces:
    """The pieces of a part of the benchmark, by their first eight bytes."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float):
        self.ids = [x for x, _ in items]
        self.items = [t for _, t in items]
        self.k = [budget(len(t), rate) for t in self.items]
        self.peq: dict[int, dict[int, int]] = {}
        short: dict[str, list[tuple[int, int]]] = defaultdict(list)
        anchor, item, begin, size = [], [], [], []
        for n, t in enumerate(self.items):
            for at, p in pieces(t, self.k[n]):
                if len(p) < _Q:
                    short[p.decode("latin-1")].append((n, at))
                else:
                    anchor.append(int.from_bytes(p[:_Q], "little"))
                    item.append(n)
                    begin.append(at)
                    size.append(len(p))
        anchor = np.array(anchor, np.uint64)
        order = np.argsort(anchor, kind="stable")
        self.anchor = anchor[order]
        self.item, self.at, self.size = (np.array(x, np.int64)[order] for x in (item, begin, size))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.anchor * _C) >> np.uint64(64 - _BITS)] = True
        self.short = None
        if short:
            self.short = ahocorasick.Automaton()
            for p, own in short.items():
                self.short.add_word(p, (len(p), own))
            self.short.make_automaton()

    def hits(self, text: np.ndarray) -> dict[int, list[int]]:
        """Item to the places where it would begin, from every piece found."""
        out: dict[int, list[int]] = defaultdict(list)
        n = len(text)
        if n >= _Q and len(self.anchor):
            for lo in range(0, n - _Q + 1, 1 << 20):
                hi = min(lo + (1 << 20), n - _Q + 1)
                v = np.ndarray((hi - lo,), "<u8", text[lo : hi + _Q - 1].tobytes(), strides=(1,))
                at = np.flatnonzero(self.bitmap[(v * _C) >> np.uint64(64 - _BITS)])
                if not len(at):
                    continue
                w = v[at]
                first, last = np.searchsorted(self.anchor, w), np.searchsorted(self.anchor, w, side="right")
                ok = last > first
                for p, s, e in zip((at[ok] + lo).tolist(), first[ok].tolist(), last[ok].tolist()):
                    for r in range(s, e):
                        n_item, a, m = int(self.item[r]), int(self.at[r]), int(self.size[r])
                        if text[p : p + m].tobytes() == self.items[n_item][a : a + m]:
                            out[n_item].append(p - a)
        if self.short is not None:
            for end, (m, own) in self.short.iter(text.tobytes().decode("latin-1")):
                s = end + 1 - m
                for item, at in own:
                    whole = (s == 0 or text[s - 1] == 32) and (end + 1 == n or text[end + 1] == 32)
                    if whole or len(self.items[item]) >= _Q:
                        out[item].append(s - at)
        return out

    def matches(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, edits) of every item within its budget somewhere in the text."""
        for n, begins in sorted(self.hits(text).items()):
            m, k = len(self.items[n]), self.k[n]
            if n not in self.peq:
                if len(self.peq) >= 4096:
                    self.peq.clear()
                self.peq[n] = masks(self.items[n])
            best, lo, hi = m + 1, None, None
            for b in sorted(set(begins)) + [None]:
                if lo is not None and (b is None or b - k > hi):
                    best = min(best, myers(self.peq[n], m, text[max(0, lo) : hi].tobytes()))
                    lo = None
                if b is not None:
                    lo = b - k if lo is None else lo
                    hi = b + m + k
            if best <= k:
                yield n, best


def _parts(benchmark: DataFrame, rate: float, part_bytes: int) -> Iterator:
    """The pieces of the benchmark, broadcast part by part."""
    named = benchmark.where(F.col("text").isNotNull()).select("item_id", F.lower("text").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = -(-size // part_bytes) or 1
    for k in range(parts):
        got = (named if parts == 1 else named.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)).collect()
        items = [(r["item_id"], normal_bytes(np.frombuffer(r["text"].encode(), np.uint8)).tobytes()) for r in got]
        yield benchmark.sparkSession.sparkContext.broadcast(Pieces([x for x in items if x[1]], rate))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, item_id and edits of every leaked item."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text"))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for b in batches:
                data, off = utf8(b.column(1))
                found = [(i, p.ids[n], e) for i in range(b.num_rows) for n, e in p.matches(normal_bytes(data[off[i] : off[i + 1]]))]
                if found:
                    row, item, edits = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(item, item_type), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "edits"])

        return run

    out = None
    for shared in _parts(benchmark, rate, part_bytes):
        found = rows.mapInArrow(scan(shared), f"doc_id {kind}, item_id {item_kind}, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of `docs` that hold no benchmark item: a filter where the rows are read, nothing is joined or shuffled."""

    def stays(shared):
        @F.arrow_udf("boolean")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            p = shared.value
            for text in batches:
                data, off = utf8(text)
                yield pa.array([next(p.matches(normal_bytes(data[off[i] : off[i + 1]])), None) is None for i in range(len(text))], pa.bool_())

        return run(F.lower("text"))

    for shared in _parts(benchmark, rate, part_bytes):
        docs = docs.where(stays(shared))
    return docs
