"""Operator 3: exact BPE token counts by a map-side lookup of two tiers.

A text is cut into pre-tokens by the tokenizer's own pattern. Tier one is a broadcast table of the
`FREQUENT` most frequent pre-tokens with their true numbers of tokens, measured on a bounded sample
of `SAMPLE_DOCS` documents, on the map side; what is in it decides how fast a count is found,
never the count. A miss goes to tier two, a cache in the worker (of `CACHE_BYTES`) that encodes a
pre-token once and keeps its count. No pre-token of the corpus is ever shuffled; the counts are
those of encoding whole texts.

Defined cases: null text has null counts, empty text 0; special tokens in a text are ordinary
text; pre-tokens longer than `LONGEST` signs are encoded each time and not kept; repeated rows are
each counted; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file unless another is given; TESSELLA_VOCABULARY names it for a cluster.
VOCABULARY = os.environ.get("TESSELLA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents on which frequencies are measured, entries of the table of tier one (and of each task's share of it).
SAMPLE_DOCS, FREQUENT = 1000, 20_000
#: Bytes of pre-tokens in a worker's cache, after which it starts anew, and signs of the longest that it keeps.
CACHE_BYTES, LONGEST = 32 << 20, 256


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def encoding_of(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def frequent_pretokens(docs: DataFrame, sample: int = SAMPLE_DOCS, most: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of the documents that come first by a hash of their id, not of more than `sample` rows of them."""
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(sample)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen, left = regex.compile(PATTERN).finditer, Counter(), sample
        for b in batches:
            for v in b.column(0)[:left]:
                for m in pieces(v.as_py()):
                    p = m.group()
                    if len(p) <= LONGEST:
                        seen[p] += 1
                if len(seen) > 10 * most:
                    seen = Counter(dict(seen.most_common(most)))
            left = max(0, left - b.num_rows)
        best = seen.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    # One row a pre-token of each task's share: the sample's, so its size doesn't grow with the corpus.
    found = rows.mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in found.orderBy(F.desc("n"), "piece").limit(most).collect()]


#: One cache for each vocabulary that this worker has met, by what the file holds; tasks share them.
_WORKER: dict[str, "_Cache"] = {}


class _Cache(dict):
    """Counts of pre-tokens; a miss is encoded once."""

    def __init__(self, frequent: dict[str, int], encoding: tiktoken.Encoding, room: int = CACHE_BYTES):
        super().__init__(frequent)
        self.frequent, self.encoding, self.size, self.room = frequent, encoding, room, room

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))  # a pre-token by itself is cut into itself
        if len(piece) <= LONGEST:
            self.room -= 100 + len(piece)
            if self.room < 0:
                self.clear()
                self.update(self.frequent)
                self.room = self.size
            self[piece] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE_DOCS, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row, without a shuffle of pre-tokens."""
    ranks = load_ranks(vocabulary)
    name, own = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), encoding_of(ranks)
    frequent = {p: len(own.encode_ordinary(p)) for p in frequent_pretokens(docs, sample, most)}
    shared = docs.sparkSession.sparkContext.broadcast((ranks, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, frequent = shared.value
        if name not in _WORKER:
            _WORKER[name] = _Cache(frequent, encoding_of(ranks))
        elif _WORKER[name].frequent is not frequent:
            _WORKER[name].frequent = frequent
            _WORKER[name].update(frequent)
        pieces, size = regex.compile(PATTERN).findall, _WORKER[name].__getitem__
        for b in batches:
            a, n = [], []
            for v in b.column(1):
                text = v.as_py()
                if text is None:
                    a.append(None)
                    n.append(None)
                    continue
                cut = pieces(text)
                a.append(len(cut))
                n.append(sum(map(size, cut)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(count, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")
