"""Operator 4: near-duplicate groups by min-max hashing.

Every text is a set of hashed runs of `SHINGLE` words. Under each of `PERMUTATIONS` random
linear permutations both the minimum and the maximum are kept: 2 x PERMUTATIONS unbiased
signature values at PERMUTATIONS evaluations. `BAND_ROWS` consecutive values make a band; texts
that share a band are candidates, and the share of equal values over the whole signature, an
unbiased estimate of Jaccard similarity, must reach `THRESHOLD`.

Texts with one signature are one node (if two signatures share a 64-bit number, one gets another).
In a band bucket every node is first compared with the bucket's smallest node, its head, and
connected components are formed. Then, in every bucket whose other nodes still lie in more than
one component, the rest of the pairs is compared in blocks of `BLOCK` nodes: a pair of blocks is
one key of the shuffle, so m nodes of a bucket send m x (m / BLOCK) rows and never m^2 pairs, a
bucket of any size is spread over tasks, and what comes back is a spanning forest of each pair of
blocks. Pairs within a component can't change it, so the groups are exactly the components of all
alike candidate pairs.

Rows that leave are found by a filter of bounded size and a sort-merge join on doc_id and text hash,
whatever their number. Nodes and buckets of very many rows are joined by broadcast, as there can be
few. Rounds of `components` join on nodes: there a hot node's rows are its links within one round,
which AQE splits.

Result of `near_duplicates`: doc_id, group_id (smallest doc_id of the group) and keep (true for
the one row that stays). Defined cases: null text, empty text and text without a word are in no
group and all stay; a text of fewer than `SHINGLE` words is one shingle; null doc_ids come last in
their group; of repeated rows one stays, in `drop_near_duplicates` that whose columns come first as
JSON; an empty table gives an empty result; columns other than doc_id and text are ignored, or pass
unchanged in `drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import mix, shingles, slices, utf8, words
from tessella.operators.sieve import MOST_BITS, join_split, sift
from tessella.session import column, durable, unused

SHINGLE, PERMUTATIONS, BAND_ROWS, THRESHOLD = 3, 64, 4, 0.5
#: Nodes of a bucket that are compared with each other at once.
BLOCK = 512
SEED = 20_240_613


def coefficients(permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the permutations of the 64-bit numbers."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, permutations, dtype=np.uint64)


def signature_values(sh: np.ndarray, bounds: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Texts x 2 permutations, 16 bits each: minimum and maximum under each permutation.

    Every text must have a shingle."""
    a, b = coefficients(permutations)
    out = np.empty((len(bounds) - 1, 2 * permutations), np.uint16)
    at = bounds[:-1]
    for k in range(permutations):
        v = sh * a[k]
        v += b[k]
        # The low bits of a linear permutation are poor; extremes are mixed before they are cut to 16 bits.
        out[:, 2 * k] = mix(np.minimum.reduceat(v, at)) >> np.uint64(48)
        out[:, 2 * k + 1] = mix(np.maximum.reduceat(v, at)) >> np.uint64(48)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column(2))
        for i, j in slices(off):
            h, bounds = words(data, off[i : j + 1])
            sh, new = shingles(h, bounds, SHINGLE)
            has = np.flatnonzero(np.diff(new))
            if not len(has):
                continue
            sig = signature_values(sh, np.append(new[:-1][has], new[-1]))
            rows = pa.array(has + i)
            cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array([x.tobytes() for x in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u8").reshape(b.num_rows, -1)
        n = sig.shape[1]
        key = mix(sig + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])


def _alike(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for k in (2, 3))
            ok = pa.array((x == y).mean(axis=1) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return run


def _forest(root: list[int], block: list[int], x: np.ndarray, threshold: float) -> set[tuple[int, int]]:
    """Links between roots that span the components of the alike pairs of nodes of two blocks, or of one with itself."""
    names, own = np.unique(np.array(root), return_inverse=True)
    block, up, out = np.array(block), list(range(len(names))), set()

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    split = block.min() != block.max()
    left = np.flatnonzero(block == block.min()) if split else np.arange(len(block))
    right = np.flatnonzero(block == block.max())
    top = own.copy()
    for i in left:
        to = right[top[right] != top[i]] if split else right[(right > i) & (top[right] != top[i])]
        alike = to[(x[to] == x[i]).mean(axis=1) >= threshold] if len(to) else to
        for j in np.unique(top[alike]):
            a, b = find(int(own[i])), find(int(j))
            if a != b:
                up[max(a, b)] = min(a, b)
                out.add((int(names[min(a, b)]), int(names[max(a, b)])))
        if len(alike):
            top = np.array([find(int(k)) for k in own])
    return out


def _compared(threshold: float):
    """Rows (key, low, high, block, root, sig) come sorted by pair of blocks: (a, b) of the roots that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, ([], [], []), set()

        def close() -> None:
            if len(set(held[1])) > 1:
                sig = np.frombuffer(b"".join(held[2]), dtype=np.uint16).reshape(len(held[2]), -1)
                out.update(_forest(held[1], held[0], sig, threshold))

        def rows(pairs: set) -> pa.RecordBatch:
            a, b = zip(*pairs)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, low, high, *rest in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (key, low, high) != now:
                    close()
                    now, held = (key, low, high), ([], [], [])
                for h, v in zip(held, rest):
                    h.append(v)
            if len(out) > 10_000:
                yield rows(out)
                out.clear()
        close()
        if out:
            yield rows(out)

    return run


def text_key() -> Column:
    """With doc_id, the name of a row: rows with both equal are repeated."""
    return F.xxhash64("text")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each is connected with, by alternating large and small stars.

    Every round is stored, so lineage stays short and rounds survive lost executors; rounds grow
    with the logarithm of the longest path.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = both.groupBy("a").agg(F.min("b").alias("low"))
        m = m.withColumn("low", F.least("a", "low"))
        j = both.join(m, "a")
        if large:
            return j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        hung = j.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        return hung.unionByName(m.select("a", F.col("low").alias("b"))).where("a <> b").distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
    edges = durable(edges.select("a", "b").where("a <> b").distinct())
    last = mark(edges)
    while last[0]:
        edges = durable(star(star(edges, True), False))
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def bucket_members(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(key, node, head) of the nodes that share a band with another; head: the bucket's smallest node."""
    bands = nodes.select("node", "sig").mapInArrow(_bands, "key bigint, node bigint")
    heads = durable(bands.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"))
    _, perhaps = sift(bands, "key", heads.select("key"), most_bits)
    return join_split(perhaps, heads, "key").select("key", "node", "head")


def groups(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_bits: int = MOST_BITS) -> DataFrame:
    """(node, root) of the components of all candidate pairs that are alike; `nodes` is stored."""
    left, right = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    members = durable(bucket_members(nodes, most_bits).where("node <> head"))
    pairs = members.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    # A head may have very many partners: it is the many that are sent to its signature, once for each partner's task.
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b")
    first = durable(components(both.mapInArrow(_alike(threshold), "a bigint, b bigint")))
    rooted = durable(members.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    spread = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    spread = durable(spread.select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    mixed = join_split(rooted, spread, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = mixed.join(nodes.select("node", "sig"), "node").select("key", "block", "root", "sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "root", "sig")
    sent = sent.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    links = sent.mapInArrow(_compared(threshold), "a bigint, b bigint")
    second = durable(components(links)).toDF("root", "higher")
    # A node that only later pairs joined is its own root at first.
    alone = second.select(F.col("root").alias("node"), "root").join(first, "node", "left_anti")
    all_ = first.unionByName(alone)
    return all_.join(second, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_hash"), "text")


def _bare(rows: DataFrame) -> DataFrame:
    """Rows whose text is null or without a word."""
    return rows.where(F.col("text").isNull() | ~F.col("text").rlike("[\\p{L}\\p{N}]|[^\\x00-\\x7F]"))


def _grouped(docs: DataFrame, threshold: float, block: int, most_bits: int) -> DataFrame:
    """(doc_id, text_hash, n, group_id, keep) of each distinct row with a word; n: how often it is repeated."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = _rows(docs).where(F.col("text").isNotNull()).mapInArrow(_signatures, f"doc_id {kind}, text_hash bigint, sig binary")
    signed = durable(signed.withColumn("node", F.xxhash64("sig")))
    counted = durable(signed.groupBy("node").agg(F.min("sig").alias("sig"), F.max("sig").alias("other"), F.count("*").alias("n")))
    clash = counted.where("sig <> other")
    if not clash.isEmpty():  # two signatures of one number: the higher ones get numbers of their own
        low = clash.select("node", F.col("sig").alias("low"))
        signed = signed.join(low, "node", "left").withColumn("node", F.when(F.col("sig") > F.col("low"), F.xxhash64("sig", F.lit(1))).otherwise(F.col("node"))).drop("low")
        signed = durable(signed)
        counted = durable(signed.groupBy("node").agg(F.min("sig").alias("sig"), F.count("*").alias("n")))
    roots = counted.select("node", "n").join(groups(counted, threshold, block, most_bits), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = durable(roots)
    first = lambda: F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash")))
    # The first row of a node is found before nodes meet, so no group passes through a task row by row.
    of_node = signed.groupBy("node").agg(first().alias("first"))
    by_root = roots.join(of_node, "node").groupBy("root").agg(F.min("first").alias("first"))
    named = durable(roots.join(by_root, "root").select("node", "n", F.col("first.doc_id").alias("group_id"), F.col("first.text_hash").alias("group_hash")))
    rows = join_split(signed.select("doc_id", "text_hash", "node"), named, "node")
    keep = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("group_hash"))
    return rows.select("doc_id", "text_hash", "group_id", keep.alias("keep")).groupBy("doc_id", "text_hash", "group_id", "keep").agg(F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, group_id and keep of every row."""
    found = _grouped(docs, threshold, block, most_bits)
    # Repeated rows are unrolled in two steps, so no array grows with their number.
    step = 10_000
    blocks = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))).alias("block"))
    size = F.least(F.lit(step), F.col("n") - F.col("block") * step)
    times = blocks.select("doc_id", "group_id", "keep", "block", F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("copy"))
    each = times.select("doc_id", "group_id", (F.col("keep") & (F.col("block") == 0) & (F.col("copy") == 1)).alias("keep"))
    return each.unionByName(_bare(_rows(docs)).select("doc_id", F.col("doc_id").alias("group_id"), F.lit(True).alias("keep")))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of `docs` that stay: one of each group."""
    found = durable(_grouped(docs, threshold, block, most_bits).where("not keep or n > 1"))
    key, hash_, other_id, other_hash, keep = unused(docs, "key", "text_hash", "other_id", "other_hash", "keep")
    decided = durable(found.select(F.xxhash64("doc_id", "text_hash").alias("h"), "doc_id", "text_hash", "keep"))
    own = docs.withColumn(hash_, text_key()).withColumn(key, F.xxhash64("doc_id", hash_))
    untouched, perhaps = sift(own, key, decided.select("h"), most_bits)
    on = F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(hash_) == F.col(other_hash))
    met = perhaps.join(decided.select("doc_id", "text_hash", "keep").toDF(other_id, other_hash, keep), on, "left")
    columns = [column(c) for c in docs.columns]
    # Of rows repeated as to doc_id and text one stays: that which comes first as JSON.
    whole = F.struct(*columns)
    once = met.where(F.col(keep)).groupBy(other_id, other_hash).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    out = untouched.select(*columns).unionByName(met.where(F.col(keep).isNull()).select(*columns))
    return out.unionByName(once.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
