"""Operator 5: exact deduplication by Grace hash partitioning.

1. Keys (hash of the content) are counted; only contents whose key occurs again can have a copy.
   A filter of bounded size tells the others, which stay where they are.
2. Rows of repeated keys are combined where they are read: a table of bounded size keeps one
   copy of each content, and its rows get the number of that block, so a content of a million
   copies leaves a task once, however its rows are spread.
3. The keys are partitioned recursively: a bucket whose distinct contents exceed `BUCKET_BYTES`
   is split by the next bits of the hash, until every bucket fits or holds one key.
4. The blocks' contents are spilled by hash (the shuffle files: a folder of a machine would be
   lost with its executor), sorted by bucket, and each bucket goes through a table with open
   addressing that compares complete contents, so equal hashes of unlike contents stay apart.
5. Rows meet the group of their block again by the block's number, of which a task makes one for
   at most `COMBINE_ROWS` rows: no list of ids is ever built, and no key of this join is hot.

Result: doc_id, group_id (the smallest doc_id with that content) and keep (true for one row of
each content). Defined cases: null text has no copy and is kept, with its own doc_id as group;
empty texts are copies of each other; rows with a null doc_id come last in their group; of
repeated rows one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.sieve import MOST_BITS, sift
from tessella.session import durable

#: Bytes of distinct content that one bucket's table may hold; bits of each level of splitting.
BUCKET_BYTES, BITS = 16 << 20, 6
#: Bytes of content, and rows, that the combining table of a task takes before it starts anew.
COMBINE_BYTES, COMBINE_ROWS = 16 << 20, 50_000


class OpenTable:
    """Open addressing with linear probing; equality is that of the complete content."""

    def __init__(self, bits: int = 10):
        self.slots = np.full(1 << bits, -1, np.int64)
        self.hashes: list[int] = []
        self.items: list[bytes] = []

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """(number of the content, whether it is new)."""
        if 2 * len(self.items) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        i = h & mask
        while (k := int(self.slots[i])) >= 0:
            if self.hashes[k] == h and self.items[k] == content:
                return k, False
            i = (i + 1) & mask
        self.slots[i] = len(self.items)
        self.hashes.append(h)
        self.items.append(content)
        return len(self.items) - 1, True

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = k


def bucket_plan(keys: DataFrame, limit: int = BUCKET_BYTES, bits: int = BITS) -> DataFrame:
    """(h, bucket) of repeated keys: level and leading bits of h, deep enough for the bucket to fit."""
    done, rest, level = None, keys.select("h", "n_bytes"), 0
    while True:
        level += 1
        path = F.shiftrightunsigned("h", max(0, 64 - bits * level))
        rest = rest.withColumn("bucket", F.concat_ws("/", F.lit(level), path.cast("string")))
        sizes = rest.groupBy("bucket").agg(F.sum("n_bytes").alias("total"), F.countDistinct("h").alias("kinds"))
        large = sizes.where((F.col("total") > limit) & (F.col("kinds") > 1)).select("bucket")
        if bits * level >= 64 or large.isEmpty():
            out = rest.select("h", "bucket")
            return out if done is None else done.unionByName(out)
        fits = rest.join(large, "bucket", "left_anti").select("h", "bucket")
        done = fits if done is None else done.unionByName(fits)
        rest = durable(rest.join(large, "bucket", "left_semi").drop("bucket"))


def _order(doc_id) -> tuple:
    return doc_id is None, 0 if doc_id is None else doc_id


def _combine(id_type: pa.DataType, most_bytes: int, most_rows: int):
    """(doc_id, block, lead, h, text) of every row; h and text stand only in the row of a block whose id is smallest, its lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = int(uuid.uuid4().int >> 64) >> 1  # stored at once, so what is computed again is never mixed with this
        made, rows = 0, []

        def flush() -> pa.RecordBatch:
            least: dict[int, int] = {}
            for i, (d, k) in enumerate(rows):
                if k not in least or _order(d) < _order(rows[least[k]][0]):
                    least[k] = i
            lead = np.zeros(len(rows), bool)
            lead[list(least.values())] = True
            h = [hashes[k] if x else None for (_, k), x in zip(rows, lead)]
            text = [table.items[k].decode() if x else None for (_, k), x in zip(rows, lead)]
            names = [f"{task:x}-{made}-{k}" for _, k in rows]
            cols = [pa.array([d for d, _ in rows], id_type), pa.array(names, pa.string()), pa.array(lead), pa.array(h, pa.int64()), pa.array(text, pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "block", "lead", "h", "text"])

        table, hashes, held = OpenTable(), [], 0
        for b in batches:
            for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.encode()
                k, new = table.find(h & 0xFFFFFFFFFFFFFFFF, raw)
                if new:
                    hashes.append(h)
                    held += len(raw)
                rows.append((d, k))
                if held > most_bytes or len(rows) >= most_rows:
                    yield flush()
                    table, hashes, held, rows, made = OpenTable(), [], 0, [], made + 1
        if rows:
            yield flush()

    return run


def _resolve(id_type: pa.DataType):
    """Blocks come by key, so by bucket, and then by smallest id: the first of a content names the group.

    Before the blocks of a repeated key comes a row with its bucket; a key without one isn't repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names, now, key = OpenTable(), [], None, None
        for b in batches:
            block, group, first = [], [], []
            for bucket, h, doc_id, name, t in zip(*(b.column(i).to_pylist() for i in range(5))):
                if bucket is not None:
                    key = h
                    if bucket != now:
                        table, names, now = OpenTable(), [], bucket
                    continue
                block.append(name)
                if h != key:
                    group.append(doc_id)
                    first.append(True)
                    continue
                k, new = table.find(h & 0xFFFFFFFFFFFFFFFF, t.encode())
                if new:
                    names.append(doc_id)
                group.append(names[k])
                first.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.string()), pa.array(group, id_type), pa.array(first, pa.bool_())], names=["block", "group_id", "first"])

    return run


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, combine_bytes: int = COMBINE_BYTES, combine_rows: int = COMBINE_ROWS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, group_id and keep of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    rows = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h"), "text")
    keys = rows.where(F.col("h").isNotNull()).select("h", F.octet_length("text").alias("n_bytes"))
    repeated = durable(keys.groupBy("h").agg(F.count("*").alias("n"), F.max("n_bytes").cast("long").alias("n_bytes")).where("n > 1").drop("n"))
    plan = bucket_plan(repeated, bucket_bytes)
    single, again = sift(rows, "h", repeated.select("h"), most_bits)
    alone = single.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(True).alias("keep"))
    combined = durable(again.mapInArrow(_combine(arrow, combine_bytes, combine_rows), f"doc_id {name}, block string, lead boolean, h bigint, text string"))
    # One shuffle for contents and buckets together; a bucket is a range of the unsigned key.
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", kind), ("block", "string"), ("text", "string"))]
    spilled = combined.where("lead").select(F.lit(None).cast("string").alias("bucket"), "h", "doc_id", "block", "text").unionByName(plan.select("bucket", "h", *none))
    spilled = spilled.repartition("h").sortWithinPartitions(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), F.col("bucket").asc_nulls_last(), F.col("doc_id").asc_nulls_last())
    found = spilled.mapInArrow(_resolve(arrow), f"block string, group_id {name}, first boolean")
    grouped = combined.select("doc_id", "block", "lead").join(found, "block")
    return alone.unionByName(grouped.select("doc_id", "group_id", (F.col("lead") & F.col("first")).alias("keep")))
