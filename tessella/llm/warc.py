"""Operator 2: fixity audit of archived pages by Merkle trees.

Every page is written as a record of the WARC format and hashed. Records lie in archive files
in the order of page_id. A leaf is an ordered range of one file: it hashes, for each record in
order, the offset from the leaf's beginning, the length and the hash of the record. A node hashes
number, length and hash of its children in order, at most `FANOUT` of them, so every node covers an
ordered range of offsets; levels are built until one root is left. Two replicas are compared from
the root down; only children of nodes that differ are looked at, and only in leaves that differ are
records compared.

Ranges are of page_id, not of rank, and offsets count from the leaf's beginning, so a record lost
or added changes one leaf and not all that follow. Equal records are counted where they are read,
and move and are hashed once with their number, so a record repeated very often is one row; a leaf
of very many unlike records is hashed in blocks of `BLOCK`.

Defined cases: a null page_id, and one of a type other than an integer, lies in ranges by the hash
of its record or of itself; null url or html count as empty; repeated rows are records of their
own, matched by their order; empty tables are a tree without nodes; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessella.session import durable

#: Ids of a leaf and children of a node, as powers of two; records of a leaf that are hashed at once.
LEAF_BITS, FANOUT_BITS, BLOCK = 6, 6, 4096
FANOUT = 1 << FANOUT_BITS


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record, as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame) -> DataFrame:
    """One row for n equal records: leaf, page_id, how many records of that id come before, length, offset of the first in the file, hash.

    The text is hashed where it is read; only the rows of the manifest move.
    """
    r = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    rows = r.select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"))
    rows = rows.groupBy("page_id", "length", "digest").agg(F.count("*").alias("n"))
    spread = lambda c: -1 - F.pmod(F.xxhash64(c), F.lit(1 << 30))
    numbered = isinstance(pages.schema["page_id"].dataType, IntegralType)
    leaf = F.shiftright(F.col("page_id").cast("long"), LEAF_BITS) if numbered else spread("page_id")
    rows = rows.withColumn("leaf", F.when(F.col("page_id").isNull(), spread("digest")).otherwise(leaf))
    rows = rows.withColumn("file", F.shiftright("leaf", FANOUT_BITS))
    before = lambda w, what: F.coalesce(F.sum(what).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = Window.partitionBy("file").orderBy("leaf", "page_id", "digest")
    same = Window.partitionBy("file", "leaf", "page_id").orderBy("digest")
    return rows.select(
        "file", "leaf", "page_id", before(same, "n").alias("earlier"), "n", "length", "digest",
        before(w, F.col("length") * F.col("n")).alias("offset"), F.row_number().over(Window.partitionBy("file", "leaf").orderBy("page_id", "digest")).alias("place"),
    )


def _hashed(kids: DataFrame, key: str, order: str, *parts: Column) -> DataFrame:
    """(node, length, digest) over the kids in order."""
    line = F.concat_ws(":", *[p.cast("string") for p in parts])
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return kids.groupBy(key).agg(F.sum("length").alias("length"), F.sha2(F.concat_ws(",", lines), 256).alias("digest")).withColumnRenamed(key, "node")


def leaves_of(rows: DataFrame) -> DataFrame:
    """(node, length, digest) of the leaves of a manifest."""
    begin = F.min("offset").over(Window.partitionBy("file", "leaf"))
    rows = rows.select("leaf", F.floor(F.col("place") / BLOCK).alias("block"), "place", (F.col("offset") - begin).alias("offset"), "n", F.col("length").alias("each"), (F.col("length") * F.col("n")).alias("length"), "digest")
    rows = rows.withColumn("id", F.struct("leaf", "block"))
    blocks = _hashed(rows, "id", "place", F.col("offset"), F.col("each"), F.col("n"), F.col("digest"))
    blocks = blocks.select(F.col("node.leaf").alias("leaf"), F.col("node.block").alias("block"), "length", "digest")
    return _hashed(blocks, "leaf", "block", F.col("block"), F.col("length"), F.col("digest"))


def trees(a: DataFrame, b: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of two replicas over their stored leaves, up to one root each; a walk down reads them and builds nothing again."""
    levels = [(a, b)]
    while True:
        few = max(x.count() for x in levels[-1]) <= FANOUT
        up = F.lit(0).cast("long") if few else F.shiftright("node", FANOUT_BITS)
        levels.append(tuple(durable(_hashed(x.withColumn("up", up), "up", "node", F.col("node"), F.col("length"), F.col("digest"))) for x in levels[-1]))
        if few:
            return [x for x, _ in levels], [y for _, y in levels]


def differing_leaves(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Leaves to which a path of differing nodes leads from the root."""
    suspects = None
    for k in range(len(a) - 1, -1, -1):
        x, y = a[k], b[k]
        if suspects is not None:
            parent = (F.lit(0).cast("long") if k == len(a) - 2 else F.shiftright("node", FANOUT_BITS)).alias("up")
            hit = suspects.withColumnRenamed("node", "up")
            x, y = (n.select("*", parent).join(hit, "up", "left_semi").drop("up") for n in (x, y))
        y = y.select("node", F.col("digest").alias("other"))
        suspects = durable(x.join(y, "node", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("node"))
    return suspects


def _each(rows: DataFrame) -> DataFrame:
    """The records of rows of the manifest one by one, unrolled in two steps so that no array grows with their number."""
    step = 10_000
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))).alias("block"))
    size = F.least(F.lit(step), F.col("n") - F.col("block") * step)
    one = blocks.select("*", F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("i")).withColumn("i", F.col("block") * step + F.col("i"))
    return one.select("file", "leaf", "page_id", (F.col("earlier") + F.col("i")).alias("copy"), "length", "digest", (F.col("offset") + (F.col("i") - 1) * F.col("length")).alias("offset"))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which replica `b` differs from `a`: corrupt, missing in b, or extra in b."""
    ma, mb = durable(manifest(a)), durable(manifest(b))
    ta, tb = trees(durable(leaves_of(ma)), durable(leaves_of(mb)))
    leaves = differing_leaves(ta, tb).withColumnRenamed("node", "leaf")
    x, y = (_each(m.join(leaves, "leaf", "left_semi")) for m in (ma, mb))
    on = F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.leaf") == F.col("y.leaf")) & (F.col("x.copy") == F.col("y.copy"))
    both = x.alias("x").join(y.alias("y"), on, "full_outer").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
    status = F.when(F.col("y.digest").isNull(), "missing").when(F.col("x.digest").isNull(), "extra").otherwise("corrupt")
    return both.select(
        F.coalesce("x.page_id", "y.page_id").alias("page_id"), status.alias("status"),
        F.coalesce("x.leaf", "y.leaf").alias("leaf"), F.coalesce("x.file", "y.file").alias("file"),
        F.col("x.offset").alias("expected_offset"), F.col("x.length").alias("expected_length"), F.col("y.length").alias("actual_length"),
        F.col("x.digest").alias("expected_sha256"), F.col("y.digest").alias("actual_sha256"),
    )


def injected(pages: DataFrame) -> DataFrame:
    """A second replica with faults: by the hash of page_id a record is changed, lost or there twice."""
    h = F.md5(F.col("page_id").cast("string"))
    changed, lost, twice = (F.coalesce((h >= x) & (h < y), F.lit(False)) for x, y in (("00", "10"), ("f0", "f8"), ("f8", "g")))
    copies = F.when(lost, F.array().cast("array<int>")).when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    html = F.when(changed, F.concat("html", F.lit("\u0000"))).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"), F.explode(copies).alias("copy")).drop("copy")
