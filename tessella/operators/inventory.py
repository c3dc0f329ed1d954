"""What was scanned: hashes, caps, rollups, differences between two scans, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.constants import CHARS_PER_TOKEN, MAX_BYTES, MAX_SCAN_FILES


def content_hash(text: Column) -> Column:
    """The name of a content."""
    return F.sha1(text)


def short_hash(text: Column, n: int = 8) -> Column:
    """The first signs of the hash."""
    return F.substring(F.sha1(text), 1, n)


def cap_bytes(files: DataFrame, size: Column, limit: int = MAX_BYTES) -> DataFrame:
    """Files of at most `limit` bytes; the filter reaches the scan."""
    return files.where(size <= limit)


def cap_files(files: DataFrame, limit: int = MAX_SCAN_FILES, key: str = "rel") -> DataFrame:
    """The first `limit` files by path, with `capped` telling whether there were more.

    A top-k, so no task sorts all; one more row than the cap tells whether it bit.
    """
    top = files.orderBy(key).limit(limit + 1)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(key)))
    return numbered.withColumn("capped", F.count("*").over(Window.partitionBy(F.lit(0))) > limit).where(F.col("position") <= limit)


def histogram(files: DataFrame, by: str, top: int) -> DataFrame:
    """The `top` most frequent values and their counts."""
    return files.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(top)


def rollup_modules(files: DataFrame) -> DataFrame:
    """Members, symbols, lines and degree of each module."""
    return files.groupBy(F.col("module").alias("slug")).agg(
        F.count("*").alias("members"), F.sum("symbols").alias("symbols"), F.sum("lines").alias("lines"),
        F.sum(F.col("deg_in") + F.col("deg_out")).alias("degree"),
    )


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(rel, change) of files added, changed or removed between two tables (rel, hash)."""
    b, n = before.select("rel", F.col("hash").alias("old")), now.select("rel", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return b.join(n, "rel", "full_outer").select("rel", change.alias("change")).where(F.col("change").isNotNull())


def reuse(files: DataFrame, cache: DataFrame, full_hash: bool = True) -> DataFrame:
    """Files with `action`: reuse the cached extraction or extract anew.

    By hash; with `full_hash` off a code file of the same size and time is trusted, a doc never.
    """
    c = cache.select("rel", *[F.col(x).alias(f"cached_{x}") for x in cache.columns if x != "rel"])
    same = F.col("hash") == F.col("cached_hash")
    if not full_hash:
        same = same | ((F.col("kind") != "doc") & (F.col("size") == F.col("cached_size")) & (F.col("mtime") == F.col("cached_mtime")))
    return files.join(c, "rel", "left").withColumn("action", F.when(F.coalesce(same, F.lit(False)), "reuse").otherwise("extract")).select(*files.columns, "action")


def without(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of `left` that have no partner."""
    return left.join(right, on, "left_anti")


def count_by_reason(dangling: DataFrame) -> DataFrame:
    """Dangling links by why they dangle."""
    return dangling.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def cap_per_group(rows: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    """The first `cap` rows of each group, with `more`: how many were left out."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - cap, F.lit(0).cast("long")))
    return ranked.where(F.col("position") <= cap)


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Rows with the number of their batch within the group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("long"))


def budget_prefix(parts: DataFrame, group: str, position: str, length: str, tokens: int) -> DataFrame:
    """Parts in order, whole while they fit the budget, then one cut, the rest dropped.

    Adds `taken` (characters) and `state`: whole, cut or dropped.
    """
    w = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    limit = F.lit(tokens * CHARS_PER_TOKEN)
    used = F.sum(length).over(w)
    before = used - F.col(length)
    state = F.when(used <= limit, "whole").when(before < limit, "cut").otherwise("dropped")
    taken = F.when(used <= limit, F.col(length)).otherwise(F.greatest(limit - before, F.lit(0)))
    return parts.withColumn("taken", taken.cast("long")).withColumn("state", state)


def token_meter(rows: DataFrame, by: str, chars: str) -> DataFrame:
    """Tokens (four characters each, rounded up) by task, and a total row with a null task."""
    tokens = F.ceil(F.col(chars) / 4)
    return rows.rollup(by).agg(F.sum(tokens).cast("long").alias("tokens"), F.count("*").alias("n"), F.grouping(by).cast("int").alias("is_total"))


def line_range(files: DataFrame, text: str, start: int, end: int) -> DataFrame:
    """Lines `start` to `end` (from 1) of each text."""
    lines = F.split(text, "\r?\n")
    return files.withColumn("excerpt", F.array_join(F.slice(lines, start, end - start + 1), "\n")).withColumn("total_lines", F.size(lines).cast("long"))
