"""Operator 10: mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled (by a hash of seed and id). Each gets a virtual finish
time: the tokens of its source up to and with it, divided by the source's weight. Documents are
sorted by it over all sources, and the order is cut where the tokens reach the budget: at every
cut the sources have contributed by their weights, as long as they last.

Both running sums, of a source and of the whole, are taken in two levels. The rows, which are
light, are cut into ranges of equal numbers of rows by quantiles of the whole sort key, to which a
number of its own is added for each row, so no source, no stretch of virtual time and no repeated row
makes a range larger than others. What came before a range is one number for it (only the source
in which it begins can have come before), at most `MOST_RANGES` in all; within it rows are summed
one by one. Of the documents only those move that are taken, as far as a filter of bounded size
can tell: to the sort-merge join with their times, and to the global range sort.

Defined cases: a null source is a source of its own; a null doc_id is shuffled as the empty
string; null or blank text has 0 tokens; rows equal in source and key are repeated rows, taken
in the order of doc_id and text hash, and where those are equal too any that are equal in all
columns, else those that come first as JSON; sources without a weight get `DEFAULT_WEIGHT`, weights of
0 or less leave a source out; a document that would pass the budget ends the mixture; an empty table
gives an empty result; other columns are ignored, or pass unchanged in `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import numbered
from tessella.operators.sieve import MOST_BITS, join_split, sift
from tessella.session import column, durable, unused

WEIGHTS, DEFAULT_WEIGHT = {"src0": 4.0, "src1": 2.0, "src2": 2.0}, 1.0
#: Tokens to take, as a share of all; seed of the shuffle.
BUDGET_SHARE, SEED = 0.5, "mix-1"
#: Rows that a range should hold, and the number of ranges at most.
RANGE_ROWS, MOST_RANGES = 20_000, 20_000


def n_tokens(text: Column) -> Column:
    """Tokens as the mixture counts them: runs of signs other than white space."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\r\n]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def shuffle_key(seed: str) -> Column:
    """The place of a document among those of its source."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _ranges(df: DataFrame, count: int, order: list[str]) -> DataFrame:
    """`df` in ranges of the order, stored; `range` numbers them."""
    n = min(MOST_RANGES, count // RANGE_ROWS) + 1
    return durable(df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))


def _sum_within(cut: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """`cut` with the running sum of n_tokens in each range (and `by`)."""
    own = Window.partitionBy("range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(name, F.sum("n_tokens").over(own))


def _mixture(docs: DataFrame, weights: dict[str, float] | None, budget_share: float, seed: str, default_weight: float) -> tuple[DataFrame, DataFrame]:
    """The stored light rows of all documents, and those that are taken with virtual_finish and running_tokens."""
    weights = WEIGHTS if weights is None else weights
    weight = F.lit(float(default_weight))
    for s, v in sorted(weights.items()):
        weight = F.when(F.col("source") == s, F.lit(float(v))).otherwise(weight)
    rows = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), shuffle_key(seed).alias("key"), F.xxhash64("text").alias("text_hash"))
    rows = durable(rows.withColumn("weight", weight).where(F.col("weight") > 0).withColumn("tie", F.monotonically_increasing_id()))
    count, total = rows.agg(F.count("*"), F.sum("n_tokens")).collect()[0]
    budget = int((total or 0) * budget_share)
    place = ["source", "key", "doc_id", "text_hash", "tie"]
    cut = _ranges(rows, count, place)
    sums = cut.groupBy("range", "source").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    begun = sums.select("range", "source", (F.sum("t").over(w) - F.col("t")).alias("before"))
    begun = durable(begun.groupBy("range").agg(F.min(F.struct("source", "before")).alias("head")))
    fair = _sum_within(cut, ["source"], place, "own").join(F.broadcast(begun), "range")
    served = F.col("own") + F.when(F.col("source").eqNullSafe(F.col("head.source")), F.col("head.before")).otherwise(0)
    fair = fair.withColumn("virtual_finish", served / F.col("weight")).drop("range", "own", "head", "weight")
    order = ["virtual_finish", *place]
    cut = _ranges(fair, count, order)
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    before = cut.groupBy("range").agg(F.sum("n_tokens").alias("t"))  # one row a range
    before = durable(before.select("range", (F.sum("t").over(w) - F.col("t")).alias("before")))
    taken = _sum_within(cut.join(F.broadcast(before.where(F.col("before") <= budget)), "range"), [], order, "own")
    taken = taken.withColumn("running_tokens", F.col("own") + F.col("before")).where(F.col("running_tokens") <= budget)
    return rows, taken.drop("range", "own", "before")


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE, seed: str = SEED, default_weight: float = DEFAULT_WEIGHT
) -> DataFrame:
    """doc_id, source, n_tokens, virtual_finish and running_tokens of the mixture, in order."""
    _, taken = _mixture(docs, weights, budget_share, seed, default_weight)
    return taken.orderBy("virtual_finish", "source", "key", "doc_id", "text_hash", "running_tokens").select("doc_id", "source", "n_tokens", "virtual_finish", "running_tokens")


def mixed_documents(
    docs: DataFrame, weights: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE, seed: str = SEED, default_weight: float = DEFAULT_WEIGHT, most_bits: int = MOST_BITS
) -> DataFrame:
    """The rows of `docs` that the mixture takes, with virtual_finish and running_tokens, in its order.

    Columns of `docs` that have these names already are replaced. Of repeated rows as many are
    returned as the mixture takes; all carry the values of the first."""
    rows, mixed = _mixture(docs, weights, budget_share, seed, default_weight)
    same = ["doc_id", "text_hash", "source"]
    taken = mixed.groupBy(*same).agg(F.min("virtual_finish").alias("virtual_finish"), F.min("running_tokens").alias("running_tokens"), F.count("*").alias("n"), F.max("running_tokens").alias("last"))
    taken = durable(taken.withColumn("h", F.xxhash64(*same)))
    own = docs.select(*[column(c) for c in docs.columns if c.lower() not in ("virtual_finish", "running_tokens")])
    columns = [column(c) for c in own.columns]
    key, hash_, a, b, c, n = unused(own, "key", "text_hash", "other_id", "other_hash", "other_source", "n_taken")
    own = own.withColumn(hash_, F.xxhash64("text")).withColumn(key, F.xxhash64("doc_id", hash_, "source"))
    # Repeated rows follow each other, so only those at the cut can be taken in part.
    cut = taken.orderBy(F.desc("last"), F.desc("virtual_finish")).first()
    if cut is not None:
        here = lambda name: F.col("doc_id").eqNullSafe(F.lit(cut["doc_id"])) & (F.col(name) == cut["text_hash"]) & F.col("source").eqNullSafe(F.lit(cut["source"]))
        if rows.where(here("text_hash")).count() > cut["n"]:
            place = unused(own, "place")[0]
            some = numbered(own.where(here(hash_)), [F.to_json(F.struct(*columns))], place).where(F.col(place) <= cut["n"]).drop(place)
            own = own.where(~here(hash_)).unionByName(some)
    _, perhaps = sift(own, key, taken.select("h"), most_bits)
    side = taken.select("h", *same, "n", "virtual_finish", "running_tokens").toDF(key, a, b, c, n, "virtual_finish", "running_tokens")
    on = F.col("doc_id").eqNullSafe(F.col(a)) & (F.col(hash_) == F.col(b)) & F.col("source").eqNullSafe(F.col(c))
    out = join_split(perhaps, side, key, n).where(on)
    return out.select(*columns, "virtual_finish", "running_tokens").orderBy("virtual_finish", "running_tokens", "source", shuffle_key(seed), "doc_id")
