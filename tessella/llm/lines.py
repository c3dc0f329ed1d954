"""Operator 7: removal of lines that many documents share.

Lines are exploded, normalised (lower case, runs of white space made one, ends trimmed) and
hashed; a line that occurs in more than `MAX_DOCS` distinct documents is dropped wherever it
occurs, and the rest is put together by position. A document is a doc_id, so rows that repeat
an id are one; with `copies_once` rows of equal text are one document too, for corpora whose
copies are still to be removed: there a copied document doesn't lose its lines for being copied.

While counting only hashes move, combined on the map side. Of the texts only those move that hold
a common line (as far as a filter of bounded size can tell): they meet the positions to drop
in a sort-merge join, whatever their number; texts with very many copies, of which there can be few,
get theirs by broadcast (a text of c copies in n rows has at most 1/c of all characters).

Defined cases: null text stays null; a row with a null doc_id is a document by its text; blank
lines are never counted or dropped; a line repeated within a document counts once and goes
everywhere; a document that loses every line keeps its row with an empty text; repeated rows are
each cleaned; an empty table gives an empty result; columns other than text and n_chars pass
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.sieve import MOST_BITS, join_split, sift
from tessella.session import column, durable, unused

#: Distinct documents that may share a line.
MAX_DOCS = 10


def normalised(line: Column) -> Column:
    """The form under which lines are equal."""
    return F.trim(F.regexp_replace(F.lower(line), "[ \t\r\f\v]+", " "))


def line_hashes(text: Column) -> Column:
    """Hashes of the lines in order, null for blank ones."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(normalised(x) != "", F.xxhash64(normalised(x))))


def drop_plan(docs: DataFrame, max_docs: int = MAX_DOCS, copies_once: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """(text_hash, dropped, n): positions of the lines to drop, for each distinct text that has some, and its rows."""
    text = F.xxhash64("text")
    document = text if copies_once else F.when(F.col("doc_id").isNull(), text).otherwise(F.xxhash64("doc_id"))
    rows = docs.where(F.col("text").isNotNull()).select(document.alias("document"), text.alias("text_hash"), line_hashes(F.col("text")).alias("hashes"))
    rows = durable(rows)
    each = rows.select("document", F.explode(F.array_distinct("hashes")).alias("line")).where(F.col("line").isNotNull())
    common = each.distinct().groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    common = durable(common.select("line"))
    lines = rows.select("text_hash", F.posexplode("hashes").alias("position", "line"))
    _, perhaps = sift(lines, "line", common, most_bits)
    # Copies say the same, and a line of most documents is one line: both are combined before the join.
    perhaps = durable(perhaps.distinct())
    sizes = durable(perhaps.groupBy("line").agg(F.count("*").alias("n")).join(common, "line", "left_semi"))
    dropped = join_split(perhaps, sizes, "line").groupBy("text_hash").agg(F.sort_array(F.collect_list("position")).alias("dropped"))
    return dropped.join(rows.groupBy("text_hash").agg(F.count("*").alias("n")), "text_hash")


def drop_common_lines(docs: DataFrame, max_docs: int = MAX_DOCS, copies_once: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """`docs` without the lines that more than `max_docs` distinct documents share."""
    plan = durable(drop_plan(docs, max_docs, copies_once, most_bits))
    key, dropped, n, split = unused(docs, "text_hash", "dropped", "n", "split")
    untouched, perhaps = sift(docs.withColumn(key, F.xxhash64("text")), key, plan.select("text_hash"), most_bits)
    joined = join_split(perhaps, plan.toDF(key, dropped, n), key, n, "left").withColumn(split, F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(dropped))
    kept = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    hit = F.col("text").isNotNull() & F.col(dropped).isNotNull()
    new = {"text": F.when(hit, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(hit, F.length(kept).cast(kind)).otherwise(F.col("n_chars"))
    cleaned = joined.select(*[new[c].alias(c) if c in new else column(c) for c in docs.columns])
    return untouched.select(*[column(c) for c in docs.columns]).unionByName(cleaned)
