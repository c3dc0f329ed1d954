"""Whether an answer's citations hold, and whether its claims were judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella.functions import cite

VERDICTS = ("supported", "partial", "refuted", "unsupported")


def parse(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, raw, path, start, end) of every citation."""
    return docs.select(key, F.explode(cite.citations(F.col(text))).alias("c")).select(key, "c.*")


def check(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations with `status` (resolved, unresolved or ignored) and `reason`; files: rel, lines.

    A path with a slash must be in the index; without one it is taken for prose.
    """
    j = citations.join(files.select(F.col("rel").alias("path"), F.col("lines").cast("long").alias("lines")), "path", "left")
    n, s, e = F.col("lines"), F.col("start"), F.col("end")
    span = F.concat(F.lit(" out of range (1-"), n.cast("string"), F.lit(")"))
    reason = (
        F.when(n.isNull() & F.col("path").contains("/"), "no such file in the index")
        .when(n.isNotNull() & s.isNotNull() & ((s < 1) | (s > n)), F.concat(F.lit("line "), s.cast("string"), span))
        .when(n.isNotNull() & e.isNotNull() & ((e < F.coalesce(s, F.lit(1))) | (e > n)), F.concat(F.lit("line range "), s.cast("string"), F.lit("-"), e.cast("string"), span))
    )
    j = j.withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "unresolved").when(n.isNull(), "ignored").otherwise("resolved")
    return j.select(*citations.columns, status.alias("status"), "reason")


def claim_units(text: Column) -> Column:
    """Paragraphs and list items of an answer, without headings and fenced code."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", "\n\n"), r"(?s)~~~.*?~~~", "\n\n")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:#{1,6} .*)$", "\n")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+", "\n\n")
    return F.filter(F.transform(F.split(t, r"\n[ \t]*\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))), lambda x: x != "")


def claim_pairs(answers: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, claim_id, claim, citation, path, digest): every claim with every citation it makes
    whose lines can be read and aren't blank. sources: rel, text.
    """
    units = answers.select(key, F.posexplode(claim_units(F.col("text"))).alias("place", "claim"))
    cited = units.select(key, "place", "claim", F.explode(cite.citations(F.col("claim"))).alias("c"))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("place"))
    rows = cited.select(key, F.concat(F.lit("C"), number.cast("string")).alias("claim_id"), "claim", "c.*").withColumnRenamed("raw", "citation")
    # A source is cut into lines once, before its citations multiply it.
    lines = sources.select(F.col("rel").alias("path"), F.split("text", "\r?\n").alias("lines"))
    first = F.greatest(F.lit(1), F.coalesce("start", F.lit(1)))
    last = F.when(F.col("start").isNull(), F.size("lines")).otherwise(F.coalesce("end", "start"))
    excerpt = F.array_join(F.slice("lines", first, F.greatest(F.lit(0), last - first + 1)), "\n")
    # A filter on the excerpt would be pushed below and work it out twice; a generator does it once.
    shown = F.explode(F.filter(F.array(excerpt), lambda x: x.rlike(r"\S"))).alias("excerpt")
    return rows.join(lines, "path").select(key, "claim_id", "claim", "citation", "path", shown).withColumn("digest", F.sha1("excerpt")).drop("excerpt")


def reduce_verdicts(verdicts: DataFrame) -> DataFrame:
    """(claim_id, ok, judged): a claim fails if any citation refutes it, or if all are judged and none supports it."""
    bad = F.bool_or(F.col("verdict") == "refuted")
    good = F.bool_or(F.col("verdict").isin("supported", "partial"))
    judged = F.bool_and(F.col("verdict").isNotNull())
    known = F.col("verdict").isin(*VERDICTS) | F.col("verdict").isNull()
    checked = verdicts.withColumn("verdict", F.when(known, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), "verdict"))))
    out = checked.groupBy("claim_id").agg(F.coalesce(bad, F.lit(False)).alias("bad"), F.coalesce(good, F.lit(False)).alias("good"), judged.alias("judged"))
    return out.select("claim_id", (~F.col("bad") & ~(F.col("judged") & ~F.col("good"))).alias("ok"), "judged")


def coverage(pairs: DataFrame, verdicts: DataFrame, most: int = C.MAX_CLAIMS) -> DataFrame:
    """One row: expected pairs, those judged under the same claim, citation and digest, and ok.

    None judged fails; some missing fails unless there are more pairs than a worklist holds.
    """
    keys = ["claim", "citation", "digest"]
    p = pairs.select(*keys).distinct()
    done = p.join(verdicts.where("verdict is not null").select(*keys).distinct().withColumn("judged", F.lit(1)), keys, "left")
    n = done.agg(F.count("*").alias("expected"), F.count("judged").alias("judged"))
    e, j = F.col("expected"), F.col("judged")
    return n.select("expected", "judged", ((e == 0) | ((j > 0) & ((j == e) | (e > most)))).alias("ok"))


def backfill(verdicts: DataFrame, worklist: DataFrame) -> DataFrame:
    """Verdicts with the digest, where they lack it, of the worklist's row."""
    w = worklist.select("claim_id", "citation", F.col("digest").alias("listed"))
    j = verdicts.join(w, ["claim_id", "citation"], "left")
    return j.withColumn("digest", F.coalesce(F.nullif("digest", F.lit("")), "listed")).drop("listed")


def drifted(citations: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Cited files whose content is no longer what the index saw."""
    r, c = recorded.select(F.col("rel").alias("path"), F.col("hash").alias("old")), current.select(F.col("rel").alias("path"), F.col("hash").alias("new"))
    return citations.select("path").distinct().join(r, "path").join(c, "path", "left").where(~F.col("old").eqNullSafe(F.col("new"))).select("path")
