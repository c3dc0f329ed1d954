"""What a change touches and how risky that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella.operators.ordering import share_below


def staleness_gate(diff: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(path, problem) of files that a diff names and the index knows, but in another state.

    diff: path, status, old_path; recorded and current: rel, hash. Only files of the diff are
    looked at. Files the index never knew are a note, not a problem.
    """
    named = diff.select("path", "status").unionByName(diff.where("status = 'renamed' and old_path is not null").select(F.col("old_path").alias("path"), F.lit("renamed-from").alias("status")))
    r, c = recorded.select(F.col("rel").alias("path"), F.col("hash").alias("old")), current.select(F.col("rel").alias("path"), F.col("hash").alias("new"))
    j = named.join(r, "path", "left").join(c, "path", "left")
    problem = (
        F.when(F.col("old").isNull(), "unindexed").when(F.col("status").isin("deleted", "renamed-from"), F.col("status"))
        .when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "changed")
    )
    return j.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def hunk_symbols(hunks: DataFrame, defs: DataFrame) -> DataFrame:
    """Symbols whose lines a hunk overlaps, the innermost first (position 1).

    The path is the equi key of the join; lines are a filter within it.
    """
    h = hunks.select(F.col("path").alias("file"), "start", "end")
    j = h.join(defs.where("end_line is not null"), "file").where("line <= end and end_line >= start")
    w = Window.partitionBy("file", "start", "end").orderBy((F.col("end_line") - F.col("line")).asc(), F.desc("line"), "name")
    return j.select("file", "start", "end", "name", "line", "end_line", F.row_number().over(w).alias("position"))


def hunk_above(hunks: DataFrame, defs: DataFrame) -> DataFrame:
    """For each hunk the nearest definition at or above its start, among those without an end.

    Definitions and hunks of a path are one sorted stream, and the last definition seen is
    carried forward: no pairs are formed.
    """
    d = defs.where("end_line is null").select("file", F.col("line").alias("at"), F.lit(0).alias("kind"), F.struct("line", "name").alias("def"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    h = hunks.select(F.col("path").alias("file"), F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(d.schema["def"].dataType).alias("def"), "start", "end")
    w = Window.partitionBy("file").orderBy("at", "kind", F.col("def.name")).rowsBetween(Window.unboundedPreceding, 0)
    seen = d.unionByName(h).withColumn("def", F.last("def", ignorenulls=True).over(w)).where("kind = 1 and def is not null")
    return seen.select("file", "start", "end", F.col("def.name").alias("name"), F.col("def.line").alias("line"), F.lit(True).alias("approx"))


def blast_level(files: Column, modules: Column) -> Column:
    """high, medium or null, by how many files and modules depend on a change."""
    high = (files >= C.BLAST_HIGH_FILES) | (modules >= C.BLAST_HIGH_MODULES)
    return F.when(high, "high").when((files >= C.BLAST_MEDIUM_FILES) | (modules >= C.BLAST_MEDIUM_MODULES), "medium")


def risk(signals: DataFrame) -> DataFrame:
    """Score, bucket and reasons of changed modules, riskiest first.

    signals: slug, exported, test_gap, dangling, surprise (booleans), dependents, dependent_modules, percentile.
    """
    blast = blast_level(F.col("dependents"), F.col("dependent_modules"))
    hub = F.when(F.col("percentile") >= C.HUB_HIGH, "high").when(F.col("percentile") >= C.HUB_MEDIUM, "medium")
    told = F.concat(F.col("dependents").cast("string"), F.lit(" dependent files across "), F.col("dependent_modules").cast("string"), F.lit(f" modules (depth {C.DELTA_DEPTH})"))
    parts = [
        (F.col("exported"), "exported", F.lit("exported symbol changed")), (F.col("test_gap"), "test_gap", F.lit("no test covers it")),
        (F.col("dangling"), "dangling", F.lit("dangling import")), (blast == "high", "blast_high", told), (blast == "medium", "blast_medium", told),
        (hub == "high", "hub_high", F.lit("hub module")), (hub == "medium", "hub_medium", F.lit("well-linked module")), (F.col("surprise"), "surprise", F.lit("surprising link")),
    ]
    score, reasons = F.lit(0), []
    for when, name, words in parts:
        score = score + F.when(F.coalesce(when, F.lit(False)), C.RISK[name]).otherwise(0)
        reasons.append(F.when(F.coalesce(when, F.lit(False)), words))
    bucket = F.when(F.col("score") >= C.BUCKET_HIGH, "HIGH").when(F.col("score") >= C.BUCKET_MEDIUM, "MEDIUM").otherwise("LOW")
    out = signals.withColumn("score", score).withColumn("reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    return out.select("slug", "score", bucket.alias("bucket"), "reasons").orderBy(F.desc("score"), "slug")


def partition(diff: DataFrame, files: DataFrame) -> DataFrame:
    """Changed paths with their class: binary, deleted, unindexed or indexed (with its module)."""
    j = diff.join(files.select(F.col("rel").alias("path"), "module"), "path", "left")
    kind = F.when(F.coalesce("binary", F.lit(False)), "binary").when(F.col("status") == "deleted", "deleted").when(F.col("module").isNull(), "unindexed").otherwise("indexed")
    return j.select("path", "module", kind.alias("class"))


def signals(diff: DataFrame, hunks: DataFrame, files: DataFrame, modules: DataFrame, defs: DataFrame, edges: DataFrame, surprising: DataFrame, dependents: DataFrame) -> DataFrame:
    """The inputs of `risk` for every module a diff touches.

    dependents: slug, dependents, dependent_modules (the closure of each changed module).
    """
    changed = partition(diff, files).where("class = 'indexed'").select("path", F.col("module").alias("slug"))
    slugs = changed.select("slug").distinct()
    hit = hunk_symbols(hunks, defs).select("file", "name", "line").unionByName(hunk_above(hunks, defs).select("file", "name", "line"))
    exported = hit.join(defs.where("exported").select("file", "name", "line"), ["file", "name", "line"], "left_semi").select(F.col("file").alias("path")).join(changed, "path").select("slug").distinct().withColumn("exported", F.lit(True))
    broken = edges.where("dangling").select(F.col("src").alias("path")).join(changed, "path").select("slug").distinct().withColumn("dangling", F.lit(True))
    odd = surprising.select(F.explode(F.array("src", "dst")).alias("slug")).distinct().withColumn("surprise", F.lit(True))
    m = share_below(modules.select("slug", "pagerank", "tested_by", "tier", "symbols"), "pagerank")
    gap = (F.size(F.coalesce("tested_by", F.array().cast("array<string>"))) == 0) & (F.col("tier") <= 1) & (F.col("symbols") > 0)
    m = m.select("slug", "percentile", gap.alias("test_gap")).join(slugs, "slug")
    for extra in (exported, broken, odd, dependents):
        m = m.join(extra, "slug", "left")
    return m.na.fill(False, ["exported", "dangling", "surprise"]).na.fill(0, ["dependents", "dependent_modules"])
