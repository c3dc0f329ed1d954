"""What to work on next, and the parts of an index page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import numbered


def queue(modules: DataFrame) -> DataFrame:
    """Modules in the order of work: stale prose, then none, then done; tail last, most linked first.

    modules: slug, prose (freshness), tier, degree.
    """
    rank = F.when(F.col("prose") == "stale", 0).when(F.col("prose") == "none", 1).otherwise(2)
    order = [F.col("rank").asc(), F.col("tail").asc(), F.desc("degree"), F.col("slug").asc()]
    m = modules.withColumn("rank", rank).withColumn("tail", F.when(F.col("tier") == 2, 1).otherwise(0))
    return numbered(m, order).drop("tail").withColumn("position", F.col("position").cast("int"))


def summary(modules: DataFrame) -> DataFrame:
    """One row: total, enriched, stale."""
    return modules.agg(F.count("*").alias("total"), F.count_if(F.col("prose") != "none").alias("enriched"), F.count_if(F.col("prose") == "stale").alias("prose_stale"))


def hubs(modules: DataFrame, k: int) -> DataFrame:
    """Modules by PageRank."""
    return modules.orderBy(F.desc("pagerank"), "slug").limit(k)


def bridges(modules: DataFrame, hub: DataFrame, k: int, least: int = 8) -> DataFrame:
    """Modules by betweenness that are no hubs; none in a graph of fewer than `least` modules."""
    enough = modules.agg((F.count("*") >= least).alias("enough"))
    return modules.where("betweenness > 0").join(hub.select("slug"), "slug", "left_anti").crossJoin(F.broadcast(enough)).where("enough").drop("enough").orderBy(F.desc("betweenness"), "slug").limit(k)


def labels(modules: DataFrame) -> DataFrame:
    """(community, label, size): each community by its best linked member."""
    return modules.groupBy("community").agg(F.min_by("slug", F.struct(-F.col("degree"), "slug")).alias("label"), F.count("*").alias("size"))
