"""Symbols: names of each file, lookup by name in tiers, definitions that nothing refers to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella.functions import lex


def exported_names(defs: DataFrame, cap: int = C.MAX_NAMES) -> DataFrame:
    """(file, names): the first exported names of each file in order, each once."""
    names = defs.where("exported").select("file", "name").distinct()
    ranked = names.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("name"))).where(F.col("n") <= cap)
    return ranked.groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("names"))


def _holds(term: str):
    return lambda path: path.contains(term)


def lookup(defs: DataFrame, query: str, k: int = C.MAX_SYMBOLS) -> DataFrame:
    """(name, score) of the k symbols nearest to a query; an exact name alone if there is one.

    Whole label 10000 or as a prefix 1000, a term exact 1000, as a prefix 100, inside 1, in the
    file's path 0.5, each times the term's rarity among names; the tiers of terms count with
    the square of the share of terms that match.
    """
    spark = defs.sparkSession
    if not defs.where(F.col("name") == query).limit(1).isEmpty():
        return spark.createDataFrame([(query, None)], "name string, score double")
    terms = [t.lower() for t in lex.keywords(query)] or [lex.fold_py(query).lower()]
    joined = " ".join(terms)
    names = defs.groupBy("name").agg(F.collect_set(F.lower("file")).alias("paths"))
    flat = F.lower(lex.fold(F.col("name")))
    names = names.withColumn("flat", flat).withColumn("label", F.array_join(lex.split_identifier(F.col("name")), " "))
    stats = names.agg(F.count("*").alias("n"), *[F.count_if(F.col("flat").contains(t)).alias(f"df{i}") for i, t in enumerate(terms)])
    idf = stats.select(*[F.log(1 + F.col("n") / (1 + F.col(f"df{i}"))).alias(f"w{i}") for i in range(len(terms))]).collect()[0]
    w = [float(idf[f"w{i}"]) for i in range(len(terms))]
    top = max(w) or 1.0
    whole = (F.col("flat") == joined) | (F.col("label") == joined)
    begins = F.col("flat").startswith(joined) | F.col("label").startswith(joined)
    full = F.when(whole, 10_000 * top).when(begins, 1_000 * top).otherwise(0.0)
    tiered, loose, matched = [], [], []
    for t, v in zip(terms, w):
        exact, prefix, inside = F.col("flat") == t, F.col("flat").startswith(t) | F.col("label").startswith(t), F.col("flat").contains(t)
        tiered.append(F.when(exact, 1000 * v).when(prefix, 100 * v).otherwise(0.0))
        loose.append(F.when(~exact & ~prefix & inside, v).otherwise(0.0))
        loose.append(F.when(F.exists("paths", _holds(t)), 0.5 * v).otherwise(0.0))
        matched.append(F.when(exact | prefix | inside, 1.0).otherwise(0.0))
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    share = add(matched) / float(len(terms))
    scored = names.select("name", F.round(full + add(loose) + add(tiered) * share * share, 6).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), F.length("name"), "name").limit(k)


def hits(found: DataFrame, defs: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Found names with their definitions (and modules) and the files that refer to them."""
    d = defs.join(files.select(F.col("rel").alias("file"), "module"), "file", "left").withColumn("module", F.coalesce("module", F.lit("root")))
    d = d.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("file", "line", "kind", "module"))).alias("defs"))
    r = refs.groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("refs"))
    return found.join(d, "name").join(r, "name", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def dead(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Definitions to whose names no other file refers."""
    used = refs.join(defs.select("name", F.col("file").alias("home")), "name").where("file <> home").select("name").distinct()
    return defs.join(used, "name", "left_anti")
