"""From a folder to index tables. Order matters: communities come before centrality, so all tables carry the same numbers."""

from __future__ import annotations

import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella.functions import paths
from tessella.operators import graph as G
from tessella.sources import artifacts, files
from tessella.session import durable


def module_slugs(rows: DataFrame) -> DataFrame:
    """(rel, module): files by folder; folders whose slugs collide, or have no ASCII letter, get a hash of their path."""
    d = rows.select("rel", paths.dirname(F.col("rel")).alias("dir"))
    slug = F.regexp_replace(F.regexp_replace(F.lower("dir"), "[^a-z0-9]+", "-"), "(^-+|-+$)", "")
    folders = d.select("dir").distinct().withColumn("base", F.when(F.col("dir") == "", "root").when(slug == "", "module").otherwise(slug))
    crowd = F.count("*").over(Window.partitionBy("base"))
    clash = (crowd > 1) | ((F.col("base") == "module") & (F.col("dir") != "module"))
    folders = folders.withColumn("module", F.when(clash & (F.col("dir") != ""), F.concat_ws("-", "base", F.substring(F.sha1("dir"), 1, 8))).otherwise(F.col("base")))
    return d.join(folders, "dir").select("rel", "module", "dir")


def file_edges(records: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges between files: imports and links as resolved, calls and uses by names defined in one file only."""
    kind = F.when(F.col("lang") == "markdown", "doc-link").otherwise("import")
    known = imports.where("status = 'resolved' and src <> dst").select("src", "dst", kind.alias("kind")).distinct()
    broken = imports.where("status = 'dangling'").select("src", F.col("spec").alias("dst"), kind.alias("kind"), "reason").distinct()
    defs = records.select(F.col("rel").alias("dst"), F.explode("defs").alias("d")).where("d.exported").select("dst", F.col("d.name").alias("name")).distinct()
    unique = defs.groupBy("name").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").drop("n")
    refs = records.select(F.col("rel").alias("src"), F.explode("refs").alias("name")).join(unique, "name").where("src <> dst")
    calls = refs.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    seen = known.where("kind = 'import'").select("src", "dst").withColumn("sure", F.lit(True))
    calls = calls.join(seen, ["src", "dst"], "left").select("src", "dst", F.lit("call").alias("kind"), "weight", F.when(F.col("sure"), "extracted").otherwise("inferred").alias("confidence"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    out = known.select("src", "dst", "kind", F.lit(1).cast("long").alias("weight"), none.alias("confidence"), no.alias("dangling"), none.alias("reason"))
    out = out.unionByName(calls.select("*", no.alias("dangling"), none.alias("reason")))
    return out.unionByName(broken.select("src", "dst", "kind", F.lit(1).cast("long").alias("weight"), none.alias("confidence"), F.lit(True).alias("dangling"), "reason"))


def package_table(scanned: DataFrame) -> DataFrame:
    """(name, dir) of packages that manifests in the tree declare."""
    m = scanned.where(F.col("rel").rlike("(^|/)(package\\.json|go\\.mod|Cargo\\.toml)$")).select("rel", files.decode("content").alias("text"))
    name = (
        F.when(F.col("rel").endswith("package.json"), F.get_json_object("text", "$.name"))
        .when(F.col("rel").endswith("go.mod"), F.regexp_extract("text", "(?m)^module\\s+(\\S+)", 1))
        .otherwise(F.replace(F.regexp_extract("text", '(?m)^name\\s*=\\s*"([^"]+)"', 1), F.lit("-"), F.lit("_")))
    )
    return m.select(name.alias("name"), paths.dirname(F.col("rel")).alias("dir")).where("name is not null and name <> ''")


def build(spark: SparkSession, root: str, index: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = C.MAX_BYTES, max_files: int = C.MAX_SCAN_FILES, aliases: dict[str, str] | None = None, out_dir: str | None = None) -> dict[str, DataFrame]:
    """Scans, extracts, resolves, ranks and stores; returns the stored tables.

    Files of unchanged content keep the records of the last build. More than `max_files` files are
    cut off by path; then a warning says so and the table `partial` says how many were left out.
    """
    from tessella.operators.inventory import cap_files

    own = Path(root, ".gitignore")
    ignored = files.ignore_globs(own.read_text()) if own.is_file() else []
    scanned = files.scan(spark, root, include, [*(exclude or []), *ignored], max_bytes, out_dir)
    capped = cap_files(scanned.select("rel"), max_files)
    left_out = scanned.count() - max_files
    if left_out > 0:
        warnings.warn(f"index is partial: {left_out} files beyond max_files={max_files} were left out", stacklevel=2)
    scanned = scanned.join(capped.select("rel"), "rel", "left_semi")
    old = artifacts.read(spark, index, "cache")
    if old is None:
        records = files.extract(scanned)
    else:
        same = scanned.select("rel", F.sha1("content").alias("hash")).join(old.select("rel", "hash", "record"), ["rel", "hash"])
        kept = same.select(F.from_json("record", files.EXTRACTED).alias("r")).select("r.*")
        records = files.extract(scanned.join(same.select("rel"), "rel", "left_anti")).unionByName(kept)
    records = durable(records)
    imports = records.select("rel", "lang", F.explode("imports").alias("spec"))
    edges = durable(file_edges(records, files.resolve(imports, records.select("rel"), package_table(scanned), aliases)))
    real = edges.where("not dangling")
    home = durable(module_slugs(records))
    lifted = durable(G.lift(real, home.select("rel", "module")))
    nodes = home.select(F.col("module").alias("node")).distinct()
    before = artifacts.read(spark, index, "modules")
    previous = before.select(F.col("slug").alias("node"), "community").where("community is not null") if before is not None else None
    community = durable(G.communities(nodes, lifted, previous))
    ranks, between = G.pagerank(nodes, lifted), G.betweenness(nodes, lifted)
    d = G.degrees(real).withColumnRenamed("node", "rel")
    f = records.join(home.select("rel", "module"), "rel").join(d, "rel", "left").na.fill(0, ["deg_in", "deg_out"]).withColumn("symbols", F.size("defs").cast("long"))
    f = durable(f.drop("imports", "refs"))
    tested = G.test_map(real, f.select("rel", "module", "test_file"))
    title = F.coalesce(F.nullif(F.element_at(F.split("path", "/"), -1), F.lit("")), F.lit("root"))
    m = f.groupBy(F.col("module").alias("slug")).agg(
        F.array_sort(F.collect_list("rel")).alias("members"), F.sum("symbols").alias("symbols"), F.sum("lines").alias("lines"),
        F.min_by("summary", F.struct(F.col("kind") != "doc", "rel")).alias("told"),
    ).join(home.select(F.col("module").alias("slug"), F.col("dir").alias("path")).distinct(), "slug")
    md = G.degrees(lifted).withColumnRenamed("node", "slug")
    m = m.join(md, "slug", "left").na.fill(0, ["deg_in", "deg_out"]).join(ranks.toDF("slug", "pagerank"), "slug", "left").join(between.toDF("slug", "betweenness"), "slug", "left")
    m = m.join(community.toDF("slug", "community"), "slug", "left").join(tested, "slug", "left").withColumn("tested_by", F.coalesce("tested_by", F.array().cast("array<string>")))
    summary = F.coalesce("told", F.concat(F.size("members").cast("string"), F.lit(" file(s) in `"), "path", F.lit("/`")))
    m = durable(m.withColumn("title", title).withColumn("summary", summary).withColumn("tier", paths.tier(F.concat("path", F.lit("/")))))
    defs = f.select(F.col("rel").alias("file"), "lang", F.explode("defs").alias("d")).select("file", "lang", "d.*")
    tables = {
        "files": f, "modules": m, "file_edges": edges, "module_edges": lifted, "surprises": G.surprises(lifted, community), "defs": defs,
        "refs": records.select(F.col("rel").alias("file"), F.explode("refs").alias("name")).join(defs.select("name").distinct(), "name"),
        "cache": records.select("rel", "hash", "size", "mtime", "kind", F.to_json(F.struct(*records.columns)).alias("record")),
    }
    tables["partial"] = spark.createDataFrame([(max_files, left_out)] if left_out > 0 else [], "max_files bigint, left_out bigint")
    members = durable(before.select("slug", "members")) if before is not None else None
    for name, df in tables.items():
        artifacts.write(df, index, name)
    return {name: artifacts.read(spark, index, name) for name in tables} | ({"before": members} if members is not None else {})


def build_all(spark: SparkSession, root: str, index: str, **options) -> dict:
    """Tables, entries and overview; returns row counts and what happened to written prose."""
    from tessella.plans import entries
    from tessella.plans.answer import Index

    stored_entries = Index(spark, index, root).entries()
    tables = build(spark, root, index, **options)
    before = tables.pop("before", None)
    told = entries.sync(spark, index, tables, durable(stored_entries) if stored_entries is not None else None, before)
    entries.overview(index, tables)
    return {k: t.count() for k, t in tables.items()} | told
