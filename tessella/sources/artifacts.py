"""Stored tables, gated by schema version, and exports as text."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.constants import SCHEMA_VERSION
from tessella.schema import TABLES


def write(df: DataFrame, index: str, name: str) -> None:
    """Stores a table of the index; a reader never sees half of it, as a failed write leaves no success mark."""
    want = [c.split()[0] for c in TABLES[name].split(", ")]
    df.select(*want).withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").parquet(f"{index}/{name}")


def read(spark: SparkSession, index: str, name: str) -> DataFrame | None:
    """A table of the index; None if it is not there or of another version."""
    try:
        df = spark.read.schema(f"{TABLES[name]}, schema_version int").parquet(f"{index}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if not df.where(f"schema_version <> {SCHEMA_VERSION} or schema_version is null").isEmpty():
        return None
    return df.drop("schema_version")


def write_if_changed(path: str, text: str) -> bool:
    """Writes a text file through a temporary one, if it differs; tells whether it did."""
    p = Path(path)
    if p.exists() and p.read_text() == text:
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    t = p.with_name(f".{p.name}.tmp")
    t.write_text(text)
    t.replace(p)
    return True


def json_lines(df: DataFrame, *order: str) -> str:
    """A small table as JSON, one row a line, in a fixed order."""
    rows = df.orderBy(*order).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()
    return "".join(r["j"] + "\n" for r in rows)


def mermaid(modules: DataFrame, edges: DataFrame, most: int = 40, most_edges: int = 80) -> str:
    """A diagram of the best linked modules and the heaviest edges between them, saying what was left out."""
    top = modules.orderBy((F.col("deg_in") + F.col("deg_out")).desc(), "slug").limit(most)
    keep = top.select("slug")
    inside = edges.join(F.broadcast(keep.toDF("src")), "src", "left_semi").join(F.broadcast(keep.toDF("dst")), "dst", "left_semi")
    summed = inside.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    rows = summed.orderBy(F.desc("w"), "src", "dst").limit(most_edges).collect()
    names = sorted(r["slug"] for r in keep.collect())
    number = {s: f"m{i}" for i, s in enumerate(names)}
    left = (modules.count() - len(names), summed.count() - len(rows))
    body = [f'  {number[s]}["{s}"]' for s in names] + [f"  {number[r['src']]} --> {number[r['dst']]}" for r in rows]
    note = [f"  %% {left[0]} modules and {left[1]} edges not shown"] if any(left) else []
    return "\n".join(["graph LR", *body, *note]) + "\n"


def fresh(spark: SparkSession, index: str) -> bool:
    """Whether there is an index of this version."""
    return read(spark, index, "files") is not None
