"""An index table kept up to date from a stream of file versions."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.constants import EXTRACTOR_VERSION, SCHEMA_VERSION


def merged(state: DataFrame | None, batch: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """State (rel, hash, ...) after a batch (rel, hash, text, seq, deleted): only contents that changed are extracted."""
    w = Window.partitionBy("rel").orderBy(F.desc("seq"))
    last = batch.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    alive = last.where("not deleted").drop("deleted", "seq")
    if state is None:
        return extract(alive)
    same = alive.select("rel", "hash").join(state.select("rel", "hash"), ["rel", "hash"], "left_semi")
    fresh = extract(alive.join(same.select("rel"), "rel", "left_anti"))
    gone = last.select("rel").join(same.select("rel"), "rel", "left_anti")
    return state.join(gone, "rel", "left_anti").unionByName(fresh)


def keep_index(stream: DataFrame, table: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Starts the query that writes version after version of the table; each batch reads the one before.

    A version is named for its batch, so a batch that runs again after a failure writes the same
    one anew, and never reads its own. Another schema or extractor means another folder.
    """
    root = Path(table) / f"v{SCHEMA_VERSION}-{EXTRACTOR_VERSION}"

    def step(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(str(root / f"batch={number - 1}")) if number else None
        merged(before, batch, extract).write.mode("overwrite").parquet(str(root / f"batch={number}"))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/{root.name}").trigger(availableNow=True).start()


def latest(spark, table: str, number: int) -> DataFrame:
    """The table after a batch."""
    return spark.read.parquet(str(Path(table) / f"v{SCHEMA_VERSION}-{EXTRACTOR_VERSION}" / f"batch={number}"))
