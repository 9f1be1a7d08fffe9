"""Structured Streaming forms of the work queue, upserts and row scoring; what watches folders is in watch.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecatlas.operators.gather import composite
from vecatlas.operators.scoring import assign
from vecatlas.operators.store import upsert
from vecatlas.operators.supervised import score_missing


def distinct_work(jobs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The first job of each (kind, dedupe_key) within the watermark."""
    return jobs.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["kind", "dedupe_key"])


def progress(jobs: DataFrame) -> DataFrame:
    """Running counts by kind, for the complete mode."""
    return jobs.groupBy("kind").agg(F.count("*").alias("events"), F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("errors"))


def scored(items: DataFrame, used: list[str], weights: dict[str, float], centroids: DataFrame) -> DataFrame:
    """Arriving rows with their stateless composite and nearest centroid; a narrow stream-static join with the model. Works on batches of foreachBatch."""
    return assign(composite(items, used, weights, standard=False), centroids).select("id", "pred", "sim")


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a step on every micro-batch until the input at hand is used up."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_table(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A step that merges a batch into a table of snapshots ``path/v=N``: a new snapshot per batch, so a repeated batch overwrites its own."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = upsert(batch.limit(0), batch, keys, F.col(order))
        if number > 0:
            new = upsert(spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}"), batch, keys, F.col(order))
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return step


def score_step(run_path: str, used: list[str], weights: dict[str, float], out: str) -> Callable[[DataFrame, int], None]:
    """A step that projects and assigns the gathered rows of a batch by a stored run and adds them below ``out/batch=N``; a repeated batch overwrites its own."""

    def step(batch: DataFrame, number: int) -> None:
        score_missing(batch, used, weights, run_path).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return step
