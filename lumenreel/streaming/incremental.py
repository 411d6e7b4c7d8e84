"""Scanning, counting and pairing as files arrive.

There is no event time here: results land one by one, counts follow, and the companions of the names a
batch brings are settled again. What must be known of earlier batches is keyed state; batches are stored
under their id, so a repeated batch replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import pair_key
from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder under the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """Everything stored so far, with its ``batch_id``; None before the first batch."""
    try:
        found = spark.read.parquet(store)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise  # a store that can't be read is not an empty one
        return None
    return found if "batch_id" in found.columns else None


def write_batch(rows: DataFrame, store: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


def stream_scan(
    files: DataFrame, store: str, process: Callable[[DataFrame], DataFrame], checkpoint: str,
    progress_store: str | None = None,
) -> StreamingQuery:
    """Scan every file of a stream once and store its row.

    ``process`` maps new file rows to catalog rows. A file that was seen before is skipped: which ones were is keyed
    state of the stream, one entry per file, so a batch costs what it brings and never reads the store. For many
    files the state belongs in RocksDB (``spark.sql.streaming.stateStore.providerClass``). With ``progress_store``
    every batch leaves a row of what it has done there (T3).
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        rows = process(batch)
        write_batch(rows if progress_store is None else observed(rows, seen), store, batch_id)
        if progress_store is not None:
            counts = [(int(seen.get["done"]), int(seen.get["bytes"]))]
            write_batch(batch.sparkSession.createDataFrame(counts, "done long, bytes long"), progress_store, batch_id)

    return (
        files.dropDuplicates(["file_id"]).writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_summary(results: DataFrame, kind: str = "library_kind") -> DataFrame:
    """Counts by kind over a stream of results; use update or complete mode."""
    return results.groupBy(kind).agg(F.count("*").alias("n"))


def observed(df: DataFrame, observation: Observation) -> DataFrame:
    """Count rows and bytes while they pass."""
    return df.observe(
        observation,
        F.count("*").alias("done"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )


def progress(spark: SparkSession, progress_store: str, total: DataFrame) -> DataFrame:
    """Per batch: files and bytes done so far, the totals and the share of the bytes in per cent.

    ``total`` has one row: files, bytes. The running sums go over one row per batch.
    """
    upto = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = spark.read.parquet(progress_store).select(
        "batch_id", F.sum("done").over(upto).alias("done"), F.sum("bytes").over(upto).alias("bytes")
    )
    wanted = total.select(F.col("files").alias("total_files"), F.col("bytes").alias("total_bytes"))
    share = F.when(F.col("total_bytes") > 0, F.round(F.col("bytes") / F.col("total_bytes") * 100, 1)).otherwise(100.0)
    return rows.join(F.broadcast(wanted.limit(1)), F.lit(True)).withColumn("share", share)


def stream_pairs(files: DataFrame, store: str, checkpoint: str, order: str = "list_ord") -> list[StreamingQuery]:
    """Keep the pairs of a growing library up to date (T4); two queries over the same stream of entries.

    One keeps the smallest video of every pair key as keyed state and stores the keys that a batch touches, however
    many stills have that key; counts of a frequent key are combined before they move. The other stores each file once
    with its key. No batch reads what is stored, and no still is written again when its companion changes: pairs
    are formed by ``current_pairs``.
    """
    video = F.coalesce(F.col("family_ext") == "video", F.lit(False))
    key = pair_key(F.col("name"))
    smallest = F.min_by(
        F.struct(F.col("file_id").alias("companion_id"), F.col("size").alias("companion_size")), F.struct("size", order)
    )
    best = files.filter(video).groupBy(key.alias("pair_key")).agg(smallest.alias("best"))
    entries = files.dropDuplicates(["file_id"]).select("file_id", F.when(~video, key).alias("pair_key"))

    def start(rows: DataFrame, what: str, mode: str) -> StreamingQuery:
        return (
            rows.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, f"{store}/{what}", batch_id))
            .outputMode(mode).option("checkpointLocation", f"{checkpoint}/{what}")
            .trigger(availableNow=True).start()
        )

    return [start(best, "best", "update"), start(entries, "entries", "append")]


def current_pairs(spark: SparkSession, store: str) -> DataFrame:
    """file_id, companion_id and companion_size of every file stored so far."""
    entries, best = stored(spark, f"{store}/entries"), stored(spark, f"{store}/best")
    if best is None:
        return entries.select(
            "file_id", F.lit(None).cast("string").alias("companion_id"), F.lit(None).cast("bigint").alias("companion_size")
        )
    latest = best.groupBy("pair_key").agg(F.max_by("best", "batch_id").alias("best"))
    return entries.join(latest, "pair_key", "left").select("file_id", "best.companion_id", "best.companion_size")
