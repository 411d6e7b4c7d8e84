"""Stills and their separately stored clips of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import pair_key


def companions(entries: DataFrame, order: str = "list_ord") -> DataFrame:
    """The smallest video per pair key, the first listed on ties."""
    videos = entries.filter(F.col("family_ext") == "video")
    best = F.min_by(
        F.struct(F.col("file_id").alias("companion_id"), F.col("size").alias("companion_size")),
        F.struct("size", order),
    )
    return videos.groupBy(pair_key(F.col("name")).alias("pair_key")).agg(best.alias("c")).select(
        "pair_key", "c.companion_id", "c.companion_size"
    )


def pairs(entries: DataFrame, order: str = "list_ord") -> DataFrame:
    """file_id, companion_id and companion_size of the stills that have a companion; only narrow columns move."""
    narrow = entries.select("file_id", "name", "size", "family_ext", order)
    keyed = narrow.filter(~F.coalesce(F.col("family_ext") == "video", F.lit(False))).select(
        "file_id", pair_key(F.col("name")).alias("pair_key")
    )
    # a frequent name is a large partition of narrow rows, which adaptive execution splits in a plain join
    found = keyed.join(companions(narrow, order), "pair_key")
    return found.select("file_id", "companion_id", "companion_size")


def _once(found: DataFrame) -> DataFrame:
    """One row per file, also where a file is listed twice."""
    return found.groupBy("file_id").agg(*(F.max(c).alias(c) for c in found.columns if c != "file_id"))


def pair_live(entries: DataFrame, order: str = "list_ord") -> DataFrame:
    """Add ``companion_id`` and ``companion_size`` to stills that have one.

    Folders do not matter, and many stills may share one video.
    """
    entries = entries.drop("companion_id", "companion_size")
    return entries.join(_once(pairs(entries, order)), "file_id", "left")


def marked_pairs(entries: DataFrame, order: str = "list_ord") -> DataFrame:
    """``mark_companions(pair_live(entries))`` with one join of the whole rows."""
    entries = entries.drop("companion_id", "companion_size", "hidden_as_companion")
    found = pairs(entries, order)
    used = found.select(F.col("companion_id").alias("file_id")).distinct().select(
        "file_id", F.lit(None).cast("string").alias("companion_id"), F.lit(None).cast("bigint").alias("companion_size"),
        F.lit(True).alias("hidden_as_companion"),
    )
    marks = _once(found.withColumn("hidden_as_companion", F.lit(False)).unionByName(used))
    return entries.join(marks, "file_id", "left").withColumn(
        "hidden_as_companion", F.coalesce("hidden_as_companion", F.lit(False))
    )


def mark_companions(paired: DataFrame) -> DataFrame:
    """Add ``hidden_as_companion`` for the videos that some still uses."""
    used = paired.select(F.col("companion_id").alias("file_id")).dropna().distinct()
    return paired.drop("hidden_as_companion").join(
        used.withColumn("_used", F.lit(True)), "file_id", "left"
    ).withColumn("hidden_as_companion", F.coalesce("_used", F.lit(False))).drop("_used")


def without_companions(paired: DataFrame) -> DataFrame:
    """Only the rows that are not some still's companion (P10)."""
    used = paired.select(F.col("companion_id").alias("file_id")).dropna().distinct()
    return paired.join(used, "file_id", "left_anti")


def companion_codec(catalog: DataFrame) -> DataFrame:
    """Add ``companion_name`` and ``companion_codec`` of the companion's own scan."""
    other = catalog.select(
        F.col("file_id").alias("companion_id"),
        F.col("name").alias("companion_name"),
        F.col("motion.codec").alias("companion_codec"),
    )
    return catalog.join(other, "companion_id", "left")
