"""Merging results: two stages of one scan, and rescans into a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTE_LABELS = ["family", "method", "confidence"]
MOTION_VALUES = [
    "found", "family", "method", "confidence", "video", "timestamp_us", "playable", "codec",
    "width", "height", "duration_ms", "reason",
]
META_FIELDS = ["make", "model", "software", "lens", "taken_at", "orientation"]


def known(label: Column) -> Column:
    """NULL for labels that say nothing."""
    return F.when(~label.isin("unknown", "none"), label)


def merge_motion(first: Column, second: Column) -> Column:
    """Route labels of the first stage win where they say something; other values come from the
    second stage when it has them; playable and reason are its verdict (U5)."""
    cells = []
    for name in MOTION_VALUES:
        if name in ROUTE_LABELS:
            value = F.coalesce(known(first[name]), second[name], first[name])
        elif name == "reason":
            value = second[name]
        else:
            value = F.coalesce(second[name], first[name])
        cells.append(value.alias(name))
    return F.when(second.isNotNull() | first.isNotNull(), F.struct(*cells))


def merge_stages(first: Column, second: Column) -> Column:
    """One result struct from the results of both stages."""
    meta = second["meta"]
    meta_known = F.coalesce(
        F.array_max(F.array(*[F.coalesce(meta[m].cast("string") != "", F.lit(False)) for m in META_FIELDS])),
        F.lit(False),
    )
    filled = lambda name: F.coalesce(F.size(second[name]) > 0, F.lit(False))
    merged = F.struct(
        second["kind"].alias("kind"),
        F.coalesce(F.when(second["container"] != "unknown", second["container"]), first["container"]).alias("container"),
        F.coalesce(second["still"], first["still"]).alias("still"),
        merge_motion(first["motion"], second["motion"]).alias("motion"),
        second["plan"].alias("plan"),
        second["read_more"].alias("read_more"),
        F.when(meta_known, meta).otherwise(first["meta"]).alias("meta"),
        F.when(filled("markers"), second["markers"]).otherwise(first["markers"]).alias("markers"),
        F.when(filled("boxes"), second["boxes"]).otherwise(first["boxes"]).alias("boxes"),
        F.concat(
            F.coalesce(first["notes"], F.array().cast("array<string>")),
            F.coalesce(second["notes"], F.array().cast("array<string>")),
        ).alias("notes"),
    )
    return F.when(second.isNull(), first).when(first.isNull(), second).otherwise(merged)


def merge_results(first: DataFrame, second: DataFrame, key: str = "file_id") -> DataFrame:
    """Table form of ``merge_stages``: ``result`` of the second frame merged onto the first."""
    other = second.select(key, F.col("result").alias("_second"))
    joined = first.join(other, key, "left")
    return joined.withColumn("result", merge_stages(F.col("result"), F.col("_second"))).drop("_second")


def upsert(catalog: DataFrame, rescanned: DataFrame, key: str = "file_id") -> DataFrame:
    """Rescanned rows replace rows of the same key."""
    kept = catalog.join(rescanned.select(key), key, "left_anti")
    return kept.unionByName(rescanned)
