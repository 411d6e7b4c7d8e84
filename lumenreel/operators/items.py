"""Item tables of many stills: extents, references and the best video item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..structures.items import MAX_SIDE, item_is_video
from .placement import extents_contiguous


def latest_items(items: DataFrame) -> DataFrame:
    """The last definition of every item, with the place of its first one."""
    last = F.max_by(F.struct("item_type", "content_type"), "ord")
    return items.groupBy("file_id", "item_id").agg(
        F.min("ord").alias("first_ord"), last.alias("d")
    ).select("file_id", "item_id", "first_ord", "d.item_type", "d.content_type")


def items_with_extents(items: DataFrame, extents: DataFrame) -> DataFrame:
    """Items with where their bytes lie; extents without a definition give an untyped item."""
    placed = extents_contiguous(extents, ["file_id", "item_id"])
    in_idat = extents.groupBy("file_id", "item_id").agg(F.bool_or("in_idat").alias("in_idat"))
    return latest_items(items).join(
        placed.join(in_idat, ["file_id", "item_id"]), ["file_id", "item_id"], "full"
    )


def described_items(refs: DataFrame, primaries: DataFrame) -> DataFrame:
    """Items that the primary item of their file describes, each once."""
    edges = refs.filter(F.col("ref_type").isin("cdsc", "auxl")).join(
        primaries, (refs["file_id"] == primaries["file_id"]) & (refs["from_id"] == primaries["primary_id"]),
        "left_semi",
    )
    return edges.select("file_id", F.col("to_id").alias("item_id")).distinct()


def video_item_candidates(placed: DataFrame, refs: DataFrame, primaries: DataFrame) -> DataFrame:
    """Video items with bytes in the file that are neither tiles nor the primary."""
    tiles = refs.filter(F.col("ref_type") == "dimg").select("file_id", F.col("to_id").alias("item_id"))
    primary = primaries.select("file_id", F.col("primary_id").alias("item_id"))
    videos = placed.filter(
        item_is_video(F.col("item_type"), F.col("content_type"))
        & (F.col("n") > 0) & ~F.coalesce("in_idat", F.lit(False))
    )
    return videos.join(tiles.unionByName(primary).distinct(), ["file_id", "item_id"], "left_anti")


def best_video_item(placed: DataFrame, refs: DataFrame, primaries: DataFrame) -> DataFrame:
    """One item per file: described first, then larger, then earlier."""
    marked = described_items(refs, primaries).withColumn("described", F.lit(True))
    rows = video_item_candidates(placed, refs, primaries).join(
        marked, ["file_id", "item_id"], "left"
    ).withColumn("described", F.coalesce("described", F.lit(False)))
    rank = F.struct((~F.col("described")).cast("int"), -F.col("total_len"), F.col("first_ord"))
    pick = F.min_by(
        F.struct("item_id", "described", "start", "total_len", "contiguous"), rank
    )
    return rows.groupBy("file_id").agg(pick.alias("p")).select("file_id", "p.*")


def _usable(width: Column, height: Column) -> Column:
    return width.between(1, MAX_SIDE) & height.between(1, MAX_SIDE)


def primary_dims(links: DataFrame, properties: DataFrame, primaries: DataFrame) -> DataFrame:
    """Size of the primary item: the property its last association names, else the largest size
    property, the last on ties (J6, A12).

    ``links``: file_id, item_id, ord, prop_index (1-based); ``properties``: file_id, prop_index,
    typ, width, height.
    """
    last = links.join(
        primaries.withColumnRenamed("primary_id", "item_id"), ["file_id", "item_id"], "left_semi"
    ).groupBy("file_id").agg(F.max_by("prop_index", "ord").alias("prop_index"))
    sizes = properties.filter(F.col("typ") == "ispe").filter(_usable(F.col("width"), F.col("height")))
    named = last.join(sizes, ["file_id", "prop_index"]).select(
        "file_id", F.struct("width", "height").alias("linked")
    )
    largest = sizes.groupBy("file_id").agg(
        F.max_by(
            F.struct("width", "height"), F.struct(F.col("width") * F.col("height"), "prop_index")
        ).alias("largest")
    )
    return largest.join(named, "file_id", "left").select(
        "file_id", F.coalesce("linked", "largest").alias("s")
    ).select("file_id", "s.width", "s.height")
