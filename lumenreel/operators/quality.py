"""Checks over a catalog; each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LITERAL = 256 * 1024


def plan_parts(catalog: DataFrame) -> DataFrame:
    """Plan parts as rows: file_id, size, ord, t, off, len, lit."""
    return catalog.select(
        "file_id", "size", F.posexplode("plan.parts").alias("ord", "p")
    ).select("file_id", "size", "ord", "p.t", "p.off", "p.len", "p.lit")


def check_bounds(catalog: DataFrame) -> DataFrame:
    """Slices that leave their file (Q1)."""
    inside = (F.col("off") >= 0) & (F.col("len") > 0) & (F.col("off") + F.col("len") <= F.col("size"))
    return plan_parts(catalog).filter((F.col("t") == "slice") & ~F.coalesce(inside, F.lit(False)))


def check_literals(catalog: DataFrame, limit: int = MAX_LITERAL) -> DataFrame:
    """Plans whose synthesised bytes reach the limit."""
    literal = F.aggregate(
        F.filter("plan.parts", lambda p: p["t"] == "lit"), F.lit(0).cast("bigint"),
        lambda a, p: a + p["len"],
    )
    return catalog.withColumn("literal_bytes", literal).filter(F.col("literal_bytes") >= limit).select(
        "file_id", "literal_bytes"
    )


def check_still(catalog: DataFrame) -> DataFrame:
    """JPEG stills that do not end where the clip starts, or earlier (Q4)."""
    return catalog.filter(
        (F.col("container") == "jpeg") & F.col("motion.playable")
        & ~F.coalesce(F.col("still.length") <= F.col("motion.video.off"), F.lit(False))
    ).select("file_id", F.col("still.length").alias("length"), F.col("motion.video.off").alias("off"))


def check_reads(catalog: DataFrame) -> DataFrame:
    """Files of which more was read than was asked for: the first reads, and then what their boxes, regions and
    segments declare (Q6)."""
    return catalog.filter(F.col("stats.bytes_read") > F.col("stats.asked")).select("file_id", "stats.reads", "stats.bytes_read")


def check_bytes(clips: DataFrame, originals: DataFrame, key: str = "file_id") -> DataFrame:
    """Exported clips that differ from their original or have none (Q2); both sides: ``key``, sha256.

    ``key`` must tell files apart; names don't.
    """
    left = clips.select(key, F.col("sha256").alias("got"))
    right = originals.select(key, F.col("sha256").alias("expected"))
    return left.join(right, key, "full").filter(~F.col("got").eqNullSafe(F.col("expected")))


def check_plain_stills(catalog: DataFrame, manifest: DataFrame, key: str = "file_id") -> DataFrame:
    """Files labelled as plain stills that got a plan (Q5)."""
    stills = manifest.filter(F.col("expected_kind") == "still").select(key)
    return catalog.join(stills, key, "left_semi").filter(F.col("plan").isNotNull()).select("file_id", "name")


def check_manifest(catalog: DataFrame, manifest: DataFrame, key: str = "file_id") -> DataFrame:
    """Labelled files whose library kind differs or that are missing (Q7)."""
    kinds = catalog.select(key, "library_kind")
    return manifest.join(kinds, key, "left").filter(~F.col("expected_kind").eqNullSafe(F.col("library_kind")))


def check_expected(catalog: DataFrame, expected: DataFrame, key: str = "file_id") -> DataFrame:
    """Samples whose clip range differs from the expected one."""
    actual = catalog.select(
        key, F.col("motion.video.off").alias("off"), F.col("motion.video.len").alias("len")
    )
    same = F.col("off").eqNullSafe(F.col("video_off")) & F.col("len").eqNullSafe(F.col("video_len"))
    return expected.join(actual, key, "left").withColumn("matches", same)
