"""Where bytes lie: appended items, extents, chunks and spans, over tables of many files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import int_div
from ..structures.packets import item_is_video
from .blocks import as_of, previous, running


def place_directory_items(items: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Start of every appended item, walking back from EOF by ``length + padding``.

    ``items``: keys, ord, mime, semantic, length, padding; ``sizes``: keys, size. Item 0 is the
    still. ``ok`` turns false at the first item without a stored length, or longer than what is
    left, and stays false for the items before it.
    """
    stored = F.coalesce("length", F.lit(0)) + F.coalesce("padding", F.lit(0))
    rows = items.filter(F.col("ord") > 0).withColumn("stored", stored)
    rows = running(rows, keys, "ord", F.col("stored"), "back", reverse=True)
    rows = rows.join(sizes, keys).withColumn("start", F.col("size") - F.col("back"))
    bad = ((F.col("stored") == 0) | (F.col("start") < 0)).cast("int")
    rows = running(rows, keys, "ord", bad, "broken", reverse=True)
    return rows.withColumn("ok", F.col("broken") == 0).drop("back", "broken")


def directory_video(placed: DataFrame, keys: list[str]) -> DataFrame:
    """The video item nearest to EOF: ``off, len`` per file."""
    usable = placed.filter("ok").filter(item_is_video(F.col("mime"), F.col("semantic")))
    best = F.max_by(F.struct("start", F.coalesce("length", "stored").alias("len")), "ord")
    return usable.groupBy(*keys).agg(best.alias("v")).select(
        *keys, F.col("v.start").alias("off"), F.col("v.len").alias("len")
    )


def extents_contiguous(extents: DataFrame, keys: list[str]) -> DataFrame:
    """Per item: first offset, total length, and whether each extent starts where the one before
    ended (A7, W3)."""
    rows = previous(extents, keys, "ord", F.col("off") + F.col("len"), "before")
    return rows.groupBy(*keys).agg(
        F.min_by("off", "ord").alias("start"),
        F.sum("len").alias("total_len"),
        F.count("*").alias("n"),
        F.bool_and(F.col("before").isNull() | (F.col("before") == F.col("off"))).alias("contiguous"),
    )


def chunk_samples_per(chunks: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``per``: samples per chunk of the last run, in table order, that starts at or before the
    chunk (J7). Chunk numbers are ``ord + 1``; no run gives 0."""
    found = as_of(
        chunks, runs, keys, F.col("ord"), F.col("first") - 1,
        F.struct(F.col("run_ord").alias("rank"), F.col("per").alias("per")), "_run",
    )
    return found.withColumn("per", F.coalesce("_run.per", F.lit(0)).cast("bigint")).drop("_run")


def chunk_first_sample(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``first_sample``: samples in all chunks before this one."""
    found = running(chunks, keys, "ord", F.col("per"), "_before", inclusive=False)
    return found.withColumn(
        "first_sample", F.coalesce("_before", F.lit(0)).cast("bigint")
    ).drop("_before")


def chunk_bytes(chunks: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``bytes``: sizes of the samples in ``[first_sample, first_sample + per)``.

    Every sample looks up its chunk on the line of sample numbers; then one sum per chunk.
    """
    filled = chunks.filter(F.col("per") > 0)
    placed = as_of(
        samples, filled, keys, F.col("idx"), F.col("first_sample"),
        F.struct(
            F.col("first_sample").alias("first"), F.col("ord").alias("ord"), F.col("per").alias("per")
        ),
        "_chunk",
    ).filter(F.col("idx") < F.col("_chunk.first") + F.col("_chunk.per"))
    sums = placed.groupBy(*keys, F.col("_chunk.ord").alias("ord")).agg(F.sum("bytes").alias("bytes"))
    joined = chunks.join(sums, [*keys, "ord"], "left")
    return joined.withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("bigint"))


def media_spans(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """First chunk start to last chunk end in table order, NULL length when negative; and the
    extremes that decide whether all chunks lie inside a range (A10, A15)."""
    end = F.col("off") + F.col("bytes")
    spans = chunks.groupBy(*keys).agg(
        F.min_by("off", "ord").alias("span_off"),
        F.max_by(end, F.col("ord")).alias("_end"),
        F.min("off").alias("lowest"),
        F.max(end).alias("highest"),
        F.count("*").alias("chunks"),
    )
    length = F.col("_end") - F.col("span_off")
    return spans.withColumn("span_len", F.when(length >= 0, length)).drop("_end")


def chunks_within(off: Column, length: Column) -> Column:
    """All chunks of a span row inside ``[off, off + length)``."""
    return (F.col("lowest") >= off) & (F.col("highest") <= off + length)


def even_chunk_bytes(sample_count: Column, sample_bytes: Column, chunks: Column) -> Column:
    """Bytes per chunk without a run table: an even split of average samples."""
    per = int_div(sample_count + chunks - 1, chunks)
    return per * int_div(sample_bytes, sample_count)


def plan_spans(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Extent of the slices of a plan: lowest start, highest end, and total bytes."""
    is_slice = F.col("t") == "slice"
    return parts.groupBy(*keys).agg(
        F.min(F.when(is_slice, F.col("off"))).alias("span_off"),
        (
            F.max(F.when(is_slice, F.col("off") + F.col("len")))
            - F.min(F.when(is_slice, F.col("off")))
        ).alias("span_len"),
        F.sum(F.when(is_slice, F.col("len")).otherwise(0)).alias("slice_bytes"),
        F.sum(F.when(~is_slice, F.col("len")).otherwise(0)).alias("literal_bytes"),
    )
