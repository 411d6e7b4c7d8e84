"""Catalog rows: filters, search, order, pages, counts and derived columns.

A catalog row has file_id, list_ord, path, name, ext, family_ext, size, mtime_ms, status, error,
kind, container, still, motion, plan, read_more, meta, markers, boxes, notes, stats, companion_id,
hidden_as_companion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, text
from ..session import materialise
from .pairing import marked_pairs

PAGE = 120
SORTS = ["name", "date-desc", "date-asc", "size-desc", "kind"]
WHOLE_FILE_STILL = 64 * 1024 * 1024
MIN_STILL = 128


def to_entries(files: DataFrame) -> DataFrame:
    """File rows with the columns that names give; a missing path is the name (P5)."""
    path = F.coalesce(F.nullif("path", F.lit("")), "name")
    return files.withColumns(
        {
            "path": path,
            "ext": names.ext(F.col("name")),
            "scannable": names.is_scannable(F.col("name")),
        }
    ).withColumns(
        {
            "family_ext": names.family_ext(F.col("ext")),
            "file_id": names.file_id(F.col("path"), F.col("size"), F.col("mtime_ms")),
        }
    )


def scannable(entries: DataFrame) -> DataFrame:
    """Only media files; meant to run below any reader."""
    return entries.filter("scannable")


def finish_catalog(scanned: DataFrame, order: str = "list_ord") -> DataFrame:
    """Pair the scanned rows and mark companions; whole rows meet their marks in one join."""
    return marked_pairs(scanned, order)


def with_kind(catalog: DataFrame, out: str = "library_kind") -> DataFrame:
    return catalog.withColumn(out, text.classify())


def filter_kind(catalog: DataFrame, kind: str) -> DataFrame:
    """Rows of one library kind; any other word keeps all rows."""
    return catalog.filter(text.classify() == kind) if kind in text.KINDS else catalog


def haystack() -> Column:
    """Everything the text search looks at, lower-cased."""
    fields = [
        "name", "path", "ext", "meta.make", "meta.model", "meta.taken_at", "motion.family",
        "motion.codec", "container",
    ]
    markers = F.coalesce(F.col("markers"), F.array().cast("array<string>"))
    words = F.concat(F.array(*[F.col(f) for f in fields]), markers)
    return F.lower(F.array_join(F.filter(words, lambda w: w.isNotNull() & (w != "")), " "))


def search(catalog: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search."""
    wanted = query.strip().lower()
    return catalog.filter(F.contains(haystack(), F.lit(wanted))) if wanted else catalog


def visible(catalog: DataFrame, kind: str = "all", query: str = "") -> DataFrame:
    """Rows the library shows for a filter and a search."""
    shown = catalog.filter(~F.coalesce("hidden_as_companion", F.lit(False)))
    return search(filter_kind(shown, kind), query)


def natural_key(path: Column) -> Column:
    """Sort key that orders digit runs by value: each run is preceded by its length.

    Close to locale order with numeric collation; ICU root collation orders the rest.
    """
    pieces = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))

    def piece(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(
            p.rlike(r"^\d"), F.concat(F.lpad(F.char_length(digits).cast("string"), 5, "0"), digits)
        ).otherwise(p)

    return F.collate(F.array_join(F.transform(pieces, piece), ""), "UNICODE")


def order_columns(sort: str = "name") -> list[Column]:
    """Sort columns with the listing order as the last one, so ties keep it."""
    when = text.captured_at(F.col("meta.taken_at"), F.col("mtime_ms"))
    order = {
        "date-desc": [when.desc()],
        "date-asc": [when.asc()],
        "size-desc": [F.col("size").desc()],
        "kind": [text.classify(), F.collate(F.col("name"), "UNICODE")],
    }.get(sort, [natural_key(F.col("path"))])
    return [*order, F.col("list_ord").asc()]


def sort(catalog: DataFrame, by: str = "name") -> DataFrame:
    return catalog.orderBy(*order_columns(by))


def page(catalog: DataFrame, by: str = "name", offset: int = 0, size: int = PAGE) -> DataFrame:
    """One page of the sorted rows."""
    return sort(catalog, by).offset(offset).limit(size)


def ranked(df: DataFrame, order: list[Column], out: str = "rank", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """``keep`` and the dense place of every row in a total order, without a one-task window.

    Only ``keep`` and what the order needs is sorted and written once; places inside a partition plus the row
    counts of the partitions before it give the rank. Only one row per partition is brought together.
    """
    placed = materialise(df.orderBy(*order).select(*keep, F.monotonically_increasing_id().alias("_id")))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_at", F.col("_id").bitwiseAND(2**33 - 1)
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.join(F.broadcast(starts.select("_part", "_start")), "_part")
    return joined.withColumn(out, F.col("_start") + F.col("_at")).drop("_id", "_part", "_at", "_start")


def neighbours(catalog: DataFrame, by: str = "name") -> DataFrame:
    """Previous and next file of every row in the visible order."""
    rows = ranked(catalog, order_columns(by)).select("rank", "file_id")
    steps = F.explode(
        F.array(
            F.struct(F.lit(0).alias("step"), F.col("rank").alias("at")),
            F.struct(F.lit(1).alias("step"), (F.col("rank") + 1).alias("at")),
            F.struct(F.lit(-1).alias("step"), (F.col("rank") - 1).alias("at")),
        )
    )
    pick = lambda step: F.max(F.when(F.col("s.step") == step, F.col("file_id")))
    return (
        rows.select("file_id", steps.alias("s"))
        .groupBy(F.col("s.at").alias("rank"))
        .agg(pick(0).alias("file_id"), pick(1).alias("previous_id"), pick(-1).alias("next_id"))
        .filter(F.col("file_id").isNotNull())
    )


# -- counts ---------------------------------------------------------------------------------------


def summary(catalog: DataFrame) -> DataFrame:
    """Row counts by library kind without companions; all five kinds always present (A1)."""
    shown = with_kind(catalog).filter(~F.coalesce("hidden_as_companion", F.lit(False)))
    return shown.agg(*[F.count_if(F.col("library_kind") == k).alias(k) for k in text.KINDS])


def found_count(catalog: DataFrame) -> DataFrame:
    """Pictures with motion, embedded or paired, counted after pairing (A5)."""
    kind = F.col("library_kind")
    return with_kind(catalog).agg(F.count_if(kind.isin("motion", "live")).alias("found"))


def entry_totals(entries: DataFrame) -> DataFrame:
    """Skipped files and the bytes of the others."""
    return entries.agg(
        F.count_if(~F.col("scannable")).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("scannable"), F.col("size"))), F.lit(0)).alias("total_bytes"),
    )


def scan_totals(catalog: DataFrame) -> DataFrame:
    """Files, reads and bytes read; rows without stats add nothing (A3)."""
    return catalog.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.coalesce("stats.reads", F.lit(0))), F.lit(0)).alias("reads"),
        F.coalesce(F.sum(F.coalesce("stats.bytes_read", F.lit(0))), F.lit(0)).alias("bytes_read"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
    )


def read_share(totals: DataFrame) -> DataFrame:
    """Per cent of the bytes that were read: two decimals below 1, else one (A4)."""
    share = F.when(
        F.col("total_bytes") > 0, F.col("bytes_read") / F.col("total_bytes") * 100
    ).otherwise(0.0)
    return totals.withColumn(
        "share", F.when(share < 1, F.round(share, 2)).otherwise(F.round(share, 1))
    )


# -- derived columns ------------------------------------------------------------------------------


def still_range() -> Column:
    """Bytes that show the still: thumbnail, else its own slice, else the file up to 64 MiB."""
    thumb, length, size = F.col("still.thumb"), F.col("still.length"), F.col("size")

    def value(off: Column, n: Column, is_thumb: bool) -> Column:
        return F.struct(
            off.cast("bigint").alias("off"), n.cast("bigint").alias("len"), F.lit(is_thumb).alias("is_thumb")
        )

    return (
        F.when(thumb["len"] > 0, value(thumb["off"], thumb["len"], True))
        .when(length >= MIN_STILL, value(F.lit(0), F.least(length, size), False))
        .when(size <= WHOLE_FILE_STILL, value(F.lit(0), size, False))
    )


def rotation(is_thumb: Column) -> Column:
    """Turn to apply: the main tag, and only for a thumbnail without a tag of its own."""
    own = F.coalesce(F.col("still.thumb.orientation"), F.lit(1))
    return F.when(
        F.coalesce(is_thumb, F.lit(False)) & own.isin(0, 1),
        F.coalesce(F.col("meta.orientation"), F.lit(1)),
    ).otherwise(1)


def display_dims(width: Column, height: Column, turn: Column) -> Column:
    """Width and height after the turn; 5 to 8 swap them."""
    swap = turn.between(5, 8)
    return F.struct(
        F.when(swap, height).otherwise(width).alias("width"),
        F.when(swap, width).otherwise(height).alias("height"),
    )


def playable() -> Column:
    """An own plan or a companion."""
    return text.yes(F.col("motion.playable")) | F.col("companion_id").isNotNull()


def clip_plan() -> Column:
    """The plan to export: the whole companion for a pair, else the row's own."""
    part = F.struct(
        F.lit("slice").alias("t"), F.lit(None).cast("binary").alias("lit"),
        F.lit(0).cast("bigint").alias("off"), F.col("companion_size").cast("bigint").alias("len"),
    )
    live = F.struct(
        F.lit("video/mp4").alias("mime"), F.lit(True).alias("direct"), F.array(part).alias("parts")
    )
    return F.when(F.col("companion_id").isNotNull(), live).otherwise(F.col("plan"))
