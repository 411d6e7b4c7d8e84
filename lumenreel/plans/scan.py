"""Adaptive scans: small reads first, more only for the files that ask for it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import WINDOW, join_windows, long, usable_windows, window
from ..functions.flow import empty, let, null
from ..operators.merge import merge_stages, upsert
from ..session import materialise
from ..structures import jpeg
from ..structures.containers import sniff
from . import outcome, rebuild, routes


@dataclass(frozen=True)
class Limits:
    """Bytes of the first read at each end; what a file needs beyond them follows from its boxes."""

    head_bytes: int = 64 * 1024
    tail_bytes: int = 64 * 1024


DEFAULT = Limits()
DEEP = Limits(head_bytes=2 * 1024 * 1024, tail_bytes=2 * 1024 * 1024)

# The longest range that is held as one value, whose text in hexadecimal must fit a value too.
LONGEST = 2**30 - 2**16
NO_PROGRESS = "the range asked for was read and gave nothing new"
TOO_LONG = "the range asked for is longer than one value can hold"

# A reader adds ``got`` (array of window structs, one per entry of ``want``) and ``read_error``. Where ``follow`` is
# set, it reads the JPEG header on from there, segment by segment, and appends what it has read: at least the headers
# of the segments, and EXIF and packet segments as a whole.
Reader = Callable[[DataFrame], DataFrame]


def content_reader(df: DataFrame) -> DataFrame:
    """Reader for rows that hold their bytes in ``content``."""
    got = F.transform(
        F.col("want"),
        lambda r: window(
            r["off"],
            F.substring(F.col("content"), (r["off"] + 1).cast("int"), r["len"].cast("int")),
        ),
    )
    if "follow" in df.columns:
        # the header is in memory with the rest; what of it is missing is one window
        whole = F.array(F.struct(long(0).alias("off"), F.col("size").alias("end"), F.col("content").alias("data")))
        header = let(whole, lambda w: jpeg.jpeg_segments(w, F.col("walk")))["pos"]
        more = let(
            F.least(header + 4, F.col("size")) - F.col("follow"),
            lambda n: window(F.col("follow"), F.substring(F.col("content"), (F.col("follow") + 1).cast("int"), n.cast("int"))),
        )
        got = F.concat(got, F.when(F.col("follow").isNotNull(), F.array(more)).otherwise(empty(WINDOW)))
    return df.withColumn("got", got).withColumn("read_error", null("string"))


def requested_ranges(limits: Limits) -> tuple[Column, Column]:
    """Head and tail ranges still to read; NULL where nothing is missing."""
    size, head, tail = F.col("size"), F.col("head"), F.col("tail")
    whole = size <= limits.head_bytes + limits.tail_bytes
    want_head = F.when(whole, size).otherwise(F.least(F.col("head_want"), size))
    want_tail = F.when(whole, long(0)).otherwise(F.least(F.col("tail_want"), size))
    read_head = head.isNull() | (head["len"] < want_head)
    head_len = F.when(read_head, want_head).otherwise(head["len"])
    off = F.greatest(head_len, size - want_tail)
    read_tail = (want_tail > 0) & (tail.isNull() | (tail["len"] < want_tail)) & (size > off)
    return (
        F.when(read_head & (want_head > 0), F.struct(long(0).alias("off"), want_head.alias("len"))),
        F.when(read_tail, F.struct(off.alias("off"), (size - off).alias("len"))),
    )


def _charge(df: DataFrame) -> DataFrame:
    got = F.col("got")
    spent = F.aggregate(got, long(0), lambda a, w: a + w["len"])
    wanted = F.aggregate(F.col("want"), long(0), lambda a, w: a + w["len"])
    if "follow" in df.columns:
        # segments say how long they are only as they are read; all of them end before the file does
        wanted = wanted + F.coalesce(F.col("size") - F.col("follow"), long(0))
    df = df.withColumn("asked", F.col("asked") + F.coalesce(wanted, long(0)))
    return df.withColumn("reads", F.col("reads") + F.size(got)).withColumn(
        "bytes_read", F.col("bytes_read") + F.coalesce(spent, long(0))
    )


def _read(df: DataFrame, reader: Reader) -> DataFrame:
    return _charge(reader(df.filter(F.size("want") > 0)))


def _settle(rows: DataFrame) -> DataFrame:
    """Add ``rebuilt``: a real one for sample-table rows, NULL for the others."""
    is_open = F.col("clip.attempt") == "tables"
    closed = rows.filter(~is_open).withColumn("rebuilt", null(rebuild.REBUILT))
    if rows.filter(is_open).isEmpty():
        return closed
    return closed.unionByName(rebuild.resolve_tables(rows.filter(is_open)))


def probe_pass(rows: DataFrame, reader: Reader, limits: Limits, carry: list[str]) -> DataFrame:
    """Read the wanted head and tail, decide, and say what is still missing.

    Windows stay with a row only while the row may need them again.
    """
    head_range, tail_range = requested_ranges(limits)
    rows = rows.withColumn("_ranges", F.struct(head_range.alias("h"), tail_range.alias("t")))
    rows = rows.withColumn("want", F.array_compact(F.array("_ranges.h", "_ranges.t", "mid_want")))
    read = _charge(reader(rows))
    followed = F.when(
        F.col("follow").isNotNull(), F.slice("got", F.size("want") + 1, F.greatest(F.size("got") - F.size("want"), F.lit(0)))
    )
    new_head = F.when(F.col("_ranges.h").isNotNull(), F.get("got", F.lit(0)))
    new_tail = F.when(
        F.col("_ranges.t").isNotNull(),
        F.get("got", F.when(F.col("_ranges.h").isNotNull(), 1).otherwise(0)),
    )
    new_mid = F.when(F.col("mid_want").isNotNull(), F.try_element_at("got", F.lit(-1)))
    read = read.withColumns(
        {
            "head": F.coalesce(new_head, "head"), "tail": F.coalesce(new_tail, "tail"),
            "mids": join_windows(
                F.array_compact(F.concat("mids", F.array(new_mid), F.coalesce(followed, empty(WINDOW))))
            ),
        }
    ).withColumn("whole", F.coalesce(F.col("head.len") >= F.coalesce("tail.off", "size"), F.lit(False)))
    read = read.withColumn("wins", join_windows(F.array_compact(F.concat(F.array("head", "tail"), "mids")))).withColumn(
        "last_len", F.coalesce(F.col("tail.len"), F.col("head.len"), long(0))
    )
    read = read.drop("want", "got", "_ranges", "follow").withColumn("passes", F.col("passes") + 1)
    seen = routes.with_structures(read)
    seen = seen.withColumns(
        {
            "video": F.col("cand.video"),
            "split": F.coalesce("cand.split", F.lit(False)),
            "fallback": F.coalesce("cand.fallback", F.lit(False)),
            "is_video": F.col("found.is_video"),
            "walk": F.when(
                F.col("found.jpeg").isNotNull(),
                F.struct(F.col("found.jpeg.pos").alias("pos"), F.col("found.jpeg.segments").alias("segments")),
            ).otherwise(F.col("walk")),
        }
    )
    seen = routes.with_clip(seen).drop("split", "fallback", "is_video", "wins")
    facts = F.col("found.facts")
    undecided = F.col("clip.attempt").isin("none", "tables") & (
        F.coalesce(facts["motion_photo"], F.lit(False))
        | F.coalesce(facts["micro_video"], F.lit(False))
        | (F.size("found.directory") > 0)
        | F.col("video").isNotNull()
    )
    keep = (
        (F.col("clip.attempt") == "tables") | undecided | F.col("clip.need").isNotNull()
        | F.col("cand.ask_head").isNotNull() | F.col("found.unread").isNotNull()
    )
    slim = {c: F.when(keep, F.col(c)) for c in ["head", "tail", "mids", *carry]}
    settled = _settle(materialise(seen.withColumns(slim)))
    result = F.when(
        F.col("read_error").isNotNull(), outcome.unread_result(F.col("read_error"))
    ).otherwise(outcome.probe_result())
    return materialise(
        settled.withColumn("result", result).drop(
            "found", "exif", "tables", "cand", "clip", "rebuilt", "video", "last_len",
            "whole", "mid_want",
        )
    )


def with_next(rows: DataFrame) -> DataFrame:
    """Add ``_next``, which is ``probe``, ``window`` or NULL when the row is finished, and ``open_reason``.

    A request follows from the bytes read so far, so the same one twice means that there was no progress.
    """
    more, last = F.col("result.read_more"), F.col("last_more")
    asks = F.coalesce(
        more.isNotNull() & F.col("read_error").isNull()
        & (F.col("result.plan").isNull() | more["reason"].isin(routes.READ_MOVIE, routes.READ_SEGMENTS)),
        F.lit(False),
    )
    again = last.isNotNull()
    for part in ("target", "off", "bytes"):
        again = again & more[part].eqNullSafe(last[part])
    why = F.when(asks & again, NO_PROGRESS).when(asks & (more["bytes"] > LONGEST), TOO_LONG)
    kind = F.when((more["target"] == "window") & more["region_off"].isNotNull(), "window").otherwise("probe")
    rows = rows.withColumn("open_reason", why)
    rows = rows.withColumn("_next", F.when(asks & F.col("open_reason").isNull(), kind))
    return rows.withColumn("last_more", more)


def window_pass(rows: DataFrame, reader: Reader, carry: list[str]) -> DataFrame:
    """Read the asked range, finish the plan with it, the tail and former ranges, and merge."""
    more, size = F.col("result.read_more"), F.col("size")
    n = F.least(more["bytes"], size - more["off"])
    rows = rows.withColumn(
        "want",
        F.array_compact(F.array(F.when(n > 0, F.struct(more["off"].alias("off"), n.alias("len"))))),
    )
    read = _charge(reader(rows))
    read = read.withColumn("mids", join_windows(F.array_compact(F.concat("mids", "got")))).withColumns(
        {
            "wins": join_windows(F.array_compact(F.concat("mids", F.array("tail")))),
            "video": routes.span(more["region_off"], more["region_len"]),
            "split": F.lit(False), "fallback": F.lit(False), "is_video": F.lit(False),
        }
    )
    read = read.withColumn(
        "seen_container", let(usable_windows(F.col("wins")), sniff)["container"]
    ).drop("want", "got")
    seen = routes.with_clip(read).drop("wins", "split", "fallback", "is_video")
    keep = (F.col("clip.attempt") == "tables") | F.col("clip.need").isNotNull()
    slim = {c: F.when(keep, F.col(c)) for c in ["head", "tail", "mids", *carry]}
    settled = _settle(materialise(seen.withColumns(slim)))
    merged = F.when(F.col("read_error").isNotNull(), outcome.unread_result(F.col("read_error"))).otherwise(
        merge_stages(F.col("result"), outcome.region_result())
    )
    return materialise(
        settled.withColumn("result", merged).drop("clip", "rebuilt", "video", "seen_container")
    )


def scan(
    files: DataFrame,
    reader: Reader = content_reader,
    limits: Limits = DEFAULT,
    carry: list[str] | None = None,
) -> DataFrame:
    """Scan ``files`` (file_id, path, name, size, mtime_ms, …) into catalog rows.

    ``carry`` names heavy columns that only the reader needs; they stay with unfinished rows and
    are not part of the result. Passes go on until no row asks for more; one that makes no progress is
    left with an ``open_reason``. Each pass handles only the rows that asked for it and writes its
    result to the checkpoint folder, so a lost executor repeats one pass at most.
    """
    if carry is None:
        carry = [c for c in ("content",) if c in files.columns]
    plain = [c for c in files.columns if c not in carry]
    start = files.withColumns(
        {
            "head": null(WINDOW), "tail": null(WINDOW),
            "head_want": long(limits.head_bytes), "tail_want": long(limits.tail_bytes),
            "reads": F.lit(0), "bytes_read": long(0), "asked": long(0), "passes": F.lit(0),
            "mids": empty(WINDOW), "mid_want": null(routes.RANGE), "follow": null("bigint"),
            "walk": F.struct(long(2).alias("pos"), empty(jpeg.SEGMENT).alias("segments")), "last_more": null(routes.READ_MORE),
            "open_reason": null("string"), "read_error": null("string"),
        }
    )
    empty_rows = start.filter(F.col("size") == 0).withColumn(
        "result", outcome.unread_result(F.lit(outcome.NOT_READ))
    )
    finished = [_catalog_rows(empty_rows, plain)]
    waiting = []
    pending = start.filter(F.col("size") > 0)
    while True:
        done = with_next(probe_pass(pending, reader, limits, carry))
        finished.append(_catalog_rows(done.filter(F.col("_next").isNull()), plain))
        waiting.append(done.filter(F.col("_next") == "window").drop("_next"))
        more = F.col("result.read_more")
        pending = done.filter(F.col("_next") == "probe").withColumns(
            {
                "head_want": F.when(more["target"] == "head", more["bytes"]).otherwise(F.col("head_want")),
                "tail_want": F.when(more["target"] == "tail", more["bytes"]).otherwise(F.col("tail_want")),
                "mid_want": F.when(more["target"] == "window", routes.span(more["off"], more["bytes"])),
                "follow": F.when(more["target"] == "segments", more["off"]),
            }
        ).drop("_next", "result")
        if pending.isEmpty():
            break
    asked = _union(waiting)
    while not asked.isEmpty():
        done = with_next(window_pass(asked, reader, carry))
        finished.append(_catalog_rows(done.filter(F.col("_next").isNull()), plain))
        asked = done.filter(F.col("_next").isNotNull()).drop("_next")
    return _union(finished)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _catalog_rows(df: DataFrame, plain: list[str]) -> DataFrame:
    fields = [F.col(f"result.{name}").alias(name) for name in outcome.FIELDS]
    failed = F.col("read_error").isNotNull()
    return df.select(
        *plain,
        F.when(failed, "failed").when(F.col("open_reason").isNotNull(), "open").otherwise("ok").alias("status"),
        F.coalesce("read_error", "open_reason").alias("error"),
        "open_reason",
        *fields,
        F.struct("reads", "bytes_read", "passes", "asked").alias("stats"),
    )


def deep_scan(
    catalog: DataFrame, where: Column, files: DataFrame, reader: Reader = content_reader,
    carry: list[str] | None = None,
) -> DataFrame:
    """Rescan the chosen rows with larger budgets and put them back into the catalog."""
    chosen = files.join(catalog.filter(where).select("file_id"), "file_id", "left_semi")
    return upsert(catalog, scan(chosen, reader, DEEP, carry))
