"""Extraction plans from the sample table.

Only files that no cheaper route settled get here. Their chunks, runs and samples become rows; the
spans are joined back and one movie box per file is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import be, blob, int_table, long
from ..functions.codecs import int_div
from ..functions.flow import let
from ..operators.placement import (
    chunk_bytes, chunk_first_sample, chunk_samples_per, even_chunk_bytes, media_spans,
)
from ..structures.movie import SUMMARY
from .routes import PART, RANGE, WINDOW_SLACK, span

KEYS = ["file_id", "start"]
REBUILT = (
    f"struct<state:string,parts:array<{PART}>,span:{RANGE},summary:{SUMMARY},reason:string,"
    f"need:{RANGE}>"
)

# The header that opens a rebuilt clip, and limits and texts of the route.
REBUILT_FTYP = b"\x00\x00\x00\x20ftypisom\x00\x00\x00\x00isomiso2avc1mp41"
SPAN_SLACK = 1024 * 1024
NO_MOOV = "no moov box is visible"
NO_TABLE = "no usable sample table"
FRAGMENTED = "fragmented MP4 (moof) is not supported yet"
OUTSIDE = "sample table points outside the file"
TOO_LARGE = "sample span is implausibly large"
NO_MATCH = "sample table does not match the metadata range"
NO_FIT = "chunk offsets do not fit the file layout"


def header_length(span_len: Column) -> Column:
    """Size of the media header: 16 bytes once the box no longer fits 32 bits."""
    return F.when(span_len + 8 > 0xFFFFFFFF, 16).otherwise(8)


def track_spans(tracks: DataFrame) -> DataFrame:
    """Span of the chosen track of every movie box; rows keep their array columns out of shuffles."""
    usable = tracks.filter(F.col("has_track") & ~F.col("fragmented") & (F.size("offsets") > 0))
    scalars = [
        *KEYS, "sample_count", "sample_bytes", F.size("offsets").alias("n"),
        F.coalesce(F.size("runs"), F.lit(-1)).alias("n_runs"), (F.size("sizes") > 0).alias("listed"),
    ]
    chunks = usable.select(*scalars, F.posexplode("offsets").alias("ord", "off"))
    runs = usable.select(*KEYS, F.posexplode("runs").alias("run_ord", "run")).select(
        *KEYS, "run_ord", "run.first", "run.per"
    )
    samples = usable.select(*KEYS, F.posexplode("sizes").alias("idx", "bytes"))
    by_run = chunk_first_sample(
        chunk_samples_per(chunks.filter("n_runs > 0"), runs, KEYS), KEYS
    )
    listed = chunk_bytes(by_run.filter("listed"), samples, KEYS).select(*KEYS, "ord", "off", "bytes")
    average = int_div(F.col("sample_bytes"), F.col("sample_count"))
    uniform = by_run.filter("not listed").select(
        *KEYS, "ord", "off", F.coalesce(F.col("per") * average, long(0)).alias("bytes")
    )
    even = even_chunk_bytes(F.col("sample_count"), F.col("sample_bytes"), F.col("n"))
    rest = chunks.filter("n_runs <= 0").select(
        *KEYS, "ord", "off",
        F.when((F.col("n_runs") == 0) & (F.col("sample_count") > 0), even)
        .otherwise(long(0)).alias("bytes"),
    )
    return media_spans(listed.unionByName(uniform).unionByName(rest), KEYS)


def judge_tracks(tracks: DataFrame, spans: DataFrame) -> DataFrame:
    """Verdict per movie box, with and without the demand that it match the claimed range.

    ``strict`` and ``lax`` are ``ready``, ``need`` (box not fully visible), ``skip`` or a reason.
    """
    col = F.col
    scalars = tracks.drop("sizes", "offsets", "runs", "raw", "summary")
    rows = scalars.join(spans, KEYS, "left")
    end = col("span_off") + col("span_len")
    delta = F.lit(len(REBUILT_FTYP)) + col("msize") + header_length(col("span_len")) - col("span_off")
    rows = rows.withColumn("delta", delta)
    limit = F.when(col("wide"), F.lit(2**63 - 1)).otherwise(F.lit(2**32 - 1))
    fits = (col("low") + col("delta") >= 0) & (
        col("high") <= F.when(col("delta") > 0, limit - col("delta")).otherwise(limit)
    )
    inside = (col("lowest") >= col("region_off")) & (
        col("highest") <= col("region_off") + col("region_len")
    )

    def verdict(match: Column) -> Column:
        return (
            F.when(~col("has_track"), "skip")
            .when(col("fragmented"), FRAGMENTED)
            .when(col("span_len").isNull() | (col("span_len") == 0) | (col("sample_bytes") == 0), "skip")
            .when((col("span_off") < 8) | (end > col("size")), OUTSIDE)
            .when(col("span_len") > col("sample_bytes") * 2 + SPAN_SLACK, TOO_LARGE)
            .when(~match, NO_MATCH)
            .when(~col("visible"), "need")
            .when(~F.coalesce(fits, F.lit(False)), NO_FIT)
            .otherwise("ready")
        )

    free = F.lit(True)
    return rows.withColumn("lax", verdict(free)).withColumn(
        "strict", verdict(col("region_off").isNull() | F.coalesce(inside, F.lit(False)))
    )


def choose_track(judged: DataFrame) -> DataFrame:
    """One verdict per file: the first matching box, else the first sound one, else the last
    reason (W9)."""
    stop = lambda c: F.col(c).isin("ready", "need")
    reason = lambda c: ~stop(c) & (F.col(c) != "skip")
    pick = F.struct("start", "span_off", "span_len", "delta", "msize")
    per_file = judged.groupBy("file_id").agg(
        F.min_by(
            F.struct(F.col("strict").alias("v"), pick.alias("p")), F.when(stop("strict"), F.col("start"))
        ).alias("s"),
        F.min_by(
            F.struct(F.col("lax").alias("v"), pick.alias("p")), F.when(stop("lax"), F.col("start"))
        ).alias("l"),
        F.max_by(F.col("strict"), F.when(reason("strict"), F.col("start"))).alias("reason"),
        F.bool_or(stop("strict")).alias("any_s"),
        F.bool_or(stop("lax")).alias("any_l"),
    )
    strict_ready = F.col("any_s") & (F.col("s.v") == "ready")
    lax_ready = F.col("any_l") & (F.col("l.v") == "ready")
    chosen = F.when(strict_ready, F.col("s.p")).when(lax_ready, F.col("l.p")).when(
        F.col("any_s"), F.col("s.p")
    )
    state = F.when(strict_ready | lax_ready, "ready").when(F.col("any_s"), "need").otherwise("unsupported")
    return per_file.select(
        "file_id", state.alias("state"), chosen.alias("pick"),
        F.coalesce("reason", F.lit(NO_TABLE)).alias("reason"),
    )


def literal(data: Column) -> Column:
    return F.struct(
        F.lit("lit").alias("t"), data.alias("lit"), F.lit(None).cast("bigint").alias("off"),
        F.length(data).cast("bigint").alias("len"),
    )


def slice_part(off: Column, length: Column) -> Column:
    return F.struct(
        F.lit("slice").alias("t"), F.lit(None).cast("binary").alias("lit"),
        off.cast("bigint").alias("off"), length.cast("bigint").alias("len"),
    )


def shift_offsets(raw: Column, at: Column, count: Column, wide: Column, delta: Column) -> Column:
    """A movie box with every chunk offset moved by ``delta`` (D11). ``at`` is the 0-based place of
    the table inside ``raw``."""
    width = F.when(wide, 8).otherwise(4)

    def table(digits: int) -> Column:
        cells = int_table(F.substring(raw, (at + 1).cast("int"), (count * width).cast("int")), digits // 2)
        return F.unhex(
            F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(c + delta), digits, "0")), "")
        )

    return F.concat(
        F.substring(raw, F.lit(1), at.cast("int")),
        F.when(wide, table(16)).otherwise(table(8)),
        F.substring(raw, (at + count * width + 1).cast("int"), F.length(raw)),
    )


def rebuild_parts(track: Column, pick: Column) -> Column:
    """Opening header, shifted movie box, media header and the span."""
    moved = shift_offsets(
        track["raw"], track["table_at"] - track["start"], track["table_count"], track["wide"], pick["delta"]
    )
    n = pick["span_len"]
    media = F.when(
        header_length(n) == 16, F.concat(blob(b"\x00\x00\x00\x01mdat"), be(n + 16, 8))
    ).otherwise(F.concat(be(n + 8, 4), blob(b"mdat")))
    return F.array(
        literal(blob(REBUILT_FTYP)), literal(moved), literal(media), slice_part(pick["span_off"], n)
    )


def resolve_tables(rows: DataFrame) -> DataFrame:
    """Settle rows whose ``clip.attempt`` is ``tables``.

    Adds ``rebuilt``: state, parts, span, summary, reason and the range still needed. ``rows`` is
    read twice; hand in a frame that is cheap to read again.
    """
    open_rows = rows.select(
        "file_id", "size", F.col("video.off").alias("region_off"), F.col("video.len").alias("region_len"),
        F.explode("clip.tracks").alias("t"),
    ).select(
        "file_id", "size", "region_off", "region_len", F.col("t.size").alias("msize"),
        *[F.col(f"t.{c}") for c in (
            "start", "visible", "has_track", "fragmented", "sample_count", "sample_bytes", "sizes",
            "offsets", "runs", "low", "high", "wide",
        )],
    )
    chosen = choose_track(judge_tracks(open_rows, track_spans(open_rows)))
    joined = rows.join(chosen, "file_id", "left")
    track = F.get(
        F.filter(F.col("clip.tracks"), lambda t: t["start"] == F.col("pick.start")), F.lit(0)
    )
    ready = F.col("state") == "ready"
    need_off = F.greatest(F.col("pick.start") - WINDOW_SLACK, long(0))
    need_len = F.col("pick.start") + F.col("pick.msize") - need_off
    rebuilt = F.struct(
        F.coalesce("state", F.lit("unsupported")).alias("state"),
        F.when(ready, let(track, lambda t: rebuild_parts(t, F.col("pick")))).alias("parts"),
        F.when(ready, span(F.col("pick.span_off"), F.col("pick.span_len"))).alias("span"),
        F.when(ready, track["summary"]).alias("summary"),
        F.coalesce(
            "reason", F.when(F.col("clip.any_moov"), F.lit(NO_TABLE)).otherwise(F.lit(NO_MOOV))
        ).alias("reason"),
        F.when(F.col("state") == "need", span(need_off, need_len)).alias("need"),
    )
    return joined.withColumn("rebuilt", rebuilt).drop("state", "pick", "reason")
