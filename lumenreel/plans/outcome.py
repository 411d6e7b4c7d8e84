"""The per-file answer: kind, still, motion, plan and what to read next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import long
from ..functions.flow import let, named, null
from ..structures.containers import STILL_MIME, still_mime
from ..structures.trailer import CLIP_BLOCK_NAME, trailer_markers
from . import routes
from .rebuild import slice_part

STILL = (
    "struct<mime:string,width:int,height:int,length:bigint,"
    "thumb:struct<off:bigint,len:bigint,orientation:int>>"
)
MOTION = (
    "struct<found:boolean,family:string,method:string,confidence:string,"
    "video:struct<off:bigint,len:bigint>,timestamp_us:bigint,playable:boolean,codec:string,"
    "width:int,height:int,duration_ms:bigint,reason:string>"
)
PLAN = f"struct<mime:string,direct:boolean,parts:array<{routes.PART}>>"
META = (
    "struct<make:string,model:string,software:string,lens:string,taken_at:string,orientation:int>"
)
FIELDS = {
    "kind": "string", "container": "string", "still": STILL, "motion": MOTION, "plan": PLAN,
    "read_more": routes.READ_MORE, "meta": META, "markers": "array<string>",
    "boxes": "array<string>", "notes": "array<string>",
}
RESULT = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"

# Texts that appear in results.
NOT_READ = "file was not read"
FURTHER = "read further into the video"
FURTHER_READING = "reading further into the video"
NO_HEADER = "no video header found in the claimed range"
NO_BOXES = "the claimed range has no MP4 box structure"


def result_struct(values: dict[str, Column]) -> Column:
    """All result fields with their fixed types."""
    cells = [
        values.get(name, F.lit(None)).cast(ddl).alias(name) for name, ddl in FIELDS.items()
    ]
    return F.struct(*cells)


def plan_struct(parts: Column, direct: Column) -> Column:
    return F.when(
        parts.isNotNull(),
        F.struct(F.lit("video/mp4").alias("mime"), direct.alias("direct"), parts.alias("parts")),
    )


def request(target: str, off: Column, n: Column, region: Column, reason: str | Column) -> Column:
    return F.struct(
        F.lit(target).alias("target"), off.cast("bigint").alias("off"), n.cast("bigint").alias("bytes"),
        region["off"].alias("region_off"), region["len"].alias("region_len"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )


def _flag(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def probe_result() -> Column:
    """Result of the first stage from ``found, exif, tables, cand, clip, rebuilt, last_len, whole``."""
    f, exif, cand, clip = F.col("found"), F.col("exif"), F.col("cand"), F.col("clip")
    tables, rebuilt, size = F.col("tables"), F.col("rebuilt"), F.col("size")
    facts = f["facts"]
    none_range = null(routes.RANGE)

    attempt = clip["attempt"]
    rebuilt_ready = _flag(rebuilt["state"] == "ready")
    sliced = clip["slice"]
    parts = F.when(sliced.isNotNull(), F.array(slice_part(sliced["off"], sliced["len"]))).when(
        rebuilt_ready, rebuilt["parts"]
    )
    ready = sliced.isNotNull() | rebuilt_ready
    summary = F.coalesce(clip["summary"], F.when(rebuilt_ready, rebuilt["summary"]))
    named_range = cand["video"].isNotNull()
    free_ready = rebuilt_ready & ~named_range

    markers = F.array_distinct(
        F.concat(
            facts["markers"],
            F.array_compact(
                F.array(
                    F.when(_flag(facts["motion_photo"]), "Camera:MotionPhoto"),
                    F.when(_flag(facts["micro_video"]), "GCamera:MicroVideo"),
                )
            ),
            F.coalesce(
                F.when(~f["is_video"], trailer_markers(f["trailer"]["blocks"])),
                F.array().cast("array<string>"),
            ),
        )
    )
    declared = _flag(facts["motion_photo"]) | _flag(facts["micro_video"])
    guessed = (
        F.when(F.array_contains(markers, CLIP_BLOCK_NAME), "samsung")
        .when(declared, "google")
        .otherwise("unknown")
    )
    structural = (attempt == "appended") | free_ready
    family = F.when(f["is_video"], "plain-video").when(named_range, cand["family"]).when(
        structural, guessed
    )
    method = (
        F.when(f["is_video"], "container")
        .when(named_range, cand["method"])
        .when(attempt == "appended", "appended-container")
        .when(free_ready, "sample-table")
    )
    confidence = (
        F.when(f["is_video"] | named_range, "exact")
        .when(attempt == "appended", F.when(facts["present"], "high").otherwise("medium"))
        .when(free_ready, F.when(_flag(facts["motion_photo"]), "high").otherwise("medium"))
        .otherwise("none")
    )
    video = F.coalesce(
        F.when(f["is_video"] | (attempt == "appended"), sliced), cand["video"],
        F.when(free_ready, rebuilt["span"]), none_range,
    )

    need = F.coalesce(clip["need"], F.when(_flag(rebuilt["state"] == "need"), rebuilt["need"]))
    wants_tail = cand["fallback"] & ~ready & (declared | (F.size(f["directory"]) > 0)) & ~F.col("whole")
    tail_bytes = F.least(F.greatest(F.col("last_len") * 4, long(routes.TAIL_WINDOW)), size)
    no_region = null(routes.RANGE)
    read_more = (
        F.when(
            f["unread"].isNotNull(),
            request(
                "segments", f["unread"], F.least(size - f["unread"], long(routes.SEGMENT_BYTES)), no_region,
                routes.READ_SEGMENTS,
            ),
        )
        .when(
            need.isNotNull(),
            request(
                "window", need["off"], need["len"], F.when(~f["is_video"], cand["video"]),
                F.when(ready, routes.READ_MOVIE).otherwise(routes.READ_HEADER),
            ),
        )
        .when(wants_tail, request("tail", null("bigint"), tail_bytes, no_region, routes.READ_TAIL))
        .when(
            cand["ask_head"].isNotNull() & (attempt != "split") & ~(structural & ~named_range),
            request("head", null("bigint"), cand["ask_head"], no_region, routes.READ_TABLE),
        )
    )
    reason = (
        F.when(attempt == "split", routes.SPLIT_REASON)
        .when(need.isNotNull() & ~ready, routes.READING_HEADER)
        .when(named_range & (attempt == "tables") & ~rebuilt_ready, rebuilt["reason"])
        .when(wants_tail, routes.READING_TAIL)
    )

    def motion(v: Column) -> Column:
        return F.when(
            v.isNotNull() | family.isNotNull() | ready,
            named(
                {
                    "found": v.isNotNull() | ready,
                    "family": family,
                    "method": method,
                    "confidence": confidence,
                    "video": v,
                    "timestamp_us": F.when(~f["is_video"], F.coalesce(facts["motion_us"], facts["micro_us"])),
                    "playable": ready,
                    "codec": summary["codec"],
                    "width": summary["width"].cast("int"),
                    "height": summary["height"].cast("int"),
                    "duration_ms": summary["duration_ms"],
                    "reason": reason,
                }
            ),
        )

    mime = still_mime(f["container"])
    picture = tables["size"]
    still_len = F.coalesce(
        F.when(~f["is_video"], cand["still_len"]),
        F.when(
            (f["container"] == "jpeg") & (video["off"] >= routes.MIN_STILL), video["off"]
        ),
    )
    still = F.when(
        mime.isNotNull(),
        F.struct(
            mime.alias("mime"),
            F.coalesce(picture["width"], exif["width"]).cast("int").alias("width"),
            F.coalesce(picture["height"], exif["height"]).cast("int").alias("height"),
            still_len.alias("length"),
            F.when(
                exif["thumb"].isNotNull(),
                F.struct(
                    exif["thumb"]["off"].alias("off"), exif["thumb"]["len"].alias("len"),
                    exif["thumb_orientation"].alias("orientation"),
                ),
            ).alias("thumb"),
        ),
    )
    meta_fields = ("make", "model", "software", "lens", "taken_at", "orientation")
    notes = F.concat(
        cand["notes"],
        F.array_compact(
            F.array(
                F.when(attempt == "appended", routes.NOTE_APPENDED),
                F.when(free_ready, routes.NOTE_TABLE),
            )
        ),
    )
    return result_struct(
        {
            "kind": F.when(f["is_video"], "video").when(ready, "motion").otherwise("photo"),
            "container": F.when(f["is_video"], "mp4").otherwise(f["container"]),
            "still": still,
            "motion": let(video, motion),
            "plan": plan_struct(parts, sliced.isNotNull()),
            "read_more": read_more,
            "meta": F.struct(*[exif[k].alias(k) for k in meta_fields]),
            "markers": markers,
            "boxes": F.transform(
                f["boxes"], lambda b: F.regexp_replace(b["typ"], r"[^\x20-\x7e]", ".")
            ),
            "notes": F.when(f["is_video"], F.array().cast("array<string>")).otherwise(notes),
        }
    )


def region_result() -> Column:
    """Result of the second stage from ``clip, rebuilt, video, seen_container``."""
    clip, rebuilt, region = F.col("clip"), F.col("rebuilt"), F.col("video")
    sliced = clip["slice"]
    rebuilt_ready = _flag(rebuilt["state"] == "ready")
    ready = sliced.isNotNull() | rebuilt_ready
    parts = F.when(sliced.isNotNull(), F.array(slice_part(sliced["off"], sliced["len"]))).when(
        rebuilt_ready, rebuilt["parts"]
    )
    summary = F.coalesce(clip["summary"], F.when(rebuilt_ready, rebuilt["summary"]))
    need = F.coalesce(clip["need"], F.when(_flag(rebuilt["state"] == "need"), rebuilt["need"]))
    nothing = (need["len"] == 0) | (need["off"] >= F.col("size"))
    covered = (need["off"] == region["off"]) & (need["len"] >= region["len"])
    go_on = need.isNotNull() & ~nothing & ~covered
    reason = (
        F.when(ready, F.lit(None))
        .when(need.isNotNull() & nothing, NO_HEADER)
        .when(need.isNotNull() & covered, NO_BOXES)
        .when(go_on, FURTHER_READING)
        .otherwise(rebuilt["reason"])
    )
    mime = still_mime(F.col("seen_container"))
    return result_struct(
        {
            "kind": F.lit("motion"),
            "container": F.col("seen_container"),
            "still": F.when(
                mime.isNotNull(),
                F.struct(
                    mime.alias("mime"), null("int").alias("width"), null("int").alias("height"),
                    null("bigint").alias("length"),
                    null("struct<off:bigint,len:bigint,orientation:int>").alias("thumb"),
                ),
            ),
            "motion": F.struct(
                F.lit(True).alias("found"),
                F.lit("unknown").alias("family"),
                F.when(ready, F.when(sliced.isNotNull(), "container").otherwise("sample-table")).alias("method"),
                F.when(ready, F.when(sliced.isNotNull(), "exact").otherwise("high")).otherwise("none").alias("confidence"),
                region.alias("video"),
                null("bigint").alias("timestamp_us"),
                ready.alias("playable"),
                summary["codec"].alias("codec"),
                summary["width"].cast("int").alias("width"),
                summary["height"].cast("int").alias("height"),
                summary["duration_ms"].alias("duration_ms"),
                reason.alias("reason"),
            ),
            "plan": plan_struct(parts, sliced.isNotNull()),
            "read_more": F.when(go_on, request(
                "window", need["off"], need["len"], region, F.when(ready, routes.READ_MOVIE).otherwise(FURTHER)
            )),
            "markers": F.array(), "boxes": F.array(), "notes": F.array(),
        }
    )


def unread_result(note: Column) -> Column:
    """Result of a file that was not or could not be read."""
    return result_struct(
        {
            "kind": F.lit("unknown"), "container": F.lit("unknown"), "markers": F.array(),
            "boxes": F.array(), "notes": F.array(note),
        }
    )


__all__ = ["FIELDS", "RESULT", "STILL_MIME", "probe_result", "region_result", "unread_result"]
