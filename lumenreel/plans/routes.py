"""Which route finds the clip of a file, as columns over its windows.

A file takes the first route that gives a range: trailer, then the metadata of its container, then
a complete clip at its end, then the sample table. Everything here is a narrow projection; only the
sample-table route needs other rows (``plans.rebuild``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import has, long, read_at, read_upto, int_table, usable_windows, walk_boxes
from ..functions.codecs import VIDEO_BRANDS
from ..functions.flow import (
    Env, Step, apply_steps, cached_steps, empty, first_where, let, named, null,
    step_columns,
)
from ..structures import containers, items, jpeg, movie, packets, trailer

RANGE = "struct<off:bigint,len:bigint>"
PART = "struct<t:string,lit:binary,off:bigint,len:bigint>"
READ_MORE = (
    "struct<target:string,off:bigint,bytes:bigint,region_off:bigint,region_len:bigint,reason:string>"
)
TRACK_TABLE = (
    "struct<start:bigint,size:bigint,visible:boolean,has_track:boolean,fragmented:boolean,"
    "sample_count:bigint,sample_bytes:bigint,sizes:array<bigint>,offsets:array<bigint>,"
    "runs:array<struct<first:bigint,per:bigint>>,low:bigint,high:bigint,table_at:bigint,"
    "table_count:bigint,wide:boolean,raw:binary,summary:" + movie.SUMMARY + ">"
)

# Window sizes, and the texts that appear in results.
TAIL_WINDOW = 64 * 1024
REGION_WINDOW = 192 * 1024
HEADER_WINDOW = 64 * 1024
WINDOW_SLACK = 4096
MIN_STILL = 128
STILLS = ["jpeg", "heif", "avif", "png", "webp", "gif", "tiff"]
SPLIT_REASON = "video payload is split across several extents"
READ_HEADER = "read the video header"
READING_HEADER = "reading the video header"
READ_MOVIE = "read the movie box"
READ_SEGMENTS = "read on in the JPEG header"
READ_TABLE = "finish reading the HEIF item table"
READ_TAIL = "motion photo declared but the video header is not in the tail window"
READING_TAIL = "reading more of the file tail"
NOTE_TRAILER = "SEFT trailer v%d with %d block(s)"
NOTE_NO_BLOCK = "the SEFT trailer holds no motion photo block"
NOTE_JPEG = "jpeg header walk stopped early"
NOTE_NO_META = "no meta box found in the head window"
NOTE_MPVD = "a top-level mpvd box holds the video"
NOTE_ITEM = "video item #%d type=%s name=%s"
NOTE_EXTENTS = "video item uses multiple extents"
NOTE_NO_ITEM = "heif meta has %d items and no video item"
NOTE_BAD_LENGTH = "the XMP video length does not point at a media box; ignoring it"
NOTE_BOUNDS = "the video range in the metadata is out of bounds; ignoring it"
NOTE_SPLIT = "multi-extent video item: extraction needs a demuxer"
NOTE_APPENDED = "a self-contained MP4 is appended to the image data"
NOTE_TABLE = "located the video through its sample table"


def span(off: Column, length: Column) -> Column:
    return F.struct(off.cast("bigint").alias("off"), length.cast("bigint").alias("len"))


def in_bounds(off: Column, length: Column, size: Column) -> Column:
    """A non-empty range inside the file."""
    return F.coalesce((off < size) & (length > 0) & (length <= size - off), F.lit(False))


def directory_range(directory: Column, size: Column) -> Column:
    """Place the items after the first backwards from EOF; the last video among them.

    The same rule over an item table is ``operators.placement.place_directory_items``.
    """
    zero = F.struct(size.alias("end"), null(RANGE).alias("found"), F.lit(False).alias("stopped"))

    def step(acc: Column, item: Column) -> Column:
        stored = packets.stored_length(item)
        start = acc["end"] - stored
        video = packets.item_is_video(item["mime"], item["semantic"])
        return F.when(
            acc["stopped"] | (stored == 0) | (stored > acc["end"]),
            F.struct(
                acc["end"].alias("end"), acc["found"].alias("found"), F.lit(True).alias("stopped")
            ),
        ).otherwise(
            F.struct(
                start.alias("end"),
                F.when(
                    video & acc["found"].isNull(), span(start, F.coalesce(item["length"], stored))
                ).otherwise(acc["found"]).alias("found"),
                F.lit(False).alias("stopped"),
            )
        )

    later = F.reverse(F.slice(directory, F.lit(2), F.greatest(F.size(directory), F.lit(1))))
    return F.aggregate(later, zero, step, lambda acc: acc["found"])


def _windows() -> Env:
    return {"wins": usable_windows(F.col("wins")), "size": F.col("size")}


#: Longest marker segment with its marker, and the next marker behind it.
SEGMENT_BYTES = 2 + 65535 + 4


def structure_steps() -> list[Step]:
    """Columns ``found`` (container, facts, trailer, …), ``exif`` and ``tables``."""

    def kind(e: Env) -> Env:
        return {
            "sniffed": containers.sniff(e["wins"]),
            "head_end": F.get(e["wins"], 0)["end"],
        }

    def top(e: Env) -> Env:
        return {
            "boxes": containers.boxes_top(e["wins"], e["size"]),
            "jpeg": F.when(e["sniffed"]["container"] == "jpeg", jpeg.jpeg_segments(e["wins"], e["walk"])),
        }

    def head(e: Env) -> Env:
        first = F.get(e["wins"], F.lit(0))["data"]
        return {
            "head": F.coalesce(
                F.when(e["jpeg"].isNotNull(), jpeg.header_text(e["wins"], e["jpeg"])), first, F.lit(bytearray())
            ),
            "unread": F.when(e["jpeg"].isNotNull(), jpeg.unread_from(e["wins"], e["size"], e["jpeg"])),
        }

    def packet(e: Env) -> Env:
        return {
            "facts": packets.packet_facts(e["head"]),
            "directory": packets.directory_items(e["head"]),
        }

    def end(e: Env) -> Env:
        return {"trailer": trailer.trailer(e["wins"], e["size"])}

    def segments(e: Env) -> Env:
        container = e["sniffed"]["container"]
        return {
            "container": container,
            "is_video": F.coalesce(
                (container == "isobmff") & e["sniffed"]["brand"].isin(VIDEO_BRANDS), F.lit(False)
            ),
            "meta": F.when(
                container.isin("heif", "avif"), first_where(e["boxes"], lambda b: b["typ"] == "meta")
            ),
            "clip": F.when(
                e["trailer"].isNotNull(),
                trailer.trailer_range(e["wins"], e["size"], e["trailer"]["blocks"]),
            ),
        }

    def result(e: Env) -> Column:
        keep = (
            "container", "is_video", "head_end", "boxes", "facts", "directory", "trailer", "jpeg",
            "unread", "meta", "clip",
        )
        return named({k: e[k] for k in keep})

    found = step_columns(
        {**_windows(), "walk": F.col("walk")}, kind, top, head, packet, end, segments, out="found", result=result
    )
    exif = jpeg.exif_steps(
        {"wins": usable_windows(F.col("wins")), "segments": F.col("found.jpeg.segments")}, "exif"
    )
    tables = items.item_table_steps(
        {"wins": usable_windows(F.col("wins")), "meta": F.col("found.meta")}, "tables"
    )
    return [*found, *exif, *tables]


def candidate_steps() -> list[Step]:
    """Column ``cand``: the range the metadata names, its labels, and what to note about it."""
    env = {**_windows(), "found": F.col("found"), "tables": F.col("tables")}

    def sources(e: Env) -> Env:
        f = e["found"]
        modern = f["container"].isin("heif", "avif") & f["clip"].isNull()
        return {
            "xmp": directory_range(f["directory"], e["size"]),
            "mpvd": F.when(modern, containers.find_mpvd(e["wins"], e["size"])),
            "item": F.when(
                modern & e["tables"].isNotNull(),
                items.video_item(e["tables"]),
            ),
            "modern": modern,
        }

    def checks(e: Env) -> Env:
        box = e["mpvd"]
        return {
            "mpvd_end": F.when(
                box.isNotNull(), containers.trim_sefd(e["wins"], box["data_start"], box["data_end"])
            ),
            "xmp_opens": F.when(
                e["modern"] & e["xmp"].isNotNull(),
                containers.starts_media_box(e["wins"], e["xmp"]["off"], e["xmp"]["len"]),
            ),
            "joined": F.when(e["item"].isNotNull(), items.contiguous(e["item"]["extents"])),
        }

    def route(off: Column, length: Column, family: str | Column, method: str, split: Column | None = None) -> Column:
        family = F.lit(family) if isinstance(family, str) else family
        return F.struct(
            off.cast("bigint").alias("off"), length.cast("bigint").alias("len"),
            family.alias("family"), F.lit(method).alias("method"),
            (F.lit(False) if split is None else split).alias("split"),
        )

    def pick(e: Env) -> Env:
        f, item, xmp, micro = e["found"], e["item"], e["xmp"], e["found"]["facts"]["micro_offset"]
        is_jpeg = f["container"] == "jpeg"
        mpvd_len = e["mpvd_end"] - e["mpvd"]["data_start"]
        first = F.get(item["extents"], F.lit(0))
        routes = (
            F.when(
                f["clip"].isNotNull(),
                route(f["clip"]["off"], f["clip"]["len"], "samsung", "seft-trailer"),
            )
            .when(is_jpeg & xmp.isNotNull(), route(xmp["off"], xmp["len"], "google", "xmp-directory"))
            .when(
                is_jpeg & (micro > 0) & (micro < e["size"]),
                route(e["size"] - micro, micro, "google", "xmp-microvideo-offset"),
            )
            .when(
                item.isNotNull(),
                route(
                    first["off"], -item["minus_len"],
                    F.when(item["far"] == 0, "heif-item").otherwise("heif-item-unreferenced"),
                    "heif-item", ~e["joined"],
                ),
            )
            .when(mpvd_len > 0, route(e["mpvd"]["data_start"], mpvd_len, "google", "mpvd-box"))
            .when(
                e["modern"] & F.coalesce(e["xmp_opens"], F.lit(False)),
                route(xmp["off"], xmp["len"], "heif-xmp", "xmp-directory"),
            )
            .when(
                ~is_jpeg & ~f["container"].isin("heif", "avif") & xmp.isNotNull(),
                route(xmp["off"], xmp["len"], "xmp", "xmp-directory"),
            )
        )
        return {"route": F.when(~f["is_video"], routes), "mpvd_len": mpvd_len}

    def result(e: Env) -> Column:
        f, r, item = e["found"], e["route"], e["item"]
        ok = in_bounds(r["off"], r["len"], e["size"])
        incomplete = f["meta"]["data_end"] > f["head_end"]
        modern = F.coalesce(e["modern"] & ~f["is_video"], F.lit(False))
        ask_head = modern & e["tables"].isNotNull() & item.isNull() & F.coalesce(incomplete, F.lit(False))
        notes = F.array(
            F.when(
                f["trailer"].isNotNull(),
                F.format_string(NOTE_TRAILER, f["trailer"]["version"], F.size(f["trailer"]["blocks"])),
            ),
            F.when(f["trailer"].isNotNull() & f["clip"].isNull(), NOTE_NO_BLOCK),
            F.when(f["jpeg"].isNotNull() & ~f["jpeg"]["complete"], NOTE_JPEG),
            F.when(f["container"].isin("heif", "avif") & f["meta"].isNull(), NOTE_NO_META),
            F.when(modern & (e["mpvd_len"] > 0), NOTE_MPVD),
            F.when(
                item.isNotNull(),
                F.format_string(
                    NOTE_ITEM, item["id"], F.get(F.filter(e["tables"]["items"], lambda x: x["id"] == item["id"]), F.lit(0))["item_type"],
                    F.coalesce(F.nullif(F.get(F.filter(e["tables"]["items"], lambda x: x["id"] == item["id"]), F.lit(0))["name"], F.lit("")), F.lit("-")),
                ),
            ),
            F.when(item.isNotNull() & ~e["joined"], NOTE_EXTENTS),
            F.when(
                modern & e["tables"].isNotNull() & item.isNull() & ~F.coalesce(incomplete, F.lit(False)),
                F.format_string(NOTE_NO_ITEM, F.size(e["tables"]["items"])),
            ),
            F.when(
                modern & item.isNull() & ~F.coalesce(e["mpvd_len"] > 0, F.lit(False))
                & ~F.coalesce(e["xmp_opens"], F.lit(True)),
                NOTE_BAD_LENGTH,
            ),
            F.when(r.isNotNull() & ~ok, NOTE_BOUNDS),
            F.when(ok & r["split"], NOTE_SPLIT),
        )
        image = F.get(f["directory"], F.lit(0))
        return named(
            {
                "video": F.when(ok, span(r["off"], r["len"])),
                "family": F.when(ok, r["family"]),
                "method": F.when(ok, r["method"]),
                "split": ok & r["split"],
                "fallback": ~f["is_video"] & ~ok & f["container"].isin(STILLS),
                "ask_head": F.when(ask_head, f["meta"]["data_end"]),
                "still_len": F.when(
                    (f["container"] == "jpeg") & f["clip"].isNull()
                    & packets.item_is_image(image["mime"]),
                    image["length"],
                ),
                "notes": F.array_compact(notes),
            }
        )

    return step_columns(env, sources, checks, pick, out="cand", result=result)


def clip_steps() -> list[Step]:
    """Columns ``movies`` and ``clip``: what the visible bytes say about a claimed range.

    ``clip.attempt`` is one of video, split, direct, window, tables, appended, none; ``clip.need`` is
    the range to read next: the start of the claimed range, a movie box that is not all visible, or
    the next header of the clip. Needs the columns ``video``, ``split``, ``fallback`` and ``is_video``.
    """
    env = {
        **_windows(), "video": F.col("video"), "split": F.col("split"),
        "fallback": F.col("fallback"), "is_video": F.col("is_video"),
    }

    def ranges(e: Env) -> Env:
        v = e["video"]
        return {
            "direct": F.when(
                v.isNotNull() & ~e["split"] & ~e["is_video"],
                let(
                    F.struct(v["off"].alias("a"), (v["off"] + v["len"]).alias("b")),
                    lambda r: containers.complete_clip(e["wins"], r["a"], r["b"]),
                ),
            ),
            "appended": F.when(e["fallback"], containers.appended_clip(e["wins"], e["size"])),
            "want": F.least(v["len"], long(REGION_WINDOW)),
        }

    def seen(e: Env) -> Env:
        return {"visible": has(e["wins"], e["video"]["off"], e["want"])}

    def roots(e: Env) -> Env:
        every = movie.moov_candidates(e["wins"], e["size"])
        return {
            "roots": F.when(e["is_video"], F.slice(every, 1, 1))
            .when(e["direct"].isNotNull(), F.array(e["direct"]))
            .when(e["appended"].isNotNull(), F.array(e["appended"]["moov"]))
            .when((e["video"].isNotNull() & ~e["split"] & e["visible"]) | e["fallback"], every)
            .otherwise(empty("struct<typ:string,start:bigint,size:bigint,data_start:bigint,data_end:bigint>")),
            "chain": F.when(
                e["direct"].isNull() & e["video"].isNotNull() & e["visible"] & ~e["split"] & ~e["is_video"],
                walk_boxes(e["wins"], e["video"]["off"], e["video"]["off"] + e["video"]["len"]),
            ).when(e["is_video"] & (F.size(every) == 0), walk_boxes(e["wins"], long(0), e["size"])),
        }

    def needs(e: Env) -> Env:
        v = e["video"]
        missing = first_where(e["roots"], lambda b: ~has(e["wins"], b["start"], b["size"]))
        end = F.when(e["is_video"], e["size"]).otherwise(v["off"] + v["len"])
        last = F.try_element_at(e["chain"], F.lit(-1))["data_end"]
        unseen = F.coalesce(
            (F.get(e["chain"], F.lit(0))["typ"] == "ftyp") & (last <= end - 8)
            & ~has(e["wins"], last, F.least(end - last, F.lit(16))),
            F.lit(False),
        )
        hidden = v.isNotNull() & ~e["split"] & ~e["is_video"] & e["direct"].isNull() & ~e["visible"]
        return {
            "hidden": F.coalesce(hidden, F.lit(False)),
            "need": F.when(hidden, span(v["off"], e["want"])).when(
                missing.isNotNull(),
                let(
                    F.greatest(missing["start"] - WINDOW_SLACK, long(0)),
                    lambda at: span(at, F.least(missing["data_end"] + WINDOW_SLACK, e["size"]) - at),
                ),
            ).when(unseen, span(last, F.least(end - last, long(HEADER_WINDOW)))),
        }

    checked = step_columns(
        env, ranges, seen, roots, needs, out="checked",
        result=lambda e: named({k: e[k] for k in ("direct", "appended", "need", "hidden", "roots")}),
    )
    parsed = movie.movie_steps(
        {"wins": usable_windows(F.col("wins")), "roots": F.col("checked.roots")}, "movies"
    )
    after = {**env, "checked": F.col("checked"), "movies": F.col("movies")}

    def attempt(e: Env) -> Env:
        c, v = e["checked"], e["video"]
        return {
            "attempt": F.when(e["is_video"], "video")
            .when(e["split"], "split")
            .when(c["direct"].isNotNull(), "direct")
            .when(c["hidden"], "window")
            .when(c["appended"].isNotNull(), "appended")
            .when(c["need"].isNotNull(), "window")
            .when(v.isNotNull(), "tables")
            .when(e["fallback"] & (F.size(e["movies"]) > 0), "tables")
            .otherwise("none")
        }

    def track_table(e: Env, m: Column) -> Column:
        def row(t: Column) -> Column:
            width = F.when(t["wide"], 8).otherwise(4)
            whole = F.when(
                t["wide"], int_table(read_upto(e["wins"], t["table_at"], t["table_count"] * width), 8)
            ).otherwise(int_table(read_upto(e["wins"], t["table_at"], t["table_count"] * width), 4))
            return let(
                whole,
                lambda cells: F.struct(
                    m["start"].alias("start"), m["size"].alias("size"), m["visible"].alias("visible"),
                    t.isNotNull().alias("has_track"),
                    F.coalesce(t["fragmented"], F.lit(False)).alias("fragmented"),
                    t["sample_count"].alias("sample_count"), t["sample_bytes"].alias("sample_bytes"),
                    t["sizes"].alias("sizes"), t["offsets"].alias("offsets"), t["runs"].alias("runs"),
                    F.array_min(cells).alias("low"), F.array_max(cells).alias("high"),
                    t["table_at"].alias("table_at"), t["table_count"].alias("table_count"),
                    t["wide"].alias("wide"),
                    F.when(m["visible"], read_at(e["wins"], m["start"], m["size"])).alias("raw"),
                    movie.movie_summary(m).alias("summary"),
                ),
            )

        return let(movie.video_track(m["tracks"]), row)

    def candidates(e: Env) -> Env:
        return {
            "tracks": F.when(
                e["attempt"] == "tables", F.transform(e["movies"], lambda m: track_table(e, m))
            )
        }

    def result(e: Env) -> Column:
        c = e["checked"]
        whole = F.when(e["is_video"], span(long(0), e["size"])).when(
            c["direct"].isNotNull(), e["video"]
        ).when(
            e["attempt"] == "appended",
            span(c["appended"]["start"], e["size"] - c["appended"]["start"]),
        )
        return named(
            {
                "attempt": e["attempt"],
                "slice": whole,
                "need": c["need"],
                "any_moov": F.size(c["roots"]) > 0,
                "summary": F.when(
                    whole.isNotNull(), movie.movie_summary(F.get(e["movies"], F.lit(0)))
                ),
                "tracks": e["tracks"],
            }
        )

    final = step_columns(after, attempt, candidates, out="clip", result=result)
    return [*checked, *parsed, *final]


def with_structures(df: DataFrame) -> DataFrame:
    """Add ``found``, ``exif``, ``tables`` and ``cand`` to rows with ``wins``, ``size`` and ``walk``."""
    df = apply_steps(df, cached_steps("structures", structure_steps))
    df = apply_steps(df, cached_steps("candidate", candidate_steps))
    return _without_temporaries(df)


def with_clip(df: DataFrame) -> DataFrame:
    """Add ``clip`` to rows with ``wins``, ``size``, ``video``, ``split``, ``fallback``, ``is_video``."""
    df = apply_steps(df, cached_steps("clip", clip_steps))
    return _without_temporaries(df).drop("movies", "checked")


def _without_temporaries(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])
