"""Movie boxes: candidates, tracks and their sample tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import (
    box_at, find_in_windows, has, int_table, latin1, long, printable, read_at,
    read_upto, u32, u64, u8, walk_boxes,
)
from ..functions.codecs import avc_codec, duration_ms, hevc_codec
from ..functions.flow import Env, Step, empty, first_where, let, named, step_columns, staged, upto

RUN = "struct<first:bigint,per:bigint>"
SUMMARY = "struct<codec:string,width:bigint,height:bigint,duration_ms:bigint>"

# The smallest box that can be a movie, and sizes of fixed headers.
MIN_MOOV = 32
VISUAL_FIELDS = 78


def moov_candidates(wins: Column, size: Column) -> Column:
    """Plausible ``moov`` boxes seen in any window, by offset, each once."""

    def probe(p: Column) -> Column:
        return let(
            p - 4,
            lambda at: F.when(
                u32(wins, at) >= MIN_MOOV, box_at(wins, at, size)
            ),
        )

    boxes = F.filter(
        F.transform(find_in_windows(wins, "moov"), probe),
        lambda b: (b["typ"] == "moov") & (b["size"] >= MIN_MOOV),
    )
    by_start = F.transform(
        F.array_distinct(boxes), lambda b: F.struct(b["start"].alias("start"), b.alias("box"))
    )
    return F.transform(F.array_sort(by_start), lambda x: x["box"])


def descend(wins: Column, level: Column, typ: str) -> Column:
    """Children of every ``typ`` box of a level, each with its parent's start."""

    def kids(b: Column) -> Column:
        return F.transform(
            walk_boxes(wins, b["data_start"], b["data_end"]),
            lambda c: F.struct(b["start"].alias("parent"), c.alias("box")),
        )

    parents = F.filter(level, lambda x: x["box"]["typ"] == typ)
    return F.flatten(F.transform(parents, lambda x: kids(x["box"])))


def _levels() -> list:
    """Steps that add the five levels below the ``roots``: l1 .. l5."""

    def first(e: Env) -> Env:
        roots = F.transform(
            e["roots"], lambda b: F.struct(long(-1).alias("parent"), b.alias("box"))
        )
        return {"l1": descend(e["wins"], roots, "moov")}

    def below(source: str, typ: str, out: str):
        return lambda e: {out: descend(e["wins"], e[source], typ)}

    return [
        first, below("l1", "trak", "l2"), below("l2", "mdia", "l3"),
        below("l3", "minf", "l4"), below("l4", "stbl", "l5"),
    ]


def movie_box_steps(env: Env, out: str = "tree") -> list[Step]:
    """Flat box rows ``(depth, parent_start, box)`` under the ``moov`` boxes of ``roots``."""

    def at_depth(level: Column, depth: int) -> Column:
        return F.transform(
            level,
            lambda x: F.struct(
                F.lit(depth).alias("depth"), x["parent"].alias("parent_start"), x["box"].alias("box")
            ),
        )

    def rows(e: Env) -> Column:
        return F.concat(*[at_depth(e[f"l{d}"], d) for d in range(1, 6)])

    return step_columns(env, *_levels(), out=out, result=rows)


def _kid(level: Column, parent: Column, typ: str) -> Column:
    return first_where(
        level, lambda x: (x["parent"] == parent["start"]) & (x["box"]["typ"] == typ)
    )["box"]


def _times(wins: Column, b: Column) -> Column:
    """``struct(version, timescale, duration)`` of a movie or media header."""
    at = b["data_start"]
    return let(
        u8(wins, at),
        lambda v: F.struct(
            v.alias("version"),
            F.when(v == 1, u32(wins, at + 20)).otherwise(u32(wins, at + 12)).alias("timescale"),
            F.when(v == 1, u64(wins, at + 24)).otherwise(u32(wins, at + 16)).alias("duration"),
        ),
    )


def sample_entry(wins: Column, stsd: Column) -> Column:
    """``struct(entry, codec)`` of the first sample entry."""

    def head(_: Env) -> Env:
        at = stsd["data_start"] + 8
        return {
            "at": at,
            "size": F.when(u32(wins, at - 4) > 0, u32(wins, at)),
            "typ": latin1(read_at(wins, at + 4, 4)),
        }

    def config(e: Env) -> Env:
        start, end = e["at"] + 8 + VISUAL_FIELDS, e["at"] + e["size"]
        wanted = F.when(e["typ"].isin("avc1", "avc3"), "avcC").when(
            e["typ"].isin("hvc1", "hev1"), "hvcC"
        )
        return {
            "config": F.when(
                wanted.isNotNull() & (start <= end),
                first_where(walk_boxes(wins, start, end), lambda b: b["typ"] == wanted),
            )
        }

    def raw(e: Env) -> Env:
        n = F.when(e["config"]["typ"] == "avcC", 4).otherwise(13)
        return {"raw": read_at(wins, e["config"]["data_start"], n)}

    def result(e: Env) -> Column:
        entry = printable(e["typ"])
        return F.when(
            (e["size"] >= 16) & e["typ"].isNotNull(),
            F.struct(
                entry.alias("entry"),
                F.when(
                    e["raw"].isNotNull(),
                    F.when(e["config"]["typ"] == "avcC", avc_codec(entry, e["raw"])).otherwise(
                        hevc_codec(entry, e["raw"])
                    ),
                ).alias("codec"),
            ),
        )

    return staged({}, head, config, raw, result=result)


def _sizes(wins: Column, stsz: Column) -> Column:
    """``struct(count, uniform, sizes)``; the table is empty for uniform sizes."""
    at = stsz["data_start"]
    return let(
        F.struct(
            F.coalesce(u32(wins, at + 4), long(0)).alias("uniform"),
            F.coalesce(u32(wins, at + 8), long(0)).alias("count"),
        ),
        lambda h: F.struct(
            h["count"].alias("count"),
            h["uniform"].alias("uniform"),
            F.when(
                (h["uniform"] == 0) & (h["count"] > 0),
                F.coalesce(
                    int_table(
                        read_upto(wins, at + 12, F.least(h["count"] * 4, stsz["data_end"] - at - 12)), 4
                    ),
                    empty("bigint"),
                ),
            ).otherwise(empty("bigint")).alias("sizes"),
        ),
    )


def _chunk_table(wins: Column, level: Column, stbl: Column) -> Column:
    """``struct(at, count, wide, offsets)`` of the chunk offset table; NULL when it overruns."""

    def table(x: Column) -> Column:
        b = x["box"]
        stride = F.when(b["typ"] == "co64", 8).otherwise(4)
        return let(
            u32(wins, b["data_start"] + 4),
            lambda n: F.struct(
                (b["data_start"] + 8).alias("at"),
                n.alias("count"),
                (b["typ"] == "co64").alias("wide"),
                (n.isNotNull() & (b["data_start"] + 8 + n * stride <= b["data_end"])).alias("ok"),
            ),
        )

    def offsets(t: Column) -> Column:
        n = t["count"]
        cells = F.when(t["wide"], int_table(read_upto(wins, t["at"], n * 8), 8)).otherwise(
            int_table(read_upto(wins, t["at"], n * 4), 4)
        )
        return F.struct(
            t["at"].alias("at"), t["count"].alias("count"), t["wide"].alias("wide"),
            F.filter(F.coalesce(cells, empty("bigint")), lambda c: c.isNotNull()).alias("offsets"),
        )

    tables = F.transform(
        F.filter(
            level,
            lambda x: (x["parent"] == stbl["start"]) & x["box"]["typ"].isin("stco", "co64"),
        ),
        table,
    )
    return let(
        tables,
        lambda ts: F.when(
            (F.size(ts) > 0) & F.forall(ts, lambda t: F.coalesce(t["ok"], F.lit(False))),
            let(F.get(ts, F.lit(0)), offsets),
        ),
    )


def _runs(wins: Column, stsc: Column) -> Column:
    """Runs ``(first chunk, samples per chunk)``; NULL without the box."""
    at = stsc["data_start"]
    n = F.least(F.coalesce(u32(wins, at + 4), long(0)), F.floor((stsc["data_end"] - at - 8) / 12))
    return F.when(
        stsc.isNotNull(),
        let(
            F.coalesce(int_table(read_upto(wins, at + 8, n * 12), 4), empty("bigint")),
            lambda cells: F.transform(
                upto(F.floor((F.size(cells) + 1) / 3)),
                lambda i: F.struct(
                    F.get(cells, (i * 3).cast("int")).alias("first"),
                    F.get(cells, (i * 3 + 1).cast("int")).alias("per"),
                ),
            ),
        ),
    )


def movie_steps(env: Env, out: str = "movies") -> list[Step]:
    """Parsed ``moov`` boxes with their tracks (B16); ``env`` names ``wins`` and ``roots``.

    A box without a readable movie header and a track without its sample boxes are dropped.
    """

    def traks(e: Env) -> Env:
        boxes = F.filter(e["l1"], lambda x: x["box"]["typ"] == "trak")
        return {
            "t1": F.transform(
                boxes,
                lambda x, i: F.struct(
                    i.alias("ord"), x["parent"].alias("moov"), x["box"].alias("trak"),
                    _kid(e["l2"], x["box"], "tkhd").alias("tkhd"),
                    _kid(e["l2"], x["box"], "mdia").alias("mdia"),
                ),
            )
        }

    def media(e: Env) -> Env:
        return {
            "t2": F.transform(
                e["t1"],
                lambda t: F.struct(
                    t.alias("t"),
                    u8(e["wins"], t["tkhd"]["data_start"]).alias("tk_version"),
                    _kid(e["l3"], t["mdia"], "hdlr").alias("hdlr"),
                    _kid(e["l3"], t["mdia"], "mdhd").alias("mdhd"),
                    let(_kid(e["l3"], t["mdia"], "minf"), lambda m: _kid(e["l4"], m, "stbl")).alias("stbl"),
                ),
            )
        }

    def entries(e: Env) -> Env:
        return {
            "t3": F.transform(
                e["t2"],
                lambda x: F.struct(
                    _times(e["wins"], x["mdhd"]).alias("times"),
                    let(
                        _kid(e["l5"], x["stbl"], "stsd"), lambda b: sample_entry(e["wins"], b)
                    ).alias("entry"),
                ),
            )
        }

    def sizes(e: Env) -> Env:
        return {
            "t4": F.transform(
                e["t2"],
                lambda x: let(
                    _kid(e["l5"], x["stbl"], "stsz"),
                    lambda b: F.when(b.isNotNull(), _sizes(e["wins"], b)),
                ),
            )
        }

    def chunks(e: Env) -> Env:
        return {"t5": F.transform(e["t2"], lambda x: _chunk_table(e["wins"], e["l5"], x["stbl"]))}

    def runs(e: Env) -> Env:
        return {
            "t6": F.transform(
                e["t2"],
                lambda x: let(_kid(e["l5"], x["stbl"], "stsc"), lambda b: _runs(e["wins"], b)),
            )
        }

    def tracks(e: Env) -> Env:
        rows = F.transform(
            e["t2"],
            lambda x, i: _track(e, x, *[F.get(e[k], i) for k in ("t3", "t4", "t5", "t6")]),
        )
        return {"tracks": F.filter(rows, lambda t: t.isNotNull())}

    def headers(e: Env) -> Env:
        def one(moov: Column) -> Column:
            mvhd = first_where(
                e["l1"],
                lambda x: (x["parent"] == moov["start"]) & (x["box"]["typ"] == "mvhd"),
            )["box"]
            return F.struct(
                moov.alias("moov"),
                let(mvhd, lambda b: F.when(b.isNotNull(), _times(e["wins"], b))).alias("times"),
            )

        return {"headers": F.transform(e["roots"], one)}

    def result(e: Env) -> Column:
        def movie(h: Column) -> Column:
            moov, t = h["moov"], h["times"]
            return F.when(
                t["version"].isNotNull() & t["timescale"].isNotNull() & t["duration"].isNotNull(),
                F.struct(
                    moov["start"].alias("start"),
                    moov["size"].alias("size"),
                    has(e["wins"], moov["start"], moov["size"]).alias("visible"),
                    t["timescale"].alias("timescale"),
                    t["duration"].alias("duration"),
                    F.filter(e["tracks"], lambda k: k["moov"] == moov["start"]).alias("tracks"),
                ),
            )

        return F.filter(F.transform(e["headers"], movie), lambda m: m.isNotNull())

    return step_columns(
        env, *_levels(), traks, media, entries, sizes, chunks, runs, tracks, headers,
        out=out, result=result,
    )


def _track(e: Env, x: Column, y: Column, size: Column, chunk: Column, run: Column) -> Column:
    """One track row, NULL when its header or sample boxes cannot be read."""
    wins, t = e["wins"], x["t"]
    usable = (
        x["stbl"].isNotNull()
        & (t["tkhd"].isNull() | x["tk_version"].isNotNull())
        & (x["mdhd"].isNull() | y["times"]["version"].isNotNull())
    )
    id_at = t["tkhd"]["data_start"] + F.when(x["tk_version"] == 1, 20).otherwise(12)
    side = [u32(wins, id_at + 64), u32(wins, id_at + 68)]
    both = side[0].isNotNull() & side[1].isNotNull()
    uniform = F.coalesce(size["uniform"], long(0))
    count = F.coalesce(size["count"], long(0))
    fragmented = F.exists(
        e["l2"],
        lambda k: (k["parent"] == t["trak"]["start"]) & k["box"]["typ"].isin("mvex", "moof"),
    ) | F.exists(
        e["l3"], lambda k: (k["parent"] == t["mdia"]["start"]) & (k["box"]["typ"] == "moof")
    )
    return F.when(
        usable,
        named(
            {
                "ord": t["ord"],
                "moov": t["moov"],
                "track_id": F.coalesce(u32(wins, id_at), long(0)),
                "handler": F.when(
                    x["hdlr"].isNotNull(),
                    F.coalesce(latin1(read_at(wins, x["hdlr"]["data_start"] + 8, 4)), F.lit("    ")),
                ),
                "entry": y["entry"]["entry"],
                "codec": y["entry"]["codec"],
                "width": F.when(both, F.shiftright(side[0], 16)).otherwise(0),
                "height": F.when(both, F.shiftright(side[1], 16)).otherwise(0),
                "timescale": F.coalesce(y["times"]["timescale"], long(0)),
                "duration": F.coalesce(y["times"]["duration"], long(0)),
                "sample_count": count,
                "sample_bytes": F.when(uniform > 0, uniform * count).otherwise(
                    F.coalesce(F.aggregate(size["sizes"], long(0), lambda a, b: a + b), long(0))
                ),
                "sizes": F.coalesce(size["sizes"], empty("bigint")),
                "table_at": chunk["at"],
                "table_count": chunk["count"],
                "wide": chunk["wide"],
                "offsets": F.coalesce(chunk["offsets"], empty("bigint")),
                "runs": run,
                "fragmented": fragmented,
            }
        ),
    )


def video_track(tracks: Column) -> Column:
    """The video track with the most sample bytes (the last on ties), else the first one."""
    filled = F.filter(tracks, lambda t: (t["handler"] == "vide") & (F.size(t["offsets"]) > 0))
    best = F.array_max(
        F.transform(
            filled, lambda t: F.struct(t["sample_bytes"].alias("n"), t["ord"].alias("ord"))
        )
    )
    return let(
        best["ord"],
        lambda o: F.coalesce(
            first_where(tracks, lambda t: t["ord"] == o),
            first_where(tracks, lambda t: t["handler"] == "vide"),
        ),
    )


def movie_summary(movie: Column) -> Column:
    """Codec, size and duration of the clip a movie box describes."""

    def summary(t: Column) -> Column:
        track_ms = duration_ms(t["duration"], t["timescale"])
        movie_ms = F.when(
            (movie["timescale"] > 0) & (movie["duration"] > 0),
            duration_ms(movie["duration"], movie["timescale"]),
        ).otherwise(track_ms)
        return F.struct(
            t["codec"].alias("codec"),
            F.when(t["width"] > 0, t["width"]).alias("width"),
            F.when(t["height"] > 0, t["height"]).alias("height"),
            F.coalesce(track_ms, movie_ms).alias("duration_ms"),
        )

    return F.when(movie.isNotNull(), let(video_track(movie["tracks"]), summary))


def find_movie(all_movies: Column, box: Column) -> Column:
    """The parsed movie of a ``moov`` box."""
    return first_where(all_movies, lambda m: m["start"] == box["start"])
