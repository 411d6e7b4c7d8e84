"""Trailer blocks at the end of a file and the video they point at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import (
    long, part, read_at, starts_with, u32_le, uint, uint_le,
)
from ..functions.flow import Env, empty, first_where, let, staged, upto

BLOCK = (
    "struct<ord:int,typ:bigint,name:string,name_read:boolean,payload_off:bigint,payload_len:bigint>"
)
RANGE = "struct<off:bigint,len:bigint>"

# The block type and name that hold a clip.
CLIP_BLOCK_TYPE = 0x0A30
CLIP_BLOCK_NAME = "MotionPhoto_Data"


def trailer(wins: Column, size: Column) -> Column:
    """``struct(dir_pos, version, blocks)`` or NULL when the file has no readable trailer.

    The footer names the directory length; both readings of that length are tried. Blocks are
    placed by their distance back from the directory.
    """

    def directory(_: Env) -> Env:
        content = u32_le(wins, size - 8)
        return {"content": F.when((content >= 8) & (content <= size), content)}

    def position(e: Env) -> Env:
        near = F.greatest(size - e["content"] - 8, long(0))
        far = F.greatest(size - e["content"], long(0))
        return {
            "dir": F.when(starts_with(wins, near, b"SEFH"), near).when(
                starts_with(wins, far, b"SEFH"), far
            )
        }

    def header(e: Env) -> Env:
        return {"version": u32_le(wins, e["dir"] + 4), "count": u32_le(wins, e["dir"] + 8)}

    def table(e: Env) -> Env:
        return {"table": read_at(wins, e["dir"] + 12, e["count"] * 12)}

    def result(e: Env) -> Column:
        readable = (e["count"] == 0) | e["table"].isNotNull()
        blocks = F.when(e["count"] > 0, _blocks(wins, size, e)).otherwise(empty(BLOCK))
        return F.when(
            e["version"].isNotNull() & e["count"].isNotNull() & readable,
            F.struct(
                e["dir"].alias("dir_pos"), e["version"].alias("version"), blocks.alias("blocks")
            ),
        )

    return F.when(
        (size >= 20) & starts_with(wins, size - 4, b"SEFT"),
        staged({}, directory, position, header, table, result=result),
    )


def _blocks(wins: Column, size: Column, e: Env) -> Column:
    def entry(i: Column) -> Column:
        row = F.substring(e["table"], (i * 12 + 1).cast("int"), F.lit(12))
        return let(
            row,
            lambda r: F.struct(
                i.cast("int").alias("ord"),
                uint_le(part(r, 2, 2), 2).alias("typ"),
                (e["dir"] - uint_le(part(r, 4, 4), 4)).alias("pos"),
                uint_le(part(r, 8, 4), 4).alias("size"),
            ),
        )

    def named(b: Column) -> Column:
        declared = u32_le(wins, b["pos"] + 4)
        return let(
            F.when(declared <= b["size"] - 8, declared),
            lambda n: F.struct(
                b["ord"].alias("ord"),
                b["typ"].alias("typ"),
                F.when(
                    n.isNotNull(),
                    F.coalesce(
                        F.make_valid_utf8(read_at(wins, b["pos"] + 8, n).cast("string")), F.lit("")
                    ),
                ).otherwise("").alias("name"),
                n.isNotNull().alias("name_read"),
                (b["pos"] + 8 + F.coalesce(n, F.lit(len(CLIP_BLOCK_NAME)))).alias("payload_off"),
                F.greatest(
                    b["size"] - 8 - F.coalesce(n, F.lit(len(CLIP_BLOCK_NAME))), long(0)
                ).alias("payload_len"),
            ),
        )

    entries = F.filter(
        F.transform(upto(e["count"]), entry),
        lambda b: (b["size"] >= 8) & (b["pos"] >= 0) & (b["pos"] < e["dir"]),
    )
    return F.filter(
        F.transform(entries, named),
        lambda b: (b["name_read"] | (b["typ"] == CLIP_BLOCK_TYPE))
        & (b["payload_len"] > 0)
        & (b["payload_off"] + b["payload_len"] <= size),
    )


def valid_range(off: Column, length: Column, size: Column) -> Column:
    """A non-empty range inside the file that does not start at 0."""
    end = F.try_add(off, length)
    return F.coalesce((length > 0) & (off > 0) & (end <= size), F.lit(False))


def is_clip_block(b: Column) -> Column:
    return (b["typ"] == CLIP_BLOCK_TYPE) | (b["name"] == CLIP_BLOCK_NAME)


def trailer_range(wins: Column, size: Column, blocks: Column) -> Column:
    """Range of the clip: the first clip block, or where its 12-byte pointer record leads."""

    def pointed(b: Column) -> Column:
        record = F.when(b["payload_len"] >= 12, read_at(wins, b["payload_off"], 12))
        return let(
            record,
            lambda r: F.when(
                F.coalesce(part(r, 0, 4) == F.lit(bytearray(b"mpv2")), F.lit(False)),
                F.struct(
                    uint(part(r, 4, 4)).alias("off"), uint(part(r, 8, 4)).alias("len")
                ),
            ),
        )

    def resolve(b: Column) -> Column:
        return let(
            pointed(b),
            lambda p: F.when(valid_range(p["off"], p["len"], size), p).when(
                valid_range(b["payload_off"], b["payload_len"], size),
                F.struct(b["payload_off"].alias("off"), b["payload_len"].alias("len")),
            ),
        )

    return let(first_where(blocks, is_clip_block), resolve)


def trailer_markers(blocks: Column) -> Column:
    """Block names; the clip block is named by its type when its header was out of sight."""
    return F.array_compact(
        F.transform(
            blocks,
            lambda b: F.when(b["name"] != "", b["name"]).when(
                b["typ"] == CLIP_BLOCK_TYPE, F.lit(CLIP_BLOCK_NAME)
            ),
        )
    )
