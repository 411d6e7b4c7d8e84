"""JPEG segments and the EXIF tags inside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import (
    has, long, part, read_at, starts_with, u8, u16, uint,
)
from ..functions.flow import Env, Step, empty, first_where, gather, last_where, let, named, null, repeat, step_columns, upto

WALK = "struct<pos:bigint,segments:array<struct<marker:bigint,start:bigint,data_start:bigint,data_len:bigint>>>"
SEGMENT = "struct<marker:bigint,start:bigint,data_start:bigint,data_len:bigint>"
RANGE = "struct<off:bigint,len:bigint>"
ENTRY = "struct<tag:bigint,typ:bigint,n:bigint,at:bigint,v8:bigint,v16:bigint,v32:bigint>"

# The tag numbers that are read.
TAG_WIDTH, TAG_HEIGHT = 0x0100, 0x0101
TAG_MAKE, TAG_MODEL, TAG_ORIENTATION, TAG_SOFTWARE, TAG_DATETIME = 0x010F, 0x0110, 0x0112, 0x0131, 0x0132
TAG_THUMB_OFF, TAG_THUMB_LEN = 0x0201, 0x0202
TAG_SUB_IFD, TAG_TAKEN, TAG_NOTE, TAG_SUB_WIDTH, TAG_SUB_HEIGHT, TAG_LENS = (
    0x8769, 0x9003, 0x927C, 0xA002, 0xA003, 0xA434,
)


def jpeg_segments(wins: Column, walk: Column | None = None) -> Column:
    """``struct(segments, complete, pos, blind)``: marker segments up to the image data.

    The walk stands at ``pos``. It is ``blind`` if the marker there isn't visible, or if it has made all its rounds;
    it can go on from there with ``walk``, a ``WALK`` of a former pass, once more of the file is read. With ``walk``
    only segments of EXIF and packets are kept.
    """
    pos = long(2) if walk is None else walk["pos"]
    no, yes = F.lit(False), F.lit(True)

    def state(pos: Column, stopped: Column, complete: Column, blind: Column, seg: Column | None = None) -> Column:
        walked = F.struct(pos.alias("pos"), stopped.alias("stopped"), complete.alias("complete"), blind.alias("blind"))
        return F.struct(walked.alias("state"), (null(SEGMENT) if seg is None else seg).alias("item"))

    def step(acc: Column) -> Column:
        pos = acc["pos"]
        look = F.struct(
            u8(wins, pos).alias("mark"), u8(wins, pos + 1).alias("code"),
            u16(wins, pos + 2).alias("len"),
        )

        def move(x: Column) -> Column:
            code = x["code"]
            seg = F.struct(
                code.alias("marker"), pos.alias("start"), (pos + 4).alias("data_start"),
                (x["len"] - 2).alias("data_len"),
            )
            kept = seg if walk is None else F.when(code == 0xE1, seg)
            return (
                F.when(x["mark"] != 0xFF, state(pos, yes, no, no))
                .when(x["mark"].isNull() | code.isNull(), state(pos, yes, no, yes))
                .when(code == 0xFF, state(pos + 1, no, no, yes))
                .when(code.isin(0xDA, 0xD9), state(pos, yes, yes, no))
                .when((code == 1) | code.between(0xD0, 0xD7), state(pos + 2, no, no, yes))
                .when(x["len"].isNull(), state(pos, yes, no, yes))
                .when(x["len"] < 2, state(pos, yes, no, no))
                .otherwise(state(pos + 2 + x["len"], no, no, yes, kept))
            )

        return let(look, move)

    start = F.struct(pos.alias("pos"), no.alias("stopped"), no.alias("complete"), yes.alias("blind"))
    former = empty(SEGMENT) if walk is None else walk["segments"]
    # a step reads a marker that no step before it has read
    visible = F.aggregate(wins, long(1), lambda n, w: n + F.greatest(w["end"] - F.greatest(w["off"], pos), long(0)))
    walked = let(
        gather(start, lambda acc: ~acc["stopped"], step, SEGMENT, visible),
        lambda x: F.struct(
            F.concat(former, x["out"]).alias("segments"), *(x["state"][k].alias(k) for k in ("complete", "pos", "blind"))
        ),
    )
    return F.when(starts_with(wins, 0, b"\xff\xd8\xff"), walked).otherwise(
        F.struct(empty(SEGMENT).alias("segments"), no.alias("complete"), long(2).alias("pos"), no.alias("blind"))
    )


def unread_from(wins: Column, size: Column, jpeg: Column) -> Column:
    """Where the header is to be read on: at an EXIF or packet segment that isn't all visible, else where the walk
    is blind; NULL when nothing is missing."""
    hidden = first_where(
        jpeg["segments"],
        lambda s: (s["marker"] == 0xE1) & (s["start"] < size)
        & ~has(wins, s["start"], F.least(s["data_len"] + 4, size - s["start"])),
    )
    return F.coalesce(hidden["start"], F.when(jpeg["blind"] & (jpeg["pos"] < size), jpeg["pos"]))


def header_text(wins: Column, jpeg: Column) -> Column:
    """The bytes of the windows that begin in the header, one after the other."""
    inside = F.filter(wins, lambda w: w["off"] <= jpeg["pos"])
    return let(
        inside,
        lambda ws: F.when(F.size(ws) == 1, F.get(ws, 0)["data"]).otherwise(
            F.aggregate(ws, F.lit(bytearray()), lambda acc, w: F.concat(acc, w["data"]))
        ),
    )


class _Tiff:
    """Reads in the byte order of one TIFF block; ``t`` holds ``base``, ``end`` and ``little``."""

    def __init__(self, wins: Column, t: Column) -> None:
        self.wins, self.base, self.end, self.little = wins, t["base"], t["end"], t["little"]

    def value(self, data: Column, n: int) -> Column:
        """Unsigned integer of ``n`` bytes in the block's byte order."""
        back = "".join(f"${i}" for i in range(n, 0, -1))
        ahead = "".join(f"${i}" for i in range(1, n + 1))
        order = F.when(self.little, back).otherwise(ahead)
        cells = F.regexp_replace(F.hex(data), F.lit("^" + "(..)" * n + "$"), order)
        return F.conv(cells, 16, 10).cast("bigint")

    def u16(self, at: Column) -> Column:
        return self.value(read_at(self.wins, at, 2), 2)

    def u32(self, at: Column) -> Column:
        return self.value(read_at(self.wins, at, 4), 4)

    def in_range(self, at: Column, n: Column | int) -> Column:
        return F.coalesce((at >= self.base) & (at + n <= self.end), F.lit(False))

    def entries(self, at: Column, count: Column) -> Column:
        """Tag rows of one directory, each with its inline value read at three widths."""

        def row(i: Column) -> Column:
            entry = at + 2 + i * 12
            raw = F.when(self.in_range(entry, 12), read_at(self.wins, entry, 12))
            return let(
                raw,
                lambda r: F.struct(
                    self.value(part(r, 0, 2), 2).alias("tag"),
                    self.value(part(r, 2, 2), 2).alias("typ"),
                    self.value(part(r, 4, 4), 4).alias("n"),
                    (entry + 8).alias("at"),
                    uint(part(r, 8, 1)).alias("v8"),
                    self.value(part(r, 8, 2), 2).alias("v16"),
                    self.value(part(r, 8, 4), 4).alias("v32"),
                ),
            )

        return F.filter(F.transform(upto(count), row), lambda x: x["tag"].isNotNull())

    def number(self, x: Column) -> Column:
        return F.when(
            x["n"] > 0,
            F.when(x["typ"] == 3, x["v16"])
            .when(x["typ"] == 4, x["v32"])
            .when(x["typ"] == 9, F.when(x["v32"] >= 2**31, long(2**32) - x["v32"]).otherwise(x["v32"]))
            .when(x["typ"].isin(1, 7), x["v8"]),
        )

    def text(self, x: Column) -> Column:
        n = x["n"]
        at = F.when(n <= 4, x["at"]).otherwise(self.base + x["v32"])
        raw = F.when(x["typ"].isin(2, 7), read_at(self.wins, at, n))
        cut = F.substring_index(F.make_valid_utf8(raw.cast("string")), "\0", 1)
        return F.nullif(F.regexp_replace(cut, r"^\s+|\s+$", ""), F.lit(""))

    def location(self, x: Column) -> Column:
        """Range of a value that is stored elsewhere, or inline when it fits four bytes."""
        unit = (
            F.when(x["typ"].isin(1, 2, 6, 7), 1).when(x["typ"].isin(3, 8), 2)
            .when(x["typ"].isin(4, 9, 11), 4).when(x["typ"].isin(5, 10, 12), 8).otherwise(0)
        )
        return let(
            F.struct((unit * x["n"]).cast("bigint").alias("len"), (self.base + x["v32"]).alias("far")),
            lambda v: F.when(v["len"] == 0, null(RANGE))
            .when(v["len"] <= 4, F.struct(x["at"].alias("off"), v["len"].alias("len")))
            .when(
                self.in_range(v["far"], v["len"]),
                F.struct(v["far"].alias("off"), v["len"].alias("len")),
            ),
        )


def _tag(entries: Column, number: int) -> Column:
    return last_where(entries, lambda x: x["tag"] == number)


def _tiff_header(wins: Column, segments: Column) -> Column:
    """``struct(base, end, little)`` of the last EXIF segment with a valid header."""

    def header(seg: Column) -> Column:
        base = seg["data_start"] + 6
        order = F.decode(read_at(wins, base, 2), "ISO-8859-1")
        return let(
            F.struct(
                base.alias("base"),
                (base + F.greatest(seg["data_len"] - 6, long(0))).alias("end"),
                (order == "II").alias("little"),
                order.isin("II", "MM").alias("known"),
            ),
            lambda t: F.when(
                F.coalesce(t["known"] & (_Tiff(wins, t).u16(base + 2) == 42), F.lit(False)), t
            ),
        )

    marked = F.filter(
        segments,
        lambda s: (s["marker"] == 0xE1)
        & (s["data_len"] >= 6)
        & starts_with(wins, s["data_start"], b"Exif\0\0"),
    )
    return last_where(F.transform(marked, header), lambda t: t.isNotNull())


def exif_steps(env: Env, out: str = "exif") -> list[Step]:
    """Camera, time, size, thumbnail and note location from the last readable EXIF segment.

    ``env`` names ``wins`` and ``segments``. Position data is never read.
    """

    def reader(e: Env) -> _Tiff:
        return _Tiff(e["wins"], e["tiff"])

    def header(e: Env) -> Env:
        return {"tiff": _tiff_header(e["wins"], e["segments"])}

    def chain(e: Env) -> Env:
        tiff = reader(e)
        zero = F.struct(
            tiff.u32(tiff.base + 4).alias("next"), empty("struct<at:bigint,count:bigint>").alias("out")
        )

        def step(acc: Column) -> Column:
            at = tiff.base + acc["next"]
            # a chain that comes back to a directory ends
            new = ~F.exists(acc["out"], lambda x: x["at"] == at)
            usable = F.coalesce((acc["next"] > 0) & tiff.in_range(at, 2) & new, F.lit(False))
            return let(
                F.when(usable, tiff.u16(at)),
                lambda n: F.when(
                    n.isNotNull(),
                    F.struct(
                        tiff.u32(at + 2 + n * 12).alias("next"),
                        F.concat(
                            acc["out"], F.array(F.struct(at.alias("at"), n.alias("count")))
                        ).alias("out"),
                    ),
                ).otherwise(F.struct(null("bigint").alias("next"), acc["out"].alias("out"))),
            )

        return {
            "ifds": repeat(zero, lambda acc: acc["next"].isNotNull(), step, tiff.end - tiff.base + 1)["out"]
        }

    def main(e: Env) -> Env:
        tiff = reader(e)
        first = F.get(e["ifds"], F.lit(0))
        return {"main": tiff.entries(first["at"], first["count"])}

    def sub(e: Env) -> Env:
        tiff = reader(e)
        at = let(_tag(e["main"], TAG_SUB_IFD), lambda x: tiff.base + tiff.number(x))
        return {
            "sub": let(
                at,
                lambda a: F.when(
                    tiff.in_range(a, 2), tiff.entries(a, tiff.u16(a))
                ).otherwise(empty(ENTRY)),
            )
        }

    def later(e: Env) -> Env:
        tiff = reader(e)

        def thumb(ifd: Column) -> Column:
            return let(
                tiff.entries(ifd["at"], ifd["count"]),
                lambda rows: let(
                    F.struct(
                        let(_tag(rows, TAG_THUMB_OFF), tiff.number).alias("off"),
                        let(_tag(rows, TAG_THUMB_LEN), tiff.number).alias("len"),
                        let(_tag(rows, TAG_ORIENTATION), tiff.number).alias("turn"),
                    ),
                    lambda v: F.struct(
                        F.when(
                            (v["len"] > 0) & tiff.in_range(tiff.base + v["off"], v["len"]),
                            F.struct((tiff.base + v["off"]).alias("off"), v["len"].alias("len")),
                        ).alias("thumb"),
                        v["turn"].alias("turn"),
                    ),
                ),
            )

        return {"later": F.transform(F.slice(e["ifds"], F.lit(2), F.greatest(F.size(e["ifds"]) - 1, F.lit(0))), thumb)}

    def result(e: Env) -> Column:
        tiff = reader(e)
        main_, sub_ = e["main"], e["sub"]
        fields = named(
            {
                "make": let(_tag(main_, TAG_MAKE), tiff.text),
                "model": let(_tag(main_, TAG_MODEL), tiff.text),
                "software": let(_tag(main_, TAG_SOFTWARE), tiff.text),
                "lens": let(_tag(sub_, TAG_LENS), tiff.text),
                "taken_at": let(_tag(sub_, TAG_TAKEN), tiff.text),
                "orientation": let(_tag(main_, TAG_ORIENTATION), tiff.number).bitwiseAND(0xFFFF).cast("int"),
                "width": F.coalesce(
                    let(_tag(main_, TAG_WIDTH), tiff.number), let(_tag(sub_, TAG_SUB_WIDTH), tiff.number)
                ),
                "height": F.coalesce(
                    let(_tag(main_, TAG_HEIGHT), tiff.number), let(_tag(sub_, TAG_SUB_HEIGHT), tiff.number)
                ),
                "thumb": last_where(e["later"], lambda x: x["thumb"].isNotNull())["thumb"],
                "thumb_orientation": last_where(e["later"], lambda x: x["turn"].isNotNull())["turn"].cast("int"),
                "maker_note": let(_tag(sub_, TAG_NOTE), tiff.location),
            }
        )

        return F.when(e["tiff"].isNotNull(), fields)

    return step_columns(env, header, chain, main, sub, later, out=out, result=result)
