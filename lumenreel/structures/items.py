"""Item tables of HEIF and AVIF stills (B12 to B14) and the picture size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import (
    child, latin1, long, read_at, read_upto, u16, u32, u8, uint, walk_boxes,
)
from ..functions.codecs import VIDEO_ITEM_TYPES
from ..functions.flow import Env, Step, empty, first_where, last_where, let, named, step_columns, staged, upto

ITEM = "struct<ord:int,id:bigint,item_type:string,name:string,content_type:string>"
EXTENT = "struct<off:bigint,len:bigint>"
LOCATION = f"struct<id:bigint,in_idat:boolean,extents:array<{EXTENT}>>"
REF = "struct<ref_type:string,from_id:bigint,to_id:bigint>"

# Fixed value: the largest plausible side of a picture.
MAX_SIDE = 1_000_000


def item_is_video(item_type: Column, content_type: Column) -> Column:
    """Only a video content type or a codec that no still uses counts."""
    typed = F.coalesce(content_type.startswith("video/"), F.lit(False))
    return typed | F.coalesce(item_type.isin(VIDEO_ITEM_TYPES), F.lit(False))


def _text(wins: Column, at: Column, limit: Column) -> Column:
    """``struct(text, next)`` of a zero-terminated string."""
    return let(
        latin1(read_upto(wins, at, limit - at)),
        lambda raw: let(
            F.substring_index(raw, "\0", 1),
            lambda t: F.struct(
                F.coalesce(t, F.lit("")).alias("text"),
                F.coalesce(
                    at + F.char_length(t)
                    + F.when(F.char_length(t) < F.char_length(raw), 1).otherwise(0),
                    at,
                ).alias("next"),
            ),
        ),
    )


def heif_items(wins: Column, iinf: Column) -> Column:
    """Item rows in table order; a repeated id stays as a later row."""

    def head(_: Env) -> Env:
        at = iinf["data_start"]
        old = F.coalesce(u8(wins, at), F.lit(0)) == 0
        return {
            "count": F.coalesce(
                F.when(old, u16(wins, at + 4)).otherwise(u32(wins, at + 4)), F.lit(0)
            ),
            "at": at + F.when(old, 6).otherwise(8),
        }

    def boxes(e: Env) -> Env:
        walked = walk_boxes(wins, e["at"], iinf["data_end"])
        entries = F.filter(walked, lambda b: b["typ"] == "infe")
        return {"entries": F.slice(entries, F.lit(1), F.least(e["count"], F.size(entries)).cast("int"))}

    def row(b: Column, i: Column) -> Column:
        def version(_: Env) -> Env:
            return {"v": F.coalesce(u8(wins, b["data_start"]), F.lit(2))}

        def ident(e: Env) -> Env:
            at = b["data_start"] + 4
            wide = e["v"] >= 3
            return {
                "id": F.when(wide, u32(wins, at)).otherwise(u16(wins, at)),
                "p": at + F.when(wide, 6).otherwise(4),
            }

        def typed(e: Env) -> Env:
            return {
                "typ": F.when(e["v"] >= 2, F.coalesce(latin1(read_at(wins, e["p"], 4)), F.lit("    ")))
                .otherwise("mime"),
                "name": let(
                    e["p"] + F.when(e["v"] >= 2, 4).otherwise(0),
                    lambda p: _text(wins, p, b["data_end"]),
                ),
            }

        def result(e: Env) -> Column:
            return F.struct(
                i.alias("ord"),
                e["id"].alias("id"),
                e["typ"].alias("item_type"),
                e["name"]["text"].alias("name"),
                F.when(e["typ"] == "mime", _text(wins, e["name"]["next"], b["data_end"])["text"])
                .otherwise("")
                .alias("content_type"),
            )

        return staged({}, version, ident, typed, result=result)

    return F.when(
        iinf.isNotNull(),
        staged(
            {}, head, boxes,
            result=lambda e: F.filter(F.transform(e["entries"], row), lambda x: x["id"].isNotNull()),
        ),
    ).otherwise(empty(ITEM))


def _sized(wins: Column, at: Column, n: Column) -> Column:
    return F.when(n == 0, long(0)).when(n.isin(1, 2, 3, 4, 8), uint(read_at(wins, at, n)))


def item_locations(wins: Column, iloc: Column, idat: Column) -> Column:
    """One row per located item with its absolute extents."""

    def head(_: Env) -> Env:
        at = iloc["data_start"]
        return {
            "v": F.coalesce(u8(wins, at), F.lit(0)),
            "a": u8(wins, at + 4),
            "b": u8(wins, at + 5),
        }

    def layout(e: Env) -> Env:
        indexed = e["v"].isin(1, 2)
        return {
            "off_n": F.shiftright(e["a"], 4),
            "len_n": e["a"].bitwiseAND(15),
            "base_n": F.shiftright(e["b"], 4),
            "idx_n": F.when(indexed, e["b"].bitwiseAND(15)).otherwise(0),
            "id_n": F.when(e["v"] < 2, 2).otherwise(4),
            "cm_n": F.when(indexed, 2).otherwise(0),
        }

    def count(e: Env) -> Env:
        at = iloc["data_start"] + 6
        n = F.when(e["v"] < 2, u16(wins, at)).otherwise(u32(wins, at))
        return {
            "count": F.least(F.coalesce(n, F.lit(0)), F.floor((iloc["data_end"] - at) / 4)),
            "at": at + e["id_n"],
        }

    def result(e: Env) -> Column:
        zero = F.struct(e["at"].cast("bigint").alias("at"), empty(LOCATION).alias("out"))

        def step(acc: Column, _i: Column) -> Column:
            def fields(_: Env) -> Env:
                p = acc["at"]
                return {
                    "id": _sized(wins, p, e["id_n"]),
                    "cm": F.when(
                        e["cm_n"] > 0,
                        F.coalesce(u16(wins, p + e["id_n"]), F.lit(0)).bitwiseAND(15),
                    ).otherwise(0),
                    "p": p + e["id_n"] + e["cm_n"] + 2,
                }

            def based(f: Env) -> Env:
                start = F.when(
                    f["cm"] == 1, F.coalesce(idat["data_start"], long(0))
                ).otherwise(long(0))
                return {
                    "base": F.try_add(_sized(wins, f["p"], e["base_n"]), start),
                    "n": u16(wins, f["p"] + e["base_n"]),
                    "first": f["p"] + e["base_n"] + 2 + e["idx_n"],
                    "stride": e["idx_n"] + e["off_n"] + e["len_n"],
                }

            def extents(f: Env) -> Env:
                def one(k: Column) -> Column:
                    at = f["first"] + k * f["stride"]
                    return F.struct(
                        F.try_add(f["base"], _sized(wins, at, e["off_n"])).alias("off"),
                        _sized(wins, at + e["off_n"], e["len_n"]).alias("len"),
                    )

                return {"extents": F.transform(upto(f["n"]), one)}

            def advance(f: Env) -> Column:
                whole = (
                    f["id"].isNotNull() & f["base"].isNotNull() & f["n"].isNotNull()
                    & ~F.exists(f["extents"], lambda x: x["off"].isNull() | x["len"].isNull())
                )
                loc = F.struct(
                    f["id"].alias("id"), (f["cm"] == 1).alias("in_idat"), f["extents"].alias("extents")
                )
                return F.when(
                    whole,
                    F.struct(
                        (f["first"] - e["idx_n"] + f["n"] * f["stride"]).cast("bigint").alias("at"),
                        F.concat(acc["out"], F.array(loc)).alias("out"),
                    ),
                ).otherwise(F.struct(F.lit(None).cast("bigint").alias("at"), acc["out"].alias("out")))

            return F.when(acc["at"].isNull(), acc).otherwise(
                staged({}, fields, based, extents, result=advance)
            )

        return F.aggregate(upto(e["count"]), zero, step, lambda acc: acc["out"])

    return F.when(
        iloc.isNotNull(), staged({}, head, layout, count, result=result)
    ).otherwise(empty(LOCATION))


def item_refs(wins: Column, iref: Column) -> Column:
    """Typed edges between items."""

    def edges(wide: Column) -> Column:
        def of_box(b: Column) -> Column:
            n = F.when(wide, 4).otherwise(2)
            at = b["data_start"]

            def head(_: Env) -> Env:
                return {
                    "from": F.when(wide, u32(wins, at)).otherwise(u16(wins, at)),
                    "count": F.least(u16(wins, at + n), F.floor((b["data_end"] - at - n - 2) / n)),
                }

            def result(e: Env) -> Column:
                targets = F.transform(
                    upto(e["count"]),
                    lambda k: F.struct(
                        b["typ"].alias("ref_type"),
                        e["from"].alias("from_id"),
                        _sized(wins, at + n + 2 + k * n, n).alias("to_id"),
                    ),
                )
                return F.filter(
                    targets, lambda x: x["to_id"].isNotNull() & x["from_id"].isNotNull()
                )

            return staged({}, head, result=result)

        return F.flatten(
            F.transform(walk_boxes(wins, iref["data_start"] + 4, iref["data_end"]), of_box)
        )

    return F.when(
        iref.isNotNull(),
        let(F.coalesce(u8(wins, iref["data_start"]), F.lit(0)) != 0, edges),
    ).otherwise(empty(REF))


def _ispe(wins: Column, b: Column) -> Column:
    return let(
        F.struct(
            u32(wins, b["data_start"] + 4).alias("width"), u32(wins, b["data_start"] + 8).alias("height")
        ),
        lambda s: F.when(
            s["width"].between(1, MAX_SIDE) & s["height"].between(1, MAX_SIDE), s
        ),
    )


def _primary_properties(wins: Column, ipma: Column, primary: Column) -> Column:
    """The last associated property index of each entry for the primary item."""
    at = ipma["data_start"]
    zero = F.struct((at + 8).cast("bigint").alias("at"), empty("bigint").alias("out"))
    wide_id = F.coalesce(u8(wins, at), F.lit(0)) >= 1
    wide_index = F.coalesce(u8(wins, at + 3), F.lit(0)).bitwiseAND(1) == 1

    def walk(w: Column) -> Column:
        def step(acc: Column, _i: Column) -> Column:
            id_n = F.when(w["id"], 4).otherwise(2)
            idx_n = F.when(w["idx"], 2).otherwise(1)

            def head(_: Env) -> Env:
                return {
                    "id": _sized(wins, acc["at"], id_n),
                    "n": u8(wins, acc["at"] + id_n),
                }

            def last(e: Env) -> Env:
                end = acc["at"] + id_n + 1 + e["n"] * idx_n
                mask = F.when(w["idx"], 0x7FFF).otherwise(0x7F)
                return {
                    "end": end,
                    "index": F.when(
                        (e["n"] > 0) & (e["id"] == primary),
                        _sized(wins, end - idx_n, idx_n).bitwiseAND(mask),
                    ),
                }

            def result(e: Env) -> Column:
                return F.struct(
                    e["end"].cast("bigint").alias("at"),
                    F.when(
                        e["index"].isNotNull(), F.concat(acc["out"], F.array(e["index"]))
                    ).otherwise(acc["out"]).alias("out"),
                )

            return F.when(acc["at"].isNull(), acc).otherwise(staged({}, head, last, result=result))

        return F.aggregate(
            upto(F.least(u32(wins, at + 4), F.floor((ipma["data_end"] - at - 8) / 3))), zero, step, lambda acc: acc["out"]
        )

    return let(F.struct(wide_id.alias("id"), wide_index.alias("idx")), walk)


def picture_size(wins: Column, iprp: Column, primary: Column) -> Column:
    """Size property of the primary item, else the largest size property."""

    def boxes(_: Env) -> Env:
        return {"kids": walk_boxes(wins, iprp["data_start"], iprp["data_end"])}

    def tables(e: Env) -> Env:
        return {
            "props": let(
                child(e["kids"], "ipco"),
                lambda b: F.when(
                    b.isNotNull(), walk_boxes(wins, b["data_start"], b["data_end"])
                ),
            ),
            "ipma": child(e["kids"], "ipma"),
        }

    def pick(e: Env) -> Env:
        indices = F.when(
            e["ipma"].isNotNull() & primary.isNotNull(),
            _primary_properties(wins, e["ipma"], primary),
        )
        linked = F.transform(indices, lambda i: F.get(e["props"], (i - 1).cast("int")))
        return {
            "linked": let(
                first_where(linked, lambda b: b["typ"] == "ispe"), lambda b: _ispe(wins, b)
            ),
            "sizes": F.filter(
                F.transform(
                    F.filter(e["props"], lambda b: b["typ"] == "ispe"), lambda b: _ispe(wins, b)
                ),
                lambda s: s.isNotNull(),
            ),
        }

    def result(e: Env) -> Column:
        largest = F.array_max(
            F.transform(
                e["sizes"],
                lambda s, i: F.struct(
                    (s["width"] * s["height"]).alias("area"), i.alias("i"), s.alias("size")
                ),
            )
        )
        return F.coalesce(e["linked"], largest["size"])

    return F.when(iprp.isNotNull(), staged({}, boxes, tables, pick, result=result))


def item_table_steps(env: Env, out: str = "tables") -> list[Step]:
    """``struct(primary, items, locations, refs, size)`` of the ``meta`` box; NULL without one.

    ``env`` names ``wins`` and ``meta``.
    """

    def kids(e: Env) -> Env:
        meta = e["meta"]
        return {"kids": walk_boxes(e["wins"], meta["data_start"] + 4, meta["data_end"])}

    def found(e: Env) -> Env:
        return {t: child(e["kids"], t) for t in ("pitm", "iinf", "idat", "iloc", "iref", "iprp")}

    def primary(e: Env) -> Env:
        wins, at = e["wins"], e["pitm"]["data_start"]
        return {
            "primary": F.when(u8(wins, at) == 0, u16(wins, at + 4)).otherwise(u32(wins, at + 4)),
            "refs": item_refs(wins, e["iref"]),
        }

    def entries(e: Env) -> Env:
        return {"items": heif_items(e["wins"], e["iinf"])}

    def places(e: Env) -> Env:
        return {"locations": item_locations(e["wins"], e["iloc"], e["idat"])}

    def size(e: Env) -> Env:
        return {"size": picture_size(e["wins"], e["iprp"], e["primary"])}

    def result(e: Env) -> Column:
        parts = ("primary", "items", "locations", "refs", "size")
        return F.when(e["meta"].isNotNull(), named({p: e[p] for p in parts}))

    return step_columns(env, kids, found, primary, entries, places, size, out=out, result=result)


def video_item(tables: Column) -> Column:
    """The best video item of one file: described by the primary first, then larger, then earlier.

    The same rule over tables of many files is ``operators.items.best_video_item``.
    """

    def chosen(e: Env) -> Column:
        def candidate(x: Column) -> Column:
            loc = last_where(tables["locations"], lambda s: s["id"] == x["id"])
            described = F.exists(
                tables["refs"],
                lambda r: (r["from_id"] == tables["primary"])
                & r["ref_type"].isin("cdsc", "auxl") & (r["to_id"] == x["id"]),
            )
            return let(
                loc,
                lambda s: F.struct(
                    F.when(F.coalesce(described, F.lit(False)), 0).otherwise(1).alias("far"),
                    (-F.aggregate(s["extents"], long(0), lambda a, b: a + b["len"])).alias("minus_len"),
                    F.array_position(e["ids"], x["id"]).alias("pos"),
                    x["id"].alias("id"),
                    s["in_idat"].alias("in_idat"),
                    s["extents"].alias("extents"),
                ),
            )

        videos = F.filter(
            tables["items"],
            lambda x: item_is_video(x["item_type"], x["content_type"])
            & F.coalesce(x["id"] != tables["primary"], F.lit(True))
            & ~F.exists(
                tables["refs"], lambda r: (r["ref_type"] == "dimg") & (r["to_id"] == x["id"])
            )
            & ~F.exists(
                tables["items"], lambda y: (y["id"] == x["id"]) & (y["ord"] > x["ord"])
            ),
        )
        usable = F.filter(
            F.transform(videos, candidate),
            lambda c: (F.size(c["extents"]) > 0) & ~c["in_idat"],
        )
        return F.array_min(usable)

    return staged(
        {}, lambda _: {"ids": F.transform(tables["items"], lambda x: x["id"])}, result=chosen
    )


def contiguous(extents: Column) -> Column:
    """Each extent starts where the one before it ends."""
    return F.forall(
        upto(F.size(extents) - 1),
        lambda i: F.get(extents, i.cast("int"))["off"] + F.get(extents, i.cast("int"))["len"]
        == F.get(extents, (i + 1).cast("int"))["off"],
    )
