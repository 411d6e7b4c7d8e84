"""What kind of container a file is, and whether a range of it is a complete clip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import (
    BOX, box_at, find_in_windows, latin1, long, read_at, starts_with, walk_boxes,
)
from ..functions.codecs import brand_family
from ..functions.flow import first_where, last_where, let, null

# Media types by container.
STILL_MIME = {
    "jpeg": "image/jpeg", "heif": "image/heic", "avif": "image/avif", "png": "image/png",
    "webp": "image/webp", "gif": "image/gif", "tiff": "image/tiff",
}


def sniff(wins: Column) -> Column:
    """``struct(container, brand)`` from the first bytes (B1)."""

    def decide(brand: Column) -> Column:
        family = brand_family(brand)
        container = (
            F.when(starts_with(wins, 0, b"\xff\xd8\xff"), "jpeg")
            .when(
                starts_with(wins, 4, b"ftyp"),
                F.when(brand.isNull(), "unknown")
                .when(family.isin("heif", "avif"), family)
                .otherwise("isobmff"),
            )
            .when(starts_with(wins, 0, b"\x89PNG"), "png")
            .when(starts_with(wins, 0, b"RIFF") & starts_with(wins, 8, b"WEBP"), "webp")
            .when(starts_with(wins, 0, b"GIF8"), "gif")
            .when(starts_with(wins, 0, b"II*\0") | starts_with(wins, 0, b"MM\0*"), "tiff")
            .otherwise("unknown")
        )
        return F.struct(
            container.alias("container"),
            F.when(starts_with(wins, 4, b"ftyp"), brand).alias("brand"),
        )

    return let(latin1(read_at(wins, long(8), 4)), decide)


def still_mime(container: Column) -> Column:
    """Media type of a still container, NULL for the others."""
    types = F.create_map(*[F.lit(x) for pair in STILL_MIME.items() for x in pair])
    return F.try_element_at(types, container)


def boxes_top(wins: Column, size: Column) -> Column:
    """Boxes at the top level of the file (B2)."""
    return walk_boxes(wins, long(0), size)


def find_mpvd(wins: Column, size: Column) -> Column:
    """The first plausible ``mpvd`` box in window order."""
    hits = F.transform(
        find_in_windows(wins, "mpvd"),
        lambda p: let(p - 4, lambda at: box_at(wins, at, size)),
    )
    return first_where(hits, lambda b: (b["typ"] == "mpvd") & (b["size"] >= 16))


def trim_sefd(wins: Column, start: Column, end: Column) -> Column:
    """End of a payload without its trailing ``sefd`` box, when the boxes fill it exactly."""
    return let(
        walk_boxes(wins, start, end),
        lambda chain: let(
            F.struct(
                F.try_element_at(chain, F.lit(-1))["data_end"].alias("reached"),
                last_where(chain, lambda b: b["typ"] == "sefd")["start"].alias("tail"),
            ),
            lambda x: F.when(x["reached"] == end, F.coalesce(x["tail"], end)).otherwise(end),
        ),
    )


def complete_clip(wins: Column, start: Column, end: Column) -> Column:
    """The ``moov`` box of a range that is a whole clip: ``ftyp`` first, ``moov`` and ``mdat``
    present, boxes ending exactly at ``end``. NULL otherwise (B20)."""
    return let(
        walk_boxes(wins, start, end),
        lambda chain: F.when(
            F.coalesce(
                (F.get(chain, F.lit(0))["typ"] == "ftyp")
                & (F.try_element_at(chain, F.lit(-1))["data_end"] == end)
                & F.exists(chain, lambda b: b["typ"] == "mdat"),
                F.lit(False),
            ),
            last_where(chain, lambda b: b["typ"] == "moov"),
        ),
    )


def appended_clip(wins: Column, size: Column) -> Column:
    """``struct(start, moov)`` of the earliest later ``ftyp`` whose boxes end at EOF."""
    hits = F.filter(
        F.transform(find_in_windows(wins, "ftyp"), lambda p: p - 4),
        lambda at: at > 0,
    )
    tested = F.transform(
        hits,
        lambda at: let(
            complete_clip(wins, at, size),
            lambda moov: F.when(
                moov.isNotNull(), F.struct(at.alias("start"), moov.alias("moov"))
            ),
        ),
    )
    return F.array_min(tested)


def starts_media_box(wins: Column, off: Column, length: Column) -> Column:
    """True when a claimed range opens with a clip's box."""
    return F.when(
        length >= 16,
        let(
            F.struct(off.alias("off"), (off + length).alias("end")),
            lambda r: F.coalesce(
                box_at(wins, r["off"], r["end"])["typ"].isin("ftyp", "moov", "mdat"), F.lit(False)
            ),
        ),
    ).otherwise(F.lit(False))


def no_box() -> Column:
    return null(BOX)
