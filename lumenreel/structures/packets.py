"""Facts and directory items from the metadata packet in the head of a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import blob, find_all, latin1
from ..functions.flow import empty, let
from ..functions.text import parse_flag, parse_i64, parse_u64, trim_ascii

ITEM = "struct<ord:int,mime:string,semantic:string,length:bigint,padding:bigint>"

# Property names, marker strings and limits of the packet format.
FLAG_MOTION = "MotionPhoto"
FLAG_MICRO = "MicroVideo"
MARKERS = ["MotionPhoto_Data", "EmbeddedVideoFile", "EmbeddedVideoType", "MotionPhoto_Data_"]
NAMESPACE = "http://ns.adobe.com/xap/1.0/"
REGION = 8192
ELEMENT = 512

SPACE = r"[ \t\n\r]*"
EDGE = r"(?:^|[ \t\n\r<:])"
VALUE = r"""("[^"]*"|'[^']*'|[^"' \t>/][^ \t>/]*)"""


def _unquote(value: Column) -> Column:
    return trim_ascii(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"))


def _first(text: Column, pattern: str) -> Column:
    """First group of the first match, NULL without a match."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def _first_filled(text: Column, pattern: str) -> Column:
    """Like ``_first`` for a group that is never empty; what is behind the match isn't looked at."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """Value of ``name=`` at a token edge of a tag."""
    # a plain search is far cheaper than the pattern, which most texts would go through in vain
    return F.when(F.contains(tag, F.lit(name)), _unquote(_first_filled(tag, EDGE + name + SPACE + "=" + SPACE + VALUE)))


def _element(body: Column, name: str) -> Column:
    """Text of the first element ``name`` without attributes."""
    return F.when(F.contains(body, F.lit(f"<{name}>")), trim_ascii(_first(body, f"<{name}>([^<]*)<")))


def place(text: Column, name: str) -> Column:
    """1-based position of the first ``name``, 0 without one. Literal patterns skip ahead, ``locate`` tries every place."""
    return F.regexp_instr(text, F.lit(name))


def from_first(text: Column, names: list[str]) -> Column:
    """``text`` from the character before the first of ``names``; NULL when it has none of them."""
    places = F.struct(*[F.nullif(place(text, name), F.lit(0)).alias(name) for name in names])
    first = let(places, lambda p: F.least(*[p[name] for name in names]) if len(names) > 1 else p[names[0]])
    return let(first, lambda at: F.substring(text, F.greatest(at - 1, F.lit(1)), F.char_length(text)))


def property_text(text: Column, name: str) -> Column:
    """A property by local name under any prefix, as attribute or element."""
    element = r">[ \t\n\r]*[^<\s][^<]*(?=<)"
    pattern = EDGE + name + "(" + SPACE + "=" + SPACE + VALUE + "|" + element + ")"

    def found(at: Column) -> Column:
        # no match begins before the character ahead of the first name
        hit = _first_filled(F.substring(text, F.greatest(at - 1, F.lit(1)), F.char_length(text)), pattern)
        return F.when(at > 0, _unquote(F.regexp_replace(hit, r"^(?:[ \t\n\r]*=[ \t\n\r]*|>)", "")))

    return F.when(F.contains(text, F.lit(name)), let(F.locate(name, text), found))


def packet_facts(head: Column) -> Column:
    """``struct(present, motion_photo, version, timestamp_us, micro_video, micro_offset,
    micro_timestamp_us, markers)`` from the head bytes."""
    has_motion = F.contains(head, blob(FLAG_MOTION.encode()))
    has_micro = F.contains(head, blob(FLAG_MICRO.encode()))

    def facts(text: Column) -> Column:
        def value(name: str, parse: Callable[[Column], Column]) -> Column:
            return let(property_text(text, name), parse)

        return F.struct(
            value(FLAG_MOTION, parse_flag).alias("motion_photo"),
            value("MotionPhotoVersion", parse_u64).alias("version"),
            value("MotionPhotoPresentationTimestampUs", parse_i64).alias("motion_us"),
            value(FLAG_MICRO, parse_flag).alias("micro_video"),
            value("MicroVideoOffset", parse_u64).alias("micro_offset"),
            value("MicroVideoPresentationTimestampUs", parse_i64).alias("micro_us"),
        )

    # every name begins with one of the two, so nothing ahead of the first of them is looked at
    found = let(
        F.when(has_motion | has_micro, let(latin1(head), lambda t: from_first(t, [FLAG_MOTION, FLAG_MICRO]))),
        lambda t: F.when(t.isNotNull(), facts(t)),
    )
    markers = F.filter(
        F.array(*[F.when(F.contains(head, blob(m.encode())), F.lit(m)) for m in MARKERS]),
        lambda m: m.isNotNull(),
    )
    return let(
        found,
        lambda f: F.struct(
            F.coalesce(
                F.contains(head, blob(NAMESPACE.encode())) | has_motion | has_micro, F.lit(False)
            ).alias("present"),
            f["motion_photo"].alias("motion_photo"),
            f["version"].alias("version"),
            f["motion_us"].alias("motion_us"),
            f["micro_video"].alias("micro_video"),
            f["micro_offset"].alias("micro_offset"),
            f["micro_us"].alias("micro_us"),
            F.coalesce(markers, F.array().cast("array<string>")).alias("markers"),
        ),
    )


def directory_items(head: Column) -> Column:
    """Items listed after ``Container:Directory``, in document order.

    The list ends with its closing tag, else with the text. An item is looked for in the 8 KiB behind its "<".
    """

    def region(text: Column) -> Column:
        named = let(place(text, "Container:Directory"), lambda n: F.when(n > 0, n).otherwise(place(text, ":Directory")))
        rest = let(named, lambda at: F.substring(text, at, F.char_length(text)))
        return F.substring_index(rest, "</Container:Directory", 1)

    def item(region_text: Column, p: Column) -> Column:
        rest = F.substring(region_text, p + 2, F.lit(REGION))
        return let(
            F.struct(
                rest.alias("rest"),
                F.when(F.contains(rest, F.lit(">")), F.substring_index(rest, ">", 1))
                .otherwise(F.substring(rest, F.lit(1), F.lit(ELEMENT - 1)))
                .alias("tag"),
            ),
            lambda x: let(
                F.struct(
                    x["tag"].alias("tag"),
                    F.substring(x["rest"], F.lit(1), F.char_length(x["tag"]) + ELEMENT).alias("body"),
                ),
                fields,
            ),
        )

    def field(x: Column, name: str) -> Column:
        tries = []
        for key in (f"Item:{name}", name):
            tries.append(attribute(x["tag"], key))
            tries.append(_element(x["body"], key))
        return F.coalesce(*tries)

    def fields(x: Column) -> Column:
        return F.struct(
            field(x, "Mime").alias("mime"),
            field(x, "Semantic").alias("semantic"),
            let(field(x, "Length"), parse_u64).alias("length"),
            let(field(x, "Padding"), parse_u64).alias("padding"),
        )

    def items(region_text: Column) -> Column:
        found = F.transform(
            find_all(region_text, "<"), lambda p: item(region_text, p)
        )
        kept = F.filter(
            found,
            lambda x: x["mime"].isNotNull() | x["semantic"].isNotNull() | x["length"].isNotNull(),
        )
        return F.transform(
            kept,
            lambda x, i: F.struct(
                i.alias("ord"),
                x["mime"].alias("mime"),
                x["semantic"].alias("semantic"),
                x["length"].alias("length"),
                x["padding"].alias("padding"),
            ),
        )

    return F.when(
        F.coalesce(F.contains(head, blob(b":Directory")), F.lit(False)),
        let(region(latin1(head)), items),
    ).otherwise(empty(ITEM))


def stored_length(item: Column) -> Column:
    """Bytes an item occupies at the end of the file."""
    return F.coalesce(item["length"], F.lit(0)) + F.coalesce(item["padding"], F.lit(0))


def item_is_video(mime: Column, semantic: Column) -> Column:
    """A video type whose role is unset, a clip, or the primary."""
    role = F.lower(semantic)
    return F.coalesce(mime.startswith("video/"), F.lit(False)) & (
        semantic.isNull() | role.isin("motionphoto", "primary")
    )


def item_is_image(mime: Column) -> Column:
    return F.coalesce(mime.startswith("image/"), F.lit(False))


def item_is_gain_map(semantic: Column) -> Column:
    return F.coalesce(F.lower(semantic) == "gainmap", F.lit(False))
