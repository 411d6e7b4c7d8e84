"""Codec strings, durations and brand lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import part, uint

# The container brands and sample entry codes the results depend on.
HEIF_BRANDS = ["heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1", "mif2"]
AVIF_BRANDS = ["avif", "avis"]
VIDEO_BRANDS = [
    "isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "dash", "3gp4", "3gp5", "3g2a",
    "M4V ", "M4A ", "qt  ",
]
VIDEO_ITEM_TYPES = ["avc1", "avc3", "mp4v", "encv"]


def brand_family(brand: Column) -> Column:
    """``heif``, ``avif``, ``video`` or NULL."""
    return (
        F.when(brand.isin(HEIF_BRANDS), F.lit("heif"))
        .when(brand.isin(AVIF_BRANDS), F.lit("avif"))
        .when(brand.isin(VIDEO_BRANDS), F.lit("video"))
    )


def avc_codec(entry: Column, config: Column) -> Column:
    """Sample entry code, a dot, then profile, compatibility and level as hex."""
    return F.concat(entry, F.lit("."), F.hex(part(config, 1, 3)))


def hevc_codec(entry: Column, config: Column) -> Column:
    """RFC 6381 string from the first 13 configuration bytes."""
    first = uint(part(config, 1, 1))
    space = F.element_at(
        F.array(F.lit(""), F.lit("A"), F.lit("B"), F.lit("C")),
        (F.shiftright(first, 6) + 1).cast("int"),
    )
    bits = F.lpad(F.conv(F.hex(part(config, 2, 4)), 16, 2), 32, "0")
    compat = F.lower(F.conv(F.reverse(bits), 2, 16))
    tier = F.when(F.shiftright(first, 5).bitwiseAND(1) == 1, "H").otherwise("L")
    constraints = F.regexp_replace(F.hex(part(config, 6, 6)), "(00)+$", "")
    return F.concat(
        entry, F.lit("."), space, first.bitwiseAND(31).cast("string"),
        F.lit("."), compat,
        F.lit("."), tier, uint(part(config, 12, 1)).cast("string"),
        F.when(constraints == "", F.lit("")).otherwise(F.concat(F.lit("."), constraints)),
    )


def codec_ok(codec: Column) -> Column:
    """Shape check for a codec string."""
    return codec.rlike(
        r"^hvc1\.[A-C]?\d+\.[0-9a-f]+\.[HL]\d+([.][0-9A-Fa-f]{2,12})?$"
    ) | codec.rlike(r"^avc1\.[0-9A-Fa-f]{6}$")


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient; NULL for a zero divisor."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def duration_ms(duration: Column, timescale: Column) -> Column:
    """Integer milliseconds; NULL for a zero timescale, saturating at the largest LONG."""
    scaled = F.coalesce(
        F.try_multiply(duration.cast("bigint"), F.lit(1000).cast("bigint")), F.lit(2**63 - 1)
    )
    return int_div(scaled, timescale)
