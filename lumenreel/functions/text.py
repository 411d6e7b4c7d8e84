"""Display text, dates and the classification of catalog rows.

The catalog columns these read are described in ``operators.catalog``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and texts that appear in results.
KIND_LABELS = {
    "motion": "Motion", "live": "Live", "still": "Still", "video": "Video",
    "other": "File", "unknown": "File",
}
KINDS = ["motion", "live", "still", "video", "problem"]
UNREADABLE = "This file could not be read."
NOT_EXTRACTED = "An embedded video was detected but not extracted."
UNITS = ["B", "kB", "MB", "GB", "TB"]
EXIF_DATE = r"^(\d{4}:\d{2}:\d{2})[ T](\d{2}:\d{2}:\d{2})"
DATE_PATTERN = "yyyy-MM-dd HH:mm"


def _tenths(value: Column) -> Column:
    """``value`` (1 to 1000) in tenths, rounded half up on its exact binary value."""
    whole = F.floor(value)
    bits = ((value - whole) * F.lit(2.0**52)).cast("bigint")
    return whole * 10 + F.shiftright(bits * 20 + F.lit(2**52), 53)


def format_bytes(size: Column) -> Column:
    """Base-1000 size text: one decimal below 100, none for bytes or from 100 up (F1)."""
    value = size.cast("double")
    text = None
    for unit in UNITS:
        if unit == "B":
            shown = F.concat(F.floor(value + 0.5).cast("string"), F.lit(" B"))
        else:
            tenths = _tenths(value)
            shown = F.when(
                value < 100,
                F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")),
            ).otherwise(F.floor(value + 0.5).cast("string"))
            shown = F.concat(shown, F.lit(f" {unit}"))
        last = unit == UNITS[-1]
        if text is None:
            text = F.when(value < 1000, shown)
        else:
            text = text.otherwise(shown) if last else text.when(value < 1000, shown)
        value = value / 1000
    return F.when(size > 0, text).otherwise("0 B")


def format_duration(ms: Column) -> Column:
    """``1m 05s`` or ``7s``; empty unless positive (F2)."""
    total = F.floor(ms.cast("double") / 1000 + 0.5).cast("bigint")
    minutes = F.floor(total / 60).cast("bigint")
    seconds = (total % 60).cast("string")
    return (
        F.when(ms.isNull() | (ms <= 0), "")
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), F.lpad(seconds, 2, "0"), F.lit("s")))
        .otherwise(F.concat(seconds, F.lit("s")))
    )


def format_datetime(when_ms: Column) -> Column:
    """Fixed-pattern date text; empty for 0 or NULL."""
    return F.when(
        F.coalesce(when_ms, F.lit(0)) != 0, F.date_format(F.timestamp_millis(when_ms), DATE_PATTERN)
    ).otherwise("")


def parse_exif_date(text: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` (or with a T) read as UTC; NULL when it is not a date."""
    day = F.regexp_extract(text, EXIF_DATE, 1)
    time = F.regexp_extract(text, EXIF_DATE, 2)
    return F.try_to_timestamp(
        F.when(day != "", F.concat(day, F.lit(" "), time, F.lit("Z"))),
        F.lit("yyyy:MM:dd HH:mm:ssX"),
    )


def captured_at(taken_at: Column, mtime_ms: Column) -> Column:
    """Capture time in epoch ms: the EXIF date, else the file time, else 0."""
    return F.coalesce(
        F.nullif(F.unix_millis(parse_exif_date(taken_at)), F.lit(0).cast("bigint")),
        F.nullif(mtime_ms, F.lit(0).cast("bigint")),
        F.lit(0).cast("bigint"),
    )


def yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def classify() -> Column:
    """The library kind of a catalog row (F6); the order of the tests is the definition."""
    return (
        F.when(F.col("status").isin("failed", "open"), "problem")
        .when(F.col("kind") == "video", "video")
        .when(F.col("companion_id").isNotNull(), "live")
        .when(yes(F.col("motion.playable")), "motion")
        .when(F.col("still").isNotNull(), "still")
        .when(yes(F.col("motion.found")), "problem")
        .otherwise("still")
    )


def kind_label(kind: Column) -> Column:
    """Label of a kind; a kind without one is its own label."""
    labels = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, kind), kind)


def badges() -> Column:
    """Short labels of a row, in display order."""
    family, codec = F.col("motion.family"), F.coalesce(F.col("motion.codec"), F.lit(""))
    width, height = F.col("still.width"), F.col("still.height")
    fixed = F.array(
        F.when(yes(F.col("motion.playable")), "MOTION"),
        F.when(F.col("companion_id").isNotNull(), "LIVE"),
        F.when(family == "samsung", "SAMSUNG")
        .when(family == "google", "GOOGLE")
        .when(family.startswith("heif"), "HEIC ITEM"),
        F.when(F.col("container") == "heif", "HEIC")
        .when(F.col("container") == "avif", "AVIF")
        .when(F.col("container") == "mp4", "MP4"),
        F.when(codec.startswith("hvc1") | codec.startswith("hev1"), "HEVC"),
        F.when(
            (width > 0) & (height > 0),
            F.concat(width.cast("string"), F.lit("×"), height.cast("string")),
        ),
    )
    marked = F.filter(
        F.coalesce(F.col("markers"), F.array().cast("array<string>")),
        lambda m: m.contains("MotionPhoto_Data"),
    )
    return F.concat(F.array_compact(fixed), F.transform(marked, lambda m: F.lit("EmbeddedVideoFile")))


def problem_text() -> Column:
    """Why a row cannot be played, or empty (F8)."""
    return (
        F.when(F.col("status").isin("failed", "open"), F.coalesce(F.col("error"), F.lit(UNREADABLE)))
        .when(F.col("motion").isNull() | yes(F.col("motion.playable")), "")
        .when(
            yes(F.col("motion.found")), F.coalesce(F.col("motion.reason"), F.lit(NOT_EXTRACTED))
        )
        .otherwise("")
    )


def describe() -> Column:
    """Camera, time, size, dimensions and clip length on one line."""
    camera = F.trim(
        F.concat_ws(
            " ",
            F.nullif(F.col("meta.make"), F.lit("")),
            F.nullif(F.col("meta.model"), F.lit("")),
        )
    )
    when_text = format_datetime(captured_at(F.col("meta.taken_at"), F.col("mtime_ms")))
    width, height = F.col("still.width"), F.col("still.height")
    length = format_duration(F.col("motion.duration_ms"))
    line = F.concat_ws(
        " · ",
        F.nullif(camera, F.lit("")),
        F.nullif(when_text, F.lit("")),
        format_bytes(F.col("size")),
        F.when(
            (width > 0) & (height > 0),
            F.concat(width.cast("string"), F.lit("×"), height.cast("string")),
        ),
        F.when(length != "", F.concat(F.lit("motion "), length)),
    )
    return (
        F.when(F.col("status") == "pending", "waiting…")
        .when(F.col("status") == "failed", F.coalesce(F.col("error"), F.lit("unreadable")))
        .otherwise(line)
    )


def clip_failure_reason(companion_codec: Column) -> Column:
    """Category of a clip that a player cannot open."""
    codec = F.coalesce(F.col("motion.codec"), companion_codec, F.lit(""))
    return (
        F.when(F.col("companion_id").isNotNull(), "companion-codec")
        .when(codec.rlike("^(hvc1|hev1)") & (F.col("container") == "heif"), "hevc-still-and-clip")
        .when(codec != "", "clip-codec")
        .otherwise("codec-unknown")
    )


def still_failure_reason() -> Column:
    """Category of a still that a viewer cannot draw."""
    modern = F.col("container").isin("heif", "avif")
    return (
        F.when(modern & yes(F.col("motion.playable")), "hevc-still-with-clip")
        .when(modern, "hevc-still")
        .otherwise("unsupported-still")
    )


def marker_seconds(timestamp_us: Column) -> Column:
    """Position of the still frame in the clip, in seconds."""
    return timestamp_us / F.lit(1e6)


# -- packet values ------------------------------------------------------------------------------


def trim_ascii(text: Column) -> Column:
    """Strip ASCII white space (F16)."""
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def parse_u64(text: Column) -> Column:
    """Digits only, at most 20 of them; NULL when too large for a LONG."""
    digits = F.trim(text)
    return F.when(digits.rlike("^[0-9]{1,20}$"), digits.try_cast("bigint"))


def parse_i64(text: Column) -> Column:
    """Like ``parse_u64`` with an optional minus sign."""
    digits = F.trim(text)
    return F.when(digits.rlike("^-?[0-9]{1,20}$"), digits.try_cast("bigint"))


def parse_flag(text: Column) -> Column:
    """True, false, or NULL for anything else."""
    return F.when(text.isin("1", "true", "True", "TRUE", "yes"), True).when(
        text.isin("0", "false", "False", "FALSE", "no"), False
    )
