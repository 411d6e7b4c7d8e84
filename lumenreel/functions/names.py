"""File-name rules: extension, junk, media families and the pairing key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions that count as stills and as videos, and the names of the files that
# operating systems leave next to pictures.
STILL_EXTENSIONS = [
    "jpg", "jpeg", "jpe", "jfif", "heic", "heif", "hif", "avif", "png", "webp", "gif", "tif", "tiff",
    "bmp", "dng", "cr2", "cr3", "nef", "arw", "orf", "rw2", "raf", "srw", "pef",
]
VIDEO_EXTENSIONS = ["mp4", "m4v", "mov", "3gp", "3g2", "mkv", "webm", "avi", "hevc", "265"]
JUNK_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini"]
JUNK_PREFIXES = ["._", ".Spotlight-", ".fseventsd"]


def ext(name: Column) -> Column:
    """Lower-cased text after the last dot; empty when the only dot leads the name."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def is_junk(name: Column) -> Column:
    """System leftovers, matched case-sensitively."""
    junk = name.isin(JUNK_NAMES)
    for prefix in JUNK_PREFIXES:
        junk = junk | name.startswith(prefix)
    return junk


def is_scannable(name: Column) -> Column:
    """A known media extension and not a leftover."""
    return ~is_junk(name) & ext(name).isin(STILL_EXTENSIONS + VIDEO_EXTENSIONS)


def family_ext(extension: Column) -> Column:
    """``video`` or ``unknown``."""
    return F.when(extension.isin(VIDEO_EXTENSIONS), "video").otherwise("unknown")


def pair_key(name: Column) -> Column:
    """Lower-cased name without its extension; a leading dot is not an extension."""
    return F.lower(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"))


def file_id(path: Column, size: Column, mtime_ms: Column) -> Column:
    return F.concat_ws(":", path, size.cast("string"), mtime_ms.cast("string"))


def clip_name(name: Column) -> Column:
    """Stem plus ``-motion.mp4``."""
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("-motion.mp4"))
