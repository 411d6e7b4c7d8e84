"""Folder listings without reading any file, and file lists that are given as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import to_entries
from ..session import materialise

LISTING = "uri string, path string, name string, size bigint, mtime_ms bigint"
FOUND = f"is_folder boolean, {LISTING}"
ARROW_FOUND = pa.schema(
    [("is_folder", pa.bool_()), ("uri", pa.string()), ("path", pa.string()), ("name", pa.string()), ("size", pa.int64()),
     ("mtime_ms", pa.int64())]
)
#: Rows that a task hands on at a time; they are all it holds of a local folder.
BATCH = 4096


@cache
def _store(prefix: str) -> tuple[pafs.FileSystem, str]:
    """The client of a store, opened once per process, and the path of its root."""
    return pafs.FileSystem.from_uri(prefix + "/") if prefix else (pafs.LocalFileSystem(), "")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """Client and path of a file, given as a plain path or with scheme and authority."""
    scheme, mark, rest = uri.rpartition("://")
    authority, slash, path = rest.partition("/") if mark else ("", "", rest)
    filesystem, root = _store(f"{scheme}{mark}{authority}" if mark else "")
    return filesystem, f"{root.rstrip('/')}{slash}{unquote(path)}" if mark else path


def _entries(folder: str) -> Iterator[tuple[bool, str, str, int, int]]:
    """is_folder, uri, name, size, mtime_ms of what is directly in a folder; links to folders are not followed.

    A local folder is read page by page. A store's client gives a folder as one list.
    """
    filesystem, path = _open(folder)
    if isinstance(filesystem, pafs.LocalFileSystem):
        with os.scandir(path) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield True, f"{folder}/{entry.name}", entry.name, 0, 0
                elif entry.is_file():
                    state = entry.stat()
                    yield False, f"{folder}/{entry.name}", entry.name, state.st_size, state.st_mtime_ns // 1_000_000
        return
    for info in filesystem.get_file_info(pafs.FileSelector(path)):
        if info.type in (pafs.FileType.Directory, pafs.FileType.File):
            mtime = info.mtime_ns // 1_000_000 if info.mtime_ns is not None else 0
            yield info.type == pafs.FileType.Directory, f"{folder}/{info.base_name}", info.base_name, info.size or 0, mtime


def _listed(root: str):
    label = root.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, t) for column, t in zip(zip(*rows), ARROW_FOUND.types)], schema=ARROW_FOUND
            )

        for folders in batches:
            for folder in folders.column("uri").to_pylist():
                for is_folder, uri, name, size, mtime in _entries(folder):
                    rows.append((is_folder, uri, label + uri[len(root) :], name, size, mtime))
                    if len(rows) >= BATCH:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """uri, path, name, size and mtime_ms of every file below ``root``, also of hidden and ``_`` names.

    Folders are listed in waves: a wave's folders are rows that tasks share, what they hold is written to the
    checkpoint folder, and the folders in it are the next wave. The driver only asks whether a wave was empty. The
    files come in pieces of the size that Spark reads tables in, so a flat folder gives as many tasks as a deep one.
    """
    root = root.rstrip("/")
    frontier = spark.createDataFrame([(root,)], "uri string")
    waves = []
    while True:
        found = materialise(frontier.mapInArrow(_listed(root), FOUND))
        waves.append(found.filter("not is_folder").drop("is_folder"))
        folders = found.filter("is_folder").select("uri")
        if folders.isEmpty():
            break
        frontier = folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = waves[0]
    for wave in waves[1:]:
        files = files.unionByName(wave)
    return files


def list_media(spark: SparkSession, root: str) -> DataFrame:
    """Entries of all files below ``root``; ties in listing order follow the path."""
    return to_entries(list_files(spark, root)).withColumn("list_ord", F.col("path"))


def list_media_fast(spark: SparkSession, root: str) -> DataFrame:
    """Entries from the built-in binary source, metadata only; names starting with ``_`` or ``.``
    are not listed."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(
            F.col("path").alias("uri"), F.col("length").alias("size"),
            F.unix_millis("modificationTime").alias("mtime_ms"),
        )
    )
    name = F.url_decode(F.regexp_extract("uri", r"([^/]*)$", 1))
    named = files.withColumn("name", name).withColumn("path", F.col("uri"))
    return to_entries(named).withColumn("list_ord", F.col("path"))


def files_from_manifest(manifest: DataFrame) -> DataFrame:
    """Entries from a table with name or path, size and mtime_ms.

    Without a name it is the path's last part. Rows with neither are left out; a missing size or time counts as 0.
    """
    if "name" not in manifest.columns:
        manifest = manifest.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    if "path" not in manifest.columns:
        manifest = manifest.withColumn("path", F.lit(None).cast("string"))
    named = manifest.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.regexp_extract("path", r"([^/]*)$", 1)))
    named = named.filter(F.coalesce("name", F.lit("")) != "").withColumns(
        {c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")) for c in ("size", "mtime_ms")}
    )
    entries = to_entries(named)
    return entries if "list_ord" in entries.columns else entries.withColumn("list_ord", F.col("path"))
