"""Catalog tables, reports and exported clips."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import clip_name
from ..operators.catalog import clip_plan
from ..operators.skew import join_to_unique
from .listing import _open

CLIPS = "file_id string, name string, out_path string, bytes bigint, sha256 string, error string"
ARROW_CLIPS = pa.schema(
    [("file_id", pa.string()), ("name", pa.string()), ("out_path", pa.string()), ("bytes", pa.int64()),
     ("sha256", pa.string()), ("error", pa.string())]
)
BLOCK = 1024 * 1024


def write_catalog(catalog: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the catalog as Parquet; media bytes are never part of it."""
    catalog.write.mode(mode).parquet(path)


def report_json() -> Column:
    """Detection report of a row: core result, read statistics and pairing."""
    core = F.struct(
        "kind", "container", F.col("size").alias("file_size"), "still", "motion", "plan", "read_more",
        "meta", "markers", "boxes", "notes",
    )
    pair = F.when(
        F.col("companion_id").isNotNull(),
        F.struct(F.col("companion_id").alias("companion"), F.lit("name").alias("by")),
    )
    return F.to_json(
        F.struct(core.alias("core"), F.col("stats").alias("stats"), pair.alias("pair")),
        {"ignoreNullFields": "false"},
    )


def _write_clips(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_write_clip(out_dir, row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[n] for d in done], ARROW_CLIPS.field(n).type) for n in ARROW_CLIPS.names],
                schema=ARROW_CLIPS,
            )

    return run


def _write_clip(out_dir: str, row: dict) -> dict:
    """Write one clip under a name of its own and move it into place when it is whole."""
    folder = f"{out_dir.rstrip('/')}/{row['folder']}"
    target = f"{folder}/{row['clip']}"
    out = {"file_id": row["file_id"], "name": row["clip"], "out_path": target, "bytes": None, "sha256": None, "error": None}
    try:
        sink_fs, target_path = _open(target)
        source_fs, source_path = _open(row["source_uri"])
        sink_fs.create_dir(os.path.dirname(target_path), recursive=True)
        partial = f"{target_path}.{uuid.uuid4().hex}"
        digest, written = hashlib.sha256(), 0
        with source_fs.open_input_file(source_path) as source, sink_fs.open_output_stream(partial) as sink:
            for part in row["parts"]:
                for data in _part_blocks(source, part):
                    sink.write(data)
                    digest.update(data)
                    written += len(data)
        sink_fs.move(partial, target_path)
        return {**out, "bytes": written, "sha256": digest.hexdigest()}
    except (OSError, ValueError, pa.ArrowException) as problem:
        return {**out, "error": f"{type(problem).__name__}: {problem}"}


def _part_blocks(source: pa.NativeFile, part: dict) -> Iterator[bytes]:
    if part["t"] == "lit":
        yield part["lit"]
        return
    at, end = part["off"], part["off"] + part["len"]
    while at < end:
        data = source.read_at(min(BLOCK, end - at), at)
        if not data:
            raise ValueError("the file ends inside a planned slice")
        yield data
        at += len(data)


def export_clips(catalog: DataFrame, out_dir: str) -> DataFrame:
    """Write the clip of every playable row; returns what was written.

    A paired still gives its whole companion file (S10). Every clip has a folder named after its
    file, so equal names do not meet. Nothing is written before the result is used; a repeated
    task writes the same files again.
    """
    companions = catalog.select(F.col("file_id").alias("companion_id"), F.col("uri").alias("companion_uri"))
    rows = join_to_unique(catalog, companions, "companion_id", "file_id")
    rows = rows.withColumn("_plan", clip_plan()).filter(F.col("_plan").isNotNull())
    todo = rows.select(
        "file_id",
        clip_name(F.col("name")).alias("clip"),
        F.substring(F.sha2(F.col("file_id"), 256), 1, 16).alias("folder"),
        F.coalesce("companion_uri", "uri").alias("source_uri"),
        F.col("_plan.parts").alias("parts"),
    )
    return todo.mapInArrow(_write_clips(out_dir), CLIPS)
