"""Bounded byte-range reads, a few windows per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .listing import _open

BATCH_BYTES = 32 * 1024 * 1024
#: Bytes between two ranges that are read with them; bytes of a JPEG header that one pass follows; of fill bytes at once.
GAP, FOLLOW, FILL = 16 * 1024, 1024 * 1024, 4096

GOT = T.ArrayType(
    T.StructType(
        [
            T.StructField("off", T.LongType()), T.StructField("len", T.LongType()),
            T.StructField("data", T.BinaryType()),
        ]
    )
)
ARROW_GOT = pa.list_(pa.struct([("off", pa.int64()), ("len", pa.int64()), ("data", pa.binary())]))


def _window(off: int, data: bytes) -> dict:
    return {"off": off, "len": len(data), "data": data}


def _near_ranges(ranges: list[dict]) -> list[tuple[int, int, list[int]]]:
    """Reads (start, end, numbers of the ranges in it): ranges with a small gap between them are one read."""
    reads: list[tuple[int, int, list[int]]] = []
    for k in sorted(range(len(ranges)), key=lambda k: ranges[k]["off"]):
        start, end = ranges[k]["off"], ranges[k]["off"] + ranges[k]["len"]
        if reads and start <= reads[-1][1] + GAP:
            reads[-1] = (reads[-1][0], max(end, reads[-1][1]), [*reads[-1][2], k])
        else:
            reads.append((start, end, [k]))
    return reads


def header_windows(read: Callable[[int, int], bytes], at: int) -> list[dict]:
    """What is needed of a JPEG header from the marker at ``at`` on: the headers of its segments, and EXIF and packet
    segments as a whole. ``read(off, n)`` gives bytes; the walk ends with the header or after ``FOLLOW`` bytes."""
    found, held = [], 0
    while held < FOLLOW:
        data, step = read(at, 4), 2
        code = data[1] if len(data) > 1 and data[0] == 0xFF else None
        if code == 0xFF:
            block = read(at, FILL)
            step = max(len(block) - len(block.lstrip(b"\xff")) - 1, 1)
            data = block[: step + 1]
        elif code is not None and code not in (0x01, *range(0xD0, 0xDA), 0xDA):
            n = int.from_bytes(data[2:4], "big") if len(data) == 4 else 0
            step = 2 + n if n >= 2 else 0
            data = read(at, step) if code == 0xE1 else data
        found.append(_window(at, data))
        held += len(data)
        if code in (None, 0xD9, 0xDA) or step < (1 if code == 0xFF else 2) or not data:
            break
        at += step
    return found


def read_ranges(uri: str, ranges: list[dict], follow: int | None = None) -> tuple[list[dict], str | None]:
    """The bytes of the ranges, cut at the end of the file, or the reason they cannot be read.

    With ``follow`` what the header has from there on comes behind them.
    """
    try:
        filesystem, path = _open(uri)
        out: list[dict] = [{}] * len(ranges)
        with filesystem.open_input_file(path) as handle:
            for start, end, members in _near_ranges(ranges):
                data = handle.read_at(end - start, start)
                for k in members:
                    at = ranges[k]["off"] - start
                    out[k] = _window(ranges[k]["off"], data[at : at + ranges[k]["len"]])
            if follow is not None:
                out += header_windows(lambda off, n: handle.read_at(n, off), follow)
        return out, None
    except (OSError, ValueError, pa.ArrowException) as problem:
        return [], f"{type(problem).__name__}: {problem}"


def _append_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``got`` and ``read_error``; output batches stay near ``BATCH_BYTES``."""
    for batch in batches:
        first, held, got, errors = 0, 0, [], []
        uris, wants = batch.column("uri"), batch.column("want")
        follows = batch.column("follow").to_pylist() if "follow" in batch.schema.names else [None] * batch.num_rows
        for i in range(batch.num_rows):
            data, error = read_ranges(uris[i].as_py(), wants[i].as_py() or [], follows[i])
            got.append(data)
            errors.append(error)
            held += sum(r["len"] for r in data)
            if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(first, i + 1 - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(got, ARROW_GOT), pa.array(errors, pa.string())],
                    names=[*part.schema.names, "got", "read_error"],
                )
                first, held, got, errors = i + 1, 0, [], []


def path_reader(df: DataFrame) -> DataFrame:
    """Reader for ``plans.scan``: reads the ranges in ``want`` from the file named by ``uri``."""
    df = df.drop("got", "read_error")
    fields = [*df.schema.fields, T.StructField("got", GOT), T.StructField("read_error", T.StringType())]
    return df.mapInArrow(_append_ranges, T.StructType(fields))


def balanced(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread files over tasks regardless of which folder they came from."""
    return files.repartition(partitions) if partitions else files.repartition(
        int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
