"""Tables of integers inside files, cut into slices of fixed length that are rows of their own.

A sample table may have hundreds of millions of cells. It is never held as one value: its range is cut into slices,
each is read and decoded by itself, and a slice's sum is carried to the slices after it. What is asked for at places of
the table (the bytes before a sample) is brought to the slice that has the place. A row is one slice, with at most
two places for each of its cells, or with the chunks that lie in it. Shuffles have ``partitions`` parts where that is given, which for large tables should
grow with them, as a task holds one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scan import Reader, content_reader
from .blocks import running

#: Cells of a slice.
CELLS = 1 << 16
#: Slices whose chunks are answered in one batch.
ROWS = 256


def _parts(rows: DataFrame, partitions: int | None, by: list[str]) -> DataFrame:
    return rows if partitions is None else rows.repartition(partitions, *by)


def table_slices(tables: DataFrame, keys: list[str], cells: int = CELLS) -> DataFrame:
    """Rows ``keys``, slice, first, n, width, want: the range of every slice of ``tables`` (keys, at, count, width).

    Other columns stay, for the reader. A table without cells has no slices.
    """
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / cells)))
    rows = tables.filter("count > 0").withColumn("slice", number).withColumn("first", F.col("slice") * cells)
    n = F.least(F.col("count") - F.col("first"), F.lit(cells).cast("bigint"))
    place = F.struct((F.col("at") + F.col("first") * F.col("width")).alias("off"), (n * F.col("width")).alias("len"))
    return rows.withColumns({"n": n, "want": F.array(place)}).drop("at", "count")


def read_slices(slices: DataFrame, keys: list[str], reader: Reader = content_reader) -> DataFrame:
    """``keys``, slice, first, n, width and the ``data`` of each slice; a slice that isn't all there has NULL."""
    read = reader(slices)
    got = F.get("got", F.lit(0))
    whole = F.when(got["len"] == F.col("n") * F.col("width"), got["data"])
    return read.select(*keys, "slice", "first", "n", "width", whole.alias("data"))


def _decoded(data: bytes | None, width: int, n: int) -> np.ndarray:
    """Big-endian cells; 8-byte cells above 63 bits are no places in a file and count as 0."""
    if data is None:
        return np.zeros(n, dtype=np.int64)
    found = np.frombuffer(data, dtype=f">u{width}").astype(np.uint64)
    return np.where(found >> np.uint64(63), np.uint64(0), found).astype(np.int64)


def _with_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = zip(*(batch.column(c).to_pylist() for c in ("data", "width", "n")))
        cells = [_decoded(*row) for row in columns]
        sums, lows, highs = ([int(f(x)) for x in cells] for f in (np.sum, np.min, np.max))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(x, pa.int64()) for x in (sums, lows, highs))],
            names=[*batch.schema.names, "sum", "low", "high"],
        )


def with_sums(slices: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Add every slice's sum, low, high, and ``before``: the sum of the table's slices before it."""
    schema = slices.schema.simpleString().removeprefix("struct<").removesuffix(">")
    summed = slices.mapInArrow(_with_sums, schema.replace(":", " ").replace(",", ", ") + ", sum bigint, low bigint, high bigint")
    narrow = running(
        summed.select(*keys, "slice", "sum"), keys, "slice", F.col("sum"), "upto"
    ).select(*keys, "slice", (F.col("upto") - F.col("sum")).alias("before"))
    on = [*keys, "slice"]
    return _parts(summed, partitions, on).join(_parts(narrow, partitions, on), on)


def table_totals(summed: DataFrame, keys: list[str]) -> DataFrame:
    """Sum, least and largest cell of every table, and whether all of it was there."""
    return summed.groupBy(*keys).agg(
        F.sum("sum").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.every(F.col("data").isNotNull()).alias("complete"),
    )


def _at_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            data, width, n, first, before = (row.column(c)[0].as_py() for c in ("data", "width", "n", "first", "before"))
            places = row.column("places").flatten().to_numpy()
            upto = before + np.append(0, np.cumsum(_decoded(data, width, n)))
            same = pa.array(np.zeros(len(places), dtype=np.int64))
            keys = [row.column(c).take(same) for c in row.schema.names[: row.schema.get_field_index("slice")]]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(places), pa.array(upto[places - first])],
                names=[*row.schema.names[: len(keys)], "place", "upto"],
            )


def sums_before(
    summed: DataFrame, places: DataFrame, keys: list[str], cells: int = CELLS, partitions: int | None = None
) -> DataFrame:
    """``keys``, place, upto: the sum of all cells before each distinct place (keys, place) of a table.

    A place at the end of a table is asked of its last slice; places outside it have no row.
    """
    on = [*keys, "slice"]
    # the other side of the join has its parts, which this side has already if ``with_sums`` was given as many
    first = summed.select(*keys, "slice", "first", "n", "width", "data", "before")
    at = places.select(*keys, "place")
    # the end of a slice belongs to the next one, but the end of the table to the last
    at = at.withColumn("slice", F.explode(F.array_distinct(F.array(F.floor(F.col("place") / cells), F.floor((F.col("place") - 1) / cells)))))
    asked = _parts(at.filter("slice >= 0"), partitions, on).groupBy(*on).agg(F.collect_set("place").alias("places"))
    met = first.join(asked, on).withColumn(
        "places", F.filter("places", lambda p: (p >= F.col("first")) & (p <= F.col("first") + F.col("n")))
    ).select(*keys, "slice", "first", "n", "width", "data", "before", "places")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema.fields if f.name in keys)
    found = met.mapInArrow(_at_places, f"{kinds}, place bigint, upto bigint")
    return _parts(found, partitions, [*keys, "place"]).distinct()


def _in_one_slice(keys: list[str], cells: int) -> Column:
    """Both ends of the chunk lie in one slice, and not at a border that the slice has in common with another one."""
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    a, b = F.col("first_sample"), F.col("first_sample") + F.col("per")

    def inside(p: Column) -> Column:
        return (p == 0) | ((p > 0) & (p % cells != 0))

    return known & F.coalesce(inside(a) & inside(b) & (F.floor(a / cells) == F.floor(b / cells)), F.lit(False))


def _columns(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Where the list of each row begins in the values of all lists, and the fields of the values."""
    values = lists.flatten()
    starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return starts, dict(zip((f.name for f in values.type), values.flatten()))


def _answered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of keys, slice, ``_chunks`` and ``_tables`` to rows of keys, the fields of the chunks and their bytes."""
    keys = batch.schema.names[: batch.schema.get_field_index("slice")]
    starts, chunks = _columns(batch.column("_chunks"))
    bounds, tables = _columns(batch.column("_tables"))
    places = [chunks[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first_sample", "per")]
    a, b = places[0], places[0] + places[1]
    rows = list(zip(*(tables[c].to_pylist() for c in ("first", "n", "width", "data", "before"))))
    picks, totals = [], []
    for k in range(batch.num_rows):
        held, mine = rows[bounds[k] : bounds[k + 1]], slice(starts[k], starts[k + 1])
        # only the last slice of a table is shorter than the others, and a chunk ends with the table
        end = max(first + n for first, n, *_ in held)
        low, high = np.minimum(a[mine], end), np.minimum(b[mine], end)
        sums = [(first, n, before + np.append(0, np.cumsum(_decoded(data, width, n)))) for first, n, width, data, before in held]
        if len(sums) == 1:
            first, _, upto = sums[0]
            picks.append(np.arange(mine.start, mine.stop))
            totals.append(upto[high - first] - upto[low - first])
            continue
        # a key with several tables: every sum at the one end with every sum at the other
        ends = [
            [sorted({int(upto[p - first]) for first, n, upto in sums if p <= first + n}) for p in side.tolist()] for side in (low, high)
        ]
        pairs = [(mine.start + i, y - x) for i, (xs, ys) in enumerate(zip(*ends)) for x in xs for y in ys]
        picks.append(np.array([i for i, _ in pairs], dtype=np.int64))
        totals.append(np.array([n for _, n in pairs], dtype=np.int64))
    pick = pa.array(np.concatenate([*picks, np.zeros(0, dtype=np.int64)]))
    parent = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(starts))).take(pick)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).take(parent) for c in keys), *(x.take(pick) for x in chunks.values()), pa.array(np.concatenate([*totals, np.zeros(0, dtype=np.int64)]))],
        names=[*keys, *chunks, "bytes"],
    )


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield _answered(batch.slice(start, ROWS))


def sliced_chunk_bytes(
    chunks: DataFrame, summed: DataFrame, keys: list[str], cells: int = CELLS, partitions: int | None = None
) -> DataFrame:
    """Bytes of every chunk (keys, ord, first_sample, per) by a table of sample sizes: a difference of two sums.

    A chunk that ends behind the table ends with it. One that lies in a slice is brought to it, once, with the others
    there; only those that reach a border of their slice, or whose table ends before it, ask for two sums.
    """
    on, others = [*keys, "slice"], [c for c in chunks.columns if c not in keys]
    inner = chunks.filter(_in_one_slice(keys, cells)).select(
        *keys, F.floor(F.col("first_sample") / cells).alias("slice"), F.struct(*others).alias("_chunk")
    )
    # the filter is the one ``sums_before`` has, so that slices are shuffled once for both
    inner = _parts(inner.filter("slice >= 0"), partitions, on).groupBy(*on).agg(F.collect_list("_chunk").alias("_chunks"))
    tables = summed.groupBy(*on).agg(F.collect_list(F.struct("first", "n", "width", "data", "before")).alias("_tables"))
    met = inner.join(tables, on)
    fields = [T.StructField(c, chunks.schema[c].dataType) for c in (*keys, *others)]
    found = met.mapInArrow(_in_slices, T.StructType([*fields, T.StructField("bytes", T.LongType())]))
    lost = inner.join(summed.select(*on), on, "left_anti").select(*keys, F.explode("_chunks").alias("_chunk")).select(*keys, "_chunk.*")
    rest = chunks.filter(~_in_one_slice(keys, cells)).select(*keys, *others).unionByName(lost)
    return found.unionByName(_chunk_bytes_by_places(rest, summed, keys, cells, partitions))


def _chunk_bytes_by_places(
    chunks: DataFrame, summed: DataFrame, keys: list[str], cells: int, partitions: int | None
) -> DataFrame:
    last = summed.groupBy(*keys).agg(F.max(F.col("first") + F.col("n")).alias("_end"))
    rows = _parts(chunks, partitions, keys).join(_parts(last, partitions, keys), keys, "left").withColumn("_end", F.coalesce("_end", F.lit(0).cast("bigint")))
    rows = rows.withColumns(
        {"_a": F.least("first_sample", "_end"), "_b": F.least(F.col("first_sample") + F.col("per"), F.col("_end"))}
    )
    both = rows.select(*keys, F.explode(F.array("_a", "_b")).alias("place"))
    sums = sums_before(summed, both, keys, cells, partitions)
    for name in ("_a", "_b"):
        at = sums.withColumnRenamed("place", name).withColumnRenamed("upto", f"{name}_sum")
        rows = _parts(rows, partitions, [*keys, name]).join(at, [*keys, name], "left")
    total = F.coalesce(F.col("_b_sum"), F.lit(0)) - F.coalesce(F.col("_a_sum"), F.lit(0))
    return rows.withColumn("bytes", total.cast("bigint")).drop("_a", "_b", "_a_sum", "_b_sum", "_end")
