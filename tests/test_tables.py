"""Sliced tables against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel.operators import tables
from lumenreel.sources.listing import list_files
from lumenreel.sources.ranges import path_reader

KEYS = ["file_id", "start"]


@pytest.mark.parametrize(("n", "cells", "width"), [(0, 8, 4), (1, 8, 4), (64, 8, 4), (1000, 7, 8), (3_000_000, tables.CELLS, 4)])
def test_chunks_of_a_sliced_table(spark, tmp_path, n, cells, width):
    """Three million cells are read from a file slice by slice; no row has more than one slice."""
    pick = np.random.default_rng(n)
    sizes = pick.integers(0, 2**32 if width == 4 else 2**40, n)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "movie").write_bytes(b"head" + sizes.astype(f">u{width}").tobytes() + b"tail")
    files = list_files(spark, str(tmp_path / "f")).select(F.lit("x").alias("file_id"), F.lit(9).cast("long").alias("start"), "uri")
    found = files.select("*", F.lit(4).cast("long").alias("at"), F.lit(n).cast("long").alias("count"), F.lit(width).alias("width"))
    slices = tables.table_slices(found, KEYS, cells)
    assert slices.count() == -(-n // cells)
    summed = tables.with_sums(tables.read_slices(slices, KEYS, path_reader), KEYS).cache()
    assert (summed.agg(F.max(F.length("data"))).first()[0] or 0) <= cells * width
    per = 5
    count = n // per + 2  # the last chunks reach behind the table
    chunks = spark.range(count).select(
        F.lit("x").alias("file_id"), F.lit(9).cast("long").alias("start"), F.col("id").alias("ord"),
        (F.col("id") * per).alias("first_sample"), F.lit(per).cast("long").alias("per"),
    )
    got = tables.sliced_chunk_bytes(chunks, summed, KEYS, cells).select("ord", "bytes").toPandas().set_index("ord")["bytes"].sort_index()
    before = np.append(0, np.cumsum(sizes, dtype=np.int64))
    edges = np.minimum(np.arange(count + 1) * per, n)
    assert got.tolist() == (before[edges[1:]] - before[edges[:-1]]).tolist()
    total = tables.table_totals(summed, KEYS).collect()
    assert [(r["total"], r["low"], r["high"], r["complete"]) for r in total] == ([(sizes.sum(), sizes.min(), sizes.max(), True)] if n else [])


def test_a_table_that_the_file_cuts_off(spark):
    rows = [("x", 0, bytearray(b"\0\0\0\1\0\0\0\2\0\0"), 0, 3, 4)]
    found = spark.createDataFrame(rows, "file_id string, start long, content binary, at long, count long, width int")
    summed = tables.with_sums(tables.read_slices(tables.table_slices(found, KEYS, 2), KEYS), KEYS)
    assert [(r["total"], r["complete"]) for r in tables.table_totals(summed, KEYS).collect()] == [(3, False)]


def test_chunks_of_repeated_and_missing_tables(spark):
    """Chunks inside slices have the sums that asking for both of their places gives, in whatever table they lie."""
    whole = [("x", 1, bytes(range(1, 41))), ("x", 1, bytes(range(1, 41))), ("x", 2, bytes(range(60))), ("x", 3, bytes(16)), ("x", 3, bytes(range(48)))]
    found = spark.createDataFrame(
        [(a, b, bytearray(c), 0, len(c) // 4, 4) for a, b, c in [*whole, ("x", None, bytes(8))]],
        "file_id string, start long, content binary, at long, count long, width int",
    )
    summed = tables.with_sums(tables.read_slices(tables.table_slices(found, KEYS, 4), KEYS), KEYS)
    rows = [("x", key, n, first, per) for key in (1, 2, 3, 4, None) for per in (0, 1, 2, 3, 9) for n, first in enumerate([-1, 0, 1, 3, 4, 5, 9, 10, 14, 15, 30])]
    rows += [("x", 2, 99, None, 1), ("x", 2, 99, 1, None), ("x", 2, 5, 5, 1)]
    chunks = spark.createDataFrame(rows, "file_id string, start long, ord long, first_sample long, per long")
    got = tables.sliced_chunk_bytes(chunks, summed, KEYS, 4)
    want = tables._chunk_bytes_by_places(chunks, summed, KEYS, 4, None)
    listed = lambda df: sorted(map(tuple, df.select(*chunks.columns, "bytes").collect()), key=str)
    assert got.columns == want.columns and listed(got) == listed(want)
    one = np.frombuffer(bytes(range(60)), dtype=">u4")
    edges = lambda first, per: one[max(first, 0) : max(first + per, 0)].sum()
    assert {r[-1] for r in listed(got) if r[1:3] == (2, 2)} == {int(edges(1, per)) for per in (0, 1, 2, 3, 9)}


def test_chunks_of_a_slice_are_shuffled_once(spark):
    """Chunks that lie in slices are brought there and not asked for by their places: one list of chunks a slice."""
    n, per = 4096, 4
    found = spark.createDataFrame([("x", 1, bytearray(4 * n), 0, n, 4)], "file_id string, start long, content binary, at long, count long, width int")
    summed = tables.with_sums(tables.read_slices(tables.table_slices(found, KEYS, 512), KEYS), KEYS, 4)
    chunks = spark.range(n // per).select(
        F.lit("x").alias("file_id"), F.lit(1).cast("long").alias("start"), F.col("id").alias("ord"),
        (F.col("id") * per).alias("first_sample"), F.lit(per).cast("long").alias("per"),
    )
    asked = []
    real = tables.sums_before
    tables.sums_before = lambda summed, places, *rest: asked.append(places.count()) or real(summed, places, *rest)
    try:
        assert tables.sliced_chunk_bytes(chunks, summed, KEYS, 512, 4).count() == n // per
    finally:
        tables.sums_before = real
    assert asked[0] <= 2 * 2 * n // 512, asked  # before: two places for each of the chunks
