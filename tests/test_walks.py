"""Walks over very many boxes, segments and hits."""

import time

from pyspark.sql import functions as F

from lumenreel.functions import bytes as by
from lumenreel.functions.flow import let
from lumenreel.structures.jpeg import jpeg_segments


def walked(spark, n):
    """``n`` boxes of 8 to 15 bytes, behind them half a header."""
    data = b"".join((8 + k % 8).to_bytes(4, "big") + b"b%03d" % (k % 1000) + b"." * (k % 8) for k in range(n)) + b"\0\0\0"
    row = spark.createDataFrame([(bytearray(data),)], "data binary")
    wins = by.usable_windows(F.array(by.window(F.lit(0), F.col("data"))))
    found = let(wins, lambda w: by.walk_boxes(w, by.long(0), by.long(len(data))))
    boxes = row.select(F.explode(found).alias("b"))
    began = time.perf_counter()
    found = boxes.select("b.typ", "b.start", "b.data_end").agg(
        F.count("*"), F.sum("start"), F.sum(F.col("data_end") - F.col("start")), F.count_distinct("typ"), F.max("data_end")
    ).first()
    return tuple(found), time.perf_counter() - began


def test_very_many_boxes(spark):
    sizes = [8 + k % 8 for k in range(200_000)]
    starts, at = 0, 0
    for s in sizes:
        starts, at = starts + at, at + s
    few = walked(spark, 20_000)[1]
    got, many = walked(spark, 200_000)
    assert got == (200_000, starts, sum(sizes), 1000, at)
    assert many < 25 * max(few, 1)  # in proportion, with room for noise


def test_many_segments_and_hits(spark):
    n = 30_000
    data = b"\xff\xd8" + b"\xff\xe2\x00\x03x" * n + b"\xff\xe1\x00\x02" + b"\xff\xd9"
    row = spark.createDataFrame([(bytearray(data), "ab-" * n)], "data binary, text string")
    wins = by.usable_windows(F.array(by.window(F.lit(0), F.col("data"))))
    walk = F.expr("cast(struct(2, array()) as struct<pos:bigint,segments:array<struct<marker:bigint,start:bigint,data_start:bigint,data_len:bigint>>>)")
    got = row.select(
        let(wins, lambda w: F.size(jpeg_segments(w)["segments"])).alias("all"),
        let(wins, lambda w: jpeg_segments(w, walk)).alias("kept"),
        by.find_all(F.col("text"), "b-").alias("hits"), by.find_all(F.lit("none"), "b-").alias("no"),
    ).first()
    assert got["all"] == n + 1 and got["kept"]["complete"] and got["kept"]["pos"] == len(data) - 2
    assert [(s["marker"], s["start"]) for s in got["kept"]["segments"]] == [(0xE1, 2 + 5 * n)]
    assert got["hits"] == [1 + 3 * k for k in range(n)] and got["no"] == []
