"""Structures above the counts that walks and lists used to stop at."""

import struct

from pyspark.sql import functions as F

from lumenreel.functions import bytes as by
from lumenreel.functions.flow import let
from lumenreel.operators import quality
from lumenreel.structures import containers, jpeg, movie, packets, trailer


def box(typ, payload=b""):
    return struct.pack(">I", 8 + len(payload)) + typ + payload


def on_bytes(spark, data, fn):
    rows = spark.createDataFrame([(bytearray(data),)], "data binary")
    wins = by.usable_windows(F.array(by.window(F.lit(0), F.col("data"))))
    size = F.length("data").cast("bigint")
    return rows.select(let(wins, lambda w: fn(w, size)).alias("x")).first()["x"]


def test_forty_sibling_boxes(spark):
    data = b"".join(box(b"free", bytes(k)) for k in range(700))
    found = on_bytes(spark, data, containers.boxes_top)
    assert [b["size"] for b in found] == [8 + k for k in range(700)]


def test_stray_words_before_the_movie(spark):
    real = box(b"moov", bytes(40))
    data = box(b"ftyp", b"isom") + box(b"free", b"zzzzmoov" * 20) + real
    found = on_bytes(spark, data, movie.moov_candidates)
    assert [(b["start"], b["size"]) for b in found] == [(len(data) - len(real), len(real))]


def test_many_directory_items(spark):
    items = "".join(f'<rdf:li><Container:Item Item:Mime="image/jpeg" Item:Semantic="S{k}" Item:Length="{k}"/></rdf:li>' for k in range(90))
    head = f"<x><Container:Directory><rdf:Seq>{items}</rdf:Seq></Container:Directory><y Item:Mime='no'/></x>".encode()
    rows = spark.createDataFrame([(bytearray(head),)], "head binary")
    found = rows.select(packets.directory_items(F.col("head")).alias("x")).first()["x"]
    assert [(i["ord"], i["semantic"], i["length"]) for i in found] == [(k, f"S{k}", k) for k in range(90)]


def test_many_trailer_blocks(spark):
    blocks, entries, at = b"", [], []
    for k in range(90):
        name = f"Block_{k}".encode() + b"x" * (300 if k == 5 else 0)
        data = struct.pack("<HHI", 0, 0x0100 + k, len(name)) + name + bytes(k + 1)
        at.append((len(blocks), len(data), 0x0100 + k))
        blocks += data
    start = b"\xff\xd8" + blocks
    for off, n, typ in at:
        entries.append(struct.pack("<HHII", 0, typ, len(start) - 2 - off, n))
    directory = b"SEFH" + struct.pack("<II", 101, len(entries)) + b"".join(entries)
    data = start + directory + struct.pack("<I", len(directory)) + b"SEFT"
    found = on_bytes(spark, data, trailer.trailer)
    assert [(b["typ"], b["payload_len"]) for b in found["blocks"]] == [(0x0100 + k, k + 1) for k in range(90)]
    assert len(found["blocks"][5]["name"]) == 307


def test_many_segments(spark):
    data = b"\xff\xd8" + b"\xff\xe1\x00\x04ab" * 1500 + b"\xff\xda\x00\x02"
    found = on_bytes(spark, data, lambda w, _: jpeg.jpeg_segments(w))
    assert len(found["segments"]) == 1500 and found["complete"]


def test_checks_find_what_is_broken(spark):
    catalog = spark.createDataFrame(
        [("a", "IMG.JPG", "motion", 10, 5), ("b", "IMG.JPG", "still", None, None), ("c", "IMG.JPG", "still", 1, 1)],
        "file_id string, name string, library_kind string, off long, len long",
    ).withColumn("plan", F.when(F.col("off").isNotNull(), F.struct("off"))).withColumn(
        "motion", F.struct(F.struct("off", "len").alias("video"))
    )
    manifest = spark.createDataFrame(
        [("a", "still"), ("b", "still"), ("c", "still"), ("d", "motion")], "file_id string, expected_kind string"
    )
    ids = lambda df: sorted(r["file_id"] for r in df.collect())
    assert ids(quality.check_plain_stills(catalog, manifest)) == ["a", "c"]
    assert ids(quality.check_manifest(catalog, manifest)) == ["a", "d"]
    clips = spark.createDataFrame([("a", "1"), ("b", "2"), ("e", "3")], "file_id string, sha256 string")
    originals = spark.createDataFrame([("a", "1"), ("b", "3"), ("f", "4")], "file_id string, sha256 string")
    assert ids(quality.check_bytes(clips, originals)) == ["b", "e", "f"]
    expected = spark.createDataFrame([("a", 10, 5), ("b", None, None), ("c", 1, 2)], "file_id string, video_off long, video_len long")
    assert ids(quality.check_expected(catalog, expected).filter("matches")) == ["a", "b"]
