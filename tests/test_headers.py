"""JPEG headers longer than the first read."""

import pytest
from pyspark.sql import functions as F

from lumenreel.operators import catalog as cat
from lumenreel.plans.scan import Limits, content_reader, scan
from lumenreel.sources import ranges
from lumenreel.sources.listing import _open, _store, list_media

from test_scan import box, movie, synth

DIRECTORY = (
    '<x><rdf:Description Camera:MotionPhoto="1"><Container:Directory><rdf:Seq><rdf:li><Container:Item Item:Mime="image/jpeg"'
    ' Item:Semantic="Primary" Item:Length="9"/></rdf:li><rdf:li><Container:Item Item:Mime="video/mp4"'
    ' Item:Semantic="MotionPhoto" Item:Length="%d"/></rdf:li></rdf:Seq></Container:Directory></rdf:Description></x>'
)
EXIF = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x0f\x01\x02\0\x04\0\0\0ABC\0\0\0\0\0"


def segment(code, body):
    return b"\xff" + bytes([code]) + (len(body) + 2).to_bytes(2, "big") + body


def photo(large, clip, fill=0, between=0):
    """``large`` segments of full length before EXIF and packet."""
    parts = [segment(0xE2, bytes([k]) * 65533) for k in range(large)]
    packet = segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + (DIRECTORY % len(clip)).encode())
    head = b"\xff\xd8" + b"".join(parts) + b"\xff" * fill + segment(0xE1, EXIF)
    head += b"".join(segment(0xED, b"p" * 65533) for _ in range(between)) + packet
    return head, head + b"\xff\xda\x00\x02" + b"s" * 90_000 + b"\xff\xd9" + clip


@pytest.fixture(scope="module")
def files():
    media = box(b"mdat", b"m" * 100_000)
    size = len(movie(0, 100_000))
    clip = synth.FTYP_ISOM + movie(len(synth.FTYP_ISOM) + size + 8, 100_000) + media
    shapes = {"none": (0, 0, 0), "one": (1, 0, 0), "two": (2, 7, 1), "twenty": (20, 5000, 2)}
    return {f"{k}.jpg": (*photo(n, clip, fill, between), clip) for k, (n, fill, between) in shapes.items()}


def check(rows, files):
    assert len(rows) == len(files)
    for r in rows:
        head, whole, clip = files[r["name"]]
        assert (r["kind"], r["motion"]["method"], r["open_reason"], r["meta"]["make"]) == ("motion", "xmp-directory", None, "ABC"), r
        assert (r["motion"]["video"]["off"], r["motion"]["video"]["len"]) == (len(whole) - len(clip), len(clip))
        assert "jpeg header walk stopped early" not in r["notes"]
        # first reads, what the header declares, and the movie box
        assert r["stats"]["bytes_read"] <= 1.1 * len(head) + 2 * 65536 + len(movie(0, 100_000)) + 300_000
    return {r["name"]: r["stats"] for r in rows}


def test_large_segments_before_the_packet(spark, files):
    rows = [(k, n, n, len(f[1]), 0, bytearray(f[1])) for k, (n, f) in enumerate(files.items())]
    table = spark.createDataFrame(rows, "list_ord long, path string, name string, size long, mtime_ms long, content binary")
    check(scan(cat.to_entries(table), content_reader).collect(), files)


def test_headers_are_followed_in_files(spark, files, tmp_path):
    for name, (_, whole, _) in files.items():
        (tmp_path / name).write_bytes(whole)
    stats = check(scan(list_media(spark, str(tmp_path)), ranges.path_reader).collect(), files)
    # only headers of the other segments are read, and one pass follows all of them
    assert stats["twenty.jpg"]["bytes_read"] <= stats["one.jpg"]["bytes_read"] + 10_000
    assert stats["twenty.jpg"]["passes"] == stats["one.jpg"]["passes"]


def test_header_walk_of_odd_bytes():
    def walk(data, at=0):
        return ranges.header_windows(lambda off, n: data[off : off + n], at)

    assert [w["len"] for w in walk(b"")] == [0] and [w["len"] for w in walk(b"\xff")] == [1]
    assert [w["off"] for w in walk(b"\xff\xe0\x00\x01zz")] == [0]  # a length below two
    assert [(w["off"], w["len"]) for w in walk(b"\xff\xff\xff\xd8\xff\xd9")] == [(0, 3), (2, 4), (4, 2)]
    fill = b"\xff" * 10_000 + b"\xda"
    assert walk(fill)[-1]["off"] + walk(fill)[-1]["len"] == len(fill)


def test_reads_of_near_ranges_and_clients(tmp_path):
    (tmp_path / "a b").write_bytes(bytes(range(256)) * 1000)
    asked = [{"off": 200_000, "len": 10}, {"off": 5, "len": 3}, {"off": 20, "len": 4}, {"off": 255_999, "len": 9}]
    assert [m for _, _, m in ranges._near_ranges(asked)] == [[1, 2], [0], [3]]
    for uri in (f"{tmp_path}/a b", f"file://{tmp_path}/a%20b"):
        got, error = ranges.read_ranges(uri, asked)
        assert error is None and [w["len"] for w in got] == [10, 3, 4, 1] and got[2]["data"] == bytes(range(20, 24))
    assert ranges.read_ranges(f"{tmp_path}/gone", asked)[1].startswith("FileNotFoundError")
    before = _store.cache_info().misses
    for k in range(50):
        _open(f"file://{tmp_path}/{k}")
    assert _store.cache_info().misses == before


def test_open_rows_are_problems(spark, files):
    """A read that gives nothing new leaves the row open, and an open row is a problem with its reason."""
    name, (_, whole, _) = "one.jpg", files["one.jpg"]
    row = [(0, name, name, len(whole), 0, bytearray(whole))]
    table = spark.createDataFrame(row, "list_ord long, path string, name string, size long, mtime_ms long, content binary")

    def blind(rows):
        return content_reader(rows.withColumn("follow", F.lit(None).cast("bigint")))

    found = cat.with_kind(cat.finish_catalog(scan(cat.to_entries(table), blind, Limits()))).first()
    assert (found["status"], found["library_kind"]) == ("open", "problem") and found["error"] == found["open_reason"]
