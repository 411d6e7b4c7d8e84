"""Real files: listing, bounded reads, routes, hostile input and exported clips."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lumenreel import synth
from lumenreel.operators import catalog as cat
from lumenreel.operators import quality
from lumenreel.plans.scan import Limits, scan
from lumenreel.sources.listing import list_media, list_media_fast
from lumenreel.sources.ranges import balanced, path_reader
from lumenreel.sources.sinks import export_clips, report_json, write_catalog

HOSTILE = {
    "noise.jpg": bytes((i * 7919 + 13) % 251 for i in range(5000)),
    "empty.jpg": b"",
    "text.jpg": b"just text " * 50,
    "cut.jpg": b"\xff\xd8\xff\xe1\x40\x00Exif\0\0II*\0",
    "no-trailer.jpg": b"\xff\xd8\xff\xd9" + b"x" * 400 + b"\xff\0\0\0SEFT",
    "absurd-box.heic": b"\0\0\0\x18ftypheic\0\0\0\0heicmif1" + b"\0\0\0\1meta" + b"\xff" * 40,
    "oversize.jpg": b'\xff\xd8\xff\xe1\0\x60<r Container:Directory><a Item:Mime="image/jpeg" Item:Length="9"/><b Item:Mime="video/mp4" Item:Length="99999999"/>\xff\xd9',
    "zeros.mp4": bytes(3000),
}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """One file of every shape, a pair, hidden names and the hostile set."""
    root = tmp_path_factory.mktemp("library")
    rows = synth.media_files(synth.document_rows(spark, "/root/testdata/sf0.001")).filter("list_ord < 12").collect()
    clips = {}
    for row in rows:
        folder = root / row["shape"]
        folder.mkdir()
        (folder / row["name"]).write_bytes(row["content"])
        clips[row["shape"]] = row["content"]
    (root / "_under.jpg").write_bytes(clips["jpeg"])
    (root / "._junk.jpg").write_bytes(b"resource fork")
    (root / "notes.txt").write_bytes(b"notes")
    (root / "pair").mkdir()
    (root / "pair" / "live.jpg").write_bytes(clips["jpeg"])
    (root / "pair" / "LIVE.MOV").write_bytes(clips["mp4"])
    (root / "hostile").mkdir()
    for name, data in HOSTILE.items():
        (root / "hostile" / name).write_bytes(data)
    (root / "gone.jpg").write_bytes(b"soon gone")
    return root, clips


@pytest.fixture(scope="module")
def scanned(spark, library):
    root, _clips = library
    files = balanced(cat.scannable(list_media(spark, str(root))), 4)
    files = files.unionByName(
        files.filter("name = 'gone.jpg'").withColumn("file_id", F.lit("missing")).withColumn("uri", F.lit("/nowhere/gone.jpg"))
    )
    rows = cat.with_kind(cat.finish_catalog(scan(files, path_reader), "path")).cache()
    rows.count()
    return rows


def test_listing_sees_hidden_names(spark, library):
    root, _ = library
    rows = {r["name"]: r for r in list_media(spark, str(root)).collect()}
    assert {"_under.jpg", "._junk.jpg", "notes.txt", "LIVE.MOV"} <= set(rows)
    assert rows["_under.jpg"]["scannable"] and not rows["._junk.jpg"]["scannable"] and not rows["notes.txt"]["scannable"]
    assert rows["live.jpg"]["path"].endswith("/pair/live.jpg")
    fast = {r["name"] for r in list_media_fast(spark, str(root)).collect()}
    assert "LIVE.MOV" in fast and "_under.jpg" not in fast


def test_routes_of_every_shape(scanned):
    got = {r["path"].split("/")[1]: r for r in scanned.collect()}
    expected = {
        "jpeg-directory": "xmp-directory", "jpeg-trailer": "seft-trailer", "jpeg-pointer": "seft-trailer",
        "heic-mpvd": "mpvd-box", "heic-mpvd-sefd": "mpvd-box", "heic-item": "heif-item", "mp4": "container",
        "jpeg-appended": "appended-container", "jpeg-micro": "xmp-microvideo-offset", "jpeg-samples": "sample-table",
    }
    for shape, method in expected.items():
        assert got[shape]["motion"]["method"] == method, shape
        assert got[shape]["motion"]["playable"], shape
    assert got["jpeg"]["plan"] is None and got["png"]["plan"] is None


def test_pairs_errors_and_hostile_files(scanned):
    by_name = {r["name"]: r for r in scanned.filter("file_id <> 'missing'").collect()}
    assert by_name["live.jpg"]["library_kind"] == "live" and by_name["LIVE.MOV"]["hidden_as_companion"]
    for name in HOSTILE:
        assert by_name[name]["plan"] is None, name
        assert by_name[name]["status"] == "ok", name
    assert by_name["empty.jpg"]["notes"] == ["file was not read"]
    missing = scanned.filter("file_id = 'missing'").collect()[0]
    assert missing["status"] == "failed" and missing["library_kind"] == "problem" and missing["error"]


def test_checks_hold(scanned):
    for check in (quality.check_bounds, quality.check_literals, quality.check_still, quality.check_reads):
        assert check(scanned).count() == 0


def test_exported_clips_are_the_original_bytes(spark, library, scanned, tmp_path):
    root, clips = library
    out = export_clips(scanned.filter("file_id <> 'missing'"), str(tmp_path / "clips")).collect()
    assert all(r["error"] is None for r in out)
    by_name = {r["name"]: r for r in out}
    payload = clips["jpeg-appended"]
    start = payload.index(b"ftypisom") - 4
    appended = by_name["IMG_8-motion.mp4"]
    assert appended["sha256"] == hashlib.sha256(payload[start:]).hexdigest()
    assert os.path.getsize(appended["out_path"]) == appended["bytes"]
    assert by_name["live-motion.mp4"]["sha256"] == hashlib.sha256(clips["mp4"]).hexdigest()
    rebuilt = open(by_name["IMG_10-motion.mp4"]["out_path"], "rb").read()
    assert rebuilt[4:12] == b"ftypisom" and b"mdat" in rebuilt
    table = rebuilt.index(b"stco") + 12
    first_chunk = int.from_bytes(rebuilt[table : table + 4], "big")
    assert first_chunk == rebuilt.index(b"mdat") + 4
    write_catalog(scanned, str(tmp_path / "catalog"))
    assert spark.read.parquet(str(tmp_path / "catalog")).count() == scanned.count()
    assert scanned.select(report_json().alias("j")).filter("j like '%\"core\"%'").count() == scanned.count()


def test_small_windows_need_more_reads_but_find_the_same_clip(spark, library):
    root, clips = library
    files = cat.scannable(list_media(spark, str(root))).filter("path like '%/jpeg-directory/%'")
    row = scan(files, path_reader, Limits(head_bytes=1000, tail_bytes=64)).collect()[0]
    data = clips["jpeg-directory"]
    start = data.index(b"ftypisom") - 4
    assert (row["motion"]["video"]["off"], row["motion"]["video"]["len"]) == (start, len(data) - start)
    assert row["motion"]["playable"] and row["stats"]["reads"] == 3 and row["motion"]["method"] == "xmp-directory"
