"""Adaptive scans: later reads follow from the data."""

from pyspark.sql import functions as F

from lumenreel import synth
from lumenreel.functions import bytes as by
from lumenreel.operators import catalog as cat
from lumenreel.plans.scan import Limits, scan
from lumenreel.registry import scans


def entries(spark, texts, first=0):
    docs = spark.createDataFrame([(first + 12 * k, t, "en", "web") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return cat.to_entries(synth.media_files(docs).drop("file_id"))


def test_touching_windows_are_one(spark):
    data = bytes(range(100))
    cuts = [(60, 20), (0, 10), (10, 5), (12, 8), (70, 5), (90, 0)]
    rows = spark.createDataFrame([([(a, n, bytearray(data[a : a + n])) for a, n in cuts],)], f"wins {by.WINDOWS}")
    found = rows.select(by.join_windows(F.col("wins")).alias("x")).first()["x"]
    assert [(w["off"], w["len"], bytes(w["data"])) for w in found] == [(0, 20, data[:20]), (60, 20, data[60:80])]


def test_movie_across_the_border_of_head_and_tail(spark):
    """The box begins in the head window and ends in the tail window."""
    row = scan(entries(spark, ["x" * 599], 10), limits=Limits(head_bytes=1200, tail_bytes=400)).collect()[0]
    assert (row["kind"], row["motion"]["method"], row["motion"]["video"]["len"]) == ("motion", "sample-table", 599)
    assert row["stats"]["reads"] == 3


def test_narrow_windows_cover_every_shape(spark):
    assert "WHERE shape IN" not in scans.SQL["scan_narrow_windows"].split("FROM res")[-1]
    rows = scans.QUERIES["scan_narrow_windows"](spark, "/root/testdata/sf0.001").select("doc_id").collect()
    assert {r["doc_id"] % 12 for r in rows} == set(range(12))


def box(typ, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + typ + body


def movie(at, n):
    """A movie box over 512 KiB: one chunk at ``at`` with two samples of ``n`` bytes together."""
    u32 = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    entry = box(b"avc1", bytes(78), b"\0\0\0\x0davcC\x01\x42\xe0\x1e\xff")
    table = box(
        b"stbl", box(b"stsd", u32(0, 1), entry), box(b"stsc", u32(0, 1, 1, 2, 1)),
        box(b"stsz", u32(0, 0, 2, n // 2, n - n // 2)), box(b"stco", u32(0, 1, at)),
    )
    media = box(b"mdia", box(b"mdhd", bytes(12), u32(600, 600, 0)), box(b"hdlr", bytes(8), b"vide", bytes(13)), box(b"minf", table))
    head = box(b"tkhd", bytes(12), u32(1), bytes(60), u32(640 << 16, 480 << 16))
    return box(b"moov", box(b"mvhd", bytes(12), u32(1000, 1000), bytes(80)), box(b"free", bytes(600_000)), box(b"trak", head, media))


def still(packet):
    body = b"http://ns.adobe.com/xap/1.0/\0" + packet.encode()
    return b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda\x00\x02" + b"s" * 100_000 + b"\xff\xd9"


def test_large_movies_outside_head_and_tail(spark):
    """Read by the size that the box declares: before the media, behind it, and with no range named."""
    ftyp, n = synth.FTYP_ISOM, 200_000
    media, size = box(b"mdat", b"m" * n), len(movie(0, n))
    directory = '<x><rdf:Description Camera:MotionPhoto="1"><Container:Directory><rdf:Seq><rdf:li><Container:Item Item:Mime="image/jpeg" Item:Semantic="Primary" Item:Length="9"/></rdf:li><rdf:li><Container:Item Item:Mime="video/mp4" Item:Semantic="MotionPhoto" Item:Length="%d"/></rdf:li></rdf:Seq></Container:Directory></rdf:Description></x>'
    whole = len(ftyp) + size + len(media)
    named = still(directory % whole)
    flagged = still('<x:xmpmeta><rdf:Description Camera:MotionPhoto="1"/></x:xmpmeta>')
    at = len(flagged) + len(ftyp) + 8
    files = {
        "front.jpg": named + ftyp + movie(len(ftyp) + size + 8, n) + media,
        "behind.jpg": named + ftyp + media + movie(len(ftyp) + 8, n),
        "tables.jpg": flagged + ftyp + media + movie(at, n) + b"z" * 100_000,
    }
    rows = spark.createDataFrame(
        [(i, k, k, len(v), 0, bytearray(v)) for i, (k, v) in enumerate(files.items())],
        "list_ord long, path string, name string, size long, mtime_ms long, content binary",
    )
    got = {r["name"]: r for r in scan(cat.to_entries(rows)).collect()}
    for name in ("front.jpg", "behind.jpg"):
        r = got[name]
        assert (r["kind"], r["motion"]["method"], r["motion"]["codec"], r["open_reason"]) == ("motion", "xmp-directory", "avc1.42E01E", None), name
        assert [(p["t"], p["off"], p["len"]) for p in r["plan"]["parts"]] == [("slice", len(named), whole)], name
    r = got["tables.jpg"]
    assert (r["kind"], r["motion"]["method"], r["motion"]["codec"], r["open_reason"]) == ("motion", "sample-table", "avc1.42E01E", None)
    assert [(p["t"], p["len"]) for p in r["plan"]["parts"]] == [("lit", 32), ("lit", size), ("lit", 8), ("slice", n)]
    assert r["plan"]["parts"][3]["off"] == at
