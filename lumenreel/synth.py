"""Media files derived from the text tables, for queries, tests and the benchmark.

``media_files`` turns every document into one file of a known shape: its text, whole, is the
payload of the clip (or of the still). Layout sizes follow simple formulas, so expected offsets can
be recomputed without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bytes import be, blob, le, window
from .functions.flow import let
from .session import dealt

SHAPES = [
    "jpeg-directory", "jpeg-trailer", "jpeg-pointer", "heic-mpvd", "heic-mpvd-sefd", "heic-item",
    "mp4", "jpeg", "jpeg-appended", "jpeg-micro", "jpeg-samples", "png",
]
EXTENSIONS = ["jpg", "jpg", "JPG", "heic", "HEIC", "heic", "mp4", "jpeg", "jpg", "jpg", "jpg", "png"]
STILL_BYTES = 200
TAIL_JUNK = 16
MTIME_BASE_MS = 1_600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cat(*parts: Column | bytes) -> Column:
    return F.concat(*[blob(p) if isinstance(p, bytes) else p for p in parts])


def box(typ: bytes, *parts: Column | bytes) -> Column:
    return let(cat(*parts), lambda body: cat(be(F.length(body) + 8, 4), typ, body))


def repeat(byte: bytes, n: int) -> bytes:
    return byte * n


def moov_box(payload_len: Column, chunks: Column, payload_at: Column, codec: str = "avc1") -> Column:
    """One video track: two samples per chunk, equal sizes, the last one takes the rest."""
    each = F.floor(payload_len / (chunks * 2)).cast("bigint")
    last = payload_len - each * (chunks * 2 - 1)
    sizes = F.concat(
        F.unhex(F.repeat(F.lpad(F.hex(each), 8, "0"), (chunks * 2 - 1).cast("int"))), be(last, 4)
    )
    offsets = F.unhex(
        F.array_join(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), chunks.cast("bigint") - 1),
                lambda i: F.lpad(F.hex(payload_at.cast("bigint") + i * 2 * each), 8, "0"),
            ),
            "",
        )
    )
    config = {
        "avc1": b"\x00\x00\x00\x0davcC\x01\x42\xe0\x1e\xff",
        "hvc1": b"\x00\x00\x00\x15hvcC\x01\x01\x60\x00\x00\x00\x90\x00\x00\x00\x00\x00\x5d",
    }[codec]
    entry = repeat(b"\0", 78) + config
    entry = (len(entry) + 8).to_bytes(4, "big") + codec.encode() + entry
    stbl = box(
        b"stbl",
        box(b"stsd", repeat(b"\0", 4) + b"\0\0\0\1" + entry),
        box(b"stsc", repeat(b"\0", 4) + b"\0\0\0\1" + b"\0\0\0\1\0\0\0\2\0\0\0\1"),
        box(b"stsz", repeat(b"\0", 8), be(chunks * 2, 4), sizes),
        box(b"stco", repeat(b"\0", 4), be(chunks, 4), offsets),
    )
    matrix = repeat(b"\0", 60)
    tkhd = box(
        b"tkhd", repeat(b"\0", 12) + b"\0\0\0\1" + matrix[:60], be(F.lit(640 << 16), 4),
        be(F.lit(480 << 16), 4),
    )
    mdhd = box(b"mdhd", repeat(b"\0", 12) + (600).to_bytes(4, "big"), be(chunks * 600, 4), repeat(b"\0", 4))
    hdlr = box(b"hdlr", repeat(b"\0", 8) + b"vide" + repeat(b"\0", 13))
    mdia = box(b"mdia", mdhd, hdlr, box(b"minf", stbl))
    mvhd = box(
        b"mvhd", repeat(b"\0", 12) + (1000).to_bytes(4, "big"), be(chunks * 1000, 4),
        repeat(b"\0", 80),
    )
    return box(b"moov", mvhd, box(b"trak", tkhd, mdia))


FTYP_ISOM = b"\x00\x00\x00\x18ftypisom\x00\x00\x00\x00isommp42"


def clip(payload: Column, chunks: Column, front: bool, base: Column | None = None, codec: str = "avc1") -> Column:
    """A complete clip; ``front`` puts ``moov`` before the media. ``base`` makes chunk offsets
    absolute in the enclosing file."""
    n = F.length(payload)
    start = F.lit(0) if base is None else base
    extra = 8 if codec == "hvc1" else 0
    moov_len = chunks * 12 + 484 + extra
    at = start + (moov_len + 32 if front else F.lit(32))
    moov = moov_box(n, chunks, at, codec)
    mdat = cat(be(n + 8, 4), b"mdat", payload)
    return cat(FTYP_ISOM, moov, mdat) if front else cat(FTYP_ISOM, mdat, moov)


def exif_segment(make: Column, model: Column, taken: Column, orientation: Column) -> Column:
    """Camera, time, orientation, 4000x3000 pixels and a 16-byte thumbnail."""
    model_z = cat(F.encode(model, "UTF-8"), b"\0")
    m = F.length(model_z)
    sub_at = m + 62
    date_at = sub_at + 42
    ifd1_at = date_at + 20

    def entry(tag: int, typ: int, n: Column | int, value: Column) -> Column:
        count = F.lit(n) if isinstance(n, int) else n
        return cat(le(F.lit(tag), 2), le(F.lit(typ), 2), le(count, 4), value)

    make_z = F.substring(cat(F.encode(make, "UTF-8"), b"\0\0\0\0"), 1, 4)
    tiff = cat(
        b"II*\0\x08\0\0\0",
        b"\x04\0",
        entry(0x010F, 2, F.octet_length(make) + 1, make_z),
        entry(0x0110, 2, m, le(F.lit(62), 4)),
        entry(0x0112, 3, 1, cat(le(orientation, 2), b"\0\0")),
        entry(0x8769, 4, 1, le(sub_at, 4)),
        le(ifd1_at, 4),
        model_z,
        b"\x03\0",
        entry(0x9003, 2, 20, le(date_at, 4)),
        entry(0xA002, 4, 1, le(F.lit(4000), 4)),
        entry(0xA003, 4, 1, le(F.lit(3000), 4)),
        b"\0\0\0\0",
        F.encode(taken, "UTF-8"), b"\0",
        b"\x02\0",
        entry(0x0201, 4, 1, le(ifd1_at + 30, 4)),
        entry(0x0202, 4, 1, le(F.lit(16), 4)),
        b"\0\0\0\0",
        repeat(b"T", 16),
    )
    return let(cat(b"Exif\0\0", tiff), lambda b: cat(b"\xff\xe1", be(F.length(b) + 2, 2), b))


def packet_segment(text: Column) -> Column:
    body = cat(b"http://ns.adobe.com/xap/1.0/\0", F.encode(text, "UTF-8"))
    return let(body, lambda b: cat(b"\xff\xe1", be(F.length(b) + 2, 2), b))


def directory_packet(clip_len: Column, still_len: Column, stamp: Column) -> Column:
    return F.format_string(
        '<x:xmpmeta><rdf:Description Camera:MotionPhoto="1" Camera:MotionPhotoVersion="1"'
        ' Camera:MotionPhotoPresentationTimestampUs="%d"><Container:Directory><rdf:Seq><rdf:li>'
        '<Container:Item Item:Mime="image/jpeg" Item:Semantic="Primary" Item:Length="%d"'
        ' Item:Padding="0"/></rdf:li><rdf:li><Container:Item Item:Mime="video/mp4"'
        ' Item:Semantic="MotionPhoto" Item:Length="%d" Item:Padding="0"/></rdf:li></rdf:Seq>'
        "</Container:Directory></rdf:Description></x:xmpmeta>",
        stamp, still_len, clip_len,
    )


def micro_packet(clip_len: Column, stamp: Column) -> Column:
    return F.format_string(
        "<x:xmpmeta><GCamera:MicroVideo>1</GCamera:MicroVideo>"
        '<rdf:Description GCamera:MicroVideoOffset="%d" GCamera:MicroVideoPresentationTimestampUs'
        '="%d"/></x:xmpmeta>',
        clip_len, stamp,
    )


def flag_packet() -> Column:
    return F.lit('<x:xmpmeta><rdf:Description Camera:MotionPhoto="1"/></x:xmpmeta>')


def jpeg(exif: Column, packet: Column | None = None) -> Column:
    parts = [b"\xff\xd8", exif] + ([packet] if packet is not None else [])
    return cat(*parts, b"\xff\xda\x00\x02" + repeat(b"s", STILL_BYTES) + b"\xff\xd9")


def trailer(payload: Column) -> Column:
    """One time block and one clip block, then the directory and the footer."""
    utc = b"\0\0\x01\x0a\x0e\0\0\0Image_UTC_Data1700000000000"
    name = b"MotionPhoto_Data"
    clip_len = F.length(payload) + 8 + len(name)
    return cat(
        utc, b"\0\0\x30\x0a" + len(name).to_bytes(4, "little") + name, payload,
        b"SEFH" + (103).to_bytes(4, "little") + (2).to_bytes(4, "little"),
        b"\0\0\x01\x0a", le(clip_len + len(utc), 4), le(F.lit(len(utc)), 4),
        b"\0\0\x30\x0a", le(clip_len, 4), le(clip_len, 4),
        (36).to_bytes(4, "little") + b"SEFT",
    )


def heic_head(video_off: Column | None = None, video_len: Column | None = None) -> Column:
    """``ftyp`` and ``meta``: a grid of two tiles, optionally with a described video item."""

    def infe(i: int, typ: bytes, tail: bytes = b"\0") -> Column:
        return box(b"infe", b"\x02\0\0\0" + i.to_bytes(2, "big") + b"\0\0" + typ + tail)

    entries = [infe(1, b"grid"), infe(2, b"hvc1"), infe(3, b"hvc1")]
    refs = [box(b"dimg", b"\0\1\0\2\0\2\0\3")]
    locs: list[Column | bytes] = [
        b"\0\2\0\0\0\1" + (900).to_bytes(4, "big") + (10).to_bytes(4, "big"),
        b"\0\3\0\0\0\1" + (910).to_bytes(4, "big") + (12).to_bytes(4, "big"),
    ]
    if video_off is not None:
        entries.append(infe(4, b"mime", b"clip\0video/mp4\0"))
        refs.append(box(b"cdsc", b"\0\1\0\1\0\4"))
        locs.append(cat(b"\0\4\0\0\0\1", be(video_off, 4), be(video_len, 4)))
    iinf = box(b"iinf", b"\0\0\0\0" + len(entries).to_bytes(2, "big"), *entries)
    iloc = box(b"iloc", b"\0\0\0\0\x44\0" + len(locs).to_bytes(2, "big"), *locs)
    iref = box(b"iref", b"\0\0\0\0", *refs)
    ispe = lambda w, h: box(b"ispe", b"\0\0\0\0" + w.to_bytes(4, "big") + h.to_bytes(4, "big"))
    ipco = box(b"ipco", ispe(512, 512), ispe(4032, 3024))
    ipma = box(b"ipma", b"\0\0\0\0\0\0\0\2" + b"\0\2\1\1" + b"\0\1\1\2")
    meta = box(
        b"meta", b"\0\0\0\0", box(b"pitm", b"\0\0\0\0\0\1"), iinf, iloc, iref,
        box(b"iprp", ipco, ipma),
    )
    return cat(b"\x00\x00\x00\x18ftypheic\x00\x00\x00\x00heicmif1", meta)


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def media_files(docs: DataFrame, front: bool = True) -> DataFrame:
    """``file_id, list_ord, path, name, size, mtime_ms, shape, content`` for every document."""
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("doc_id") % len(SHAPES) + 1).cast("int"))
    extension = F.element_at(
        F.array(*[F.lit(s) for s in EXTENSIONS]), (F.col("doc_id") % len(SHAPES) + 1).cast("int")
    )
    rows = docs.select(
        "doc_id", "lang", "source",
        shape.alias("shape"),
        F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"), F.lit("."), extension).alias("name"),
        F.encode("text", "UTF-8").alias("payload"),
        (F.col("doc_id") % 3 + 1).alias("chunks"),
        F.date_format(
            F.timestamp_seconds(F.col("doc_id") * 3600 + 1_577_836_800), "yyyy:MM:dd HH:mm:ss"
        ).alias("taken"),
    )
    content = _content(front)
    return rows.select(
        "doc_id", "shape", "name",
        F.concat_ws("/", "source", "lang", "name").alias("path"),
        (F.col("doc_id") * 60_000 + MTIME_BASE_MS).alias("mtime_ms"),
        content.alias("content"),
    ).select(
        F.concat_ws(
            ":", "path", F.length("content").cast("string"), F.col("mtime_ms").cast("string")
        ).alias("file_id"),
        F.col("doc_id").alias("list_ord"),
        "path", "name", F.length("content").cast("bigint").alias("size"), "mtime_ms", "shape", "content",
    )


def _content(front: bool) -> Column:
    col = F.col
    payload, chunks = col("payload"), col("chunks")
    exif = exif_segment(
        col("lang"), F.concat(col("source"), F.lit("-camera")), col("taken"), col("doc_id") % 8 + 1
    )
    whole = clip(payload, chunks, front)
    stamp = col("doc_id") * 1000 + 250
    still_len = F.octet_length("source") + 188 + 2 + 4 + STILL_BYTES + 2
    clip_len = F.length(payload) + chunks * 12 + 516
    plain = heic_head()
    shapes = {
        "jpeg-directory": cat(jpeg(exif, packet_segment(directory_packet(clip_len, still_len, stamp))), whole),
        "jpeg-trailer": cat(jpeg(exif), trailer(whole)),
        "jpeg-pointer": let(
            cat(jpeg(exif), whole),
            lambda b: cat(b, trailer(cat(b"mpv2", be(F.length(b) - clip_len, 4), be(clip_len, 4)))),
        ),
        "heic-mpvd": cat(plain, box(b"mpvd", whole)),
        "heic-mpvd-sefd": cat(plain, box(b"mpvd", whole, box(b"sefd", repeat(b"e", 24)))),
        "heic-item": let(
            F.length(heic_head(F.lit(0), F.lit(0))) + 8,
            lambda at: cat(heic_head(at, clip_len), box(b"free", whole)),
        ),
        "mp4": clip(payload, chunks, not front),
        "jpeg": cat(jpeg(exif), payload),
        "jpeg-appended": cat(jpeg(exif), whole),
        "jpeg-micro": cat(jpeg(exif, packet_segment(micro_packet(clip_len, stamp))), whole),
        "jpeg-samples": let(
            jpeg(exif, packet_segment(flag_packet())),
            lambda b: cat(b, clip(payload, chunks, False, F.length(b)), repeat(b"z", TAIL_JUNK)),
        ),
        "png": cat(b"\x89PNG\r\n\x1a\n", payload),
    }
    out = None
    for name, value in shapes.items():
        out = F.when(col("shape") == name, value) if out is None else out.when(col("shape") == name, value)
    return out


#: Bytes in a segment that ``long_header_files`` puts before the others, and of its header.
LEAD, SEGMENT_HEAD = 3000, 4


def long_header_files(docs: DataFrame) -> DataFrame:
    """One photo per document whose directory packet comes behind 0 to 20 segments of ``LEAD`` bytes."""
    rows = docs.select(
        "doc_id", "lang", "source", F.encode("text", "UTF-8").alias("payload"), (F.col("doc_id") % 3 + 1).alias("chunks"),
    )
    exif = exif_segment(
        F.col("lang"), F.concat(F.col("source"), F.lit("-camera")), F.lit("2020:01:01 00:00:00"), F.col("doc_id") % 8 + 1
    )
    whole = clip(F.col("payload"), F.col("chunks"), True)
    still_len = F.octet_length("source") + 188 + 2 + 4 + STILL_BYTES + 2
    clip_len = F.length("payload") + F.col("chunks") * 12 + 516
    packet = packet_segment(directory_packet(clip_len, still_len, F.col("doc_id") * 1000 + 250))
    segment = b"\xff\xe2" + (LEAD + 2).to_bytes(2, "big") + repeat(b"p", LEAD)
    lead = F.unhex(F.repeat(F.lit(segment.hex()), (F.col("doc_id") % 21).cast("int")))
    tail = b"\xff\xda\x00\x02" + repeat(b"s", STILL_BYTES) + b"\xff\xd9"
    name = F.concat(F.lit("LONG_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return rows.select(
        F.col("doc_id").alias("list_ord"), name.alias("name"), name.alias("path"), F.lit(MTIME_BASE_MS).alias("mtime_ms"),
        cat(b"\xff\xd8", lead, exif, packet, tail, whole).alias("content"),
    ).withColumn("size", F.length("content").cast("bigint"))


def whole_windows(files: DataFrame) -> DataFrame:
    """Files with one window over everything."""
    return files.withColumn("wins", F.array(window(F.lit(0), F.col("content"))))


# -- library rows by formula ----------------------------------------------------------------------

LIBRARY_EXTENSIONS = ["jpg", "mov", "HEIC", "MP4", "txt", "jpeg", "Mov", "png", "heic"]


def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listed file per document."""
    return library_files_from(table(spark, sf_dir, "documents"))


def library_files_from(documents: DataFrame) -> DataFrame:
    """File rows by formula. A third of all names share the stem ``IMG_0001``."""
    doc = F.col("doc_id")
    extension = F.element_at(
        F.array(*[F.lit(e) for e in LIBRARY_EXTENSIONS]),
        (doc % len(LIBRARY_EXTENSIONS) + 1).cast("int"),
    )
    stem = F.when(doc % 3 == 0, "0001").otherwise(F.floor(doc / 6).cast("string"))
    name = (
        F.when(doc % 40 == 7, "Thumbs.db").when(doc % 50 == 9, ".jpg").when(doc % 60 == 11, "NOEXT")
        .otherwise(
            F.concat(
                F.when(doc % 25 == 4, "._").otherwise(""), F.lit("IMG_"), stem, F.lit("."), extension
            )
        )
    )
    return documents.select(
        "doc_id", "lang", "source", "n_chars",
        doc.alias("list_ord"),
        name.alias("name"),
        F.when(doc % 10 != 3, F.concat_ws("/", "source", "lang", name)).alias("path"),
        (F.col("n_chars") % 10 * 1000 + 500).alias("size"),
        (doc * 60_000 + MTIME_BASE_MS).alias("mtime_ms"),
    )


def library_catalog(entries: DataFrame) -> DataFrame:
    """Scan results by formula for entries that still carry doc_id, lang, source and n_chars."""
    doc, n = F.col("doc_id"), F.col("n_chars")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    failed = doc % 17 == 3
    taken = F.date_format(F.timestamp_seconds(doc * 3600 + 1_577_836_800), "yyyy:MM:dd HH:mm:ss")
    thumb = F.when(
        doc % 6 == 1,
        F.struct(
            F.lit(20).cast("bigint").alias("off"), (n % 50).alias("len"),
            F.when(doc % 4 != 0, (doc % 4).cast("int")).alias("orientation"),
        ),
    )
    still = F.struct(
        F.lit("image/jpeg").alias("mime"),
        F.when(doc % 13 != 0, (doc % 3000 + 100).cast("int")).alias("width"),
        (doc % 2000 + 50).cast("int").alias("height"),
        F.when(doc % 3 != 0, n).alias("length"),
        thumb.alias("thumb"),
    )
    motion = F.struct(
        (doc % 5 != 1).alias("found"),
        pick(["samsung", "google", "heif-item", "unknown"], doc % 4).alias("family"),
        F.lit("container").alias("method"), F.lit("exact").alias("confidence"),
        F.struct((n % 1000).alias("off"), n.alias("len")).alias("video"),
        F.when(doc % 3 == 1, doc * 1000).alias("timestamp_us"),
        doc.isNotNull().alias("_unused"),
        (doc % 5).isin(2, 3).alias("playable"),
        F.when(doc % 3 != 2, pick(["avc1.42E01E", "hvc1.1.6.L93.90", ""], doc % 3)).alias("codec"),
        F.lit(640).alias("width"), F.lit(480).alias("height"),
        F.when(doc % 9 != 0, (doc % 200) * 1000 - 500).alias("duration_ms"),
        F.when(doc % 20 == 4, "reading the video header").alias("reason"),
    ).dropFields("_unused")
    return entries.withColumns(
        {
            "status": F.when(failed, "failed").when(doc % 31 == 5, "pending").otherwise("ok"),
            "error": F.when(doc % 34 == 3, "disk error"),
            "kind": F.when(F.col("family_ext") == "video", "video").otherwise(pick(["motion", "photo"], doc % 2)),
            "container": pick(["jpeg", "heif", "avif", "mp4", "png"], doc % 5),
            "still": F.when(doc % 11 != 0, still),
            "motion": F.when(doc % 5 != 0, motion),
            "meta": F.struct(
                F.when(doc % 4 != 1, F.upper("lang")).alias("make"),
                F.when(doc % 3 == 0, "").otherwise(F.col("source")).alias("model"),
                F.lit(None).cast("string").alias("software"), F.lit(None).cast("string").alias("lens"),
                F.when(doc % 19 == 0, None).when(doc % 7 == 0, "not a date")
                .when(doc % 23 == 1, F.lit("2020:13:41 10:00:00"))
                .when(doc % 2 == 0, F.replace(taken, F.lit(" "), F.lit("T"))).otherwise(taken).alias("taken_at"),
                (doc % 9).cast("int").alias("orientation"),
            ),
            "markers": F.when(doc % 8 == 0, F.array(F.lit("MotionPhoto_Data")))
            .when(doc % 8 == 1, F.array(F.lit("Camera:MotionPhoto"), F.lit("MotionPhoto_Data_x")))
            .otherwise(F.array().cast("array<string>")),
            "stats": F.when(
                ~failed,
                F.struct((doc % 4).cast("int").alias("reads"), n.alias("bytes_read"), F.lit(1).alias("passes")),
            ),
        }
    )
