"""Queries that turn file bytes into rows.

The files are derived from the documents (``synth.media_files``). The SQL never parses a byte: it
computes sizes and offsets from the layout formulas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth
from ..functions import bytes as by
from ..functions import codecs, text
from ..functions.flow import apply_steps, cached_steps, fence, let
from ..structures import containers, items, jpeg, movie, packets, trailer

QUERIES: dict = {}
SQL: dict[str, str] = {}

HEIC, HEIC_ITEM = 279, 342

PACKET_SQL = """CASE shape
  WHEN 'jpeg-directory' THEN strlen('<x:xmpmeta><rdf:Description Camera:MotionPhoto="1" Camera:MotionPhotoVersion="1" Camera:MotionPhotoPresentationTimestampUs="' || (doc_id * 1000 + 250) || '"><Container:Directory><rdf:Seq><rdf:li><Container:Item Item:Mime="image/jpeg" Item:Semantic="Primary" Item:Length="' || still_len || '" Item:Padding="0"/></rdf:li><rdf:li><Container:Item Item:Mime="video/mp4" Item:Semantic="MotionPhoto" Item:Length="' || clip || '" Item:Padding="0"/></rdf:li></rdf:Seq></Container:Directory></rdf:Description></x:xmpmeta>')
  WHEN 'jpeg-micro' THEN strlen('<x:xmpmeta><GCamera:MicroVideo>1</GCamera:MicroVideo><rdf:Description GCamera:MicroVideoOffset="' || clip || '" GCamera:MicroVideoPresentationTimestampUs="' || (doc_id * 1000 + 250) || '"/></x:xmpmeta>')
  WHEN 'jpeg-samples' THEN strlen('<x:xmpmeta><rdf:Description Camera:MotionPhoto="1"/></x:xmpmeta>') END"""

MEDIA = f"""base AS (
  SELECT doc_id, lang, source, strlen(text) AS n, doc_id % 3 + 1 AS c, text,
    list_extract({synth.SHAPES}, CAST(doc_id % 12 + 1 AS INT)) AS shape,
    source || '/' || lang || '/IMG_' || doc_id || '.' || list_extract({synth.EXTENSIONS}, CAST(doc_id % 12 + 1 AS INT)) AS path,
    strlen(source) + 396 AS still_len, strlen(text) + (doc_id % 3 + 1) * 12 + 516 AS clip,
    (doc_id % 3 + 1) * 12 + 484 AS moov FROM documents),
packed AS (SELECT *, {PACKET_SQL} AS pk FROM base),
jpegs AS (SELECT *, strlen(source) + 188 AS exif_seg, coalesce(pk + 33, 0) AS pk_seg,
    strlen(source) + 396 + coalesce(pk + 33, 0) AS jpeg_len FROM packed),
media AS (SELECT *,
    CASE WHEN shape IN ('jpeg-directory','jpeg-micro','jpeg-appended') THEN jpeg_len + clip
      WHEN shape = 'jpeg-trailer' THEN jpeg_len + clip + 103 WHEN shape = 'jpeg-pointer' THEN jpeg_len + clip + 115
      WHEN shape = 'jpeg-samples' THEN jpeg_len + clip + 16 WHEN shape = 'jpeg' THEN jpeg_len + n
      WHEN shape = 'heic-mpvd' THEN {HEIC} + 8 + clip WHEN shape = 'heic-mpvd-sefd' THEN {HEIC} + 40 + clip
      WHEN shape = 'heic-item' THEN {HEIC_ITEM} + 8 + clip WHEN shape = 'mp4' THEN clip ELSE 8 + n END AS size,
    CASE WHEN shape IN ('jpeg-directory','jpeg-micro','jpeg-appended','jpeg-pointer') THEN jpeg_len
      WHEN shape = 'jpeg-trailer' THEN jpeg_len + 59 WHEN shape = 'jpeg-samples' THEN jpeg_len
      WHEN shape IN ('heic-mpvd','heic-mpvd-sefd') THEN {HEIC} + 8 WHEN shape = 'heic-item' THEN {HEIC_ITEM} + 8
      WHEN shape = 'mp4' THEN 0 END AS clip_off FROM jpegs),
clips AS (SELECT *, clip_off + CASE WHEN shape IN ('mp4','jpeg-samples') THEN 32 + n ELSE 24 END AS moov_off,
    CASE WHEN shape = 'jpeg-samples' THEN jpeg_len + 32 WHEN shape = 'mp4' THEN 32 ELSE moov + 32 END AS payload_at
  FROM media WHERE clip_off IS NOT NULL)"""

IS_HEIC = "shape IN ('heic-mpvd','heic-mpvd-sefd','heic-item')"
IS_JPEG = "shape LIKE 'jpeg%'"


def media(spark: SparkSession, sf: str) -> DataFrame:
    files = synth.whole_windows(synth.media_files(synth.document_rows(spark, sf)))
    return files.withColumnRenamed("list_ord", "doc_id")


def on_windows(build) -> Column:
    """``build(wins, size)`` over the windows of each row, bound once."""
    return fence(let(by.usable_windows(F.col("wins")), lambda w: build(w, F.col("size"))))


def bound_windows() -> Column:
    return by.usable_windows(F.col("wins"))


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = lambda spark, sf: fn(media(spark, sf))
        if sql is not None:
            SQL[name] = f"WITH {MEDIA} {sql}"
        return fn

    return register


# -- containers -------------------------------------------------------------------------------------


@query(
    "sniff",
    f"SELECT doc_id, CASE WHEN {IS_JPEG} THEN 'jpeg' WHEN {IS_HEIC} THEN 'heif' WHEN shape = 'mp4' THEN 'isobmff' ELSE 'png' END AS container, CASE WHEN {IS_HEIC} THEN 'heic' WHEN shape = 'mp4' THEN 'isom' END AS brand FROM media",
)
def _(m: DataFrame) -> DataFrame:
    return m.withColumn("s", on_windows(lambda w, n: containers.sniff(w))).select("doc_id", "s.container", "s.brand")


@query(
    "boxes_top",
    f"""SELECT doc_id, 0 AS ord, 'ftyp' AS typ, 0 AS start, 24 AS size FROM media WHERE {IS_HEIC} OR shape = 'mp4'
    UNION ALL SELECT doc_id, 1, 'meta', 24, CASE WHEN shape = 'heic-item' THEN {HEIC_ITEM} ELSE {HEIC} END - 24 FROM media WHERE {IS_HEIC}
    UNION ALL SELECT doc_id, 2, CASE WHEN shape = 'heic-item' THEN 'free' ELSE 'mpvd' END, clip_off - 8, size - clip_off + 8 FROM media WHERE {IS_HEIC}
    UNION ALL SELECT doc_id, 1, 'mdat', 24, n + 8 FROM media WHERE shape = 'mp4'
    UNION ALL SELECT doc_id, 2, 'moov', 32 + n, moov FROM media WHERE shape = 'mp4'""",
)
def _(m: DataFrame) -> DataFrame:
    boxes = on_windows(containers.boxes_top)
    return m.select("doc_id", F.posexplode(boxes).alias("ord", "b")).select(
        "doc_id", "ord", "b.typ", "b.start", "b.size"
    )


@query("find_mpvd", f"SELECT doc_id, {HEIC} AS start, size - {HEIC} AS len FROM media WHERE shape LIKE 'heic-mpvd%'")
def _(m: DataFrame) -> DataFrame:
    found = m.withColumn("b", on_windows(containers.find_mpvd)).filter("b is not null")
    return found.select("doc_id", "b.start", F.col("b.size").alias("len"))


@query("trim_sefd", "SELECT doc_id, clip_off + clip AS clip_end FROM media WHERE shape LIKE 'heic-mpvd%'")
def _(m: DataFrame) -> DataFrame:
    found = m.withColumn("b", on_windows(containers.find_mpvd)).filter("b is not null")
    end = on_windows(lambda w, n: containers.trim_sefd(w, F.col("b.data_start"), F.col("b.data_end")))
    return found.select("doc_id", end.alias("clip_end"))


@query(
    "complete_clip",
    "SELECT doc_id, CASE WHEN shape = 'mp4' THEN moov_off END AS moov_at, CASE WHEN shape = 'mp4' THEN moov END AS moov_len FROM media LEFT JOIN (SELECT doc_id, moov_off FROM clips) USING (doc_id)",
)
def _(m: DataFrame) -> DataFrame:
    box = on_windows(lambda w, n: containers.complete_clip(w, by.long(0), n))
    return m.withColumn("b", box).select("doc_id", F.col("b.start").alias("moov_at"), F.col("b.size").alias("moov_len"))


@query(
    "appended_clip",
    "SELECT doc_id, clip_off AS start, moov_off AS moov_at FROM clips WHERE shape IN ('jpeg-directory','jpeg-micro','jpeg-appended','heic-mpvd','heic-mpvd-sefd','heic-item')",
)
def _(m: DataFrame) -> DataFrame:
    found = m.withColumn("a", on_windows(containers.appended_clip)).filter("a is not null")
    return found.select("doc_id", "a.start", F.col("a.moov.start").alias("moov_at"))


@query(
    "starts_media_box",
    "SELECT doc_id, clip_off IS NOT NULL AS opens FROM media",
)
def _(m: DataFrame) -> DataFrame:
    at = F.coalesce(
        F.get(on_windows(lambda w, n: by.find_in_windows(w, "isommp42")), 0) - 16, by.long(0)
    )
    opens = on_windows(lambda w, n: containers.starts_media_box(w, F.col("at"), n - F.col("at")))
    return m.withColumn("at", at).select("doc_id", opens.alias("opens"))


# -- trailer ----------------------------------------------------------------------------------------

_BLOCK_LEN = "CASE WHEN shape = 'jpeg-trailer' THEN clip ELSE 12 END"
_BLOCK_AT = "CASE WHEN shape = 'jpeg-trailer' THEN jpeg_len ELSE jpeg_len + clip END"


@query(
    "trailer_blocks",
    f"""SELECT doc_id, 0 AS ord, 2561 AS typ, 'Image_UTC_Data' AS name, {_BLOCK_AT} + 22 AS payload_off, 13 AS payload_len FROM media WHERE shape IN ('jpeg-trailer','jpeg-pointer')
    UNION ALL SELECT doc_id, 1, 2608, 'MotionPhoto_Data', {_BLOCK_AT} + 59, {_BLOCK_LEN} FROM media WHERE shape IN ('jpeg-trailer','jpeg-pointer')""",
)
def _(m: DataFrame) -> DataFrame:
    blocks = on_windows(trailer.trailer)["blocks"]
    return m.select("doc_id", F.explode(blocks).alias("b")).select(
        "doc_id", "b.ord", "b.typ", "b.name", "b.payload_off", "b.payload_len"
    )


@query(
    "trailer_range",
    "SELECT doc_id, clip_off AS off, clip AS len, 'Image_UTC_Data,MotionPhoto_Data' AS markers FROM media WHERE shape IN ('jpeg-trailer','jpeg-pointer')",
)
def _(m: DataFrame) -> DataFrame:
    found = m.withColumn("t", on_windows(trailer.trailer)).filter("t is not null")
    value = on_windows(lambda w, n: trailer.trailer_range(w, n, F.col("t.blocks")))
    return found.withColumn("r", value).select(
        "doc_id", "r.off", "r.len", F.array_join(trailer.trailer_markers(F.col("t.blocks")), ",").alias("markers")
    )


# -- packets ----------------------------------------------------------------------------------------


@query(
    "packet_facts",
    """SELECT doc_id, shape IN ('jpeg-directory','jpeg-micro','jpeg-samples','jpeg-trailer','jpeg-pointer') AS present,
      CASE WHEN shape IN ('jpeg-directory','jpeg-samples') THEN true END AS motion_photo,
      CASE WHEN shape = 'jpeg-directory' THEN 1 END AS version,
      CASE WHEN shape = 'jpeg-directory' THEN doc_id * 1000 + 250 END AS motion_us,
      CASE WHEN shape = 'jpeg-micro' THEN true END AS micro_video,
      CASE WHEN shape = 'jpeg-micro' THEN clip END AS micro_offset,
      CASE WHEN shape = 'jpeg-micro' THEN doc_id * 1000 + 250 END AS micro_us,
      CASE WHEN shape IN ('jpeg-trailer','jpeg-pointer') THEN 'MotionPhoto_Data' ELSE '' END AS markers FROM media""",
)
def _(m: DataFrame) -> DataFrame:
    facts = on_windows(lambda w, n: packets.packet_facts(F.get(w, 0)["data"]))
    return m.withColumn("f", facts).select(
        "doc_id", "f.present", "f.motion_photo", "f.version", "f.motion_us", "f.micro_video",
        "f.micro_offset", "f.micro_us", F.array_join("f.markers", ",").alias("markers"),
    )


@query(
    "directory_items",
    """SELECT doc_id, 0 AS ord, 'image/jpeg' AS mime, 'Primary' AS semantic, still_len AS length, 0 AS padding FROM media WHERE shape = 'jpeg-directory'
    UNION ALL SELECT doc_id, 1, 'video/mp4', 'MotionPhoto', clip, 0 FROM media WHERE shape = 'jpeg-directory'""",
)
def _(m: DataFrame) -> DataFrame:
    rows = on_windows(lambda w, n: packets.directory_items(F.get(w, 0)["data"]))
    return m.select("doc_id", F.explode(rows).alias("i")).select("doc_id", "i.*")


# -- jpeg -------------------------------------------------------------------------------------------


@query(
    "jpeg_segments",
    f"""SELECT doc_id, 0 AS ord, 225 AS marker, 2 AS start, exif_seg - 4 AS data_len FROM media WHERE {IS_JPEG}
    UNION ALL SELECT doc_id, 1, 225, 2 + exif_seg, pk_seg - 4 FROM media WHERE {IS_JPEG} AND pk IS NOT NULL""",
)
def _(m: DataFrame) -> DataFrame:
    rows = on_windows(lambda w, n: jpeg.jpeg_segments(w))["segments"]
    return m.select("doc_id", F.posexplode(rows).alias("ord", "s")).select(
        "doc_id", "ord", "s.marker", "s.start", "s.data_len"
    )


def with_exif(m: DataFrame) -> DataFrame:
    rows = m.withColumn("segments", on_windows(lambda w, n: jpeg.jpeg_segments(w))["segments"])
    steps = cached_steps(
        "exif_query", lambda: jpeg.exif_steps({"wins": bound_windows(), "segments": F.col("segments")})
    )
    return apply_steps(rows, steps)


@query(
    "exif_tags",
    f"""SELECT doc_id, lang AS make, source || '-camera' AS model, strftime(make_timestamp(CAST(doc_id * 3600 + 1577836800 AS BIGINT) * 1000000), '%Y:%m:%d %H:%M:%S') AS taken_at,
      doc_id % 8 + 1 AS orientation, 4000 AS width, 3000 AS height, exif_seg - 14 AS thumb_off, 16 AS thumb_len FROM media WHERE {IS_JPEG}""",
)
def _(m: DataFrame) -> DataFrame:
    return with_exif(m).filter("exif is not null").select(
        "doc_id", "exif.make", "exif.model", "exif.taken_at", "exif.orientation", "exif.width",
        "exif.height", F.col("exif.thumb.off").alias("thumb_off"), F.col("exif.thumb.len").alias("thumb_len"),
    )


# -- item tables ------------------------------------------------------------------------------------


def with_tables(m: DataFrame) -> DataFrame:
    rows = m.withColumn(
        "meta", on_windows(lambda w, n: by.child(containers.boxes_top(w, n), "meta"))
    )
    steps = cached_steps(
        "tables_query", lambda: items.item_table_steps({"wins": bound_windows(), "meta": F.col("meta")})
    )
    return apply_steps(rows, steps)


_ITEM_ROWS = "(0, 1, 'grid', ''), (1, 2, 'hvc1', ''), (2, 3, 'hvc1', ''), (3, 4, 'mime', 'video/mp4')"


@query(
    "heif_items",
    f"SELECT doc_id, v.* FROM media, (VALUES {_ITEM_ROWS}) v(ord, item_id, item_type, content_type) WHERE {IS_HEIC} AND (v.ord < 3 OR shape = 'heic-item')",
)
def _(m: DataFrame) -> DataFrame:
    return with_tables(m).select("doc_id", F.explode("tables.items").alias("i")).select(
        "doc_id", "i.ord", F.col("i.id").alias("item_id"), "i.item_type", "i.content_type"
    )


@query(
    "item_extents",
    f"""SELECT doc_id, v.* FROM media, (VALUES (2, 0, 900, 10), (3, 0, 910, 12)) v(item_id, ord, off, len) WHERE {IS_HEIC}
    UNION ALL SELECT doc_id, 4, 0, clip_off, clip FROM media WHERE shape = 'heic-item'""",
)
def _(m: DataFrame) -> DataFrame:
    rows = with_tables(m).select("doc_id", F.explode("tables.locations").alias("l"))
    return rows.select("doc_id", F.col("l.id").alias("item_id"), F.posexplode("l.extents").alias("ord", "x")).select(
        "doc_id", "item_id", "ord", "x.off", "x.len"
    )


@query(
    "item_refs",
    f"SELECT doc_id, v.* FROM media, (VALUES ('dimg', 1, 2), ('dimg', 1, 3), ('cdsc', 1, 4)) v(ref_type, from_id, to_id) WHERE {IS_HEIC} AND (v.to_id < 4 OR shape = 'heic-item')",
)
def _(m: DataFrame) -> DataFrame:
    return with_tables(m).select("doc_id", F.explode("tables.refs").alias("r")).select("doc_id", "r.*")


@query(
    "picture_size_and_video_item",
    f"SELECT doc_id, 4032 AS width, 3024 AS height, CASE WHEN shape = 'heic-item' THEN 4 END AS video_item FROM media WHERE {IS_HEIC}",
)
def _(m: DataFrame) -> DataFrame:
    rows = with_tables(m).filter("tables is not null")
    return rows.select(
        "doc_id", "tables.size.width", "tables.size.height", items.video_item(F.col("tables"))["id"].alias("video_item")
    )


# -- movies -----------------------------------------------------------------------------------------


def with_roots(m: DataFrame) -> DataFrame:
    return m.withColumn("roots", on_windows(movie.moov_candidates))


def with_movies(m: DataFrame) -> DataFrame:
    steps = cached_steps(
        "movies_query", lambda: movie.movie_steps({"wins": bound_windows(), "roots": F.col("roots")})
    )
    return apply_steps(with_roots(m), steps)


def tracks(m: DataFrame) -> DataFrame:
    rows = with_movies(m).select("doc_id", F.explode("movies").alias("m"))
    return rows.select("doc_id", F.col("m.start").alias("moov_start"), F.explode("m.tracks").alias("t"))


@query("moov_candidates", "SELECT doc_id, moov_off AS start, moov AS len FROM clips")
def _(m: DataFrame) -> DataFrame:
    return with_roots(m).select("doc_id", F.explode("roots").alias("b")).select("doc_id", "b.start", F.col("b.size").alias("len"))


@query(
    "movie_boxes",
    """SELECT doc_id, v.depth, v.typ, moov_off + v.rel AS start, v.len + v.per * c AS size FROM clips, (VALUES
      (1, 'mvhd', 8, 108, 0), (1, 'trak', 116, 368, 12), (2, 'tkhd', 124, 92, 0), (2, 'mdia', 216, 268, 12),
      (3, 'mdhd', 224, 32, 0), (3, 'hdlr', 256, 33, 0), (3, 'minf', 289, 195, 12), (4, 'stbl', 297, 187, 12),
      (5, 'stsd', 305, 115, 0), (5, 'stsc', 420, 28, 0), (5, 'stsz', 448, 20, 8)) v(depth, typ, rel, len, per)
    UNION ALL SELECT doc_id, 5, 'stco', moov_off + 468 + 8 * c, 16 + 4 * c FROM clips""",
)
def _(m: DataFrame) -> DataFrame:
    steps = cached_steps(
        "movie_boxes_query",
        lambda: movie.movie_box_steps({"wins": bound_windows(), "roots": F.col("roots")}),
    )
    return apply_steps(with_roots(m), steps).select("doc_id", F.explode("tree").alias("x")).select(
        "doc_id", "x.depth", "x.box.typ", "x.box.start", "x.box.size"
    )


@query(
    "tracks",
    "SELECT doc_id, moov_off AS moov_start, 1 AS track_id, 'vide' AS handler, 'avc1' AS entry, 'avc1.42E01E' AS codec, 640 AS width, 480 AS height, 600 AS timescale, c * 600 AS duration, 2 * c AS sample_count, n AS sample_bytes, false AS fragmented FROM clips",
)
def _(m: DataFrame) -> DataFrame:
    names = [
        "track_id", "handler", "entry", "codec", "width", "height", "timescale", "duration",
        "sample_count", "sample_bytes", "fragmented",
    ]
    return tracks(m).select("doc_id", "moov_start", *[f"t.{n}" for n in names])


@query(
    "sample_sizes",
    "SELECT doc_id, i AS idx, CASE WHEN i < 2 * c - 1 THEN n // (2 * c) ELSE n - n // (2 * c) * (2 * c - 1) END AS bytes FROM clips, range(6) r(i) WHERE i < 2 * c",
)
def _(m: DataFrame) -> DataFrame:
    return tracks(m).select("doc_id", F.posexplode("t.sizes").alias("idx", "bytes"))


@query("chunk_offsets", "SELECT doc_id, i AS ord, payload_at + i * 2 * (n // (2 * c)) AS off FROM clips, range(3) r(i) WHERE i < c")
def _(m: DataFrame) -> DataFrame:
    return tracks(m).select("doc_id", F.posexplode("t.offsets").alias("ord", "off"))


@query("stsc_runs", "SELECT doc_id, 0 AS run_ord, 1 AS first, 2 AS per FROM clips")
def _(m: DataFrame) -> DataFrame:
    return tracks(m).select("doc_id", F.posexplode("t.runs").alias("run_ord", "r")).select(
        "doc_id", "run_ord", "r.first", "r.per"
    )


@query(
    "movie_summary",
    "SELECT doc_id, 'avc1.42E01E' AS codec, 640 AS width, 480 AS height, c * 1000 AS duration_ms FROM clips",
)
def _(m: DataFrame) -> DataFrame:
    rows = with_movies(m).withColumn("m", F.get("movies", 0)).filter("m is not null")
    return rows.withColumn("s", movie.movie_summary(F.col("m"))).select(
        "doc_id", "s.codec", "s.width", "s.height", "s.duration_ms"
    )


# -- byte primitives --------------------------------------------------------------------------------


@query(
    "read_at_windows",
    """SELECT doc_id, CASE WHEN pos + 16 <= least(size, 512) OR pos >= greatest(least(size, 512), size - 512) AND pos + 16 <= size THEN true ELSE false END AS visible
      FROM (SELECT doc_id, size, doc_id * 37 % size AS pos FROM media)""",
)
def _(m: DataFrame) -> DataFrame:
    head = F.least(F.col("size"), by.long(512))
    tail = F.greatest(head, F.col("size") - 512)
    wins = F.array(
        by.window(F.lit(0), F.substring("content", F.lit(1), head.cast("int"))),
        by.window(tail, F.substring("content", (tail + 1).cast("int"), F.lit(512))),
    )
    seen = on_windows(lambda w, n: by.read_at(w, F.col("at"), 16))
    expected = F.substring("content", (F.col("at") + 1).cast("int"), F.lit(16))
    rows = m.withColumn("wins", wins).withColumn("at", F.col("doc_id") * 37 % F.col("size"))
    return rows.withColumn("seen", seen).select(
        "doc_id", (F.col("seen").isNotNull() & F.coalesce(F.col("seen") == expected, F.lit(True))).alias("visible")
    )


def table_query(name: str, table: str, sql: str):
    def register(fn):
        QUERIES[name] = lambda spark, sf: fn(synth.table(spark, sf, table))
        SQL[name] = sql
        return fn

    return register


@table_query(
    "find_in_text", "documents",
    "SELECT doc_id, list_count(p) AS hits, coalesce(p[1], -1) AS first_at FROM (SELECT doc_id, list_filter(range(length(text)), lambda i: text[i + 1:i + 4] = 'tion') AS p FROM documents)",
)
def _(documents: DataFrame) -> DataFrame:
    hits = by.find_all(F.col("text"), "tion")
    return documents.withColumn("h", hits).select(
        "doc_id", F.size("h").alias("hits"), F.coalesce(F.get("h", 0), F.lit(-1)).alias("first_at")
    )


@table_query(
    "integers_from_bytes", "orders",
    "SELECT o_orderkey, o_orderkey % 65536 AS be16, o_custkey AS le32, o_orderkey * 1000003 AS be64, o_orderkey % 256 = 7 AS starts FROM orders",
)
def _(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    data = F.concat(
        by.be(key % 65536, 2), by.le(F.col("o_custkey"), 4), by.be(key * 1000003, 8), by.be(key % 256, 1)
    )
    rows = orders.select("o_orderkey", F.array(by.window(F.lit(100), data)).alias("wins"))
    at = lambda fn, off: let(bound_windows(), lambda w: fn(w, by.long(off)))
    return rows.select(
        "o_orderkey", at(by.u16, 100).alias("be16"), at(by.u32_le, 102).alias("le32"),
        at(by.u64, 106).alias("be64"),
        let(bound_windows(), lambda w: by.starts_with(w, 114, b"\x07")).alias("starts"),
    )


@table_query(
    "fourcc_text", "part",
    "SELECT p_partkey, chr(CAST(65 + p_partkey % 26 AS INT)) || 'b' || CASE WHEN p_partkey % 128 BETWEEN 32 AND 126 THEN chr(CAST(p_partkey % 128 AS INT)) ELSE '.' END || '.' AS code FROM part",
)
def _(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    data = F.concat(by.be(key % 26 + 65, 1), by.blob(b"b"), by.be(key % 128, 1), by.blob(b"\xfe"))
    return part.select("p_partkey", by.fourcc(data).alias("code"))


@table_query(
    "codec_strings", "lineitem",
    """SELECT l_orderkey, l_partkey, l_linenumber, 'avc1.' || printf('%02X%02X%02X', l_orderkey % 256, l_partkey % 256, l_suppkey % 256) AS avc,
      'hvc1.' || list_extract(['','A','B','C'], CAST(l_linenumber % 4 + 1 AS INT)) || (l_orderkey % 32) || '.' ||
      printf('%x', CAST(list_sum(list_transform(range(32), lambda i: ((l_partkey * 65537) // (2 ** i)::BIGINT) % 2 * (2 ** (31 - i))::BIGINT)) AS BIGINT)) || '.' ||
      CASE WHEN l_suppkey % 2 = 1 THEN 'H' ELSE 'L' END || (l_suppkey % 256) ||
      CASE WHEN l_orderkey % 3 = 0 THEN '' WHEN l_orderkey % 3 = 1 THEN '.' || printf('%02X', 144) ELSE '.90' || '00' || printf('%02X', l_partkey % 255 + 1) END AS hevc FROM lineitem""",
)
def _(lineitem: DataFrame) -> DataFrame:
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    avc = F.concat(by.blob(b"\1"), by.be(order % 256, 1), by.be(part % 256, 1), by.be(supp % 256, 1))
    first = F.col("l_linenumber") % 4 * 64 + supp % 2 * 32 + order % 32
    tail = (
        F.when(order % 3 == 0, by.blob(bytes(6))).when(order % 3 == 1, by.blob(b"\x90" + bytes(5)))
        .otherwise(F.concat(by.blob(b"\x90\x00"), by.be(part % 255 + 1, 1), by.blob(bytes(3))))
    )
    hevc = F.concat(by.blob(b"\1"), by.be(first, 1), by.be(part * 65537, 4), tail, by.be(supp % 256, 1))
    return lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", codecs.avc_codec(F.lit("avc1"), avc).alias("avc"),
        codecs.hevc_codec(F.lit("hvc1"), hevc).alias("hevc"),
    )


@table_query(
    "html_attributes", "pages",
    r"""SELECT page_id, nullif(regexp_extract(html, '(?:^|[ \t\n\r<:])lang[ \t\n\r]*=[ \t\n\r]*"([^"]*)"', 1), '') AS lang,
      nullif(regexp_extract(html, '(?:^|[ \t\n\r<:])href[ \t\n\r]*=[ \t\n\r]*"([^"]*)"', 1), '') AS href FROM pages""",
)
def _(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", packets.attribute(F.col("html"), "lang").alias("lang"),
        packets.attribute(F.col("html"), "href").alias("href"),
    )


@table_query(
    "literal_base64", "documents",
    "SELECT doc_id, strlen(base64(encode(text))) AS b64_len, md5(base64(encode(text))) AS b64_md5, md5(trim(text, ' \t\n\r\f')) AS trimmed_md5 FROM documents",
)
def _(documents: DataFrame) -> DataFrame:
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    return documents.select(
        "doc_id", F.octet_length(coded).alias("b64_len"), F.md5(coded).alias("b64_md5"),
        F.md5(text.trim_ascii(F.col("text"))).alias("trimmed_md5"),
    )
