"""Queries over listed files and catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth
from ..functions import codecs, names, text
from ..operators import catalog as cat
from ..operators import pairing, quality
from ..plans.routes import in_bounds
from ..sources import store
from ..sources.listing import files_from_manifest
from ..streaming.incremental import scratch
from ..structures import containers, items, packets, trailer

EXTENSIONS_SQL = "['jpg','mov','HEIC','MP4','txt','jpeg','Mov','png','heic']"
STILL_SQL = ",".join(f"'{e}'" for e in names.STILL_EXTENSIONS)
VIDEO_SQL = ",".join(f"'{e}'" for e in names.VIDEO_EXTENSIONS)

FILES = f"""files AS (
  SELECT doc_id, lang, source, n_chars, doc_id AS list_ord, name,
         n_chars % 10 * 1000 + 500 AS size, doc_id * 60000 + 1600000000000 AS mtime_ms,
         CASE WHEN doc_id % 10 <> 3 THEN source || '/' || lang || '/' || name ELSE name END AS path
  FROM (SELECT *, CASE WHEN doc_id % 40 = 7 THEN 'Thumbs.db' WHEN doc_id % 50 = 9 THEN '.jpg'
           WHEN doc_id % 60 = 11 THEN 'NOEXT'
           ELSE CASE WHEN doc_id % 25 = 4 THEN '._' ELSE '' END || 'IMG_' ||
             CASE WHEN doc_id % 3 = 0 THEN '0001' ELSE CAST(doc_id // 6 AS VARCHAR) END || '.' ||
             list_extract({EXTENSIONS_SQL}, CAST(doc_id % 9 + 1 AS INT)) END AS name
        FROM documents)),
entries AS (
  SELECT *, CASE WHEN ext IN ({VIDEO_SQL}) THEN 'video' ELSE 'unknown' END AS family_ext,
         NOT junk AND ext IN ({STILL_SQL},{VIDEO_SQL}) AS scannable,
         path || ':' || CAST(size AS VARCHAR) || ':' || CAST(mtime_ms AS VARCHAR) AS file_id,
         lower(CASE WHEN strpos(name[2:], '.') > 0 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END) AS pair_key
  FROM (SELECT *, CASE WHEN strpos(name[2:], '.') > 0 THEN lower(split_part(name, '.', -1)) ELSE '' END AS ext,
           (name LIKE '.\\_%' ESCAPE '\\' OR name IN ('.DS_Store','Thumbs.db','desktop.ini')
            OR name LIKE '.Spotlight-%' OR name LIKE '.fseventsd%') AS junk FROM files))"""

PAIRED = FILES + """,
best AS (
  SELECT pair_key, file_id AS companion_id, size AS companion_size FROM (
    SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY size, list_ord) AS rn
    FROM entries WHERE scannable AND family_ext = 'video') WHERE rn = 1),
paired AS (
  SELECT e.*, b.companion_id, b.companion_size FROM entries e
  LEFT JOIN best b ON e.pair_key = b.pair_key AND e.family_ext <> 'video'
  WHERE e.scannable),
lib AS (
  SELECT p.*, p.file_id IN (SELECT companion_id FROM paired WHERE companion_id IS NOT NULL) AS hidden
  FROM paired p)"""

CATALOG = PAIRED + """,
raw AS (
  SELECT *,
    CASE WHEN doc_id % 17 = 3 THEN 'failed' WHEN doc_id % 31 = 5 THEN 'pending' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 34 = 3 THEN 'disk error' END AS error,
    CASE WHEN family_ext = 'video' THEN 'video' WHEN doc_id % 2 = 0 THEN 'motion' ELSE 'photo' END AS kind,
    list_extract(['jpeg','heif','avif','mp4','png'], CAST(doc_id % 5 + 1 AS INT)) AS container,
    doc_id % 11 <> 0 AS has_still,
    CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN doc_id % 3000 + 100 END AS still_w,
    CASE WHEN doc_id % 11 <> 0 THEN doc_id % 2000 + 50 END AS still_h,
    CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 <> 0 THEN n_chars END AS still_len,
    CASE WHEN doc_id % 11 <> 0 AND doc_id % 6 = 1 THEN n_chars % 50 END AS thumb_len,
    CASE WHEN doc_id % 11 <> 0 AND doc_id % 6 = 1 AND doc_id % 4 <> 0 THEN doc_id % 4 END AS thumb_o,
    doc_id % 5 <> 0 AS has_motion,
    doc_id % 5 IN (2, 3, 4) AS found,
    doc_id % 5 IN (2, 3) AS playable,
    CASE WHEN doc_id % 5 <> 0 THEN list_extract(['samsung','google','heif-item','unknown'], CAST(doc_id % 4 + 1 AS INT)) END AS family,
    CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 2 THEN list_extract(['avc1.42E01E','hvc1.1.6.L93.90'], CAST(doc_id % 3 + 1 AS INT)) END AS codec,
    CASE WHEN doc_id % 5 <> 0 AND doc_id % 9 <> 0 THEN doc_id % 200 * 1000 - 500 END AS duration_ms,
    CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 1 THEN doc_id * 1000 END AS timestamp_us,
    CASE WHEN doc_id % 5 <> 0 AND doc_id % 20 = 4 THEN 'reading the video header' END AS reason,
    CASE WHEN doc_id % 4 <> 1 THEN upper(lang) END AS make,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS model,
    CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'not a date' WHEN doc_id % 23 = 1 THEN '2020:13:41 10:00:00'
      WHEN doc_id % 2 = 0 THEN strftime(make_timestamp(CAST(doc_id * 3600 + 1577836800 AS BIGINT) * 1000000), '%Y:%m:%dT%H:%M:%S')
      ELSE strftime(make_timestamp(CAST(doc_id * 3600 + 1577836800 AS BIGINT) * 1000000), '%Y:%m:%d %H:%M:%S') END AS taken_at,
    CASE WHEN doc_id % 19 = 0 OR doc_id % 7 = 0 OR doc_id % 23 = 1 THEN mtime_ms ELSE (doc_id * 3600 + 1577836800) * 1000 END AS captured_ms,
    doc_id % 9 AS orientation,
    CASE WHEN doc_id % 8 = 0 THEN 'MotionPhoto_Data' WHEN doc_id % 8 = 1 THEN 'Camera:MotionPhoto MotionPhoto_Data_x' END AS marker_text,
    CASE WHEN doc_id % 17 <> 3 THEN doc_id % 4 END AS reads,
    CASE WHEN doc_id % 17 <> 3 THEN n_chars END AS bytes_read
  FROM lib),
cat AS (
  SELECT *, CASE WHEN status = 'failed' THEN 'problem' WHEN kind = 'video' THEN 'video'
      WHEN companion_id IS NOT NULL THEN 'live' WHEN playable THEN 'motion' WHEN has_still THEN 'still'
      WHEN found THEN 'problem' ELSE 'still' END AS library_kind,
    lower(concat_ws(' ', name, path, nullif(ext, ''), nullif(make, ''), nullif(model, ''), taken_at, family, codec, container, marker_text)) AS hay
  FROM raw)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.to_entries(synth.library_files(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = cat.scannable(entries(spark, sf_dir))
    return synth.library_catalog(pairing.marked_pairs(shown))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def on_entries(name: str, sql: str, build) -> None:
    query(name, f"WITH {FILES} {sql}")(lambda spark, sf: build(entries(spark, sf)))


def on_catalog(name: str, sql: str, build) -> None:
    query(name, f"WITH {CATALOG} {sql}")(lambda spark, sf: build(catalog(spark, sf)))


@query(
    "manifest_intake",
    f"WITH {FILES} SELECT list_ord, name, path, CASE WHEN doc_id % 7 = 2 THEN 0 ELSE size END AS size FROM files WHERE doc_id % 10 <> 3",
)
def _(spark, sf):
    """A file list with gaps: names or paths alone, rows with neither, missing sizes."""
    doc = F.col("doc_id")
    listed = synth.library_files(spark, sf).select(
        "list_ord", "path", "mtime_ms", F.when(doc % 5 != 3, F.col("name")).alias("name"),
        F.when(doc % 7 != 2, F.col("size")).alias("size"),
    )
    return files_from_manifest(listed).select("list_ord", "name", "path", "size")


# -- names and entries ----------------------------------------------------------------------------

on_entries("entry_ext", "SELECT list_ord, name, ext FROM entries", lambda e: e.select("list_ord", "name", "ext"))
on_entries(
    "entry_junk", "SELECT list_ord, junk FROM entries",
    lambda e: e.select("list_ord", names.is_junk(F.col("name")).alias("junk")),
)
on_entries(
    "entry_scannable", "SELECT list_ord, scannable, family_ext FROM entries",
    lambda e: e.select("list_ord", "scannable", "family_ext"),
)
on_entries(
    "entry_pair_key", "SELECT list_ord, pair_key FROM entries",
    lambda e: e.select("list_ord", names.pair_key(F.col("name")).alias("pair_key")),
)
on_entries(
    "entry_projection", "SELECT file_id, list_ord, path, name, ext, size, mtime_ms FROM entries",
    lambda e: e.select("file_id", "list_ord", "path", "name", "ext", "size", "mtime_ms"),
)
on_entries(
    "entry_prescan_filter", "SELECT file_id, size FROM entries WHERE scannable",
    lambda e: cat.scannable(e).select("file_id", "size"),
)
on_entries(
    "entry_clip_name", "SELECT list_ord, regexp_replace(name, '\\.[^.]+$', '') || '-motion.mp4' AS clip FROM entries",
    lambda e: e.select("list_ord", names.clip_name(F.col("name")).alias("clip")),
)
on_entries(
    "total_bytes_and_skipped",
    "SELECT count(*) FILTER (WHERE NOT scannable) AS skipped, CAST(sum(size) FILTER (WHERE scannable) AS BIGINT) AS total_bytes FROM entries",
    cat.entry_totals,
)

# -- pairing --------------------------------------------------------------------------------------


@query("pair_live", f"WITH {PAIRED} SELECT file_id, companion_id, companion_size FROM lib")
def _(spark: SparkSession, sf: str) -> DataFrame:
    shown = cat.scannable(entries(spark, sf))
    return pairing.pair_live(shown).select("file_id", "companion_id", "companion_size")


@query("mark_companions", f"WITH {PAIRED} SELECT file_id, hidden AS hidden_as_companion FROM lib")
def _(spark: SparkSession, sf: str) -> DataFrame:
    shown = cat.scannable(entries(spark, sf))
    return pairing.mark_companions(pairing.pair_live(shown)).select("file_id", "hidden_as_companion")


@query("hide_companions", f"WITH {PAIRED} SELECT file_id FROM lib WHERE NOT hidden")
def _(spark: SparkSession, sf: str) -> DataFrame:
    shown = cat.scannable(entries(spark, sf))
    return pairing.without_companions(pairing.pair_live(shown)).select("file_id")


on_catalog(
    "companion_codec",
    "SELECT c.file_id, o.name AS companion_name, o.codec AS companion_codec FROM cat c LEFT JOIN cat o ON c.companion_id = o.file_id",
    lambda c: pairing.companion_codec(c).select("file_id", "companion_name", "companion_codec"),
)

# -- classification, filters, search ----------------------------------------------------------------

on_catalog("classify", "SELECT file_id, library_kind FROM cat", lambda c: cat.with_kind(c).select("file_id", "library_kind"))
on_catalog(
    "library_summary",
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE library_kind = '{k}') AS {k}" for k in text.KINDS) + " FROM cat WHERE NOT hidden",
    cat.summary,
)
on_catalog(
    "found_count", "SELECT count(*) FILTER (WHERE library_kind IN ('motion','live')) AS found FROM cat", cat.found_count
)
for _kind in ("all", "motion", "live", "still", "video", "problem", "other"):
    _test = "" if _kind in ("all", "other") else f" WHERE library_kind = '{_kind}'"
    on_catalog(
        f"filter_kind_{_kind}", f"SELECT file_id FROM cat{_test}",
        lambda c, k=_kind: cat.filter_kind(c, k).select("file_id"),
    )
for _name, _words in (("codec", " HVC1.1 "), ("marker", "data_x"), ("source", "Src3"), ("none", "  ")):
    on_catalog(
        f"search_{_name}", f"SELECT file_id FROM cat WHERE contains(hay, '{_words.strip().lower()}')",
        lambda c, q=_words: cat.search(c, q).select("file_id"),
    )
on_catalog(
    "visible_page_rows", "SELECT file_id FROM cat WHERE NOT hidden AND library_kind = 'live' AND contains(hay, 'img')",
    lambda c: cat.visible(c, "live", "img").select("file_id"),
)
on_catalog(
    "playable", "SELECT file_id, coalesce(playable, false) OR companion_id IS NOT NULL AS playable FROM cat",
    lambda c: c.select("file_id", cat.playable().alias("playable")),
)

# -- order and pages --------------------------------------------------------------------------------

NATURAL = """list_transform(regexp_extract_all(path, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
  THEN lpad(CAST(length(regexp_replace(x, '^0+(.)', '\\1')) AS VARCHAR), 5, '0') || regexp_replace(x, '^0+(.)', '\\1') ELSE x END)"""
NATURAL_TEXT = f"replace(replace(array_to_string({NATURAL}, ''), '_', ' '), '.', '!')"
ORDERS = {
    "name": f"lower({NATURAL_TEXT}), {NATURAL_TEXT}",
    "date-desc": "captured_ms DESC",
    "date-asc": "captured_ms",
    "size-desc": "size DESC",
}


def _page_sql(by: str) -> str:
    return (
        f"SELECT file_id FROM (SELECT file_id, row_number() OVER (ORDER BY {ORDERS[by]}, list_ord) AS rn FROM cat) "
        "WHERE rn > 120 AND rn <= 240"
    )


for _by in ("date-desc", "date-asc", "size-desc"):
    on_catalog(
        f"page_{_by.replace('-', '_')}", _page_sql(_by),
        lambda c, by=_by: cat.page(c, by, offset=cat.PAGE).select("file_id"),
    )


def _stored_page(c: DataFrame) -> DataFrame:
    folder = scratch(c.sparkSession, "pages")
    store.write_pages(c.select("file_id", "size", "list_ord"), folder, "size-desc")
    return store.read_page(c.sparkSession, folder, 600, 250).select("file_id", "size")


on_catalog(
    "stored_page",
    "SELECT file_id, size FROM (SELECT file_id, size, row_number() OVER (ORDER BY size DESC, list_ord) AS rn FROM cat) WHERE rn > 600 AND rn <= 850",
    _stored_page,
)


def _stored_catalog(c: DataFrame) -> DataFrame:
    """Stored, then every file of a size class rescanned and put in place."""
    folder = scratch(c.sparkSession, "catalog")
    rows = c.select("file_id", "size", "status", "list_ord")
    store.write_store(rows, folder, buckets=64)
    store.upsert_store(folder, rows.filter("size % 3000 = 500").withColumn("status", F.lit("rescanned")))
    return store.read_store(c.sparkSession, folder).select("file_id", "status")


on_catalog(
    "stored_catalog", "SELECT file_id, CASE WHEN size % 3000 = 500 THEN 'rescanned' ELSE status END AS status FROM cat",
    _stored_catalog,
)
on_catalog(
    "sort_size_rank", "SELECT file_id, row_number() OVER (ORDER BY size DESC, list_ord) - 1 AS rank FROM cat",
    lambda c: cat.ranked(c.select("file_id", "size", "list_ord"), [F.col("size").desc(), F.col("list_ord")]).select("file_id", "rank"),
)
on_catalog(
    "sort_kind_rank",
    "SELECT file_id, row_number() OVER (ORDER BY library_kind, lower(replace(replace(name, '_', ' '), '.', '!')), replace(replace(name, '_', ' '), '.', '!') DESC, list_ord) - 1 AS rank FROM cat",
    lambda c: cat.ranked(c, cat.order_columns("kind")).select("file_id", "rank"),
)
on_catalog(
    "sort_name_rank",
    f"SELECT file_id, row_number() OVER (ORDER BY lower({NATURAL_TEXT}), {NATURAL_TEXT} DESC, list_ord) - 1 AS rank FROM cat",
    lambda c: cat.ranked(c, cat.order_columns("name")).select("file_id", "rank"),
)
on_catalog(
    "neighbours",
    "SELECT row_number() OVER w - 1 AS rank, file_id, lag(file_id) OVER w AS previous_id, lead(file_id) OVER w AS next_id FROM cat WINDOW w AS (ORDER BY captured_ms DESC, list_ord)",
    lambda c: cat.neighbours(c, "date-desc"),
)

# -- totals -----------------------------------------------------------------------------------------

TOTALS = "SELECT count(*) AS files, CAST(coalesce(sum(reads), 0) AS BIGINT) AS reads, CAST(coalesce(sum(bytes_read), 0) AS BIGINT) AS bytes_read, CAST(sum(size) AS BIGINT) AS total_bytes FROM cat"
on_catalog("scan_totals", TOTALS, cat.scan_totals)
on_catalog(
    "read_share",
    f"SELECT *, CASE WHEN bytes_read * 100.0 / total_bytes < 1 THEN round(CAST(bytes_read AS DOUBLE) / total_bytes * 100, 2) ELSE round(CAST(bytes_read AS DOUBLE) / total_bytes * 100, 1) END AS share FROM ({TOTALS})",
    lambda c: cat.read_share(cat.scan_totals(c)),
)
on_catalog(
    "check_reads", "SELECT file_id, reads, bytes_read FROM cat WHERE bytes_read > reads * 5000",
    lambda c: quality.check_reads(c.withColumn("stats", F.col("stats").withField("asked", F.col("stats.reads") * 5000))),
)

# -- text -------------------------------------------------------------------------------------------


def _bytes_sql(x: str) -> str:
    """Exact ties (quarters) go up here; all other halves are not representable."""
    up = lambda v: f"{v} + CASE WHEN {v} * 4 = floor({v} * 4) AND {v} * 2 <> floor({v} * 2) THEN 0.01 ELSE 0 END"
    cases = "".join(
        f" WHEN {x} >= 1e{3 * p} THEN CASE WHEN {x} / 1e{3 * p} >= 100 THEN printf('%d {u}', CAST(floor({x} / 1e{3 * p} + 0.5) AS BIGINT)) ELSE printf('%.1f {u}', {up(f'({x} / 1e{3 * p})')}) END"
        for p, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "kB"))
    )
    return f"CASE WHEN {x} <= 0 THEN '0 B'{cases} ELSE printf('%.0f B', {x}) END"


MS_TOTAL = "CAST(floor(duration_ms / 1000.0 + 0.5) AS BIGINT)"
DURATION_SQL = (
    f"CASE WHEN duration_ms IS NULL OR duration_ms <= 0 THEN '' WHEN {MS_TOTAL} // 60 > 0 THEN ({MS_TOTAL} // 60) || 'm ' "
    f"|| lpad(CAST({MS_TOTAL} % 60 AS VARCHAR), 2, '0') || 's' ELSE ({MS_TOTAL} % 60) || 's' END"
)
WHEN_SQL = "strftime(make_timestamp(captured_ms * 1000), '%Y-%m-%d %H:%M')"
DIMS_SQL = "CASE WHEN still_w > 0 AND still_h > 0 THEN still_w || '×' || still_h END"

on_entries(
    "format_bytes",
    f"SELECT list_ord, {_bytes_sql('CAST(n_chars * n_chars * (doc_id % 50) AS DOUBLE)')} AS text FROM entries",
    lambda e: e.select(
        "list_ord", text.format_bytes(F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 50)).alias("text")
    ),
)
on_catalog(
    "format_duration", f"SELECT file_id, {DURATION_SQL} AS text FROM cat",
    lambda c: c.select("file_id", text.format_duration(F.col("motion.duration_ms")).alias("text")),
)
on_catalog(
    "format_datetime", f"SELECT file_id, {WHEN_SQL} AS text FROM cat",
    lambda c: c.select(
        "file_id", text.format_datetime(text.captured_at(F.col("meta.taken_at"), F.col("mtime_ms"))).alias("text")
    ),
)
on_catalog(
    "parse_exif_date",
    "SELECT file_id, try_strptime(replace(taken_at, 'T', ' '), '%Y:%m:%d %H:%M:%S') AS taken FROM cat",
    lambda c: c.select("file_id", text.parse_exif_date(F.col("meta.taken_at")).alias("taken")),
)
on_catalog(
    "captured_at", "SELECT file_id, captured_ms FROM cat",
    lambda c: c.select("file_id", text.captured_at(F.col("meta.taken_at"), F.col("mtime_ms")).alias("captured_ms")),
)
on_catalog(
    "kind_label",
    "SELECT file_id, CASE library_kind WHEN 'motion' THEN 'Motion' WHEN 'live' THEN 'Live' WHEN 'still' THEN 'Still' WHEN 'video' THEN 'Video' ELSE library_kind END AS label FROM cat",
    lambda c: c.select("file_id", text.kind_label(text.classify()).alias("label")),
)
on_catalog(
    "badges",
    f"""SELECT file_id, concat_ws('|', CASE WHEN playable THEN 'MOTION' END, CASE WHEN companion_id IS NOT NULL THEN 'LIVE' END,
      CASE family WHEN 'samsung' THEN 'SAMSUNG' WHEN 'google' THEN 'GOOGLE' WHEN 'heif-item' THEN 'HEIC ITEM' END,
      CASE container WHEN 'heif' THEN 'HEIC' WHEN 'avif' THEN 'AVIF' WHEN 'mp4' THEN 'MP4' END,
      CASE WHEN codec LIKE 'hvc1%' THEN 'HEVC' END, {DIMS_SQL},
      CASE WHEN marker_text LIKE '%MotionPhoto_Data%' THEN 'EmbeddedVideoFile' END) AS badges FROM cat""",
    lambda c: c.select("file_id", F.array_join(text.badges(), "|").alias("badges")),
)
on_catalog(
    "problem_text",
    f"""SELECT file_id, CASE WHEN status = 'failed' THEN coalesce(error, '{text.UNREADABLE}') WHEN NOT has_motion OR playable THEN ''
      WHEN found THEN coalesce(reason, '{text.NOT_EXTRACTED}') ELSE '' END AS problem FROM cat""",
    lambda c: c.select("file_id", text.problem_text().alias("problem")),
)
on_catalog(
    "describe",
    f"""SELECT file_id, CASE WHEN status = 'pending' THEN 'waiting…' WHEN status = 'failed' THEN coalesce(error, 'unreadable')
      ELSE concat_ws(' · ', nullif(trim(concat_ws(' ', nullif(make, ''), nullif(model, ''))), ''), {WHEN_SQL},
        {_bytes_sql('CAST(size AS DOUBLE)')}, {DIMS_SQL},
        CASE WHEN {DURATION_SQL} <> '' THEN 'motion ' || {DURATION_SQL} END) END AS line FROM cat""",
    lambda c: c.select("file_id", text.describe().alias("line")),
)
on_catalog(
    "failure_reasons",
    """SELECT c.file_id, CASE WHEN c.companion_id IS NOT NULL THEN 'companion-codec'
        WHEN coalesce(c.codec, o.codec, '') LIKE 'hvc1%' AND c.container = 'heif' THEN 'hevc-still-and-clip'
        WHEN coalesce(c.codec, o.codec, '') <> '' THEN 'clip-codec' ELSE 'codec-unknown' END AS clip_reason,
      CASE WHEN c.container IN ('heif','avif') AND c.playable THEN 'hevc-still-with-clip'
        WHEN c.container IN ('heif','avif') THEN 'hevc-still' ELSE 'unsupported-still' END AS still_reason
      FROM cat c LEFT JOIN cat o ON c.companion_id = o.file_id""",
    lambda c: pairing.companion_codec(c).select(
        "file_id", text.clip_failure_reason(F.col("companion_codec")).alias("clip_reason"),
        text.still_failure_reason().alias("still_reason"),
    ),
)
on_catalog(
    "marker_seconds", "SELECT file_id, timestamp_us / 1e6 AS seconds FROM cat",
    lambda c: c.select("file_id", text.marker_seconds(F.col("motion.timestamp_us")).alias("seconds")),
)

# -- derived columns --------------------------------------------------------------------------------

RANGE_SQL = """SELECT *, CASE WHEN thumb_len > 0 THEN 20 WHEN still_len >= 128 OR size <= 67108864 THEN 0 END AS off,
  CASE WHEN thumb_len > 0 THEN thumb_len WHEN still_len >= 128 THEN least(still_len, size) WHEN size <= 67108864 THEN size END AS len,
  coalesce(thumb_len > 0, false) AS is_thumb FROM cat"""
on_catalog(
    "still_range", f"SELECT file_id, off, len, is_thumb FROM ({RANGE_SQL})",
    lambda c: c.withColumn("r", cat.still_range()).select("file_id", "r.off", "r.len", "r.is_thumb"),
)
TURN_SQL = "CASE WHEN is_thumb AND coalesce(thumb_o, 1) = 1 THEN orientation ELSE 1 END"
on_catalog(
    "display_dims",
    f"SELECT file_id, {TURN_SQL} AS turn, CASE WHEN {TURN_SQL} BETWEEN 5 AND 8 THEN still_h ELSE still_w END AS width, CASE WHEN {TURN_SQL} BETWEEN 5 AND 8 THEN still_w ELSE still_h END AS height FROM ({RANGE_SQL})",
    lambda c: c.withColumn("turn", cat.rotation(cat.still_range()["is_thumb"]))
    .withColumn("d", cat.display_dims(F.col("still.width"), F.col("still.height"), F.col("turn")))
    .select("file_id", F.col("turn"), "d.width", "d.height"),
)
on_catalog(
    "range_bounds",
    "SELECT file_id, n_chars % 1000 < size AND n_chars > 0 AND n_chars % 1000 + n_chars <= size AS inside, n_chars % 1000 > 0 AND n_chars > 0 AND n_chars % 1000 + n_chars <= size AS valid FROM cat WHERE has_motion",
    lambda c: c.filter("motion is not null").select(
        "file_id",
        in_bounds(F.col("motion.video.off"), F.col("motion.video.len"), F.col("size")).alias("inside"),
        trailer.valid_range(F.col("motion.video.off"), F.col("motion.video.len"), F.col("size")).alias("valid"),
    ),
)
on_catalog(
    "still_mime",
    "SELECT file_id, CASE container WHEN 'jpeg' THEN 'image/jpeg' WHEN 'heif' THEN 'image/heic' WHEN 'avif' THEN 'image/avif' WHEN 'png' THEN 'image/png' END AS mime FROM cat",
    lambda c: c.select("file_id", containers.still_mime(F.col("container")).alias("mime")),
)
on_catalog(
    "codec_shape", "SELECT file_id, codec IS NOT NULL AS ok FROM cat",
    lambda c: c.select("file_id", F.coalesce(codecs.codec_ok(F.col("motion.codec")), F.lit(False)).alias("ok")),
)


# -- scalar parsing over the text tables ------------------------------------------------------------


@query(
    "parse_numbers",
    """SELECT event_id, CASE WHEN regexp_matches(trim(s), '^[0-9]{1,20}$') THEN TRY_CAST(trim(s) AS BIGINT) END AS u,
      CASE WHEN regexp_matches(trim(s), '^-?[0-9]{1,20}$') THEN TRY_CAST(trim(s) AS BIGINT) END AS i,
      CASE WHEN f IN ('1','true','True','TRUE','yes') THEN true WHEN f IN ('0','false','False','FALSE','no') THEN false END AS flag
      FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN '-' || user_id WHEN 2 THEN '+' || user_id
        WHEN 3 THEN user_id || '99999999999999999999' WHEN 4 THEN '9999999999999999999' ELSE event_type END AS s,
        list_extract(['1','true','yes','0','no','FALSE','maybe'], CAST(event_id % 7 + 1 AS INT)) AS f FROM events)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    user, k = F.col("user_id").cast("string"), F.col("event_id") % 6
    s = (
        F.when(k == 0, F.concat(F.lit(" "), user, F.lit(" "))).when(k == 1, F.concat(F.lit("-"), user))
        .when(k == 2, F.concat(F.lit("+"), user)).when(k == 3, F.concat(user, F.lit("9" * 20)))
        .when(k == 4, F.lit("9" * 19)).otherwise(F.col("event_type"))
    )
    flags = F.array(*[F.lit(v) for v in ("1", "true", "yes", "0", "no", "FALSE", "maybe")])
    f = F.element_at(flags, (F.col("event_id") % 7 + 1).cast("int"))
    return synth.table(spark, sf, "events").select(
        "event_id", text.parse_u64(s).alias("u"), text.parse_i64(s).alias("i"), text.parse_flag(f).alias("flag")
    )


@query(
    "brand_families",
    """SELECT l_orderkey, l_partkey, l_linenumber, brand, CASE WHEN brand IN ('heic','mif1') THEN 'heif' WHEN brand = 'avif' THEN 'avif'
      WHEN brand IN ('isom','qt  ','3gp4') THEN 'video' END AS family,
      brand = 'mp4v' OR (l_partkey % 3 = 0) AS item_video, l_partkey % 3 = 0 AND l_suppkey % 4 <> 3 AS directory_video
      FROM (SELECT *, list_extract(['heic','mif1','avif','isom','qt  ','3gp4','hvc1','mp4v'], CAST(l_orderkey % 8 + 1 AS INT)) AS brand FROM lineitem)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    brands = ["heic", "mif1", "avif", "isom", "qt  ", "3gp4", "hvc1", "mp4v"]
    brand = F.element_at(F.array(*[F.lit(b) for b in brands]), (F.col("l_orderkey") % 8 + 1).cast("int"))
    mime = F.when(F.col("l_partkey") % 3 == 0, "video/mp4").otherwise("image/jpeg")
    roles = F.array(F.lit("MotionPhoto"), F.lit("primary"), F.lit(None).cast("string"), F.lit("GainMap"))
    role = F.element_at(roles, (F.col("l_suppkey") % 4 + 1).cast("int"))
    return synth.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", brand.alias("brand"),
        codecs.brand_family(brand).alias("family"),
        items.item_is_video(brand, mime).alias("item_video"),
        packets.item_is_video(mime, role).alias("directory_video"),
    )


@query(
    "duration_ms",
    "SELECT o_orderkey, CASE WHEN o_custkey % 50 > 0 THEN CAST(floor(o_orderkey * 1000.0 / (o_custkey % 50)) AS BIGINT) END AS ms FROM orders",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return synth.table(spark, sf, "orders").select(
        "o_orderkey", codecs.duration_ms(F.col("o_orderkey"), F.col("o_custkey") % 50).alias("ms")
    )
