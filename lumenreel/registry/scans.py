"""Queries over whole scans: routes, plans, read budgets, reports, checks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth
from ..operators import catalog as cat
from ..operators import quality
from ..plans.scan import DEFAULT, Limits, content_reader, deep_scan, scan
from ..session import materialise
from ..sources.sinks import report_json
from ..streaming import incremental
from .library import PAIRED
from .structures import MEDIA, PACKET_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}
_scanned: dict[tuple, DataFrame] = {}

# Windows so small that most files need the further passes.
NARROW = Limits(head_bytes=1200, tail_bytes=400)

RESULT_SQL = f"""{MEDIA},
res AS (SELECT m.*, c.moov_off, c.payload_at,
   CASE WHEN shape = 'mp4' THEN 'video' WHEN shape IN ('jpeg','png') THEN 'photo' ELSE 'motion' END AS kind,
   CASE WHEN shape = 'mp4' THEN 'plain-video' WHEN shape IN ('jpeg-trailer','jpeg-pointer') THEN 'samsung'
     WHEN shape IN ('jpeg-directory','jpeg-micro','heic-mpvd','heic-mpvd-sefd','jpeg-samples') THEN 'google'
     WHEN shape = 'heic-item' THEN 'heif-item' WHEN shape = 'jpeg-appended' THEN 'unknown' END AS family,
   CASE WHEN shape = 'mp4' THEN 'container' WHEN shape IN ('jpeg-trailer','jpeg-pointer') THEN 'seft-trailer' WHEN shape = 'jpeg-directory' THEN 'xmp-directory'
     WHEN shape = 'jpeg-micro' THEN 'xmp-microvideo-offset' WHEN shape LIKE 'heic-mpvd%' THEN 'mpvd-box' WHEN shape = 'heic-item' THEN 'heif-item'
     WHEN shape = 'jpeg-appended' THEN 'appended-container' WHEN shape = 'jpeg-samples' THEN 'sample-table' END AS method,
   CASE WHEN shape IN ('jpeg','png') THEN NULL WHEN shape = 'jpeg-appended' THEN 'medium' WHEN shape = 'jpeg-samples' THEN 'high' ELSE 'exact' END AS confidence,
   CASE WHEN shape = 'jpeg-samples' THEN payload_at WHEN shape NOT IN ('jpeg','png') THEN m.clip_off END AS video_off,
   CASE WHEN shape = 'jpeg-samples' THEN n WHEN shape NOT IN ('jpeg','png') THEN clip END AS video_len
   FROM media m LEFT JOIN (SELECT doc_id, moov_off, payload_at FROM clips) c USING (doc_id))"""


def _files(spark: SparkSession, sf: str) -> tuple:
    """Name, size and time of the files of the documents."""
    found = synth.table(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return tuple(sorted(map(tuple, found.distinct().collect())))


def scanned(spark: SparkSession, sf: str, limits: Limits = DEFAULT) -> DataFrame:
    """The scan of all derived files; its passes are already written, so queries can share it.

    It is taken again when the files of the table have changed.
    """
    key = (spark.sparkContext.applicationId, _files(spark, sf), limits)
    if key not in _scanned:
        files = synth.media_files(synth.document_rows(spark, sf))
        _scanned[key] = materialise(scan(cat.to_entries(files.drop("file_id")), limits=limits))
    return _scanned[key]


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = f"WITH {RESULT_SQL} {sql}"
        return fn

    return register


ROUTE = [
    "kind", "container", "motion.family", "motion.method", "motion.confidence", "motion.playable",
]
ROUTE_SQL = """SELECT doc_id, kind, CASE WHEN shape LIKE 'jpeg%' THEN 'jpeg' WHEN shape LIKE 'heic%' THEN 'heif' ELSE shape END AS container, family, method, confidence,
  CASE WHEN kind <> 'photo' THEN true END AS playable, video_off, video_len,
  CASE WHEN kind <> 'photo' THEN 'avc1.42E01E' END AS codec, CASE WHEN kind <> 'photo' THEN c * 1000 END AS duration_ms FROM res"""


def routes(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        F.col("list_ord").alias("doc_id"), *ROUTE, F.col("motion.video.off").alias("video_off"),
        F.col("motion.video.len").alias("video_len"), "motion.codec", "motion.duration_ms",
    )


@query("scan_routes", ROUTE_SQL)
def _(spark, sf):
    return routes(scanned(spark, sf))


@query(
    "scan_stills",
    """SELECT doc_id, CASE WHEN shape LIKE 'jpeg%' THEN 'image/jpeg' WHEN shape LIKE 'heic%' THEN 'image/heic' WHEN shape = 'png' THEN 'image/png' END AS mime,
      CASE WHEN shape LIKE 'jpeg%' THEN 4000 WHEN shape LIKE 'heic%' THEN 4032 END AS width,
      CASE WHEN shape = 'jpeg-directory' THEN still_len WHEN shape LIKE 'jpeg-%' THEN video_off END AS length,
      CASE WHEN shape LIKE 'jpeg%' THEN lang END AS make, CASE WHEN shape LIKE 'jpeg%' THEN doc_id % 8 + 1 END AS orientation FROM res""",
)
def _(spark, sf):
    return scanned(spark, sf).select(
        F.col("list_ord").alias("doc_id"), "still.mime", "still.width", "still.length", "meta.make", "meta.orientation"
    )


@query(
    "scan_plan_parts",
    """SELECT doc_id, 0 AS ord, 'slice' AS t, video_off AS off, video_len AS len FROM res WHERE kind <> 'photo' AND shape <> 'jpeg-samples'
    UNION ALL SELECT doc_id, 0, 'lit', NULL, 32 FROM res WHERE shape = 'jpeg-samples' UNION ALL SELECT doc_id, 1, 'lit', NULL, moov FROM res WHERE shape = 'jpeg-samples'
    UNION ALL SELECT doc_id, 2, 'lit', NULL, 8 FROM res WHERE shape = 'jpeg-samples' UNION ALL SELECT doc_id, 3, 'slice', payload_at, n FROM res WHERE shape = 'jpeg-samples'""",
)
def _(spark, sf):
    parts = quality.plan_parts(scanned(spark, sf).withColumn("file_id", F.col("list_ord")))
    return parts.select(F.col("file_id").alias("doc_id"), "ord", "t", "off", "len")


@query(
    "shifted_offsets",
    "SELECT doc_id, i AS ord, 32 + moov + 8 + i * 2 * (n // (2 * c)) AS off FROM res, range(3) r(i) WHERE shape = 'jpeg-samples' AND i < c",
)
def _(spark, sf):
    from ..functions.bytes import int_table

    moved = F.get(F.col("plan.parts"), F.lit(1))["lit"]
    rows = scanned(spark, sf).filter("motion.method = 'sample-table'").withColumn("raw", moved)
    chunks = F.floor((F.length("raw") - 484) / 12)
    table = int_table(F.substring("raw", (F.length("raw") - chunks * 4 + 1).cast("int"), F.length("raw")), 4)
    return rows.select(F.col("list_ord").alias("doc_id"), F.posexplode(table).alias("ord", "off"))


@query("scan_budget", "SELECT doc_id, 1 AS reads, size AS bytes_read, 1 AS passes FROM res")
def _(spark, sf):
    return scanned(spark, sf).select(
        F.col("list_ord").alias("doc_id"), "stats.reads", "stats.bytes_read", "stats.passes"
    )


@query("scan_report", "SELECT doc_id, kind, family, video_off FROM res")
def _(spark, sf):
    rows = cat.finish_catalog(scanned(spark, sf))
    got = lambda p: F.get_json_object("report", f"$.core.{p}")
    return rows.withColumn("report", report_json()).select(
        F.col("list_ord").alias("doc_id"), got("kind").alias("kind"), got("motion.family").alias("family"),
        got("motion.video.off").cast("bigint").alias("video_off"),
    )


@query(
    "planted_faults",
    """SELECT doc_id, rule FROM res, (VALUES ('bounds', 2), ('literals', 3), ('still', 5), ('reads', 7)) f(rule, every)
      WHERE doc_id % every = 0 AND CASE rule WHEN 'bounds' THEN kind <> 'photo' WHEN 'literals' THEN kind <> 'photo'
        WHEN 'still' THEN shape LIKE 'jpeg-%' ELSE true END""",
)
def _(spark, sf):
    """Slices moved out of their file, long literals, stills that reach into the clip, reads over the need: each check
    names the rows that were spoilt for it and no others."""
    rows = scanned(spark, sf).withColumn("file_id", F.col("list_ord"))
    doc, long_literal = F.col("list_ord"), quality.MAX_LITERAL

    def parts(change):
        return F.col("plan").withField("parts", F.transform("plan.parts", change))

    beyond = parts(lambda p: F.when(p["t"] == "slice", p.withField("off", F.col("size") - p["len"] + 1)).otherwise(p))
    literal = F.struct(
        F.lit("lit").alias("t"), F.lit(None).cast("binary").alias("lit"), F.lit(None).cast("bigint").alias("off"),
        F.lit(long_literal).cast("bigint").alias("len"),
    )
    spoilt = {
        "bounds": (2, "plan", beyond, quality.check_bounds),
        "literals": (3, "plan", F.col("plan").withField("parts", F.concat("plan.parts", F.array(literal))), quality.check_literals),
        "still": (5, "still", F.col("still").withField("length", F.col("motion.video.off") + 1), quality.check_still),
        "reads": (7, "stats", F.col("stats").withField("bytes_read", F.col("stats.asked") + 1), quality.check_reads),
    }
    found = None
    for rule, (every, column, fault, check) in spoilt.items():
        bad = rows.withColumn(column, F.when((doc % every == 0) & F.col(column).isNotNull(), fault).otherwise(F.col(column)))
        row = check(bad).select(F.col("file_id").alias("doc_id"), F.lit(rule).alias("rule")).distinct()
        found = row if found is None else found.unionByName(row)
    return found


@query(
    "scan_quality",
    "SELECT 'bounds' AS rule, 0 AS broken UNION ALL SELECT 'literals', 0 UNION ALL SELECT 'still', 0 UNION ALL SELECT 'reads', 0 UNION ALL SELECT 'plain stills', 0 UNION ALL SELECT 'kinds', 0",
)
def _(spark, sf):
    rows = cat.with_kind(cat.finish_catalog(scanned(spark, sf)))
    labels = rows.select(
        "file_id", F.when(F.col("shape") == "mp4", "video").when(F.col("shape").isin("jpeg", "png"), "still")
        .otherwise("motion").alias("expected_kind"),
    )
    checks = {
        "bounds": quality.check_bounds(rows), "literals": quality.check_literals(rows),
        "still": quality.check_still(rows), "reads": quality.check_reads(rows),
        "plain stills": quality.check_plain_stills(rows, labels), "kinds": quality.check_manifest(rows, labels),
    }
    out = None
    for rule, found in checks.items():
        row = found.agg(F.lit(rule).alias("rule"), F.count("*").alias("broken"))
        out = row if out is None else out.unionByName(row)
    return out


LABELS = ["doc_id", "kind", "container", "family", "method", "video_off", "video_len"]
LABELS_SQL = f"SELECT {', '.join(LABELS)} FROM ({ROUTE_SQL})"


@query("scan_narrow_windows", LABELS_SQL)
def _(spark, sf):
    """Small windows force the further passes; the routes must not change."""
    return routes(scanned(spark, sf, NARROW)).select(*LABELS)


@query(
    "scan_long_headers",
    f"""SELECT doc_id, 'motion' AS kind, 'xmp-directory' AS method, lang AS make, doc_id % 8 + 1 AS orientation, NULL::VARCHAR AS open_reason,
      doc_id % 21 * {synth.LEAD + synth.SEGMENT_HEAD} + strlen(source) + 429 + pk AS video_off, clip AS video_len, true AS read_within_size
    FROM (SELECT *, {PACKET_SQL} AS pk FROM (SELECT * EXCLUDE (shape), 'jpeg-directory' AS shape FROM base))""",
)
def _(spark, sf):
    """Packets far behind the first read: the header is followed segment by segment; only what the first reads
    saw may be read again."""
    files = cat.to_entries(synth.long_header_files(synth.document_rows(spark, sf)))
    return scan(files, limits=NARROW).select(
        F.col("list_ord").alias("doc_id"), "kind", "motion.method", "meta.make", "meta.orientation", "open_reason",
        F.col("motion.video.off").alias("video_off"), F.col("motion.video.len").alias("video_len"),
        (F.col("stats.bytes_read") <= F.col("size") + NARROW.head_bytes + NARROW.tail_bytes).alias("read_within_size"),
    )


@query("deep_scan", LABELS_SQL)
def _(spark, sf):
    """Rescan of the files that small windows left without a plan."""
    files = cat.to_entries(synth.media_files(synth.document_rows(spark, sf)).drop("file_id"))
    narrow = scanned(spark, sf, NARROW)
    return routes(deep_scan(narrow, F.col("plan").isNull(), files, content_reader)).select(*LABELS)


# -- streams ----------------------------------------------------------------------------------------


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the folder as a file stream, be it one file or a folder of files.

    Only a pattern is looked up as either; a plain path of a stream must be a folder.
    """
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def event_results(events: DataFrame) -> DataFrame:
    return events.withColumn("library_kind", F.col("event_type"))


@query("stream_summary", None)
def _(spark, sf):
    import uuid

    name = f"summary_{uuid.uuid4().hex}"
    counts = incremental.stream_summary(event_results(stream_of(spark, sf, "events")))
    run = (
        counts.writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", incremental.scratch(spark, "summary"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.table(name)


SQL["stream_summary"] = "SELECT event_type AS library_kind, count(*) AS n FROM events GROUP BY 1"


@query("stream_pairs", None)
def _(spark, sf):
    entries = cat.scannable(cat.to_entries(synth.library_files_from(stream_of(spark, sf, "documents"))))
    store = incremental.scratch(spark, "pairs")
    for run in incremental.stream_pairs(entries, store, incremental.scratch(spark, "pairs-state")):
        run.awaitTermination()
    return incremental.current_pairs(spark, store).select("file_id", "companion_id")


SQL["stream_pairs"] = f"WITH {PAIRED} SELECT file_id, companion_id FROM lib"


@query("stream_scan", ROUTE_SQL)
def _(spark, sf):
    docs = stream_of(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    files = cat.to_entries(synth.media_files(docs).drop("file_id"))
    store = incremental.scratch(spark, "results")
    incremental.stream_scan(files, store, scan, incremental.scratch(spark, "scan-state")).awaitTermination()
    return routes(incremental.stored(spark, store))


@query(
    "stream_progress",
    "SELECT 0 AS batch_id, count(*) AS done, sum(size)::BIGINT AS bytes, count(*) AS total_files, sum(size)::BIGINT AS total_bytes, 100.0::DOUBLE AS share FROM res",
)
def _(spark, sf):
    """Files land in the catalog without a scan; what counts here is the progress of the stream."""
    docs = stream_of(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    files = cat.to_entries(synth.media_files(docs).drop("file_id", "content"))
    done = incremental.scratch(spark, "progress")
    incremental.stream_scan(
        files, incremental.scratch(spark, "listed"), lambda rows: rows, incremental.scratch(spark, "progress-state"), done
    ).awaitTermination()
    whole = cat.to_entries(synth.media_files(synth.document_rows(spark, sf)).drop("file_id", "content"))
    total = whole.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return incremental.progress(spark, done, total).withColumn("batch_id", F.col("batch_id").cast("int"))
