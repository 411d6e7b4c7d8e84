"""Queries over structure tables: placement, chunks, extents, items, merges and results.

Their inputs are computed from the orders row by row; positions follow from the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth
from ..operators import items as item_ops
from ..operators import tables as sliced
from ..operators import merge, placement, quality
from ..operators.blocks import as_of
from ..session import dealt, tasks_for

QUERIES: dict = {}
SQL: dict[str, str] = {}

LINES = """lines AS (SELECT o_orderkey // 8 AS file_id, o_orderkey % 8 AS ord, CAST(floor(o_totalprice) AS BIGINT) % 50 + 1 AS q,
    o_custkey % 7 + 1 AS ln, o_custkey AS pk, CAST(floor(o_totalprice) AS BIGINT) % 97 AS sk FROM orders)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Eight ordered rows per file, computed from the order key alone."""
    price = F.floor("o_totalprice").cast("bigint")
    return synth.table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 8).alias("file_id"), (F.col("o_orderkey") % 8).alias("ord"),
        (price % 50 + 1).alias("q"), (F.col("o_custkey") % 7 + 1).alias("ln"),
        F.col("o_custkey").alias("pk"), (price % 97).alias("sk"),
    )


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# -- appended items (W1) ----------------------------------------------------------------------------

DIRECTORY = LINES + """,
d AS (SELECT *, CASE WHEN pk % 11 <> 0 THEN q END AS length, CASE WHEN pk % 11 <> 0 THEN ln END AS padding,
    CASE WHEN pk % 2 = 0 THEN 'video/mp4' ELSE 'image/jpeg' END AS mime,
    list_extract(['MotionPhoto','GainMap',NULL], CAST(sk % 3 + 1 AS INT)) AS semantic FROM lines),
s AS (SELECT *, coalesce(length, 0) + coalesce(padding, 0) AS stored, 100 + file_id % 200 AS size FROM d WHERE ord > 0),
p AS (SELECT *, size - sum(stored) OVER (PARTITION BY file_id ORDER BY ord DESC) AS start FROM s),
placed AS (SELECT *, bool_and(stored > 0 AND start >= 0) OVER (PARTITION BY file_id ORDER BY ord DESC) AS ok FROM p)"""


def placed_items(spark: SparkSession, sf: str) -> DataFrame:
    has = F.col("pk") % 11 != 0
    roles = F.array(F.lit("MotionPhoto"), F.lit("GainMap"), F.lit(None).cast("string"))
    rows = lines(spark, sf).withColumns(
        {
            "length": F.when(has, F.col("q")), "padding": F.when(has, F.col("ln")),
            "mime": F.when(F.col("pk") % 2 == 0, "video/mp4").otherwise("image/jpeg"),
            "semantic": F.element_at(roles, (F.col("sk") % 3 + 1).cast("int")),
        }
    )
    sizes = rows.select("file_id").distinct().withColumn("size", F.col("file_id") % 200 + 100)
    return placement.place_directory_items(rows, sizes, ["file_id"])


@query("place_directory_items", f"WITH {DIRECTORY} SELECT file_id, ord, CAST(start AS BIGINT) AS start, ok FROM placed")
def _(spark, sf):
    return placed_items(spark, sf).select("file_id", "ord", "start", "ok")


@query(
    "directory_video",
    f"""WITH {DIRECTORY} SELECT file_id, CAST(start AS BIGINT) AS off, coalesce(length, stored) AS len FROM placed
    WHERE ok AND mime = 'video/mp4' AND (semantic IS NULL OR semantic = 'MotionPhoto')
    QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ord DESC) = 1""",
)
def _(spark, sf):
    return placement.directory_video(placed_items(spark, sf), ["file_id"])


# -- extents and items ------------------------------------------------------------------------------

EXTENTS = LINES + """,
e AS (SELECT file_id, ln AS item_id, ord,
    1000 + 10 * ord + CASE WHEN pk % 9 = 0 THEN 1 ELSE 0 END AS off,
    10 AS len, sk % 17 = 0 AS in_idat FROM lines),
x AS (SELECT file_id, item_id, min_by(off, ord) AS start, CAST(sum(len) AS BIGINT) AS total_len, count(*) AS n, bool_or(in_idat) AS in_idat,
    bool_and(prev IS NULL OR prev = off) AS contiguous
    FROM (SELECT *, lag(off + len) OVER (PARTITION BY file_id, item_id ORDER BY ord) AS prev FROM e) GROUP BY ALL)"""


def extent_rows(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(
        "file_id", F.col("ln").alias("item_id"), "ord",
        (F.col("ord") * 10 + 1000 + F.when(F.col("pk") % 9 == 0, 1).otherwise(0)).alias("off"),
        F.lit(10).cast("bigint").alias("len"), (F.col("sk") % 17 == 0).alias("in_idat"),
    )


@query("extents_contiguous", f"WITH {EXTENTS} SELECT file_id, item_id, start, total_len, n, contiguous FROM x")
def _(spark, sf):
    return placement.extents_contiguous(extent_rows(spark, sf), ["file_id", "item_id"])


ITEMS = EXTENTS + """,
i AS (SELECT file_id, pk % 8 AS item_id, ord, list_extract(['mime','hvc1','avc1','grid'], CAST(sk % 4 + 1 AS INT)) AS item_type,
    CASE WHEN sk % 4 = 0 AND pk % 2 = 0 THEN 'video/mp4' ELSE '' END AS content_type FROM lines),
li AS (SELECT file_id, item_id, min(ord) AS first_ord, max_by(item_type, ord) AS item_type, max_by(content_type, ord) AS content_type FROM i GROUP BY ALL),
placed AS (SELECT file_id, item_id, first_ord, item_type, content_type, start, total_len, n, contiguous, in_idat FROM li FULL JOIN x USING (file_id, item_id)),
prim AS (SELECT file_id, min(pk % 8) AS primary_id FROM lines GROUP BY file_id),
r AS (SELECT file_id, list_extract(['cdsc','dimg','auxl','thmb'], CAST(q % 4 + 1 AS INT)) AS ref_type, pk % 8 AS from_id, sk % 8 AS to_id FROM lines),
des AS (SELECT DISTINCT r.file_id, to_id AS item_id FROM r JOIN prim ON r.file_id = prim.file_id AND r.from_id = prim.primary_id WHERE ref_type IN ('cdsc','auxl')),
cand AS (SELECT * FROM placed p WHERE (coalesce(content_type LIKE 'video/%', false) OR item_type = 'avc1') AND n > 0 AND NOT coalesce(in_idat, false)
  AND NOT EXISTS (SELECT 1 FROM r WHERE r.file_id = p.file_id AND r.to_id = p.item_id AND ref_type = 'dimg')
  AND NOT EXISTS (SELECT 1 FROM prim WHERE prim.file_id = p.file_id AND prim.primary_id = p.item_id))"""


def item_rows(spark: SparkSession, sf: str) -> DataFrame:
    types = F.array(*[F.lit(t) for t in ("mime", "hvc1", "avc1", "grid")])
    return lines(spark, sf).select(
        "file_id", (F.col("pk") % 8).alias("item_id"), "ord",
        F.element_at(types, (F.col("sk") % 4 + 1).cast("int")).alias("item_type"),
        F.when((F.col("sk") % 4 == 0) & (F.col("pk") % 2 == 0), "video/mp4").otherwise("").alias("content_type"),
    )


def ref_rows(spark: SparkSession, sf: str) -> DataFrame:
    types = F.array(*[F.lit(t) for t in ("cdsc", "dimg", "auxl", "thmb")])
    return lines(spark, sf).select(
        "file_id", F.element_at(types, (F.col("q") % 4 + 1).cast("int")).alias("ref_type"),
        (F.col("pk") % 8).alias("from_id"), (F.col("sk") % 8).alias("to_id"),
    )


def primaries(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("file_id").agg(F.min(F.col("pk") % 8).alias("primary_id"))


def placed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return item_ops.items_with_extents(item_rows(spark, sf), extent_rows(spark, sf))


@query("latest_items", f"WITH {ITEMS} SELECT file_id, item_id, first_ord, item_type, content_type FROM li")
def _(spark, sf):
    return item_ops.latest_items(item_rows(spark, sf))


@query("items_with_extents", f"WITH {ITEMS} SELECT file_id, item_id, item_type, content_type, start, total_len FROM placed")
def _(spark, sf):
    return placed_rows(spark, sf).select("file_id", "item_id", "item_type", "content_type", "start", "total_len")


@query("described_items", f"WITH {ITEMS} SELECT file_id, item_id FROM des")
def _(spark, sf):
    return item_ops.described_items(ref_rows(spark, sf), primaries(spark, sf))


@query("video_item_candidates", f"WITH {ITEMS} SELECT file_id, item_id FROM cand")
def _(spark, sf):
    return item_ops.video_item_candidates(
        placed_rows(spark, sf), ref_rows(spark, sf), primaries(spark, sf)
    ).select("file_id", "item_id")


@query(
    "best_video_item",
    f"""WITH {ITEMS} SELECT file_id, item_id, described, start, total_len, contiguous FROM (
      SELECT c.*, des.item_id IS NOT NULL AS described FROM cand c LEFT JOIN des ON c.file_id = des.file_id AND c.item_id = des.item_id)
      QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY described DESC, total_len DESC, first_ord) = 1""",
)
def _(spark, sf):
    return item_ops.best_video_item(placed_rows(spark, sf), ref_rows(spark, sf), primaries(spark, sf))


@query(
    "primary_dims",
    f"""WITH {LINES}, pr AS (SELECT file_id, min(pk % 8) AS item_id FROM lines GROUP BY file_id),
    props AS (SELECT file_id, ord + 1 AS prop_index, CASE WHEN sk % 3 = 0 THEN 'irot' ELSE 'ispe' END AS typ, CASE WHEN pk % 13 = 0 THEN 0 ELSE pk END AS w, q * 10 AS h FROM lines),
    sizes AS (SELECT * FROM props WHERE typ = 'ispe' AND w BETWEEN 1 AND 1000000 AND h BETWEEN 1 AND 1000000),
    last AS (SELECT l.file_id, max_by(ln, ord) AS prop_index FROM lines l JOIN pr ON l.file_id = pr.file_id AND l.pk % 8 = pr.item_id GROUP BY ALL),
    big AS (SELECT file_id, w, h FROM sizes QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY w * h DESC, prop_index DESC) = 1)
    SELECT big.file_id, coalesce(s.w, big.w) AS width, coalesce(s.h, big.h) AS height FROM big LEFT JOIN last ON big.file_id = last.file_id
    LEFT JOIN sizes s ON s.file_id = last.file_id AND s.prop_index = last.prop_index""",
)
def _(spark, sf):
    rows = lines(spark, sf)
    links = rows.select("file_id", (F.col("pk") % 8).alias("item_id"), "ord", F.col("ln").alias("prop_index"))
    props = rows.select(
        "file_id", (F.col("ord") + 1).alias("prop_index"),
        F.when(F.col("sk") % 3 == 0, "irot").otherwise("ispe").alias("typ"),
        F.when(F.col("pk") % 13 == 0, 0).otherwise(F.col("pk")).alias("width"), (F.col("q") * 10).alias("height"),
    )
    return item_ops.primary_dims(links, props, primaries(spark, sf))


# -- chunks (J7, J8, W2, A10, A15) ------------------------------------------------------------------
# Five long tracks; every order is a chunk, and every third one starts a run.

CHUNKS = """parts AS (SELECT o_orderkey % 5 AS file_id, o_orderkey // 5 AS ord, o_custkey AS pk, CAST(floor(o_totalprice) AS BIGINT) AS q FROM orders),
chunks AS (SELECT file_id, ord, ord * 1000 + pk % 7 AS off FROM parts),
runs AS (SELECT file_id, ord // 3 AS run_ord, ord + 1 AS first, pk % 4 AS per FROM parts WHERE ord % 3 = 0 AND ord > 0),
samples AS (SELECT file_id, ord AS idx, q AS bytes FROM parts),
per AS (SELECT c.file_id, c.ord, c.off, coalesce(r.per, 0) AS per FROM chunks c ASOF LEFT JOIN runs r ON c.file_id = r.file_id AND c.ord + 1 >= r.first),
firsts AS (SELECT *, CAST(coalesce(sum(per) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_sample FROM per),
totals AS (SELECT file_id, idx, sum(bytes) OVER (PARTITION BY file_id ORDER BY idx) AS run, max(idx) OVER (PARTITION BY file_id) AS top FROM samples),
sized AS (SELECT f.*, CAST(coalesce(b.run, 0) - coalesce(a.run, 0) AS BIGINT) AS bytes FROM firsts f
  LEFT JOIN (SELECT file_id, max(idx) AS top FROM samples GROUP BY file_id) t ON f.file_id = t.file_id
  LEFT JOIN totals a ON a.file_id = f.file_id AND a.idx = least(first_sample - 1, t.top)
  LEFT JOIN totals b ON b.file_id = f.file_id AND b.idx = least(first_sample + per - 1, t.top))"""


def chunk_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = synth.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 5).alias("file_id"), F.floor(F.col("o_orderkey") / 5).alias("ord"),
        F.col("o_custkey").alias("pk"), F.floor("o_totalprice").cast("bigint").alias("q"),
    )
    chunks = parts.select("file_id", "ord", (F.col("ord") * 1000 + F.col("pk") % 7).alias("off"))
    runs = parts.filter((F.col("ord") % 3 == 0) & (F.col("ord") > 0)).select(
        "file_id", F.floor(F.col("ord") / 3).alias("run_ord"), (F.col("ord") + 1).alias("first"),
        (F.col("pk") % 4).alias("per"),
    )
    return chunks, runs, parts.select("file_id", F.col("ord").alias("idx"), F.col("q").alias("bytes"))


def first_samples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks, runs, samples = chunk_tables(spark, sf)
    with_per = placement.chunk_samples_per(chunks, runs, ["file_id"])
    return placement.chunk_first_sample(with_per, ["file_id"]), samples


@query("chunk_samples_per", f"WITH {CHUNKS} SELECT file_id, ord, per FROM per")
def _(spark, sf):
    chunks, runs, _samples = chunk_tables(spark, sf)
    return placement.chunk_samples_per(chunks, runs, ["file_id"]).select("file_id", "ord", "per")


@query("chunk_first_sample", f"WITH {CHUNKS} SELECT file_id, ord, first_sample FROM firsts")
def _(spark, sf):
    return first_samples(spark, sf)[0].select("file_id", "ord", "first_sample")


@query("chunk_bytes", f"WITH {CHUNKS} SELECT file_id, ord, bytes FROM sized")
def _(spark, sf):
    return placement.chunk_bytes(*first_samples(spark, sf), ["file_id"]).select("file_id", "ord", "bytes")


@query(
    "media_spans",
    f"""WITH {CHUNKS} SELECT file_id, min_by(off, ord) AS span_off, max_by(off + bytes, ord) - min_by(off, ord) AS span_len,
      bool_and(off >= 3 AND off + bytes <= 100000000) AS within FROM sized GROUP BY file_id""",
)
def _(spark, sf):
    spans = placement.media_spans(placement.chunk_bytes(*first_samples(spark, sf), ["file_id"]), ["file_id"])
    within = placement.chunks_within(F.lit(3), F.lit(100000000 - 3))
    return spans.select("file_id", "span_off", "span_len", within.alias("within"))


@query(
    "as_of_orders",
    """SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey % 50 AS k, o_orderkey FROM orders) o
      ON e.user_id % 50 = o.k AND e.event_id >= o.o_orderkey""",
)
def _(spark, sf):
    events = synth.table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("k"))
    orders = synth.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k"), "o_orderkey")
    found = as_of(
        events, orders, ["k"], F.col("event_id"), F.col("o_orderkey"),
        F.struct(F.col("o_orderkey").alias("o_orderkey")), "o",
    )
    return found.select("event_id", "o.o_orderkey")


@query(
    "plan_spans",
    f"""WITH {LINES} SELECT file_id, min(off) AS span_off, max(off + len) - min(off) AS span_len, CAST(coalesce(sum(len) FILTER (WHERE off IS NOT NULL), 0) AS BIGINT) AS slice_bytes,
      CAST(coalesce(sum(len) FILTER (WHERE off IS NULL), 0) AS BIGINT) AS literal_bytes FROM (SELECT file_id, CASE WHEN pk % 3 <> 0 THEN pk END AS off, q AS len FROM lines) GROUP BY file_id""",
)
def _(spark, sf):
    parts = lines(spark, sf).select(
        "file_id", F.when(F.col("pk") % 3 != 0, "slice").otherwise("lit").alias("t"),
        F.when(F.col("pk") % 3 != 0, F.col("pk")).alias("off"), F.col("q").alias("len"),
    )
    return placement.plan_spans(parts, ["file_id"])


# -- merges and expectations ------------------------------------------------------------------------


@query(
    "upsert",
    "SELECT o_orderkey AS file_id, CASE WHEN l.k IS NOT NULL THEN 'rescanned' ELSE o_orderstatus END AS state FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40) l ON k = o_orderkey",
)
def _(spark, sf):
    catalog = synth.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderstatus").alias("state"))
    again = synth.table(spark, sf, "lineitem").filter(F.col("l_quantity") > 40).select(
        F.col("l_orderkey").alias("file_id"), F.lit("rescanned").alias("state")
    ).distinct().join(catalog.select("file_id"), "file_id", "left_semi")
    return merge.upsert(catalog, again)


@query(
    "check_expected",
    """SELECT o_orderkey AS name, v.q IS NOT DISTINCT FROM CASE WHEN o_custkey % 2 = 0 THEN v.q ELSE 7 END AS matches
      FROM orders LEFT JOIN (SELECT l_orderkey, min(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) v ON o_orderkey = v.l_orderkey""",
)
def _(spark, sf):
    low = synth.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(
        F.min(F.col("l_quantity").cast("bigint")).alias("q")
    )
    catalog = low.select(
        "name", F.struct(F.struct(F.col("q").alias("off"), F.col("q").alias("len")).alias("video")).alias("motion")
    )
    orders = synth.table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), "o_custkey").join(low, "name", "left")
    claim = F.when(F.col("o_custkey") % 2 == 0, F.col("q")).otherwise(7)
    expected = orders.select("name", claim.alias("video_off"), claim.alias("video_len"))
    return quality.check_expected(catalog, expected, key="name").select("name", "matches")


@query(
    "sliced_chunk_bytes",
    """SELECT doc_id, (i - 1) // (doc_id % 7 + 1) AS ord, sum(('0x' || v)::BIGINT)::BIGINT AS bytes
      FROM (SELECT doc_id, unnest(cells) AS v, generate_subscripts(cells, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(hex(text), '[0-9A-F]{8}') AS cells FROM documents)) GROUP BY ALL""",
)
def _(spark, sf):
    """Texts as tables of 4-byte cells, read and summed in slices of 512 cells; chunks have 1 to 7 cells."""
    docs = synth.document_rows(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    found = docs.select(
        "doc_id", "content", F.lit(0).cast("bigint").alias("at"), F.floor(F.length("content") / 4).alias("count"), F.lit(4).alias("width")
    )
    keys, cells, per = ["doc_id"], 512, F.col("doc_id") % 7 + 1
    parts = 4 * tasks_for(synth.table(spark, sf, "documents"))  # a text has about 15 times its size in rows
    summed = sliced.with_sums(sliced.read_slices(sliced.table_slices(found, keys, cells), keys), keys, parts)
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / per)))
    # chunks need no text, only how many cells it has
    counts = synth.table(spark, sf, "documents").select("doc_id", F.floor(F.length(F.encode("text", "UTF-8")) / 4).alias("count"))
    chunks = dealt(counts).filter("count > 0").select("doc_id", per.alias("per"), number.alias("ord"))
    chunks = chunks.withColumn("first_sample", F.col("ord") * F.col("per"))
    return sliced.sliced_chunk_bytes(chunks, summed, keys, cells, parts).select("doc_id", "ord", "bytes")
