"""Exact deduplication with a heavy-hitter split.

Every row becomes a narrow (doc_id, digest) row. A Misra-Gries summary (Spark's frequent-items sketch:
a bounded set of counters, decremented together when it overflows, merged task by task) names the digests
that may be frequent. Their counts and winners are then computed exactly; these few rows are broadcast, so
rows of frequent digests are settled where they are read and never meet in one task. The other digests are
bounded by the summary's error and take the ordinary shuffle, with map-side combine. Texts don't move.

Defined results: a null text counts as empty; empty texts are equal to each other. Among rows of equal text
the largest doc_id stays, a null doc_id being smaller than any. Of repeated rows (equal doc_id and text)
exactly one stays. An empty table gives no rows. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, whole_text, written

#: Frequent digests whose winners are broadcast, at most (48 bytes each).
HEAVY = 512
#: Counters of a summary.
COUNTERS = 8192
#: Summaries are merged by this many tasks before the last merge.
MERGERS = 64


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def frequent(rows: DataFrame, item: Column, most: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """At most ``most`` items, among them every one above the error of a Misra-Gries summary: ``item`` (long)."""
    parts = rows.select(item.alias("item"), F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("part"))
    parts = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(item, {counters})").alias("summary"))
    # grouped, for tasks without a summary must not take part in the merge
    merged = parts.groupBy(F.shiftright("part", 16)).agg(F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {most})")).alias("found"))
    return top.select("found.item")


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")
    )


def exact_groups(docs: DataFrame, most: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 and its ``route`` (broadcast or shuffle)."""
    rows = texts(docs).select(
        "doc_id", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")
    )
    rows = written(rows)
    named = frequent(rows, F.xxhash64("digest"), most, counters)
    hot = rows.join(F.broadcast(named), F.xxhash64(rows.digest) == named.item, "left_semi")
    winners = written(_winners(hot).filter("group_size > 1").limit(most))
    routed = rows.join(F.broadcast(winners), "digest", "left")
    settled = routed.filter("keep is not null").withColumn("route", F.lit("broadcast"))
    rest = routed.filter("keep is null").select("doc_id", "digest", "row")
    rest = rest.join(_winners(rest), "digest").withColumn("route", F.lit("shuffle"))
    return settled.unionByName(rest).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "route",
    )


def deduplicated(docs: DataFrame, most: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only groups of two and more are joined back, on (doc_id, digest); rows repeated as a whole are thinned
    to one of them.
    """
    groups = exact_groups(docs, most, counters)
    lost = groups.filter("not kept").select(F.col("doc_id").alias("_llm_lost_id"), F.col("text_sha256").alias("_llm_lost_sha"))
    kept_of = groups.filter("kept and group_size > 1")
    repeated = (
        lost.join(
            kept_of, lost._llm_lost_id.eqNullSafe(kept_of.doc_id) & (lost._llm_lost_sha == kept_of.text_sha256), "left_semi"
        ).distinct()
    )
    lost, repeated = written(lost.distinct()), written(repeated)
    rows = docs.withColumn("_llm_sha", F.sha2(whole_text(), 256))
    same = rows.doc_id.eqNullSafe(F.col("_llm_lost_id")) & (F.col("_llm_sha") == F.col("_llm_lost_sha"))
    alone = rows.join(lost, same, "left_anti").drop("_llm_sha")
    if repeated.isEmpty():
        return alone
    again = rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_llm_sha"]).drop("_llm_sha")
    return alone.unionByName(again)
