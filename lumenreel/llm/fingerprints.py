"""Document fingerprints: bottom-k sketches of word shingle hashes.

The sketch of a text holds the k smallest distinct hashes of its shingles (five words, lower case; fewer words
are one shingle). Sketches of parts merge to the sketch of the whole. Two sketches give the share of common
shingles (resemblance) and how much of one lies in the other (containment), one gives the number of distinct
shingles; all are exact while a text has at most k shingles. Only built-in expressions are used, each evaluated
once per row where the text is.

Defined results: a null text counts as empty; without words the sketch is empty. Two empty sketches resemble
each other fully, an empty and another not at all. Equal texts have equal sketches. The order of documents is
that of doc_id, a null doc_id first, equal ones by the digest of their text; rows repeated as a whole are one
document in that order, and each of them gets a row. The document after the last is the first; a single one
follows itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import texts, written

#: Hashes of a sketch, and words of a shingle.
K = 128
SIZE = 5
#: Stands for a null doc_id, before all others; a document of this id counts as one without.
NO_ID = -(2**63)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text: an ascending array of 64-bit hashes."""
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")

    def shingles(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - SIZE)
        rolled = F.transform(at, lambda i: F.xxhash64(*(w[i + j] for j in range(SIZE))))
        whole = F.xxhash64(w)
        return F.when(F.size(w) >= SIZE, rolled).when(F.size(w) > 0, F.array(whole)).otherwise(
            F.array().cast("array<bigint>")
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda w: _smallest(shingles(w), k))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return _smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity."""
    share = lambda m: F.size(F.array_intersect(F.array_intersect(m, a), b)) / F.size(m)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(_let(merged(a, b, k), share))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    largest = F.element_at(a, -1) / F.lit(2.0**64) + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; of an empty a, 1."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def text_of(a: Column) -> Column:
    """A sketch as text."""
    return F.array_join(a.cast("array<string>"), ",")


def successors(keys: DataFrame) -> DataFrame:
    """Per distinct (k, sha): the key after it, cyclically, as (next_k, next_sha).

    Keys are dealt out in ranges; a window looks ahead inside a range, and one row per range carries the first
    key of the next one back.
    """
    ranged = written(keys.repartitionByRange("k", "sha").withColumn("range", F.spark_partition_id()))
    ahead = F.lead(F.struct("k", "sha")).over(W.partitionBy("range").orderBy("k", "sha"))
    heads = ranged.groupBy("range").agg(F.min(F.struct("k", "sha")).alias("head"))
    order = W.orderBy("range")  # one row per range
    after = F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select("range", after.alias("after"))
    found = ranged.withColumn("ahead", ahead).join(heads, "range")
    found = found.withColumn("ahead", F.coalesce("ahead", "after"))
    return found.select(*keys.columns, F.col("ahead.k").alias("next_k"), F.col("ahead.sha").alias("next_sha"))


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited text and how like they and the next document's are.

    The edited text is the text with its last floor(n / 4) code points replaced by the first as many (or all) of
    the next document. A document takes part twice, for itself and for the one before it; only its first code
    points and its sketch move to that one.
    """
    # both uses of a text read the same three columns, so its one shuffle serves both
    rows = texts(docs).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.unhex(F.sha2("text", 256)).alias("sha"), "text"
    )
    keys = rows.select("k", "sha", F.length("text").cast("long").alias("n_chars")).distinct()
    after = written(successors(keys)).withColumn("part", F.floor(F.col("n_chars") / 4).cast("int"))
    wanted = after.select(
        F.col("next_k").alias("k"), F.col("next_sha").alias("sha"), F.col("k").alias("for_k"),
        F.col("sha").alias("for_sha"), "part", "n_chars",
    )
    heads = rows.join(wanted, ["k", "sha"]).select(
        F.col("for_k").alias("k"), F.col("for_sha").alias("sha"), "part", "n_chars",
        F.substring("text", F.lit(1), F.col("part")).alias("head"), sketch(F.col("text"), k).alias("next_sketch"),
    )
    heads = heads.groupBy("k", "sha").agg(*(F.first(c).alias(c) for c in ("part", "n_chars", "head", "next_sketch")))
    joined = rows.join(heads, ["k", "sha"])
    own = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("part")).cast("int"))
    found = joined.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "n_chars", "next_sketch", "text", F.concat(own, "head").alias("edited")
    ).select(
        "doc_id", "n_chars", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("own_sketch"), sketch(F.col("edited"), k).alias("edited_sketch"),
    )
    own, edited = F.col("own_sketch"), F.col("edited_sketch")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", text_of(own).alias("fingerprint"),
        text_of(edited).alias("edited_fingerprint"), resemblance(own, edited, k).alias("near_edited"),
        resemblance(own, F.col("next_sketch"), k).alias("near_next"),
        containment(own, edited, k).alias("kept_share"), distinct_shingles(own, k).alias("shingles"),
    )
