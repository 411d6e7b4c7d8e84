"""Temperature mixing of sources to target weights under a token budget.

Source shares p are raised to an exponent a between 0 (all sources alike) and 1 (as found) and normalised to
weights. The exponent is found by bisection: entropy falls and the largest repetition falls too as a grows, so
the largest exponent that reaches the target entropy is taken, or a larger one if a source would otherwise be
repeated more often than allowed. Every pass evaluates a grid of exponents in one aggregation over the sources,
so a bracket shrinks by the grid's width in one job; only the grid's sums reach the driver.

A source's budget (weight times total budget) is met by whole epochs over its documents and a part of one more.
The documents of a source lie in blocks by a hash; a part of an epoch takes whole blocks in the order of a block
hash, then documents of the last block in the order of a document hash, as long as the budget isn't exceeded.
So it is a prefix of a permutation of blocks, described by one cut-off key per source. Running sums go over
ranges of block hashes, blocks of a range and documents of a block in turn: no window holds a whole source.

Defined results: a null source is a source of its own. Texts without words have no tokens; they are taken in
every whole epoch and in the part if they come before the cut. Rows of equal doc_id and source share their place:
all or none of them are taken. A source without tokens is kept once. If the budget asks for more than the
allowed repetition even at exponent 1, every source is repeated that often and the budget stays unmet. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, whole_text, written

#: Documents of a block, about; ranges of block hashes in a source.
BLOCK = 1024
RANGES = 4096
#: Grid points and passes of the bisection: the exponent is found to 1e-6.
GRID, PASSES = 33, 4
SEED = 20240501


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _unit(*parts) -> Column:
    """A hash of the parts between 0 and 1."""
    return (F.xxhash64(*parts) / F.lit(2.0**64)) + 0.5


def source_shares(rows: DataFrame) -> DataFrame:
    """Per source: tokens, documents and the number of its blocks."""
    return rows.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("n_docs")).withColumn(
        "n_blocks", F.ceil(F.col("n_docs") / BLOCK).cast("long")
    )


def _sums(sources: DataFrame, total: float, exponents: list[float]) -> list[tuple[float, float]]:
    """Of each exponent: the entropy of its weights and the largest ratio of a weight to its share."""
    grid = sources.filter("source_tokens > 0").select(
        (F.col("source_tokens") / F.lit(total)).alias("p"), F.posexplode(F.array(*map(F.lit, exponents))).alias("at", "a")
    )
    power = F.pow("p", "a")
    found = grid.groupBy("at").agg(
        F.sum(power).alias("z"), F.sum(power * F.log("p") * F.col("a")).alias("s"), F.max(power / F.col("p")).alias("most")
    )
    rows = {r["at"]: r for r in found.collect()}  # one row per grid point
    return [(math.log(r["z"]) - r["s"] / r["z"], r["most"] / r["z"]) for r in (rows[k] for k in range(len(exponents)))]


def _bisect(sources: DataFrame, total: float, reached: Callable[[float, float], bool]) -> float:
    """The smallest exponent from which on ``reached`` holds, 1 if none."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * k / (GRID - 1) for k in range(GRID)]
        found = [reached(*x) for x in _sums(sources, total, grid)]
        at = next((k for k, there in enumerate(found) if there), GRID - 1)
        if at == 0:
            return low
        low, high = grid[at - 1], grid[at]
    return high


def find_exponent(sources: DataFrame, budget: int, target_entropy: float, max_repeats: float) -> float:
    """The exponent, to six places.

    ``target_entropy`` is a share of the largest possible entropy, that of equal weights. Sources that are more
    even than that keep their shares.
    """
    first = sources.filter("source_tokens > 0").agg(F.sum("source_tokens").alias("t"), F.count("*").alias("n")).first()
    if not first["t"] or first["n"] < 2:
        return 1.0
    total, wanted = float(first["t"]), target_entropy * math.log(first["n"])
    even = _bisect(sources, total, lambda entropy, _: entropy <= wanted + 1e-12)
    rare = _bisect(sources, total, lambda _, ratio: budget / total * ratio <= max_repeats + 1e-12)
    return round(max(even, rare), 6)


def _block(doc_id: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), n_blocks)


def _block_key(source: Column, block: Column, seed: int) -> Column:
    """Place of a block in the order of its source's part of an epoch."""
    return _unit(F.lit(seed), source, block, F.lit("block"))


def _doc_key(doc_id: Column, seed: int) -> Column:
    """Place of a document in the order of its block."""
    return _unit(F.lit(seed), doc_id, F.lit("document"))


def _copies(block_key: Column, doc_key: Column, plan: str = "") -> Column:
    """How often a row with these keys is taken under its source's plan."""
    cut_block, cut_doc = F.col(f"{plan}cut_block"), F.col(f"{plan}cut_doc")
    in_part = (block_key < cut_block) | ((block_key == cut_block) & (doc_key <= cut_doc))
    return F.col(f"{plan}epochs") + F.coalesce(in_part, F.lit(False)).cast("int")


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    rows = rows.withColumn("block", _block(F.col("doc_id"), F.col("n_blocks"), seed))
    return rows.withColumn("block_key", _block_key(F.col("source"), F.col("block"), seed)).withColumn(
        "doc_key", _doc_key(F.col("doc_id"), seed)
    )


def plan(
    rows: DataFrame, budget: int | None, target_entropy: float, max_repeats: float, seed: int = SEED
) -> DataFrame:
    """Per source: weight, budget, whole epochs, and the cut-off key of the part of an epoch.

    ``rows`` has doc_id, source and tokens. Without ``budget`` it is the number of tokens there are.
    """
    sources = written(source_shares(rows))
    if budget is None:
        budget = int(sources.agg(F.sum("source_tokens")).first()[0] or 0)
    exponent, tokens = find_exponent(sources, budget, target_entropy, max_repeats), F.col("source_tokens")
    power = F.when(tokens > 0, F.pow(tokens.cast("double"), F.lit(exponent))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    sources = sources.withColumn("exponent", F.lit(exponent)).withColumn("weight", weight).withColumn(
        "source_budget",
        F.least(F.round(F.col("weight") * budget), F.floor(tokens * F.lit(float(max_repeats)))).cast("long"),
    )
    sources = sources.withColumn(
        "epochs", F.when(tokens > 0, F.floor(F.col("source_budget") / tokens)).otherwise(1).cast("int")
    ).withColumn("rest", F.when(tokens > 0, F.col("source_budget") - F.col("epochs") * tokens).otherwise(0))
    keyed = _keyed(
        rows.join(sources.filter("rest > 0").select(F.col("source").alias("_s"), "n_blocks", "rest"),
                  rows.source.eqNullSafe(F.col("_s"))).drop("_s"), seed,
    ).withColumn("part", F.floor(F.col("block_key") * RANGES).cast("int"))
    blocks = keyed.groupBy("source", "rest", "part", "block_key").agg(F.sum("tokens").alias("t"))
    parts = blocks.groupBy("source", "rest", "part").agg(F.sum("t").alias("t"))
    upto = lambda *by: W.partitionBy("source", *by).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("t").over(upto().orderBy("part")), F.lit(0))
    # the range, then the block, in which the budget ends
    parts = parts.withColumn("before", before).filter("before <= rest and before + t > rest")
    parts = parts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "before")
    inside = blocks.join(parts, blocks.source.eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).drop("_s", "_p")
    before = F.col("before") + F.coalesce(F.sum("t").over(upto().orderBy("block_key")), F.lit(0))
    last = inside.withColumn("before", before).filter("before <= rest and before + t > rest")
    last = last.select(F.col("source").alias("_s"), F.col("block_key").alias("_b"), "before")
    inside = keyed.join(last, keyed.source.eqNullSafe(F.col("_s")) & (F.col("block_key") == F.col("_b"))).drop("_s", "_b")
    peers = W.partitionBy("source").orderBy("doc_key").rangeBetween(W.unboundedPreceding, W.currentRow)
    taken = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(peers))
    cut = taken.groupBy("source").agg(
        F.first("block_key").alias("cut_block"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("doc_key"))), F.lit(-1.0)).alias("cut_doc"),
    ).select(F.col("source").alias("_s"), "cut_block", "cut_doc")
    return written(sources.join(cut, sources.source.eqNullSafe(F.col("_s")), "left").drop("_s"))


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(whole_text()).alias("tokens"),
    )


def mixed(
    docs: DataFrame, budget: int | None = None, target_entropy: float = 0.95, max_repeats: float = 2.0, seed: int = SEED
) -> DataFrame:
    """One row per document and epoch that takes it: doc_id, source, tokens, epoch, block, place, weight, exponent.

    Sorted by ``place`` (0 to 1), the rows of all sources are interleaved by their weights.
    """
    rows = written(narrow(docs))
    sources = plan(rows, budget, target_entropy, max_repeats, seed)
    columns = ["n_blocks", "exponent", "weight", "source_budget", "source_tokens", "epochs", "cut_block", "cut_doc"]
    joined = rows.join(sources.select(F.col("source").alias("_s"), *columns), rows.source.eqNullSafe(F.col("_s"))).drop("_s")
    taken = _keyed(joined, seed).withColumn("copies", _copies(F.col("block_key"), F.col("doc_key"))).filter("copies > 0")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    # each whole epoch has its own order of blocks and documents; the part keeps the one it was cut by
    own = F.when(
        F.col("epoch") < F.col("epochs"),
        _unit(F.lit(seed), "source", "block", "epoch") + _unit(F.lit(seed), "doc_id", "epoch") / F.col("n_blocks"),
    ).otherwise(F.col("block_key") + F.col("doc_key") / F.col("n_blocks"))
    whole = F.greatest(F.col("source_budget") / F.greatest(F.col("source_tokens"), F.lit(1)), F.lit(1.0))
    place = F.least((F.col("epoch") + own / 2) / whole, F.lit(1.0))
    return taken.select("doc_id", "source", "tokens", "epoch", "block", place.alias("place"), "weight", "exponent")


def mixed_documents(
    docs: DataFrame, budget: int | None = None, target_entropy: float = 0.95, max_repeats: float = 2.0, seed: int = SEED
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it.

    Texts don't move: a row's decision follows from its own hashes and its source's cut-off key.
    """
    rows = written(narrow(docs))
    columns = ["n_blocks", "epochs", "cut_block", "cut_doc"]
    sources = plan(rows, budget, target_entropy, max_repeats, seed).select(
        F.struct(*columns).alias("_llm_plan"), F.col("source").alias("_llm_source")
    )
    joined = docs.join(sources, docs["source"].cast("string").eqNullSafe(F.col("_llm_source")))
    doc_id = F.col("doc_id").cast("bigint")
    block = _block(doc_id, F.col("_llm_plan.n_blocks"), seed)
    copies = _copies(_block_key(F.col("_llm_source"), block, seed), _doc_key(doc_id, seed), "_llm_plan.")
    taken = joined.withColumn("_llm_copies", copies).filter("_llm_copies > 0")
    return taken.withColumn("_llm_copy", F.explode(F.sequence(F.lit(1), F.col("_llm_copies")))).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )
