"""Running values over long ordered groups without putting a whole group into one task.

Positions are cut into blocks of fixed length. A window runs inside each block, one small row per
block carries the state across, and an equi-join on (key, block) brings it back. A group of any size
therefore costs at most one block of rows per window, plus one row per block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: Column,
    out: str,
    fold: str = "sum",
    reverse: bool = False,
    inclusive: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``out``: the running ``sum`` or ``max`` of ``value`` in order of ``pos``.

    ``reverse`` runs from the highest position down. ``inclusive`` counts the row itself and rows
    at the same position; without it positions must be unique within a key.
    """
    combine = {"sum": F.sum, "max": F.max}[fold]
    rows = df.withColumn("_value", value).withColumn(
        "_block", F.floor(F.col(pos) / block).cast("bigint")
    )
    order = F.col(pos).desc() if reverse else F.col(pos).asc()
    block_order = F.col("_block").desc() if reverse else F.col("_block").asc()
    before = W.partitionBy(*keys).orderBy(block_order).rowsBetween(W.unboundedPreceding, -1)
    state = (
        rows.groupBy(*keys, "_block")
        .agg(combine("_value").alias("_total"))
        .withColumn("_carry", combine("_total").over(before))
        .select(*keys, "_block", "_carry")
    )
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    inside = (
        inside.rangeBetween(W.unboundedPreceding, W.currentRow)
        if inclusive
        else inside.rowsBetween(W.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_local", combine("_value").over(inside))
    on = reduce(
        lambda a, b: a & b,
        [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_block"]],
    )
    joined = rows.alias("l").join(state.alias("r"), on, "left").select("l.*", "r._carry")
    if fold == "sum":
        total = F.when(
            F.col("_carry").isNotNull() | F.col("_local").isNotNull(),
            F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0)),
        )
    else:
        total = F.greatest(F.col("_carry"), F.col("_local"))
    return joined.withColumn(out, total).drop("_value", "_block", "_local", "_carry")


def previous(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Add ``out``: ``value`` of the row before, in order of ``pos``; NULL on the first row."""
    last = F.struct(F.col(pos).alias("pos"), value.alias("value"))
    found = running(df, keys, pos, last, "_last", fold="max", inclusive=False, block=block)
    return found.withColumn(out, F.col("_last.value")).drop("_last")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_pos: Column,
    right_pos: Column,
    right_value: Column,
    out: str,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``out`` to ``left``: the greatest ``right_value`` among right rows at or before it.

    Both sides are laid on one line of positions and the running maximum is read off the left
    rows, so no pair of rows is ever compared. ``right_value`` is usually a struct that starts with
    the order in which the right rows win.
    """
    kept = [c for c in left.columns if c not in keys]
    points = right.select(
        *keys, right_pos.cast("bigint").alias("_pos"), right_value.alias("_point"),
        F.lit(None).alias("_row"),
    )
    rows = left.select(
        *keys, left_pos.cast("bigint").alias("_pos"), F.lit(None).alias("_point"),
        F.struct(*kept).alias("_row"),
    )
    line = points.unionByName(rows)
    found = running(line, keys, "_pos", F.col("_point"), out, fold="max", block=block)
    return found.filter(F.col("_row").isNotNull()).select(*keys, "_row.*", out)
