"""Joins whose many-side may have a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
SALTS = 32


def frequent_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than one in ``share`` of all rows; there are fewer than ``share``."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * share > total).select(key)


def join_to_unique(
    many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join ``many`` to ``one`` (unique per key), spreading frequent keys over ``salts`` tasks.

    ``spread`` names a column of ``many`` that differs within a key. The list of frequent keys is
    shorter than ``HOT_SHARE`` whatever the data, so it is broadcast.
    """
    hot = F.broadcast(frequent_keys(many.filter(F.col(key).isNotNull()), key).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    left = many.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
