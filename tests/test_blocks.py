"""Block-wise running values against brute force, with blocks far smaller than the groups."""

import random

from pyspark.sql import functions as F

from lumenreel.operators.blocks import as_of, previous, running
from lumenreel.operators.skew import frequent_keys, join_to_unique

random.seed(7)
ROWS = [(k, i, random.randint(0, 9)) for k, n in (("hot", 100), ("b", 7), ("c", 1)) for i in range(n)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k string, i bigint, v bigint")


def test_running_sums_in_both_directions(spark):
    rows = running(frame(spark), ["k"], "i", F.col("v"), "fwd", block=3)
    rows = running(rows, ["k"], "i", F.col("v"), "back", reverse=True, block=3)
    rows = running(rows, ["k"], "i", F.col("v"), "before", inclusive=False, block=3)
    for r in rows.collect():
        same = [(i, v) for k, i, v in ROWS if k == r["k"]]
        assert r["fwd"] == sum(v for i, v in same if i <= r["i"])
        assert r["back"] == sum(v for i, v in same if i >= r["i"])
        assert (r["before"] or 0) == sum(v for i, v in same if i < r["i"])


def test_previous_value(spark):
    for r in previous(frame(spark), ["k"], "i", F.col("v"), "p", block=3).collect():
        expected = [v for k, i, v in ROWS if k == r["k"] and i == r["i"] - 1]
        assert r["p"] == (expected[0] if expected else None)


def test_as_of_takes_the_last_run_at_or_before(spark):
    runs = [("hot", r, first, first * 10) for r, first in enumerate([0, 5, 5, 40, 20])]
    right = spark.createDataFrame(runs, "k string, rank bigint, first bigint, per bigint")
    found = as_of(
        frame(spark), right, ["k"], F.col("i"), F.col("first"),
        F.struct("rank", "per"), "run", block=4,
    )
    for r in found.collect():
        usable = [x for x in runs if x[0] == r["k"] and x[2] <= r["i"]]
        assert (r["run"]["per"] if r["run"] else None) == (max(usable, key=lambda x: x[1])[3] if usable else None)


def test_join_with_a_hot_key_keeps_every_row(spark):
    one = spark.createDataFrame([("hot", 1), ("c", 3)], "k string, x bigint")
    got = join_to_unique(frame(spark), one, "k", "i")
    assert got.count() == len(ROWS)
    assert {(r["k"], r["x"]) for r in got.select("k", "x").distinct().collect()} == {("hot", 1), ("b", None), ("c", 3)}
    assert frequent_keys(frame(spark), "k", share=2).collect()[0]["k"] == "hot"
