"""Streams of many batches against the same work done at once."""

import random
import shutil

from pyspark.sql import functions as F

from lumenreel.operators import catalog as cat
from lumenreel.operators import pairing
from lumenreel.streaming import incremental

FILES = "file_id string, list_ord long, name string, size long, family_ext string"


def batches(spark, folder, rows, schema, n):
    """A stream that brings ``rows`` in ``n`` batches."""
    source = f"{folder}/source"
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def test_pairs_after_many_batches(spark, tmp_path):
    pick = random.Random(4)
    rows = []
    for k in range(600):
        video = pick.random() < 0.3
        stem = "IMG_0001" if pick.random() < 0.34 else f"IMG_{pick.randrange(60)}"
        name = f"{stem}.{'mov' if video else 'jpg'}" if pick.random() < 0.9 else f"{stem.lower()}.HEIC"
        # later videos tend to be smaller, so companions change late
        rows.append((f"f{k}", k, name, 1000 - k + pick.randrange(50), "video" if name.endswith("mov") else "unknown"))
    rows += rows[:40]
    stream = batches(spark, tmp_path, rows, FILES, 12)
    for _ in range(2):  # the second start finds nothing new
        for run in incremental.stream_pairs(stream, f"{tmp_path}/pairs", f"{tmp_path}/state"):
            run.awaitTermination()
        got = incremental.current_pairs(spark, f"{tmp_path}/pairs")
        table = spark.createDataFrame(rows, FILES).dropDuplicates(["file_id"])
        want = pairing.pair_live(table).select("file_id", "companion_id", "companion_size")
        assert got.count() == 600 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(f"{tmp_path}/pairs/best").select("batch_id").distinct().count() == 12


def test_pairs_without_videos(spark, tmp_path):
    stream = batches(spark, tmp_path, [("a", 1, "x.jpg", 5, "unknown")], FILES, 1)
    for run in incremental.stream_pairs(stream, f"{tmp_path}/pairs", f"{tmp_path}/state"):
        run.awaitTermination()
    assert [tuple(r) for r in incremental.current_pairs(spark, f"{tmp_path}/pairs").collect()] == [("a", None, None)]


def test_scanned_once_without_reading_the_store(spark, tmp_path):
    schema = "file_id string, size long"
    rows = [(f"f{k % 70}", k % 70) for k in range(100)]
    scanned = []

    def process(batch):
        scanned.append(batch.count())
        return batch.withColumn("kind", F.lit("photo"))

    def run(stream):
        incremental.stream_scan(stream, f"{tmp_path}/store", process, f"{tmp_path}/state", f"{tmp_path}/done").awaitTermination()

    run(batches(spark, tmp_path, rows, schema, 4))
    assert sum(scanned) == 70 and len(scanned) >= 4
    total = spark.createDataFrame([(140, 2 * sum(range(70)))], "files long, bytes long")
    seen = incremental.progress(spark, f"{tmp_path}/done", total).orderBy("batch_id").collect()
    assert [r["done"] for r in seen][-1] == 70 and seen[-1]["share"] == 50.0
    assert all(a["done"] <= b["done"] and a["bytes"] <= b["bytes"] for a, b in zip(seen, seen[1:]))
    # what is stored isn't needed to know what was seen
    shutil.rmtree(tmp_path / "store")
    spark.createDataFrame([("f3", 3), ("new", 9)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    run(spark.readStream.schema(schema).parquet(f"{tmp_path}/source"))
    assert [r["file_id"] for r in incremental.stored(spark, f"{tmp_path}/store").collect()] == ["new"]
