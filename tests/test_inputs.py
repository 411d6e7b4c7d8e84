"""Tables in one file or many, and rows that lie in few of their pieces."""

import pytest
from pyspark.sql import functions as F

from lumenreel.functions.flow import repeat
from lumenreel.registry import QUERIES
from lumenreel.registry.scans import stream_of
from lumenreel.session import dealt
from lumenreel.structures import packets


def documents(spark, n):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 9).cast("int")).alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), (F.col("id") % 9 * 5).alias("n_chars"),
    )


def test_streams_of_a_folder_of_files(spark, tmp_path):
    documents(spark, 60).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["stream_pairs"](spark, f"{tmp_path}").count() == QUERIES["pair_live"](spark, f"{tmp_path}").count() > 0
    done = QUERIES["stream_progress"](spark, f"{tmp_path}").first()
    assert (done["done"], done["total_files"], done["share"]) == (60, 60, 100.0)


@pytest.mark.parametrize("folder", [False, True])
def test_stream_of_reads_file_and_folder(spark, tmp_path, folder):
    documents(spark, 10).coalesce(1).write.parquet(f"{tmp_path}/parts")
    if folder:
        documents(spark, 10).repartition(2).write.parquet(f"{tmp_path}/sf/documents.parquet")
    else:
        (tmp_path / "sf").mkdir()
        next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "sf" / "documents.parquet")
    run = (
        stream_of(spark, f"{tmp_path}/sf", "documents").writeStream.format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
    )
    run.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_rows_of_one_piece_are_dealt_out(spark, tmp_path):
    """Forty pieces by size, but all rows in the one that holds the middle of the row group."""
    documents(spark, 4000).coalesce(1).write.parquet(f"{tmp_path}/one")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = spark.read.parquet(f"{tmp_path}/one")
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = dealt(rows).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sizes.sum() == 4000 and len(sizes) >= 16 and sizes.max() <= 2 * 4000 / len(sizes)


def test_rounds_follow_what_there_is(spark):
    """A walk of 20,000 steps, more than fixed loops of 25 rounds in three levels had; and one of none."""
    walked = repeat(F.col("at"), lambda x: x < F.col("end"), lambda x: x + 1, F.col("end") - F.col("at"))
    rows = spark.createDataFrame([(0, 20_000), (5, 5), (None, 3)], "at bigint, end bigint").select(walked.alias("at"))
    assert [r["at"] for r in rows.collect()] == [20_000, 5, None]


def test_property_is_looked_for_behind_its_first_name(spark):
    """The same value as by the pattern over the whole text, and no search of what comes before the name."""
    odd = [
        'MotionPhoto="1"', 'MotionPhoto = 7 ', "aMotionPhoto=\"1\" x:MotionPhoto='2'", "é" * 50 + " c:MotionPhoto=\"3\"/>",
        "<c:MotionPhoto>4</c:MotionPhoto>", "MotionPhotoVersion=\"5\"", "MotionPhoto_Data", "p" * 999, "", None,
        "MotionPhotoX MotionPhoto=6", "=\"1\"MotionPhoto", "\nMotionPhoto\t=\r'8'", "<MotionPhoto> </MotionPhoto><MotionPhoto>9<",
    ]
    pattern = packets.EDGE + "MotionPhoto(" + packets.SPACE + "=" + packets.SPACE + packets.VALUE + r"|>[ \t\n\r]*[^<\s][^<]*(?=<))"
    whole = packets._unquote(F.regexp_replace(packets._first(F.col("text"), pattern), r"^(?:[ \t\n\r]*=[ \t\n\r]*|>)", ""))
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    got = rows.select("text", packets.property_text(F.col("text"), "MotionPhoto").alias("got"), whole.alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and sum(r["got"] is not None for r in got) >= 7
    long = spark.createDataFrame([(" c:x=1" * 10 + ' c:MotionPhoto="1"',)], "text string")
    plan = long.select(packets.property_text(F.col("text"), "MotionPhoto").alias("v"))._jdf.queryExecution().analyzed().toString()
    assert "locate(MotionPhoto" in plan


def test_packet_values_are_evaluated_once(spark):
    """Each property and each item value is looked for once, behind the first flag and only where its name occurs."""
    filler = b"p" * 50_000
    packet = (
        b'<x c:MotionPhoto="1" c:MotionPhotoVersion=\'2\' c:MotionPhotoPresentationTimestampUs="-3"><Container:Directory><li>'
        b'<Item Item:Mime="video/mp4" Length="7"><Item:Padding> 5 </Item:Padding></li></Container:Directory></x>'
    )
    rows = spark.createDataFrame([(bytearray(filler + packet + filler),), (bytearray(packet),), (bytearray(filler),), (None,)], "head binary")
    facts, items = packets.packet_facts(F.col("head")), packets.directory_items(F.col("head"))
    got = rows.select(facts.alias("f"), items.alias("d")).collect()
    for r in got[:2]:
        assert (r["f"]["motion_photo"], r["f"]["version"], r["f"]["motion_us"], r["f"]["micro_video"]) == (True, 2, -3, None)
        assert [(d["mime"], d["semantic"], d["length"], d["padding"]) for d in r["d"]] == [("video/mp4", None, 7, 5)]
    assert [r["f"]["motion_photo"] for r in got[2:]] == [None, None] and [r["d"] for r in got[2:]] == [[], []]
    plan = rows.select(facts.alias("f"), items.alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("locate(") == 6 and plan.count("regexp_extract_all(") <= 8, plan
