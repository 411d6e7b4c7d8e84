"""Stored catalogs: hash buckets that are replaced one by one, and sorted rows that are read by the page.

Both are folders of Parquet with a small table beside them: which version of a bucket counts, or how many rows a
sorted part has. These tables have a row per bucket or part, and are all that the driver sees.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.catalog import PAGE, order_columns
from ..operators.merge import upsert

#: Buckets of a catalog. A rescan rewrites the buckets it touches.
BUCKETS = 256


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, folder: str, key: str, buckets: int) -> str:
    """The rows by bucket in a folder of their own; its name."""
    version = uuid.uuid4().hex
    by_bucket = rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    by_bucket.write.partitionBy("bucket").parquet(f"{folder}/rows/version={version}")
    return version


@dataclass(frozen=True)
class State:
    """Number of the last change, the catalog's layout, and the version of each bucket that has rows."""

    change: int
    buckets: int
    key: str
    schema: StructType
    versions: dict[int, str]


def _current(spark: SparkSession, folder: str) -> State:
    changes = spark.read.parquet(f"{folder}/changes")
    last = changes.agg(F.max("change")).first()[0]
    rows = changes.filter(F.col("change") == last).collect()
    layout = rows[0]
    return State(
        last, layout["buckets"], layout["key"], StructType.fromJson(json.loads(layout["columns"])),
        {r["bucket"]: r["version"] for r in rows if r["version"]},
    )


def _write_state(spark: SparkSession, folder: str, state: State) -> None:
    """Make the versions of ``state`` the ones that count, by one new file; until it is there the former ones do."""
    layout = (state.buckets, state.key, state.schema.json())
    rows = [(b, v, *layout) for b, v in state.versions.items()] or [(0, None, *layout)]
    table = spark.createDataFrame(rows, "bucket int, version string, buckets int, key string, columns string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/changes/change={state.change}")


def _found(rows: DataFrame) -> list[int]:
    return [r["bucket"] for r in rows.select("bucket").distinct().collect()]


def write_store(catalog: DataFrame, folder: str, key: str = "file_id", buckets: int = BUCKETS) -> None:
    """A new stored catalog."""
    spark = catalog.sparkSession
    version = _write_buckets(catalog, folder, key, buckets)
    there = spark.read.schema(f"{key} string, bucket int").parquet(f"{folder}/rows/version={version}")
    _write_state(spark, folder, State(0, buckets, key, catalog.schema, {b: version for b in _found(there)}))


def _read(spark: SparkSession, folder: str, state: State, buckets: list[int]) -> DataFrame:
    paths = [f"{folder}/rows/version={state.versions[b]}/bucket={b}" for b in sorted(buckets) if b in state.versions]
    return spark.read.schema(state.schema).parquet(*paths) if paths else spark.createDataFrame([], state.schema)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that count."""
    state = _current(spark, folder)
    return _read(spark, folder, state, [*state.versions])


def upsert_store(folder: str, rescanned: DataFrame) -> None:
    """Put rescanned rows in the place of those with the same key.

    Only buckets with such rows are read and written. Files of former versions stay until ``vacuum_store``, so who
    reads meanwhile, and a change that is broken off, see the former rows.
    """
    spark = rescanned.sparkSession
    state = _current(spark, folder)
    touched = _found(rescanned.select(_bucket(state.key, state.buckets).alias("bucket")))
    if not touched:
        return
    rows = upsert(_read(spark, folder, state, touched), rescanned, state.key)
    version = _write_buckets(rows, folder, state.key, state.buckets)
    versions = {**state.versions, **{b: version for b in touched}}
    _write_state(spark, folder, replace(state, change=state.change + 1, versions=versions))


def vacuum_store(spark: SparkSession, folder: str) -> int:
    """Delete the files of buckets that no longer count; how many folders went."""
    state = _current(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for entry in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "version=*/bucket=*")) or []:
        found = entry.getPath()
        version, bucket = found.getParent().getName().partition("=")[2], int(found.getName().partition("=")[2])
        if state.versions.get(bucket) != version:
            store.delete(found, True)
            gone += 1
    for change in range(state.change):
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes/change={change}"), True)
    return gone


def write_pages(catalog: DataFrame, folder: str, by: str = "name") -> None:
    """The catalog in one of its orders, for ``read_page`` (O6): sorted parts, and how many rows each has."""
    placed = catalog.orderBy(*order_columns(by)).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(2**33 - 1)}).drop("_id")
    placed.write.partitionBy("_part").parquet(f"{folder}/rows")
    counts = catalog.sparkSession.read.parquet(f"{folder}/rows").groupBy("_part").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.parquet(f"{folder}/counts")


def read_page(spark: SparkSession, folder: str, offset: int, size: int = PAGE) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of the order, in it; only the parts that hold them are read."""
    rows, start, wanted = spark.read.parquet(f"{folder}/rows"), 0, []
    for part in spark.read.parquet(f"{folder}/counts").orderBy("_part").collect():
        first, last = max(offset - start, 0), min(offset + size - start, part["n"])
        if first < last:
            wanted.append((F.col("_part") == part["_part"]) & (F.col("_at") >= first) & (F.col("_at") < last))
        start += part["n"]
    chosen = reduce(lambda a, b: a | b, wanted, F.lit(False))
    return rows.filter(chosen).orderBy("_part", "_at").drop("_part", "_at")
