"""Listings in waves, stored catalogs and pages."""

import shutil

import pytest
from pyspark.sql import functions as F

from lumenreel.sources import listing, store


def test_waves_list_every_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "BATCH", 100)
    root = tmp_path / "root"
    names = [f"flat/{k:04d}.jpg" for k in range(2500)] + [f"a/b{k % 7}/c/d{k}/x y%é.HEIC" for k in range(30)] + ["_u.jpg", ".h.jpg"]
    for k, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * (k % 50))
    (root / "empty" / "deeper").mkdir(parents=True)
    (root / "loop").symlink_to(root)
    rows = listing.list_files(spark, str(root) + "/").collect()
    assert sorted((r["path"], r["size"]) for r in rows) == sorted((f"root/{n}", k % 50) for k, n in enumerate(names))
    assert all(r["uri"] == f"{tmp_path}/{r['path']}" and r["mtime_ms"] > 10**12 for r in rows)
    assert listing.list_media(spark, str(root / "empty")).count() == 0


def test_lists_given_as_tables(spark):
    rows = [("n.jpg", None, 5, 1), (None, "p/q.HEIC", None, 1), ("", "p/r.mov", 3, None), (None, None, 1, 1), (None, "", 1, 1), (None, "dir/", 1, 1)]
    table = spark.createDataFrame(rows, "name string, path string, size long, mtime_ms long")
    got = {r["name"]: (r["path"], r["ext"], r["size"], r["mtime_ms"]) for r in listing.files_from_manifest(table).collect()}
    assert got == {"n.jpg": ("n.jpg", "jpg", 5, 1), "q.HEIC": ("p/q.HEIC", "heic", 0, 1), "r.mov": ("p/r.mov", "mov", 3, 0)}
    only = listing.files_from_manifest(table.select("path", "size", "mtime_ms").filter("path like 'p%'"))
    assert {r["name"] for r in only.collect()} == {"q.HEIC", "r.mov"}


@pytest.fixture
def catalog(spark):
    return spark.range(1000).select(F.concat(F.lit("f"), "id").alias("file_id"), F.lit("old").alias("state"), "id")


def files_of(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, catalog, tmp_path):
    folder = f"{tmp_path}/store"
    store.write_store(catalog, folder, buckets=16)
    before = files_of(tmp_path / "store" / "rows")
    changed = catalog.filter("id in (3, 4)").withColumn("state", F.lit("new")).unionByName(
        spark.createDataFrame([("added", "new", -1)], catalog.schema)
    )
    reading = store.read_store(spark, folder)
    store.upsert_store(folder, changed)
    after = files_of(tmp_path / "store" / "rows")
    assert before.items() <= after.items() and len(after) - len(before) <= 3
    assert reading.filter("state = 'new'").count() == 0  # who reads meanwhile sees the former rows
    rows = {r["file_id"]: r["state"] for r in store.read_store(spark, folder).collect()}
    assert len(rows) == 1001 and {k for k, v in rows.items() if v == "new"} == {"f3", "f4", "added"}
    assert store.vacuum_store(spark, folder) == len(after) - len(before)
    assert store.read_store(spark, folder).count() == 1001
    store.upsert_store(folder, changed.limit(0))
    store.upsert_store(folder, changed.withColumn("state", F.lit("newer")))
    assert store.read_store(spark, folder).filter("state = 'newer'").count() == 3


def test_a_broken_change_leaves_the_former_rows(spark, catalog, tmp_path, monkeypatch):
    folder = f"{tmp_path}/store"
    store.write_store(catalog, folder, buckets=4)
    monkeypatch.setattr(store, "_write_state", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.upsert_store(folder, catalog.withColumn("state", F.lit("new")))
    assert store.read_store(spark, folder).filter("state = 'old'").count() == 1000


def test_empty_store(spark, catalog, tmp_path):
    folder = f"{tmp_path}/store"
    store.write_store(catalog.limit(0), folder)
    store.upsert_store(folder, catalog.limit(5))
    assert store.read_store(spark, folder).count() == 5


@pytest.mark.parametrize("offset", [0, 115, 990, 2000])
def test_pages_read_their_parts_only(spark, tmp_path, offset):
    rows = spark.range(1000).select(
        F.concat(F.lit("f"), "id").alias("file_id"), (F.col("id") * 37 % 101).alias("size"), F.col("id").alias("list_ord"),
    ).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_pages(rows, f"{tmp_path}/pages", "size-desc")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [r["file_id"] for r in rows.orderBy(F.col("size").desc(), "list_ord").collect()][offset : offset + 120]
    there = spark.read.parquet(f"{tmp_path}/pages/rows").filter(F.col("file_id").isin(want)).select("_part").distinct()
    needed = {f"_part={r['_part']}" for r in there.collect()}
    every = list((tmp_path / "pages" / "rows").glob("_part=*"))
    assert len(needed) <= 2 and len(every) == 8
    for part in every:
        if part.name not in needed and len(needed) > 0:
            shutil.rmtree(part)
    assert [r["file_id"] for r in store.read_page(spark, f"{tmp_path}/pages", offset).collect()] == want
