"""Queries against their SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import table

SF = "/root/testdata/sf0.001"
FAST = [
    "entry_ext", "entry_pair_key", "pair_live", "mark_companions", "hide_companions", "companion_codec", "library_summary",
    "search_marker", "page_date_desc", "sort_name_rank", "neighbours", "read_share", "format_bytes",
    "badges", "problem_text", "describe", "display_dims", "parse_numbers", "brand_families", "sniff",
    "trailer_range", "packet_facts", "directory_items", "exif_tags", "heif_items", "movie_boxes",
    "tracks", "place_directory_items", "directory_video", "best_video_item", "primary_dims",
    "chunk_bytes", "media_spans", "codec_strings", "integers_from_bytes", "stream_summary", "stream_pairs",
    "stored_page", "stored_catalog", "manifest_intake", "stream_progress", "check_reads",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, SF)
    cursor = db.execute(oracle_sql()[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(
        cursor.fetchall(), [d[0] for d in cursor.description]
    )


def test_entry_and_registry(spark):
    assert entry(spark).count() == 1
    assert set(oracle_sql()) <= set(queries())
