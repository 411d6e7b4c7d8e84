"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: White space that parts words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and the whole ``text``, so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, its lineage cut.

    The files of ``instead_of``, an earlier result that nothing needs any longer, are deleted.
    """
    return materialise(df, instead_of)
