"""Small helpers shared by the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, and a word.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


KEY = ["_key_a", "_key_b"]


def row_key(df: DataFrame) -> dict[str, Column]:
    """A 128-bit key of each row by all its columns: rows with the same key are the same in every column."""
    every = [c for name in df.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    return {name: F.xxhash64(F.lit(n), *every) for n, name in enumerate(KEY)}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
