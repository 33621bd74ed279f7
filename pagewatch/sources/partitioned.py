"""Tables that are merged partition by partition.

A table is partitioned by natural columns and a bucket of its key, so the rows that a merge can
change lie in the partitions of the incoming keys. Only those are read, merged and
overwritten (dynamic partition overwrite); the files of all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.session import write_through
from pagewatch.sources.tables import merge_candidates, merge_elections, replace_partition

BUCKET = "key_bucket"
BUCKETS = 64
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """Write ``df`` under ``by`` and a bucket of ``keys``; a partition is written by few tasks.

    ``by`` must be columns that never change for a key, the natural partitions. Keys and buckets belong to the
    table: later merges must name the same.
    """
    parts = [*by, BUCKET]
    placed = df.withColumn(BUCKET, bucket_of(keys, buckets))
    placed = placed.repartition(*parts).sortWithinPartitions(*parts)
    placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def rewrite_touched(
    spark: SparkSession, path: str, new: DataFrame, merge: Merge, keys: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS
) -> int:
    """Merge ``new`` into the table at ``path``, partition-wise; the number of partitions rewritten.

    ``merge(existing, new)`` gives the full new content of the partitions it is handed. It must keep or
    replace rows by ``keys``, as each key lies in one partition. The list of touched partitions comes to the
    driver, at most one entry per partition of the table. The merged rows are written to the scratch
    folder first: a run that fails before the last step leaves the table as it was, and one that is repeated
    gives the same content.
    """
    stored = spark.read.parquet(path)
    parts = [*by, BUCKET]
    kinds = dict(stored.dtypes)
    incoming = new.withColumn(BUCKET, bucket_of(keys, buckets)).withColumns({c: F.col(c).cast(kinds[c]) for c in parts})
    incoming = write_through(incoming, "incoming")
    touched = incoming.select(*parts).distinct().collect()
    if not touched:
        return 0
    # literal conditions on the partition columns: the other partitions are not even listed as input
    here = F.lit(False)
    for row in touched:
        same = F.lit(True)
        for c in parts:
            same = same & F.col(c).eqNullSafe(F.lit(row[c]))
        here = here | same
    merged = merge(stored.filter(here).drop(BUCKET), incoming.drop(BUCKET))
    merged = write_through(merged.select(*[c for c in stored.columns if c != BUCKET]), "merged")
    write_partitioned(merged, path, keys, by, buckets, "overwrite")
    return len(touched)


def replace_groups(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS) -> int:
    """``replace_partition`` on a written table: the groups that ``new`` covers are deleted, then it is inserted."""
    return rewrite_touched(spark, path, new, lambda old, fresh: replace_partition(old, fresh, keys), keys, by, buckets)


def upsert_elections(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS) -> int:
    """``merge_elections`` on a table written under cycle and a bucket of (state, cycle, office)."""
    return rewrite_touched(spark, path, new, merge_elections, ["state", "cycle", "office"], ["cycle"], buckets)


def upsert_candidates(spark: SparkSession, path: str, entries: DataFrame, ts: Column, cycle: int, buckets: int = BUCKETS) -> int:
    """``merge_candidates`` on a table written under a bucket of candidate_id."""
    return rewrite_touched(spark, path, entries, lambda old, new: merge_candidates(old, new, ts, cycle), ["candidate_id"], (), buckets)
