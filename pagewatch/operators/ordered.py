"""Ordered per-key computations that stay parallel inside one hot key.

A plain running window sends a whole key to one task. Here the order column
(a dense increasing id) is cut into blocks of at most ``BLOCK_ROWS`` ids, so no
(key, block) holds more rows than that; a key's blocks run in parallel, and
only one summary row per (key, block) is shuffled by the key alone to carry
state from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.session import write_through

BLOCK_ROWS = 1_000_000


def block_of(order: Column, rows: int = BLOCK_ROWS) -> Column:
    """First id of the block an id belongs to."""
    return order - F.pmod(order, F.lit(rows))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, first in ``order``.

    Spark turns the rank filter into a per-partition group limit ahead of the
    shuffle, so a hot key sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank", salts: int = 64
) -> DataFrame:
    """The first ``k`` rows per key, with their 1-based rank.

    Spark limits each map partition ahead of the shuffle only for small ``k``.
    Beyond that, rows are first cut to ``k`` per (key, salt), so a hot key
    reaches the final ranking with at most ``k * salts`` rows. End ``order``
    with a unique column.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > limit:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))  # any spread gives the same rows
        spread = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_cut", F.row_number().over(spread))
        df = df.filter(F.col("_cut") <= k).drop("_salt", "_cut")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def history_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    prev: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add values of the rows of the same key that precede each row.

    ``order`` lists integer columns; blocks are cut on the first. ``prev``
    gives the directly preceding row's value, ``last`` the last non-null value
    before the row. ``prev`` values must not be NULL.
    """
    prev, last = prev or {}, last or {}
    place = F.struct(*order)
    values = {f"_v_{n}": c for n, c in {**prev, **last}.items()}
    src = df.withColumns({"_block": block_of(F.col(order[0]), block_rows), **values})
    in_block = Window.partitionBy(*keys, "_block").orderBy(*order)
    above = in_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    tails = src.groupBy(*keys, "_block").agg(
        *[F.max_by(f"_v_{n}", place).alias(f"_c_{n}") for n in prev],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_c_{n}") for n in last],
    )
    carried = tails.select(
        *keys,
        "_block",
        *[F.lag(f"_c_{n}").over(blocks).alias(f"_c_{n}") for n in prev],
        *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last],
    ).filter(_any_set(prev, last))
    inside = src.withColumns(
        {
            **{f"_i_{n}": F.lag(f"_v_{n}").over(in_block) for n in prev},
            **{f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(above) for n in last},
        }
    )
    names = [*prev, *last]
    return (
        inside.join(carried, [*keys, "_block"], "left")
        .withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in names})
        .drop("_block", *[f"_{x}_{n}" for x in "vic" for n in names])
    )


def _any_set(*groups: dict[str, Column]) -> Column:
    cond = F.lit(False)
    for group in groups:
        for name in group:
            cond = cond | F.col(f"_c_{name}").isNotNull()
    return cond


def running_streak(
    df: DataFrame, key: str, order: str, counts: Column, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the number of consecutive rows, ending here, for which ``counts`` holds."""
    src = df.withColumn("_block", block_of(F.col(order), block_rows)).withColumn("_hit", counts.cast("int"))
    upto = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        src.withColumn("_hits", F.sum("_hit").over(upto))
        .withColumn("_reset", F.max(F.when(F.col("_hit") == 0, F.col("_hits"))).over(upto))
        .withColumn("_open", F.col("_hits") - F.coalesce("_reset", F.lit(0)))
    )
    blocks = Window.partitionBy(key).orderBy("_block")
    running = blocks.rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        inside.groupBy(key, "_block")
        .agg(F.sum("_hit").alias("_n"), F.max_by("_open", order).alias("_tail"), F.min("_hit").alias("_all"))
        .withColumn("_total", F.sum("_n").over(running))
        .withColumn("_base", F.last(F.when(F.col("_all") == 0, F.col("_total") - F.col("_tail")), True).over(running))
        .withColumn("_end", F.col("_total") - F.coalesce("_base", F.lit(0)))
        .withColumn("_carry", F.lag("_end").over(blocks))
        .filter("_carry > 0")
        .select(key, "_block", "_carry")
    )
    streak = F.col("_open") + F.when(F.col("_reset").isNull(), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return (
        inside.join(carried, [key, "_block"], "left")
        .withColumn(name, F.when(F.col("_hit") == 1, streak).otherwise(0))
        .drop("_block", "_hit", "_hits", "_reset", "_open", "_carry")
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Total rank 1..n without sending the table to one task.

    Rows are range-partitioned on the sort key and written once; each part is
    numbered on its own and shifted by the sizes of the parts before it. The
    shift table has one row per part. End ``order`` with a unique column.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = write_through(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "rank")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        stored.groupBy("_part")
        .count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        stored.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_rn") + F.col("_shift"))
        .drop("_rn", "_shift", "_part")
    )
