"""Columns of embedding vectors shared by the operators on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number; true for an empty one."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def scaled(vector: Column, by: int) -> Column:
    """floor(by * component) of each component, as longs.

    Squared distances of longs below 2^27 fit a long up to 64 components; a larger
    component has no exact distance, so it is an error rather than a wrong number.
    """

    def whole(x: Column) -> Column:
        value = F.lit(float(by)) * x.cast("double")
        too_large = F.raise_error(F.concat(F.lit(f"a component times {by} must be below {LARGEST}: "), x.cast("string")))
        return F.when(F.abs(value) < LARGEST, F.floor(value)).otherwise(too_large.cast("long"))

    return F.transform(vector, whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of equal widths, none null, as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def floor_means(rows: DataFrame, keys: list[str], sums: str, count: str) -> list[tuple]:
    """(*keys, means) of every group: componentwise floor(sum / count), exact at any size.

    ``sums`` holds an array of partial sums a row, ``count`` how many vectors are in them.
    One row a group comes to the driver, so the groups must be bounded.
    """
    each = rows.select(*keys, F.posexplode(F.concat(F.array(count), sums)).alias("at", "part"))
    each = each.groupBy(*keys, "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    groups = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "total"))).alias("totals"))
    means = []
    for row in groups.collect():
        n, *totals = [int(t.total) for t in row.totals]
        means.append((*[row[k] for k in keys], [t // n for t in totals]))
    return means
