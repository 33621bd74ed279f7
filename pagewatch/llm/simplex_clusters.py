"""Clusters of integer vectors, their centroids filtered by n-simplex projection.

A few pivots span a simplex. The distances of a vector to them, taken once and kept with
it, are turned into the coordinates of an apex over that simplex: those below the last
say where the vector stands along the pivots, the last how far it is above them. The
Euclidean distance of two apexes is never more than that of the vectors, and with the
last coordinate of one turned to the other side never less. A centroid whose lower bound is
above the least upper bound of all cannot be nearest; the others are compared exactly, in
integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.vectors import finite, floor_means, lists, matrix, scaled
from pagewatch.session import write_through

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
PIVOTS = 48
BATCH = 2048


@dataclass
class Simplex:
    """Pivots and the simplex they span, in the coordinates that its corners define."""

    pivots: np.ndarray

    def __post_init__(self):
        base = self.pivots[1:].astype(np.float64) - self.pivots[0]
        # A pivot that adds no direction of its own has a corner of height nought and is left out.
        kept, held = [], np.empty((0, base.shape[1]))
        for at, row in enumerate(base):
            height = row - held.T @ (held @ row)
            height -= held.T @ (held @ height)
            if (size := np.linalg.norm(height)) > 1e-6 * max(1.0, np.linalg.norm(row)):
                kept, held = [*kept, at], np.vstack([held, height / size])
        self.pivots = self.pivots[[0, *[k + 1 for k in kept]]]
        self.corners = base[kept] @ held.T
        self.sizes = (self.corners**2).sum(1)
        self.inverse = np.linalg.inv(self.corners) if kept else np.empty((0, 0))

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots; whole numbers, exact below 2^53."""
        rows, pivots = rows.astype(np.float64), self.pivots.astype(np.float64)
        return (rows**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * rows @ pivots.T

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """The apex of each row of squared distances to the pivots: from the pivots alone, never from the vector."""
        along = ((squared[:, :1] - squared[:, 1:] + self.sizes) / 2) @ self.inverse.T
        return np.column_stack([along, np.sqrt(np.maximum(squared[:, 0] - (along**2).sum(1), 0))])

    @staticmethod
    def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower and upper bounds of the distances of all of ``a`` to all of ``b``."""
        lower = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T
        return lower, lower + 4 * np.outer(a[:, -1], b[:, -1])


def nearest(rows: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance, exact comparisons made) a row; ties go to the smaller number."""
    lower, upper = simplex.bounds(apexes, simplex.apexes(simplex.distances(centroids)))
    # Rounding stays far below this share of the numbers that the bounds are made of.
    largest = (centroids.astype(np.float64) ** 2).sum(1).max() + (simplex.pivots.astype(np.float64) ** 2).sum(1).max()
    slack = 1e-6 * (1 + (apexes**2).sum(1) + largest)
    left = lower <= (upper.min(1) + slack)[:, None]
    at, of = np.nonzero(left)
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    for start in range(0, len(at), 8 * BATCH):
        a, c = at[start : start + 8 * BATCH], of[start : start + 8 * BATCH]
        exact[a, c] = ((rows[a] - centroids[c]) ** 2).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(len(rows)), best], left.sum(1)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def kept_vectors(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and the whole numbers of each vector with ``dims`` finite components."""
    good = F.when(F.size("embedding") == dims, finite(F.col("embedding"))).otherwise(False)
    return embeddings.filter(good).select("vec_id", scaled(F.col("embedding"), scale).alias("whole"))


def first_vectors(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest sha256; null ids last, equal ids by their components."""
    order = [F.col("vec_id").isNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "whole"]
    rows = kept.orderBy(*order).limit(k).collect()
    return np.array([r.whole for r in rows], np.int64)


def cluster(
    embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_compared of each kept vector.

    Vectors that are null, of another length, or hold null or non-finite components are
    left out. Equal vectors and repeated rows are assigned alike, row by row. A null vec_id
    is kept, and starts a centroid only if there are fewer others than centroids. With
    fewer vectors than ``k`` there are as many centroids as vectors; without any, no rows.
    ``n_compared`` counts the centroids that the bounds left for exact comparison in the last
    assignment. Components of 2^27 and more after scaling are an error.

    The vectors are written once with their apexes. A round reads them, sums map-side to a
    row per centroid and batch, and sends no vector through a shuffle; centroids and sums are
    ``k`` rows on the driver.
    """
    kept = write_through(kept_vectors(embeddings, dims, scale), "simplex-vectors")
    first = first_vectors(kept, max(k, pivots), seed)
    if not len(first):
        long = F.lit(None).cast("long")
        names = ("distance", "cluster_inertia", "inertia")
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[long.alias(n) for n in names], F.lit("").alias("centroid_sha256"), F.lit(0).alias("n_compared"))
    centroids, simplex = first[:k], Simplex(np.vstack([np.zeros(dims, np.int64), first[:pivots]]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(simplex.distances(matrix(batch["whole"], dims)))
            yield pa.record_batch([batch["vec_id"], batch["whole"], lists(apexes)], ["vec_id", "whole", "apex"])

    kept = write_through(kept.mapInArrow(project, "vec_id long, whole array<long>, apex array<double>"), "simplex-apexes")

    def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                rows = matrix(part["whole"], dims)
                yield part, rows, *nearest(rows, matrix(part["apex"], len(simplex.pivots)), centroids, simplex)

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            for _, rows, best, _, _ in assigned(batches, centroids):
                own = best == np.arange(len(centroids))[:, None]
                held = np.nonzero(own.any(1))[0]
                total = own[held].astype(np.float64) @ rows.astype(np.float64)  # whole numbers far below 2^53
                columns = [pa.array(held, pa.int32()), lists(total.astype(np.int64)), pa.array(own[held].sum(1))]
                yield pa.record_batch(columns, ["cluster", "total", "n"])

        parts = kept.select("whole", "apex").mapInArrow(sums, "cluster int, total array<long>, n long")
        centroids = centroids.copy()
        for number, mean in floor_means(parts, ["cluster"], "total", "n"):
            centroids[number] = mean

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, distance, compared in assigned(batches, centroids):
            columns = [part["vec_id"], pa.array(best, pa.int32()), pa.array(distance), pa.array(compared, pa.int32())]
            yield pa.record_batch(columns, ["vec_id", "cluster", "distance", "n_compared"])

    found = write_through(kept.mapInArrow(place, "vec_id long, cluster int, distance long, n_compared int"), "simplex-assigned")
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    inertia = {r.cluster: int(r.total) for r in totals.collect()}
    facts = F.array(*[F.struct(F.lit(inertia.get(i, 0)).cast("long").alias("own"), F.lit(digest(c)).alias("sha")) for i, c in enumerate(centroids)])
    of = F.element_at(facts, F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", of.own.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of.sha.alias("centroid_sha256"), "n_compared",
    )


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in DuckDB: a row per vector and component, every centroid compared."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
d{n} as (select x.row, c.number, sum((x.v - c.v) * (x.v - c.v))::bigint as distance from x join c{n} c using (dim) group by all),
a{n} as (select row, arg_min(number, (distance, number)) as number, min(distance) as distance from d{n} group by row)""")
        if n < rounds:
            steps.append(f"""
s{n} as (select number, dim, sum(v)::hugeint as s, count(*)::hugeint as n from x join a{n} using (row) group by all),
c{n + 1} as (select c.number, dim, coalesce((s - ((s % n) + n) % n) // n, c.v)::bigint as v from c{n} c left join s{n} using (number, dim))""")
    return f"""
with kept as (
  select row_number() over () as row, vec_id, embedding from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
x as (
  select row, dim, floor({scale} * embedding[dim]::double)::bigint as v
  from kept, (select unnest(range(1, {dims + 1})) as dim)),
first as (select row, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as number from kept qualify number < {k}),
c0 as (select number, dim, v from x join first using (row)), {",".join(steps)},
sha as (select number, sha256(string_agg(v::varchar, ',' order by dim)) as centroid_sha256 from c{rounds} group by number),
total as (select number, sum(distance)::bigint as cluster_inertia from a{rounds} group by number)
select vec_id, number::int as cluster, distance, cluster_inertia, (select sum(distance)::bigint from a{rounds}) as inertia, centroid_sha256
from a{rounds} join kept using (row) join total using (number) join sha using (number)"""
