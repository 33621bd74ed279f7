"""Product codes of integer vectors, each part coded by a trie over the distinct parts.

A vector is cut into equal parts, and each part is replaced by the number of the nearest
entry of its position's codebook. Distinct parts in lexicographic order are a trie: parts
that agree in their first dimensions share a node there. A depth-first walk carries, for
each node, the squared distances to all entries accumulated over the dimensions so far,
so a common prefix is paid for once; a leaf takes the least of them, and its weight (how
many parts are that one) times its values goes into the entry's sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.tables import parts as shuffle_parts
from pagewatch.llm.vectors import finite, floor_means, lists, matrix, scaled
from pagewatch.session import write_through

DIMS, SCALE, PARTS, ENTRIES, ROUNDS = 64, 1024, 4, 256, 4
NODES = 1024


def walk(rows: np.ndarray, entries: np.ndarray, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each of the sorted, different ``rows``; ties go to the smaller entry.

    The walk takes a bundle of at most ``nodes`` sibling prefixes at a time and finishes what
    is below it before the next bundle, so at most ``nodes`` vectors of distances are held a
    dimension.
    """
    n, depth = rows.shape
    best, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not depth:
        return best, least
    # The dimension at which a row leaves the path of the row before it.
    leaves_at = np.append(0, (rows[1:] != rows[:-1]).argmax(1))
    columns = np.ascontiguousarray(entries.T)
    heads, root = np.zeros(1, np.int64), np.zeros((1, len(entries)), np.int64)
    # A bundle: the prefixes' first rows, the row after its last, their length less one, and the parents they extend.
    stack = list(_bundles(leaves_at, heads, n, 0, root, nodes))
    while stack:
        heads, end, at, held, parent = stack.pop()
        gap = rows[heads, at][:, None] - columns[at]
        held = held[parent] + gap * gap
        if at + 1 < depth:
            stack += _bundles(leaves_at, heads, end, at + 1, held, nodes)
        else:
            best[heads] = held.argmin(1)
            least[heads] = held[np.arange(len(heads)), best[heads]]
    return best, least


def _bundles(leaves_at: np.ndarray, heads: np.ndarray, end: int, at: int, held: np.ndarray, nodes: int) -> Iterator[tuple]:
    """The prefixes one dimension longer than those at ``heads``, in bundles, the first one last."""
    new = leaves_at[heads[0] : end] <= at
    new[0] = True
    below = heads[0] + np.nonzero(new)[0]
    parent = np.searchsorted(heads, below, side="right") - 1
    for first in range((len(below) - 1) // nodes * nodes, -1, -nodes):
        last = below[first + nodes] if first + nodes < len(below) else end
        yield below[first : first + nodes], last, at, held, parent[first : first + nodes]


def coded(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of any rows, by the trie over the different ones."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    different, back = np.unique(rows, axis=0, return_inverse=True)
    best, least = walk(different, entries)
    return best[back.ravel()], least[back.ravel()]


def first_entries(kept: DataFrame, entries: int, parts: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, a codebook per position; null ids come last, equal ids by components."""
    rows = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "whole").limit(entries).collect()
    vectors = np.array([r.whole for r in rows], np.int64)
    return np.split(vectors, parts, axis=1) if len(vectors) else []


def distinct_parts(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """(position, part, weight): the different parts in lexicographic order, cut by range over the tasks."""
    cut = [F.struct(F.lit(p).alias("position"), F.slice("whole", p * width + 1, width).alias("part")) for p in range(parts)]
    each = kept.select(F.explode(F.array(*cut)).alias("p")).groupBy("p.position", "p.part").agg(F.count("*").alias("weight"))
    each = each.select("position", "part", "weight").repartitionByRange(shuffle_parts(kept.sparkSession), "position", "part")
    return write_through(each.sortWithinPartitions("position", "part"), "trie-parts")


def compress(
    embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector.

    Vectors that are null or hold null or non-finite components are left out, and so are
    those of another length than ``dims``, as no codebook fits them. Equal vectors and repeated rows are coded alike,
    row by row. A null vec_id is kept and starts an entry only if there are too few others.
    With fewer vectors than ``entries`` there are as many entries as vectors; without any, no rows. Null
    labels are one label. Components of 2^27 and more after scaling are an error.

    Copies are one weighted part before anything is shuffled by part. A round reads the written
    parts, each task a run of the lexicographic order, and sums to a row per entry and batch; codebooks
    are ``entries`` vectors on the driver. The last assignment codes the vectors where they are read.
    """
    if dims % parts or not 1 <= entries <= 256:
        raise ValueError("parts must divide dims, and an entry's number must fit two hex digits")
    width = dims // parts
    good = F.when(F.size("embedding") == dims, finite(F.col("embedding"))).otherwise(False)
    kept = embeddings.filter(good).select("vec_id", "label", scaled(F.col("embedding"), scale).alias("whole"))
    kept = write_through(kept, "trie-vectors")
    books = first_entries(kept, entries, parts)
    if not books:
        long = F.lit(None).cast("long")
        return kept.select("vec_id", F.lit("").alias("code"), long.alias("error"), long.alias("label_error"), F.lit("").alias("codebooks_sha256"))
    shared = distinct_parts(kept, parts, width)

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                position = batch["position"].to_numpy()
                rows, weight = matrix(batch["part"], width), batch["weight"].to_numpy()
                for p in np.unique(position).tolist():
                    own, many = rows[position == p], weight[position == p]
                    best, _ = walk(own, books[p])
                    order = np.argsort(best, kind="stable")
                    entry, starts = np.unique(best[order], return_index=True)
                    total = np.add.reduceat((own * many[:, None])[order], starts, axis=0)
                    columns = [pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()), lists(total), pa.array(np.add.reduceat(many[order], starts))]
                    yield pa.record_batch(columns, ["position", "entry", "total", "n"])

        sorted_parts = shared.mapInArrow(sums, "position int, entry int, total array<long>, n long")
        books = [b.copy() for b in books]
        for position, entry, mean in floor_means(sorted_parts, ["position", "entry"], "total", "n"):
            books[position][entry] = mean

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [coded(rows, book) for rows, book in zip(np.split(matrix(batch["whole"], dims), parts, axis=1), books)]
            codes = np.column_stack([best for best, _ in found]).astype(np.uint8)
            text = codes.tobytes().hex()
            columns = [batch["vec_id"], batch["label"], pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)])]
            yield pa.record_batch([*columns, pa.array(sum(least for _, least in found))], ["vec_id", "label", "code", "error"])

    label = dict(kept.dtypes)["label"]
    done = write_through(kept.mapInArrow(code, f"vec_id long, label {label}, code string, error long"), "trie-codes")
    by_label = done.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    return done.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def oracle(dims: int = DIMS, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB: a row per part and dimension, every entry compared."""
    width, steps = dims // parts, []
    for n in range(rounds + 1):
        steps.append(f"""
d{n} as (
  select x.row, x.pos, c.entry, sum((x.v - c.v) * (x.v - c.v))::bigint as distance
  from x join c{n} c on x.pos = c.pos and x.dim = c.dim group by all),
a{n} as materialized (select row, pos, arg_min(entry, (distance, entry)) as entry, min(distance) as distance from d{n} group by row, pos)""")
        if n < rounds:
            steps.append(f"""
s{n} as (select pos, entry, dim, sum(v)::hugeint as s, count(*)::hugeint as n from x join a{n} using (row, pos) group by all),
c{n + 1} as materialized (
  select c.pos, c.entry, c.dim, coalesce((s - ((s % n) + n) % n) // n, c.v)::bigint as v
  from c{n} c left join s{n} using (pos, entry, dim))""")
    return f"""
with kept as materialized (
  select row_number() over () as row, vec_id, label, embedding from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
x as materialized (
  select row, (dim - 1) // {width} as pos, (dim - 1) % {width} as dim, floor({scale} * embedding[dim]::double)::bigint as v
  from kept, (select unnest(range(1, {dims + 1})) as dim)),
first as (select row, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {entries}),
c0 as materialized (select pos, entry, dim, v from x join first using (row)), {",".join(steps)},
coded as (
  select row, string_agg(printf('%02x', entry), '' order by pos) as code, sum(distance)::bigint as error
  from a{rounds} group by row),
digest as (select sha256(string_agg(v::varchar, ',' order by pos, entry, dim)) as codebooks_sha256 from c{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (row), digest"""
