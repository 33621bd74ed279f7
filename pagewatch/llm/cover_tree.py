"""Near-duplicate vectors by dual traversal of cover trees, exact at the threshold.

Vectors of a label stand on the unit sphere, where a cosine is a distance. A cover tree
has nested levels: a node's centre is also its first child's, the children's radii are at
most half the node's, and their centres are further apart than that. Two trees are
searched together: a pair of nodes whose balls are too far apart is pruned, a pair whose
balls lie wholly within the threshold links everything below it, and only what is left is
opened, down to pairs of vectors, whose cosine is computed.

The vectors of a large label are dealt to cells around centres, and a cell to pieces of bounded
size. Each piece's tree is built once and written as one row. Pairs of cells, then of
pieces, are pruned by the same bound; each pair that is left is a row that some task
searches by itself.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.bk_dedup import roots_of
from pagewatch.llm.components import connected
from pagewatch.llm.vectors import finite
from pagewatch.session import write_through

COSINE = 0.98
PIECE = 1024
CENTRES = 2048
DRAWN = 4
SLACK = 1e-6  # far above the rounding of a distance: a bound never decides a pair that is close
PAIRS = 1 << 14


def scaled_down(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square overflows or vanishes; cosines stay the same to the last bit."""
    rows = rows.astype(np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    gap = rows - to
    return np.sqrt((gap * gap).sum(-1))


class CoverTree:
    """Nodes in arrays, children side by side; the points below node ``i`` are ``order[start[i]:end[i]]``."""

    ARRAYS = ("order", "start", "end", "centre", "radius", "first", "last")

    def __init__(self, points: np.ndarray, **arrays: np.ndarray):
        self.points = points
        if arrays:
            self.__dict__.update(arrays)
            return
        order = np.arange(len(points))
        start, end, centre, radius, first, last = [0], [len(points)], [0], [], [], []
        for node, (low, high) in enumerate(zip(start, end)):  # the lists grow on the way
            left = order[low:high].copy()
            far = distances(points[left], points[centre[node]])
            radius.append(far.max())
            first.append(len(start))
            while len(left) and radius[node] > SLACK:
                near = far <= radius[node] / 2
                held = left[near]
                order[low : low + len(held)] = held
                start.append(low), end.append(low + len(held))
                centre.append(centre[node] if len(start) == first[node] + 1 else held[0])
                low, left = low + len(held), left[~near]
                if len(left):
                    far = distances(points[left], points[left[0]])
            last.append(len(start))
        self.order, self.start, self.end, self.centre = order, np.array(start), np.array(end), np.array(centre)
        self.radius, self.first, self.last = np.array(radius), np.array(first), np.array(last)

    def below(self, node: int) -> np.ndarray:
        """A node's children, or the node itself where it is not divided."""
        return np.arange(self.first[node], self.last[node]) if self.last[node] > self.first[node] else np.array([node])


class Links:
    """Links between the points of one tree, or of two: how many each point has, and what hangs together.

    Points have places: those of the first tree in its order, then those of the second.
    """

    def __init__(self, a: CoverTree, b: CoverTree, rows_a: np.ndarray, rows_b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray, cosine: float):
        self.a, self.b, self.alone, self.cosine = a, b, a is b, cosine
        self.reach = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.shift = 0 if self.alone else len(a.order)
        self.rows = rows_a[a.order] if self.alone else np.vstack([rows_a[a.order], rows_b[b.order]])
        self.norms = np.sqrt((self.rows * self.rows).sum(1))
        self.copies = copies_a[a.order] if self.alone else np.append(copies_a[a.order], copies_b[b.order])
        self.sums = np.append(0, np.cumsum(self.copies))
        n = len(self.rows)
        self.steps, self.chain, self.own = (np.zeros(n + 1, np.int64) for _ in range(3))
        self.counts, self.pairs, self.close, self.waiting = np.zeros(n, np.int64), [], [], 0

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows that each place links with, copies counted; the least place that it hangs together with)."""
        stack = [(0, 0)]
        while stack:
            x, y = stack.pop()
            if self.alone and x == y:
                if 2 * self.a.radius[x] < self.reach - SLACK:
                    self._all_of(x)
                    continue
                kids = self.a.below(x)
                if len(kids) > 1:
                    stack += [(k, k) for k in kids.tolist() if self.a.end[k] - self.a.start[k] > 1]
                    stack += self._opened(kids, kids, True)
                else:
                    self._exactly(x, x)
                continue
            kids_x, kids_y = self.a.below(x), self.b.below(y)
            if self._bare(x, y):
                self._exactly(x, y)
            else:
                stack += self._opened(kids_x, kids_y)
        self._flush()
        self.counts += np.cumsum(self.steps)[:-1] - np.cumsum(self.own)[:-1] * self.copies
        follows = np.nonzero(np.cumsum(self.chain)[:-1] > 0)[0]
        return self.counts, roots_of(len(self.rows), [(follows, follows + 1), *self.pairs])

    def _bare(self, x: int, y: int) -> bool:
        return self.a.first[x] == self.a.last[x] and self.b.first[y] == self.b.last[y]

    def _opened(self, xs: np.ndarray, ys: np.ndarray, upper: bool = False) -> list[tuple[int, int]]:
        """Of the pairs of a node of ``xs`` and one of ``ys``, those that the bounds do not decide.

        With ``upper``, only pairs of a node and a later one. Pairs of single points go to the exact comparison.
        """
        out, step = [], max(1, 4 * PAIRS // len(ys))
        there = self.b.points[self.b.centre[ys]].T
        single_x, single_y = (t.end[n] - t.start[n] == 1 for t, n in ((self.a, xs), (self.b, ys)))
        for s in range(0, len(xs), step):
            x = xs[s : s + step]
            far = np.sqrt(np.maximum(2 - 2 * (self.a.points[self.a.centre[x]] @ there), 0))
            spread = self.a.radius[x][:, None] + self.b.radius[ys]
            near = far - spread <= self.reach + SLACK
            if upper:
                near &= np.arange(s, s + len(x))[:, None] < np.arange(len(ys))
            i, j = np.nonzero(near)
            single = single_x[s + i] & single_y[j]
            if single.any():
                self.close.append((self.a.start[x[i[single]]], self.b.start[ys[j[single]]] + self.shift))
                self.waiting += int(single.sum())
                if self.waiting >= PAIRS:
                    self._flush()
            i, j = i[~single], j[~single]
            inside = (far + spread)[i, j] < self.reach - SLACK
            for p, q in zip(x[i[inside]].tolist(), ys[j[inside]].tolist()):
                self._all(p, q)
            out += zip(x[i[~inside]].tolist(), ys[j[~inside]].tolist())
        return out

    def _range(self, tree: CoverTree, node: int, shift: int) -> tuple[int, int]:
        return int(tree.start[node]) + shift, int(tree.end[node]) + shift

    def _all(self, x: int, y: int) -> None:
        """Everything below ``x`` links with everything below ``y``."""
        (s, e), (t, f) = self._range(self.a, x, 0), self._range(self.b, y, self.shift)
        for (low, high), many in (((s, e), self.sums[f] - self.sums[t]), ((t, f), self.sums[e] - self.sums[s])):
            self.steps[low] += many
            self.steps[high] -= many
            self.chain[low] += 1
            self.chain[high - 1] -= 1
        self.pairs.append((np.array([s]), np.array([t])))

    def _all_of(self, x: int) -> None:
        """Everything below ``x`` links with all the rest below it."""
        s, e = self._range(self.a, x, 0)
        many = self.sums[e] - self.sums[s]
        self.steps[s] += many
        self.steps[e] -= many
        self.own[s] += 1
        self.own[e] -= 1
        self.chain[s] += 1
        self.chain[e - 1] -= 1

    def _exactly(self, x: int, y: int) -> None:
        (s, e), (t, f) = self._range(self.a, x, 0), self._range(self.b, y, self.shift)
        for low in range(s, e, max(1, PAIRS // (f - t))):
            at = np.arange(low, min(e, low + max(1, PAIRS // (f - t))))
            p, q = np.repeat(at, f - t), np.tile(np.arange(t, f), len(at))
            if x == y and self.alone:
                p, q = p[p < q], q[p < q]
            self.close.append((p, q))
            self.waiting += len(p)
            if self.waiting >= PAIRS:
                self._flush()

    def _flush(self) -> None:
        if not self.waiting:
            return
        p, q = (np.concatenate(c) for c in zip(*self.close))
        self.close, self.waiting = [], 0
        for s in range(0, len(p), PAIRS):
            i, j = p[s : s + PAIRS], q[s : s + PAIRS]
            linked = np.einsum("ij,ij->i", self.rows[i], self.rows[j]) / (self.norms[i] * self.norms[j]) >= self.cosine
            i, j = i[linked], j[linked]
            np.add.at(self.counts, i, self.copies[j])
            np.add.at(self.counts, j, self.copies[i])
            self.pairs.append((i, j))


def pack(rows: np.ndarray, keys: np.ndarray, copies: np.ndarray) -> tuple[bytes, np.ndarray, float]:
    """A tree over ``rows`` with their keys as bytes, its root's centre and radius."""
    points = unit(scaled_down(rows))
    tree, held = CoverTree(points), io.BytesIO()
    np.savez(held, rows=rows, keys=keys, copies=copies, **{name: getattr(tree, name) for name in CoverTree.ARRAYS})
    return held.getvalue(), points[0], float(tree.radius[0])


def unpack(packed: bytes) -> tuple[CoverTree, np.ndarray, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(packed)) as held:
        rows = scaled_down(held["rows"])
        return CoverTree(unit(rows), **{name: held[name] for name in CoverTree.ARRAYS}), rows, held["keys"], held["copies"]


def spread_out(points: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` of the points, each the furthest from those before it."""
    chosen, far = [0], distances(points, points[0])
    while len(chosen) < k and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1]]))
    return points[chosen]


def draw_centres(vectors: DataFrame, piece: int, centres: int) -> dict[tuple, tuple[int, np.ndarray]]:
    """(label, dims) -> (number of its first cell, centres) of the labels with more than ``piece`` vectors.

    There are at most about ``centres`` in all, so what goes to every task is bounded; they come from some
    ``DRAWN`` times as many vectors, drawn by hash. Any centres give the same links.
    """
    sizes = vectors.groupBy("label", "dims").count().filter(F.col("count") > piece)
    large = sizes.orderBy(F.desc("count"), "label", "dims").limit(centres // 2).collect()
    if not large:
        return {}
    each = max(piece, math.ceil(sum(r["count"] for r in large) / (centres // 2)))
    wanted = {(r.label, r.dims): math.ceil(r["count"] / each) for r in large}
    rows = [(r.label, r.dims, min(1.0, DRAWN * wanted[r.label, r.dims] / r["count"])) for r in large]
    kinds = dict(vectors.dtypes)
    shares = vectors.sparkSession.createDataFrame(rows, f"label {kinds['label']}, dims int, share double")
    luck = F.pmod(F.xxhash64("embedding", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    drawn = vectors.join(F.broadcast(shares), ["label", "dims"]).filter(luck < F.col("share")).orderBy("key").select("label", "dims", "embedding")
    seen: dict[tuple, list] = {}
    for r in drawn.collect():
        seen.setdefault((r.label, r.dims), []).append(r.embedding)
    out, first = {}, 0
    for group in sorted(seen, key=repr):
        chosen = spread_out(unit(scaled_down(np.array(seen[group], np.float64))), wanted[group])
        out[group] = (first, chosen)
        first += len(chosen)
    return out


def deal(vectors: DataFrame, centres: dict[tuple, tuple[int, np.ndarray]]) -> DataFrame:
    """``vectors`` with the cell of the nearest centre and the distance to it; cell -1 where the label has no centres."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(batch["label"].to_pylist(), batch["dims"].to_pylist())):
                if group in centres:
                    groups.setdefault(group, []).append(i)
            for group, at in groups.items():
                first, points = centres[group]
                rows = unit(scaled_down(batch["embedding"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)))
                cell[at] = first + (rows @ points.T).argmax(1)
                far[at] = distances(rows, points[cell[at] - first])
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    fields = ", ".join(f"{name} {kind}" for name, kind in vectors.dtypes)
    return vectors.mapInArrow(dealt, f"{fields}, cell int, far double")


def cell_pairs(dealt: DataFrame, centres: dict[tuple, tuple[int, np.ndarray]], reach: float) -> DataFrame:
    """(cell, other) of the cells of one label, ``cell <= other``, whose balls come within reach of each other."""
    radius = {r.cell: r.radius for r in dealt.filter("cell >= 0").groupBy("cell").agg(F.max("far").alias("radius")).collect()}
    found = [pd.DataFrame({"cell": [], "other": []}, dtype="int32")]
    for first, points in centres.values():
        ball = np.array([radius.get(first + i, -math.inf) for i in range(len(points))])
        for i, point in enumerate(points):
            near = i + np.nonzero(distances(points[i:], point) <= ball[i] + ball[i:] + reach + SLACK)[0]
            found.append(pd.DataFrame({"cell": np.int32(first + i), "other": (first + near).astype(np.int32)}))
    return dealt.sparkSession.createDataFrame(pd.concat(found), "cell int, other int")


def build_trees(dealt: DataFrame, piece: int) -> DataFrame:
    """A row per piece: what it is of, its tree as bytes, the root's centre and its radius."""
    of = ["label", "dims", "cell"]
    sizes = dealt.groupBy(*of).agg(F.ceil(F.count("*") / piece).cast("int").alias("cut"))
    cut = dealt.join(sizes, of).withColumn("piece", F.pmod(F.xxhash64("key"), "cut").cast("int"))
    kind, vector = dict(dealt.dtypes)["label"], np.float32 if dict(dealt.dtypes)["embedding"] == "array<float>" else np.float64

    def build(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1)
        matrix = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(vector).reshape(rows.num_rows, -1)
        tree, centre, radius = pack(matrix, rows["key"].to_numpy(), rows["copies"].to_numpy())
        columns = {name: first[name].combine_chunks() for name in [*of, "piece"]}
        return pa.table({**columns, "centre": pa.array([centre]), "radius": [radius], "tree": pa.array([tree], pa.binary())})

    cut = cut.select(*of, "piece", "key", "copies", "embedding")
    schema = f"label {kind}, dims int, cell int, piece int, centre array<double>, radius double, tree binary"
    return cut.groupBy(*of, "piece").applyInArrow(build, schema)


def apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def tree_links(vectors: DataFrame, cosine: float = COSINE, piece: int = PIECE, centres: int = CENTRES) -> DataFrame:
    """(key, n, root): rows that a vector links with in one pair of pieces, copies counted, and a key that it hangs together with.

    ``vectors`` holds different vectors (key, label, dims, embedding, copies). Summed by key, ``n`` is
    the number of links; the components of (key, root) are those of all links.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    drawn = draw_centres(vectors, piece, centres)
    dealt = write_through(deal(vectors, drawn), "cover-dealt")
    trees = write_through(build_trees(dealt, piece), "cover-trees")
    balls = trees.select("label", "dims", "cell", "piece", "centre", "radius")
    others = balls.select(*[F.col(c).alias(f"{c}_b") for c in balls.columns])
    same = (F.col("label") == F.col("label_b")) & (F.col("dims") == F.col("dims_b"))
    meets = F.broadcast(cell_pairs(dealt, drawn, reach)) if drawn else None
    small = balls.filter("cell < 0").join(others.filter("cell_b < 0"), same)
    pairs = small
    if drawn:
        pairs = balls.filter("cell >= 0").join(meets, "cell").join(others, F.col("other") == F.col("cell_b")).select(*balls.columns, *others.columns)
        pairs = pairs.unionByName(small)
    ordered = (F.col("cell") < F.col("cell_b")) | (F.col("piece") <= F.col("piece_b"))
    close = apart(F.col("centre"), F.col("centre_b")) <= F.col("radius") + F.col("radius_b") + (reach + SLACK)
    pairs = pairs.filter(ordered & close).select("label", "dims", "cell", "piece", "cell_b", "piece_b")
    left = trees.select("label", "dims", "cell", "piece", F.col("tree").alias("a"))
    right = trees.select("label", "dims", F.col("cell").alias("cell_b"), F.col("piece").alias("piece_b"), F.col("tree").alias("b"))
    # A piece meets itself with one copy of its tree.
    itself = (F.col("cell") == F.col("cell_b")) & (F.col("piece") == F.col("piece_b"))
    none = F.lit(None).cast("binary")
    work = left.select("a", none.alias("b")).unionByName(
        pairs.filter(~itself).join(left, ["label", "dims", "cell", "piece"]).join(right, ["label", "dims", "cell_b", "piece_b"]).select("a", "b")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch["a"], batch["b"]):
                a, rows_a, keys_a, copies_a = unpack(one.as_py())
                b, rows_b, keys_b, copies_b = unpack(two.as_py()) if two.is_valid else (a, rows_a, keys_a, copies_a)
                counts, roots = Links(a, b, rows_a, rows_b, copies_a, copies_b, cosine).search()
                keys = keys_a[a.order] if a is b else np.append(keys_a[a.order], keys_b[b.order])
                at = np.nonzero(counts)[0]
                yield pa.record_batch([pa.array(keys[at]), pa.array(counts[at]), pa.array(keys[roots[at]])], ["key", "n", "root"])

    return work.mapInArrow(search, "key long, n long, root long")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, piece: int = PIECE, centres: int = CENTRES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings``.

    Rows with equal labels link if the cosine of their vectors is at least ``cosine``, equal vectors
    included. Null labels, null, empty and zero vectors, vectors with null or non-finite
    components and vectors of different lengths link with nothing. Each repeated row is a row of its
    own. A null vec_id counts as no id for the smallest and is not kept; a component of
    nothing else has a null component_id. No rows give no rows.

    Equal vectors are one weighted vector before anything is compared; of a pair of pieces
    leave at most as many rows as vectors.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0")
    vector = F.col("embedding")
    usable = F.col("label").isNotNull() & finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = embeddings.select("vec_id", "label", "embedding", usable.alias("usable"))
    valid = rows.filter("usable")
    different = valid.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    different = different.select(F.monotonically_increasing_id().alias("key"), "label", F.size("embedding").alias("dims"), "embedding", "copies", "low")
    different = write_through(different, "cover-vectors")
    hits = write_through(tree_links(different.drop("low"), cosine, piece, centres), "cover-hits")
    counts = hits.groupBy("key").agg(F.sum("n").alias("n"))
    places = connected(hits.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), "root")
    known = different.select("key", "label", "embedding", "copies", "low").join(places, "key", "left").join(counts, "key", "left")
    known = known.withColumn("root", F.coalesce("root", "key"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "root").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = valid.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)


def oracle(cosine: float = COSINE) -> str:
    """The same in DuckDB: every pair of a label, components by recursion over links."""
    return f"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= {cosine}),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
lowest as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join lowest on vec_id = lowest.a left join counts on vec_id = counts.a"""
