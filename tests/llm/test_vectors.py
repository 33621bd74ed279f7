"""Clusters, codes and near-duplicates of vectors against plain code."""

import hashlib
import math
import random

import numpy as np
import pytest

from pagewatch.llm import cover_tree, simplex_clusters, trie_codes
from tests.llm.cases import compared
from tests.llm.frames import INF, NAN, embeddings

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_simplex_clusters", "op12_trie_codes", "op13_cover_tree"])
def test_query(spark, name):
    ok, message = compared(spark, FOLDER, name)
    assert ok, message


def vectors(n, dims, seed=3, labels=3):
    """Vectors in clusters of near copies, with exact copies, parallel ones, ties, and rows that cannot be used."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        near = rows[rng.integers(len(rows))][1] if rows and i % 3 else rng.normal(size=dims).tolist()
        v = np.array(near) * (2.0 if i % 7 == 1 else 1.0) + rng.normal(size=dims) * (0.0 if i % 5 == 0 else 0.08)
        rows.append((i, np.float32(v).tolist(), int(rng.integers(labels))))
    odd = [
        (1000, None, 1), (1001, [], 1), (1002, [0.0] * dims, 1), (1003, [NAN] + [1.0] * (dims - 1), 1),
        (1004, [INF] + [1.0] * (dims - 1), 1), (1005, [None] + [1.0] * (dims - 1), 1), (1006, rows[0][1], None),
        (None, rows[0][1], rows[0][2]), (3, rows[3][1], rows[3][2]), (1007, [0.0] * dims, 1), (1008, [-0.0] * dims, 1),
    ]
    return rows + odd


def usable(v, dims=None):
    return v is not None and (dims is None or len(v) == dims) and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows)]


def plain_clusters(rows, dims, k=16, rounds=3):
    kept = [(i, whole(v, 64)) for i, v, _ in rows if usable(v, dims)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def place():
        return [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = place()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, at) if m == n]
            centroids[n] = mean(own) if own else centroids[n]
    at = place()
    inertia = [sum(d for d, m in at if m == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia), sha[n]) for (i, _), (d, n) in zip(kept, at)]


@pytest.mark.parametrize("n", [150, 9, 0])
def test_clusters(spark, n):
    rows = vectors(n, 12) if n else [(1, None, 1), (2, [1.0], 1)]
    for pivots in (1, 5, 30):
        got = simplex_clusters.cluster(embeddings(spark, rows), dims=12, pivots=pivots)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared"]
        found = sorted((tuple(r)[:6] for r in got.collect()), key=repr)
        assert found == sorted(plain_clusters(rows, 12), key=repr)


def test_simplex_bounds_hold_and_tighten():
    rng = np.random.default_rng(1)
    points = rng.integers(-60, 60, (300, 20))
    true = ((points[:50, None] - points[None, 50:]) ** 2).sum(-1)
    widths = []
    for pivots in (2, 8, 21):
        simplex = simplex_clusters.Simplex(np.vstack([points[:pivots], points[:2]]))  # repeated pivots add nothing
        apexes = simplex.apexes(simplex.distances(points))
        assert apexes.shape[1] == pivots
        lower, upper = simplex.bounds(apexes[:50], apexes[50:])
        assert (lower <= true + 1e-6 * true.max()).all() and (upper >= true - 1e-6 * true.max()).all()
        widths.append((upper - lower).mean())
    assert widths[0] > widths[1] > widths[2] and widths[2] < 1


def test_bounds_spare_comparisons(spark):
    """Separate clusters: the bounds leave few centroids to the exact comparison."""
    rng = np.random.default_rng(2)
    homes = rng.normal(size=(16, 64)) * 3
    rows = [(i, np.float32(homes[i % 16] + rng.normal(size=64) * 0.05).tolist(), 0) for i in range(320)]
    got = simplex_clusters.cluster(embeddings(spark, rows), pivots=16).collect()
    assert sum(r.n_compared for r in got) < 4 * len(rows)


def plain_codes(rows, dims, parts=4, entries=256, rounds=4):
    kept = [(i, l, whole(v, 1024)) for i, v, l in rows if usable(v, dims)]
    width = dims // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0], kept[r][2]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def place():
        return [[min((apart(part, e), n) for n, e in enumerate(book)) for part, book in zip(row, books)] for row in cut]

    for _ in range(rounds):
        at = place()
        for p, book in enumerate(books):
            for n in range(len(book)):
                own = [row[p] for row, near in zip(cut, at) if near[p][1] == n]
                book[n] = mean(own) if own else book[n]
    at = place()
    error = [sum(d for d, _ in near) for near in at]
    by_label = {l: sum(e for (_, m, _), e in zip(kept, error) if m == l) for _, l, _ in kept}
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    codes = ["".join(f"{n:02x}" for _, n in near) for near in at]
    return [(i, c, e, by_label[l], sha) for (i, l, _), c, e in zip(kept, codes, error)]


@pytest.mark.parametrize("n, entries", [(90, 256), (90, 7), (0, 256)])
def test_codes(spark, n, entries):
    rows = vectors(n, 8) if n else [(1, None, 1), (2, [1.0], 1)]
    got = trie_codes.compress(embeddings(spark, rows), dims=8, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_codes(rows, 8, entries=entries), key=repr)


@pytest.mark.parametrize("nodes", [1, 3, 1024])
def test_walk_of_bundles(nodes):
    rng = np.random.default_rng(4)
    rows = np.unique(rng.integers(-3, 3, (400, 5)), axis=0)
    entries = rng.integers(-4, 4, (9, 5))
    far = ((rows[:, None] - entries) ** 2).sum(-1)
    best, least = trie_codes.walk(rows, entries, nodes)
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all()


def test_large_components_are_an_error(spark):
    rows = embeddings(spark, [(1, [3e7] * 64, 1)])
    for job in (simplex_clusters.cluster, trie_codes.compress):
        with pytest.raises(Exception, match="must be below"):
            job(rows).collect()


def plain_links(rows, cosine):
    def linked(a, b):
        (_, x, l), (_, y, m) = a, b
        if l is None or l != m or not usable(x) or not usable(y) or len(x) != len(y) or not any(x) or not any(y):
            return False
        x, y = np.array(x, np.float64), np.array(y, np.float64)
        return x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine

    near = [{j for j in range(len(rows)) if j != i and linked(rows[i], rows[j])} for i in range(len(rows))]
    left, component = set(range(len(rows))), {}
    while left:
        stack = [left.pop()]
        group = list(stack)
        while stack:
            new = near[stack.pop()] & left
            left -= new
            stack += new
            group += new
        known = [rows[i][0] for i in group if rows[i][0] is not None]
        component.update((i, min(known, default=None)) for i in group)
    return sorted(((rows[i][0], len(near[i]), component[i], rows[i][0] is not None and rows[i][0] == component[i]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("piece, centres", [(1024, 2048), (16, 64), (16, 4), (5, 16)])
def test_near_vectors(spark, piece, centres):
    """One piece a label; cells around centres; cells cut to pieces; a ball of near copies and a hot copy."""
    rows = vectors(160, 6, labels=2)
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    got = cover_tree.near_vectors(embeddings(spark, rows), 0.98, piece, centres)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_links(rows, 0.98)


def test_no_usable_vectors(spark):
    rows = [(1, None, 1), (2, [0.0], 1), (3, [1.0, NAN], 2)]
    assert sorted(tuple(r) for r in cover_tree.near_vectors(embeddings(spark, rows)).collect()) == [(i, 0, i, True) for i in (1, 2, 3)]
    assert cover_tree.near_vectors(embeddings(spark, [])).collect() == []


def test_tree_levels():
    """Each node holds the points of its children, whose radii are at most half of its own and whose centres are further apart."""
    rng = random.Random(6)
    points = cover_tree.unit(np.array([[rng.gauss(0, 1) for _ in range(3)] for _ in range(300)]))
    tree = cover_tree.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(300)) and tree.centre[0] == 0
    for node in range(len(tree.start)):
        members = tree.order[tree.start[node] : tree.end[node]]
        far = cover_tree.distances(points[members], points[tree.centre[node]])
        assert tree.centre[node] in members and abs(far.max() - tree.radius[node]) < 1e-12
        kids = np.arange(tree.first[node], tree.last[node])
        if len(kids):
            assert tree.centre[kids[0]] == tree.centre[node]
            assert np.concatenate([tree.order[tree.start[k] : tree.end[k]] for k in kids]).tolist() == members.tolist()
            assert (tree.radius[kids] <= tree.radius[node] / 2).all()
            gaps = cover_tree.distances(points[tree.centre[kids]][:, None], points[tree.centre[kids]][None])
            assert (gaps[np.triu_indices(len(kids), 1)] > tree.radius[node] / 2).all()
        else:
            assert tree.radius[node] <= cover_tree.SLACK


def test_dense_balls_are_counted_without_their_pairs():
    """Two balls within the threshold: bounds decide them, hardly any pair is compared."""
    rng = np.random.default_rng(7)
    rows = np.vstack([np.ones((2000, 4)), np.ones((2000, 4)) * 2]) + rng.normal(size=(4000, 4)) * 1e-3
    pack = cover_tree.unpack(cover_tree.pack(rows, np.arange(4000), np.ones(4000, np.int64))[0])
    found = cover_tree.Links(pack[0], pack[0], pack[1], pack[1], pack[3], pack[3], 0.98)
    counts, roots = found.search()
    assert (counts == 3999).all() and (roots == 0).all() and sum(len(p) for p, _ in found.pairs) < 100
