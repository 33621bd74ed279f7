"""SimHash near-duplicates by BK-trees.

A document's 64-bit fingerprint comes from its 4-word shingles. Two fingerprints at most
``radius`` bits apart agree in at least two of six bit blocks, so each of the fifteen
pairs of blocks deals the different fingerprints to shards that miss no link. Shards of up
to ``LEAF`` are compared row by row; in a larger one they stand in a BK-tree: a node's children are keyed by their Hamming distance to it,
and a search follows only the edges whose distance is within the radius of its own.

Shards above a size are cut into pieces; each pair of pieces is a task that builds a tree
over both, so a shard that many fingerprints share is worked on by many tasks. What
leaves a shard is its components, one row per fingerprint at most, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.components import connected
from pagewatch.llm.tables import KEY, parts, row_key
from pagewatch.session import write_through

RADIUS, SHINGLE, SEED = 4, 4, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
LEAF = 16
PIECE = 8192


def votes_of(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes; none without hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for start in range(0, n, 255 * 64):
        raw = np.unpackbits(hashes[start : start + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(raw), 255):
            counts += np.add.reduce(raw[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint_of(text: str) -> int:
    """Lower-case A-Z, words, shingles with repeats, XXH64 of each; a bit is set if most hashes set it."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    return votes_of(np.frombuffer(digests, ">u8").astype("<u8"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Null texts count as empty: fingerprint zero."""

    return docs.select("doc_id", fingerprint_column("text").alias("fp"))


def fingerprint_column(text: str) -> Column:
    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t or "") for t in texts], np.uint64).view(np.int64))

    return fp(text)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKTree:
    """Children keyed by integer Hamming distance to their node's fingerprint; small subtrees are arrays."""

    def __init__(self, fps: np.ndarray, at: np.ndarray | None = None, leaf: int = LEAF):
        self.at = np.arange(len(fps)) if at is None else at
        self.held, self.children = fps, {}
        if len(fps) <= leaf:
            return
        far = distance(fps[1:], fps[0])
        order = np.argsort(far, kind="stable")
        keys, starts = np.unique(far[order], return_index=True)
        for key, members in zip(keys.tolist(), np.split(order, starts[1:])):
            self.children[key] = BKTree(fps[1:][members], self.at[1:][members], leaf)
        self.held, self.at = fps[:1], self.at[:1]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of queries, numbers of fingerprints) of all pairs within the radius, an array pair per node."""
        stack = [(self, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            far = distance(queries[asked][:, None], node.held[None, :])
            q, f = np.nonzero(far <= radius)
            if len(q):
                yield asked[q], node.at[f]
            for key, child in node.children.items():
                near = asked[np.abs(far[:, 0].astype(np.int16) - key) <= radius]
                if len(near):
                    stack.append((child, near))


def roots_of(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each of ``n`` numbers' components under the pairs, as they come."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def block_keys(fp: Column) -> Column:
    """The shard of a fingerprint for each pair of blocks, as (pair, bits of both) in one long."""
    ends = np.cumsum(BLOCKS).tolist()
    bits = [F.shiftrightunsigned(fp, end - width).bitwiseAND(F.lit((1 << width) - 1)) for end, width in zip(ends, BLOCKS)]
    pairs = list(combinations(range(len(BLOCKS)), 2))
    return F.array(*[F.lit(k << 24) + bits[a] * (1 << BLOCKS[b]) + bits[b] for k, (a, b) in enumerate(pairs)])


def shard_links(fps: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(a, b): each fingerprint with the smallest of its component inside a shard, if another.

    ``fps`` holds different fingerprints (fp). Components over all rows are those of all
    links within the radius.
    """
    if radius > len(BLOCKS) - 2:
        raise ValueError("two of the blocks must agree within the radius")
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"))).alias("shard"))
    sizes = keyed.groupBy("shard").count()
    large = sizes.filter(F.col("count") > piece).select("shard", F.ceil(F.col("count") / piece).cast("int").alias("cut"))
    dealt = keyed.join(large, "shard", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), "cut").cast("int")
    meets = F.sequence(F.lit(0), F.col("cut") - 1)
    pair = F.transform(meets, lambda m: F.struct(F.least(m, own).alias("low"), F.greatest(m, own).alias("high"), (own > m).alias("upper")))
    dealt = dealt.withColumn("meet", F.explode(pair)).select(
        "fp", "shard", F.col("meet.low").alias("low"), F.col("meet.high").alias("high")
    )
    n = parts(fps.sparkSession)
    dealt = dealt.repartition(n, "shard", "low", "high").sortWithinPartitions("shard", "low", "high", "fp")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame()
        for batch in batches:
            rows = pd.concat([kept, batch], ignore_index=True) if len(kept) else batch
            same = (rows[["shard", "low", "high"]] == rows[["shard", "low", "high"]].iloc[-1]).all(axis=1).to_numpy()
            open_at = len(rows) - int(same.sum())
            yield from _linked(rows.iloc[:open_at], radius)
            kept = rows.iloc[open_at:].reset_index(drop=True)
        yield from _linked(kept, radius)

    return dealt.mapInPandas(link, "a long, b long")


def _linked(rows: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    """Links of whole groups that stand one after another."""
    if not len(rows):
        return
    fps = rows.fp.to_numpy().view(np.uint64)
    new = np.ones(len(rows), bool)
    for name in ("shard", "low", "high"):
        values = rows[name].to_numpy()
        new[1:] = new[1:] & (values[1:] == values[:-1]) if name == "shard" else new[1:] & (values[1:] == values[:-1])
    new[1:] = ~new[1:]
    starts = np.nonzero(new)[0]
    ends = np.append(starts[1:], len(rows))
    group = np.cumsum(new)
    low, high = [], []
    for lag in range(1, LEAF):  # groups of up to LEAF are one leaf of a tree: their rows against each other
        small = (ends - starts <= LEAF)[group[:-lag] - 1] if len(rows) > lag else np.empty(0, bool)
        hit = small & (group[lag:] == group[:-lag]) & (distance(fps[lag:], fps[:-lag]) <= radius) if len(small) else small
        at = np.nonzero(hit)[0]
        low.append(at)
        high.append(at + lag)
    if low and sum(map(len, low)):
        pairs = pd.DataFrame({"a": fps[np.concatenate(high)].view(np.int64), "b": fps[np.concatenate(low)].view(np.int64)})
        yield pairs
    for start, end in zip(starts[ends - starts > LEAF].tolist(), ends[ends - starts > LEAF].tolist()):
        own = fps[start:end]
        tree = BKTree(own)
        root = roots_of(len(own), (p for s in range(0, len(own), 1024) for p in _shifted(tree, own, s, radius)))
        at = np.nonzero(root != np.arange(len(own)))[0]
        if len(at):
            yield pd.DataFrame({"a": own[at].view(np.int64), "b": own[root[at]].view(np.int64)})


def _shifted(tree: BKTree, fps: np.ndarray, start: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for q, f in tree.within(fps[start : start + 1024], radius):
        yield q + start, f


def near_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each document.

    Fingerprints at most ``radius`` bits apart link; the component_id is the smallest
    doc_id reachable. Texts without words and null texts have fingerprint zero, which
    links like any other. Rows that repeat stay; a null doc_id counts as no doc_id for
    the smallest. No rows give no rows.
    """
    rows = write_through(fingerprints(docs), "bk-fingerprints")
    homes = group_roots(rows.select("fp", F.col("doc_id").alias("key")), radius)
    lowest = homes.groupBy("root").agg(F.min("low").alias("component_id"))
    homes = homes.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return rows.join(homes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def group_roots(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, low): each different fingerprint of ``rows`` (fp, key), the fingerprint that stands for its group, and its smallest key."""
    nodes = write_through(rows.groupBy("fp").agg(F.min("key").alias("low")), "bk-nodes")
    links = write_through(shard_links(nodes.select("fp"), radius), "bk-links")
    homes = nodes.join(connected(links).withColumnRenamed("node", "fp"), "fp", "left")
    return homes.select("fp", F.coalesce("root", "fp").alias("root"), "low")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one of those with the smallest doc_id.

    A group is its fingerprints, whatever the ids: rows of one doc_id with unrelated texts
    are in different groups, each of which keeps a row. Rows with a null doc_id come last
    and stay only where their group has no other id. Of several rows with the smallest
    id the least row key stays.
    """
    keyed = docs.withColumns(row_key(docs))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)
    prints = keyed.select("doc_id", "text", *KEY)
    rows = write_through(prints.select(fingerprint_column("text").alias("fp"), order.alias("key")), "bk-fingerprints")
    kept = group_roots(rows, radius).groupBy("root").agg(F.min("low").alias("low"))
    kept = write_through(kept.select(*[F.col(f"low.{k}").alias(k) for k in KEY]), "bk-kept")
    return keyed.dropDuplicates(KEY).join(kept, KEY, "left_semi").drop(*KEY)
