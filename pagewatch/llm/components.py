"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.session import write_through


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): a node of its component, the same for all of it.

    Each round orders the nodes anew by a hash of node and round; every node moves to the choice of its
    least neighbour, and links between nodes of one place vanish. As the order is new
    each time, no arrangement of ids is slow: a fixed share of the nodes is left, so rounds are
    logarithmic, on chains in id order too. Sums per node are taken before the shuffle, so a node with very many
    links is no hot key; joins to such a node are cut by the skew-join rule. Each round
    is written, and only the count of links comes to the driver.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    edges, places, turn = write_through(both, "cc-edges"), None, 0
    while True:
        turn += 1
        rank_a, rank_b, rank_to = (F.xxhash64(name, F.lit(turn)) for name in ("a", "b", "to"))
        choice = edges.groupBy("a").agg(F.min_by("b", rank_b).alias("to"))
        choice = choice.select(F.col("a").alias("node"), F.when(rank_a <= rank_to, F.col("a")).otherwise(F.col("to")).alias("to"))
        choice = write_through(choice, "cc-choice")
        onward = choice.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = choice.join(onward, "to").select("node", F.col("next").alias("root"))
        moved = write_through(moved, "cc-moved")
        if places is None:
            places = moved
        else:
            step = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            places = places.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            places = write_through(places, "cc-places")
        left = edges.join(moved.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        left = left.join(moved.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = write_through(left.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-edges")
        if edges.isEmpty():
            return places
