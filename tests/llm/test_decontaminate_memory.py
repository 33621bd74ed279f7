"""What decontamination holds and moves: narrow rows, one per lay of an item along a document."""

import random

import pytest
from pyspark.sql import functions as F

from pagewatch.llm import decontaminate as dc
from tests.llm.frames import documents

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(5_000)]
ITEMS = [(i, " ".join(RNG.choices(WORDS, k=30))) for i in range(40)]


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [dc.BROADCAST_SEEDS, 0])
def test_one_row_per_lay(spark, monkeypatch, broadcast):
    """A passage meets some eighty seeds: one narrow row goes on, and words are handed on no further than the item goes."""
    written = {}
    through = dc.write_through
    monkeypatch.setattr(dc, "write_through", lambda df, label: written.setdefault(label, through(df, label)))
    filler = RNG.choices(WORDS, k=300)
    text = " ".join([*filler, *ITEMS[3][1].split(), *filler, *ITEMS[7][1].split(), *filler, *ITEMS[3][1].split()])
    docs = documents(spark, [(1, text, "a"), (2, "quite clean", "a")])
    got = dc.hits(docs, benchmark(spark), broadcast=broadcast)
    assert {(r.doc_id, r.item_id, r.n_agree) for r in got.collect()} == {(1, 3, 30), (1, 7, 30)}
    met = written["decon-met"]
    assert met.count() == 3 and set(met.columns) == {*dc.KEY, "item_key", "shift", "low_at", "high_at"}
    assert all(r.low_at == 0 and r.high_at >= 23 for r in met.collect())


@pytest.mark.parametrize("broadcast", [dc.BROADCAST_SEEDS, 0])
def test_runs_of_a_document(spark, monkeypatch, broadcast):
    """Passages at every place around the ends of runs are met."""
    whole = dc.lays
    monkeypatch.setattr(dc, "lays", lambda *a: whole(*a, run=16))
    rows = [(d, " ".join([*RNG.choices(WORDS, k=d), *ITEMS[d % 40][1].split(), *RNG.choices(WORDS, k=d % 7)]), "a") for d in range(60)]
    got = dc.hits(documents(spark, rows), benchmark(spark), broadcast=broadcast)
    assert {(r.doc_id, r.item_id, r.n_agree, r.agreement) for r in got.collect()} == {(d, d % 40, 30, 1.0) for d in range(60)}


def test_sieve(spark):
    """Every seed of the benchmark passes, and next to none else: seeds of documents are not shuffled to be dropped."""
    seeds = spark.range(3_000).select(F.xxhash64("id").alias("seed"))
    placed = spark.range(100_000).select(F.xxhash64("id").alias("seed"), F.col("id").alias("place"))
    left = dc.sieved(placed, seeds)
    assert left.columns == placed.columns
    ids = {r.place for r in left.collect()}
    assert ids >= set(range(3_000)) and len(ids) < 3_100 and left.count() == len(ids)


def test_documents_stay_where_they_are(spark):
    """Above Spark's own limit texts would be shuffled and sorted to drop a few documents."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dc.without_contaminated(documents(spark, [(1, ITEMS[0][1], "a"), (2, "clean", "a")]), benchmark(spark))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r.doc_id for r in kept.collect()] == [2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
