"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

A seed is the hash of some of the words in a short window: a fixed mask says which
positions count, so a substituted word in an ignored position does no harm. Seeds of the
benchmark are joined with seeds of all documents. Around each hit the item is laid along
the document word by word, and the overlap counts if a window of the item that holds the
hit agrees in at least the given share of its words.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.tables import KEY, row_key, whole_text
from pagewatch.session import write_through

# These meet every full window with the substitutions it allows; the short ones are for items that they cannot meet.
MASKS = ("11111", "1110101", "1101011")
SHORT = ("1111", "111", "1101", "11", "1")
WINDOW, AGREE = 13, 0.8
BROADCAST_SEEDS = 1_000_000
RUN = 4_096
# The sieve: 2 bytes a seed and some 50 a bucket go to all executors.
SIEVE_SEEDS, BUCKET_BITS, REST_BITS = 50_000_000, 18, 15


def covered(masks: Sequence[str], n: int, gone: int) -> bool:
    """Whether every way to substitute ``gone`` of ``n`` words leaves some mask whole."""
    places = [{i + j for j, c in enumerate(m) if c == "1"} for m in masks for i in range(n - len(m) + 1)]
    return all(any(not p & {*out} for p in places) for out in combinations(range(n), gone))


def masks_of(n: int, masks: Sequence[str], window: int, agree: float) -> list[int]:
    """Numbers, in ``masks`` and then ``SHORT``, of the masks that miss no item of ``n`` words at the allowed agreement."""
    width = min(n, window)
    gone = max(g for g in range(width + 1) if (width - g) / width >= agree)
    every = [*masks, *SHORT]
    for last in range(len(masks), len(every) + 1):
        if covered(every[:last], width, gone):
            break
    return [k for k, m in enumerate(every[:last]) if len(m) <= n]


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds_at(hashes: Column, i: Column, masks: dict[int, str]) -> list[Column]:
    """The seed of each mask at position ``i``; the mask's number is part of it."""
    return [F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j, c in enumerate(m) if c == "1"]) for k, m in masks.items()]


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_key, item_id, item): the word hashes of each different item and its smallest id, null if it has none.

    Items without words are left out.
    """
    bare = F.regexp_replace(whole_text(), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    items = benchmark.select("item_id", bare.alias("_t")).filter("_t <> ''").groupBy(word_hashes(F.col("_t")).alias("item"))
    return items.agg(F.min("item_id").alias("item_id")).select(F.monotonically_increasing_id().alias("item_key"), "item_id", "item")


def item_seeds(items: DataFrame, by_length: dict[int, list[int]], masks: Sequence[str]) -> DataFrame:
    """(seed, item_key, at) of every window of the masks that an item's length asks for."""
    n, every = F.size("item"), [*masks, *SHORT]
    at = items.select("item_key", "item", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    used = {k: every[k] for numbers in by_length.values() for k in numbers}
    longest = max(by_length)
    each = []
    for (k, m), seed in zip(used.items(), seeds_at(F.col("item"), F.col("at"), used)):
        asked = F.least(n, F.lit(longest)).isin(*[length for length, numbers in by_length.items() if k in numbers])
        each.append(F.when(asked & (F.col("at") + len(m) <= n), seed))
    return at.select("item_key", "at", F.explode(F.array(*each)).alias("seed")).filter("seed is not null")


def sieved(placed: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose seed is in ``seeds``, and one in some thousands of the others.

    Only a few bits of each seed are sent to the executors, so that what is shuffled by seed is little more than the hits.
    """
    bucket, rest = F.shiftrightunsigned("seed", 64 - BUCKET_BITS), F.col("seed").bitwiseAND((1 << REST_BITS) - 1).cast("short")
    buckets = seeds.groupBy(bucket.alias("_bucket")).agg(F.collect_set(rest).alias("_rests"))
    return placed.join(F.broadcast(buckets), bucket == F.col("_bucket")).filter(F.array_contains("_rests", rest)).select(placed.columns)


def lays(texts: DataFrame, seeds: DataFrame, n_seeds: int, used: dict[int, str], broadcast: int, run: int = RUN) -> DataFrame:
    """(row key, item_key, shift, low_at, high_at) of each place where seeds lay an item along a document.

    ``low_at`` and ``high_at`` are the first and last place in the item that a seed met. No row is wider than the seeds of
    ``run`` words, and a document's hits are summed up as they are found.
    """
    reach = max(map(len, used.values())) - 1
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / run).cast("int"))
    runs = F.transform(starts, lambda c: F.slice("words", c * run + 1, run + reach))
    every = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.least(F.size("run"), F.lit(run)) - 1), lambda i: F.array(*seeds_at(F.col("run"), i, used))
        )
    )
    # posexplode_outer: for posexplode Spark adds a filter that works out all seeds once more
    cut = texts.select(*KEY, word_hashes(F.col("text")).alias("words")).select(*KEY, F.posexplode_outer(runs).alias("c", "run"))
    placed = cut.select(*KEY, "c", every.alias("seeds")).select(*KEY, "c", F.posexplode_outer("seeds").alias("k", "seed"))
    placed = placed.select(*KEY, (F.col("c") * run + F.floor(F.col("k") / len(used)).cast("int")).alias("place"), "seed")
    if broadcast < n_seeds <= SIEVE_SEEDS:
        placed = sieved(placed, seeds)
    met = placed.join(F.broadcast(seeds) if n_seeds <= broadcast else seeds, "seed").select(*KEY, "item_key", (F.col("place") - F.col("at")).alias("shift"), "at")
    return met.groupBy(*KEY, "item_key", "shift").agg(F.min("at").alias("low_at"), F.max("at").alias("high_at"))


def hits(
    docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, window: int = WINDOW, agree: float = AGREE, broadcast: int = BROADCAST_SEEDS
) -> DataFrame:
    """(doc_id, item_id, n_words, n_agree, agreement) of each verified overlap, the best per document and different item.

    Every item is met that agrees in the given share of a window, short ones too: for each length in the
    benchmark the masks are chosen that leave no substitution it allows unmet, down to the whole item where
    none is allowed. An item with a null id is an item like any other.

    Two passes. The first carries narrow rows alone (row key, place, seed), worked out in runs of a document's words,
    and keeps one row per lay of an item along a document, however many seeds met. The second takes words again only from
    the documents that met one, and hands on no more of them than the item covers. The seed table, and the keys of
    those documents, go to all executors if their counted size allows; else rows are shuffled, of the seeds those that
    a sieve lets through. Windows that run over a document's end have a shorter hash and meet no seed.
    """
    items = write_through(item_words(benchmark), "decon-items")
    lengths = [r.n for r in items.select(F.least(F.size("item"), F.lit(window)).alias("n")).distinct().collect()]
    by_length = {n: masks_of(n, masks, window, agree) for n in sorted(lengths)} or {window: [0]}
    seeds = write_through(item_seeds(items, by_length, masks), "decon-seeds")
    n_seeds = seeds.count()
    used = {k: [*masks, *SHORT][k] for k in sorted({k for numbers in by_length.values() for k in numbers})}
    texts = docs.select("doc_id", whole_text().alias("text"))
    texts = texts.withColumns(row_key(texts))
    met = write_through(lays(texts, seeds, n_seeds, used, broadcast), "decon-met")
    asked = write_through(met.select(*KEY).distinct(), "decon-asked")
    few = asked.count() <= broadcast
    asked = texts.join(F.broadcast(asked) if few else asked, KEY, "left_semi").dropDuplicates(KEY)
    worded = asked.select("doc_id", *KEY, word_hashes(F.col("text")).alias("words"))
    n, low = F.size("item"), F.least("shift", F.lit(0))
    near = F.slice("words", F.greatest("shift", F.lit(0)) + 1, n).alias("near")
    found = met.join(F.broadcast(items) if n_seeds <= broadcast else items, "item_key").join(worded, KEY)
    found = found.select("doc_id", "item_key", "item_id", "item", "low_at", "high_at", low.alias("low"), near)
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda j: (F.get("near", j + F.col("low")) == F.get("item", j)).eqNullSafe(True))
    found = found.select("doc_id", "item_key", "item_id", "low_at", "high_at", n.alias("n_words"), same.alias("same"))
    width = F.least(F.lit(window), F.col("n_words"))
    first = F.greatest(F.col("low_at") - width + 1, F.lit(0))
    last = F.least(F.col("high_at"), F.col("n_words") - width)
    best = F.array_max(F.transform(F.sequence(first, last), lambda s: F.size(F.filter(F.slice("same", s + 1, width), lambda x: x))))
    found = found.select(
        "doc_id", "item_key", "item_id", "n_words", F.size(F.filter("same", lambda x: x)).alias("n_agree"), (best / width).alias("agreement")
    )
    # kept by the aggregate, as a filter would be moved into the join with its expressions spelled out
    verified = F.when(F.col("agreement") >= agree, F.struct("n_agree", "agreement", "n_words"))
    found = found.groupBy("doc_id", "item_key", "item_id").agg(F.max(verified).alias("best")).filter("best is not null")
    return found.select("doc_id", "item_id", "best.*")


def flag_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, contaminated, n_items, and the best item with its agreeing words.

    Null and empty texts are clean. Rows with the same doc_id, null included, share one
    verdict. An empty benchmark leaves all clean. Of equal items the smallest id stands
    for all; if none has one, ``item_id`` is null and the document is flagged all the same.
    """
    order = F.struct("n_agree", "agreement", (-F.col("item_id")).alias("low"), "n_words")
    per = hits(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max(order).alias("best"))
    per = per.select(F.col("doc_id").alias("_id"), "n_items", "best")
    joined = docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        (-F.col("best.low")).alias("item_id"), F.col("best.n_words").alias("item_words"), F.col("best.n_agree").alias("n_agree"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark."""
    marked = write_through(hits(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct(), "decon-marked")
    # ids alone go to all executors: above Spark's own limit every text would be shuffled and sorted to drop a few
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_SEEDS else marked
    return docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]), "left_anti")
