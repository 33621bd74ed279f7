"""Removal of repeated byte strings, by sorting suffixes block by block.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier. The job
never sorts all suffixes at once:

1. Anchors. A window of ``LENGTH`` bytes picks the place of its least hashed ``GRAM``-byte
   string. Equal windows pick equal strings at equal places, so a window can only repeat if
   its anchor's hash does. Windows of unique anchors are done with.
2. Contexts. For an anchor whose hash repeats, the bytes that its windows span are a
   context. Equal contexts under one hash are equal window for window, so only the first
   (smallest doc_id, then start) stays; all windows of the others have an earlier start.
3. Buckets. The suffixes that start the windows of the contexts left under one hash are one
   bucket. Buckets are sorted block by block: suffixes by their first ``PERIOD`` bytes, and
   ties by the ranks of sample suffixes, worked out before for places whose number modulo
   the period is in a difference cover. For any two suffixes the cover has a small shift
   that takes both to sample places. Neighbours in order that agree in ``LENGTH`` bytes are
   equal windows, and all but the first start are repeats.
4. Runs of repeated starts go back to their documents.

A bucket of more than ``SPLIT_CONTEXTS`` contexts is cut by what its windows hold: each
window goes by the hash of its own bytes, the earliest start per hash is found by an
aggregate that is combined before the shuffle, and all other starts are repeats.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.tables import parts, whole_text
from pagewatch.session import write_through

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # anchors a window can choose from
# A perfect difference set modulo 31 (every difference occurs exactly once).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_BYTES = 2 << 20
LEAST_ID = -(2**63)
SPLIT_CONTEXTS = 20_000


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` bytes (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        factor, done = np.uint64(0x9E3779B97F4A7C15), 1
        while done < width:
            h = h[:-done] * factor + h[done:]
            factor, done = factor * factor, done * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, done = values, 1
    while done * 2 <= width:
        least, done = np.minimum(least[:-done], least[done:]), done * 2
    rest = width - done
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first window, last window) of the anchors: runs of windows that pick the same place.

    Of equal least hashes in a window the first place is picked.
    """
    if len(data) < LENGTH:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none
    h = gram_hashes(data)
    least = sliding_least(h, SPAN)
    windows = np.arange(len(least))
    # the picked place of a window: the next place at or after its start that holds its least hash
    at = np.nonzero(_is_least(h, least))[0]
    picked = at[np.searchsorted(at, windows)]
    wrong = h[picked] != least
    while wrong.any():  # a smaller window's place stands before: go on to the next one
        nxt = np.searchsorted(at, picked[wrong], "right")
        picked[wrong] = at[nxt]
        wrong[wrong] = h[picked[wrong]] != least[wrong]
    starts = np.nonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))[0]
    ends = np.append(starts[1:], len(windows)) - 1
    return h[picked[starts]], starts, ends


def _is_least(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places that hold the least hash of some window over them."""
    padded = np.zeros(len(least) + 2 * (SPAN - 1), np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(least)] = least
    most = ~sliding_least(~padded, SPAN)
    return h == most[: len(h)]


def big_words(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The ``width`` bytes from each place as numbers that sort like the bytes, most significant first."""
    out = []
    for start in range(0, width, 8):
        word = np.zeros(len(at), np.uint64)
        for k in range(start, min(start + 8, width)):
            word = (word << np.uint64(8)) | data[at + k]
        out.append(word << np.uint64(8 * (start + 8 - min(start + 8, width))))
    return out


def ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows of keys, the first key the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def cover_shifts() -> np.ndarray:
    """shift[i, j]: the least shift that takes places congruent i and j both to the cover."""
    table = np.full((PERIOD, PERIOD), -1, np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            table[i, j] = next(k for k in range(PERIOD) if (i + k) % PERIOD in COVER and (j + k) % PERIOD in COVER)
    return table


def sample_ranks(data: np.ndarray, places: int) -> np.ndarray:
    """Ranks by at least ``LENGTH`` bytes of the sample suffixes among ``places``, -1 elsewhere.

    ``data`` has room behind the last place. Ranks by a period are doubled: the place a
    period on is a sample place as well.
    """
    at = np.nonzero(np.isin(np.arange(places) % PERIOD, COVER))[0]
    rank = np.full(len(data) + 4 * PERIOD * 4, -1, np.int64)
    rank[at] = ranked(big_words(data, at, PERIOD))
    known = PERIOD
    while known < LENGTH:
        rank[at] = ranked([rank[at], rank[at + known]])
        known *= 2
    return rank


def sort_block(data: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``at`` by bucket and their first ``LENGTH`` bytes.

    First by bucket and a period's bytes; ties by sample ranks at a shift that takes all
    of them to the cover, or else pair by pair.
    """
    places = int(at.max()) + LENGTH
    keys = [bucket, *big_words(data, at, PERIOD)]
    tie = ranked(keys)
    rank, shifts = sample_ranks(data, places), cover_shifts()
    residue = at % PERIOD
    tied = order = np.argsort(tie, kind="stable")
    group = tie[order]
    starts = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
    low = np.minimum.reduceat(residue[order], starts)
    high = np.maximum.reduceat(residue[order], starts)
    shift = np.empty(len(at), np.int64)
    sizes = np.diff(np.append(starts, len(at)))
    shift[order] = np.repeat(shifts[low, high], sizes)
    ranks = rank[at + shift]
    fits = np.isin((residue + shift) % PERIOD, COVER)
    order = np.lexsort([ranks, tie])
    mixed = np.logical_and.reduceat(fits[tied], starts)
    for n in np.nonzero(~mixed)[0].tolist():  # more than two residues in a tie: no one shift serves them all
        part = slice(int(starts[n]), int(starts[n] + sizes[n]))
        members = order[part].tolist()

        def by_cover(a: int, b: int) -> int:
            k = shifts[residue[a], residue[b]]
            return int(rank[at[a] + k] - rank[at[b] + k])

        order[part] = sorted(members, key=cmp_to_key(by_cover))
    return order


def equal_runs(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number per suffix, shared by those of a bucket that agree in ``LENGTH`` bytes."""
    a, b = at[order[:-1]], at[order[1:]]
    same = bucket[order[:-1]] == bucket[order[1:]]
    for k in range(LENGTH):
        left = np.nonzero(same)[0]
        if not len(left):
            break
        same[left] = data[a[left] + k] == data[b[left] + k]
    runs = np.empty(len(at), np.int64)
    runs[order] = np.cumsum(np.concatenate([[0], ~same]))
    return runs


def repeats_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc, tie, start, end) of runs of repeated window starts among the contexts of whole buckets.

    ``rows``: hash, doc, tie, first, context. The earliest start of equal windows stays.
    """
    lengths = rows.context.map(len).to_numpy()
    data = np.frombuffer(b"".join([*rows.context, bytes(8 * PERIOD + LENGTH)]), np.uint8)
    windows = lengths - LENGTH + 1
    context = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(lengths) - lengths, windows) + offset
    bucket = np.cumsum(np.concatenate([[0], rows["hash"].to_numpy()[1:] != rows["hash"].to_numpy()[:-1]])).astype(np.uint64)[context]
    order = sort_block(data, at, bucket)
    runs = equal_runs(data, at, bucket, order)
    doc, tie = rows.doc.to_numpy()[context], rows.tie.to_numpy()[context]
    start = rows["first"].to_numpy()[context] + offset
    by_age = np.lexsort([start, tie, doc, runs])
    repeat = np.zeros(len(at), bool)
    repeat[by_age[1:]] = runs[by_age[1:]] == runs[by_age[:-1]]
    begins = repeat & ~np.concatenate([[False], repeat[:-1] & (context[1:] == context[:-1])])
    ends = repeat & ~np.concatenate([repeat[1:] & (context[1:] == context[:-1]), [False]])
    return pd.DataFrame({"doc": doc[begins], "tie": tie[begins], "start": start[begins], "end": start[ends]})


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tie and text: a null doc_id comes first; rows that share a doc_id are told apart by their text."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc"), whole_text().alias("text"))
    shared = write_through(rows.groupBy("doc").count().filter("count > 1").select("doc", F.lit(True).alias("shared")), "suffix-ids")
    if shared.isEmpty():
        return rows.withColumn("tie", F.lit(0).cast("long"))
    tie = F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(shared, "doc", "left").withColumn("tie", tie).drop("shared")


def in_pieces(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def anchor_hashes(rows: DataFrame) -> DataFrame:
    """(hash, n): how often each anchor hash occurs, counted ahead for a few documents at a time."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_pieces(batches):
            found = [anchors_of(np.frombuffer(text.encode(), np.uint8))[0] for text in batch.text]
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"hash": hashes.view(np.int64), "n": counts})

    return rows.select("text").mapInPandas(find, "hash long, n long")


def anchors(rows: DataFrame) -> DataFrame:
    """The anchors of all documents with the hash of the bytes their windows span."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for batch in in_pieces(batches):
            spans, found = [], []
            for text in batch.text:
                raw = text.encode()
                own = anchors_of(np.frombuffer(raw, np.uint8))
                spans += [xxh64_intdigest(raw[a:b]) for a, b in zip(own[1].tolist(), (own[2] + LENGTH).tolist())]
                found.append(own)
            hashes, first, last = (np.concatenate(part) for part in zip(*found))
            of = np.repeat(np.arange(len(batch)), [len(own[0]) for own in found])
            yield pd.DataFrame(
                {"hash": hashes.view(np.int64), "context": np.array(spans, np.uint64).view(np.int64),
                 "doc": batch.doc.to_numpy()[of], "tie": batch.tie.to_numpy()[of], "first": first.astype(np.int32),
                 "last": last.astype(np.int32)}
            )

    schema = "hash long, context long, doc long, tie long, first int, last int"
    return rows.select("doc", "tie", "text").mapInPandas(find, schema)


def contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, doc, tie, first, context) with the bytes of the wanted anchors (hash, doc, tie, first, last)."""
    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("hash", "first", "last")).alias("s"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_pieces(batches):
            pieces: list[bytes] = []
            for text, first, last in zip(batch.text, batch["first"], batch["last"]):
                raw = text.encode()
                pieces += [raw[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
            of = np.repeat(np.arange(len(batch)), batch["first"].map(len).to_numpy())
            yield pd.DataFrame(
                {"hash": np.concatenate(batch["hash"].to_list()), "doc": batch.doc.to_numpy()[of],
                 "tie": batch.tie.to_numpy()[of], "first": np.concatenate(batch["first"].to_list()),
                 "context": pd.Series(pieces, dtype=object)}
            )

    joined = rows.join(lists, ["doc", "tie"])
    joined = joined.select("doc", "tie", "text", *[F.col(f"s.{c}").alias(c) for c in ("hash", "first", "last")])
    return joined.mapInPandas(cut, "hash long, doc long, tie long, first int, context binary")


def sorted_repeats(found: DataFrame) -> DataFrame:
    """Repeated starts of the buckets of ``found``, a block of whole buckets at a time."""
    dealt = found.repartition(parts(found.sparkSession), "hash").sortWithinPartitions("hash")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            values = rows["hash"].to_numpy()
            cuts = np.append(np.nonzero(values[1:] != values[:-1])[0] + 1, len(rows))
            size, start = np.cumsum(rows.context.map(len).to_numpy()), 0
            for k, cut in enumerate(cuts[:-1].tolist()):
                following = int(cuts[k + 1])
                if size[following - 1] - (size[start - 1] if start else 0) > BLOCK_BYTES:
                    yield repeats_in_block(rows.iloc[start:cut])
                    start = cut
            kept = rows.iloc[start:].reset_index(drop=True)
        if kept is not None and len(kept):
            yield repeats_in_block(kept)

    return dealt.mapInPandas(solve, "doc long, tie long, start int, end int")


def split_repeats(found: DataFrame) -> DataFrame:
    """Repeated starts of buckets in very many contexts: windows meet by the hash of their bytes."""
    n = F.length("context") - LENGTH
    starts = found.select("hash", "doc", "tie", "first", "context", F.explode(F.sequence(F.lit(0), n)).alias("at"))
    whole = F.substring(F.col("context"), F.col("at") + 1, F.lit(LENGTH))
    windows = starts.select(
        F.struct("hash", F.xxhash64(whole).alias("window")).alias("key"), F.struct("doc", "tie", (F.col("first") + F.col("at")).alias("start")).alias("place")
    )
    earliest = windows.groupBy("key").agg(F.min("place").alias("least"))
    later = windows.join(earliest, "key").filter("place <> least")
    return later.select("place.doc", "place.tie", "place.start", F.col("place.start").alias("end"))


def release(spark) -> None:
    """Let Spark drop the shuffle files of finished steps now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_starts(rows: DataFrame, split: int = SPLIT_CONTEXTS) -> DataFrame:
    """(doc, tie, start, end): runs of window starts whose bytes also start earlier."""
    spark = rows.sparkSession
    twice = anchor_hashes(rows).groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash")
    twice = write_through(twice, "suffix-hashes")
    release(spark)
    held = write_through(anchors(rows).join(twice, "hash", "left_semi"), "suffix-anchors")
    release(spark)
    place = F.struct("doc", "tie", "first")
    kinds = held.groupBy("hash", "context").agg(F.min(F.struct("doc", "tie", "first", "last")).alias("least"), F.count("*").alias("n"))
    kinds = write_through(kinds, "suffix-contexts")
    firsts = kinds.filter("n > 1").select("hash", "context", F.struct("least.doc", "least.tie", "least.first").alias("least"))
    copies = held.join(firsts, ["hash", "context"]).filter(place != F.col("least"))
    copies = copies.select("doc", "tie", F.col("first").alias("start"), F.col("last").alias("end"))
    many = kinds.groupBy("hash").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = kinds.join(many, "hash").select("hash", "kinds", "least.*")
    found = contexts(rows, wanted.filter(F.col("kinds") <= split))
    ours = write_through(sorted_repeats(write_through(found, "suffix-bytes")).unionByName(copies), "suffix-repeats")
    release(spark)
    large = wanted.filter(F.col("kinds") > split)
    if large.isEmpty():
        return ours
    hot = write_through(contexts(rows, large), "suffix-hot")
    return ours.unionByName(write_through(split_repeats(hot), "suffix-hot-repeats"))


def remove_repeats(docs: DataFrame, split: int = SPLIT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row.

    Null texts count as empty. A null doc_id stands before all others. Rows that share a
    doc_id stand in the order of a hash of their texts; rows that also share the text are
    one document and get the same result. No rows give no rows.
    """
    rows = keyed(docs)
    runs = repeated_starts(rows, split)
    lists = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("runs"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_pieces(batches):
            cut = [kept_bytes(t.encode(), a, b) for t, a, b in zip(part.text, part.starts, part.ends)]
            out = pd.DataFrame(cut, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield out.assign(doc_id=part.doc_id.astype("Int64").to_numpy())

    joined = rows.join(lists, ["doc", "tie"], "left")
    joined = joined.select("doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends"))
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, doc_id long"
    return joined.mapInPandas(remove, schema).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def kept_bytes(raw: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple[int, int, int, str, bytes]:
    """Sizes, number of removed runs, digest and bytes of what is left; windows from each start to its end go."""
    if starts is None or not len(starts):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept
