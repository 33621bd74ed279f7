"""SimHash document fingerprints, in DataFrame expressions only.

Terms are five-word shingles. A term's hash votes on 64 bits with the term's weight, one
more than the number of its words that have more than three letters; a bit is set if most
weight is for it. Two votes share one long (32 bits each), so a text's votes are 32 sums.
Tables of permuted blocks find all fingerprints within a radius: with one block more than
the radius, two such fingerprints agree in a whole block.

Texts go through one shuffle, by ranges of doc_id. The first row of each range is also
sent to the range before it, so every document meets its successor without another one.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.llm.tables import GAP, parts, whole_text

SHINGLE = 5
RADIUS = 3
PAIR = 0x100000001  # the lowest bit of each half of a long
LEAST_ID = -(2**63)


def coded_words(text: Column) -> Column:
    """A text's words as hashes whose last bit says that the word has more than three letters."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), GAP)
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(w) > 3).cast("long")))


def terms(words: Column) -> Column:
    """(hash, weight) of each shingle of coded words; fewer words are one term, no words one empty term."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))

    def term(i: Column) -> Column:
        own = [F.get(words, i + j) for j in range(SHINGLE)]
        weight = sum((F.coalesce(w.bitwiseAND(F.lit(1)), F.lit(0)) for w in own), F.lit(1).cast("long"))
        return F.struct(F.xxhash64(*own).alias("hash"), weight.alias("weight"))

    return F.transform(starts, term)


def votes() -> list[Column]:
    """Sums of the weights for each bit, bits n and n + 32 in one long, and of all weight."""
    weight = F.col("weight")
    sums = [
        F.sum(F.shiftrightunsigned(F.col("hash"), n).bitwiseAND(F.lit(PAIR)) * weight).alias(f"v{n}") for n in range(32)
    ]
    return [*sums, F.sum(weight).alias("total")]


def fingerprint() -> Column:
    """The 64 bits of the votes as a long."""
    half = F.col("total")
    out = F.lit(0).cast("long")
    for n in range(32):
        low = F.col(f"v{n}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"v{n}"), 32)
        out = out.bitwiseOR(F.when(low * 2 > half, F.lit(1 << n)).otherwise(F.lit(0).cast("long")))
        top = 1 << (n + 32)
        out = out.bitwiseOR(F.when(high * 2 > half, F.lit(top - 2**64 if top >= 2**63 else top)).otherwise(F.lit(0).cast("long")))
    return out


def voted(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Keys, carried columns and fingerprint ``fp`` of each row of ``rows`` (keys, carried longs, text).

    Keys identify rows. Rows with a null text have no fingerprint and are left out.
    """
    worded = rows.select(*keys, *carried, coded_words(F.col("text")).alias("_w"))
    termed = worded.select(*keys, *carried, terms(F.col("_w")).alias("_t"))
    # outer: for a plain inline Spark adds a filter that works out all terms once more
    sums = termed.select(*keys, *carried, F.inline_outer("_t")).filter("weight is not null").groupBy(*keys).agg(*votes(), *[F.max(c).alias(c) for c in carried])
    return sums.select(*keys, *carried, fingerprint().alias("fp"))


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below ``key``, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    run = F.size(F.filter(_longs([r[0] for r in runs]), lambda b: b <= key))
    inside = F.size(F.filter(F.get(F.array(*map(_longs, runs)), run - 1), lambda b: b <= key))
    return F.when(run > 0, (run - 1) * step + inside).otherwise(0)


def _longs(values: list[int | None]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def id_ranges(docs: DataFrame, n: int) -> tuple[list[int], list[int | None]]:
    """Lower bounds of about ``n`` ranges of doc_id with like numbers of rows, and the first id in each.

    A number for each range comes to the driver.
    """
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    shares = [i / n for i in range(1, n)]
    cuts = docs.select(F.percentile_approx(key, shares, 10_000).alias("c")).first().c if shares else None
    bounds = sorted(set(cuts or []))
    by = {r.r: r.k for r in docs.groupBy(range_of(key, bounds).alias("r")).agg(F.min(key).alias("k")).collect()}
    return bounds, [by.get(i) for i in range(len(bounds) + 1)]


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """(range, row, doc_id, text, next_text, extra): documents by range with the text of the next document.

    After the last comes the first. ``extra`` marks the copy of the next range's first row,
    which only serves as successor. Equal ids stand in the order of their texts; a null id
    comes first.
    """
    bounds, firsts = id_ranges(docs, n)
    filled = [i for i, k in enumerate(firsts) if k is not None]
    before = dict(zip(filled, filled[-1:] + filled[:-1]))
    key, own = F.coalesce("doc_id", F.lit(LEAST_ID)), F.col("own")
    rows = docs.select("doc_id", whole_text().alias("text"), key.alias("key"), range_of(key, bounds).alias("own"))
    is_first = F.col("key") == F.get(_longs(firsts), own)
    also = F.when(is_first, F.get(_longs([before.get(i) for i in range(len(firsts))]), own))
    places = F.array(
        F.struct(own.cast("long").alias("range"), F.lit(0).alias("extra")), F.struct(also.alias("range"), F.lit(1).alias("extra"))
    )
    dealt = rows.withColumn("place", F.explode(places)).filter("place.range is not null")
    dealt = dealt.select("doc_id", "text", "key", "place.range", "place.extra")
    inside = Window.partitionBy("range").orderBy("extra", "key", "text")
    return dealt.select(
        "range", F.row_number().over(inside).alias("row"), "doc_id", "text", F.lead("text").over(inside).alias("next_text"), "extra"
    )


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the next text."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(F.coalesce(following, F.lit("")), F.lit(1), cut))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def hash_words(hex_digest: Column) -> list[Column]:
    """A 64-digit hex digest as four longs, which aggregates keep in place."""
    return [F.conv(F.substring(hex_digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Null texts count as empty; texts without words have fingerprint zero. Equal texts have
    equal fingerprints. Repeated rows stand beside each other in order. One document is its
    own successor; no rows give no rows.
    """
    rows = with_next(docs, max(1, 4 * parts(docs.sparkSession)))
    rows = rows.withColumn("changed", F.when(F.col("extra") == 0, edited(F.col("text"), F.col("next_text"))))
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("changed").alias("text"))
    )
    facts = rows.select(
        "range", "row", "doc_id", "extra", F.length("text").cast("long").alias("n_chars"),
        *hash_words(F.sha2(F.col("changed").cast("binary"), 256)), both.alias("both"),
    )
    carried = ["doc_id", "extra", "n_chars", "s0", "s1", "s2", "s3"]
    seen = voted(facts.select("range", "row", *carried, F.inline("both")), ["range", "row", "kind"], carried)
    of_kind = [F.max(F.when(F.col("kind") == k, F.col("fp"))).alias(name) for k, name in ((0, "fp"), (1, "changed_fp"))]
    seen = seen.groupBy("range", "row").agg(*of_kind, *[F.max(c).alias(c) for c in carried])
    following = F.lead("fp").over(Window.partitionBy("range").orderBy("row"))
    seen = seen.withColumn("next_fp", following).filter("extra = 0")
    digest = F.concat(*[digits(F.col(f"s{i}")) for i in range(4)])
    return seen.select(
        "doc_id", "n_chars", digest.alias("edited_sha256"), digits(F.col("fp")).alias("fingerprint"),
        digits(F.col("changed_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("changed_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def digits(value: Column) -> Column:
    """A long as sixteen hex digits in lower case."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def block_tables(fp: Column, radius: int, spare: int = 2) -> Column:
    """Keys of a fingerprint in the permuted tables: a table for each choice of ``spare`` of its blocks.

    The bits are cut into ``radius + spare`` blocks. Within the radius at least ``spare``
    blocks are equal, and the table that brings these to the front holds both under one key.
    """
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(t), *[blocks[i] for i in chosen]) for t, chosen in enumerate(combinations(range(n), spare))])


def find_near(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fp, distance): all fingerprints of ``fps`` within the radius of each of ``queries`` (fp each).

    Both sides are reduced to different fingerprints first. A pair that meets in several
    tables is given by the first of them only, so nothing is sorted out afterwards.
    """
    own = fps.select("fp").distinct().withColumn("tables", block_tables(F.col("fp"), radius))
    asked = queries.select(F.col("fp").alias("query")).distinct().withColumn("asked", block_tables(F.col("query"), radius))
    own = own.select("fp", "tables", F.posexplode("tables").alias("t", "key"))
    asked = asked.select("query", "asked", F.posexplode("asked").alias("at", "query_key"))
    equal = F.array_position(F.zip_with("tables", "asked", lambda a, b: a == b), True)
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("query")))
    met = own.join(asked, (F.col("key") == F.col("query_key")) & (F.col("t") == F.col("at")) & (far <= radius) & (equal == F.col("t") + 1))
    return met.select("query", "fp", far.alias("distance"))
