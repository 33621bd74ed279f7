"""Mix sources to target weights over the course of training.

Each source has a weight schedule over training time 0..1 (piecewise linear). The
integral of a schedule is the source's demand; demand is shared over all words and
capped at a number of passes over the source, the excess going to the others. Inside
a source documents stand in a hashed order. A document's words lie at some cumulative
demand of its source, and the inverse of the schedule's integral turns that into a
training position; sorting by position gives the training order.

A source that holds a third of all rows is spread over hash buckets: sums are taken
per (source, bucket), then inside each bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.llm.tables import KEY, WORD, row_key, whole_text
from pagewatch.operators.ordered import global_rank
from pagewatch.session import write_through

Schedule = Sequence[tuple[float, float]]
PASSES = 3
FLAT = ((0.0, 1.0), (1.0, 1.0))
# Sources of weight 2 fade out, those of weight 3 come in late; the integrals stay as weighed.
CURRICULUM = {2.0: ((0.0, 1.5), (1.0, 0.5)), 3.0: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the hashed order and the row key of each document."""
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size")
    return docs.select("doc_id", "source", size, order_key().alias("order_key"), *[c.alias(k) for k, c in row_key(docs).items()])


def order_key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def cyclic_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Sources by code point, null last, get ``weights`` in turn."""
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int") + 1)
    return ranked.withColumn("weight", weight.cast("double")).drop("place")


def integral(schedule: Schedule) -> float:
    return sum((w0 + w1) * (t1 - t0) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def demanded(sources: DataFrame, schedules: Mapping[float, Schedule] | None) -> DataFrame:
    """Add ``demand``: the integral over training of a source's weight times its schedule, flat where none is given."""
    demand = F.col("weight") * integral(FLAT)
    for weight, schedule in (schedules or {}).items():
        demand = F.when(F.col("weight") == weight, F.col("weight") * integral(schedule)).otherwise(demand)
    return sources.withColumn("demand", demand)


def share_words(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """Add ``target``: all words shared by demand, none above ``passes`` times its source.

    Only sums come to the driver. Each round fixes the sources that reach their cap;
    the rest share what is left, until no further source is above.
    """
    cap = F.col("source_size") * passes
    level, fixed = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("demand") * level >= cap
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("demand"))).alias("open"),
            F.sum(full.cast("long")).alias("n"),
        ).first()
        if row.total is None or row.n == fixed or not row.open:
            break
        fixed, level = row.n, (row.total - row.held) / row.open
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.least(F.col("demand") * level, cap.cast("double")))


def plan_mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), passes: int = PASSES, buckets: int = 1024,
    schedules: Mapping[float, Schedule] | None = CURRICULUM,
) -> DataFrame:
    """One row per document: what the mix takes of it and the position of its first word.

    ``schedules`` maps a source weight to the schedule that scales it over training; the
    integral of the two is what the source demands. Other sources are flat.

    ``taken`` counts words with repeats: whole passes over the source, then a last pass
    up to the target, which may end inside one document. Empty and null texts have size
    0 and take 0; a null source is a source of its own, last in order. Repeated rows are
    rows of their own. No rows give no rows. ``before`` is the number of words of the
    source that precede the document in hashed order, ``passes_done`` the whole passes.
    """
    bucket = F.floor(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * buckets / 2.0**32)
    sized = write_through(document_sizes(docs).withColumn("bucket", bucket), "mix-sizes")
    cells = write_through(sized.groupBy("source", "bucket").agg(F.sum("size").alias("cell")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    sources = write_through(demanded(cyclic_weights(sources, weights), schedules), "mix-sources")
    goals = share_words(sources, passes).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell").over(earlier), F.lit(0)))
    cells = _join(cells, goals)
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size", *KEY)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("in_cell", F.coalesce(F.sum("size").over(running), F.lit(0)))
    joined = placed.join(cells, placed["source"].eqNullSafe(cells["source"]) & (placed["bucket"] == cells["bucket"]))
    before = F.col("cell_before") + F.col("in_cell")
    done = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("goal") - F.col("passes_done") * F.col("source_size")
    part = F.greatest(F.least(F.col("size"), rest - F.col("before")), F.lit(0))
    return (
        joined.select(
            placed["doc_id"], placed["source"], placed["size"], placed["order_key"], before.alias("before"),
            "source_size", "weight", "target", "goal", done.alias("passes_done"), *KEY,
        )
        .withColumn("part", part)
        .withColumn("taken", F.col("size") * F.col("passes_done") + F.col("part"))
        .withColumn("position", _position(F.col("before"), schedules))
    )


def _join(cells: DataFrame, goals: DataFrame) -> DataFrame:
    return cells.join(goals, cells["source"].eqNullSafe(goals["source"])).drop(goals["source"])


def demand_position(done: Column, schedule: Schedule = FLAT) -> Column:
    """Training time at which a source has used the share ``done`` (0..1) of its demand.

    ``schedule`` lists (time, weight) knots from 0 to 1. Between two knots the integral
    is quadratic and is inverted in closed form.
    """
    steps, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        steps.append((t0, w0, (w1 - w0) / (t1 - t0), total))
        total += (w0 + w1) * (t1 - t0) / 2
    where = F.lit(0.0)
    for t0, w0, slope, base in steps:
        y = F.greatest(done * total - base, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * y, F.lit(0.0)))
        here = F.lit(t0) + F.when(root + w0 > 0, 2 * y / (root + w0)).otherwise(0.0)
        where = F.when(done * total >= base, here).otherwise(where)
    return F.least(where, F.lit(1.0))


def training_copies(plan: DataFrame, schedules: Mapping[float, Schedule] | None = None) -> DataFrame:
    """One row per copy of a document with its words and position.

    ``schedules`` maps a source weight to the schedule of such sources; the others are flat.
    """
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes_done").cast("int"))))
    words = F.when(F.col("copy") < F.col("passes_done"), F.col("size")).otherwise(F.col("part"))
    placed = copies.withColumn("words", words).filter("words > 0")
    return placed.withColumn("position", _position(F.col("copy") * F.col("source_size") + F.col("before"), schedules))


def training_order(plan: DataFrame, schedules: Mapping[float, Schedule] | None = None) -> DataFrame:
    """``training_copies`` range-sorted by position."""
    return training_copies(plan, schedules).orderBy("position", "order_key", "copy")


def _position(offset: Column, schedules: Mapping[float, Schedule] | None) -> Column:
    done = F.when(F.col("goal") > 0, F.least(offset / F.col("goal"), F.lit(1.0))).otherwise(0.0)
    where = demand_position(done)
    for weight, schedule in (schedules or {}).items():
        where = F.when(F.col("weight") == weight, demand_position(done, schedule)).otherwise(where)
    return where


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), passes: int = PASSES, schedules: Mapping[float, Schedule] | None = CURRICULUM
) -> DataFrame:
    """The mix as documents: a row per copy in training order, all columns kept.

    Documents stay whole, so the one document in which a source's last pass ends counts
    if at least half of it is due. Documents without words carry nothing to train on and
    are not in the mix. Places in training are worked out without texts; each then
    fetches its document by the row key, and rows are range-sorted by position.
    """
    copies = training_copies(plan_mix(docs, weights, passes, schedules=schedules), schedules)
    copies = copies.filter((F.col("copy") < F.col("passes_done")) | (F.col("part") * 2 >= F.col("size")))
    copies = write_through(copies.select(*KEY, F.struct("position", "order_key", "copy").alias("_place")), "mix-copies")
    texts = docs.withColumns(row_key(docs)).dropDuplicates(KEY)
    return copies.join(texts, KEY).orderBy("_place", *KEY).select(*docs.columns)


def mixed(docs: DataFrame) -> DataFrame:
    """The digest of the mix: a row per document in the order of its first word."""
    ordered = plan_mix(docs).orderBy("position", "order_key")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    words = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
    return f"""
with d as (select doc_id, source, {words}::bigint as size, md5(coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size,
  [1.0, 2.0, 3.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as weight from d group by source),
r as (select *, sum(3 * source_size) over w as held, sum(weight) over w as used, sum(source_size) over () as total,
  sum(weight) over () as every, row_number() over w as n
  from s window w as (order by source_size / weight, encode(source) nulls last rows unbounded preceding)),
l as (select max(level) as level from (
  select total / every as level from r
  union all select (total - held) / nullif(every - used, 0) from r)),
g as (select source, source_size, weight, least(weight * coalesce(level, 0), (3 * source_size)::double) as target from s, l),
p as (select d.*, g.source_size, g.target, floor(g.target + 0.5)::bigint as goal,
  coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from d join g on d.source is not distinct from g.source),
q as (select *, case when source_size > 0 then goal // source_size else 0 end as done from p)
select doc_id, size, source_size, target,
  (size * done + greatest(least(size, goal - done * source_size - before), 0))::bigint as taken
from q"""
