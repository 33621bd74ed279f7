"""Keyed-state jobs over an append stream of scans or fetches, a shard of keys at a time.

Keys are dealt to a fixed number of shards by hash, so one large site spreads over many
tasks and many small keys share one call. A call gets all rows of its shard in a
micro-batch, holds them as Arrow columns and takes them by key and id, a slice at a time; every
step is then a few array operations over all keys of a slice, with one stored row per key as what
came before.

A row at or below the last id that its key has seen is emitted with ``late = true`` and changes no
state; the batch replay repairs such rows. The number of shards belongs to a job's checkpoint and
must not change under it. With ``ttl_days``, what is known of a key is dropped that long after its last row; such
a key starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewatch.functions.status import (
    GONE_STATUSES, NO_GUIDANCE, POSITIVE_CLASSES, THROTTLE_STATUSES, usable_scan,
)
from pagewatch.functions.urls import canon_url

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 64
SLICE = 100_000
DAY_MS = 86_400_000
TEXT, LONG, BOOL, STAMP = pa.string(), pa.int64(), pa.bool_(), pa.timestamp("us")


def booleans(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy(zero_copy_only=False).astype(bool)


def pick(values: pa.Array, at: np.ndarray) -> pa.Array:
    """``values[at]``, null where ``at`` is below nought."""
    return values.take(pa.array(at, mask=at < 0))


def choose(mask: np.ndarray, yes: pa.Array, no: pa.Array) -> pa.Array:
    return pc.if_else(pa.array(mask), yes, no)


def same_text(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equal texts, nulls equal each other."""
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    return booleans(pc.or_kleene(pc.equal(a, b), both_null))


class Groups:
    """Rows sorted by key and id: the number of each row's key and where its run starts and ends."""

    def __init__(self, key: np.ndarray):
        n = len(key)
        self.n = n
        self.new = np.ones(n, bool)
        self.new[1:] = key[1:] != key[:-1]
        self.starts = np.nonzero(self.new)[0]
        self.of = np.cumsum(self.new) - 1
        self.start = self.starts[self.of] if n else self.starts
        self.last = np.append(self.starts[1:], n)[: len(self.starts)] - 1
        self.keys = key[self.starts]

    def upto(self, mask: np.ndarray) -> np.ndarray:
        """The last row of the key, up to each row, where ``mask`` holds; -1 if there is none."""
        at = np.maximum.accumulate(np.where(mask, np.arange(self.n), -1)) if self.n else np.empty(0, np.int64)
        return np.where(at >= self.start, at, -1)

    def before(self, mask: np.ndarray) -> np.ndarray:
        """As ``upto``, without the row itself."""
        at = np.append(-1, self.upto(mask)[:-1])[: self.n]
        return np.where(self.new, -1, at)


class _Sharded(StatefulProcessor):
    """Sorts a shard's rows, sets the late ones apart and hands the others to ``step`` with the stored rows."""

    order = "scan_id"
    keys: tuple[str, ...] = ()
    columns: dict[str, pa.DataType] = {}
    state: dict[str, str] = {}

    def __init__(self, ttl_days: float | None = None):
        self.ttl_ms = None if ttl_days is None else max(1, round(ttl_days * DAY_MS))

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = ", ".join(f"{k} string" for k in self.keys)
        value = ", ".join(f"{name} {kind}" for name, kind in {"last_id": "bigint", **self.state}.items())
        self.known = handle.getMapState("known", key, value, self.ttl_ms)

    def step(self, rows: pa.Table, groups: Groups, stored: dict[str, pa.Array]) -> tuple[pa.Table, dict[str, pa.Array], np.ndarray]:
        """(what is emitted, new state of each key, which rows count as seen)."""
        raise NotImplementedError

    def late(self, rows: pa.Table) -> pa.Table:
        return rows

    def stateless(self, rows: pa.Table) -> np.ndarray | None:
        """Rows that neither need nor change what is stored."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        schema = pa.schema(self.columns)
        chunks = [pa.RecordBatch.from_pandas(c[list(self.columns)], schema, preserve_index=False) for c in rows]
        table = pa.Table.from_batches(chunks, schema).combine_chunks()
        free = self.stateless(table)
        if free is not None and free.any():
            yield from self.emitted(self.passed(table.filter(pa.array(free))), False)
            table = table.filter(pa.array(~free)).combine_chunks()
        if table.num_rows:
            yield from self.handled(table)

    def passed(self, rows: pa.Table) -> pa.Table:
        return rows

    def handled(self, table: pa.Table) -> Iterator[pd.DataFrame]:
        """Rows by key and id, about ``SLICE`` at a time as if each were a micro-batch, so only what came in is held whole."""
        number = np.zeros(table.num_rows, np.int64)
        for name in self.keys:  # equal keys get equal numbers, a null one included
            codes = pc.fill_null(table[name].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            number = np.unique(number * (table.num_rows + 2) + codes + 1, return_inverse=True)[1]
        ids = table[self.order].to_numpy()
        sort = np.lexsort((ids, number))
        start, n = 0, len(sort)
        empty = next(iter(self.known.keys()), None) is None  # asked once, so that the first micro-batch does not ask for each of its keys
        while start < n:
            end = min(start + SLICE, n)
            while end < n and number[sort[end]] == number[sort[end - 1]] and ids[sort[end]] == ids[sort[end - 1]]:
                end += 1
            at = sort[start:end]
            new = empty and (start == 0 or number[at[0]] != number[sort[start - 1]])  # a key that goes on has been stored by the slice before
            yield from self.sliced(table.take(pa.array(at)).combine_chunks(), number[at], ids[at], empty, new)
            start = end

    def sliced(self, table: pa.Table, number: np.ndarray, ids: np.ndarray, empty: bool = False, new: bool = False) -> Iterator[pd.DataFrame]:
        """``empty``: nothing is stored but, unless ``new``, what the slice before has stored of the first key."""
        groups = Groups(number)
        number = groups.of
        names = list(zip(*[table[k].take(pa.array(groups.starts)).to_pylist() for k in self.keys]))
        asked = names[: 0 if new else 1] if empty else names
        found = [self.known.getValue(name) for name in asked] + [None] * (len(names) - len(asked))
        last = np.array([np.iinfo(np.int64).min if f is None else f[0] for f in found])
        late = ids <= last[groups.of]
        late[1:] |= (number[1:] == number[:-1]) & (ids[1:] == ids[:-1])
        if "late" in self.columns:
            late |= booleans(table["late"])
        if late.any():
            yield from self.emitted(self.late(table.filter(pa.array(late))), True)
            table, number, ids = table.filter(pa.array(~late)).combine_chunks(), number[~late], ids[~late]
        if not table.num_rows:
            return
        live = Groups(number)
        kinds = {"string": TEXT, "bigint": LONG, "boolean": BOOL, "int": pa.int32()}
        had = [found[i] for i in live.keys]
        stored = {
            name: pa.array([None if f is None else f[at] for f in had], kinds[kind]) for at, (name, kind) in enumerate(self.state.items(), 1)
        }
        stored["had"] = pa.array([f is not None for f in had], BOOL)
        out, state, seen = self.step(table, live, stored)
        yield from self.emitted(out, False)
        newest = live.upto(seen)[live.last]
        values = list(zip(*[state[name].to_pylist() for name in self.state]))
        for i, at in enumerate(newest.tolist()):
            if at >= 0:
                self.known.updateValue(names[live.keys[i]], (int(ids[at]), *values[i]))

    def emitted(self, rows: pa.Table, late: bool) -> Iterator[pd.DataFrame]:
        if "late" in rows.column_names:
            rows = rows.drop_columns(["late"])
        rows = rows.append_column("late", pa.array(np.full(rows.num_rows, late)))
        known = set(rows.column_names)
        rows = pa.table({c: rows[c] if c in known else pa.nulls(rows.num_rows) for c in self.output})
        for start in range(0, rows.num_rows, SLICE):
            yield rows.slice(start, SLICE).to_pandas(integer_object_nulls=True)

    @property
    def output(self) -> list[str]:
        return [field.split()[0] for field in self.emits.split(", ")]

    emits = ""

    def close(self) -> None:
        pass


def changed(table: pa.Table, **columns: pa.Array | np.ndarray) -> pa.Table:
    for name, values in columns.items():
        values = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)
        at = table.schema.get_field_index(name)
        table = table.set_column(at, name, values) if at >= 0 else table.append_column(name, values)
    return table


class _BodyVerdict(_Sharded):
    """Per (candidate, body): the verdict a scan sees: its own, else the last one before it.

    A scan that is of no use and has no verdict neither needs one nor leaves one, and is passed on as it is.
    """

    keys = ("candidate_id", "text_hash")
    columns = {
        "scan_id": LONG, "candidate_id": TEXT, "url": TEXT, "page_key": TEXT, "fetched_at": STAMP, "text_hash": TEXT, "http_status": pa.int32(),
        "usable": BOOL, "own_class": TEXT,
    }
    state = {"verdict": "string"}
    emits = (
        "scan_id bigint, candidate_id string, url string, page_key string, fetched_at timestamp, text_hash string, "
        "http_status int, usable boolean, classification string, late boolean"
    )

    def stateless(self, rows):
        return ~booleans(rows["usable"]) & pc.is_null(rows["own_class"]).to_numpy(zero_copy_only=False)

    def passed(self, rows):
        return changed(rows, classification=pa.array([NO_GUIDANCE] * rows.num_rows, TEXT))

    def step(self, rows, groups, stored):
        own = rows["own_class"].combine_chunks()
        at = groups.upto(pc.is_valid(own).to_numpy(zero_copy_only=False))
        verdict = choose(at >= 0, pick(own, at), pick(stored["verdict"], groups.of))
        out = changed(rows, classification=pc.fill_null(verdict, NO_GUIDANCE))
        return out, {"verdict": pick(verdict, groups.last)}, np.ones(groups.n, bool)


class _PageChanges(_Sharded):
    """Per (candidate, page): the state that a new scan is compared with.

    Usable scans cut a page's rows into stretches. In a stretch after positive guidance, the
    second missing page in a row takes it down, once; the usable scan that ends the
    stretch is compared with the one before it, or with the take-down in between.
    """

    keys = ("candidate_id", "page_key")
    columns = {
        "scan_id": LONG, "candidate_id": TEXT, "url": TEXT, "page_key": TEXT, "fetched_at": STAMP, "text_hash": TEXT, "http_status": pa.int32(),
        "usable": BOOL, "classification": TEXT, "late": BOOL,
    }
    state = {"prev_gone": "boolean", "base_id": "bigint", "base_class": "string", "base_hash": "string", "down": "boolean"}
    emits = (
        "candidate_id string, url string, event_type string, prev_scan_id bigint, new_scan_id bigint, "
        "prev_classification string, new_classification string, detected_at timestamp, late boolean"
    )

    def late(self, rows):
        return rows.rename_columns({"scan_id": "new_scan_id", "fetched_at": "detected_at"})

    def step(self, rows, groups, stored):
        n, of = groups.n, groups.of
        ids, hashes, classes = (rows[c].combine_chunks() for c in ("scan_id", "text_hash", "classification"))
        usable = booleans(rows["usable"])
        gone = booleans(pc.is_in(rows["http_status"], pa.array(GONE_STATUSES, pa.int32())))
        positive = booleans(pc.is_in(classes, pa.array(POSITIVE_CLASSES)))
        prev_gone = np.append(False, gone[:-1])[:n]
        prev_gone[groups.starts] = booleans(stored["prev_gone"])

        at = groups.before(usable)
        base_id = choose(at >= 0, pick(ids, at), pick(stored["base_id"], of))
        base_class = choose(at >= 0, pick(classes, at), pick(stored["base_class"], of))
        base_hash = choose(at >= 0, pick(hashes, at), pick(stored["base_hash"], of))
        base_positive = booleans(pc.is_in(base_class, pa.array(POSITIVE_CLASSES)))

        stretch = groups.new.copy()
        stretch[1:] |= usable[:-1]
        stretches = Groups(np.cumsum(stretch))
        falls = gone & prev_gone & base_positive & ~usable
        falls &= stretches.before(falls) < 0
        fell = stretches.before(falls)  # the take-down between a scan and its base
        was_down = (fell >= 0) | (booleans(pick(stored["down"], of)) & (at < 0))
        prev_id = choose(fell >= 0, pick(ids, fell), base_id)
        prev_positive = base_positive & (fell < 0)
        prev_class = choose(fell >= 0, pa.array([NO_GUIDANCE] * n, TEXT), base_class)

        moved = usable & booleans(pc.is_valid(base_id)) & (was_down | ~same_text(base_hash, hashes)) & (positive | prev_positive)
        kind = np.where(falls | (prev_positive & ~positive), "take_down", np.where(prev_positive, "modified", "put_up"))
        events = changed(
            rows, event_type=pa.array(kind.astype(object), TEXT), prev_scan_id=choose(falls, base_id, prev_id), new_scan_id=ids,
            prev_classification=choose(falls, base_class, prev_class),
            new_classification=choose(falls, pa.array([NO_GUIDANCE] * n, TEXT), classes), detected_at=rows["fetched_at"],
        ).filter(pa.array(falls | moved))

        end = groups.last
        kept, down = groups.upto(usable)[end], stretches.upto(falls)[end]
        down = np.where(usable[end], -1, down)
        held = down < 0
        state = {
            "prev_gone": pa.array(gone[end]),
            "base_id": choose(held, choose(kept >= 0, pick(ids, kept), stored["base_id"]), pick(ids, down)),
            "base_class": choose(held, choose(kept >= 0, pick(classes, kept), stored["base_class"]), pa.array([NO_GUIDANCE] * len(end), TEXT)),
            "base_hash": choose(held, choose(kept >= 0, pick(hashes, kept), stored["base_hash"]), pa.nulls(len(end), TEXT)),
            "down": pa.array(~held | (booleans(stored["down"]) & (kept < 0))),
        }
        return events, state, np.ones(n, bool)


class _NewBodies(_Sharded):
    """Per (candidate, page): scans whose body differs from that of the last recorded one; a page that was never there leaves no trace."""

    keys = ("candidate_id", "page_key")
    columns = {"scan_id": LONG, "candidate_id": TEXT, "page_key": TEXT, "text_hash": TEXT, "http_status": pa.int32()}
    state = {"body": "string"}
    emits = "scan_id bigint, candidate_id string, page_key string, text_hash string, late boolean"

    def step(self, rows, groups, stored):
        gone = booleans(pc.is_in(rows["http_status"], pa.array(GONE_STATUSES, pa.int32())))
        had = booleans(stored["had"])[groups.of]
        recorded = had | (groups.upto(~gone) >= 0)
        bodies = rows["text_hash"].combine_chunks()
        at = groups.before(recorded)
        before = choose(at >= 0, pick(bodies, at), pick(stored["body"], groups.of))
        unchanged = booleans(pc.equal(before, bodies)) & (had | (at >= 0))
        kept = groups.upto(recorded)[groups.last]
        return rows.filter(pa.array(recorded & ~unchanged)), {"body": choose(kept >= 0, pick(bodies, kept), stored["body"])}, recorded


class _HostStrikes(_Sharded):
    """Per host: consecutive throttled fetches."""

    order = "seq"
    keys = ("host",)
    columns = {"seq": LONG, "host": TEXT, "http_status": pa.int32(), "retry_after": pa.float64()}
    state = {"strikes": "int"}
    emits = "seq bigint, host string, http_status int, strikes int, backoff_seconds double, abandoned boolean, late boolean"

    def step(self, rows, groups, stored):
        hit = booleans(pc.is_in(rows["http_status"], pa.array(THROTTLE_STATUSES, pa.int32())))
        hits, reset = np.cumsum(hit), groups.upto(~hit)
        carried = pc.fill_null(stored["strikes"], 0).to_numpy(zero_copy_only=False)[groups.of]
        before = np.where(reset >= 0, hits[reset], hits[groups.start] - hit[groups.start] - carried)
        strikes = np.where(hit, hits - before, 0)
        wait = 30.0 * 2.0 ** np.clip(strikes - 1, 0, 4)  # 300 seconds are reached before the exponent is
        given = rows["retry_after"].to_numpy(zero_copy_only=False).astype(float)
        wait = np.minimum(np.where(np.isnan(given), wait, given), 300.0)
        gave_up = strikes >= 3
        out = changed(
            rows, strikes=pa.array(strikes, pa.int32()), backoff_seconds=pa.array(wait, mask=gave_up | (strikes == 0)), abandoned=gave_up
        )
        return out, {"strikes": pa.array(strikes[groups.last], pa.int32())}, np.ones(groups.n, bool)


def _run(df: DataFrame, processor: _Sharded, shards: int, spread: Column | None = None) -> DataFrame:
    shard = F.pmod(F.xxhash64(*processor.keys) if spread is None else spread, F.lit(shards)).cast("int")
    return (
        df.withColumn("_shard", shard)
        .groupBy("_shard")
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=processor.emits,
            outputMode="append",
            timeMode="none" if processor.ttl_ms is None else "processingTime",
        )
    )


def _prepared(scans: DataFrame) -> DataFrame:
    return scans.select(
        "scan_id",
        "candidate_id",
        "url",
        canon_url(F.col("url")).alias("page_key"),
        F.col("fetched_at").cast("timestamp").alias("fetched_at"),
        "text_hash",
        F.col("http_status").cast("int").alias("http_status"),
        usable_scan(F.col("http_status"), F.col("raw_text")).alias("usable"),
        *(["own_class"] if "own_class" in scans.columns else []),
    )


def stream_changes(scans: DataFrame, shards: int = SHARDS, ttl_days: float | None = None) -> DataFrame:
    """Change events of a scan stream that carries each scan's own verdict in ``own_class``.

    Scans that pass the body stage untouched are dealt by page there, so a body that all missing
    pages share is no hot key.
    """
    idle = ~F.col("usable") & F.col("own_class").isNull()
    spread = F.when(idle, F.xxhash64("candidate_id", "page_key")).otherwise(F.xxhash64("candidate_id", "text_hash"))
    judged = _run(_prepared(scans), _BodyVerdict(ttl_days), shards, spread)
    return _run(judged, _PageChanges(ttl_days), shards)


def stream_new_bodies(scans: DataFrame, shards: int = SHARDS, ttl_days: float | None = None) -> DataFrame:
    """Scans whose body changed since the page's last recorded scan."""
    rows = scans.select(
        "scan_id", "candidate_id", canon_url(F.col("url")).alias("page_key"), "text_hash", F.col("http_status").cast("int").alias("http_status")
    )
    return _run(rows, _NewBodies(ttl_days), shards)


def stream_host_strikes(fetch_log: DataFrame, shards: int = SHARDS, ttl_days: float | None = None) -> DataFrame:
    """Strikes, backoff and abandonment per fetch (seq, host, http_status, optional retry_after)."""
    given = F.col("retry_after").cast("double") if "retry_after" in fetch_log.columns else F.lit(None).cast("double")
    rows = fetch_log.select("seq", "host", F.col("http_status").cast("int").alias("http_status"), given.alias("retry_after"))
    return _run(rows, _HostStrikes(ttl_days), shards)
