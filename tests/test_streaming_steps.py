"""The state steps of the streams on their own: against a plain walk over the rows, one hot key, long streaks, expiry."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pagewatch.operators.corpus import host_strikes
from pagewatch.streaming import stateful
from pagewatch.streaming.jobs import run_available

RED, MAYBE, NONE = "red_box_guidance", "ambiguous", "no_guidance_detected"


class Known(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


class Handle:
    def getMapState(self, name, key, value, ttl):
        return Known()


def run(processor, batches, chunk=1000):
    """Rows that come out as dicts; each batch is handed over in chunks, in any order."""
    processor.init(Handle())
    out = []
    for rows in batches:
        frame = pd.DataFrame(rows, columns=list(processor.columns)).astype(object)
        frame[processor.order] = frame[processor.order].astype("int64")
        for emitted in processor.handleInputRows((0,), iter([frame[i : i + chunk] for i in range(0, len(frame), chunk)]), None):
            assert list(emitted.columns) == processor.output
            out += emitted.astype(object).where(emitted.notna(), None).to_dict("records")
    return out


def dealt(rows, batches, rng):
    cuts = sorted(rng.sample(range(len(rows)), batches - 1))
    out = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for part in out:
        rng.shuffle(part)
    return out


def judged_rows(n, rng):
    rows = []
    for i in range(n):
        page = rng.choice("ppppqr")
        status = rng.choice((200, 200, 404, 404, 410, 500, None))
        body = rng.choice(("a", "b", "c", None)) if status == 200 else rng.choice(("x", None))
        rows.append((i, None if page == "r" else "C1", "u", page, pd.Timestamp("2026-01-01"), body, status, status == 200, rng.choice((RED, MAYBE, NONE)), False))
    return rows


def plain_changes(rows):
    state, out = {}, []
    for i, cand, _, page, _, body, status, usable, cls, _ in rows:
        prev, base = state.get((cand, page), (None, None))
        gone, event = status in (404, 410), None
        good = base and base[1] in (RED, MAYBE)
        if usable:
            now = cls in (RED, MAYBE)
            if base and (base[3] or base[2] != body) and (good or now):
                event = ("take_down" if not now else "modified" if good else "put_up", base[0], i, base[1], cls)
            base = (i, cls, body, False)
        elif gone and prev and good:
            event = ("take_down", base[0], i, base[1], NONE)
            base = (i, NONE, None, True)
        state[cand, page] = (gone, base)
        if event:
            out.append(event)
    return sorted(out, key=lambda e: e[2])


@pytest.mark.parametrize("batches", [1, 2, 40])
def test_page_changes(batches):
    rng = random.Random(batches)
    rows = judged_rows(600, rng)
    out = run(stateful._PageChanges(), dealt(list(rows), batches, rng), chunk=37)
    assert not any(r["late"] for r in out)
    got = [(r["event_type"], r["prev_scan_id"], r["new_scan_id"], r["prev_classification"], r["new_classification"]) for r in out]
    assert sorted(got, key=lambda e: e[2]) == plain_changes(rows) and len(got) > 60


@pytest.mark.parametrize("batches", [1, 2, 40])
def test_body_verdicts(batches):
    rng = random.Random(batches)
    rows, want, seen = [], {}, {}
    for i in range(500):
        body, usable, own = rng.choice(("a", "b", None)), rng.random() < 0.7, rng.choice((RED, NONE, None, None))
        rows.append((i, "C", "u", "p", pd.Timestamp("2026-01-01"), body, 200, usable, own))
        seen[body] = own or seen.get(body)
        want[i] = (seen[body] if usable or own else None) or NONE
    out = run(stateful._BodyVerdict(), dealt(rows, batches, rng), chunk=64)
    assert {r["scan_id"]: r["classification"] for r in out} == want and len(out) == 500


@pytest.mark.parametrize("batches", [1, 2, 40])
def test_new_bodies(batches):
    rng = random.Random(batches)
    rows, want, last = [], [], {}
    for i in range(500):
        page, status, body = rng.choice("pqrst"), rng.choice((200, 404, 404, 410)), rng.choice(("a", "b", None))
        rows.append((i, "C", page, body, status))
        if page not in last and status != 200:
            continue
        if page not in last or body is None or last[page] != body:
            want.append(i)
        last[page] = body
    out = run(stateful._NewBodies(), dealt(rows, batches, rng), chunk=64)
    assert sorted(r["scan_id"] for r in out) == want and not any(r["late"] for r in out)


def test_late_and_repeated_ids_change_nothing():
    rows = [(5, "h", 429, None), (6, "h", 429, None)]
    out = run(stateful._HostStrikes(), [rows, [(5, "h", 200, None), (7, "h", 429, None), (7, "h", 200, None)]])
    assert [(r["seq"], r["strikes"], r["late"]) for r in sorted(out, key=lambda r: (r["seq"], r["late"]))] == [
        (5, 1, False), (5, None, True), (6, 2, False), (7, 3, False), (7, None, True),
    ]


def test_five_thousand_strikes_in_a_row(spark, tmp_path):
    rows = [(i, "hot" if i % 10 else "cold", 429 if i != 2500 else 200, None if i % 3 else 7.0) for i in range(5600)]
    log = spark.createDataFrame(rows, "seq long, host string, http_status int, retry_after double")
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    out = run_available(stateful.stream_host_strikes(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    columns = ("seq", "strikes", "backoff_seconds", "abandoned")
    got = sorted(out.select(*columns).collect())
    assert got == sorted(host_strikes(log).select(*columns).collect()) and max(r.strikes for r in got) > 2500


def test_hot_key_is_held_in_columns():
    """A page with a million rows in one batch: a few hundred bytes a row at most, no row objects."""
    n, chunk = 1_000_000, 10_000
    processor = stateful._NewBodies()
    processor.init(Handle())

    def chunks():
        for start in range(0, n, chunk):
            ids = np.arange(start, start + chunk)
            bodies = np.array([f"{i // 1000:064x}" for i in ids], dtype=object)
            yield pd.DataFrame({"scan_id": ids[::-1], "candidate_id": "C", "page_key": "p", "text_hash": bodies[::-1], "http_status": 200})

    tracemalloc.start()
    found = sum(len(frame) for frame in processor.handleInputRows((0,), chunks(), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n // 1000
    assert peak < 200 * n


def test_expiry_lets_a_key_start_anew(spark, tmp_path):
    """With a time to live, a key's state is gone after it; without one it stays."""
    for ttl, strikes in ((None, 2), (1e-7, 1)):
        folder, root = str(tmp_path / f"in{ttl}"), str(tmp_path / f"at{ttl}")
        for seq in (1, 2):
            spark.createDataFrame([(seq, "h", 429)], "seq long, host string, http_status int").write.mode("append").parquet(folder)
            stream = spark.readStream.schema("seq long, host string, http_status int").parquet(folder)
            out = run_available(stateful.stream_host_strikes(stream, shards=2, ttl_days=ttl), f"{root}/out", f"{root}/state")
        assert out.filter("seq = 2").first().strikes == strikes


@pytest.mark.parametrize("size", (1, 2, 7, 40))
def test_slices_of_a_batch_emit_what_the_whole_emits(monkeypatch, size):
    """A shard's rows are taken in slices: keys that go on over slices, repeated and late ids, state from the batch before."""
    rng = random.Random(size)
    judged = [r[:1] + (rng.choice((None, "C1", "C2")),) + r[2:] for r in judged_rows(300, rng)]
    judged += rng.sample(judged, 20)
    strikes = [(i, rng.choice(("a", "b", None)), rng.choice((200, 429, 503)), None) for i in range(300)]
    strikes += rng.sample(strikes, 20)
    bodies = [(r[0], r[1], r[3], r[5], r[6]) for r in judged]
    key = lambda row: repr(sorted(row.items()))
    for kind, rows in ((stateful._PageChanges, judged), (stateful._HostStrikes, strikes), (stateful._NewBodies, bodies)):
        parts = dealt(rows, 3, rng)
        monkeypatch.setattr(stateful, "SLICE", 100_000)
        want = run(kind(), parts)
        monkeypatch.setattr(stateful, "SLICE", size)
        assert sorted(run(kind(), parts), key=key) == sorted(want, key=key)


def test_a_hot_key_is_stepped_through_in_slices(monkeypatch):
    """No step sees more than a slice of a hot host's rows."""
    processor, seen = stateful._HostStrikes(), []
    processor.init(Handle())
    step = processor.step
    monkeypatch.setattr(processor, "step", lambda rows, groups, stored: seen.append(rows.num_rows) or step(rows, groups, stored))
    n = 3 * stateful.SLICE
    frame = pd.DataFrame({"seq": np.arange(n)[::-1], "host": "h", "http_status": 429, "retry_after": None})
    out = pd.concat(processor.handleInputRows((0,), iter([frame]), None))
    assert max(seen) <= stateful.SLICE and sum(seen) == n
    assert (out.strikes == out.seq + 1).all()


@pytest.mark.parametrize("size", [1, 3, 100])
def test_an_empty_store_is_not_asked_for_each_key(monkeypatch, size):
    asked = []
    monkeypatch.setattr(stateful, "SLICE", size)
    monkeypatch.setattr(Known, "getValue", lambda self, key: asked.append(key) or self.get(key))
    rows = [(i, "a", f"p{i // 2}", f"h{i}", 200) for i in range(10)]
    out = run(stateful._NewBodies(), [rows])
    assert [r["scan_id"] for r in out] == list(range(10)) and not any(r["late"] for r in out)
    assert len(asked) == {1: 5, 3: 2, 100: 0}[size]  # only keys that go on in another slice
