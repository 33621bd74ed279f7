"""Ordered operators against plain sequential code, with tiny blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagewatch.operators.changes import replay_changes, unchanged_pages
from pagewatch.operators.corpus import host_strikes
from pagewatch.operators.ordered import global_rank, history_before
from pagewatch.streaming import stateful
from pagewatch.streaming.jobs import run_available, stream_feed_delta

POSITIVE = ("red_box_guidance", "ambiguous")
T0 = dt.datetime(2026, 1, 1)


def make_history(seed, n=400, pages=4, hot=True):
    """Scans (one candidate holds most of them) and detections."""
    rng = random.Random(seed)
    scans, dets = [], []
    for i in range(n):
        cand = "A" if hot and rng.random() < 0.7 else rng.choice("BCD")
        page = rng.randrange(pages)
        url = rng.choice(("https://www.", "http://")) + f"site{cand}.example/p{page}" + rng.choice(("", "/"))
        status = rng.choice((200, 200, 200, 404, 404, 410, 403, 500))
        body = "" if status != 200 else rng.choice(("one", "two", "three", "Just a moment...", "\n"))
        scans.append((i, cand, url, T0 + dt.timedelta(minutes=i), status, body, f"h{body}"))
        if status == 200 and rng.random() < 0.5:
            for _ in range(rng.choice((1, 1, 2))):
                cls = rng.choice((*POSITIVE, "no_guidance_detected"))
                dets.append((len(dets), i, cand, cls))
    return scans, dets


def frames(spark, scans, dets):
    s = spark.createDataFrame(
        scans, "scan_id long, candidate_id string, url string, fetched_at timestamp, http_status int, raw_text string, text_hash string"
    )
    d = spark.createDataFrame(dets, "detection_id long, scan_id long, candidate_id string, classification string")
    return s, d


def event_rows(df):
    cols = ("candidate_id", "url", "event_type", "prev_scan_id", "new_scan_id", "prev_classification", "new_classification")
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def told(spark, *steps):
    """Events of one page of one candidate: steps are (status, body, verdict or None)."""
    scans = [(i, "A", "https://a.example/p", T0 + dt.timedelta(hours=i), status, body, f"h{body}") for i, (status, body, _) in enumerate(steps)]
    dets = [(i, i, "A", cls) for i, (_, _, cls) in enumerate(steps) if cls]
    return [(r[2], r[3], r[4], r[5], r[6]) for r in event_rows(replay_changes(*frames(spark, scans, dets)))]


RED, MAYBE, NONE = "red_box_guidance", "ambiguous", "no_guidance_detected"


@pytest.mark.parametrize(
    "steps,events",
    [
        # guidance appears, changes, and goes with its text
        ([(200, "a", NONE), (200, "b", RED), (200, "c", MAYBE), (200, "d", NONE)],
         [("modified", 1, 2, RED, MAYBE), ("put_up", 0, 1, NONE, RED), ("take_down", 2, 3, MAYBE, NONE)]),
        # the same body is no change; a body without a verdict of its own keeps that of its earlier scan
        ([(200, "a", RED), (200, "a", None), (200, "b", NONE), (200, "a", None)],
         [("put_up", 2, 3, NONE, RED), ("take_down", 1, 2, RED, NONE)]),
        # one missing page is nothing, two in a row take the guidance down, a third says no more
        ([(200, "a", RED), (404, "", None), (200, "a", None), (404, "", None), (410, "", None), (404, "", None)],
         [("take_down", 2, 4, RED, NONE)]),
        # errors, challenges and blank pages between do not count, but they part the missing ones
        ([(200, "a", RED), (500, "x", None), (404, "", None), (503, "", None), (404, "", None), (200, "Just a moment...", None), (200, "\n", None)], []),
        # after a take-down the page counts as without guidance
        ([(200, "a", RED), (404, "", None), (404, "", None), (200, "a", None)],
         [("put_up", 2, 3, NONE, RED), ("take_down", 0, 2, RED, NONE)]),
        # nothing stands before the first scan
        ([(404, "", None), (404, "", None), (200, "a", RED)], []),
    ],
)
def test_replay_by_hand(spark, steps, events):
    assert sorted(told(spark, *steps)) == sorted(events)


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 50)])
def test_replay_does_not_depend_on_blocks(spark, seed, block):
    s, d = frames(spark, *make_history(seed))
    whole = event_rows(replay_changes(s, d))
    assert len(whole) > 30 and event_rows(replay_changes(s, d, block_rows=block)) == whole


def test_stream_matches_batch_over_several_batches(spark, tmp_path):
    scans, dets = make_history(9, n=240)
    s, d = frames(spark, scans, dets)
    own = d.groupBy("scan_id").agg(F.max_by("classification", "detection_id").alias("own_class"))
    tagged = s.join(own, "scan_id", "left")
    folder = str(tmp_path / "in")
    stream = None
    for low, high in ((0, 100), (100, 101), (101, 240)):
        tagged.filter(f"scan_id >= {low} and scan_id < {high}").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(tagged.schema).parquet(folder)
        out = run_available(stateful.stream_changes(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert event_rows(out.filter("not late")) == event_rows(replay_changes(s, d))
    assert out.filter("late").count() == 0
    # an id that was already passed is reported and changes nothing
    tagged.filter("scan_id = 5").coalesce(1).write.mode("append").parquet(folder)
    out = run_available(stateful.stream_changes(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    late = out.filter("late").collect()
    assert [r["new_scan_id"] for r in late] == [5]


@pytest.mark.parametrize("block", [3, 1000])
def test_unchanged_pages(spark, block):
    scans, dets = make_history(4, n=200)
    s, _ = frames(spark, scans, dets)
    want, last = {}, {}
    for scan_id, cand, url, _, status, _, h in sorted(scans):
        key = (cand, url.split("//")[1].removeprefix("www.").rstrip("/"))
        if key not in last and status in (404, 410):
            continue
        want[scan_id] = last.get(key) == h
        last[key] = h
    got = {r["scan_id"]: r["unchanged"] for r in unchanged_pages(s, block).select("scan_id", "unchanged").collect()}
    assert got == want


@pytest.mark.parametrize("block", [2, 13, 1000])
def test_history_before(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice("aaab"), rng.choice((None, None, i))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, v int")
    out = history_before(df, ["k"], ["id"], prev={"p": F.struct("id")}, last={"l": F.col("v")}, block_rows=block)
    want, prev, last = {}, {}, {}
    for i, k, v in rows:
        want[i] = (prev.get(k), last.get(k))
        prev[k] = i
        if v is not None:
            last[k] = v
    assert {r["id"]: (r["p"]["id"] if r["p"] else None, r["l"]) for r in out.collect()} == want


@pytest.mark.parametrize("block", [3, 1000])
def test_host_strikes(spark, block):
    rng = random.Random(7)
    rows = [(i, rng.choice("xxxy"), rng.choice((429, 503, 200)), rng.choice((None, 2.0, 86400.0))) for i in range(200)]
    out = host_strikes(spark.createDataFrame(rows, "seq long, host string, http_status int, retry_after double"), block)
    streak, want = {}, {}
    for seq, host, status, retry in rows:
        n = streak[host] = streak.get(host, 0) + 1 if status in (429, 503) else 0
        wait = min(retry if retry is not None else 30.0 * 2 ** (n - 1), 300.0) if 0 < n < 3 else None
        want[seq] = (n, wait, n >= 3)
    assert {r["seq"]: (r["strikes"], r["backoff_seconds"], r["abandoned"]) for r in out.collect()} == want


def in_batches(spark, df, order, cuts, tmp_path, job):
    """The output of a streaming job that gets ``df`` in several micro-batches, one run each."""
    folder, out = str(tmp_path / "in"), None
    for low, high in zip(cuts, cuts[1:]):
        df.filter((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        out = run_available(job(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    return out


def test_stream_host_strikes_over_several_batches(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, rng.choice("xxxy"), rng.choice((429, 503, 200)), rng.choice((None, 2.0))) for i in range(150)]
    log = spark.createDataFrame(rows, "seq long, host string, http_status int, retry_after double")
    out = in_batches(spark, log, "seq", (0, 40, 41, 110, 150), tmp_path, stateful.stream_host_strikes)
    columns = ("seq", "strikes", "backoff_seconds", "abandoned")
    assert sorted(out.select(*columns).collect()) == sorted(host_strikes(log).select(*columns).collect())
    assert out.filter("late").count() == 0


def test_stream_new_bodies_over_several_batches(spark, tmp_path):
    s, _ = frames(spark, *make_history(23, n=160))
    out = in_batches(spark, s, "scan_id", (0, 50, 51, 160), tmp_path, stateful.stream_new_bodies)
    want = unchanged_pages(s).filter("not unchanged").select("scan_id").collect()
    assert sorted(r.scan_id for r in out.filter("not late").collect()) == sorted(r.scan_id for r in want)


def test_scratch_job_deletes_its_intermediates(spark):
    import os

    from pagewatch import session

    with session.scratch_job(spark):
        kept = session.write_through(spark.range(5), "probe")
        folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
        assert kept.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_scratch_jobs_of_two_threads_keep_to_their_own(spark):
    import threading

    from pagewatch import session

    ready, done, seen = threading.Event(), threading.Event(), {}

    def other():
        with session.scratch_job(spark):
            kept = session.write_through(spark.range(7), "other")
            ready.set()
            done.wait(60)
            seen["rows"] = kept.count()

    thread = threading.Thread(target=other)
    with session.scratch_job(spark):
        session.write_through(spark.range(3), "mine").count()
        thread.start()
        assert ready.wait(60)
    done.set()
    thread.join(60)
    assert seen == {"rows": 7}


def test_global_rank_spreads_and_counts(spark):
    df = spark.range(1000).withColumn("k", F.lit("same"))
    ranked = global_rank(df, [F.col("k"), F.col("id").desc()])
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {i: 1000 - i for i in range(1000)}


def test_feed_delta_bootstrap_flood_and_cap(spark, tmp_path):
    def batch(ids):
        rows = [(i, n) for n, i in enumerate(ids, 1)]
        spark.createDataFrame(rows, "id string, position int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, position int").parquet(str(tmp_path / "in"))
        stream_feed_delta(stream, str(tmp_path / "posted"), str(tmp_path / "acts"), str(tmp_path / "ck")).awaitTermination()
        done = spark.read.parquet(str(tmp_path / "acts"))
        top = done.agg(F.max("batch")).first()[0]
        return {r["id"]: r["action"] for r in done.filter(F.col("batch") == top).collect()}

    first = [f"C{i}#a" for i in range(20)]
    assert set(batch(first).values()) == {"bootstrap"}
    # a re-keyed feed with two newcomers: known candidates are absorbed, newcomers post
    rekeyed = [f"C{i}#b" for i in range(20)] + ["N1#x", "N2#x"]
    acts = batch(rekeyed)
    assert acts["N1#x"] == acts["N2#x"] == "post"
    assert sum(a == "absorb" for a in acts.values()) == 20
    # seven new: the five oldest (largest position) post, two wait and come back
    seven = [f"M{i}#x" for i in range(7)]
    acts = batch(seven)
    assert [i for i in seven if acts[i] == "wait"] == ["M0#x", "M1#x"]
    assert batch(["M0#x", "M1#x"]) == {"M0#x": "post", "M1#x": "post"}
