"""Diff a new sweep against history, and reconcile recorded events with a replay."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.status import NO_GUIDANCE, change_type, is_gone, is_positive, usable_scan
from pagewatch.functions.text import strip
from pagewatch.operators.changes import (
    PAGE, apply_reconciliation, baseline_of, reconcile_events, replay_changes, with_page_key,
)
from pagewatch.operators.corpus import Scorer, classify_pages, prefilter, scan_outcome
from pagewatch.session import write_through


def sweep_decisions(
    batch: DataFrame, history: DataFrame, events: DataFrame, detections: DataFrame
) -> DataFrame:
    """What happens to each page of a sweep before anything is classified.

    ``batch`` holds one scan per page. Adds recorded, unchanged, usable, the
    baseline (base_scan_id, base_class, base_hash), prev_status and ``action``:
    drop / unchanged / empty / prefiltered / reuse / classify. Texts are left out: join them
    by ``scan_id`` where a page is classified.
    """
    facts = with_page_key(history).select(
        "scan_id", *PAGE, "text_hash", "http_status", usable_scan(F.col("http_status"), F.col("raw_text")).alias("usable")
    )
    facts = write_through(facts, "sweep-history")  # page keys are dear, and history is read three times
    last = facts.groupBy(*PAGE).agg(F.max_by(F.struct("text_hash", "http_status"), "scan_id").alias("prev"))
    base = baseline_of(facts, events, detections).select(
        *PAGE,
        F.col("ref_scan_id").alias("base_scan_id"),
        F.col("classification").alias("base_class"),
        F.col("text_hash").alias("base_hash"),
    )
    usable = usable_scan(F.col("http_status"), F.col("raw_text"))
    empty = (strip(F.coalesce("raw_text", F.lit(""))) == "") | ~F.coalesce(F.col("http_status") == 200, F.lit(False))
    wants = F.col("recorded") & ~F.col("unchanged") & ~F.col("empty") & (is_positive(F.col("base_class")) | F.col("scan"))
    rows = (
        prefilter(with_page_key(batch))
        .join(last, PAGE, "left")
        .join(base, PAGE, "left")
        .withColumns(
            {
                "recorded": ~(F.col("prev").isNull() & is_gone(F.col("http_status"))),
                "unchanged": F.coalesce(F.col("prev.text_hash") == F.col("text_hash"), F.lit(False)),
                "usable": usable,
                "empty": empty,
                "prev_status": F.col("prev.http_status"),
            }
        )
        .withColumn("wants", wants)
    )
    rows = write_through(rows.drop("prev", "score", "reason", "raw_text"), "sweep")
    body = ["candidate_id", "text_hash"]
    leader = rows.filter("wants").groupBy(*body).agg(F.min("scan_id").alias("lead_scan_id"))
    after_lead = F.coalesce(F.col("scan_id") > F.col("lead_scan_id"), F.lit(False))
    action = (
        F.when(~F.col("recorded"), "drop")
        .when(F.col("unchanged"), "unchanged")
        .when(F.col("empty"), "empty")
        .when(after_lead, "reuse")
        .when(F.col("wants"), "classify")
        .otherwise("prefiltered")
    )
    return rows.join(leader, body, "left").withColumn("action", action).withColumn("readable", ~F.col("empty")).drop("scan", "empty")


def diff_scans(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Change events of a sweep.

    ``verdicts``: scan_id, classification for the pages whose action is
    'classify'. A page without a verdict failed to classify: it and the pages
    that would reuse it are left out and return on the next sweep.
    """
    known = verdicts.select(F.col("scan_id").alias("lead_scan_id"), F.col("classification").alias("verdict"))
    rows = decisions.filter("recorded").join(known, "lead_scan_id", "left")
    judged = F.col("action").isin("classify", "reuse")
    new_class = F.when(judged, F.col("verdict")).otherwise(NO_GUIDANCE)
    changed = F.col("usable") & ~F.col("unchanged") & ~F.col("base_hash").eqNullSafe(F.col("text_hash"))
    vanished = (
        ~F.col("usable")
        & is_gone(F.col("http_status"))
        & is_gone(F.col("prev_status"))
        & is_positive(F.col("base_class"))
    )
    event = F.when(changed, change_type(F.col("base_class"), new_class)).when(vanished, "take_down")
    return (
        rows.filter(F.col("base_scan_id").isNotNull() & ~(judged & F.col("verdict").isNull()))
        .withColumn("event_type", event)
        .filter("event_type is not null")
        .select(
            "candidate_id",
            "url",
            "event_type",
            F.col("base_scan_id").alias("prev_scan_id"),
            F.col("scan_id").alias("new_scan_id"),
            F.col("base_class").alias("prev_classification"),
            F.when(vanished, NO_GUIDANCE).otherwise(new_class).alias("new_classification"),
            F.col("fetched_at").alias("detected_at"),
        )
    )


class Sweep(NamedTuple):
    """What one sweep adds: each table is ready to be appended."""

    scans: DataFrame
    detections: DataFrame
    events: DataFrame
    outcome: DataFrame
    quarantine: DataFrame


def run_sweep(
    batch: DataFrame,
    history: DataFrame,
    events: DataFrame,
    detections: DataFrame,
    robots_blocked: DataFrame,
    first: Scorer | None = None,
    second: Scorer | None = None,
    chunk_chars: int = 40_000,
) -> Sweep:
    """Decide, classify and diff one sweep.

    The first page of each new body is classified. Where that fails, nothing is recorded
    of the page, so the next sweep meets it again, and the next page with the same body
    is tried; later pages reuse the verdict found. The rounds end when no failed body has
    a page left. ``outcome`` has a row per candidate of the batch.
    """
    body = ["candidate_id", "text_hash"]
    rows = sweep_decisions(batch, history, events, detections).drop("lead_scan_id", "action")
    wanted = write_through(rows.filter("wants").select("scan_id", *body), "sweep-wanted")
    texts = batch.select(F.col("scan_id").alias("page_id"), F.coalesce("raw_text", F.lit("")).alias("text"))
    leads = wanted.groupBy(*body).agg(F.min("scan_id").alias("scan_id"))
    found: DataFrame | None = None
    failed: DataFrame | None = None
    while True:
        leads = write_through(leads, "sweep-leads")
        pages = texts.join(leads.select(F.col("scan_id").alias("page_id")), "page_id", "left_semi")
        good, bad = classify_pages(pages, first, second, chunk_chars)
        good = write_through(good.join(leads.withColumnRenamed("scan_id", "page_id"), "page_id"), "sweep-found")
        bad = write_through(bad.join(leads.withColumnRenamed("scan_id", "page_id"), "page_id"), "sweep-failed")
        found = good if found is None else found.unionByName(good)
        failed = bad if failed is None else failed.unionByName(bad)
        again = bad.select(*body, F.col("page_id").alias("_failed"))
        leads = wanted.join(again, body).filter("scan_id > _failed").groupBy(*body).agg(F.min("scan_id").alias("scan_id"))
        if bad.isEmpty() or leads.isEmpty():
            break
    lost = failed.select(F.col("page_id").alias("scan_id"), F.lit(True).alias("lost"))
    lead = found.select(*body, F.col("page_id").alias("lead_scan_id"))
    action = (
        F.when(~F.col("recorded"), "drop")
        .when(F.col("unchanged"), "unchanged")
        .when(F.col("lost"), "failed")
        .when(~F.col("readable"), "empty")
        .when(F.col("scan_id") == F.col("lead_scan_id"), "classify")
        .when(F.col("scan_id") > F.col("lead_scan_id"), "reuse")
        .otherwise("prefiltered")
    )
    rows = rows.join(lead, body, "left").join(lost, "scan_id", "left").withColumn("action", action)
    rows = write_through(rows.drop("lost"), "sweep-actions")
    kept = rows.filter("action <> 'failed'")
    changes = write_through(
        diff_scans(kept, found.select(F.col("page_id").alias("scan_id"), "classification")), "sweep-events"
    )
    verdicts = found.withColumnRenamed("page_id", "scan_id").drop("text_hash")
    appended = kept.filter("recorded").select("scan_id")
    concluded = F.col("action") != "failed"
    pages = (
        rows.select("scan_id", "candidate_id", "action", "recorded", "usable")
        .join(verdicts.select("scan_id", "classification"), "scan_id", "left")
        .join(changes.select(F.col("new_scan_id").alias("scan_id"), "event_type"), "scan_id", "left")
        .select(
            "candidate_id", "classification", "event_type",
            F.when(concluded, F.col("recorded")).alias("recorded"), F.when(concluded, F.col("usable")).alias("usable"),
            (F.col("action") == "prefiltered").alias("prefiltered"), (F.col("action") == "reuse").alias("deduped"),
        )
    )
    return Sweep(
        scans=batch.join(appended, "scan_id", "left_semi"),
        detections=verdicts,
        events=changes,
        outcome=scan_outcome(pages, robots_blocked),
        quarantine=failed.withColumnRenamed("page_id", "scan_id").drop("text_hash"),
    )


def replay_and_reconcile(
    scans: DataFrame, detections: DataFrame, recorded: DataFrame, apply: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(differences, events): the events are corrected when ``apply`` is set."""
    differences = reconcile_events(replay_changes(scans, detections), recorded)
    return differences, apply_reconciliation(recorded, differences) if apply else recorded
