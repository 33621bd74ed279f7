"""Page history: verdicts as of a scan, baselines, change events, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.status import NO_GUIDANCE, change_type, is_gone, is_positive, usable_scan
from pagewatch.functions.urls import canon_url
from pagewatch.operators.ordered import BLOCK_ROWS, history_before, latest_per_key
from pagewatch.session import write_through

PAGE = ["candidate_id", "page_key"]
EVENT_COLUMNS = (
    "candidate_id", "url", "event_type", "prev_scan_id", "new_scan_id",
    "prev_classification", "new_classification", "detected_at",
)


def with_page_key(scans: DataFrame) -> DataFrame:
    return scans.withColumn("page_key", canon_url(F.col("url")))


def phantom_404(scans: DataFrame) -> DataFrame:
    """Add ``recorded``: false for 404/410 rows ahead of the page's first other scan."""
    return first_seen(with_page_key(scans))


def first_seen(paged: DataFrame) -> DataFrame:
    """``recorded`` for scans that carry their page key."""
    first = (
        paged.filter(~is_gone(F.col("http_status"))).groupBy(*PAGE).agg(F.min("scan_id").alias("_first"))
    )
    return (
        paged.join(first, PAGE, "left")
        .withColumn("recorded", F.coalesce(F.col("scan_id") >= F.col("_first"), F.lit(False)))
        .drop("_first")
    )


def unchanged_pages(scans: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scan_id, candidate_id, page_key, text_hash, unchanged) of every recorded scan.

    ``unchanged``: the body equals that of the page's previous recorded scan. The narrow
    columns are written once, as page keys are dear and history reads them twice; join
    ``scan_id`` for the rest of a scan.
    """
    narrow = with_page_key(scans).select("scan_id", "candidate_id", "page_key", "http_status", "text_hash")
    narrow = write_through(narrow, "page-bodies")
    recorded = first_seen(narrow).filter("recorded").select("scan_id", *PAGE, "text_hash")
    body = F.struct(F.col("text_hash").alias("h"))
    return (
        history_before(recorded, PAGE, ["scan_id"], prev={"_prev": body}, block_rows=block_rows)
        .withColumn("unchanged", F.coalesce(F.col("_prev.h") == F.col("text_hash"), F.lit(False)))
        .drop("_prev")
    )


def latest_verdict_per_scan(detections: DataFrame) -> DataFrame:
    return detections.groupBy("scan_id").agg(
        F.max_by("classification", "detection_id").alias("own_class")
    )


def verdict_as_of(scans: DataFrame, detections: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``classification`` as the scan saw it: its own verdict, else the body's last earlier one.

    The scans are written once with their own verdicts: pass narrow columns.
    """
    own = scans.join(latest_verdict_per_scan(detections), "scan_id", "left")
    own = write_through(own, "own-verdicts")  # history reads its input twice
    body = ["candidate_id", "text_hash"]
    seen = history_before(own, body, ["scan_id"], last={"_earlier": F.col("own_class")}, block_rows=block_rows)
    verdict = F.coalesce("own_class", "_earlier", F.lit(NO_GUIDANCE))
    return seen.withColumn("classification", verdict).drop("own_class", "_earlier")


def verdict_latest(scans: DataFrame, detections: DataFrame) -> DataFrame:
    """Add ``classification``: the latest verdict of the same body, from any scan."""
    body = ["candidate_id", "text_hash"]
    by_body = (
        detections.select("detection_id", "scan_id", "classification")
        .join(scans.select("scan_id", *body), "scan_id")
        .groupBy(*body)
        .agg(F.max_by("classification", "detection_id").alias("classification"))
    )
    return scans.join(by_body, body, "left").withColumn(
        "classification", F.coalesce("classification", F.lit(NO_GUIDANCE))
    )


def baseline_state(scans: DataFrame, events: DataFrame, detections: DataFrame) -> DataFrame:
    """Last concluded state per page: (ref_scan_id, classification, text_hash).

    The newest usable scan, unless a change event at or after it says otherwise.
    """
    paged = with_page_key(scans).withColumn("usable", usable_scan(F.col("http_status"), F.col("raw_text")))
    return baseline_of(paged, events, detections)


def baseline_of(paged: DataFrame, events: DataFrame, detections: DataFrame) -> DataFrame:
    """``baseline_state`` for scans that carry their page key and whether they are usable."""
    usable = verdict_latest(paged.filter("usable"), detections)
    last_scan = usable.groupBy(*PAGE).agg(
        F.max_by(F.struct("scan_id", "classification", "text_hash"), "scan_id").alias("u")
    )
    last_event = with_page_key(events).groupBy(*PAGE).agg(
        F.max_by(F.struct("new_scan_id", "new_classification"), "change_id").alias("e")
    )
    event_wins = F.col("u").isNull() | F.coalesce(F.col("e.new_scan_id") >= F.col("u.scan_id"), F.lit(False))
    return last_scan.join(last_event, PAGE, "full_outer").select(
        *PAGE,
        F.when(event_wins, F.col("e.new_scan_id")).otherwise(F.col("u.scan_id")).alias("ref_scan_id"),
        F.when(event_wins, F.col("e.new_classification")).otherwise(F.col("u.classification")).alias("classification"),
        F.when(~event_wins, F.col("u.text_hash")).alias("text_hash"),
    )


def replay_changes(scans: DataFrame, detections: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Change events implied by the full scan history.

    One ordered pass per page yields, for every row, the previous status and
    the last usable scan. A take-down is the earliest second-in-a-row 404/410
    after a positive usable scan. Every later usable scan is compared with the
    scan before it, or with the take-down that came in between.
    """
    log = with_page_key(scans).select(
        "scan_id",
        "candidate_id",
        "url",
        "page_key",
        "fetched_at",
        "text_hash",
        usable_scan(F.col("http_status"), F.col("raw_text")).alias("usable"),
        is_gone(F.col("http_status")).alias("gone"),
    )
    log = write_through(verdict_as_of(log, detections, block_rows), "history")
    anchor = F.when(F.col("usable"), F.struct("scan_id", "classification", "text_hash"))
    steps = history_before(
        log, PAGE, ["scan_id"], prev={"prev": F.struct("gone")}, last={"base": anchor}, block_rows=block_rows
    )
    steps = write_through(steps, "steps")

    vanished = steps.filter(
        F.col("gone") & F.col("prev.gone") & is_positive(F.col("base.classification"))
    ).groupBy(*PAGE, F.col("base.scan_id").alias("base_scan_id"))
    take_downs = vanished.agg(
        F.min_by(F.struct("scan_id", "url", "fetched_at"), "scan_id").alias("row"),
        F.first("base.classification").alias("base_class"),
    )
    down_events = take_downs.select(
        "candidate_id",
        F.col("row.url").alias("url"),
        F.lit("take_down").alias("event_type"),
        F.col("base_scan_id").alias("prev_scan_id"),
        F.col("row.scan_id").alias("new_scan_id"),
        F.col("base_class").alias("prev_classification"),
        F.lit(NO_GUIDANCE).alias("new_classification"),
        F.col("row.fetched_at").alias("detected_at"),
    )

    downs = take_downs.select(*PAGE, "base_scan_id", F.col("row.scan_id").alias("down_scan_id"))
    moved = steps.filter(
        F.col("usable")
        & F.col("base").isNotNull()
        & (is_positive(F.col("classification")) | is_positive(F.col("base.classification")))
    ).withColumn("base_scan_id", F.col("base.scan_id"))
    compared = moved.join(downs, [*PAGE, "base_scan_id"], "left")
    was_down = F.col("down_scan_id").isNotNull()
    prev_class = F.when(was_down, NO_GUIDANCE).otherwise(F.col("base.classification"))
    scan_events = (
        compared.filter(was_down | ~F.col("base.text_hash").eqNullSafe(F.col("text_hash")))
        .select(
            "candidate_id",
            "url",
            change_type(prev_class, F.col("classification")).alias("event_type"),
            F.coalesce("down_scan_id", "base_scan_id").alias("prev_scan_id"),
            F.col("scan_id").alias("new_scan_id"),
            prev_class.alias("prev_classification"),
            F.col("classification").alias("new_classification"),
            F.col("fetched_at").alias("detected_at"),
        )
        .filter("event_type is not null")
    )
    return down_events.unionByName(scan_events).select(*EVENT_COLUMNS)


def reconcile_events(expected: DataFrame, recorded: DataFrame) -> DataFrame:
    """Compare replayed with recorded events by (candidate_id, url, new_scan_id).

    Rows are missing, spurious or mismatched; agreeing events are left out.
    """
    keys = ["candidate_id", "url", "new_scan_id"]
    payload = ["event_type", "prev_scan_id", "prev_classification", "new_classification", "detected_at"]
    have = latest_per_key(recorded, keys, [F.col("change_id").desc()])
    left = expected.select(*keys, F.struct(*payload).alias("want"))
    right = have.select(*keys, F.struct("change_id", *payload).alias("have"))
    checked = ("event_type", "prev_classification", "new_classification")
    differs = F.lit(False)
    for c in checked:
        differs = differs | ~F.col(f"want.{c}").eqNullSafe(F.col(f"have.{c}"))
    status = (
        F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "spurious").when(differs, "mismatched")
    )
    return (
        left.join(right, keys, "full_outer")
        .withColumn("status", status)
        .filter("status is not null")
        .select(
            *keys,
            "status",
            F.col("have.change_id").alias("change_id"),
            F.col("have.event_type").alias("recorded_event_type"),
            *[F.col(f"want.{c}").alias(c) for c in payload],
        )
    )


def apply_reconciliation(recorded: DataFrame, differences: DataFrame) -> DataFrame:
    """Recorded events with spurious ones deleted, mismatches corrected and missing ones added.

    Added events have no ``change_id`` yet; the table writer assigns it.
    """
    touched = differences.filter("change_id is not null").select("change_id")
    kept = recorded.join(touched, "change_id", "left_anti")
    written = differences.filter("status <> 'spurious'").select("change_id", *EVENT_COLUMNS)
    return kept.select("change_id", *EVENT_COLUMNS).unionByName(written)
