"""Calendar lookups and which candidates are due for a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.dates import general_election_date


def lookup_primary_date(candidates: DataFrame, elections: DataFrame) -> DataFrame:
    """Set ``primary_date``: district row, else office row, else statewide.

    A level without a date falls through; a state with no dated row at all
    keeps the date the candidate already has.
    """
    out = candidates
    levels = (("_d", F.concat_ws(":", "office", "district")), ("_o", F.col("office")), ("_s", F.lit("")))
    for name, key in levels:
        rows = elections.select("state", "cycle", F.col("office").alias(f"{name}k"), F.col("primary_date").alias(name))
        rows = rows.filter(F.col(name).isNotNull())
        out = out.withColumn(f"{name}k", key).join(rows, ["state", "cycle", f"{name}k"], "left").drop(f"{name}k")
    found = F.coalesce("_d", "_o", "_s", "primary_date")
    return out.withColumn("primary_date", found).select(*candidates.columns)


def scan_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("candidate_id").agg(
        F.count("*").alias("scan_count"), F.max("fetched_at").alias("last_scanned")
    )


def last_activity(candidates: DataFrame, scans: DataFrame) -> DataFrame:
    """Add ``last_activity``: newest fetch or last concluded attempt."""
    counts = scan_counts(scans).select("candidate_id", "last_scanned")
    return (
        candidates.join(counts, "candidate_id", "left")
        .withColumn("last_activity", F.greatest("last_scanned", "last_attempt_at"))
        .drop("last_scanned")
    )


def due_candidates(
    candidates: DataFrame,
    elections: DataFrame,
    scans: DataFrame,
    today: Column,
    daily_window_days: int = 21,
    default_interval_days: int = 7,
    require_verified: bool = False,
) -> DataFrame:
    """Candidates due today, soonest election first."""
    filings = elections.filter("office = ''").select("state", "cycle", "filing_deadline")
    pool = candidates.filter(
        (F.coalesce("inactive", F.lit(0)) == 0) & (F.coalesce("website_url", F.lit("")) != "")
    )
    if require_verified:
        pool = pool.filter(F.coalesce("url_verified", F.lit(False)))
    general = general_election_date(F.coalesce("cycle", F.year(today)))
    before_primary = F.coalesce(today <= F.col("primary_date"), F.lit(False))
    to_primary = F.when(before_primary, F.datediff("primary_date", today))
    to_general = F.when(~before_primary, F.datediff("general", today))
    daily = F.coalesce("days_to_primary", "days_to_general") <= daily_window_days
    elapsed = F.datediff(today, F.to_date("last_activity"))
    interval = F.when(F.col("cadence") == "daily", 1).otherwise(default_interval_days)
    return (
        last_activity(pool, scans)
        .join(filings, ["state", "cycle"], "left")
        .withColumn("general", general)
        .filter((today <= F.col("general")) & F.coalesce(today >= F.col("filing_deadline"), F.lit(True)))
        .withColumns({"days_to_primary": to_primary, "days_to_general": to_general})
        .withColumn("cadence", F.when(daily, "daily").otherwise("weekly"))
        .withColumns({"elapsed_days": elapsed, "interval_days": interval})
        .filter(F.col("elapsed_days").isNull() | (F.col("elapsed_days") >= F.col("interval_days")))
        .select("candidate_id", "cadence", "days_to_primary", "days_to_general", "elapsed_days", "interval_days")
        .orderBy(F.coalesce("days_to_primary", "days_to_general"), "candidate_id")
    )


def scannable(
    candidates: DataFrame,
    mode: str = "new",
    due: DataFrame | None = None,
    state: str | None = None,
    require_verified: bool = False,
) -> DataFrame:
    """Candidates to scan, in work order.

    ``mode``: 'new' skips concluded attempts, 'rescan' takes all, 'due' takes
    the due set in its own order.
    """
    pool = candidates.filter(F.col("website_url").isNotNull() & (F.coalesce("inactive", F.lit(0)) == 0))
    if state:
        pool = pool.filter(F.col("state") == state.upper())
    if require_verified:
        pool = pool.filter("url_verified")
    if mode == "due":
        order = due.select("candidate_id", F.coalesce("days_to_primary", "days_to_general").alias("_soon"))
        return pool.join(order, "candidate_id").orderBy("_soon", "candidate_id").drop("_soon")
    if mode == "new":
        pool = pool.filter("scan_status is null")
    return pool.orderBy("state", "district", "name", "candidate_id")


def already_attempted(candidates: DataFrame) -> DataFrame:
    """One row: candidates in scope that a 'new' run skips."""
    return candidates.filter(
        F.col("website_url").isNotNull() & (F.coalesce("inactive", F.lit(0)) == 0) & F.col("scan_status").isNotNull()
    ).agg(F.count("*").alias("skipped"))
