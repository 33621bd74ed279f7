"""Table schemas. Money is DECIMAL, timestamps are real timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EVIDENCE = "array<struct<quote:string,why:string>>"

TABLES: dict[str, str] = {
    "candidates": (
        "candidate_id string, name string, office string, state string, district string, party string, "
        "cycle int, universe_reason string, primary_date date, website_url string, url_source string, "
        "url_verified boolean, receipts decimal(18,2), rating string, created_at timestamp, "
        "updated_at timestamp, scan_status string, last_attempt_at timestamp, nominee_source string, "
        "inactive int, last_scan_partial boolean"
    ),
    "elections": (
        "state string, cycle int, office string, primary_date date, filing_deadline date, "
        "source string, runoff_date date"
    ),
    "scans": (
        "scan_id bigint, candidate_id string, url string, fetched_at timestamp, http_status int, "
        "content_type string, render_mode string, raw_text string, text_hash string, "
        "discovered_via string, robots_posture string"
    ),
    "detections": (
        "detection_id bigint, scan_id bigint, candidate_id string, classification string, "
        f"confidence double, evidence {EVIDENCE}, rationale string, model string, "
        "escalated boolean, classified_at timestamp"
    ),
    "archives": (
        "archive_id bigint, candidate_id string, scan_id bigint, detection_id bigint, url string, "
        "screenshot_path string, html_path string, text_path string, pdf_path string, "
        "content_hash string, wayback_url string, wayback_job_id string, archived_at timestamp"
    ),
    "ie_filings": (
        "candidate_id string, committee_id string, committee_name string, payee_name string, "
        "support_oppose_indicator string, expenditure_amount decimal(18,2), expenditure_date date, "
        "dissemination_date date, cycle int, transaction_id string, raw string"
    ),
    "corroboration": (
        "candidate_id string, detection_id bigint, guidance_first_detected timestamp, "
        "supporting_ie_total_after decimal(28,2), supporting_total decimal(28,2), "
        "opposing_total decimal(28,2), ie_filing_count bigint, spender_list array<struct<"
        "committee_id:string,committee_name:string,indicator:string,amount:decimal(28,2),count:bigint,"
        "first_date:date,last_date:date>>, computed_at timestamp"
    ),
    "reviews": (
        "review_id bigint, detection_id bigint, reviewer string, action string, notes string, "
        "reviewed_at timestamp"
    ),
    "change_events": (
        "change_id bigint, candidate_id string, url string, event_type string, prev_scan_id bigint, "
        "new_scan_id bigint, prev_classification string, new_classification string, detected_at timestamp"
    ),
}

# Values of candidates.inactive.
ACTIVE, FEC_INACTIVE, WRONG_RACE, LOST_PRIMARY = 0, 1, 2, 3


def table_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], table_schema(table))


def evolve_schema(df: DataFrame, table: str) -> DataFrame:
    """Add the columns a table has gained since ``df`` was written, as NULLs."""
    return df.unionByName(empty_table(df.sparkSession, table), allowMissingColumns=True)
