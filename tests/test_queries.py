"""Registered queries against DuckDB. PAGEWATCH_ALL=1 runs every one of them."""

import os

import pytest

from pagewatch.catalog import CASES
from tests.compare import check, duck

FOLDER = "/root/testdata/sf0.001"
CORE = (
    "norm_party", "norm_district", "canon_url", "signal_score", "classifier_text", "reason_label", "parse_verdict",
    "contested_universe", "crosswalk", "resolve_nominees", "flag_losers", "due_candidates", "resolution_chain",
    "phantom_404", "unchanged_pages", "replay_changes", "reconcile_events", "diff_scans", "corroborate",
    "pending_queue", "cross_attribution_twins", "candidate_views", "exhibit_timeline", "rank_index", "feed_items",
    "feed_delta", "chunk_pages", "classify_pages", "sitemap_urls", "robots_audit", "host_strikes", "crawl_plan_throttled", "append_reviews",
    "append_reviews_refused", "apply_triage_refused", "extract_text", "stratified_sample", "feed_json_rows",
    "stream_host_strikes",
)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(CASES) if os.environ.get("PAGEWATCH_ALL") else CORE)
def test_query(spark, con, name):
    ok, message = check(spark, con, FOLDER, name)
    assert ok, message


def test_contract_names():
    assert all(n == n.lower() for n in CASES)
    unchecked = {n for n, c in CASES.items() if c.oracle is None}
    assert not unchecked
