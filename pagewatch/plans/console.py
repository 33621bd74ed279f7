"""Tables behind the human review console."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagewatch.operators.review import (
    cross_attribution_twins, multi_attribution_hashes, pending_detections, pending_queue, recent_decisions,
    richest_first, template_siblings, url_queue, work_order,
)


def review_console_tables(
    detections: DataFrame, scans: DataFrame, candidates: DataFrame, reviews: DataFrame
) -> dict[str, DataFrame]:
    return {
        "queue": work_order(pending_queue(detections, scans, candidates, reviews)),
        "pending": pending_detections(detections, scans, candidates, reviews),
        "siblings": template_siblings(detections, scans, reviews),
        "twins": cross_attribution_twins(detections, scans, candidates, reviews),
        "shared_bodies": multi_attribution_hashes(detections, scans),
        "url_queue": richest_first(url_queue(candidates)),
        "recent": recent_decisions(reviews, detections, candidates),
    }
