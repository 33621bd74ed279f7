"""Candidate views: everything a published page needs, as a handful of tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.status import usable_scan
from pagewatch.operators.ordered import latest_per_key
from pagewatch.operators.publish import (
    ADDRESS, BODY, body_detections, body_first_seen, collapse_aliases, compared_scans, exhibit_detections, exhibit_events,
    exhibit_timeline, exhibit_urls, exhibit_versions, gone_since, lastmod, modified_event_context, publishable, scans_of, top_detection,
    url_live_state, view_label, view_status, watched_addresses,
)
from pagewatch.operators.review import ranked_detections
from pagewatch.operators.schedule import scan_counts
from pagewatch.session import write_through


class Views:
    """``views`` has one row per candidate; the rest hang off (candidate_id, text_hash).

    A table is worked out when it is first asked for, with only the intermediates that it needs; those that several tables need
    are written once. ``scans`` is read twice for all of them: its narrow columns, and the texts of the few scans that need them.
    """

    def __init__(
        self,
        candidates: DataFrame,
        scans: DataFrame,
        detections: DataFrame,
        reviews: DataFrame,
        archives: DataFrame,
        corroboration: DataFrame,
        events: DataFrame,
    ):
        self.candidates, self.scans, self.detections, self.reviews = candidates, scans, detections, reviews
        self.archives, self.corroboration, self.events = archives, corroboration, events

    def _statuses(self, scans: DataFrame, top: DataFrame) -> DataFrame:
        """Publishable candidates with scan counts, top verdict, money and status."""
        money = latest_per_key(self.corroboration, ["candidate_id"], [F.col("computed_at").desc()]).select(
            "candidate_id", "supporting_total"
        )
        return (
            publishable(self.candidates, self.detections, self.reviews)
            .join(scan_counts(scans), "candidate_id", "left")
            .withColumn("scan_count", F.coalesce("scan_count", F.lit(0)))
            .join(top, "candidate_id", "left")
            .join(money, "candidate_id", "left")
            .withColumn("status", view_status())
        )

    @cached_property
    def standing(self) -> DataFrame:
        """The candidates of ``views`` with their status and money alone: from narrow columns, nothing is written for it."""
        top = top_detection(ranked_detections(self.detections, self.scans, self.reviews))
        return self._statuses(self.scans, top.select("candidate_id", "classification", "action"))

    @cached_property
    def _facts(self) -> DataFrame:
        return write_through(self.scans.select("scan_id", "candidate_id", "url", "text_hash", "fetched_at", "http_status"), "facts")

    @cached_property
    def _ranked(self) -> DataFrame:
        return write_through(ranked_detections(self.detections, self._facts, self.reviews), "ranked")

    @cached_property
    def _newest_archive(self) -> DataFrame:
        return latest_per_key(
            self.archives.filter("detection_id is not null"),
            ["detection_id"],
            [F.col("archived_at").desc(), F.col("archive_id").desc()],
        ).select("detection_id", "archive_id")

    @cached_property
    def _exhibit_rows(self) -> DataFrame:
        return write_through(exhibit_detections(self._ranked), "exhibit-rows")

    @cached_property
    def _collapsed(self) -> DataFrame:
        return write_through(collapse_aliases(self._exhibit_rows), "exhibits")

    @cached_property
    def urls(self) -> DataFrame:
        return write_through(exhibit_urls(self._exhibit_rows, self._collapsed), "addresses")

    @cached_property
    def _texts(self) -> DataFrame:
        """Scans of watched addresses and those that events compare: these keep their text, the others what it says of the page."""
        watched = self._facts.join(watched_addresses(self._ranked), ADDRESS, "left_semi").select("scan_id", F.lit(True).alias("watched"))
        compared = compared_scans(self.events).withColumn("compared", F.lit(True))
        needed = watched.join(compared, "scan_id", "full_outer")
        facts = ["candidate_id", "url", "text_hash", "fetched_at"]
        texts = scans_of(needed, self.scans, *facts, "http_status", "raw_text").select(
            "scan_id", *facts, "watched", usable_scan(F.col("http_status"), F.col("raw_text")).alias("usable"),
            F.when(F.col("compared"), F.col("raw_text")).alias("raw_text"),
        )
        return write_through(texts, "texts")

    @cached_property
    def _gone(self) -> DataFrame:
        live = self._texts.filter("watched").drop("raw_text")
        return write_through(gone_since(self.urls, url_live_state(live, self._ranked, self.events)), "gone")

    @cached_property
    def versions(self) -> DataFrame:
        return exhibit_versions(self._collapsed, self.urls, body_detections(self._ranked), body_first_seen(self._facts, self._ranked))

    @cached_property
    def timeline(self) -> DataFrame:
        events = write_through(exhibit_events(self.events, self.urls), "exhibit-events")
        modified = modified_event_context(events, self._texts, self._ranked).select(*events.columns, "guidance_same")
        others = events.filter("not event_type <=> 'modified'").withColumn("guidance_same", F.lit(None).cast("boolean"))
        changes = modified.unionByName(others)
        return exhibit_timeline(self._collapsed, self.urls, changes, self.versions, self._gone)

    @cached_property
    def exhibits(self) -> DataFrame:
        return write_through(
            self._collapsed.join(self._gone, BODY, "left")
            .join(self._newest_archive, "detection_id", "left")
            .withColumn("approved", F.coalesce(F.col("action") == "approve", F.lit(False))),
            "shown",
        )

    @cached_property
    def views(self) -> DataFrame:
        top = top_detection(self._ranked).select(
            "candidate_id", "detection_id", "classification", "confidence", "evidence", "classified_at",
            F.col("url").alias("page_url"), "action", "reviewed_at",
        )
        # joined to the detections: candidates without one have no id, and all of them would go to one task
        top = top.join(self._newest_archive, "detection_id", "left")
        views = self._statuses(self._facts, top)
        views = views.select(*[c for c in views.columns if c != "archive_id"], "archive_id").withColumn("label", view_label())
        return lastmod(views, self.exhibits)


def candidate_views(
    candidates: DataFrame,
    scans: DataFrame,
    detections: DataFrame,
    reviews: DataFrame,
    archives: DataFrame,
    corroboration: DataFrame,
    events: DataFrame,
) -> Views:
    """The tables of the published pages; see ``Views``."""
    return Views(candidates, scans, detections, reviews, archives, corroboration, events)
