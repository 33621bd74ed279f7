"""How often the candidate views read the scans, and which reads bring the page texts."""

import re

from pagewatch.catalog.core import Tables
from pagewatch.catalog.site import evidence_detections, site_candidates
from pagewatch.operators import publish
from pagewatch.plans import views
from pagewatch.plans.money import corroborate

FOLDER = "/root/testdata/sf0.001"


def test_scans_are_read_twice_and_their_texts_once(spark, monkeypatch, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    t = Tables(spark, FOLDER)
    path = str(tmp_path / "all-scans")
    t("scans_v").write.parquet(path)
    scans, plans, write = spark.read.parquet(path), [], views.write_through

    def watched(df, label="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(views, "write_through", watched)
    monkeypatch.setattr(publish, "write_through", watched)
    corr = corroborate(t("ie_filings_v"), t("detections_v"), t("reviews_v"), 2026)
    out = views.candidate_views(site_candidates(t), scans, evidence_detections(t), t("reviews_v"), t("archives_v"), corr, t("change_events_v"))
    for df in (out.views, out.exhibits, out.urls, out.versions, out.timeline):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    # the detections of the adapter views do not come from this file, so its scans are the plan's own
    reads = [re.search(r"ReadSchema: (\S+)", line).group(1) for p in plans for line in p.splitlines() if "all-scans" in line]
    assert len(reads) == 2
    assert ["raw_text" in r for r in sorted(reads, key=lambda r: "raw_text" in r)] == [False, True]


def test_event_texts_are_read_once_behind_an_id_filter(spark, monkeypatch):
    schema = "change_id long, event_type string, prev_scan_id long, new_scan_id long"
    events = spark.createDataFrame([(1, "modified", 1, 2), (2, "modified", 2, 99), (3, "put_up", 3, 4), (4, "modified", None, 3)], schema)
    scans = spark.createDataFrame([(i, f"text {i}") for i in range(1, 6)], "scan_id long, raw_text string")
    detections = spark.createDataFrame([(1, 1, None)], f"detection_id long, scan_id long, evidence {publish.EVIDENCE}")
    taken, write = {}, publish.write_through
    monkeypatch.setattr(publish, "write_through", lambda df, label: taken.setdefault(label, write(df, label)))
    for limit in (publish.BROADCAST_IDS, 0):
        taken.clear()
        monkeypatch.setattr(publish, "BROADCAST_IDS", limit)
        got = {r.change_id: (r.prev_text, r.new_text) for r in publish.modified_event_context(events, scans, detections).collect()}
        assert got == {1: ("text 1", "text 2"), 2: ("text 2", None), 4: (None, "text 3")}
        assert sorted(r.scan_id for r in taken["event-texts"].collect()) == [1, 2, 3]


def test_status_and_rank_need_no_written_views(spark, monkeypatch):
    t, labels, write = Tables(spark, FOLDER), [], views.write_through
    monkeypatch.setattr(views, "write_through", lambda df, label="stage": labels.append(label) or write(df, label))
    corr = corroborate(t("ie_filings_v"), t("detections_v"), t("reviews_v"), 2026)
    out = views.candidate_views(site_candidates(t), t("scans_v"), evidence_detections(t), t("reviews_v"), t("archives_v"), corr, t("change_events_v"))
    standing = out.standing.select("candidate_id", "status", "supporting_total").collect()
    assert labels == []
    assert out.versions.columns and "gone" not in labels and "texts" not in labels
    assert sorted(standing) == sorted(out.views.select("candidate_id", "status", "supporting_total").collect())
    assert len(labels) == len(set(labels))


def test_timeline_entries_are_worked_out_once(spark, monkeypatch, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    t, plans, write = Tables(spark, FOLDER), [], publish.write_through
    path = str(tmp_path / "all-events")
    t("change_events_v").write.parquet(path)

    def watched(df, label="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(views, "write_through", watched)
    monkeypatch.setattr(publish, "write_through", watched)
    corr = corroborate(t("ie_filings_v"), t("detections_v"), t("reviews_v"), 2026)
    out = views.candidate_views(
        site_candidates(t), t("scans_v"), evidence_detections(t), t("reviews_v"), t("archives_v"), corr, spark.read.parquet(path)
    )
    plans.append(out.timeline._jdf.queryExecution().executedPlan().toString())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    # the scans they compare, the last of each address, and those on exhibits
    assert sum("all-events" in line for p in plans for line in p.splitlines()) == 3
    assert "all-events" not in plans[-1]


def test_only_positive_detections_are_ranked_for_exhibits(spark):
    schema = "detection_id long, candidate_id string, url string, classification string, action string, classified_at date, tier int, severity int, confidence_rank double"
    rows = [
        (1, "a", "u", "ambiguous", "reject", None, 0, 1, 0.1), (2, "a", "u", "no_guidance_detected", "approve", None, 0, 0, 0.9),
        (3, "a", "v", "no_guidance_detected", None, None, 0, 0, 0.9), (4, "a", "w", "ambiguous", None, None, 1, 1, 0.2),
        (5, "a", "w", "no_guidance_detected", None, None, 0, 0, 0.9),
    ]
    found = publish.exhibit_detections(spark.createDataFrame(rows, schema))
    assert [r.detection_id for r in found.collect()] == [4]
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Partial"):]  # the rank limit ahead of the shuffle
    assert " IN (" in below[: below.index("Scan")]


def test_candidates_without_a_detection_are_not_joined_by_its_id(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    t = Tables(spark, FOLDER)
    corr = corroborate(t("ie_filings_v"), t("detections_v"), t("reviews_v"), 2026)
    out = views.candidate_views(site_candidates(t), t("scans_v"), evidence_detections(t), t("reviews_v"), t("archives_v"), corr, t("change_events_v"))
    lines = out.views._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    depth = [re.search(r"[A-Za-z]", line).start() for line in lines]
    joins = [i for i, line in enumerate(lines) if re.search(r"Join LeftOuter, \(detection_id", line)]
    assert joins
    for i in joins:
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert not any("c_custkey" in line for line in lines[i:end])
