"""Published findings: exhibits, live state, versions, timelines, index and feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions.dates import money_compact
from pagewatch.functions.politics import heat_class, seat_compact
from pagewatch.functions.status import AMBIGUOUS, GUIDANCE, change_key, is_positive, usable_scan
from pagewatch.functions.text import guidance_unchanged
from pagewatch.operators.ordered import global_rank, history_before, latest_per_key
from pagewatch.operators.review import latest_reviews, rank_order
from pagewatch.schemas import EVIDENCE
from pagewatch.session import write_through

# Published statuses as (status, sort rank, public).
STATUSES = (
    ("positive_published", 0, True),
    ("positive_pending", 1, False),
    ("ambiguous_pending", 2, False),
    ("negative", 4, True),
    ("rejected", 3, False),
    ("not_scanned", 8, True),
    ("no_url", 7, True),
    ("blocked_by_robots", 6, True),
    ("fetch_failed", 5, True),
)
PUBLIC_STATUSES = tuple(s for s, _, public in STATUSES if public)
# Labels of the statuses.
POSITIVE_LABEL = "Posted public messaging guidance consistent with red-boxing"
AMBIGUOUS_LABEL = "Possible messaging guidance — under review"
CONFIRMED_LABEL = (
    "Posted public messaging guidance consistent with red-boxing — initially classified ambiguous "
    "by the automated screen; confirmed on human review"
)
REJECTED_LABEL = "Reviewed — not a finding"
NEGATIVE_LABEL = "No public messaging guidance detected as of "
GAP_LABELS = {
    "not_scanned": "Not yet scanned",
    "no_url": "No campaign site found — not scanned",
    "blocked_by_robots": "Site blocks automated access — not scanned",
    "fetch_failed": "Site unreachable — fetch failed",
}
# States that have a square on the state map.
GRID_STATES = (
    "AK", "AL", "AR", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA", "ID", "IL", "IN", "KS",
    "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV",
    "NY", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY",
)
FINDING_STATUSES = ("positive_published", "positive_pending", "ambiguous_pending")
DAY_MICROS = 86_400_000_000

BODY = ["candidate_id", "text_hash"]
ADDRESS = ["candidate_id", "url"]


def status_rank(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for name, rank, _ in STATUSES for x in (name, rank)])
    return F.coalesce(F.try_element_at(table, status), F.lit(9))


def top_detection(ranked: DataFrame) -> DataFrame:
    """The representative detection per candidate."""
    return latest_per_key(ranked, ["candidate_id"], rank_order())


def exhibit_detections(ranked: DataFrame) -> DataFrame:
    """Best detection per (candidate, url) when positive and not rejected, with first detection time.

    Every positive detection ranks above the others, so only positive ones are ranked.
    """
    positive = ranked.filter(is_positive(F.col("classification")))
    best = latest_per_key(positive, ADDRESS, rank_order()).filter(F.coalesce("action", F.lit("")) != "reject")
    firsts = positive.groupBy(*ADDRESS).agg(F.min("classified_at").alias("first_detected_at"))
    return best.join(firsts, ADDRESS)


def rank_key() -> Column:
    """Ascending struct form of the ranking: the smallest is the best."""
    return F.struct(*[(-F.col(c)).alias(c) for c in ("tier", "severity", "confidence_rank", "detection_id")])


def collapse_aliases(exhibit_rows: DataFrame) -> DataFrame:
    """One exhibit per distinct body; ``alias_count`` further addresses serve it."""
    lead = F.struct(
        *[c for c in exhibit_rows.columns if c not in (*BODY, "first_detected_at")]
    )
    return (
        exhibit_rows.groupBy(*BODY)
        .agg(
            F.min_by(lead, rank_key()).alias("lead"),
            F.min("first_detected_at").alias("first_detected_at"),
            (F.count("*") - 1).alias("alias_count"),
        )
        .select(*BODY, "lead.*", "first_detected_at", "alias_count")
    )


def exhibit_urls(exhibit_rows: DataFrame, exhibits: DataFrame) -> DataFrame:
    """(candidate, body, url, is_primary): every address of every exhibit."""
    primary = exhibits.select(*BODY, F.col("url").alias("primary_url"))
    return exhibit_rows.select(*BODY, "url").join(primary, BODY).select(
        *BODY, "url", (F.col("url") == F.col("primary_url")).alias("is_primary")
    )


def body_detections(ranked: DataFrame) -> DataFrame:
    """Best positive detection per (candidate, body): every version ever served."""
    return latest_per_key(ranked.filter(is_positive(F.col("classification"))), BODY, rank_order())


def body_first_seen(scans: DataFrame, detections: DataFrame) -> DataFrame:
    """First fetch of every body that was ever positive. Ranked detections bring their bodies, others get them by scan."""
    positive = detections.filter(is_positive(F.col("classification")))
    if "text_hash" not in detections.columns:
        positive = positive.select("scan_id").join(scans.select("scan_id", *BODY), "scan_id")
    bodies = positive.select(*BODY).distinct()
    return scans.join(bodies, BODY, "left_semi").groupBy(*BODY).agg(F.min("fetched_at").alias("first_seen"))


BROADCAST_IDS = 1_000_000


def watched_addresses(ranked: DataFrame) -> DataFrame:
    """Addresses on which guidance was ever found."""
    return ranked.filter(is_positive(F.col("classification"))).select(*ADDRESS).distinct()


def url_live_state(scans: DataFrame, ranked: DataFrame, events: DataFrame) -> DataFrame:
    """(candidate_id, url, gone_on): NULL while the guidance is still up.

    Scans that bring ``usable`` instead of their text are those of watched addresses alone. Elsewhere the test
    of a text is part of the aggregate, as a filter would be moved ahead of the semi-join and read every text.
    """
    if "usable" in scans.columns:
        watched, usable = scans.filter("usable"), F.lit(True)
    else:
        watched = scans.join(watched_addresses(ranked), ADDRESS, "left_semi")
        usable = usable_scan(F.col("http_status"), F.col("raw_text"))
    last_scan = (
        watched.groupBy(*ADDRESS)
        .agg(F.max_by(F.struct("scan_id", "text_hash", "fetched_at"), F.when(usable, F.col("scan_id"))).alias("s"))
        .filter("s is not null")
        .select(*ADDRESS, "s.*")
    )
    verdicts = latest_per_key(ranked, BODY, rank_order()).select(*BODY, "classification")
    seen = last_scan.join(verdicts, BODY, "left").select(
        *ADDRESS,
        "scan_id",
        F.when(~is_positive(F.col("classification")), F.to_date("fetched_at")).alias("scan_gone"),
    )
    last_event = (
        events.groupBy(*ADDRESS)
        .agg(F.max_by(F.struct("event_type", "new_scan_id", "detected_at"), "change_id").alias("e"))
    )
    newer = F.coalesce("e.new_scan_id", F.lit(0)) > F.coalesce("scan_id", F.lit(0))
    event_gone = F.when(F.col("e.event_type") == "take_down", F.to_date("e.detected_at"))
    return (
        seen.join(last_event, ADDRESS, "full_outer")
        .filter(F.col("scan_id").isNotNull() | (newer & (F.col("e.event_type") == "take_down")))
        .select(*ADDRESS, F.when(newer, event_gone).otherwise(F.col("scan_gone")).alias("gone_on"))
    )


def gone_since(urls: DataFrame, live: DataFrame) -> DataFrame:
    """Per exhibit: the day it was gone everywhere, NULL while any address still carries it."""
    return (
        urls.join(live, ADDRESS, "left")
        .groupBy(*BODY)
        .agg(F.when(F.bool_and(F.col("gone_on").isNotNull()), F.max("gone_on")).alias("gone_since"))
    )


def exhibit_versions(exhibits: DataFrame, urls: DataFrame, bodies: DataFrame, seen: DataFrame) -> DataFrame:
    """Earlier bodies served on an exhibit's addresses, with their life span."""
    current = exhibits.join(seen, BODY, "left").select(
        *BODY,
        F.coalesce("first_seen", "first_detected_at").alias("current_first"),
        F.col("first_seen").alias("current_seen"),
    )
    owners = urls.join(current, BODY).select(
        *ADDRESS, F.col("text_hash").alias("exhibit_hash"), "current_first", "current_seen"
    )
    older = (
        bodies.filter(F.coalesce("action", F.lit("")) != "reject")
        .join(exhibits.select(*BODY), BODY, "left_anti")
        .join(seen, BODY)
        .join(owners, ADDRESS)
        .filter("first_seen < current_first")
        .withColumns(
            {"_at": -F.unix_micros(F.col("first_seen").cast("timestamp")), "_id": -F.col("detection_id")}
        )
    )
    # walking backwards, the "previous" row is the version that replaced this one
    chained = history_before(
        older,
        ["candidate_id", "exhibit_hash"],
        ["_at", "_id"],
        prev={"_next": F.struct("first_seen")},
        block_rows=DAY_MICROS,
    )
    return chained.select(
        "candidate_id",
        "exhibit_hash",
        "text_hash",
        "detection_id",
        (F.coalesce("action", F.lit("")) == "approve").alias("approved"),
        F.to_date("first_seen").alias("first_seen"),
        F.to_date(F.when(F.col("_next").isNotNull(), F.col("_next.first_seen")).otherwise(F.col("current_seen"))).alias(
            "superseded"
        ),
    )


def exhibit_events(events: DataFrame, urls: DataFrame) -> DataFrame:
    """Events on addresses of exhibits, with the exhibit's body for the address."""
    narrow = events.select("change_id", *ADDRESS, "event_type", "prev_scan_id", "new_scan_id", "detected_at")
    return narrow.join(urls.select(*ADDRESS, "text_hash"), ADDRESS).drop("url")


def compared_scans(events: DataFrame) -> DataFrame:
    """The different scan ids that modified events name."""
    return events.filter("event_type = 'modified'").select(F.explode(F.array("prev_scan_id", "new_scan_id")).alias("scan_id")).filter("scan_id is not null").distinct()


def scans_of(ids: DataFrame, scans: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the scans with these ids (different ones). They go to every task if few by count.

    With more, both sides are shuffled, where Spark's runtime bloom filter drops other scans first.
    """
    ids = write_through(ids, "scan-ids")
    few = ids.count() <= BROADCAST_IDS
    return scans.select("scan_id", *columns).join(F.broadcast(ids) if few else ids, "scan_id")


def modified_event_context(events: DataFrame, scans: DataFrame, detections: DataFrame) -> DataFrame:
    """Modified events with both texts, the latest evidence of both scans and ``guidance_same``.

    The scans that events name are taken from ``scans`` in one pass and written; only those texts are joined.
    """
    out = events.filter("event_type = 'modified'")
    ids = write_through(compared_scans(out), "event-ids")
    evidence = ids.join(detections, "scan_id").groupBy("scan_id").agg(F.max_by("evidence", "detection_id").alias("evidence"))
    texts = scans_of(ids, scans, "raw_text").join(evidence, "scan_id", "left")
    texts = write_through(texts.select("scan_id", "raw_text", "evidence"), "event-texts")
    for name in ("prev", "new"):
        side = texts.select(*[F.col(c).alias(f"{name}_{n}") for c, n in (("scan_id", "scan_id"), ("raw_text", "text"), ("evidence", "evidence"))])
        out = out.join(side, f"{name}_scan_id", "left")
    none = F.array().cast(EVIDENCE)
    return out.withColumn(
        "guidance_same",
        guidance_unchanged(
            F.coalesce("prev_evidence", none), F.coalesce("new_evidence", none), F.col("prev_text"), F.col("new_text")
        ),
    )


def exhibit_timeline(
    exhibits: DataFrame, urls: DataFrame, changes: DataFrame, versions: DataFrame, gone: DataFrame
) -> DataFrame:
    """(candidate_id, text_hash, day, kind, kind_rank) rows, one per distinct entry.

    ``changes``: candidate_id, url, event_type, detected_at, guidance_same; or text_hash (of the exhibit) instead of url.
    The logged entries are written, as four branches read them.
    """
    if "text_hash" not in changes.columns:
        changes = changes.join(urls.select(*ADDRESS, "text_hash"), ADDRESS)
    logged = write_through(
        changes.select(
            *BODY,
            F.to_date("detected_at").alias("day"),
            change_key(F.col("event_type"), F.col("guidance_same")).alias("kind"),
        ).distinct(),
        "logged",
    )
    dated = logged.filter("kind in ('updated', 'revised', 'changed')").select(*BODY, "day")
    revised = (
        versions.select("candidate_id", F.col("exhibit_hash").alias("text_hash"), F.col("superseded").alias("day"))
        .filter("day is not null")
        .distinct()
        .join(dated, [*BODY, "day"], "left_anti")
        .withColumn("kind", F.lit("revised"))
    )
    detected = (
        exhibits.select(*BODY, F.to_date(F.coalesce("first_detected_at", "classified_at")).alias("day"))
        .filter("day is not null")
        .join(logged.filter("kind = 'put_up'"), [*BODY, "day"], "left_anti")
        .withColumn("kind", F.lit("detected"))
    )
    removed = (
        gone.filter("gone_since is not null")
        .join(logged.filter("kind = 'take_down'"), BODY, "left_anti")
        .select(*BODY, F.col("gone_since").alias("day"), F.lit("gone").alias("kind"))
    )
    rank = (
        F.when(F.col("kind").isin("detected", "put_up"), 0)
        .when(F.col("kind") == "updated", 1)
        .when(F.col("kind").isin("revised", "changed"), 2)
        .otherwise(3)
    )
    rows = logged.unionByName(revised).unionByName(detected).unionByName(removed)
    return rows.withColumn("kind_rank", rank)


def publishable(candidates: DataFrame, detections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Active candidates, plus inactive ones with an approved detection."""
    approved = (
        latest_reviews(reviews)
        .filter("action = 'approve'")
        .select("detection_id")
        .join(detections.select("detection_id", "candidate_id"), "detection_id")
        .select("candidate_id")
        .distinct()
        .withColumn("_approved", F.lit(True))
    )
    return (
        candidates.join(approved, "candidate_id", "left")
        .filter((F.coalesce("inactive", F.lit(0)) == 0) | F.col("_approved"))
        .drop("_approved")
    )


def view_status() -> Column:
    """One of the nine statuses from scan_count, classification, action and candidate columns."""
    cls, act = F.col("classification"), F.coalesce("action", F.lit(""))
    return (
        F.when(
            F.col("scan_count") == 0,
            F.when(F.coalesce("website_url", F.lit("")) == "", "no_url")
            .when(F.col("scan_status") == "robots_blocked", "blocked_by_robots")
            .when(F.col("scan_status") == "fetch_failed", "fetch_failed")
            .otherwise("not_scanned"),
        )
        .when(is_positive(cls) & (act == "approve"), "positive_published")
        .when(is_positive(cls) & (act == "reject"), "rejected")
        .when(cls == GUIDANCE, "positive_pending")
        .when(cls == AMBIGUOUS, "ambiguous_pending")
        .otherwise("negative")
    )


def view_label() -> Column:
    status = F.col("status")
    gap = F.create_map(*[F.lit(x) for pair in GAP_LABELS.items() for x in pair])
    return (
        F.when((status == "positive_published") & (F.col("classification") == AMBIGUOUS), CONFIRMED_LABEL)
        .when(status.isin("positive_published", "positive_pending"), POSITIVE_LABEL)
        .when(status == "ambiguous_pending", AMBIGUOUS_LABEL)
        .when(status == "rejected", REJECTED_LABEL)
        .when(status == "negative", F.concat(F.lit(NEGATIVE_LABEL), F.date_format("last_scanned", "yyyy-MM-dd")))
        .otherwise(F.try_element_at(gap, status))
    )


def public_view(views: DataFrame, exhibits: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Public statuses, approved exhibits of those candidates, approved versions of those exhibits."""
    shown = views.filter(F.col("status").isin(*PUBLIC_STATUSES))
    kept = exhibits.filter("approved").join(shown.select("candidate_id"), "candidate_id", "left_semi")
    owners = kept.select("candidate_id", F.col("text_hash").alias("exhibit_hash"))
    return shown, kept, versions.filter("approved").join(owners, ["candidate_id", "exhibit_hash"], "left_semi")


def finding_fingerprint(exhibits: DataFrame) -> DataFrame:
    """Per candidate: eight hex digits that change only with the set of approved bodies."""
    body = F.coalesce(F.nullif("text_hash", F.lit("")), "url", F.lit(""))
    joined = F.array_join(F.array_sort(F.collect_list(body)), "|")
    return (
        exhibits.filter("approved").groupBy("candidate_id").agg(F.substring(F.sha1(joined), 1, 8).alias("fingerprint"))
    )


def lastmod(views: DataFrame, exhibits: DataFrame) -> DataFrame:
    """Add ``lastmod``: the latest approval, removal, review or scan day."""
    dates = exhibits.groupBy("candidate_id").agg(
        F.max("reviewed_at").alias("_reviewed"), F.max("gone_since").alias("_gone")
    )
    newest = F.greatest(
        F.to_date("_reviewed"), F.col("_gone"), F.to_date("reviewed_at"), F.to_date("last_scanned")
    )
    return views.join(dates, "candidate_id", "left").withColumn("lastmod", newest).drop("_reviewed", "_gone")


def status_counts(views: DataFrame) -> DataFrame:
    return views.groupBy("status").agg(F.count("*").alias("n"))


def coverage_summary(views: DataFrame, public: bool) -> DataFrame:
    """One row of site-wide counts over the full universe."""
    findings = ("positive_published",) if public else ("positive_published", "positive_pending")

    def n(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    money = F.sum(F.when(F.col("status").isin(*findings), F.col("supporting_total")))
    return views.agg(
        F.count("*").alias("total"),
        n("positive_published").alias("findings"),
        n("positive_pending", "ambiguous_pending").alias("pending"),
        n("negative").alias("negative"),
        n("no_url").alias("no_url"),
        n("blocked_by_robots").alias("blocked"),
        n("fetch_failed").alias("failed"),
        F.coalesce(money, F.lit(0)).cast("decimal(28,2)").alias("aligned_total"),
    )


def state_heatmap(views: DataFrame, public: bool) -> DataFrame:
    """Findings per state with heat class, aligned money and whether the map has a square."""
    findings = ("positive_published",) if public else ("positive_published", "positive_pending")
    per_state = (
        views.filter(F.col("status").isin(*findings) & (F.coalesce("state", F.lit("")) != ""))
        .groupBy("state")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("supporting_total"), F.lit(0)).cast("decimal(28,2)").alias("aligned_total"),
        )
    )
    return per_state.select(
        "state",
        "n",
        heat_class(F.col("n")).alias("heat"),
        "aligned_total",
        money_compact(F.col("aligned_total")).alias("aligned_text"),
        F.col("state").isin(*GRID_STATES).alias("on_grid"),
    )


def index_keys(views: DataFrame) -> DataFrame:
    """Add band, aligned_ie and status_rank: the index sort keys."""
    finding = F.col("status").isin(*FINDING_STATUSES)
    aligned = F.when(finding, F.coalesce("supporting_total", F.lit(0))).otherwise(0).cast("decimal(28,2)")
    return views.withColumn("aligned_ie", aligned).withColumns(
        {
            "band": F.when(F.col("aligned_ie") > 0, 0).when(finding, 1).otherwise(2),
            "status_rank": status_rank(F.col("status")),
        }
    )


def rank_index(views: DataFrame) -> DataFrame:
    """Add ``position``: findings with aligned money lead, then findings, then the rest."""
    keyed = index_keys(views).withColumns(
        {f"_{c}": F.coalesce(c, F.lit("")) for c in ("state", "district", "name")}
    )
    order = [
        F.col("band").asc(), F.col("aligned_ie").desc(), F.col("status_rank").asc(),
        F.col("_state").asc(), F.col("_district").asc(), F.col("_name").asc(), F.col("candidate_id").asc(),
    ]
    # range partitioning samples its input first; written views are not computed twice
    return global_rank(write_through(keyed, "index"), order, "position").drop("_state", "_district", "_name")


def paginate(ranked: DataFrame, size: int = 500, position: str = "position") -> DataFrame:
    """Add the 1-based ``page`` of each position."""
    return ranked.withColumn("page", (F.floor((F.col(position) - 1) / max(1, size)) + 1).cast("int"))


def approved_at(views: DataFrame, exhibits: DataFrame) -> DataFrame:
    """Published findings with the time that dates them in the feed."""
    approvals = exhibits.filter("approved").groupBy("candidate_id").agg(
        F.max("reviewed_at").alias("_last"),
        F.count("*").alias("n_approved"),
        F.min(F.to_date("reviewed_at")).alias("_first_day"),
        F.max(F.to_date("reviewed_at")).alias("_last_day"),
        F.max_by(
            F.struct("url", "evidence"),
            F.struct(F.coalesce("reviewed_at", "first_detected_at"), "tier", "severity", "confidence_rank", "detection_id"),
        ).alias("newest"),
    )
    return (
        views.filter("status = 'positive_published'")
        .join(approvals, "candidate_id", "left")
        .withColumn("n_approved", F.coalesce("n_approved", F.lit(0)))
        .withColumn("approved_at", F.coalesce("_last", "reviewed_at", "classified_at"))
        .withColumn("several_days", F.coalesce(F.col("_first_day") < F.col("_last_day"), F.lit(False)))
        .drop("_last", "_first_day", "_last_day")
    )


def feed_items(views: DataFrame, exhibits: DataFrame, site_url: str, n: int = 50) -> DataFrame:
    """The newest published findings as feed items.

    ``views`` carries ``display_name``; only the top ``n`` rows go past the sort, and
    ``position`` numbers those.
    """
    newest = [F.col("approved_at").desc_nulls_last(), "state", "district", "name", "candidate_id"]
    top = approved_at(views, exhibits).orderBy(*newest).limit(n)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(*newest)))
    prints = finding_fingerprint(exhibits)
    seat = seat_compact(F.col("office"), F.col("state"), F.col("district"))
    name_seat = F.concat("display_name", F.lit(" ("), seat, F.lit(")"))
    several = F.col("n_approved") > 1
    evidence = F.when(several, F.col("newest.evidence")).otherwise(F.col("evidence"))
    quote = F.try_element_at(
        F.filter(F.transform(evidence, lambda e: e["quote"]), lambda q: F.coalesce(q, F.lit("")) != ""), F.lit(1)
    )
    page = F.nullif(F.when(several, F.col("newest.url")).otherwise(F.col("page_url")), F.lit(""))
    page_word = F.when(several, "Newest guidance page: ").otherwise("Guidance page: ")
    title = F.when(
        several & F.col("several_days"), F.concat(F.lit("Updated red-box guidance found for "), name_seat)
    ).otherwise(F.concat(name_seat, F.lit(" — red-box guidance found")))
    content = F.concat_ws(
        " · ", "label", F.concat(page_word, page), F.concat(F.lit("Quoted span: “"), quote, F.lit("”"))
    )
    return top.join(prints, "candidate_id", "left").select(
        "candidate_id",
        F.concat("candidate_id", F.lit("#"), F.coalesce("fingerprint", F.lit("0"))).alias("id"),
        F.concat(F.lit(site_url.rstrip("/") + "/"), "candidate_id").alias("url"),
        title.alias("title"),
        content.alias("content_text"),
        F.col("approved_at").alias("date_published"),
        "position",
    )


def feed_delta(
    items: DataFrame, posted: DataFrame, flood_limit: int = 15, max_posts: int = 5
) -> DataFrame:
    """(id, action) of new feed items: bootstrap, absorb, post or wait.

    ``items``: id, position (1 = newest). ``posted``: id. With nothing posted
    yet everything is recorded silently. When more than ``flood_limit`` ids are
    new, those whose candidate is already known under another id are absorbed.
    The oldest ``max_posts`` of the rest are posted.
    """
    prefix = lambda: F.substring_index("id", "#", 1).alias("_prefix")
    fresh = items.filter(F.coalesce("id", F.lit("")) != "").join(posted.select("id"), "id", "left_anti")
    known = posted.select(prefix()).distinct().withColumn("_known", F.lit(True))
    n_fresh = fresh.agg(F.count("*")).scalar()
    n_posted = posted.limit(1).agg(F.count("*")).scalar()
    marked = (
        fresh.withColumn("_prefix", prefix())
        .join(known, "_prefix", "left")
        .withColumn("_absorb", (n_fresh > flood_limit) & F.coalesce("_known", F.lit(False)))
    )
    queue = marked.filter("not _absorb").orderBy(F.col("position").desc()).limit(max_posts).select(
        "id", F.lit(True).alias("_post")
    )
    action = (
        F.when(n_posted == 0, "bootstrap").when(F.col("_absorb"), "absorb").when(F.col("_post"), "post").otherwise("wait")
    )
    return marked.join(queue, "id", "left").select("id", "position", action.alias("action"))
