"""Queries behind the published site."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewatch.catalog.core import Tables, case, with_views
from pagewatch.catalog.history import CORR, FIRST, LR, MONEY_VIEWS, OPEN, POS, SP, SPEND, AFTER
from pagewatch.catalog.scalars import _COMPACT_SQL
from pagewatch.operators import publish as P
from pagewatch.operators.names import standardize_names
from pagewatch.operators.review import ranked_detections
from pagewatch.plans.money import corroborate
from pagewatch.plans.publish import publish_tables
from pagewatch.plans.views import candidate_views
from pagewatch.session import scratch_root
from pagewatch.sources.sinks import feed_json, sitemap_rows, write_feed

SITE = "https://tracker.example"
RK = (
    "rk",
    "select d.*, s.url, s.text_hash, action, reviewed_at, case when " + POS + " and action='approve' then 2 when " + POS
    + " and (action is null or action='needs_more') then 1 else 0 end as tier, case classification when 'red_box_guidance' then 2 when 'ambiguous' then 1 else 0 end as sev "
    "from detections_v d join scans_v s on s.scan_id=d.scan_id left join lr on lr.detection_id=d.detection_id",
)
ORDER = "tier desc, sev desc, confidence desc, detection_id desc"


def best(keys: str, where: str = "true") -> str:
    return f"(select * from (select *, row_number() over (partition by {keys} order by {ORDER}) as rn from rk where {where}) x where rn=1)"


TOP = ("topd", f"select * from {best('candidate_id')} t")
EXR = (
    "exr",
    f"select e.*, f.first_detected_at from {best('candidate_id, url')} e join (select candidate_id, url, min(classified_at) as first_detected_at from rk where {POS} group by 1,2) f "
    f"using (candidate_id, url) where {POS} and coalesce(action,'')<>'reject'",
)
EX = (
    "ex",
    f"select * from (select * exclude (rn, first_detected_at), min(first_detected_at) over (partition by candidate_id, text_hash) as first_detected_at, count(*) over (partition by candidate_id, text_hash)-1 as alias_count, "
    f"row_number() over (partition by candidate_id, text_hash order by {ORDER}) as rn from exr) x where rn=1",
)
BOD = ("bod", f"select * from {best('candidate_id, text_hash', POS)} t")
SEEN = (
    "seen",
    f"select candidate_id, text_hash, min(fetched_at) as first_seen from scans_v where (candidate_id,text_hash) in (select (candidate_id,text_hash) from rk where {POS}) group by 1,2",
)
LIVE = (
    "live",
    "select coalesce(l.candidate_id,e.candidate_id) as candidate_id, coalesce(l.url,e.url) as url, case when coalesce(e.new_scan_id,0)>coalesce(l.scan_id,0) then "
    "case when e.event_type='take_down' then cast(e.detected_at as date) end when t.classification is null or t.classification not in ('red_box_guidance','ambiguous') "
    "then cast(l.fetched_at as date) end as gone_on from (select * from (select *, row_number() over (partition by candidate_id, url order by scan_id desc) as rn from sp where usable and "
    f"(candidate_id,url) in (select (candidate_id,url) from rk where {POS})) x where rn=1) l full join (select * from (select *, row_number() over (partition by candidate_id, url order by change_id desc) as rn "
    f"from change_events_v) x where rn=1) e on e.candidate_id=l.candidate_id and e.url=l.url left join {best('candidate_id, text_hash')} t on t.candidate_id=l.candidate_id and t.text_hash=l.text_hash "
    "where l.scan_id is not null or (coalesce(e.new_scan_id,0)>0 and e.event_type='take_down')",
)
GONE = (
    "gone",
    "select candidate_id, text_hash, case when bool_and(gone_on is not null) then max(gone_on) end as gone_since from exr left join live using (candidate_id, url) group by 1,2",
)
VERS = (
    "vers",
    "select candidate_id, exhibit_hash, text_hash, detection_id, action='approve' as approved, cast(first_seen as date) as first_seen, cast(coalesce(lead(first_seen) over (partition by candidate_id, exhibit_hash "
    "order by first_seen, detection_id), cur_seen) as date) as superseded from (select bod.candidate_id, bod.text_hash, bod.detection_id, coalesce(bod.action,'') as action, seen.first_seen, x.text_hash as exhibit_hash, "
    "cs.first_seen as cur_seen from bod join seen using (candidate_id,text_hash) join exr x on x.candidate_id=bod.candidate_id and x.url=bod.url join ex on ex.candidate_id=x.candidate_id and ex.text_hash=x.text_hash "
    "left join seen cs on cs.candidate_id=x.candidate_id and cs.text_hash=x.text_hash where coalesce(bod.action,'')<>'reject' and (bod.candidate_id,bod.text_hash) not in (select (candidate_id,text_hash) from ex) "
    "and seen.first_seen<coalesce(cs.first_seen, ex.first_detected_at)) v",
)
# every detection quotes the page body; half of them quote it in upper case
_QUOTE = "case when detection_id%2=0 then upper(text_hash) else text_hash||' x' end"
CTX = (
    "ctx",
    "select change_id, case when qn is null then null when qp is not null then case when lower(qp)=lower(qn) then true else contains(tn,lower(qp)) and contains(tp,lower(qn)) end "
    "when tp<>'' then contains(tp,lower(qn)) end as same from (select e.change_id, p.raw_text as tp, n.raw_text as tn, "
    "(select " + _QUOTE + " from rk where rk.scan_id=e.prev_scan_id) as qp, (select " + _QUOTE + " from rk where rk.scan_id=e.new_scan_id) as qn "
    "from change_events_v e left join scans_v p on p.scan_id=e.prev_scan_id left join scans_v n on n.scan_id=e.new_scan_id where e.event_type='modified') c",
)
LOG = (
    "logd",
    "select distinct e.candidate_id, x.text_hash, cast(detected_at as date) as day, case when event_type<>'modified' then event_type when same then 'updated' when same=false then 'revised' else 'changed' end as kind "
    "from change_events_v e join exr x on x.candidate_id=e.candidate_id and x.url=e.url left join ctx using (change_id)",
)
TIME = (
    "tl",
    "select * from logd union all select distinct candidate_id, exhibit_hash, superseded, 'revised' from vers where superseded is not null and (candidate_id,exhibit_hash,superseded) not in "
    "(select (candidate_id,text_hash,day) from logd where kind in ('updated','revised','changed')) union all select candidate_id, text_hash, cast(first_detected_at as date), 'detected' from ex "
    "where (candidate_id,text_hash,cast(first_detected_at as date)) not in (select (candidate_id,text_hash,day) from logd where kind='put_up') union all select candidate_id, text_hash, gone_since, 'gone' "
    "from gone where gone_since is not null and (candidate_id,text_hash) not in (select (candidate_id,text_hash) from logd where kind='take_down')",
)
PUBL = (
    "publ",
    "select * from candidates_v where coalesce(inactive,0)=0 or candidate_id in (select candidate_id from detections_v join lr using (detection_id) where action='approve')",
)
VIEW = (
    "vw",
    "select v.*, case when n is null then case when website_url is null then 'no_url' when c_custkey%5=0 then 'blocked_by_robots' when c_custkey%5=1 then 'fetch_failed' else 'not_scanned' end "
    "when " + POS + " and action='approve' then 'positive_published' when " + POS + " and action='reject' then 'rejected' when classification='red_box_guidance' then 'positive_pending' "
    "when classification='ambiguous' then 'ambiguous_pending' else 'negative' end as status from (select p.*, n, last_scanned, t.detection_id, classification, confidence, url as page_url, action, reviewed_at, classified_at, text_hash as top_hash, "
    "corr.supporting from publ p left join (select candidate_id, count(*) as n, max(fetched_at) as last_scanned from scans_v group by 1) s using (candidate_id) left join topd t using (candidate_id) "
    "left join corr using (candidate_id)) v",
)
EXA = ("exa", "select ex.*, gone_since, coalesce(action='approve',false) as approved from ex left join gone using (candidate_id,text_hash)")
SITE_VIEWS = ("candidates_v", "scans_v", "change_events_v", "archives_v", *MONEY_VIEWS)
VIEW_CHAIN = (SP, LR, RK, TOP, EXR, EX, BOD, SEEN, LIVE, GONE, VERS, CTX, LOG, TIME, PUBL, OPEN, FIRST, SPEND, AFTER, CORR, VIEW, EXA)


def evidence_detections(t: Tables):
    """Detections with evidence quoted from the page they were read on."""
    body = t("scans_v").select("scan_id", F.col("text_hash").alias("_b"))
    quote = F.when(F.col("detection_id") % 2 == 0, F.upper("_b")).otherwise(F.concat("_b", F.lit(" x")))
    ev = F.array(F.struct(quote.alias("quote"), F.lit("why").alias("why")))
    return t("detections_v").join(body, "scan_id").withColumn("evidence", ev).drop("_b")


def ranked(t: Tables):
    return ranked_detections(evidence_detections(t), t("scans_v"), t("reviews_v"))


def site_candidates(t: Tables):
    k = F.col("c_custkey") % 5
    return t("candidates_v").withColumn(
        "scan_status", F.when(k == 0, "robots_blocked").when(k == 1, "fetch_failed")
    )


def gathered(t: Tables):
    corr = corroborate(t("ie_filings_v"), t("detections_v"), t("reviews_v"), 2026)
    return candidate_views(
        site_candidates(t), t("scans_v"), evidence_detections(t), t("reviews_v"), t("archives_v"), corr, t("change_events_v")
    )


RANK_CHAIN = (SP, LR, RK)


@case("top_detection", with_views("select candidate_id, detection_id, url from topd", *SITE_VIEWS, extra=(*RANK_CHAIN, TOP)))
def _top(t: Tables):
    return P.top_detection(ranked(t)).select("candidate_id", "detection_id", "url")


@case("exhibit_detections", with_views("select candidate_id, url, detection_id, first_detected_at from exr", *SITE_VIEWS, extra=(*RANK_CHAIN, EXR)))
def _exr(t: Tables):
    return P.exhibit_detections(ranked(t)).select("candidate_id", "url", "detection_id", "first_detected_at")


@case(
    "collapse_aliases",
    with_views("select candidate_id, text_hash, url, detection_id, first_detected_at, alias_count from ex", *SITE_VIEWS, extra=(*RANK_CHAIN, EXR, EX)),
)
def _ex(t: Tables):
    return P.collapse_aliases(P.exhibit_detections(ranked(t))).select(
        "candidate_id", "text_hash", "url", "detection_id", "first_detected_at", "alias_count"
    )


@case(
    "exhibit_urls",
    with_views("select exr.candidate_id, exr.text_hash, exr.url, exr.url=ex.url as is_primary from exr join ex using (candidate_id,text_hash)", *SITE_VIEWS, extra=(*RANK_CHAIN, EXR, EX)),
)
def _urls(t: Tables):
    rows = P.exhibit_detections(ranked(t))
    return P.exhibit_urls(rows, P.collapse_aliases(rows))


@case("body_detections", with_views("select candidate_id, text_hash, detection_id from bod", *SITE_VIEWS, extra=(*RANK_CHAIN, BOD)))
def _bod(t: Tables):
    return P.body_detections(ranked(t)).select("candidate_id", "text_hash", "detection_id")


@case("body_first_seen", with_views("select * from seen", *SITE_VIEWS, extra=(*RANK_CHAIN, SEEN)))
def _seen(t: Tables):
    return P.body_first_seen(t("scans_v"), t("detections_v"))


@case("url_live_state", with_views("select * from live", *SITE_VIEWS, extra=(*RANK_CHAIN, LIVE)))
def _live(t: Tables):
    return P.url_live_state(t("scans_v"), ranked(t), t("change_events_v"))


@case("exhibit_versions", with_views("select * from vers", *SITE_VIEWS, extra=(*RANK_CHAIN, EXR, EX, BOD, SEEN, VERS)))
def _versions(t: Tables):
    return gathered(t).versions


@case("modified_event_context", with_views("select * from ctx", *SITE_VIEWS, extra=(*RANK_CHAIN, CTX)))
def _context(t: Tables):
    out = P.modified_event_context(t("change_events_v"), t("scans_v"), evidence_detections(t))
    return out.select("change_id", F.col("guidance_same").alias("same"))


@case("exhibit_timeline", with_views("select * from tl", *SITE_VIEWS, extra=VIEW_CHAIN))
def _timeline(t: Tables):
    return gathered(t).timeline.drop("kind_rank")


@case("publishable", with_views("select candidate_id from publ", *SITE_VIEWS, extra=(LR, PUBL)))
def _publishable(t: Tables):
    return P.publishable(t("candidates_v"), t("detections_v"), t("reviews_v")).select("candidate_id")


LASTMOD = (
    "lm",
    "select vw.*, greatest(cast(m as date), g, cast(reviewed_at as date), cast(last_scanned as date)) as lastmod from vw left join "
    "(select candidate_id, max(reviewed_at) as m, max(gone_since) as g from exa group by 1) e using (candidate_id)",
)


@case(
    "candidate_views",
    with_views("select candidate_id, status, coalesce(n,0) as scan_count, last_scanned, detection_id, page_url, supporting from vw", *SITE_VIEWS, extra=VIEW_CHAIN),
)
def _views(t: Tables):
    return gathered(t).views.select(
        "candidate_id", "status", "scan_count", "last_scanned", "detection_id", "page_url",
        F.col("supporting_total").cast("double").alias("supporting"),
    )


@case(
    "view_labels",
    with_views(
        "select candidate_id, case when status='positive_published' and classification='ambiguous' then $c when status in ('positive_published','positive_pending') then $p "
        "when status='ambiguous_pending' then $a when status='rejected' then 'Reviewed — not a finding' when status='negative' then $n||strftime(last_scanned,'%Y-%m-%d') "
        "when status='no_url' then $u when status='blocked_by_robots' then $b when status='fetch_failed' then $f else 'Not yet scanned' end as label from vw"
        .replace("$c", f"'{P.CONFIRMED_LABEL}'").replace("$p", f"'{P.POSITIVE_LABEL}'").replace("$a", f"'{P.AMBIGUOUS_LABEL}'")
        .replace("$n", f"'{P.NEGATIVE_LABEL}'").replace("$u", f"'{P.GAP_LABELS['no_url']}'").replace("$b", f"'{P.GAP_LABELS['blocked_by_robots']}'")
        .replace("$f", f"'{P.GAP_LABELS['fetch_failed']}'"),
        *SITE_VIEWS, extra=VIEW_CHAIN,
    ),
)
def _labels(t: Tables):
    return gathered(t).views.select("candidate_id", "label")


@case("lastmod", with_views("select candidate_id, lastmod from lm", *SITE_VIEWS, extra=(*VIEW_CHAIN, LASTMOD)))
def _lastmod(t: Tables):
    return gathered(t).views.select("candidate_id", "lastmod")


PUBLIC_SQL = "status in ('positive_published','negative','not_scanned','no_url','blocked_by_robots','fetch_failed')"


@case(
    "public_view",
    with_views(
        f"select 'views' as part, count(*) as n from vw where {PUBLIC_SQL} union all select 'exhibits', count(*) from exa where approved and candidate_id in (select candidate_id from vw where {PUBLIC_SQL}) "
        f"union all select 'versions', count(*) from vers where approved and (candidate_id,exhibit_hash) in (select (candidate_id,text_hash) from exa where approved and candidate_id in (select candidate_id from vw where {PUBLIC_SQL}))",
        *SITE_VIEWS, extra=VIEW_CHAIN,
    ),
)
def _public(t: Tables):
    g = gathered(t)
    parts = zip(("views", "exhibits", "versions"), P.public_view(g.views, g.exhibits, g.versions))
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@case(
    "finding_fingerprint",
    with_views(
        "select candidate_id, substr(sha1(string_agg(text_hash,'|' order by text_hash)),1,8) as fingerprint from exa where approved group by 1", *SITE_VIEWS, extra=VIEW_CHAIN
    ),
)
def _fingerprint(t: Tables):
    return P.finding_fingerprint(gathered(t).exhibits)


@case("status_counts", with_views("select status, count(*) as n from vw group by 1", *SITE_VIEWS, extra=VIEW_CHAIN))
def _counts(t: Tables):
    return P.status_counts(gathered(t).views)


@case(
    "coverage_summary",
    with_views(
        "select count(*) as total, count_if(status='positive_published') as findings, count_if(status in ('positive_pending','ambiguous_pending')) as pending, count_if(status='negative') as negative, "
        "count_if(status='no_url') as no_url, count_if(status='blocked_by_robots') as blocked, count_if(status='fetch_failed') as failed, "
        "sum(case when status in ('positive_published','positive_pending') then supporting end) as aligned_total from vw",
        *SITE_VIEWS, extra=VIEW_CHAIN,
    ),
)
def _coverage(t: Tables):
    return P.coverage_summary(gathered(t).views, public=False).withColumn("aligned_total", F.col("aligned_total").cast("double"))


@case(
    "state_heatmap",
    with_views(
        "select state, n, case when n>=7 then 'h4' when n>=4 then 'h3' when n>=2 then 'h2' else 'h1' end as heat, " + _COMPACT_SQL + " as aligned_text, false as on_grid from "
        "(select state, count(*) as n, coalesce(sum(supporting),0) as x from vw where status='positive_published' group by 1) s",
        *SITE_VIEWS, extra=VIEW_CHAIN,
    ),
)
def _heatmap(t: Tables):
    return P.state_heatmap(gathered(t).views, public=True).drop("aligned_total")


INDEX = (
    "idx",
    "select *, row_number() over (order by case when finding and coalesce(supporting,0)>0 then 0 when finding then 1 else 2 end, case when finding then -coalesce(supporting,0) else 0 end, "
    "case status when 'positive_published' then 0 when 'positive_pending' then 1 when 'ambiguous_pending' then 2 when 'rejected' then 3 when 'negative' then 4 when 'fetch_failed' then 5 "
    "when 'blocked_by_robots' then 6 when 'no_url' then 7 else 8 end, state, district, name, candidate_id) as position from "
    "(select *, status in ('positive_published','positive_pending','ambiguous_pending') as finding from vw) v",
)


@case("rank_index", with_views("select candidate_id, position from idx", *SITE_VIEWS, extra=(*VIEW_CHAIN, INDEX)))
def _index(t: Tables):
    standing = gathered(t).standing.select("candidate_id", "state", "district", "name", "status", "supporting_total")
    return P.rank_index(standing).select("candidate_id", "position")


@case(
    "paginate",
    with_views("select candidate_id, cast((row_number() over (order by name, candidate_id)-1)//100+1 as int) as page from candidates_v", "candidates_v"),
)
def _paginate(t: Tables):
    from pagewatch.operators.ordered import global_rank

    ordered = global_rank(t("candidates_v"), [F.col("name"), F.col("candidate_id")], "position")
    return P.paginate(ordered, 100).select("candidate_id", "page")


FEED = (
    "feed",
    "select v.candidate_id||'#'||coalesce(fp,'0') as id, '" + SITE + "/'||v.candidate_id as url, case when na>1 and d1<d2 then 'Updated red-box guidance found for '||nm else nm||' — red-box guidance found' end as title, "
    "case when classification='ambiguous' then '" + P.CONFIRMED_LABEL + "' else '" + P.POSITIVE_LABEL + "' end || case when na>1 then ' · Newest guidance page: '||e.nurl||' · Quoted span: “'||e.nq||'”' "
    "else ' · Guidance page: '||page_url||' · Quoted span: “'||tq||'”' end as content_text, coalesce(ap, reviewed_at, classified_at) as date_published from "
    "(select *, name||' ('||case when office='P' then 'President' when office='S' then state||' Senate' else state||'-'||district end||')' as nm, case when detection_id%2=0 then upper(top_hash) else top_hash||' x' end as tq from vw) v left join "
    "(select candidate_id, count(*) as na, max(reviewed_at) as ap, min(cast(reviewed_at as date)) as d1, max(cast(reviewed_at as date)) as d2, substr(sha1(string_agg(text_hash,'|' order by text_hash)),1,8) as fp "
    "from exa where approved group by 1) a using (candidate_id) left join (select candidate_id, url as nurl, case when detection_id%2=0 then upper(text_hash) else text_hash||' x' end as nq from "
    f"(select *, row_number() over (partition by candidate_id order by reviewed_at desc, {ORDER}) as rx from exa where approved) x where rx=1) e using (candidate_id) "
    "where status='positive_published' order by date_published desc, state, district, name, v.candidate_id limit 50",
)


def _feed_rows(t: Tables):
    g = gathered(t)
    shown, exhibits, _ = P.public_view(standardize_names(g.views), g.exhibits, g.versions)
    return P.feed_items(shown, exhibits, SITE)


@case("feed_items", with_views("select * from feed", *SITE_VIEWS, extra=(*VIEW_CHAIN, FEED)))
def _feed(t: Tables):
    return _feed_rows(t).drop("candidate_id", "position")


@case(
    "publish_tables",
    with_views(
        f"select 'index' as part, count(*) as n from vw where {PUBLIC_SQL} union all select 'status_counts', count(distinct status) from vw union all select 'feed', count(*) from feed "
        f"union all select 'sitemap', count(*)+ceil(count(*)/500.0)::bigint+3 from vw where {PUBLIC_SQL}",
        *SITE_VIEWS, extra=(*VIEW_CHAIN, FEED),
    ),
)
def _publish(t: Tables):
    tables = publish_tables(gathered(t), True, F.lit("2026-06-01").cast("date"), site_url=SITE)
    out = None
    for part in ("index", "status_counts", "feed", "sitemap"):
        row = tables[part].agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


SHOWN_EXHIBITS = f"select * from exa where approved and candidate_id in (select candidate_id from vw where {PUBLIC_SQL})"


@case(
    "public_view_rows",
    with_views(
        f"select 'view' as part, candidate_id, status as content, cast(null as varchar) as exhibit from vw where {PUBLIC_SQL} union all select 'exhibit', candidate_id, url, text_hash from ({SHOWN_EXHIBITS}) e union all "
        f"select 'version', candidate_id, text_hash, exhibit_hash from vers where approved and (candidate_id,exhibit_hash) in (select (candidate_id,text_hash) from ({SHOWN_EXHIBITS}) e)",
        *SITE_VIEWS, extra=VIEW_CHAIN,
    ),
)
def _public_rows(t: Tables):
    g = gathered(t)
    views, exhibits, versions = P.public_view(g.views, g.exhibits, g.versions)
    row = lambda part, content, exhibit: (F.lit(part).alias("part"), "candidate_id", F.col(content).alias("content"), exhibit.alias("exhibit"))
    return (
        views.select(*row("view", "status", F.lit(None).cast("string")))
        .unionByName(exhibits.select(*row("exhibit", "url", F.col("text_hash"))))
        .unionByName(versions.select(*row("version", "text_hash", F.col("exhibit_hash"))))
    )


@case(
    "publish_tables_rows",
    with_views(
        "select 'index' as part, cast(candidate_id as varchar) as entry, position as n, cast((position-1)//500+1 as bigint) as page from idx union all select 'status_counts', status, count(*), null from vw group by status "
        "union all select 'feed', id||' '||title, null, null from feed union all select 'exhibits', candidate_id||' '||text_hash, null, null from (" + SHOWN_EXHIBITS + ") e",
        *SITE_VIEWS, extra=(*VIEW_CHAIN, FEED, (INDEX[0], INDEX[1].replace("from vw)", f"from vw where {PUBLIC_SQL})"))),
    ),
)
def _publish_rows(t: Tables):
    tables = publish_tables(gathered(t), True, F.lit("2026-06-01").cast("date"), site_url=SITE)
    none = F.lit(None).cast("long")
    entry = lambda part, text, n=none, page=none: tables[part].select(
        F.lit(part).alias("part"), text.cast("string").alias("entry"), n.cast("long").alias("n"), page.cast("long").alias("page")
    )
    return (
        entry("index", F.col("candidate_id"), F.col("position"), F.col("page"))
        .unionByName(entry("status_counts", F.col("status"), F.col("n")))
        .unionByName(entry("feed", F.concat_ws(" ", "id", "title")))
        .unionByName(entry("exhibits", F.concat_ws(" ", "candidate_id", "text_hash")))
    )


@case(
    "write_feed_and_sitemap_rows",
    with_views(
        "select '" + SITE + "/'||candidate_id as loc, strftime(coalesce(lastmod, date '2026-06-01'),'%Y-%m-%d') as lastmod from lm union all select '" + SITE + "/', '2026-06-01' union all "
        "select '" + SITE + "/index-'||cast(p as varchar), '2026-06-01' from (select unnest(range(2, cast(ceil((select count(*) from vw)/500.0) as bigint)+1)) as p) r "
        "union all select '" + SITE + "/'||s, '2026-06-01' from (values ('methodology'),('corrections'),('about')) v(s)",
        *SITE_VIEWS, extra=(*VIEW_CHAIN, LASTMOD),
    ),
)
def _sitemap(t: Tables):
    views = gathered(t).views
    pages = P.paginate(P.rank_index(views), 500).select("page")
    return sitemap_rows(views, pages, SITE, F.lit("2026-06-01").cast("date"))


@case(
    "feed_json_rows",
    with_views(
        "select row_number() over (order by date_published desc, state, district, name, candidate_id)::int as position, '{\"id\":'||to_json(id)||',\"url\":'||to_json(url)||',\"title\":'||to_json(title)||',\"content_text\":'||"
        "to_json(content_text)||coalesce(',\"date_published\":\"'||strftime(date_published,'%Y-%m-%dT%H:%M:%S.%g')||'\"','')||'}' as value from feed join (select candidate_id, state, district, name from vw) v on candidate_id=split_part(id,'#',1)",
        *SITE_VIEWS, extra=(*VIEW_CHAIN, FEED),
    ),
)
def _feed_json(t: Tables):
    return feed_json(_feed_rows(t))


@case("write_feed", with_views("select id, title from feed", *SITE_VIEWS, extra=(*VIEW_CHAIN, FEED)))
def _write_feed(t: Tables):
    path = f"{scratch_root(t.spark)}/pagewatch-feed-{uuid.uuid4().hex}"
    write_feed(_feed_rows(t), path)
    written = t.spark.read.text(path)
    return written.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.title").alias("title"))


# posted: one id per candidate, under the old suffix for half of them
_ITEMS = "select candidate_id||'#'||cast(c_custkey%7 as string) as id, c_custkey+1 as position from candidates_v where coalesce(inactive,0)=0"
_POSTED = "select candidate_id||'#'||cast(case when c_custkey%3=0 then c_custkey%7 else 9 end as string) as id from candidates_v where office<>'P'"


@case(
    "feed_delta",
    with_views(
        "select id, position, case when absorb then 'absorb' when row_number() over (partition by absorb order by position desc)<=5 then 'post' else 'wait' end as action from "
        "(select *, split_part(id,'#',1) in (select split_part(id,'#',1) from posted) as absorb from items where id not in (select id from posted)) x",
        "candidates_v", extra=(("items", _ITEMS), ("posted", _POSTED)),
    ),
)
def _feed_delta(t: Tables):
    return P.feed_delta(t.sql(_ITEMS, "candidates_v"), t.sql(_POSTED, "candidates_v"))
