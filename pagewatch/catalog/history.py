"""Change history, outside spending and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.catalog.core import Tables, case, with_views
from pagewatch.catalog.scalars import CANON_SQL, POSITIVE_SQL, USABLE_SQL
from pagewatch.operators import changes as C
from pagewatch.operators import money as M
from pagewatch.operators import review as V
from pagewatch.plans.changes import diff_scans, replay_and_reconcile, sweep_decisions, run_sweep
from pagewatch.plans.console import review_console_tables
from pagewatch.plans.money import corroborate
from pagewatch.session import write_through

NONE = "'no_guidance_detected'"
POS = POSITIVE_SQL.format("classification")

# ---------------------------------------------------------------- change history
SP = ("sp", f"select *, {CANON_SQL.format('url')} as pk, {USABLE_SQL.format('raw_text', 'http_status')} as usable, http_status in (404,410) as gone from scans_v")
H0 = (
    "h0",
    "select sp.*, coalesce(last_value(d.classification ignore nulls) over (partition by sp.candidate_id, text_hash order by sp.scan_id "
    f"rows between unbounded preceding and current row), {NONE}) as cls from sp left join detections_v d on d.scan_id=sp.scan_id",
)
H1 = (
    "h1",
    "select *, sum(usable::int) over w as g, not usable and gone and coalesce(lag(gone) over w, false) as cg from h0 "
    "window w as (partition by candidate_id, pk order by scan_id)",
)
H2 = (
    "h2",
    "select *, cg and sum(cg::int) over (partition by candidate_id, pk, g order by scan_id)=1 and max(case when usable then cls end) over "
    "(partition by candidate_id, pk, g) in ('red_box_guidance','ambiguous') as td from h1",
)
H3 = (
    "h3",
    f"select *, lag(scan_id) over w as bid, lag(case when td then {NONE} else cls end) over w as bcls, lag(case when td then null else text_hash end) "
    "over w as bhash from h2 where usable or td window w as (partition by candidate_id, pk order by scan_id)",
)
EV = (
    "ev",
    "select candidate_id, url, case when pp and not np then 'take_down' when np and not pp then 'put_up' when pp and np then 'modified' end as event_type, "
    "bid as prev_scan_id, scan_id as new_scan_id, bcls as prev_classification, ncls as new_classification, fetched_at as detected_at from "
    f"(select *, bcls in ('red_box_guidance','ambiguous') as pp, not td and cls in ('red_box_guidance','ambiguous') as np, case when td then {NONE} else cls end as ncls "
    "from h3 where bid is not null and (td or bhash is distinct from text_hash)) x where pp or np",
)
REPLAY = (SP, H0, H1, H2, H3, EV)
# the event log of a tracker that lost some events, got some wrong and invented others
RECORDED = (
    "recorded",
    "select new_scan_id*2 as change_id, candidate_id, url, case when new_classification='ambiguous' then 'put_up' else event_type end as event_type, prev_scan_id, new_scan_id, "
    "prev_classification, new_classification, detected_at from ev where prev_classification<>'ambiguous' union all "
    "select scan_id*2+1, candidate_id, url, 'take_down', null, scan_id, 'red_box_guidance', 'no_guidance_detected', fetched_at from sp where http_status=404 and render_mode='pdf' "
    "and scan_id not in (select new_scan_id from ev)",
)
DIFF = (
    "df",
    "select candidate_id, url, new_scan_id, status, event_type, recorded_event_type from (select coalesce(e.candidate_id,r.candidate_id) as candidate_id, "
    "coalesce(e.url,r.url) as url, coalesce(e.new_scan_id,r.new_scan_id) as new_scan_id, case when r.change_id is null then 'missing' when e.event_type is null then 'spurious' "
    "when e.event_type<>r.event_type or e.prev_classification<>r.prev_classification or e.new_classification<>r.new_classification then 'mismatched' end as status, "
    "e.event_type, r.event_type as recorded_event_type from ev e full join recorded r on e.candidate_id=r.candidate_id and e.url=r.url and e.new_scan_id=r.new_scan_id) x where status is not null",
)


@case(
    "phantom_404",
    with_views(
        "select scan_id, max((not gone)::int) over (partition by candidate_id, pk order by scan_id)=1 as recorded from sp", "scans_v", extra=(SP,)
    ),
)
def _phantom(t: Tables):
    return C.phantom_404(t("scans_v")).select("scan_id", "recorded")


UNCHANGED_SQL = with_views(
    "select scan_id, coalesce(text_hash=lag(text_hash) over (partition by candidate_id, pk order by scan_id),false) as unchanged from "
    "(select *, max((not gone)::int) over (partition by candidate_id, pk order by scan_id) as rec from sp) s where rec=1",
    "scans_v",
    extra=(SP,),
)


@case("unchanged_pages", UNCHANGED_SQL)
def _unchanged(t: Tables):
    return C.unchanged_pages(t("scans_v")).select("scan_id", "unchanged")


@case("verdict_as_of", with_views("select scan_id, cls as classification from h0", "scans_v", "detections_v", extra=(SP, H0)))
def _as_of(t: Tables):
    narrow = t("scans_v").select("scan_id", "candidate_id", "text_hash")
    return C.verdict_as_of(narrow, t("detections_v")).select("scan_id", "classification")


LATEST_BODY = (
    "lb",
    "select s.candidate_id, text_hash, arg_max(d.classification, d.detection_id) as cls from detections_v d join scans_v s on s.scan_id=d.scan_id group by 1,2",
)


@case(
    "verdict_latest",
    with_views(f"select scan_id, coalesce(cls,{NONE}) as classification from scans_v left join lb using (candidate_id,text_hash)", "scans_v", "detections_v", extra=(LATEST_BODY,)),
)
def _latest(t: Tables):
    return C.verdict_latest(t("scans_v"), t("detections_v")).select("scan_id", "classification")


def baseline_sql(scans: str = "sp", events: str = "change_events_v") -> str:
    return (
        "select coalesce(u.candidate_id,e.candidate_id) as candidate_id, coalesce(u.pk,e.pk) as page_key, "
        "case when u.scan_id is null or coalesce(e.new_scan_id>=u.scan_id,false) then e.new_scan_id else u.scan_id end as ref_scan_id, "
        "case when u.scan_id is null or coalesce(e.new_scan_id>=u.scan_id,false) then e.new_classification else u.cls end as classification, "
        "case when u.scan_id is null or coalesce(e.new_scan_id>=u.scan_id,false) then null else u.text_hash end as text_hash from "
        f"(select s.*, coalesce(lb.cls,{NONE}) as cls from (select *, row_number() over (partition by candidate_id, pk order by scan_id desc) as rn from {scans} where usable) s "
        "left join lb using (candidate_id,text_hash) where rn=1) u full join "
        f"(select * from (select *, {CANON_SQL.format('url')} as pk, row_number() over (partition by candidate_id, {CANON_SQL.format('url')} order by change_id desc) as rn from {events}) x where rn=1) e "
        "on u.candidate_id=e.candidate_id and u.pk=e.pk"
    )


@case("baseline_state", with_views(baseline_sql(), "scans_v", "detections_v", "change_events_v", extra=(SP, LATEST_BODY)))
def _baseline(t: Tables):
    return C.baseline_state(t("scans_v"), t("change_events_v"), t("detections_v"))


@case("replay_changes", with_views("select * from ev", "scans_v", "detections_v", extra=REPLAY))
def _replay(t: Tables):
    return C.replay_changes(t("scans_v"), t("detections_v"))


def recorded_events(t: Tables):
    ev = C.replay_changes(t("scans_v"), t("detections_v")).withColumn("change_id", F.col("new_scan_id") * 2)
    kept = ev.filter("prev_classification <> 'ambiguous'").withColumn(
        "event_type", F.when(F.col("new_classification") == "ambiguous", "put_up").otherwise(F.col("event_type"))
    )
    invented = t("scans_v").filter("http_status = 404 and render_mode = 'pdf'").join(
        ev.select(F.col("new_scan_id").alias("scan_id")), "scan_id", "left_anti"
    ).select(
        (F.col("scan_id") * 2 + 1).alias("change_id"), "candidate_id", "url", F.lit("take_down").alias("event_type"),
        F.lit(None).cast("bigint").alias("prev_scan_id"), F.col("scan_id").alias("new_scan_id"),
        F.lit("red_box_guidance").alias("prev_classification"), F.lit("no_guidance_detected").alias("new_classification"),
        F.col("fetched_at").alias("detected_at"),
    )
    return kept.unionByName(invented)


@case("reconcile_events", with_views("select * from df", "scans_v", "detections_v", extra=(*REPLAY, RECORDED, DIFF)))
def _reconcile(t: Tables):
    diff, _ = replay_and_reconcile(t("scans_v"), t("detections_v"), recorded_events(t))
    return diff.select("candidate_id", "url", "new_scan_id", "status", "event_type", "recorded_event_type")


@case("replay_and_reconcile_applied", with_views("select * from ev", "scans_v", "detections_v", extra=REPLAY))
def _applied(t: Tables):
    _, events = replay_and_reconcile(t("scans_v"), t("detections_v"), recorded_events(t), apply=True)
    return events.drop("change_id")


# the newest scan of each page is the sweep, everything before it is the history
SWEEP = ("sweep", "select * from (select *, row_number() over (partition by candidate_id, pk order by scan_id desc) as rn from sp) x where rn=1")
HIST = ("hist", "select * from sp where scan_id not in (select scan_id from sweep)")
HIST_LB = (
    "lb",
    "select s.candidate_id, text_hash, arg_max(d.classification, d.detection_id) as cls from detections_v d join hist s on s.scan_id=d.scan_id group by 1,2",
)
HIST_EV = ("hev", "select * from change_events_v where new_scan_id in (select scan_id from hist)")
BASE = ("base", baseline_sql("hist", "hev"))
PREV = ("prev", "select * from (select *, row_number() over (partition by candidate_id, pk order by scan_id desc) as rn from hist) x where rn=1")
DECIDE = (
    "dec",
    "select s.*, p.scan_id is not null or not s.gone as recorded, coalesce(p.text_hash=s.text_hash,false) as unchanged, p.http_status as prev_status, "
    "b.ref_scan_id as bid, b.classification as bcls, b.text_hash as bhash, trim(s.raw_text)='' or s.http_status<>200 as emptyish from sweep s "
    "left join prev p on p.candidate_id=s.candidate_id and p.pk=s.pk left join base b on b.candidate_id=s.candidate_id and b.page_key=s.pk",
)
LEAD = ("leadr", "select candidate_id, text_hash, min(scan_id) as lead from dec where recorded and not unchanged and not emptyish group by 1,2")
ACT = (
    "act",
    "select d.*, lead, case when not recorded then 'drop' when unchanged then 'unchanged' when emptyish then 'empty' when d.scan_id>lead then 'reuse' "
    "else 'classify' end as action from dec d left join leadr using (candidate_id,text_hash)",
)
SWEEP_CHAIN = (SP, SWEEP, HIST, HIST_LB, HIST_EV, BASE, PREV, DECIDE, LEAD, ACT)
SWEEP_VIEWS = ("scans_v", "detections_v", "change_events_v")


def _last_sweep(t: Tables):
    """The newest scan of each page as a sweep, with the history, events and detections before it. Scans are written, as a tracker's tables are."""
    scans = write_through(C.with_page_key(t("scans_v")).withColumn("content_type", F.lit("text/html")), "scans")
    last = scans.groupBy("candidate_id", "page_key").agg(F.max("scan_id").alias("scan_id")).select("scan_id")
    last = write_through(last, "last-scans")
    batch = write_through(scans.drop("page_key").join(last, "scan_id", "left_semi"), "batch")
    history = scans.drop("page_key").join(last, "scan_id", "left_anti")
    seen = scans.select("scan_id").join(last, "scan_id", "left_anti")
    old_dets = t("detections_v").join(seen, "scan_id", "left_semi")
    old_events = t("change_events_v").join(seen.withColumnRenamed("scan_id", "new_scan_id"), "new_scan_id", "left_semi")
    return batch, history, old_events, old_dets


def _decisions(t: Tables):
    return sweep_decisions(*_last_sweep(t))


@case("sweep_decisions", with_views("select scan_id, action from act", *SWEEP_VIEWS, extra=SWEEP_CHAIN))
def _sweep_decisions(t: Tables):
    return _decisions(t).select("scan_id", "action")


@case(
    "diff_scans",
    with_views(
        "select candidate_id, url, kind as event_type, bid as prev_scan_id, scan_id as new_scan_id, bcls as prev_classification, case when vanish then "
        f"{NONE} else ncls end as new_classification from (select *, case when changed then case when pp and not np then 'take_down' when np and not pp then 'put_up' when pp and np then 'modified' end "
        "when vanish then 'take_down' end as kind from (select *, usable and not unchanged and bhash is distinct from text_hash as changed, not usable and gone and prev_status in (404,410) "
        "and bcls in ('red_box_guidance','ambiguous') as vanish, bcls in ('red_box_guidance','ambiguous') as pp, ncls in ('red_box_guidance','ambiguous') as np from "
        f"(select act.*, case when action in ('classify','reuse') then d.classification else {NONE} end as ncls, d.classification as dcls from act left join detections_v d on d.scan_id=act.lead "
        "where recorded) a where bid is not null and not (action in ('classify','reuse') and dcls is null)) b) c where kind is not null",
        *SWEEP_VIEWS, extra=SWEEP_CHAIN,
    ),
)
def _diff(t: Tables):
    return diff_scans(_decisions(t), t("detections_v").select("scan_id", "classification")).drop("detected_at")


# the sweep as a job: pages whose id is divisible by 3 give a reply that cannot be read
TRIED = (
    "tried",
    "select d.*, l.lead, case when not recorded then 'drop' when unchanged then 'unchanged' when emptyish then 'empty' when d.scan_id=l.lead then 'classify' when d.scan_id>l.lead then 'reuse' else 'failed' end as action "
    "from dec d left join (select candidate_id, text_hash, min(scan_id) as lead from dec where recorded and not unchanged and not emptyish and scan_id%3<>0 group by 1,2) l using (candidate_id, text_hash)",
)
SAID = "case when lead%2=0 then 'red_box_guidance' else 'no_guidance_detected' end"
SWEPT = (
    "swept",
    "select *, case when changed then case when pp and not np then 'take_down' when np and not pp then 'put_up' when pp and np then 'modified' end when vanish then 'take_down' end as kind from "
    "(select *, usable and not unchanged and bhash is distinct from text_hash as changed, not usable and gone and prev_status in (404,410) and bcls in ('red_box_guidance','ambiguous') as vanish, "
    f"bcls in ('red_box_guidance','ambiguous') as pp, coalesce(ncls='red_box_guidance',false) as np from (select *, case when action in ('classify','reuse') then {SAID} else {NONE} end as ncls from tried where action<>'failed') a) b",
)
JOB_CHAIN = (*SWEEP_CHAIN[:-2], TRIED, SWEPT)


def _odd_reply(model: str):
    def score(chunks):
        cls = F.when(F.col("page_id") % 2 == 0, "red_box_guidance").otherwise("no_guidance_detected")
        reply = F.to_json(F.struct(cls.alias("classification"), F.lit(0.9).alias("confidence")))
        raw = F.when(F.col("page_id") % 3 == 0, "sorry, no verdict").otherwise(reply)
        return chunks.withColumns({"raw": raw, "model": F.lit(model)})

    return score


def _sweep(t: Tables):
    blocked = t("candidates_v").filter("c_custkey % 2 = 0")
    return run_sweep(*_last_sweep(t), blocked, _odd_reply("m1"), _odd_reply("m2"))


def _job(body: str) -> str:
    return with_views(body, *SWEEP_VIEWS, "candidates_v", extra=JOB_CHAIN)


@case("run_sweep_scans", _job("select scan_id, candidate_id, url from tried where action not in ('drop','failed')"))
def _run_scans(t: Tables):
    return _sweep(t).scans.select("scan_id", "candidate_id", "url")


@case("run_sweep_detections", _job(f"select scan_id, candidate_id, {SAID} as classification, 0.9::double as confidence, 'm1' as model from tried where action='classify'"))
def _run_detections(t: Tables):
    return _sweep(t).detections.select("scan_id", "candidate_id", "classification", "confidence", "model")


@case("run_sweep_quarantine", _job("select scan_id, candidate_id, 'unparseable verdict: sorry, no verdict' as error from tried where action='failed'"))
def _run_quarantine(t: Tables):
    return _sweep(t).quarantine.select("scan_id", "candidate_id", "error")


@case("run_sweep_events", _job("select candidate_id, scan_id as new_scan_id, bid as prev_scan_id, kind as event_type from swept where recorded and bid is not null and kind is not null"))
def _run_events(t: Tables):
    return _sweep(t).events.select("candidate_id", "new_scan_id", "prev_scan_id", "event_type")


@case(
    "run_sweep_outcome",
    _job(
        "select t.candidate_id, count(*) filter (where t.action not in ('failed','drop') and t.usable) as pages_scanned, count(*) filter (where t.action<>'failed' and (t.action='drop' or not t.usable)) as pages_failed, "
        "count(*) filter (where t.action='classify') as detections, count(*) filter (where t.action='reuse') as deduped, count(*) filter (where s.recorded and s.bid is not null and s.kind is not null) as changes, "
        "case when count(*) filter (where t.action not in ('failed','drop') and t.usable)>0 then 'scanned' when bool_or(coalesce(c.c_custkey%2=0,false)) then 'robots_blocked' else 'fetch_failed' end as scan_status "
        "from tried t left join swept s using (scan_id) left join candidates_v c on c.candidate_id=t.candidate_id group by 1"
    ),
)
def _run_outcome(t: Tables):
    return _sweep(t).outcome.select("candidate_id", "pages_scanned", "pages_failed", "detections", "deduped", "changes", "scan_status")


# ---------------------------------------------------------------- outside spending
LR = ("lr", "select detection_id, action, reviewed_at, reviewer as decided_by from (select *, row_number() over (partition by detection_id order by reviewed_at desc, review_id desc) as rn from reviews_v) x where rn=1")
OPEN = ("op", f"select d.* from detections_v d left join lr using (detection_id) where {POS} and coalesce(action,'')<>'reject'")
FIRST = ("fd", "select candidate_id, detection_id, classified_at from (select *, row_number() over (partition by candidate_id order by classified_at, detection_id) as rn from op) x where rn=1")
SPEND = (
    "spend",
    "select candidate_id, committee_id, coalesce(support_oppose_indicator,'?') as indicator, max(committee_name) as committee_name, sum(expenditure_amount) as amount, "
    "count(*) as n, min(expenditure_date) as first_date, max(expenditure_date) as last_date from ie_filings_v where cycle=2026 group by 1,2,3",
)
AFTER = (
    "aft",
    "select fd.candidate_id, coalesce(sum(case when expenditure_date>=cast(classified_at as date) then expenditure_amount end),0) as after from fd left join "
    "(select * from ie_filings_v where support_oppose_indicator='S') i using (candidate_id) group by 1",
)
MONEY_VIEWS = ("ie_filings_v", "detections_v", "reviews_v")


@case(
    "committee_spend",
    with_views("select candidate_id, committee_id, indicator, committee_name, cast(amount as double) as amount, n as count, first_date, last_date from spend", "ie_filings_v", extra=(SPEND,)),
)
def _committee(t: Tables):
    return M.committee_spend(t("ie_filings_v"), 2026).withColumn("amount", F.col("amount").cast("double"))


@case("positives_to_corroborate", with_views("select distinct candidate_id from op", *MONEY_VIEWS, extra=(LR, OPEN)))
def _positives(t: Tables):
    return M.positives_to_corroborate(t("detections_v"), t("reviews_v"))


@case("supporting_after", with_views("select candidate_id, cast(after as double) as after from aft", *MONEY_VIEWS, extra=(LR, OPEN, FIRST, AFTER)))
def _after(t: Tables):
    firsts = M.first_detected(t("detections_v"), t("reviews_v"))
    out = M.supporting_after(t("ie_filings_v"), firsts, 2026)
    return out.select("candidate_id", F.col("supporting_ie_total_after").cast("double").alias("after"))


CORR = (
    "corr",
    "select fd.candidate_id, fd.detection_id, cast(after as double) as after, cast(coalesce(sum(case when indicator='S' then amount end),0) as double) as supporting, "
    "cast(coalesce(sum(case when indicator='O' then amount end),0) as double) as opposing, coalesce(sum(n),0)::bigint as filings, "
    "coalesce(string_agg(committee_id||':'||indicator||':'||cast(n as varchar), ',' order by amount desc, committee_id, indicator),'') as spenders, "
    "string_agg(distinct case when indicator='S' then committee_name end, ', ' order by case when indicator='S' then committee_name end) as names "
    "from fd left join spend using (candidate_id) left join aft using (candidate_id) group by 1,2,3",
)
HEADLINE = (
    "case when filings=0 then 'No independent expenditures on file for this candidate yet.' else '$'||format('{:,.0f}',supporting)||"
    "' in supporting independent expenditures aligned with this candidate'||coalesce(' from '||names,'') end"
)


def _corroboration(t: Tables):
    return corroborate(t("ie_filings_v"), t("detections_v"), t("reviews_v"), 2026)


@case(
    "corroborate",
    with_views("select candidate_id, detection_id, after, supporting, opposing, filings, spenders from corr", *MONEY_VIEWS, extra=(LR, OPEN, FIRST, SPEND, AFTER, CORR)),
)
def _corroborate(t: Tables):
    spender = lambda s: F.concat_ws(":", s["committee_id"], s["indicator"], s["count"].cast("string"))
    return _corroboration(t).select(
        "candidate_id",
        "detection_id",
        F.col("supporting_ie_total_after").cast("double").alias("after"),
        F.col("supporting_total").cast("double").alias("supporting"),
        F.col("opposing_total").cast("double").alias("opposing"),
        F.col("ie_filing_count").alias("filings"),
        F.array_join(F.transform("spender_list", spender), ",").alias("spenders"),
    )


@case("headline", with_views(f"select candidate_id, {HEADLINE} as headline from corr", *MONEY_VIEWS, extra=(LR, OPEN, FIRST, SPEND, AFTER, CORR)))
def _headline(t: Tables):
    return _corroboration(t).select("candidate_id", "headline")


# ---------------------------------------------------------------- review
PB = ("pbod", f"select d.*, s.url, s.text_hash from detections_v d join scans_v s on s.scan_id=d.scan_id where {POS}")
MULTI = ("multi", "select text_hash from pbod group by 1 having count(distinct candidate_id)>1")
QUEUE = (
    "que",
    "select p.*, c.name, c.office from (select pbod.*, count(*) over (partition by candidate_id,text_hash)-1 as alias_count, row_number() over "
    "(partition by candidate_id,text_hash order by confidence desc, detection_id) as rn from pbod left join lr using (detection_id) where "
    "(action is null or action='needs_more') and candidate_id in (select candidate_id from candidates_v)) p join candidates_v c using (candidate_id) where rn=1",
)
RV = ("scans_v", "detections_v", "reviews_v", "candidates_v")


def _rv(t: Tables):
    return t("detections_v"), t("scans_v"), t("candidates_v"), t("reviews_v")


@case("latest_review", with_views("select detection_id, action from detections_v left join lr using (detection_id)", "detections_v", "reviews_v", extra=(LR,)))
def _latest_review(t: Tables):
    return V.with_latest_review(t("detections_v"), t("reviews_v")).select("detection_id", "action")


@case(
    "template_siblings",
    with_views(
        "select detection_id, url, min(detection_id) over w as group_id, count(*) over w as group_size, action as review_action, decided_by from pbod left join lr using (detection_id) "
        "window w as (partition by candidate_id, text_hash)",
        *RV, extra=(LR, PB),
    ),
)
def _siblings(t: Tables):
    d, s, _, r = _rv(t)
    return V.template_siblings(d, s, r).drop("candidate_id", "text_hash")


@case(
    "siblings_of",
    with_views(
        "select detection_id, action as review_action, decided_by from pbod left join lr using (detection_id)",
        *RV, extra=(LR, PB),
    ),
)
def _siblings_of(t: Tables):
    d, s, _, r = _rv(t)
    return V.siblings_of(d, V.template_siblings(d, s, r)).select("detection_id", "review_action", "decided_by")


@case(
    "twins_of",
    with_views(
        "select * from (select detection_id as asked_id, min(k) over body as body_id, min(k) over claim as claim_id, count(k) over body - count(k) over claim as n_twins "
        "from (select *, case when candidate_id in (select candidate_id from candidates_v) then detection_id end as k from pbod where candidate_id is not null) p "
        "where text_hash in (select text_hash from multi) window body as (partition by text_hash), claim as (partition by text_hash, candidate_id)) x where n_twins>0",
        *RV, extra=(LR, PB, MULTI),
    ),
)
def _twins_of(t: Tables):
    d, s, c, r = _rv(t)
    return V.twins_of(V.positive_bodies(d, s), V.cross_attribution_twins(d, s, c, r))


@case(
    "twin_bodies",
    with_views(
        "select a.detection_id, a.text_hash, count(case when b.candidate_id<>a.candidate_id then 1 end) as n_twins, count(distinct b.candidate_id) as n_candidates from "
        "(select p.* from pbod p join candidates_v c using (candidate_id) where text_hash in (select text_hash from multi)) a join (select p.* from pbod p join candidates_v c using (candidate_id)) b "
        "on a.text_hash=b.text_hash group by a.detection_id, a.text_hash",
        *RV, extra=(LR, PB, MULTI),
    ),
)
def _twin_bodies(t: Tables):
    d, s, c, r = _rv(t)
    return V.twin_bodies(V.cross_attribution_twins(d, s, c, r))


@case("multi_attribution_hashes", with_views("select * from multi", *RV, extra=(PB, MULTI)))
def _multi(t: Tables):
    d, s, _, _ = _rv(t)
    return V.multi_attribution_hashes(d, s)


@case(
    "cross_attribution_twins",
    with_views(
        "select text_hash, detection_id, candidate_id, name, url, action as review_action from pbod join candidates_v using (candidate_id) left join lr using (detection_id) "
        "where text_hash in (select text_hash from multi)",
        *RV, extra=(LR, PB, MULTI),
    ),
)
def _twins(t: Tables):
    d, s, c, r = _rv(t)
    return V.cross_attribution_twins(d, s, c, r).drop("office", "state", "district", "inactive")


@case(
    "pending_queue",
    with_views(
        "select candidate_id, text_hash, detection_id, confidence, name, office, url, alias_count, text_hash in (select text_hash from multi) as multi_attribution from que",
        *RV, extra=(LR, PB, MULTI, QUEUE),
    ),
)
def _queue(t: Tables):
    return V.pending_queue(*_rv(t)).select(
        "candidate_id", "text_hash", "detection_id", "confidence", "name", "office", "url", "alias_count", "multi_attribution"
    )


@case(
    "next_pending",
    with_views(
        "select detection_id from que where (candidate_id,text_hash) not in (select (candidate_id,text_hash) from pbod where confidence>0.5) order by confidence desc, detection_id limit 1",
        *RV, extra=(LR, PB, QUEUE),
    ),
)
def _next(t: Tables):
    d, s, c, r = _rv(t)
    pending = V.pending_detections(d, s, c, r)
    skip = d.filter("confidence > 0.5").join(
        s.select("scan_id", "text_hash"), "scan_id"
    ).filter(F.col("classification") != "no_guidance_detected")
    # an excluded detection blocks its whole body, so exclude by body through the open members
    blocked = pending.join(skip.select("candidate_id", "text_hash").distinct(), ["candidate_id", "text_hash"], "left_semi")
    return V.next_pending(V.pending_queue(d, s, c, r), pending, blocked)


@case(
    "recent_decisions",
    with_views(
        "select review_id, detection_id, action, name from reviews_v join detections_v using (detection_id) join candidates_v using (candidate_id) order by reviewed_at desc, review_id desc limit 20",
        *RV,
    ),
)
def _recent(t: Tables):
    d, _, c, r = _rv(t)
    return V.recent_decisions(r, d, c).select("review_id", "detection_id", "action", "name")


@case("url_queue", with_views("select candidate_id, name, cast(receipts as double) as receipts from candidates_v where website_url is null and coalesce(inactive,0)=0 and c_custkey%2=1", "candidates_v"))
def _url_queue(t: Tables):
    c = t("candidates_v").withColumns(
        {
            "url_source": F.when(F.col("c_custkey") % 2 == 0, "human_none").otherwise("none"),
            "universe_reason": F.lit(None).cast("string"),
        }
    )
    return V.url_queue(c).select("candidate_id", "name", F.col("receipts").cast("double").alias("receipts"))


@case(
    "pdf_evidence_backlog",
    with_views(
        f"select d.detection_id, d.candidate_id, s.url, coalesce(action,'pending') as action from detections_v d join scans_v s on s.scan_id=d.scan_id join candidates_v c on c.candidate_id=d.candidate_id "
        "left join lr using (detection_id) where render_mode='pdf' and classification<>'no_guidance_detected' and coalesce(action,'pending') in ('approve','pending') "
        "and not exists (select 1 from archives_v a where a.detection_id=d.detection_id and pdf_path is not null)",
        *RV, "archives_v", extra=(LR,),
    ),
)
def _pdf(t: Tables):
    d, s, c, r = _rv(t)
    return V.pdf_evidence_backlog(d, s, c, r, t("archives_v")).select("detection_id", "candidate_id", "url", "action")


@case(
    "junk_scans",
    with_views(
        "select scan_id from sp where http_status in (404,410) and scan_id not in (select scan_id from detections_v) and scan_id not in (select scan_id from archives_v) and "
        "not exists (select 1 from few e where e.prev_scan_id=sp.scan_id or e.new_scan_id=sp.scan_id) and not exists (select 1 from sp u where u.usable and u.candidate_id=sp.candidate_id and u.url=sp.url)",
        *RV, "archives_v", "change_events_v", extra=(SP, ("few", "select * from change_events_v where event_type<>'take_down'")),
    ),
)
def _junk(t: Tables):
    from pagewatch.functions.status import usable_scan

    s = t("scans_v")
    usable = s.filter(usable_scan(F.col("http_status"), F.col("raw_text"))).select("candidate_id", "url")
    events = t("change_events_v").filter("event_type <> 'take_down'")
    return V.junk_scans(s, usable, t("detections_v"), t("archives_v"), events).select("scan_id")


@case(
    "review_console_tables",
    with_views(
        "select 'queue' as part, count(*) as n from que union all select 'twins', count(*) from pbod where text_hash in (select text_hash from multi) and candidate_id in (select candidate_id from candidates_v) "
        "union all select 'siblings', count(*) from pbod union all select 'shared_bodies', count(*) from multi union all select 'recent', 20",
        *RV, extra=(LR, PB, MULTI, QUEUE),
    ),
)
def _console(t: Tables):
    d, s, c, r = _rv(t)
    c = c.withColumns({"url_source": F.lit("none"), "universe_reason": F.lit(None).cast("string")})
    tables = review_console_tables(d, s, c, r)
    out = None
    for part in ("queue", "twins", "siblings", "shared_bodies", "recent"):
        row = tables[part].agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@case(
    "review_console_rows",
    with_views(
        "select 'queue' as part, detection_id as id, text_hash as content, alias_count as n from que union all select 'siblings', detection_id, text_hash, count(*) over (partition by candidate_id, text_hash) from pbod "
        "union all select 'twins', detection_id, text_hash, cast(null as bigint) from pbod where text_hash in (select text_hash from multi) and candidate_id in (select candidate_id from candidates_v) "
        "union all select 'shared_bodies', null, text_hash, null from multi union all select 'recent', review_id, action, detection_id from "
        "(select * from reviews_v join detections_v using (detection_id) join candidates_v using (candidate_id) order by reviewed_at desc, review_id desc limit 20) r",
        *RV, extra=(LR, PB, MULTI, QUEUE),
    ),
)
def _console_rows(t: Tables):
    d, s, c, r = _rv(t)
    c = c.withColumns({"url_source": F.lit("none"), "universe_reason": F.lit(None).cast("string")})
    tables = review_console_tables(d, s, c, r)
    none = F.lit(None).cast("long")
    shown = {
        "queue": (F.col("detection_id"), F.col("text_hash"), F.col("alias_count")),
        "siblings": (F.col("detection_id"), F.col("text_hash"), F.col("group_size")),
        "twins": (F.col("detection_id"), F.col("text_hash"), none),
        "shared_bodies": (none, F.col("text_hash"), none),
        "recent": (F.col("review_id"), F.col("action"), F.col("detection_id")),
    }
    out = None
    for part, (key, content, n) in shown.items():
        rows = tables[part].select(
            F.lit(part).alias("part"), key.cast("long").alias("id"), content.alias("content"), n.cast("long").alias("n")
        )
        out = rows if out is None else out.unionByName(rows)
    return out
