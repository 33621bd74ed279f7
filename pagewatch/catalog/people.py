"""Universe, nominees, schedule and resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.catalog.core import Tables, case, with_views
from pagewatch.catalog.scalars import BLOCKED_SQL, DISTRICT_SQL, PARTY_SQL, RATING_SQL, SITE_HOST_SQL
from pagewatch.operators import nominees as N
from pagewatch.operators import resolve as R
from pagewatch.operators import schedule as S
from pagewatch.operators import universe as U
from pagewatch.plans.nominees import resolve_nominees, sweep_losers
from pagewatch.plans.universe import UniverseConfig, build_universe, funded_pool

TODAY = "2026-06-01"


def day(text: str = TODAY):
    return F.lit(text).cast("date")


def stamp():
    return F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")


# ---------------------------------------------------------------- universe
_SURNAME = (
    "list_filter(list_transform(string_split(upper(split_part(name,',',1)),' '), lambda x: trim(x,'.')), "
    "lambda x: x not in ('JR','SR','II','III','IV','V'))[1]"
)
FUNDED = ("fu", "select * from filings_v where receipts>=50000 or incumbent_challenge='I'")
DEDUPED = (
    "de",
    f"select * from (select *, row_number() over (partition by {_SURNAME}, office, state, district, "
    f"{PARTY_SQL.format('party')}, receipts order by incumbent_challenge='I' desc, "
    "(office<>'P' and substr(candidate_id,3,2)=upper(state) and substr(candidate_id,5,2)=lpad(district,2,'0')) desc, "
    "candidate_id desc) as rn from fu) x where rn=1",
)
POOL = ("pool", f"select *, {PARTY_SQL.format('party')} as pn from de where candidate_id not in (select candidate_id from inactive_v) and office<>'P'")
BUCKETS = ("bu", "select office, state, district, pn, count(*) as n from pool group by all")
RACES = ("ra", "select office, state, district, count(*) as gn, count(distinct pn) as gp from pool where receipts>=100000 group by all")
RATED = (
    "rated",
    "select office, state, d as district, arg_max(rating, seq) as competitive from (select office, state, seq, rating, "
    "unnest(case when district is null then ['','00'] else [district] end) as d from ratings_v where "
    + RATING_SQL.format("rating") + " in ('Toss-up','Tilt','Lean')) r group by all",
)
POP = (
    "pop",
    "select pool.*, n, competitive, coalesce(receipts>=100000 and gn>=2 and gp>=2, false) as general from pool "
    "join bu using (office,state,district,pn) left join ra using (office,state,district) left join rated using (office,state,district)",
)
CHAIN = (FUNDED, DEDUPED, POOL, BUCKETS, RACES, RATED, POP)
VIEWS_U = ("filings_v", "inactive_v", "ratings_v")


def label_sql(primary: str, nominee: str | None = None) -> str:
    parts = []
    if nominee:
        parts.append(f"case when {nominee} then 'nominee' end")
    parts += [
        f"case when {primary} and n>=2 then 'contested_primary' end",
        f"case when {primary} and general then 'contested_general' end",
        f"case when {primary} and competitive is not null then 'competitive_general' end",
        "case when incumbent_challenge='I' then 'incumbent' end",
        "case when n=1 and receipts>=50000 then 'funded_nominee' end",
    ]
    joined = "concat_ws('+'," + ",".join(parts) + ")"
    return f"case when {joined}='contested_primary+competitive_general' then 'both' else {joined} end"


def _pool(t: Tables):
    return funded_pool(t("filings_v"), UniverseConfig(), t("inactive_v"))


@case("funded", with_views("select candidate_id from fu where office in ('H','S')", "filings_v", extra=(FUNDED,)))
def _funded(t: Tables):
    return U.funded(t("filings_v"), offices=("H", "S")).select("candidate_id")


@case("on_ballot", with_views("select candidate_id from filings_v where office<>'P'", "filings_v"))
def _on_ballot(t: Tables):
    return U.on_ballot(t("filings_v"), 2026).select("candidate_id")


@case("drop_inactive", with_views("select candidate_id from filings_v where candidate_id not in (select candidate_id from inactive_v)", "filings_v", "inactive_v"))
def _drop_inactive(t: Tables):
    return U.drop_inactive(t("filings_v"), t("inactive_v")).select("candidate_id")


@case("dedupe_people", with_views("select candidate_id, name, cast(receipts as double) as receipts from de", "filings_v", extra=(FUNDED, DEDUPED)))
def _dedupe(t: Tables):
    return U.dedupe_people(U.funded(t("filings_v"))).select(
        "candidate_id", "name", F.col("receipts").cast("double").alias("receipts")
    )


@case("contested_primaries", with_views("select candidate_id from pop where n>=2", *VIEWS_U, extra=CHAIN))
def _contested(t: Tables):
    return U.contested_primaries(_pool(t))


@case("contested_generals", with_views("select candidate_id from pop where general", *VIEWS_U, extra=CHAIN))
def _generals(t: Tables):
    return U.contested_generals(_pool(t))


@case(
    "incumbents_and_presumptive_nominees",
    with_views(
        "select candidate_id, 'incumbent' as kind from pop where incumbent_challenge='I' union all "
        "select candidate_id, 'presumptive' from pop where n=1 and receipts>=50000",
        *VIEWS_U, extra=CHAIN,
    ),
)
def _incumbents(t: Tables):
    pool = _pool(t)
    return U.incumbents(pool).withColumn("kind", F.lit("incumbent")).unionByName(
        U.presumptive_nominees(pool).withColumn("kind", F.lit("presumptive"))
    )


@case("competitive_overlay", with_views("select candidate_id, competitive as rating from pop", *VIEWS_U, extra=CHAIN))
def _overlay(t: Tables):
    return U.competitive_overlay(_pool(t), t("ratings_v")).select("candidate_id", F.col("competitive_rating").alias("rating"))


UNIVERSE_SQL = (
    "select candidate_id, name, office, state, district, party, cast(receipts as double) as receipts, label as universe_reason, "
    "case when label in ('both') or contains(label,'competitive_general') then competitive end as rating from "
    f"(select *, {label_sql('true')} as label from pop) p where label<>''"
)


def _shown(df):
    return df.select(
        "candidate_id", "name", "office", "state", "district", "party",
        F.col("receipts").cast("double").alias("receipts"), "universe_reason", "rating",
    )


@case("contested_universe", with_views(UNIVERSE_SQL, *VIEWS_U, extra=CHAIN))
def contested_universe(t: Tables):
    return _shown(build_universe(t("filings_v"), ratings=t("ratings_v"), inactive=t("inactive_v")))


@case(
    "union_reasons",
    with_views(
        "select candidate_id, concat_ws('+', case when incumbent_challenge='I' then 'incumbent' end, case when receipts>=100000 then 'rich' end) as reasons from filings_v",
        "filings_v",
    ),
)
def _union_reasons(t: Tables):
    r = U.union_reasons({"incumbent": U.is_incumbent(), "rich": F.col("receipts") >= 100000})
    return t("filings_v").select("candidate_id", F.array_join(r, "+").alias("reasons"))


@case(
    "disposition_counts",
    with_views(
        f"select 'reason' as kind, label, count(*) as n from (select {label_sql('true')} as label from pop) p where label<>'' group by label",
        *VIEWS_U, extra=CHAIN,
    ),
)
def _disposition(t: Tables):
    return U.disposition_counts(build_universe(t("filings_v"), ratings=t("ratings_v"), inactive=t("inactive_v")))


@case(
    "orphans",
    with_views(
        "select candidate_id, office, state from candidates_v where coalesce(inactive,0)=0 and office in ('H','S') "
        "and candidate_id not in (select candidate_id from pop where n>=2)",
        "candidates_v", *VIEWS_U, extra=CHAIN,
    ),
)
def _orphans(t: Tables):
    produced = U.contested_primaries(_pool(t))
    return U.orphans(t("candidates_v"), produced, 2026, offices=("H", "S")).select("candidate_id", "office", "state")


# ---------------------------------------------------------------- nominees
def _bucket_cols(prefix: str = "") -> str:
    o, s, d, p = (f"{prefix}{c}" for c in ("office", "state", "district", "party"))
    return f"{o} as bo, upper({s}) as bs, {DISTRICT_SQL.format(o, d)} as bd, {PARTY_SQL.format(p)} as bp"


PEOPLE_B = (
    "pb",
    f"select candidate_id, name, inactive, state, office, district, c_custkey, {_bucket_cols()}, lower(trim(split_part(name,',',1))) as la, "
    "lower(list_filter(string_split(trim(split_part(name,',',2)),' '), lambda x: trim(x,'.') not in "
    "('DR','JR','SR','II','III','IV','MR','MRS','MS','ESQ','COL','HON','REV'))[1]) as fa from people_v",
)
CALLS = (
    "calls",
    "select seq, state as bs, office as bo, " + DISTRICT_SQL.format("office", "district") + " as bd, "
    + PARTY_SQL.format("winner_party") + " as bp, winner_name, nullif(substr(election_date,1,10),'') as election_date, "
    "lower(case when contains(winner_name,',') then split_part(winner_name,', ',1) else split_part(winner_name,' ',-1) end) as lb, "
    "lower(case when contains(winner_name,',') then split_part(split_part(winner_name,', ',2),' ',1) else split_part(winner_name,' ',1) end) as fb "
    "from (select *, province as state, case type when 'U.S. House' then 'H' when 'Senate' then 'S' end as office from races_v "
    "where called and election_type='Primary' and (election_date='' or substr(election_date,1,4)='2026')) r where office is not null",
)
LATEST_CALL = (
    "lc",
    "select * from (select *, row_number() over (partition by bo,bs,bd,bp order by coalesce(election_date,'') desc, seq) as rn from calls) x where rn=1",
)
HITS = (
    "hits",
    "select bo,bs,bd,bp, pb.candidate_id, case when fb='' then 1 when fa=fb then 3 when starts_with(fa,fb) or starts_with(fb,fa) "
    "then 2 else 0 end as r from lc join pb using (bo,bs,bd,bp) where la=lb and (fb='' or starts_with(fa,fb) or "
    "starts_with(fb,fa) or fa[1]=fb[1])",
)
XWALK = (
    "xw",
    "select bo,bs,bd,bp, case when count(*)=1 then max(candidate_id) end as candidate_id from "
    "(select *, max(r) over (partition by bo,bs,bd,bp) as best from hits) h where r=best group by bo,bs,bd,bp",
)
X_CHAIN = (PEOPLE_B, CALLS, LATEST_CALL, HITS, XWALK)


def race_documents(t: Tables):
    """Races as the nested documents the results feed delivers."""
    r = t("races_v")
    loser = F.struct(F.lit("Somebody Else").alias("name"), F.lit("IND").alias("party"), F.lit(False).alias("winner"))
    top = F.struct(F.col("winner_name").alias("name"), F.col("winner_party").alias("party"), F.col("called").alias("winner"))
    return r.select("seq", "type", "province", "district", "election_type", "election_date", F.array(loser, top).alias("candidates"))


def feed_calls(t: Tables):
    from pagewatch.sources.readers import called_winners

    return called_winners(race_documents(t), 2026)


CALL_COLUMNS = "bo as office, bs as state, bd as district, bp as party, winner_name"


@case("read_results_feed", with_views(f"select seq, {CALL_COLUMNS}, election_date from calls", "people_v", "races_v", extra=(CALLS,)))
def _feed(t: Tables):
    return feed_calls(t).drop("source")


@case("latest_call", with_views(f"select seq, {CALL_COLUMNS} from lc", "races_v", extra=(CALLS, LATEST_CALL)))
def _latest_call(t: Tables):
    return N.latest_call(feed_calls(t)).drop("source", "election_date")


@case(
    "crosswalk",
    with_views("select bo as office, bs as state, bd as district, bp as party, xw.candidate_id from lc left join xw using (bo,bs,bd,bp)", "people_v", "races_v", extra=X_CHAIN),
)
def _crosswalk(t: Tables):
    matched = N.crosswalk(N.latest_call(feed_calls(t)), t("people_v"))
    return matched.select("office", "state", "district", "party", "candidate_id")


@case(
    "crosswalk_rate",
    with_views(
        "select count(*) as calls, count(xw.candidate_id) as matched, count(*)-count(xw.candidate_id) as unmatched, "
        "round(100.0*count(xw.candidate_id)/count(*)) as pct from lc left join xw using (bo,bs,bd,bp)",
        "people_v", "races_v", extra=X_CHAIN,
    ),
)
def _crosswalk_rate(t: Tables):
    return N.crosswalk_rate(N.crosswalk(N.latest_call(feed_calls(t)), t("people_v"))).withColumn("pct", F.col("pct").cast("double"))


SIZES = ("sz", "select bo,bs,bd,bp,count(*) as members,max(candidate_id) as lone from pb group by all")
MANUAL = (
    "man",
    "select sz.bo,sz.bs,sz.bd,sz.bp, o.candidate_id, coalesce(pb.name, o.name) as name, pb.name is null as missing from sz join "
    "overrides_v o on o.key=bo||'-'||bs||'-'||bd||'-'||bp left join pb on pb.candidate_id=o.candidate_id and pb.bo=sz.bo and pb.bs=sz.bs and pb.bd=sz.bd and pb.bp=sz.bp",
)
RESOLVED = (
    "res",
    "select bo,bs,bd,bp,candidate_id,name,'manual' as source from man union all "
    "select bo,bs,bd,bp,lone,pb.name,'uncontested' from sz join pb using (bo,bs,bd,bp) where members=1 and bs not in ('AK','CA','WA') "
    "and not exists (select 1 from man where man.bo=sz.bo and man.bs=sz.bs and man.bd=sz.bd and man.bp=sz.bp) union all "
    "select bo,bs,bd,bp,xw.candidate_id,pb.name,'feed:feed' from sz join xw using (bo,bs,bd,bp) join pb using (bo,bs,bd,bp,candidate_id) where members>=2 and bs not in ('AK','CA','WA') "
    "and not exists (select 1 from man where man.bo=sz.bo and man.bs=sz.bs and man.bd=sz.bd and man.bp=sz.bp)",
)
R_CHAIN = (*X_CHAIN, SIZES, MANUAL, RESOLVED)
VIEWS_N = ("people_v", "races_v", "overrides_v")


@case("override_nominees", with_views("select bo as b_office, bs as b_state, bd as b_district, bp as b_party, candidate_id, name, missing from man", *VIEWS_N, extra=(PEOPLE_B, SIZES, MANUAL)))
def _overrides(t: Tables):
    return N.override_nominees(t("people_v"), t("overrides_v")).drop("source", "confidence")


@case(
    "resolve_nominees",
    with_views("select bo as b_office, bs as b_state, bd as b_district, bp as b_party, candidate_id, name, source from res", *VIEWS_N, extra=R_CHAIN),
)
def _resolve(t: Tables):
    return resolve_nominees(t("people_v"), t("overrides_v"), feed_calls(t))[0].drop("confidence", "missing")


@case(
    "resolve_nominees_unresolved",
    with_views(
        "select bo as b_office, bs as b_state, bd as b_district, bp as b_party, members from sz where members>=2 and (bo,bs,bd,bp) not in (select (bo,bs,bd,bp) from res)",
        *VIEWS_N, extra=R_CHAIN,
    ),
)
def _unresolved(t: Tables):
    return resolve_nominees(t("people_v"), t("overrides_v"), feed_calls(t))[1]


ELECTION_DATES = ("ed", "select state, office, primary_date from elections_v")
PHASE = (
    "ph",
    "select pop.*, case when coalesce(date '" + TODAY + "' > case when a.state is not null then a.primary_date when b.state is not null "
    "then b.primary_date else c.primary_date end, false) then 'general' else 'primary' end as phase, nm.source as nominee from pop "
    "left join ed a on a.state=pop.state and a.office=pop.office||':'||pop.district left join ed b on b.state=pop.state and b.office=pop.office "
    "left join ed c on c.state=pop.state and c.office='' left join (select candidate_id, min(source) as source from res group by all) nm on nm.candidate_id=pop.candidate_id",
)


def _mode_universe(t: Tables, mode: str):
    nominees = resolve_nominees(t("people_v"), t("overrides_v"), feed_calls(t))[0]
    return build_universe(
        t("filings_v"), mode=mode, ratings=t("ratings_v"), nominees=nominees, inactive=t("inactive_v"),
        primary_dates=t("elections_v"), today=day(),
    ).select("candidate_id", "universe_reason", "nominee_source")


def _mode_sql(primary: str, nominee: str) -> str:
    return (
        f"select candidate_id, label as universe_reason, case when {nominee} then nominee end as nominee_source from "
        f"(select *, {label_sql(primary, nominee)} as label from ph) p where label<>''"
    )


_MODE_VIEWS = (*VIEWS_U, *VIEWS_N, "elections_v")
_MODE_CHAIN = (*CHAIN, *R_CHAIN, ELECTION_DATES, PHASE)


@case("universe_general_mode", with_views(_mode_sql("false", "nominee is not null"), *_MODE_VIEWS, extra=_MODE_CHAIN))
def _general(t: Tables):
    return _mode_universe(t, "general")


@case("universe_full_mode", with_views(_mode_sql("phase='primary'", "(phase='general' and nominee is not null)"), *_MODE_VIEWS, extra=_MODE_CHAIN))
def _full(t: Tables):
    return _mode_universe(t, "full")


@case(
    "exclude_unvoted",
    with_views(
        "select candidate_id from candidates_v c where not exists (select 1 from elections_v e where e.office<>'' and e.primary_date>=date '"
        + TODAY + "' and e.state=c.state and (e.office=c.office or e.office=c.office||':'||c.district))",
        "candidates_v", "elections_v",
    ),
)
def _unvoted(t: Tables):
    return N.exclude_unvoted(t("candidates_v"), N.unvoted_races(t("elections_v"), day())).select("candidate_id")


@case(
    "settled_states",
    with_views(
        "select state, case when greatest(primary_date, runoff_date)<date '" + TODAY + "' then 'past' else 'held' end as disposition "
        "from elections_v where office='' and primary_date<date '" + TODAY + "'",
        "elections_v",
    ),
)
def _settled(t: Tables):
    return N.settled_states(t("elections_v"), day())


# nominees among the swept rows only: the same chain over a narrower people table
SWEPT_B = (
    "pb",
    PEOPLE_B[1].replace(
        "from people_v",
        "from people_v c where coalesce(inactive,0) in (0,3) and state in (select state from elections_v where office='' and "
        f"greatest(primary_date,runoff_date)<date '{TODAY}') and not exists (select 1 from elections_v e where e.office<>'' and "
        f"e.primary_date>=date '{TODAY}' and e.state=c.state and (e.office=c.office or e.office=c.office||':'||c.district))",
    ),
)
SWEEP_CHAIN = (SWEPT_B, CALLS, LATEST_CALL, HITS, XWALK, SIZES, MANUAL, RESOLVED)
MOVES = (
    "mv",
    "select candidate_id, bs as state, coalesce(inactive,0)=3 as marked, case when resolved and not won then case when coalesce(inactive,0)<>3 "
    "then 'lost' end when coalesce(inactive,0)=3 then 'clear' end as move from (select pb.*, exists (select 1 from res where res.bo=pb.bo "
    "and res.bs=pb.bs and res.bd=pb.bd and res.bp=pb.bp) as resolved, exists (select 1 from res where res.candidate_id=pb.candidate_id) as won "
    "from pb where bs not in ('AK','CA','WA')) p",
)
GUARD = (
    "gd",
    "select state, sum((move='clear')::int) as n_clear, sum(marked::int) as n_marked, sum((move='clear')::int) > greatest(5.0, 0.2*sum(marked::int)) as refused "
    "from mv group by state having sum((move='clear')::int)>0",
)


def _sweep(t: Tables):
    return sweep_losers(
        t("people_v").withColumn("updated_at", F.lit(None).cast("timestamp_ntz")),
        t("elections_v"), t("overrides_v"), feed_calls(t), None, 2026, day(), stamp(),
    )


@case(
    "flag_losers_moves",
    with_views(
        "select candidate_id, mv.state, case when move='clear' and refused then 'refused' else move end as move from mv left join gd using (state) where move is not null",
        *VIEWS_N, "elections_v", extra=(*SWEEP_CHAIN, MOVES, GUARD),
    ),
)
def _moves(t: Tables):
    return _sweep(t)[1]


@case(
    "flag_losers",
    with_views(
        "select p.candidate_id, case when m.move='lost' then 3 when m.move='clear' and not coalesce(refused,false) then null else p.inactive end as inactive "
        "from people_v p left join mv m using (candidate_id) left join gd on gd.state=m.state union all "
        "select distinct candidate_id, cast(null as int) from res where source='manual' and candidate_id not in (select candidate_id from people_v)",
        *VIEWS_N, "elections_v", extra=(*SWEEP_CHAIN, MOVES, GUARD),
    ),
)
def _flag(t: Tables):
    return _sweep(t)[0].select("candidate_id", "inactive")


@case(
    "mass_clear_guard",
    with_views(
        "select state, count(*) as n_clear, m as n_marked, count(*)>greatest(5.0,0.2*m) as refused from candidates_v join "
        "(select state, count(*) as m from candidates_v where inactive=3 group by state) k using (state) where inactive=3 and office='H' group by state, m",
        "candidates_v",
    ),
)
def _guard(t: Tables):
    marked = t("candidates_v").filter("inactive = 3")
    return N.mass_clear_guard(marked.filter("office = 'H'"), marked)


@case(
    "sync_inactive",
    with_views(
        "select candidate_id, case when coalesce(inactive,0)=0 and party='IND' then 1 when inactive=1 and party<>'IND' then null else inactive end as inactive from candidates_v",
        "candidates_v",
    ),
)
def _sync(t: Tables):
    c = t("candidates_v").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return N.sync_inactive(c, c.filter("party = 'IND'"), stamp()).select("candidate_id", "inactive")


@case("resolver_counts", with_views("select split_part(source,':',1) as source, count(*) as n from res group by 1", *VIEWS_N, extra=R_CHAIN))
def _resolver_counts(t: Tables):
    return N.resolver_counts(resolve_nominees(t("people_v"), t("overrides_v"), feed_calls(t))[0])


# ---------------------------------------------------------------- schedule
DATED = (
    "dated",
    "select c.*, coalesce(a.primary_date,b.primary_date,s.primary_date) as primary_date from candidates_v c "
    "left join elections_v a on a.state=c.state and a.cycle=c.cycle and a.office=c.office||':'||c.district "
    "left join elections_v b on b.state=c.state and b.cycle=c.cycle and b.office=c.office "
    "left join elections_v s on s.state=c.state and s.cycle=c.cycle and s.office=''",
)


def dated_candidates(t: Tables):
    c = t("candidates_v").withColumn("primary_date", F.lit(None).cast("date"))
    return S.lookup_primary_date(c, t("elections_v"))


@case("lookup_primary_date", with_views("select candidate_id, primary_date from dated", "candidates_v", "elections_v", extra=(DATED,)))
def _lookup(t: Tables):
    return dated_candidates(t).select("candidate_id", "primary_date")


# scan times moved from January 2024 to May 2026, and one attempt stamp per candidate
_SHIFTED = "fetched_at + interval '860 days'"


def _recent(t: Tables):
    scans = t("scans_v").withColumn("fetched_at", F.expr(_SHIFTED))
    attempt = F.when(F.col("c_custkey") % 5 == 0, F.lit("2026-05-20 00:00:00").cast("timestamp_ntz"))
    return dated_candidates(t).withColumn("last_attempt_at", attempt), scans


ACTIVITY = (
    "act",
    "select dated.*, greatest(m, case when c_custkey%5=0 then timestamp '2026-05-20 00:00:00' end) as last_activity from dated left join "
    f"(select candidate_id, max({_SHIFTED}) as m from scans_v group by 1) s using (candidate_id)",
)


@case("last_activity", with_views("select candidate_id, last_activity from act", "candidates_v", "elections_v", "scans_v", extra=(DATED, ACTIVITY)))
def _activity(t: Tables):
    c, scans = _recent(t)
    return S.last_activity(c, scans).select("candidate_id", "last_activity")


DUE = (
    "due",
    "select candidate_id, cadence, dp as days_to_primary, dg as days_to_general from (select *, case when coalesce(dp,dg)<=21 then 'daily' else 'weekly' end as cadence "
    f"from (select candidate_id, last_activity, case when date '{TODAY}'<=primary_date then date_diff('day',date '{TODAY}',primary_date) end as dp, "
    f"case when not coalesce(date '{TODAY}'<=primary_date,false) then date_diff('day',date '{TODAY}',date '2026-11-03') end as dg from act "
    "where coalesce(inactive,0)=0 and website_url is not null) a) b where last_activity is null or date_diff('day',cast(last_activity as date),date '"
    + TODAY + "')>=case cadence when 'daily' then 1 else 7 end",
)


@case("due_candidates", with_views("select * from due", "candidates_v", "elections_v", "scans_v", extra=(DATED, ACTIVITY, DUE)))
def _due(t: Tables):
    c, scans = _recent(t)
    return S.due_candidates(c, t("elections_v"), scans, day()).select("candidate_id", "cadence", "days_to_primary", "days_to_general")


@case(
    "scannable",
    with_views(
        "select 'new' as mode, candidate_id from candidates_v where website_url is not null and coalesce(inactive,0)=0 and c_custkey%3<>0 "
        "union all select 'due', candidate_id from due",
        "candidates_v", "elections_v", "scans_v", extra=(DATED, ACTIVITY, DUE),
    ),
)
def _scannable(t: Tables):
    c, scans = _recent(t)
    c = c.withColumn("scan_status", F.when(F.col("c_custkey") % 3 == 0, "scanned"))
    due = S.due_candidates(c, t("elections_v"), scans, day())
    new = S.scannable(c).select(F.lit("new").alias("mode"), "candidate_id")
    return new.unionByName(S.scannable(c, "due", due).select(F.lit("due").alias("mode"), "candidate_id"))


@case("already_attempted", with_views("select count(*) as skipped from candidates_v where website_url is not null and coalesce(inactive,0)=0 and office='H'", "candidates_v"))
def _attempted(t: Tables):
    return S.already_attempted(t("candidates_v").withColumn("scan_status", F.when(F.col("office") == "H", "scanned")))


@case("scan_counts", with_views("select candidate_id, count(*) as scan_count, max(fetched_at) as last_scanned from scans_v group by 1", "scans_v"))
def _scan_counts(t: Tables):
    return S.scan_counts(t("scans_v"))


# ---------------------------------------------------------------- resolution
def _sourced(t: Tables):
    source = F.when(F.col("website_url").isNull(), F.when(F.col("c_custkey") % 2 == 0, "human_none").otherwise("none")).otherwise("search")
    return t("candidates_v").withColumn("url_source", source)


@case(
    "resolve_targets",
    with_views(
        "select disposition, count(*) as n from (select case when url_verified then 'manual (kept)' when website_url is null and c_custkey%2=0 then "
        "'human_none (kept)' when coalesce(inactive,0)<>0 then 'inactive (skipped)' when website_url is not null then 'search (kept)' else 'attempt' end "
        "as disposition from candidates_v) d group by 1",
        "candidates_v",
    ),
)
def _targets(t: Tables):
    return R.resolve_targets(_sourced(t)).groupBy("disposition").agg(F.count("*").alias("n"))


# search hits: ten ranked links per candidate, some blocked; the answer names one of them
_HITS_SQL = (
    "select candidate_id, c_custkey, r as rank, case when (c_custkey+r)%4=0 then 'https://www.facebook.com/'||candidate_id "
    "else 'https://www.site'||cast(c_custkey+r as string)||'.example/home' end as link from candidates_v cross join (values {0}) v(r)"
)
_RANKS = ",".join(f"({i})" for i in range(1, 11))
_ANSWER = (
    "case when c_custkey%5=0 then 'NONE' when c_custkey%5=1 then 'https://other.example' else 'The site is https://site'||"
    "cast(c_custkey+c_custkey%10+1 as string)||'.example.' end"
)
SEARCH = (
    "se",
    "select h.candidate_id, arg_min(link, rank) as url from (select *, row_number() over (partition by candidate_id order by rank) as rn from hits_t where not "
    + BLOCKED_SQL.format(SITE_HOST_SQL.format("link")) + ") h join (select candidate_id, " + _ANSWER + " as a from candidates_v) q using (candidate_id) "
    "where rn<=8 and " + SITE_HOST_SQL.format("link") + " = regexp_extract(a,'https://([a-z0-9]+\\.example)',1) group by 1",
)
HITS_T = ("hits_t", _HITS_SQL.format(_RANKS))


def search_results(t: Tables):
    ranks = F.explode(F.array(*[F.lit(i) for i in range(1, 11)]))
    hits = t("candidates_v").select("candidate_id", "c_custkey", ranks.alias("rank")).withColumn(
        "link",
        F.expr(
            "case when (c_custkey+rank)%4=0 then 'https://www.facebook.com/'||candidate_id "
            "else 'https://www.site'||cast(c_custkey+rank as string)||'.example/home' end"
        ),
    )
    answers = t("candidates_v").select("candidate_id", F.expr(_ANSWER).alias("answer"))
    return R.select_search_result(hits, answers)


@case("select_search_result", with_views("select * from se", "candidates_v", extra=(HITS_T, SEARCH)))
def _select(t: Tables):
    return search_results(t)


_TITLE = (
    "case c_custkey%4 when 0 then trim(split_part(name,',',1))||' family' when 1 then 'List of people' "
    "else feed_given||' '||split_part(name,',',1) end"
)


@case(
    "encyclopedia_site",
    with_views(
        "select candidate_id, 'https://campaign'||cast(c_custkey as varchar)||'.example' as url from (select *, lower(" + _TITLE + ") as t, la, fa from people_v join "
        "(select candidate_id, la, fa from pb) x using (candidate_id)) p where contains(t, la) and (contains(t, fa) or length(fa)<3) and c_custkey%3<>0",
        "people_v", extra=(PEOPLE_B,),
    ),
)
def _encyclopedia(t: Tables):
    p = t("people_v")
    wikitext = F.expr(
        "case when c_custkey%3=0 then 'no infobox' else '| website = {{URL|https://campaign'||cast(c_custkey as string)||'.example}}' end"
    )
    articles = p.select("candidate_id", F.lit(1).alias("rank"), F.expr(_TITLE).alias("title"), wikitext.alias("wikitext"))
    return R.encyclopedia_site(p, articles)


@case(
    "resolution_chain",
    with_views(
        "select c.candidate_id, case when office='P' then 'https://m.example' when party='DEM' then 'https://w.example' when party='GOP' then 'http://c.example' else se.url end as url, "
        "case when office='P' then 'manual' when party='DEM' then 'wikipedia' when party='GOP' then 'committee' when se.url is not null then 'search' else 'none' end as url_source, "
        "office='P' and c_custkey%2=0 as url_verified from candidates_v c left join se using (candidate_id)",
        "candidates_v", extra=(HITS_T, SEARCH),
    ),
)
def _chain(t: Tables):
    c = t("candidates_v")
    overrides = c.filter("office = 'P'").select(
        "candidate_id", F.lit("https://m.example").alias("url"), (F.col("c_custkey") % 2 == 0).alias("verified")
    )
    wiki = c.filter("party = 'DEM'").select("candidate_id", F.lit("https://w.example").alias("url"))
    filed = F.explode(F.array(F.lit("see web"), F.lit("http://c.example"), F.lit("http://d.example")))
    committees = c.filter("party = 'GOP'").select("candidate_id", filed.alias("url")).withColumn(
        "seq", F.when(F.col("url") == "http://d.example", 3).otherwise(2)
    )
    return R.resolution_chain(c, overrides, wiki, committees, search_results(t))


@case(
    "apply_resolution",
    with_views(
        "select c.candidate_id, case when url_verified or coalesce(inactive,0)<>0 then website_url else se.url end as website_url, case when url_verified or coalesce(inactive,0)<>0 then 'old' "
        "when se.url is not null then 'search' when website_url is not null then 'none' else 'old' end as url_source from candidates_v c left join se using (candidate_id)",
        "candidates_v", extra=(HITS_T, SEARCH),
    ),
)
def _apply(t: Tables):
    c = t("candidates_v").withColumns({"url_source": F.lit("old"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    found = search_results(t).withColumns({"url_source": F.lit("search"), "url_verified": F.lit(False)})
    return R.apply_resolution(c, found, stamp(), force=True).select("candidate_id", "website_url", "url_source")


@case(
    "robots_posture",
    "select page_id, case when h like 'blog.%' then 'override' else 'respect' end as posture from "
    "(select page_id, regexp_extract(url,'//([^/?#]*)',1) as h from pages) p",
)
def _posture(t: Tables):
    p = t("pages").withColumn("host", F.regexp_extract("url", "//([^/?#]*)", 1))
    # only blog hosts are overridden, written with case, port and www variants
    overrides = p.filter("host like 'blog.%'").select(
        F.concat(F.lit("WWW."), F.upper("host"), F.lit(":443")).alias("host"), F.lit(" Override ").alias("posture")
    ).distinct()
    return R.robots_posture(p.select("page_id", "url"), overrides).select("page_id", "posture")

