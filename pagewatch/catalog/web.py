"""Web-corpus, evaluation, table-merge and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewatch.catalog.core import Tables, case, with_views
from pagewatch.catalog.history import PB, REPLAY, SP, UNCHANGED_SQL
from pagewatch.catalog.people import CALL_COLUMNS, CALLS, race_documents
from pagewatch.catalog.scalars import CANON_SQL, HOST_SQL, PROSE_PATTERNS, any_path_sql, signal_sql
from pagewatch.catalog.site import _ITEMS, _POSTED
from pagewatch.catalog.sources import VIEWS
from pagewatch.functions import urls
from pagewatch.functions.status import usable_scan
from pagewatch.operators import corpus as W
from pagewatch.operators import evaluate as E
from pagewatch.schemas import evolve_schema
from pagewatch.session import scratch_root
from pagewatch.sources import partitioned, readers, tables
from pagewatch.sources.sinks import universe_csv_rows, write_universe_csv
from pagewatch.streaming import stateful
from pagewatch.streaming.jobs import run_available, stream_feed_delta, table_stream

NOW = "2026-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def scratch(t: Tables, name: str) -> str:
    return f"{scratch_root(t.spark)}/pagewatch-{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- corpus
@case(
    "prefilter",
    with_views(
        "select page_id, score, reason, reason<>'boilerplate_empty' as scan from (select page_id, " + signal_sql("raw_text", PROSE_PATTERNS) + " as score, case when "
        + any_path_sql("url", urls.MEDIA_PATHS) + " or ends_with(lower(url),'.pdf') or contains(content_type,'pdf') then 'media_or_pdf' when " + signal_sql("raw_text", PROSE_PATTERNS)
        + ">0 then 'signal' when " + any_path_sql("url", urls.BOILERPLATE_PATHS) + " then 'boilerplate_empty' else 'default' end as reason from page_texts_v) p",
        "page_texts_v",
    ),
)
def _prefilter(t: Tables):
    return W.prefilter(t("page_texts_v"), PROSE_PATTERNS).select("page_id", "score", "reason", "scan")


@case(
    "template_aliases",
    with_views("select scan_id, min(scan_id) over (partition by candidate_id, text_hash) as representative, scan_id > min(scan_id) over (partition by candidate_id, text_hash) as deduped from scans_v", "scans_v"),
)
def _aliases(t: Tables):
    return W.template_aliases(t("scans_v")).select("scan_id", "representative", "deduped")


def chunk_sql(limit: int) -> str:
    return (
        f"select doc_id as page_id, 0 as chunk_no, text as chunk from documents where length(text)<={limit} union all "
        f"select doc_id, cast(i as int), substr(text||chr(10)||chr(10), cast(i*{limit}+1 as bigint), {limit}) from documents, range(0, 100000) r(i) "
        f"where length(text)>{limit} and i*{limit}<length(text)+2 and trim(substr(text||chr(10)||chr(10), cast(i*{limit}+1 as bigint), {limit}), ' '||chr(10))<>''"
    )


def _documents(t: Tables):
    return t("documents").select(F.col("doc_id").alias("page_id"), "text")


@case("chunk_pages", chunk_sql(1000).replace("range(0, 100000)", "range(0, 400)"))
def _chunk(t: Tables):
    return W.chunk_pages(_documents(t), 1000)


CH = ("ch", chunk_sql(2000).replace("range(0, 100000)", "range(0, 200)"))
SC = ("sc", "select page_id, chunk_no, " + signal_sql("chunk", PROSE_PATTERNS) + " as n from ch")
SV = (
    "sv",
    "select *, case when n>=3 then 2 when n>=1 then 1 else 0 end as sev, case when n=0 then 0.9 else least(0.95, 0.5+n*0.1) end as conf, (n between 1 and 2) or (n>0 and least(0.95,0.5+n*0.1)<0.75) as esc from sc",
)


@case(
    "classify_pages",
    "with " + ", ".join(f"{n} as ({q})" for n, q in (CH, SC, SV)) + " select page_id, case max(sev) when 2 then 'red_box_guidance' when 1 then 'ambiguous' else 'no_guidance_detected' end as classification, "
    "cast(max(conf) filter (sev=m) as double) as confidence, cast(sum(n) filter (sev=m) as int) as quotes, bool_or(esc) as escalated from (select *, max(sev) over (partition by page_id) as m from sv) s group by page_id",
)
def _classify(t: Tables):
    scorer = W.lexical_scorer(PROSE_PATTERNS)
    verdicts, _ = W.classify_pages(_documents(t), scorer, scorer, chunk_chars=2000)
    return verdicts.select("page_id", "classification", "confidence", F.size("evidence").alias("quotes"), "escalated")


@case(
    "combine_chunks",
    with_views(
        "select page_id, case max(sev) when 2 then 'red_box_guidance' when 1 then 'ambiguous' else 'no_guidance_detected' end as classification, max(confidence) filter (sev=m) as confidence, "
        "bool_or(escalated) as escalated, arg_min('r'||cast(detection_id as varchar), detection_id) filter (sev=m) as rationale from (select *, max(sev) over (partition by page_id) as m from "
        "(select *, detection_id-detection_id%8 as page_id, case classification when 'red_box_guidance' then 2 when 'ambiguous' then 1 else 0 end as sev from detections_v) d) x group by 1",
        "detections_v",
    ),
)
def _combine(t: Tables):
    none = F.array().cast("array<struct<quote:string,why:string>>")
    v = F.struct(
        "classification", "confidence", none.alias("evidence"),
        F.concat(F.lit("r"), F.col("detection_id").cast("string")).alias("rationale"), F.lit(None).cast("string").alias("error"),
    )
    scored = t("detections_v").select(
        (F.col("detection_id") - F.col("detection_id") % 8).alias("page_id"), F.col("detection_id").alias("chunk_no"), v.alias("v"), F.lit("m").alias("model"), "escalated"
    )
    return W.combine_chunks(scored).select("page_id", "classification", "confidence", "escalated", "rationale")


@case(
    "extract_links",
    "select page_id, regexp_extract(url,'^(https?://[^/?#]*)',1)||h as href, case when ends_with(lower(h),'.pdf') then 'pdf' else 'page' end as kind from "
    "(select page_id, url, unnest(regexp_extract_all(html,'<a href=\"([^\"]*)\"',1)) as h from pages) p",
)
def _links(t: Tables):
    return W.extract_links(t("pages")).select("page_id", "href", "kind")


# No quoted '>' stands in a tag of these pages, so tags can be cut out by a pattern.
@case(
    "extract_text",
    "select page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, "
    "'<head>.*?</head>|<(script|style|noscript|template|svg|canvas|title)[ >].*?</(script|style|noscript|template|svg|canvas|title)>|<!--.*?-->', chr(1), 'gs'), "
    "'<[^>]*>', chr(1), 'gs'), chr(1)), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;?', '&', 'g'), ' '||chr(9)||chr(10)||chr(13))), lambda x: x <> ''), chr(10)) as text from pages",
)
def _text(t: Tables):
    return W.extract_text(t("pages"))


# one sitemap document per page; every fifth is an index over its neighbours
_DOC = "'https://maps.example/'||cast({0} as string)||'.xml'"
_BODY = (
    "case when page_id%5=0 then '<sitemapindex><loc>'||" + _DOC.format("page_id+1") + "||'</loc><LOC> '||" + _DOC.format("page_id+2") + "||' </LOC></sitemapindex>' "
    "when page_id%5=4 then '  ' else '<urlset><loc>'||url||'</loc><loc>'||url||'&x</loc><loc>http://all.example/</loc></urlset>' end"
)


def _sitemaps(t: Tables, max_children: int, max_locs: int):
    p = t("pages")
    site = F.substring_index(urls.host_key(F.col("url")), ".", -2)
    sites = p.select(site.alias("site"), F.col("page_id").alias("ord"), F.expr(_DOC.format("page_id")).alias("doc_url"))
    docs = p.select(F.expr(_DOC.format("page_id")).alias("doc_url"), F.expr(_BODY).alias("body"))
    blocked = p.filter("page_id % 15 = 1").select(F.expr(_DOC.format("page_id")).alias("doc_url"))
    return W.sitemap_urls(sites, docs, max_children, max_locs, blocked)


SITE_OF = "array_to_string(list_slice(string_split(" + HOST_SQL.format("url") + ",'.'),-2,-1),'.')"
UNITS = (
    "units",
    f"select site, ord, child, u.url, n from (select p.*, {SITE_OF} as site, page_id as ord, -1 as child, page_id as leaf from pages p where page_id%5 in (1,2,3) and page_id%15<>1 union all "
    f"select * exclude (rn) from (select q.*, row_number() over (partition by site order by page_id, child) as rn from (select p.*, {SITE_OF} as site, page_id as ord, c.k-1 as child, page_id+c.k as leaf from pages p, (values (1),(2)) c(k) "
    "where page_id%5=0 and (page_id+c.k)%15<>1) q) z where rn<=25) a join (select page_id as leaf, url, 3 as n from pages where page_id%5 in (1,2,3)) u using (leaf)",
)
LOCS = (
    "locs",
    "select site, ord, child, i, case i when 0 then url when 1 then url||'&x' else 'http://all.example/' end as url from (select *, coalesce(sum(n) over (partition by site order by ord, child rows between unbounded preceding and 1 preceding),0) as before from units) b, "
    "(values (0),(1),(2)) v(i) where before<60",
)


@case(
    "sitemap_urls",
    with_views(
        "select site, pos, url from (select site, url, row_number() over (partition by site order by ord, child, i) as pos from (select *, row_number() over (partition by site, url order by ord, child, i) as rn from locs) x where rn=1) y where pos<=60",
        extra=(UNITS, LOCS),
    ),
)
def _sitemap(t: Tables):
    return _sitemaps(t, 25, 60)


def _sites(t: Tables):
    return t("pages").select(F.concat(F.lit("https://www."), urls.host_key(F.col("url")), F.lit("/")).alias("site")).distinct()


@case(
    "seed_urls",
    "with s as (select distinct 'https://www.'||" + HOST_SQL.format("url") + " as root from pages) select root||'/' as site, root||p as url, case when p='' then 'seed' else 'common_path' end as via, pos "
    "from s, (values ('',0)," + ",".join(f"('{p}',{i})" for i, p in enumerate(urls.COMMON_PATHS, 1)) + ") v(p,pos)",
)
def _seeds(t: Tables):
    return W.seed_urls(_sites(t)).drop("page_key")


@case(
    "crawl_budget",
    "select page_id, budget_rank from (select page_id, row_number() over (partition by site, high order by page_id) as budget_rank from (select page_id, " + HOST_SQL.format("url") + " as site, ("
    + any_path_sql("url", urls.HIGH_VALUE_PATHS) + " or ends_with(lower(url),'.pdf')) as high from pages) p) q where budget_rank<=3",
)
def _budget(t: Tables):
    u = F.col("url")
    frontier = t("pages").select("page_id", urls.host_key(u).alias("site"), urls.is_high_value(u).alias("high"))
    return W.crawl_budget(frontier, 3, [F.col("page_id")]).select("page_id", "budget_rank")


def crawl_inputs(t: Tables):
    """Seeds and edges of a crawl over the given pages, joined by page key."""
    site = F.concat(F.lit("https://"), urls.host_key(F.col("url")))
    p = t("pages").withColumn("site", site)
    listed = p.select("site", (F.col("page_id") + 1).alias("pos"), "url")
    seeds = W.seed_urls(p.select("site").distinct(), listed, ("/media", "/press"))
    links = W.extract_links(p.select("page_id", "url", "html")).join(p.select("page_id", "site"), "page_id")
    edges = links.withColumn("page_key", urls.canon_url(F.col("url"))).select("site", "page_key", "pos", "href", "kind")
    return seeds, edges


def crawl_sql(max_pages: int, blocked: str = "false", throttled: str = "false") -> str:
    """One address after another, as a crawler would: a site's queue, visits, budgets and strikes are a row per step."""
    high = "(" + any_path_sql("url", urls.HIGH_VALUE_PATHS) + " or ends_with(lower(url),'.pdf'))"
    domain = "replace(regexp_extract({0},'^[a-z]+://([^/?#]*)',1),'www.','')"
    address = "{'url':url,'key':key,'host':" + HOST_SQL.format("url") + f",'high':{high},'depth':0,'via':via}}"
    spent = f"case when papers then n_pdf when x.high then n_high else n_low end < {max_pages}"
    fetched = "(head is not null)"
    steps = (
        ("sites", "select distinct 'https://'||" + HOST_SQL.format("url") + " as site from pages"),
        (
            "listed",
            "select site, 0 as pos, site as url, 'seed' as via from sites union all select site, i, site||p, 'common_path' from sites, (values (1,'/media'),(2,'/press')) v(i,p) "
            "union all select 'https://'||" + HOST_SQL.format("url") + ", page_id+3, url, 'sitemap' from pages",
        ),
        ("trimmed", "select site, pos, via, case when rtrim(u,'/')='' then u else rtrim(u,'/') end as url from (select *, split_part(url,'#',1) as u from listed) l"),
        ("seeds", f"select *, {CANON_SQL.format('url')} as key from trimmed where {domain.format('url')}={domain.format('site')} qualify row_number() over (partition by site, key order by pos)=1"),
        (
            "hrefs",
            "select site, page_key, pos, regexp_extract(url,'^(https?://[^/?#]*)',1)||h as url, 'link_crawl' as via from (select url, 'https://'||" + HOST_SQL.format("url") + f" as site, {CANON_SQL.format('url')} as page_key, "
            "unnest(regexp_extract_all(html,'<a href=\"([^\"]*)\"',1)) as h, generate_subscripts(regexp_extract_all(html,'<a href=\"([^\"]*)\"',1),1) as pos from pages) p",
        ),
        ("edges", f"select *, {CANON_SQL.format('url')} as key from hrefs"),
        (
            "outs",
            f"select site, page_key, list({address} order by not {high}, pos) filter (not ends_with(lower(url),'.pdf')) as links, "
            f"list({address}) filter (ends_with(lower(url),'.pdf')) as papers_of from edges group by 1,2",
        ),
        (
            "crawl",
            f"select site, 0 as step, list({address} order by not {high}, pos) as queue, cast([] as varchar[]) as visited, 0 as n_high, 0 as n_low, 0 as n_pdf, false as papers, false as ended, "
            f"list_filter(list({address}), lambda x: false) as found, cast(map() as map(varchar,int)) as strikes, list({address})[0] as got from seeds group by site "
            "union all select c.site, step+1, "
            f"case when {fetched} and not papers and head.depth<2 then list_concat(live[2:], list_transform(coalesce(links,[]), lambda x: struct_update(x, depth := head.depth+1))) when {fetched} then live[2:] "
            "when not papers then list_sort(list_transform(found, lambda x: struct_update(x, depth := -1, via := 'pdf_link', high := true))) else [] end, "
            f"case when {fetched} then list_append(visited, head.key) else visited end, "
            f"n_high+cast({fetched} and not papers and head.high as int), n_low+cast({fetched} and not papers and not head.high as int), n_pdf+cast({fetched} and papers as int), "
            f"papers or not {fetched}, papers and not {fetched}, "
            f"case when {fetched} and not papers and head.depth<2 then list_concat(found, coalesce(papers_of,[])) else found end, "
            f"case when {fetched} then map_concat(strikes, map([head.host],[cast(case when {throttled.format('head.key')} then coalesce(strikes[head.host],0)+1 else 0 end as int)])) else strikes end, head "
            "from (select *, live[1] as head from (select *, list_filter(queue, lambda x: not list_contains(visited, x.key) and coalesce(strikes[x.host],0)<3 "
            f"and not ({blocked.format('x.key')}) and {spent}) as live from crawl where not ended) l) c left join outs o on o.site=c.site and o.page_key=c.head.key",
        ),
    )
    return "with recursive " + ", ".join(f"{n} as ({q})" for n, q in steps) + " select site, cast(got.depth as int) as depth, got.url as url, got.via as via, got.high as high from crawl where got is not null"


@case("crawl_plan", crawl_sql(5))
def _crawl(t: Tables):
    seeds, edges = crawl_inputs(t)
    return W.crawl_plan(seeds, edges, max_pages=5).select("site", "depth", "url", "via", "high")


@case("crawl_plan_throttled", crawl_sql(6, "length({0})%11=0", "length({0})%3<>0"))
def _crawl_throttled(t: Tables):
    """Pages that answer 503 or are disallowed, by the length of their keys."""
    seeds, edges = crawl_inputs(t)
    known = seeds.select("site", "page_key").unionByName(edges.select("site", urls.canon_url(F.col("href")).alias("page_key"))).distinct()
    size = F.length("page_key")
    responses = known.withColumn("http_status", F.when(size % 3 != 0, 503).otherwise(200))
    plan = W.crawl_plan(seeds, edges, known.filter(size % 11 == 0), max_pages=6, responses=responses)
    return plan.select("site", "depth", "url", "via", "high")


@case(
    "robots_audit",
    "select page_id, case when h like 'blog.%' then 'override' else 'respect' end as posture, case when h like 'blog.%' then true when length(h)%4=0 then false when length(h)%4=1 then true "
    "when starts_with(p,'/en/') then false else true end as allowed, case when length(h)%4 in (2,3) then cast(5 as double) end as crawl_delay from "
    "(select page_id, regexp_extract(url,'//([^/?#]*)',1) as h, regexp_extract(url,'//[^/?#]*([^?#]*)',1) as p from pages) x",
)
def _robots(t: Tables):
    p = t("pages")
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    k = F.length("host") % 4
    docs = p.select(host.alias("host")).distinct().select(
        "host",
        F.when(k == 0, 503).when(k == 1, 404).otherwise(200).alias("http_status"),
        F.lit("# robots\nUser-agent: *\nAllow: /en/none\nDisallow: /en/\nCrawl-delay: 5\n\nUser-agent: other\nDisallow: /\n").alias("body"),
    )
    overrides = docs.filter("host like 'blog.%'").select("host", F.lit("override").alias("posture"))
    out = W.robots_audit(p.select("page_id", "url"), docs, overrides, "pagewatch/1.0")
    return out.select("page_id", "posture", "allowed", "crawl_delay")


STRIKES_SQL = with_views(
    "select seq, host, strikes, case when strikes between 1 and 2 then least(30.0*pow(2,strikes-1),300.0) end as backoff_seconds, strikes>=3 as abandoned from (select seq, host, "
    "case when hit then row_number() over (partition by host, isl order by seq)-case when isl=0 then 0 else 1 end else 0 end as strikes from (select *, sum((not hit)::int) over (partition by host order by seq) as isl from "
    "(select *, http_status in (429,503) as hit from fetch_log_v) f) g) h",
    "fetch_log_v",
)


@case("host_strikes", STRIKES_SQL)
def _strikes(t: Tables):
    return W.host_strikes(t("fetch_log_v")).select("seq", "host", "strikes", "backoff_seconds", "abandoned")


@case(
    "scan_outcome",
    with_views(
        "select candidate_id, count_if(usable) as pages_scanned, count_if(not usable) as pages_failed, count_if(d.classification='red_box_guidance') as positives, count_if(d.classification='ambiguous') as ambiguous, "
        "count_if(e.event_type='take_down') as take_downs, case when count_if(usable)>0 then 'scanned' else 'fetch_failed' end as scan_status from (select *, candidate_id as cid from sp) s left join (select scan_id, classification from detections_v) d using (scan_id) "
        "left join (select new_scan_id as scan_id, event_type from change_events_v) e using (scan_id) group by 1",
        "scans_v", "detections_v", "change_events_v", extra=(SP,),
    ),
)
def _outcome(t: Tables):
    pages = (
        t("scans_v")
        .select("scan_id", "candidate_id", usable_scan(F.col("http_status"), F.col("raw_text")).alias("usable"))
        .join(t("detections_v").select("scan_id", "classification"), "scan_id", "left")
        .join(t("change_events_v").select(F.col("new_scan_id").alias("scan_id"), "event_type"), "scan_id", "left")
        .withColumns({"recorded": F.lit(True), "prefiltered": F.lit(False), "deduped": F.lit(False)})
    )
    none = t("candidates_v").filter("c_custkey < 0")
    return W.scan_outcome(pages, none).select(
        "candidate_id", "pages_scanned", "pages_failed", "positives", "ambiguous", "take_downs", "scan_status"
    )


# ---------------------------------------------------------------- evaluation
@case(
    "scan_cost_preflight",
    with_views(
        "select ppc as pages_per_candidate, tok as tokens_per_page, esc as escalation_rate, ppc*1000 as pages, ppc*1000*tok/1e6 as first_pass_cost, ppc*1000*tok/1e6*esc*3 as escalation_cost from "
        "(select count(*)*1.0::double/count(distinct d.candidate_id) as ppc, cast(floor(floor(avg(length(raw_text)))/4) as bigint)+700 as tok, avg(escalated::int) as esc from detections_v d join scans_v s on s.scan_id=d.scan_id) x",
        "detections_v", "scans_v",
    ),
)
def _preflight(t: Tables):
    return E.scan_cost_preflight(t("detections_v"), t("scans_v"), 1000)


_EV = (
    "select 'm'||cast(detection_id%3 as string) as model, case detection_id%4 when 0 then 'fixture' when 1 then 'db_positive' else 'db_negative' end as source, "
    "case when detection_id%17=0 then 'ERROR' else classification end as classification, detection_id%17<>0 and detection_id%2=0 as ok, detection_id%900 as in_tok, detection_id%50 as out_tok, "
    "cast(detection_id%1000 as double)/100 as latency_s from detections_v"
)


@case(
    "model_eval",
    with_views(
        "select model, count_if(source='fixture' and ok) as fixture_ok, count_if(source='fixture') as fixture_n, count_if(source='db_positive' and ok) as positive_ok, "
        "count_if(source='db_positive' and classification='red_box_guidance') as positive_strict, count_if(source='db_positive') as positive_n, count_if(source='db_negative' and ok) as negative_ok, "
        "count_if(source='db_negative') as negative_n, count_if(classification='ERROR') as errors, cast(sum(in_tok) as bigint) as in_tok, cast(sum(out_tok) as bigint) as out_tok, "
        "list_sort(list(latency_s))[count(*)//2+1] as p50_latency from ev group by 1",
        "detections_v", extra=(("ev", _EV),),
    ),
)
def _model_eval(t: Tables):
    return E.model_eval(t.sql(_EV, "detections_v"))


@case(
    "stratified_sample",
    with_views(
        "select detection_id, stratum from (select *, row_number() over (partition by stratum order by draw, detection_id) as place from drawn) x where "
        "place <= case stratum when 'hard' then 20 else 60 - (select least(20, count(*)) from drawn where stratum='hard') end",
        "page_texts_v",
        extra=(("drawn", "select page_id as detection_id, sha256('42:'||cast(page_id as varchar)) as draw, case when " + any_path_sql("url", urls.MEDIA_PATHS) + " or " + signal_sql("raw_text") + ">0 then 'hard' else 'easy' end as stratum from page_texts_v"),),
    ),
)
def _sample(t: Tables):
    negatives = t("page_texts_v").withColumn("detection_id", F.col("page_id"))
    return E.stratified_sample(negatives, 20, 60).select("detection_id", "stratum")


@case(
    "eval_set",
    with_views(
        "select source, count(*) as n, count_if(ok) as n_ok from (select 'fixture' as source, case when quality=1 then 'red_box_guidance' else 'no_guidance_detected' end = case when doc_id%3=0 then 'red_box_guidance' else 'no_guidance_detected' end or "
        "(toxic=1 and doc_id%3<>0) as ok from labels union all select 'db_positive', true from detections_v where classification='red_box_guidance' union all select 'db_negative', true from detections_v where classification='no_guidance_detected') x group by 1",
        "detections_v",
    ),
)
def _eval_set(t: Tables):
    want = F.when(F.col("quality") == 1, F.array(F.lit("red_box_guidance"))).otherwise(F.array(F.lit("no_guidance_detected")))
    accept = F.when(F.col("toxic") == 1, F.array_union(want, F.array(F.lit("no_guidance_detected")))).otherwise(want)
    labelled = t("labels").join(t("documents").select("doc_id", "text"), "doc_id").select(
        F.concat(F.lit("fixture:"), F.col("doc_id").cast("string")).alias("id"), "text", accept.alias("accept"), "doc_id"
    )
    d, s = t("detections_v"), t("scans_v")
    negatives = d.filter("classification = 'no_guidance_detected'").join(s.select("scan_id", "url", "raw_text"), "scan_id")
    cases = E.eval_set(labelled, d, s, negatives)
    said = F.when(F.col("doc_id") % 3 == 0, "red_box_guidance").otherwise("no_guidance_detected")
    verdicts = labelled.select("id", F.lit("m").alias("model"), said.alias("classification")).unionByName(
        cases.filter("source <> 'fixture'").select("id", F.lit("m").alias("model"), F.col("accept")[0].alias("classification"))
    )
    scored = E.score_eval(cases, verdicts)
    return scored.groupBy("source").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


# ---------------------------------------------------------------- sources and merges
_LINE = (
    "concat_ws('|', candidate_id, name, case when incumbent then 'I' else '' end, 'x', party, case when c_custkey%6=0 then 'n/a' else cast(receipts as string) end, "
    "'6','7','8','9','10','11','12','13','14','15','16','17', lower(state), case when c_custkey%5=0 then ' ' else district end, '20')"
)


@case(
    "read_candidate_summary",
    with_views(
        "select candidate_id, name, case when substr(candidate_id,1,1) in ('H','S','P') then substr(candidate_id,1,1) else '' end as office, party, upper(state) as state, "
        "case when c_custkey%5=0 then '00' else district end as district, case when c_custkey%6=0 then 0.0 else cast(receipts as double) end as receipts, case when incumbent then 'I' else '' end as incumbent_challenge from people_v",
        "people_v",
    ),
)
def _summary(t: Tables):
    p = t("people_v")
    path = scratch(t, "summary")
    short = p.select(F.concat_ws("|", "candidate_id", "name").alias("value"))
    p.select(F.expr(_LINE).alias("value")).unionByName(short).write.text(path)
    return readers.read_candidate_summary(t.spark, path).withColumn("receipts", F.col("receipts").cast("double"))


@case(
    "read_calendar",
    "select n_name as state, '' as office, date '2026-03-03'+n_nationkey*7 as primary_date, date '2026-01-05' as filing_deadline, case when n_nationkey%5=2 then date '2026-06-16' end as runoff_date from nation "
    "union all select n_name, 'H', date '2026-08-11', date '2026-01-05', null from nation where n_nationkey%6=0 union all select n_name, 'H:0'||cast(d as varchar), date '2026-09-01', "
    "case when n_nationkey%2=0 then date '2026-02-02' else date '2026-01-05' end, date '2026-10-01' from nation, (values (1),(2)) v(d) where n_nationkey%5=0",
)
def _calendar(t: Tables):
    day = F.date_format(F.expr("date '2026-03-03' + n_nationkey*7"), "yyyy-MM-dd")
    whole = F.struct(
        F.lit("H").alias("office"), F.lit(None).cast("array<string>").alias("districts"), F.lit("2026-08-11").alias("primary_date"),
        F.lit(None).cast("string").alias("filing_deadline"), F.lit(None).cast("string").alias("runoff_date"),
    )
    pair = F.struct(
        F.lit("H").alias("office"), F.array(F.lit("01"), F.lit("02")).alias("districts"), F.lit("2026-09-01").alias("primary_date"),
        F.when(F.col("n_nationkey") % 2 == 0, "2026-02-02").alias("filing_deadline"), F.lit("2026-10-01").alias("runoff_date"),
    )
    moved = F.filter(
        F.array(F.when(F.col("n_nationkey") % 6 == 0, whole), F.when(F.col("n_nationkey") % 5 == 0, pair)), lambda o: o.isNotNull()
    )
    path = scratch(t, "calendar")
    t("nation").select(
        F.col("n_name").alias("state"), day.alias("primary_date"), F.lit("2026-01-05").alias("filing_deadline"),
        F.when(F.col("n_nationkey") % 5 == 2, "2026-06-16").alias("runoff_date"), F.lit("x").alias("source"), moved.alias("overrides"),
    ).write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_calendar(t.spark, path, 2026).drop("cycle", "source")


@case("read_ratings", with_views("select office, state, district, rating from ratings_v", "ratings_v"))
def _ratings(t: Tables):
    path = scratch(t, "ratings")
    t("ratings_v").drop("seq").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_ratings(t.spark, path).select("office", "state", "district", "rating")


@case("read_keyed_overrides", with_views("select key, candidate_id, name from overrides_v", "overrides_v"))
def _keyed(t: Tables):
    path = scratch(t, "overrides")
    entry = F.to_json(F.struct("candidate_id", "name"))
    doc = F.concat(F.lit('{"_comment":"by hand","'), "key", F.lit('":'), entry, F.lit("}"))
    t("overrides_v").select(doc.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_keyed_overrides(t.spark, path, "candidate_id string, name string")


@case(
    "read_results_feed_documents",
    with_views("select office, count(*) as n from (select case type when 'U.S. House' then 'H' when 'Senate' then 'S' end as office from races_v where called and election_type='Primary' and (election_date='' or substr(election_date,1,4)='2026')) r where office is not null group by 1", "races_v"),
)
def _feed_documents(t: Tables):
    path = scratch(t, "feed")
    race_documents(t).write.json(path)
    return readers.read_results_feed(t.spark, path, 2026).groupBy("office").agg(F.count("*").alias("n"))


@case("read_results_feed_document_rows", with_views(f"select {CALL_COLUMNS}, election_date from calls", "races_v", extra=(CALLS,)))
def _feed_document_rows(t: Tables):
    path = scratch(t, "feed")
    race_documents(t).write.json(path)
    return readers.read_results_feed(t.spark, path, 2026).select("office", "state", "district", "party", "winner_name", "election_date")


@case(
    "normalize_ie",
    with_views(
        "select candidate_id, case when seq%4=0 then 'flat '||committee_name else committee_name end as committee_name, case when seq%9=0 then 0.0 else cast(expenditure_amount as double) end as amount, expenditure_date, "
        "case when seq%5=0 then 'T'||transaction_id else transaction_id end as transaction_id from ie_filings_v",
        "ie_filings_v",
    ),
)
def _normalize(t: Tables):
    f = t("ie_filings_v")
    raw = f.select(
        "candidate_id", "committee_id",
        F.struct(F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("committee_name")).alias("name")).alias("committee"),
        F.concat(F.lit("flat "), "committee_name").alias("committee_name"),
        F.lit(None).cast("string").alias("payee_name"),
        "support_oppose_indicator",
        F.when(F.col("seq") % 9 != 0, F.col("expenditure_amount").cast("string")).alias("expenditure_amount"),
        F.concat(F.col("expenditure_date").cast("string"), F.lit("T00:00:00")).alias("expenditure_date"),
        F.lit(None).cast("string").alias("dissemination_date"),
        F.when(F.col("seq") % 5 != 0, F.col("transaction_id")).otherwise("").alias("sub_id"),
        F.concat(F.lit("T"), "transaction_id").alias("transaction_id"),
    )
    out = readers.normalize_ie(raw, 2026)
    return out.select(
        "candidate_id", "committee_name", F.col("expenditure_amount").cast("double").alias("amount"), "expenditure_date", "transaction_id"
    )


@case("guarded_snapshot_replace", with_views("select candidate_id, name from candidates_v where office='H'", "candidates_v"))
def _snapshot(t: Tables):
    target = scratch(t, "snapshots")
    c = t("candidates_v").select("candidate_id", "name", "c_custkey")
    tables.guarded_snapshot_replace(c, target, 1, stamp="20260601")
    tables.guarded_snapshot_replace(c.filter("office = 'H'"), target, 1, stamp="20260601")
    try:
        tables.guarded_snapshot_replace(c.limit(1), target, 2, stamp="20260602")
    except ValueError:
        pass
    return tables.read_latest_snapshot(t.spark, target).select("candidate_id", "name")


@case(
    "universe_csv_rows",
    with_views("select candidate_id, name, coalesce(website_url,'') as nominee_source, '' as rating, format('{:.0f}', cast(receipts as double)) as receipts from candidates_v", "candidates_v"),
)
def _csv(t: Tables):
    u = t("candidates_v").withColumns(
        {"universe_reason": F.lit("incumbent"), "nominee_source": F.col("website_url"), "rating": F.lit(None).cast("string")}
    )
    return universe_csv_rows(u).select("candidate_id", "name", "nominee_source", "rating", "receipts")


@case("write_universe_csv", with_views("select candidate_id, name, office, format('{:.0f}', cast(receipts as double)) as receipts from candidates_v", "candidates_v"))
def _write_csv(t: Tables):
    path = scratch(t, "csv")
    u = t("candidates_v").withColumns({c: F.lit(None).cast("string") for c in ("universe_reason", "nominee_source", "rating")})
    write_universe_csv(u, path)
    return t.spark.read.csv(path, header=True).select("candidate_id", "name", "office", "receipts")


@case(
    "merge_candidates",
    with_views(
        "select coalesce(o.candidate_id,n.candidate_id) as candidate_id, coalesce(n.name,o.name) as name, o.website_url, case when o.candidate_id is null then 'none' else 'search' end as url_source, "
        "n.candidate_id is not null as touched, o.inactive from (select * from candidates_v where office<>'S') o full join (select * from people_v where party<>'IND') n on n.candidate_id=o.candidate_id",
        "candidates_v", "people_v",
    ),
)
def _merge(t: Tables):
    extra = {c: F.lit(None).cast("string") for c in ("universe_reason", "rating", "nominee_source")}
    old = t("candidates_v").filter("office <> 'S'").withColumns(
        {**extra, "url_source": F.lit("search"), "updated_at": F.lit(None).cast("timestamp_ntz"), "created_at": F.lit(None).cast("timestamp_ntz")}
    )
    new = t("people_v").filter("party <> 'IND'").withColumns(extra)
    merged = tables.merge_candidates(old, new, now(), 2026)
    return merged.select("candidate_id", "name", "website_url", "url_source", F.col("updated_at").isNotNull().alias("touched"), "inactive")


@case(
    "merge_elections",
    with_views(
        "select state, office, case when office='' then date '2026-12-01' else primary_date end as primary_date from elections_v union all select state, 'S', date '2026-12-01' from elections_v where office=''",
        "elections_v",
    ),
)
def _merge_elections(t: Tables):
    e = t("elections_v")
    moved = e.filter("office = ''").withColumn("primary_date", F.lit("2026-12-01").cast("date"))
    new = moved.unionByName(moved.withColumn("office", F.lit("S")))
    return tables.merge_elections(e, new).select("state", "office", "primary_date")


@case(
    "replace_partition",
    with_views(
        "select candidate_id, transaction_id from ie_filings_v where candidate_id not in (select candidate_id from candidates_v where office='S') union all select candidate_id, 'new' from candidates_v where office='S'",
        "ie_filings_v", "candidates_v",
    ),
)
def _replace(t: Tables):
    f = t("ie_filings_v").select("candidate_id", "cycle", "transaction_id")
    new = t("candidates_v").filter("office = 'S'").select("candidate_id", "cycle", F.lit("new").alias("transaction_id"))
    return tables.replace_partition(f, new, ["candidate_id", "cycle"]).select("candidate_id", "transaction_id")


@case(
    "replace_partition_written",
    with_views(
        "select candidate_id, transaction_id from ie_filings_v where candidate_id not in (select candidate_id from candidates_v where office='S') union all select candidate_id, 'new' from candidates_v where office='S'",
        "ie_filings_v", "candidates_v",
    ),
)
def _replace_written(t: Tables):
    f = t("ie_filings_v").select("candidate_id", "cycle", "transaction_id")
    new = t("candidates_v").filter("office = 'S'").select("candidate_id", "cycle", F.lit("new").alias("transaction_id"))
    path, keys = scratch(t, "ie-table"), ["candidate_id", "cycle"]
    partitioned.write_partitioned(f, path, keys, ["cycle"], 16)
    partitioned.replace_groups(t.spark, path, new, keys, ["cycle"], 16)
    return partitioned.read_partitioned(t.spark, path).select("candidate_id", "transaction_id")


@case(
    "dedupe_ie",
    with_views(
        "select seq from (select seq, k, row_number() over (partition by k, committee_id order by seq) as rn from (select seq, committee_id, case when seq%10=0 then null else support_oppose_indicator||cast(expenditure_date as varchar) end as k from ie_filings_v) a) b "
        "where rn=1 or k is null",
        "ie_filings_v",
    ),
)
def _dedupe_ie(t: Tables):
    key = F.when(F.col("seq") % 10 != 0, F.concat("support_oppose_indicator", F.col("expenditure_date").cast("string")))
    return tables.dedupe_ie(t("ie_filings_v").withColumn("transaction_id", key)).select("seq")


@case("evolve_schema", with_views("select candidate_id, website_url, true as added from candidates_v", "candidates_v"))
def _evolve(t: Tables):
    old = t("candidates_v").select("candidate_id", "name", "website_url")
    out = evolve_schema(old, "candidates")
    return out.select("candidate_id", "website_url", F.col("last_scan_partial").isNull().alias("added"))


@case(
    "append_reviews",
    with_views(
        "select (select max(review_id) from reviews_v)+row_number() over (order by detection_id, asked) as review_id, detection_id, action from (select detection_id, detection_id as asked, 'reject' as action from pbod where confidence<0.1 "
        "union all select m.detection_id, p.detection_id, 'reject' from pbod p join pbod m on m.candidate_id=p.candidate_id and m.text_hash=p.text_hash and m.detection_id<>p.detection_id where p.confidence<0.1 and p.escalated) x",
        "detections_v", "scans_v", "reviews_v", extra=(PB,),
    ),
)
def _append(t: Tables):
    d = t("detections_v")
    decisions = d.filter("confidence < 0.1").select(
        "detection_id", F.lit("reject").alias("action"), F.lit("r").alias("reviewer"), F.lit(None).cast("string").alias("notes"),
        F.col("escalated").alias("group"),
    )
    bad = decisions.withColumn("action", F.lit("maybe"))
    out, _ = tables.append_reviews(t("reviews_v"), decisions.unionByName(bad), d, t("scans_v"), now())
    return out.select("review_id", "detection_id", "action")


@case(
    "append_reviews_refused",
    with_views(
        "select detection_id, action, reason from (select detection_id + (case when detection_id%5=3 then 100000000 else 0 end) as detection_id, "
        "case when detection_id%5=1 then 'maybe' when detection_id%5=2 then null else 'approve' end as action, case when detection_id%5 in (1,2) then 'unknown action' "
        "when detection_id%5=3 then 'unknown detection' when classification not in ('red_box_guidance','ambiguous') then 'not a positive detection' end as reason from detections_v) d where reason is not null",
        "detections_v",
    ),
)
def _append_refused(t: Tables):
    k, d = F.col("detection_id") % 5, t("detections_v")
    decisions = d.select(
        (F.col("detection_id") + F.when(k == 3, 100_000_000).otherwise(0)).alias("detection_id"),
        F.when(k == 1, "maybe").when(k != 2, "approve").alias("action"), F.lit("r").alias("reviewer"),
        F.lit(None).cast("string").alias("notes"), F.lit(False).alias("group"),
    )
    _, refused = tables.append_reviews(t("reviews_v"), decisions, d, t("scans_v"), now())
    return refused.select("detection_id", "action", "reason")


@case(
    "apply_triage",
    with_views(
        "select candidate_id, case when c_custkey%4=1 then 'https://found.example' else website_url end as website_url, case when c_custkey%4=1 then 'manual' when c_custkey%4=2 then 'human_none' else 'none' end as url_source, "
        "case when c_custkey%4=3 then 2 else inactive end as inactive from candidates_v",
        "candidates_v",
    ),
)
def _triage(t: Tables):
    c = t("candidates_v").withColumns(
        {"url_source": F.lit("none"), "scan_status": F.lit("scanned"), "updated_at": F.lit(None).cast("timestamp_ntz")}
    )
    k = F.col("c_custkey") % 4
    last = F.when(k == 1, "found").when(k == 2, "human_none").otherwise("wrong_race")
    calls = c.filter(k != 0).select(
        "candidate_id",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("seq"), F.lit("wrong_race").alias("outcome"), F.lit(None).cast("string").alias("url")),
                F.struct(F.lit(2).alias("seq"), last.alias("outcome"), F.lit("https://found.example").alias("url")),
            )
        ),
    )
    odd = c.filter(k == 0).select("candidate_id", F.lit(9).alias("seq"), F.lit("maybe").alias("outcome"), F.lit("x").alias("url"))
    updated, _ = tables.apply_triage(c, calls.unionByName(odd), now())
    return updated.select("candidate_id", "website_url", "url_source", "inactive")


@case(
    "apply_triage_refused",
    with_views(
        "select candidate_id||(case when c_custkey%4=2 then '?' else '' end) as candidate_id, outcome, reason from (select *, case when c_custkey%4=1 then 'maybe' when c_custkey%4=3 then null else 'found' end as outcome, "
        "case when c_custkey%4 in (1,3) then 'unknown outcome' when c_custkey%4=2 then 'unknown candidate' end as reason from candidates_v) c where reason is not null",
        "candidates_v",
    ),
)
def _triage_refused(t: Tables):
    c, k = t("candidates_v"), F.col("c_custkey") % 4
    c = c.withColumns({"url_source": F.lit("none"), "scan_status": F.lit("scanned"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    calls = c.select(
        F.concat("candidate_id", F.when(k == 2, "?").otherwise("")).alias("candidate_id"), F.lit(1).alias("seq"),
        F.when(k == 1, "maybe").when(k != 3, "found").alias("outcome"), F.lit("u").alias("url"),
    )
    _, refused = tables.apply_triage(c, calls, now())
    return refused.select("candidate_id", "outcome", "reason")


# ---------------------------------------------------------------- streaming
def stream_view(t: Tables, view: str, table: str):
    """A domain view over the stream of one table."""
    events = table_stream(t.spark, t.folder, f"{table}.parquet")
    events.createOrReplaceTempView(table)
    return t.spark.sql(VIEWS[view][0])


_OWN = (
    "case when event_type='purchase' then 'red_box_guidance' when event_type='click' and scan_id%2=0 then 'ambiguous' "
    "when event_type in ('click','view') then 'no_guidance_detected' end"
)


@case("stream_changes", with_views("select * , false as late from ev", "scans_v", "detections_v", extra=REPLAY))
def _stream_changes(t: Tables):
    scans = stream_view(t, "scans_v", "events").withColumn("own_class", F.expr(_OWN))
    out = run_available(stateful.stream_changes(scans))
    return out.withColumn("detected_at", F.col("detected_at").cast("timestamp_ntz"))


@case("stream_new_bodies", "select scan_id from (" + UNCHANGED_SQL + ") u where not unchanged")
def _stream_bodies(t: Tables):
    return run_available(stateful.stream_new_bodies(stream_view(t, "scans_v", "events"))).filter("not late").select("scan_id")


@case("stream_host_strikes", STRIKES_SQL)
def _stream_strikes(t: Tables):
    log = stream_view(t, "fetch_log_v", "events").select("seq", "host", F.col("http_status").cast("int").alias("http_status"))
    return run_available(stateful.stream_host_strikes(log)).select("seq", "host", "strikes", "backoff_seconds", "abandoned")


@case(
    "stream_feed_delta",
    with_views(
        "select id, position, case when absorb then 'absorb' when row_number() over (partition by absorb order by position desc)<=5 then 'post' else 'wait' end as action from "
        "(select *, split_part(id,'#',1) in (select split_part(id,'#',1) from posted) as absorb from items where id not in (select id from posted)) x",
        "candidates_v", extra=(("items", _ITEMS), ("posted", _POSTED)),
    ),
)
def _stream_feed(t: Tables):
    root = scratch(t, "feed-delta")
    t.sql(_POSTED, "candidates_v").write.parquet(f"{root}/posted/batch=-1")
    t.sql(_ITEMS, "candidates_v").coalesce(1).write.parquet(f"{root}/items")
    items = table_stream(t.spark, f"{root}/items", "*.parquet")
    stream_feed_delta(items, f"{root}/posted", f"{root}/actions", f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/actions").select("id", "position", "action")

