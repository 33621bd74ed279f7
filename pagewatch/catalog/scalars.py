"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.catalog.core import Tables, case, with_views
from pagewatch.functions import dates, politics, status, text, urls

PARTY_SQL = (
    "case when upper(trim({0})) in ('DFL','DNL','D') or upper(trim({0})) like 'DEM%' then 'DEM' "
    "when upper(trim({0})) like 'REP%' or upper(trim({0})) like 'GOP%' or upper(trim({0}))='R' then 'REP' "
    "else substr(upper(trim({0})),1,3) end"
)
DISTRICT_SQL = (
    "case when {0} in ('S','P') or upper(split_part({1},'-',-1)) in ('AL','ATLARGE') "
    "or ltrim(split_part({1},'-',-1),'0')='' then '0' else ltrim(upper(split_part({1},'-',-1)),'0') end"
)
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?"
SHAPE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_PATH = f"rtrim(regexp_replace(regexp_extract({{0}},'{SHAPE}',2),';[^/]*$',''),'/')"
CANON_SQL = (
    f"regexp_replace(lower(regexp_extract({{0}},'{SHAPE}',1)),'^www\\.','')"
    f"||case when {_PATH}='' then '/' else {_PATH} end"
    f"||case when regexp_extract({{0}},'{SHAPE}',3)='' then '' else '?'||regexp_extract({{0}},'{SHAPE}',3) end"
)
HOST_SQL = f"regexp_replace(lower(regexp_extract({{0}},'{HOST}',1)),'^www\\.','')"
CHALLENGE_SQL = (
    "(length({0})<400 and regexp_matches(lower({0}),'" + "|".join(status.CHALLENGE_MARKERS) + "'))"
)
USABLE_SQL = f"({{1}}=200 and trim({{0}})<>'' and not {CHALLENGE_SQL})"
POSITIVE_SQL = "({0} in ('red_box_guidance','ambiguous'))"


def any_path_sql(column: str, paths: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({column}),'{p}')" for p in paths) + ")"


def signal_sql(column: str, patterns=text.SIGNAL_PATTERNS) -> str:
    return "(" + "+".join(f"cast(regexp_matches({column},'(?i){p}') as int)" for p in patterns) + ")"


# Words that do occur in the invented prose, to exercise the score off zero.
PROSE_PATTERNS = (r" the ", r" der ", r" que ", r" les? ", r"tion[ .]", r" (?:and|und) ", r" in (?:the|die) ")


@case(
    "norm_party",
    f"select c_custkey, {PARTY_SQL.format('raw')} as party_norm from (select c_custkey, "
    "case c_custkey%4 when 0 then ' '||lower(c_mktsegment) when 1 then 'republican' when 2 then 'd' else 'dnl ' end as raw "
    "from customer) t",
)
def _norm_party(t: Tables):
    raw = t.sql(
        "select c_custkey, case c_custkey%4 when 0 then ' '||lower(c_mktsegment) when 1 then 'republican' "
        "when 2 then 'd' else 'dnl ' end as raw from customer",
        "customer",
    )
    return raw.select("c_custkey", politics.norm_party(F.col("raw")).alias("party_norm"))


@case(
    "norm_district",
    with_views(
        "select seq, " + DISTRICT_SQL.format("office", "district") + " as district_norm from (select seq, "
        "case type when 'U.S. House' then 'H' when 'Senate' then 'S' else 'X' end as office, "
        "case when seq%6=0 then 'at-AL' when seq%6=1 then '' else district end as district from races_v) r",
        "races_v",
    ),
)
def _norm_district(t: Tables):
    office = F.when(F.col("type") == "U.S. House", "H").when(F.col("type") == "Senate", "S").otherwise("X")
    district = F.when(F.col("seq") % 6 == 0, "at-AL").when(F.col("seq") % 6 == 1, "").otherwise(F.col("district"))
    return t("races_v").select("seq", politics.norm_district(office, district).alias("district_norm"))


@case(
    "as_date",
    "select event_id, try_cast(case when regexp_matches(substr(s,1,10),'^\\d{4}-\\d{2}-\\d{2}$') then substr(s,1,10) end as date) as d "
    "from (select event_id, case when event_id%4=0 then 'bad'||cast(ts as varchar) when event_id%4=1 then '2026-02-30' "
    "else cast(ts as varchar) end as s from events) t",
)
def _as_date(t: Tables):
    s = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("bad"), F.col("ts").cast("string")))
        .when(F.col("event_id") % 4 == 1, "2026-02-30")
        .otherwise(F.col("ts").cast("string"))
    )
    return t("events").select("event_id", dates.as_date(s).alias("d"))


@case("text_hash", "select doc_id, sha256(text) as text_hash from documents")
def _text_hash(t: Tables):
    return t("documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


@case(
    "office_of_and_pad_district",
    with_views(
        "select candidate_id, case when upper(substr(id,1,1)) in ('H','S','P') then upper(substr(id,1,1)) else '' end as office, "
        "case when length(d)<2 then lpad(d,2,'0') else d end as district from (select candidate_id, "
        "lower(office)||substr(candidate_id,2) as id, cast(c_custkey%150 as varchar) as d from candidates_v) t",
        "candidates_v",
    ),
)
def _office_of(t: Tables):
    c = t("candidates_v").withColumn("id", F.concat(F.lower("office"), F.expr("substr(candidate_id, 2)")))
    return c.select(
        "candidate_id",
        politics.office_of(F.col("id")).alias("office"),
        politics.pad_district((F.col("c_custkey") % 150).cast("string")).alias("district"),
    )


@case(
    "person_surname",
    with_views(
        "select candidate_id, list_filter(list_transform(string_split(upper(split_part(name,',',1)),' '), lambda x: trim(x,'.')), "
        "lambda x: x not in ('JR','SR','II','III','IV','V'))[1] as surname from filings_v",
        "filings_v",
    ),
)
def _person_surname(t: Tables):
    return t("filings_v").select("candidate_id", politics.person_surname(F.col("name")).alias("surname"))


@case(
    "id_matches_geo",
    with_views(
        "select cid, office<>'P' and length(cid)>=6 and substr(cid,3,2)=upper(st) and substr(cid,5,2)=lpad(d,2,'0') as matches "
        "from (select office||cast(c_custkey%10 as varchar)||'N'||cast(c_custkey%7 as varchar)||district||candidate_id as cid, "
        "office, 'n'||cast(c_custkey%5 as varchar) as st, ltrim(district,'0') as d from candidates_v) t",
        "candidates_v",
    ),
)
def _id_matches_geo(t: Tables):
    key = F.col("c_custkey")
    c = t("candidates_v").select(
        F.concat("office", (key % 10).cast("string"), F.lit("N"), (key % 7).cast("string"), "district", "candidate_id").alias("cid"),
        "office",
        F.concat(F.lit("n"), (key % 5).cast("string")).alias("st"),
        F.ltrim("district", F.lit("0")).alias("d"),
    )
    return c.select("cid", politics.id_matches_geo(*[F.col(x) for x in ("cid", "office", "st", "d")]).alias("matches"))


_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}),'[\\p{{L}}]+|[^\\p{{L}}]+'), lambda x: upper(x[1])||substr(x,2)),'')"
_GIVEN = (
    "list_filter(string_split(trim(split_part(name,',',2)),' '), lambda x: upper(trim(x,'.')) not in "
    "('DR','JR','SR','II','III','IV','MR','MRS','MS','ESQ','COL','HON','REV') and x<>'')"
)
FILED_SQL = (
    f"select candidate_id, {_TITLE.format('coalesce(' + _GIVEN + '[1],' + chr(39) * 2 + ')')} as filed_first, "
    f"{_TITLE.format('trim(split_part(name,chr(44),1))')} as filed_last from people_v"
)


@case("fec_name_parts", with_views(FILED_SQL, "people_v"))
def _fec_name_parts(t: Tables):
    p = t("people_v").withColumn("n", politics.fec_name_parts(F.col("name")))
    return p.select("candidate_id", F.col("n.first").alias("filed_first"), F.col("n.last").alias("filed_last"))


FEED_NAME_SQL = (
    "select candidate_id, " + _TITLE.format("split_part(feed_given,' ',1)") + " as feed_first, " + _TITLE.format("feed_last") + " as feed_last from people_v"
)


@case("feed_name_parts", with_views(FEED_NAME_SQL, "people_v"))
def _feed_name_parts(t: Tables):
    comma = F.concat("feed_last", F.lit(", "), "feed_given")
    plain = F.concat("feed_given", F.lit(" "), "feed_last", F.lit(" Jr."))
    shown = F.when(F.col("c_custkey") % 2 == 0, comma).otherwise(plain)
    p = t("people_v").withColumn("n", politics.feed_name_parts(shown))
    return p.select("candidate_id", F.col("n.first").alias("feed_first"), F.col("n.last").alias("feed_last"))


_NAMES = (
    ("filed", FILED_SQL),
    ("called", FEED_NAME_SQL),
    (
        "pair",
        "select candidate_id, lower(filed_first) as a, lower(feed_first) as b, lower(filed_last)=lower(feed_last) as same_last "
        "from filed join called using (candidate_id)",
    ),
)


@case(
    "names_match",
    with_views(
        "select candidate_id, same_last and (a='' or b='' or starts_with(a,b) or starts_with(b,a) or a[1]=b[1]) as matches from pair",
        "people_v",
        extra=_NAMES,
    ),
)
def _names_match(t: Tables):
    shown = F.concat("feed_given", F.lit(" "), "feed_last")
    return t("people_v").select("candidate_id", politics.names_match(F.col("name"), shown).alias("matches"))


@case(
    "first_name_rank",
    with_views(
        "select candidate_id, case when a='' or b='' then 1 when a=b then 3 when starts_with(a,b) or starts_with(b,a) then 2 "
        "else 0 end as name_rank from pair",
        "people_v",
        extra=_NAMES,
    ),
)
def _first_name_rank(t: Tables):
    called = politics.feed_name_parts(F.concat("feed_given", F.lit(" "), "feed_last"))["first"]
    return t("people_v").select("candidate_id", politics.first_name_rank(F.col("name"), called).alias("name_rank"))


RATING_SQL = (
    "case when lower({0}) like '%toss%' then 'Toss-up' when lower({0}) like '%tilt%' then 'Tilt' when lower({0}) like '%lean%' "
    "then 'Lean' when lower({0}) like '%likely%' then 'Likely' when lower({0}) like '%solid%' or lower({0}) like '%safe%' "
    "then 'Solid' else " + _TITLE.format("trim({0})").replace("{{", "{").replace("}}", "}").replace("\\p{L}", "\\p{{L}}") + " end"
)


@case("norm_rating", with_views("select seq, " + RATING_SQL.format("rating") + " as rating from ratings_v", "ratings_v"))
def _norm_rating(t: Tables):
    return t("ratings_v").select("seq", politics.norm_rating(F.col("rating")).alias("rating"))


@case("canon_url", "select page_id, " + CANON_SQL.format("url") + " as page_key from pages")
def _canon_url(t: Tables):
    return t("pages").select("page_id", urls.canon_url(F.col("url")).alias("page_key"))


@case(
    "url_variants",
    with_views(
        "select scan_id, s||'://'||w||host||path||sl as form from (select scan_id, "
        "regexp_replace(regexp_extract(url,'" + SHAPE + "',1),'^www\\.','') as host, "
        "rtrim(regexp_extract(url,'" + SHAPE + "',2),'/') as path from scans_v) u "
        "cross join (values ('https'),('http')) a(s) cross join (values ('www.'),('')) b(w) cross join (values ('/'),('')) c(sl)",
        "scans_v",
    ),
)
def _url_variants(t: Tables):
    return t("scans_v").select("scan_id", F.explode(urls.url_variants(F.col("url"))).alias("form"))


@case(
    "host_key",
    "select page_id, " + HOST_SQL.format("url") + " as host, replace(regexp_extract(url,'" + HOST + "',1),'www.','') "
    "= replace(regexp_extract(other,'" + HOST + "',1),'www.','') as same_site from (select page_id, url, "
    "case when page_id%2=0 then replace(url,'://','://www.') else replace(url,'example','Example') end as other from pages) p",
)
def _host_key(t: Tables):
    other = F.when(F.col("page_id") % 2 == 0, F.expr("replace(url,'://','://www.')")).otherwise(
        F.expr("replace(url,'example','Example')")
    )
    return t("pages").select(
        "page_id", urls.host_key(F.col("url")).alias("host"), urls.same_domain(F.col("url"), other).alias("same_site")
    )


SITE_HOST_SQL = "regexp_replace(lower(split_part(regexp_replace({0},'^.*?//',''),'/',1)),'^www\\.','')"
BLOCKED_SQL = (
    "(ends_with({0},'.gov') or " + " or ".join(f"{{0}}='{b}' or ends_with({{0}},'.{b}')" for b in urls.BLOCKED_HOSTS) + ")"
)
_MIXED = (
    "case page_id%6 when 0 then 'https://www.facebook.com/p/'||url when 1 then 'http://x.senate.gov/' "
    "when 2 then 'notx.com/a' when 3 then 'https://m.youtube.com' else url end"
)


@case(
    "is_blocked_host",
    f"select page_id, {BLOCKED_SQL.format('h')} as blocked from (select page_id, {SITE_HOST_SQL.format(_MIXED)} as h from pages) p",
)
def _is_blocked_host(t: Tables):
    return t("pages").select("page_id", urls.is_blocked_host(F.expr(_MIXED)).alias("blocked"))


_FREE = "case page_id%3 when 0 then 'My answer: ('||url||').' when 1 then 'NONE' else 'see https://www.facebook.com/x, or '||url end"


@case(
    "pick_campaign_url",
    "select page_id, case when u<>'' and not " + BLOCKED_SQL.format(SITE_HOST_SQL.format("u")) + " then u end as picked from "
    "(select page_id, rtrim(regexp_extract(" + _FREE + ",'https?://[^\\s)>\\]\"''`]+'),'.,);''\"`') as u from pages) p",
)
def _pick(t: Tables):
    return t("pages").select("page_id", urls.pick_campaign_url(F.expr(_FREE)).alias("picked"))


_WIKI = (
    "case page_id%5 when 0 then '{{Infobox | name = x\n| website = {{url|'||url||'}} \n| x=1' "
    "when 1 then '| Website = [https://a.house.gov Office] ['||url||' Campaign site]\n' "
    "when 2 then '|website= {{URL|b.senate.gov}}' when 3 then '| website = {{URL|c'||cast(page_id as string)||'.com|label}} ["
    "'||url||' campaign]' else 'no box '||url end"
)


@case(
    "website_from_wikitext",
    "select page_id, case page_id%5 when 0 then url when 1 then url when 2 then null when 3 then url end as site from pages",
)
def _wikitext(t: Tables):
    return t("pages").select("page_id", urls.website_from_wikitext(F.expr(_WIKI)).alias("site"))


_PASTED = "case page_id%5 when 0 then ' '||replace(url,'http','HTTP') when 1 then replace(replace(url,'https://',''),'http://','') when 2 then 'ftp://a.b' when 3 then '  ' else 'localhost' end"


@case(
    "normalize_url",
    "select page_id, case when r='' then null when regexp_matches(f,'^[hH][tT][tT][pP][sS]?:') and contains(regexp_extract(f,'"
    + HOST + "',1),'.') then f end as url from (select page_id, r, case when contains(r,'://') then r else 'https://'||r end as f "
    "from (select page_id, trim(" + _PASTED + ") as r from pages) a) b",
)
def _normalize_url(t: Tables):
    return t("pages").select("page_id", urls.normalize_url(F.expr(_PASTED)).alias("url"))


@case(
    "is_challenge",
    "select conv_id, turn, " + CHALLENGE_SQL.format("t") + " as challenge from (select conv_id, turn, "
    "case when turn%2=0 then 'Please solve the CAPTCHA '||text else text end as t from conversations) c",
)
def _is_challenge(t: Tables):
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Please solve the CAPTCHA "), "text")).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", status.is_challenge(body).alias("challenge"))


@case(
    "usable_scan",
    with_views("select scan_id, " + USABLE_SQL.format("raw_text", "http_status") + " as usable from scans_v", "scans_v"),
)
def _usable_scan(t: Tables):
    return t("scans_v").select("scan_id", status.usable_scan(F.col("http_status"), F.col("raw_text")).alias("usable"))


@case(
    "change_type",
    with_views(
        "select change_id, case when p and not n then 'take_down' when n and not p then 'put_up' when p and n then 'modified' end as kind "
        "from (select change_id, " + POSITIVE_SQL.format("prev_classification") + " as p, " + POSITIVE_SQL.format("new_classification")
        + " as n from change_events_v) e",
        "change_events_v",
    ),
)
def _change_type(t: Tables):
    kind = status.change_type(F.col("prev_classification"), F.col("new_classification"))
    return t("change_events_v").select("change_id", kind.alias("kind"))


@case("signal_score", "select doc_id, " + signal_sql("text") + " as score, " + signal_sql("text", PROSE_PATTERNS) + " as prose_score from documents")
def _signal_score(t: Tables):
    return t("documents").select(
        "doc_id",
        text.signal_score(F.col("text")).alias("score"),
        text.signal_score(F.col("text"), PROSE_PATTERNS).alias("prose_score"),
    )


@case(
    "url_classes",
    with_views(
        "select page_id, " + any_path_sql("url", urls.MEDIA_PATHS) + " as media, " + any_path_sql("url", urls.BOILERPLATE_PATHS)
        + " as boilerplate, (ends_with(lower(url),'.pdf') or contains(lower(content_type),'pdf')) as pdf, ("
        + any_path_sql("url", urls.HIGH_VALUE_PATHS) + " or ends_with(lower(url),'.pdf')) as high from page_texts_v",
        "page_texts_v",
    ),
)
def _url_classes(t: Tables):
    u = F.col("url")
    return t("page_texts_v").select(
        "page_id", urls.is_media(u).alias("media"), urls.is_boilerplate(u).alias("boilerplate"),
        urls.is_pdf(u, F.col("content_type")).alias("pdf"), urls.is_high_value(u).alias("high"),
    )


@case(
    "classifier_text",
    "select doc_id, text||chr(10)||chr(10)||'[hidden/DOM-only content]'||chr(10)||'  only here '||cast(doc_id as varchar) as t "
    "from (select doc_id, trim(text, ' '||chr(9)||chr(10)||chr(13)) as text from documents) d",
)
def _classifier_text(t: Tables):
    dom = F.concat("text", F.lit("\n  only here "), F.col("doc_id").cast("string"), F.lit(" "))
    return t("documents").select("doc_id", text.classifier_text(F.col("text"), dom).alias("t"))


_SPANS = "array(named_struct('quote', substr(text,1,40)||'…', 'why', 'a'), named_struct('quote', '', 'why', 'b'), named_struct('quote', upper(substr(text,1,40)), 'why', 'c'))"


@case(
    "quote_set",
    "select doc_id, rtrim(lower(trim(regexp_replace(substr(text,1,40)||'…','\\s+',' ','g'))),'.…') as spans from documents",
)
def _quote_set(t: Tables):
    d = t("documents").withColumn("ev", F.expr(_SPANS))
    keys = text.quote_set(F.col("ev"))
    return d.select("doc_id", F.element_at(keys, 1).alias("spans"))


@case(
    "guidance_unchanged",
    "select doc_id, case doc_id%4 when 0 then true when 1 then contains(n, q2) and contains(o, q1) when 2 then contains(o, q1) end as same "
    "from (select doc_id, squeeze(text) as n, squeeze(substr(text,1,200)) as o, squeeze(substr(text,1,20)) as q1, squeeze(substr(text,11,20)) as q2 from documents) d"
    .replace("squeeze(text)", "lower(trim(regexp_replace(text,'\\s+',' ','g')))")
    .replace("squeeze(substr(text,1,200))", "lower(trim(regexp_replace(substr(text,1,200),'\\s+',' ','g')))")
    .replace("squeeze(substr(text,1,20))", "rtrim(lower(trim(regexp_replace(substr(text,1,20),'\\s+',' ','g'))),'.…')")
    .replace("squeeze(substr(text,11,20))", "rtrim(lower(trim(regexp_replace(substr(text,11,20),'\\s+',' ','g'))),'.…')"),
)
def _guidance_unchanged(t: Tables):
    quote = lambda a: F.array(F.struct(F.substring("text", a, 20).alias("quote"), F.lit("w").alias("why")))
    none = F.array().cast("array<struct<quote:string,why:string>>")
    k = F.col("doc_id") % 4
    # 0: same quotes; 1: different quotes; 2: only new quotes; 3: nothing new
    prev_ev = F.when(k == 0, quote(1)).when(k == 1, quote(11)).when(k == 3, quote(1)).otherwise(none)
    new_ev = F.when(k == 3, none).otherwise(quote(1))
    same = text.guidance_unchanged(prev_ev, new_ev, F.substring("text", 1, 200), F.col("text"))
    return t("documents").select("doc_id", same.alias("same"))


@case(
    "quote_diff",
    "select doc_id, trim(substr(text,1,10),' '||chr(10)||chr(13))||'…' as dropped, 'new '||cast(doc_id as varchar) as added from documents",
)
def _quote_diff(t: Tables):
    ev = lambda *q: F.array(*[F.struct(x.alias("quote"), F.lit("w").alias("why")) for x in q])
    shared = F.lit("Shared  quote.")
    head = text.strip(F.substring("text", 1, 10))
    old = ev(head, F.concat(head, F.lit("…")), shared)
    new = ev(F.lit("shared quote"), F.concat(F.lit("new "), F.col("doc_id").cast("string")))
    d = t("documents").withColumn("diff", text.quote_diff(old, new))
    return d.select(
        "doc_id", F.array_join("diff.dropped", "|").alias("dropped"), F.array_join("diff.added", "|").alias("added")
    )


@case(
    "change_key",
    with_views(
        "select change_id, case when event_type<>'modified' then event_type when change_id%3=0 then 'changed' "
        "when change_id%3=1 then 'updated' else 'revised' end as kind from change_events_v",
        "change_events_v",
    ),
)
def _change_key(t: Tables):
    k = F.col("change_id") % 3
    same = F.when(k == 1, True).when(k == 2, False)
    return t("change_events_v").select("change_id", status.change_key(F.col("event_type"), same).alias("kind"))


@case(
    "general_election_date",
    "select y, (make_date(y,11,1) + cast((8-isodow(make_date(y,11,1)))%7 as integer)) + 1 as election_day from "
    "(select distinct cast(year(o_orderdate) as integer)+o_orderkey%60 as y from orders) t",
)
def _general_election_date(t: Tables):
    y = t("orders").select((F.year("o_orderdate") + F.col("o_orderkey") % 60).cast("int").alias("y")).distinct()
    return y.select("y", dates.general_election_date(F.col("y")).alias("election_day"))


@case("estimate_tokens", "select doc_id, cast(floor(length(text)/4) as bigint)+700 as tokens from documents")
def _estimate_tokens(t: Tables):
    return t("documents").select("doc_id", text.estimate_tokens(F.length("text")).alias("tokens"))


_BITS = tuple((r, i) for i, r in enumerate(politics.REASON_ORDER))


@case(
    "reason_label",
    "select c_custkey, case when label='contested_primary+competitive_general' then 'both' else label end as label from "
    "(select c_custkey, concat_ws('+',"
    + ",".join(f"case when (c_custkey>>{i})%2=1 then '{r}' end" for r, i in _BITS)
    + ") as label from customer) t",
)
def _reason_label(t: Tables):
    on = [F.when(F.shiftright("c_custkey", i) % 2 == 1, F.lit(r)) for r, i in reversed(_BITS)]
    reasons = F.filter(F.array(*on), lambda r: r.isNotNull())
    return t("customer").select("c_custkey", politics.reason_label(reasons).alias("label"))


_COMPACT_SQL = (
    "case when x>=1e9 then '$'||format('{:.1f}',x/1e9)||'B' when x>=1e6 then '$'||format('{:.1f}',x/1e6)||'M' "
    "when x>=1e3 then '$'||format('{:.0f}',x/1e3)||'K' else '$'||format('{:,.0f}',x) end"
)
_ORD = "case when d%100 between 10 and 20 then 'th' when d%10=1 then 'st' when d%10=2 then 'nd' when d%10=3 then 'rd' else 'th' end"


@case(
    "seat_labels",
    with_views(
        "select candidate_id, office||'-'||state||case when district='' then '' else '-'||district end as code, "
        "case when office='P' then 'President' when office='S' then state||' Senate' when district='' then state "
        "else state||'-'||district end as compact, case when office='P' then 'President' when office='S' then 'U.S. Senate, '||state "
        "when d=0 then state||' at-large' else state||'''s '||cast(d as varchar)||" + _ORD + "||' District' end as phrase, "
        + _COMPACT_SQL + " as money from (select candidate_id, office, state, case when c_custkey%8=5 then '' else district end as district, "
        "case when c_custkey%8=5 then 0 else cast(district as int) end as d, cast(receipts as double)*(1+c_custkey%97*c_custkey) as x from candidates_v) c",
        "candidates_v",
    ),
)
def _seat_labels(t: Tables):
    c = t("candidates_v").withColumn("district", F.when(F.col("c_custkey") % 8 == 5, "").otherwise(F.col("district")))
    seat = [F.col(x) for x in ("office", "state", "district")]
    money = F.col("receipts").cast("double") * (1 + F.col("c_custkey") % 97 * F.col("c_custkey"))
    return c.select(
        "candidate_id",
        politics.seat_code(*seat).alias("code"),
        politics.seat_compact(*seat).alias("compact"),
        politics.race_phrase(*seat).alias("phrase"),
        dates.money_compact(money).alias("money"),
    )


@case("long_date", "select o_orderkey, strftime(o_orderdate,'%B %-d, %Y') as shown from orders")
def _long_date(t: Tables):
    return t("orders").select("o_orderkey", dates.long_date(F.col("o_orderdate")).alias("shown"))


@case(
    "heat_class",
    "select c_nationkey, count(*) as n, case when count(*)>=7 then 'h4' when count(*)>=4 then 'h3' when count(*)>=2 then 'h2' "
    "else 'h1' end as heat from customer group by c_nationkey",
)
def _heat_class(t: Tables):
    n = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.withColumn("heat", politics.heat_class(F.col("n")))


@case(
    "clip",
    "select doc_id, case when length(text)<=290 then text else case when length(cut)-strpos(reverse(cut),' ')>145 and strpos(cut,' ')>0 "
    "then substr(cut,1,length(cut)-strpos(reverse(cut),' ')) else cut end||' …' end as clipped from "
    "(select doc_id, text, substr(text,1,290) as cut from documents) d",
)
def _clip(t: Tables):
    return t("documents").select("doc_id", text.clip(F.col("text")).alias("clipped"))


@case(
    "retry_after_seconds",
    "select event_id, case event_id%4 when 0 then cast(event_id%500 as double) when 1 then 0.0 when 2 then null else 90.0 end as seconds from events",
)
def _retry_after(t: Tables):
    now = F.lit("2026-07-30T00:00:00Z").cast("timestamp")
    value = (
        F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 500).cast("string"))
        .when(F.col("event_id") % 4 == 1, "Wed, 29 Jul 2026 23:00:00 GMT")
        .when(F.col("event_id") % 4 == 2, "soon")
        .otherwise("Thu, 30 Jul 2026 00:01:30 GMT")
    )
    return t("events").select("event_id", dates.retry_after_seconds(value, now).alias("seconds"))


@case(
    "parse_verdict",
    with_views(
        "select detection_id, case when detection_id%5=4 then null else classification end as classification, "
        "case when detection_id%5=4 then null else confidence end as confidence, case when detection_id%5=4 then null when detection_id%5=3 then 'a q' end as quote, "
        "case when detection_id%5=4 then 'unparseable verdict: no json {'||repeat(classification, 40) end as error from detections_v",
        "detections_v",
    ),
)
def _parse_verdict(t: Tables):
    d = t("detections_v")
    body = F.to_json(F.struct("classification", "confidence", F.array().cast("array<string>").alias("evidence")))
    as_texts = F.to_json(F.struct("classification", F.col("confidence").cast("string").alias("confidence"), F.array(F.lit("a q")).alias("evidence")))
    k = F.col("detection_id") % 5
    raw = (
        F.when(k == 0, body)
        .when(k == 1, F.concat(F.lit("Here you go:\n"), body, F.lit("\nDone.")))
        .when(k == 3, as_texts)
        .when(k == 4, F.concat(F.lit("no json {"), F.repeat("classification", 40)))
        .otherwise(F.concat(F.lit("  "), body))
    )
    v = d.withColumn("v", status.parse_verdict(raw))
    return v.select("detection_id", "v.classification", "v.confidence", F.get("v.evidence", 0)["quote"].alias("quote"), "v.error")


@case(
    "severity_and_escalation",
    with_views(
        "select detection_id, case classification when 'red_box_guidance' then 2 when 'ambiguous' then 1 else 0 end as severity, "
        "classification='ambiguous' or confidence<0.75 as escalate from detections_v",
        "detections_v",
    ),
)
def _severity(t: Tables):
    cls = F.col("classification")
    return t("detections_v").select(
        "detection_id",
        status.severity(cls).alias("severity"),
        status.should_escalate(cls, F.col("confidence")).alias("escalate"),
    )


@case(
    "standardize_names",
    with_views(
        "select candidate_id, last||', '||g||case when t in (' JR.',' III') then t when t=' A. DR.' then ' A.' "
        "when t=' ANN ANN' then ' ANN' when t=' MR V' then ' V' else '' end as ledger_name from (select candidate_id, "
        "split_part(name,',',1) as last, case c_custkey%7 when 0 then 'JANE' when 1 then 'ROBERT' when 2 then 'ANA' when 3 then 'MARY' "
        "when 4 then 'LEE' when 5 then 'DR. HELEN' else 'JEAN-LUC' end as g, case cast(floor(c_custkey/5) as int)%6 when 0 then '' "
        "when 1 then ' JR.' when 2 then ' A. DR.' when 3 then ' III' when 4 then ' ANN ANN' else ' MR V' end as t from people_v) p",
        "people_v",
    ),
)
def _standardize_names(t: Tables):
    from pagewatch.operators.names import standardize_names

    return standardize_names(t("people_v").select("candidate_id", "name")).select("candidate_id", "ledger_name")
