"""Domain views over the driver's tables, as SQL that both engines run unchanged."""

from __future__ import annotations

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (sql, names it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "candidates_v": (
        """select 'C'||lpad(cast(c_custkey as string),6,'0') as candidate_id, c_name as name,
  case c_custkey%10 when 0 then 'P' when 1 then 'S' when 2 then 'S' else 'H' end as office, n_name as state,
  case when c_custkey%10<3 then '00' else lpad(cast(c_custkey%4 as string),2,'0') end as district,
  case c_mktsegment when 'BUILDING' then 'DEM' when 'MACHINERY' then 'DFL'
       when 'AUTOMOBILE' then 'REP' when 'HOUSEHOLD' then 'GOP' else 'IND' end as party,
  2026 as cycle, cast(c_acctbal*20 as decimal(18,2)) as receipts, c_custkey%9=0 as incumbent,
  case when c_custkey%11=0 then null else 'https://site'||cast(c_custkey as string)||'.example' end as website_url,
  c_custkey%4=0 as url_verified, case when c_custkey%13=0 then 3 when c_custkey%17=0 then 1 end as inactive,
  c_custkey
from customer join nation on c_nationkey=n_nationkey""",
        ("customer", "nation"),
    ),
    # every person twice: a second id with a suffix in the name and the same money
    "filings_v": (
        """select candidate_id, name, office, state, district, party, receipts,
  case when incumbent then 'I' else 'C' end as incumbent_challenge, inactive, c_custkey from people_v
union all
select 'H4'||substr(candidate_id,2), regexp_replace(name, ',', ' JR,'), office, state, district, party, receipts,
  'O' as incumbent_challenge, inactive, c_custkey from people_v""",
        ("people_v",),
    ),
    # candidates with filed and reported names
    "people_v": (
        """select candidate_id,
  case c_custkey%5 when 0 then 'SMITH' when 1 then 'ONDER' when 2 then 'O''BRIEN' when 3 then 'VAN-DYKE'
    else 'MCCOY' end || ', ' || given || tail as name,
  case when c_custkey%3=0 then 'Mc' else '' end || case c_custkey%5 when 0 then 'Smith' when 1 then 'Onder'
    when 2 then 'O''Brien' when 3 then 'Van-Dyke' else 'Mccoy' end as feed_last,
  case cast(floor(c_custkey/7) as int)%4 when 0 then given when 1 then substr(given,1,1)||'.' when 2 then substr(given,1,2)
    else 'Pat' end as feed_given,
  office, state, district, party, cycle, receipts, incumbent, website_url, url_verified, inactive, c_custkey
from (select *, case c_custkey%7 when 0 then 'JANE' when 1 then 'ROBERT' when 2 then 'ANA' when 3 then 'MARY'
    when 4 then 'LEE' when 5 then 'DR. HELEN' else 'JEAN-LUC' end as given,
  case cast(floor(c_custkey/5) as int)%6 when 0 then '' when 1 then ' JR.' when 2 then ' A. DR.' when 3 then ' III'
    when 4 then ' ANN ANN' else ' MR V' end as tail from candidates_v) c""",
        ("candidates_v",),
    ),
    "inactive_v": ("select candidate_id from candidates_v where inactive=1", ("candidates_v",)),
    "ratings_v": (
        """select n_nationkey as seq, case n_nationkey%3 when 0 then 'S' else 'H' end as office, n_name as state,
  case n_nationkey%3 when 0 then null when 1 then '01' else '02' end as district,
  case n_nationkey%6 when 0 then 'TOSSUP' when 1 then 'Lean R' when 2 then ' tilt D' when 3 then 'Likely D'
    when 4 then 'Safe R' else 'too close' end as rating from nation
union all
select n_nationkey+1000, 'H', n_name, '01', 'Toss-up' from nation where n_regionkey=1""",
        ("nation",),
    ),
    "elections_v": (
        """select n_name as state, 2026 as cycle, '' as office, date '2026-03-03'+n_nationkey*7 as primary_date,
  date '2026-01-05' as filing_deadline,
  case when n_nationkey%5=2 then date '2026-03-31'+n_nationkey*7 end as runoff_date from nation
union all select n_name,2026,'H',date '2026-08-11',null,null from nation where n_nationkey%6=0
union all select n_name,2026,'H:01',date '2026-09-01',null,null from nation where n_nationkey%5=0""",
        ("nation",),
    ),
    # raw result documents, one winner each
    "races_v": (
        """select c_custkey as seq, case office when 'H' then 'U.S. House' when 'S' then 'Senate' else 'Governor' end as type,
  state as province, case when office='H' then state||'-'||district else district end as district,
  case when c_custkey%9=4 then 'General' else 'Primary' end as election_type,
  case c_custkey%4 when 0 then '2026-03-03T00:00:00Z' when 1 then '2026-05-26T00:00:00Z' when 2 then ''
    else '2024-03-05T00:00:00Z' end as election_date,
  case when c_custkey%2=0 then feed_given||' '||feed_last else feed_last||', '||feed_given end as winner_name,
  party as winner_party, c_custkey%8<>5 as called
from people_v""",
        ("people_v",),
    ),
    "overrides_v": (
        """select office||'-'||upper(state)||'-'||case when office in ('S','P') then '0' else cast(cast(district as int) as string) end||'-'||case when party in ('DEM','DFL') then 'DEM' when party in ('REP','GOP') then 'REP'
    else party end as key,
  case when c_custkey%2=0 then candidate_id else 'X'||candidate_id end as candidate_id,
  'Override '||cast(c_custkey as string) as name
from candidates_v where c_custkey in (select min(c_custkey) from candidates_v group by state, office, party)""",
        ("candidates_v",),
    ),
    "scans_v": (
        """select event_id as scan_id,'C'||lpad(cast(user_id as string),6,'0') as candidate_id,
  case event_id%3 when 0 then 'https://www.' when 1 then 'https://' else 'http://' end
   ||'site'||cast(user_id as string)||'.example/p'
   ||cast(cast(regexp_extract(props,'([0-9]+)',1) as int)%3 as string)
   ||case when event_id%5=0 then '/' else '' end as url,
  ts as fetched_at, case event_type when 'error' then 404 else 200 end as http_status,
  case when event_type='error' then '' when event_type='signup' and event_id%4=0 then 'Just a moment...'
       else 'body '||cast(cast(floor(value) as bigint)%3 as string) end as raw_text,
  case when event_type='error' then '' when event_type='signup' and event_id%4=0 then 'Just a moment...'
       else 'body '||cast(cast(floor(value) as bigint)%3 as string) end as text_hash,
  case when event_id%10=3 then 'pdf' else 'browser' end as render_mode, event_type
from events""",
        ("events",),
    ),
    "detections_v": (
        """select event_id as detection_id, event_id as scan_id, 'C'||lpad(cast(user_id as string),6,'0') as candidate_id,
  case when event_type='purchase' then 'red_box_guidance'
       when event_type='click' and event_id%2=0 then 'ambiguous' else 'no_guidance_detected' end as classification,
  cast(event_id%100 as double)/100 as confidence, event_id%7=0 as escalated, ts as classified_at
from events where event_type in ('purchase','click','view')""",
        ("events",),
    ),
    "reviews_v": (
        """select event_id*2 as review_id, event_id as detection_id,
  case event_id%5 when 0 then 'reject' when 1 then 'needs_more' else 'approve' end as action, ts as reviewed_at,
  'reviewer '||cast(event_id%7 as string) as reviewer
from events where event_type in ('purchase','click') and event_id%3=0
union all
select event_id*2+1, event_id, case event_id%4 when 0 then 'approve' else 'reject' end, ts, cast(null as string)
from events where event_type in ('purchase','click') and event_id%6=0""",
        ("events",),
    ),
    "archives_v": (
        """select event_id*3 as archive_id, case when event_type='click' then event_id end as detection_id, event_id as scan_id,
  case when event_id%4=0 then '/a/'||cast(event_id as string)||'.pdf' end as pdf_path, ts as archived_at
from events where event_type in ('purchase','click')""",
        ("events",),
    ),
    # recorded change events of the tracker itself (not a replay)
    "change_events_v": (
        """select scan_id as change_id, candidate_id, url,
  case when event_type='error' then 'take_down' when event_type='purchase' then 'put_up' else 'modified' end as event_type,
  case when event_type='click' then scan_id-1 end as prev_scan_id, scan_id as new_scan_id,
  case when event_type='purchase' then 'no_guidance_detected' else 'red_box_guidance' end as prev_classification,
  case when event_type='error' then 'no_guidance_detected' when event_type='purchase' then 'red_box_guidance'
    else 'ambiguous' end as new_classification, fetched_at as detected_at
from scans_v where event_type in ('error','purchase','click')""",
        ("scans_v",),
    ),
    "ie_filings_v": (
        """select o_orderkey as seq, cast(o_orderkey as string) as transaction_id,
  'C'||lpad(cast(o_custkey as string),6,'0') as candidate_id,
  'K'||lpad(cast(o_orderkey%40 as string),3,'0') as committee_id, 'PAC '||cast(o_orderkey%40 as string) as committee_name,
  case o_orderstatus when 'F' then 'S' when 'O' then 'O' end as support_oppose_indicator,
  cast(o_totalprice as decimal(18,2)) as expenditure_amount,
  cast(o_orderdate as date) + 10000 as expenditure_date, 2026 as cycle
from orders""",
        ("orders",),
    ),
    "fetch_log_v": (
        """select event_id as seq, 'site'||cast(user_id%20 as string)||'.example' as host,
  case event_type when 'error' then 429 when 'signup' then 503 else 200 end as http_status, ts from events""",
        ("events",),
    ),
    # pages and documents as pages of sites
    "page_texts_v": (
        """select doc_id as page_id, 'https://'||source||'.example'||case doc_id%7 when 0 then '/Media-Kit' when 1 then '/donate'
    when 2 then '/privacy/x' when 3 then '/about.PDF' when 4 then '/signup?x=1' else '/p'||cast(doc_id as string) end as url,
  case when doc_id%11=0 then 'application/pdf' else 'text/html' end as content_type, text as raw_text, source, lang
from documents""",
        ("documents",),
    ),
}
