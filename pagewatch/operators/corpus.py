"""Web-corpus jobs: prefilter, chunk, classify, links, sitemaps, crawl plan, robots."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewatch.functions.status import THROTTLE_STATUSES, parse_verdict, severity, should_escalate
from pagewatch.functions.text import SIGNAL_PATTERNS, bind, signal_hits, signal_score, strip
from pagewatch.functions.urls import (
    COMMON_PATHS, canon_url, host_key, is_boilerplate, is_high_value, is_media, is_pdf, same_domain, url_host,
)
from pagewatch.operators.markup import chunks_of, links_of, parse_robots, robots_path, text_of
from pagewatch.operators.ordered import BLOCK_ROWS, running_streak, top_per_key
from pagewatch.operators.resolve import robots_posture
from pagewatch.session import write_through

Scorer = Callable[[DataFrame], DataFrame]

STRIKES = 3  # throttled fetches in a row after which a host is given up


def prefilter(pages: DataFrame, patterns: Sequence[str] = SIGNAL_PATTERNS) -> DataFrame:
    """Add ``scan``, ``reason`` and ``score``. Needs url, raw_text and content_type."""
    url = F.col("url")
    reason = (
        F.when(is_media(url) | is_pdf(url, F.col("content_type")), "media_or_pdf")
        .when(F.col("score") > 0, "signal")
        .when(is_boilerplate(url), "boilerplate_empty")
        .otherwise("default")
    )
    return (
        pages.withColumn("score", signal_score(F.col("raw_text"), patterns))
        .withColumn("reason", reason)
        .withColumn("scan", F.col("reason") != "boilerplate_empty")
    )


def template_aliases(pages: DataFrame, order: str = "scan_id") -> DataFrame:
    """Add ``representative`` (first page of the same candidate and body) and ``deduped``."""
    body = ["candidate_id", "text_hash"]
    first = pages.groupBy(*body).agg(F.min(order).alias("representative"))
    return pages.join(first, body).withColumn("deduped", F.col(order) > F.col("representative"))


def few_pages(
    read: Callable[[Iterator[tuple]], list[tuple]], schema: list[tuple[str, pa.DataType]], rows: int = 64
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the rows that ``read`` makes of a few pages at a time, after ``page_id`` the columns of ``schema``.

    Only these pages' texts become Python's, and what they expand to is handed on before the next pages are read.
    Spark bounds the bytes of the batches themselves (spark.sql.execution.arrow.maxBytesPerBatch).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([("page_id", batch.schema.field("page_id").type), *schema])
            for start in range(0, batch.num_rows, rows):
                made = read(zip(*[column.to_pylist() for column in batch.slice(start, rows).columns]))
                columns = zip(*made) if made else [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return run


def chunk_pages(pages: DataFrame, chunk_chars: int = 40_000) -> DataFrame:
    """(page_id, chunk_no, chunk) from (page_id, text): paragraphs packed up to the limit."""

    def cut(rows: Iterator[tuple]) -> list[tuple]:
        return [(page, n, chunk) for page, text in rows for n, chunk in enumerate(chunks_of(text or "", chunk_chars))]

    key_type = pages.schema["page_id"].dataType.simpleString()
    cut_few = few_pages(cut, [("chunk_no", pa.int32()), ("chunk", pa.string())])
    return pages.select("page_id", "text").mapInArrow(cut_few, f"page_id {key_type}, chunk_no int, chunk string")


def lexical_scorer(patterns: Sequence[str] = SIGNAL_PATTERNS, model: str = "lexical") -> Scorer:
    """The built-in scorer: verdict JSON from the number of distinct signals in a chunk."""

    def score(chunks: DataFrame) -> DataFrame:
        hits = F.filter(
            F.array(
                *[
                    F.when(hit, F.regexp_extract("chunk", "(?iU)" + p, 0))
                    for p, hit in zip(patterns, signal_hits(F.col("chunk"), patterns))
                ]
            ),
            lambda q: q.isNotNull(),
        )
        n = F.size("_hits")
        cls = F.when(n >= 3, "red_box_guidance").when(n >= 1, "ambiguous").otherwise("no_guidance_detected")
        confidence = F.when(n == 0, F.lit(0.9)).otherwise(F.least(F.lit(0.95), 0.5 + n * 0.1))
        verdict = F.struct(
            cls.alias("classification"),
            confidence.alias("confidence"),
            F.transform("_hits", lambda q: F.struct(q.alias("quote"), F.lit("signal").alias("why"))).alias("evidence"),
            F.concat(n.cast("string"), F.lit(" distinct signals")).alias("rationale"),
        )
        return (
            chunks.withColumn("_hits", hits)
            .withColumns({"raw": F.to_json(verdict), "model": F.lit(model)})
            .drop("_hits")
        )

    return score


def batch_scorer(fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], model: str) -> Scorer:
    """Wrap a user's batch function (adds a ``raw`` verdict text to each chunk row)."""

    def score(chunks: DataFrame) -> DataFrame:
        out = T.StructType([*chunks.schema.fields, T.StructField("raw", T.StringType())])
        return chunks.mapInPandas(fn, out).withColumn("model", F.lit(model))

    return score


def score_chunks(chunks: DataFrame, first: Scorer, second: Scorer, escalate_below: float = 0.75) -> DataFrame:
    """(page_id, chunk_no, v, model, escalated): a first pass over all chunks, a second over the doubtful ones.

    The first pass is written before it is read twice, so no chunk is scored again; only
    chunks that go on to the second pass keep their text there.
    """
    parsed = first(chunks).withColumn("v", parse_verdict(F.col("raw"))).drop("raw")
    again = F.col("v.error").isNull() & should_escalate(
        F.col("v.classification"), F.col("v.confidence"), escalate_below
    )
    parsed = parsed.withColumn("again", again).withColumn("chunk", F.when(F.col("again"), F.col("chunk")))
    parsed = write_through(parsed, "scored")
    result = ["page_id", "chunk_no", "v", "model", "escalated"]
    kept = parsed.filter("not again").withColumn("escalated", F.lit(False)).select(*result)
    redo = parsed.filter("again").select(*chunks.columns)
    rescored = second(redo).withColumn("v", parse_verdict(F.col("raw"))).withColumn("escalated", F.lit(True))
    return kept.unionByName(rescored.select(*result))


def combine_chunks(scored: DataFrame) -> DataFrame:
    """One verdict per page: highest severity, its evidence in chunk order, its best confidence."""
    rows = scored.select(
        "page_id",
        F.struct(
            "chunk_no",
            severity(F.col("v.classification")).alias("sev"),
            F.col("v").alias("v"),
            "model",
        ).alias("r"),
        "escalated",
    )
    top = bind(
        F.array_max(F.transform("rows", lambda x: x["sev"])),
        lambda worst: F.filter("rows", lambda r: r["sev"] == worst),
    )
    lead = F.col("top")[0]
    return (
        rows.groupBy("page_id")
        .agg(F.sort_array(F.collect_list("r")).alias("rows"), F.bool_or("escalated").alias("escalated"))
        .withColumn("top", top)
        .select(
            "page_id",
            F.coalesce(lead["v"]["classification"], F.lit("no_guidance_detected")).alias("classification"),
            F.coalesce(F.array_max(F.transform("top", lambda r: r["v"]["confidence"])), F.lit(0.0)).alias("confidence"),
            F.flatten(
                F.transform(
                    "top",
                    lambda r: F.coalesce(
                        r["v"]["evidence"], F.array().cast("array<struct<quote:string,why:string>>")
                    ),
                )
            ).alias("evidence"),
            F.coalesce(lead["v"]["rationale"], F.lit("")).alias("rationale"),
            lead["model"].alias("model"),
            "escalated",
        )
    )


def classify_pages(
    pages: DataFrame,
    first: Scorer | None = None,
    second: Scorer | None = None,
    chunk_chars: int = 40_000,
    escalate_below: float = 0.75,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, quarantine). One unreadable chunk sends its whole page to quarantine.

    A quarantined page keeps every reply that could not be read, whole, by chunk.
    """
    first = first or lexical_scorer()
    second = second or lexical_scorer(model="lexical-second")
    scored = write_through(
        score_chunks(chunk_pages(pages, chunk_chars), first, second, escalate_below), "verdicts"
    )
    unread = F.sort_array(F.collect_list(F.struct("chunk_no", F.col("v.error").alias("error"))))
    failed = scored.filter("v.error is not null").groupBy("page_id").agg(unread.alias("unread"))
    failed = failed.select("page_id", F.get("unread", 0)["error"].alias("error"), "unread")
    return combine_chunks(scored.join(failed, "page_id", "left_anti")), failed


def extract_links(pages: DataFrame) -> DataFrame:
    """Same-site links of (page_id, url, html): (page_id, url, pos, href, kind page/pdf).

    An optional ``site_url`` column anchors the same-site test.
    """
    anchor = F.col("site_url") if "site_url" in pages.columns else F.col("url")
    key_type = pages.schema["page_id"].dataType.simpleString()

    def read(rows: Iterator[tuple]) -> list[tuple]:
        return [
            (page, url, site, pos, href, kind) for page, url, site, html in rows for pos, (href, kind) in enumerate(links_of(url, html or ""))
        ]

    text = pa.string()
    read_few = few_pages(read, [("url", text), ("site_url", text), ("pos", pa.int32()), ("href", text), ("kind", text)])
    found = pages.select("page_id", "url", anchor.alias("site_url"), "html").mapInArrow(
        read_few, f"page_id {key_type}, url string, site_url string, pos int, href string, kind string"
    )
    return found.filter(same_domain(F.col("site_url"), F.col("href"))).drop("site_url")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): every text node outside code and markup elements."""
    key_type = pages.schema["page_id"].dataType.simpleString()

    def read(rows: Iterator[tuple]) -> list[tuple]:
        return [(page, text_of(html or "")) for page, html in rows]

    read_few = few_pages(read, [("text", pa.string())])
    return pages.select("page_id", "html").mapInArrow(read_few, f"page_id {key_type}, text string")


LOC = r"(?is)<loc>\s*(.*?)\s*</loc>"


def sitemap_urls(
    sites: DataFrame, documents: DataFrame, max_children: int = 25, max_locs: int = 2000, blocked: DataFrame | None = None
) -> DataFrame:
    """(site, pos, url): page addresses from sitemaps and one level of sitemap index.

    ``sites``: site, ord, doc_url (sitemaps in the order they are tried).
    ``documents``: doc_url, body (fetched ones). ``blocked``: doc_url of sitemaps that robots
    files disallow. A blocked child takes no place among the ``max_children``; one that is
    allowed takes a place even if it could not be fetched.
    """
    docs = documents.filter(strip(F.coalesce("body", F.lit(""))) != "").select(
        "doc_url",
        F.transform(F.regexp_extract_all("body", F.lit(LOC), F.lit(1)), strip).alias("locs"),
        F.contains(F.lower("body"), F.lit("<sitemapindex")).alias("is_index"),
    )
    allowed = lambda df: df if blocked is None else df.join(blocked.select("doc_url"), "doc_url", "left_anti")
    top = allowed(sites).join(docs, "doc_url")
    plain = top.filter("not is_index").select("site", "ord", F.lit(-1).alias("child"), "locs")
    place = [F.col("ord"), F.col("child")]
    listed = top.filter("is_index").select("site", "ord", F.posexplode("locs").alias("child", "doc_url"))
    children = (
        top_per_key(allowed(listed), ["site"], place, max_children)
        .join(docs, "doc_url")
        .select("site", "ord", "child", "locs")
    )
    # every unit holds an address, so the cap is reached within max_locs units
    filled = plain.unionByName(children).filter(F.size("locs") > 0)
    before = Window.partitionBy("site").orderBy("ord", "child").rowsBetween(Window.unboundedPreceding, -1)
    units = (
        top_per_key(filled, ["site"], place, max_locs)
        .withColumn("_before", F.coalesce(F.sum(F.size("locs")).over(before), F.lit(0)))
        .filter(F.col("_before") < max_locs)
    )
    found = (
        units.select("site", "ord", "child", F.posexplode("locs").alias("i", "url"))
        .filter("url <> ''")
        .groupBy("site", "url")
        .agg(F.min(F.struct("ord", "child", "i")).alias("place"))
    )
    return top_per_key(found, ["site"], [F.col("place")], max_locs, "pos").select("site", "pos", "url")


def seed_urls(sites: DataFrame, sitemap: DataFrame | None = None, common_paths: Sequence[str] = COMMON_PATHS) -> DataFrame:
    """(site, url, via, pos, page_key): base address, probed paths, sitemap; first form wins.

    ``sites``: site (the base address).
    """
    root = F.regexp_extract("site", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    options = [F.struct(F.lit(0).alias("pos"), F.col("site").alias("url"), F.lit("seed").alias("via"))]
    for i, path in enumerate(common_paths, start=1):
        options.append(
            F.struct(F.lit(i).alias("pos"), F.concat(root, F.lit(path)).alias("url"), F.lit("common_path").alias("via"))
        )
    rows = sites.select("site", F.inline(F.array(*options)))
    if sitemap is not None:
        listed = sitemap.select("site", (F.col("pos") + len(common_paths)).alias("pos"), "url", F.lit("sitemap").alias("via"))
        rows = rows.unionByName(listed)
    bare = F.substring_index("url", "#", 1)
    trimmed = F.rtrim(bare, F.lit("/"))
    cleaned = rows.withColumn("url", F.when(trimmed == "", bare).otherwise(trimmed)).filter("url <> ''")
    return (
        cleaned.filter(same_domain(F.col("site"), F.col("url")))
        .withColumn("page_key", canon_url(F.col("url")))
        .groupBy("site", "page_key")
        .agg(F.min_by(F.struct("url", "via", "pos"), "pos").alias("r"))
        .select("site", "r.url", "r.via", "r.pos", "page_key")
    )


def crawl_budget(frontier: DataFrame, max_pages: int = 150, order: Sequence[Column] | None = None) -> DataFrame:
    """Rows within each site's per-class budget, with their ``budget_rank``."""
    return top_per_key(frontier, ["site", "high"], order or [F.col("pos")], max_pages, "budget_rank")


def given_up(fetched: DataFrame, responses: DataFrame) -> DataFrame:
    """(site, host, gone): where in a site's crawl a host has answered ``STRIKES`` times in a row by throttling.

    ``fetched``: site, page_key, host, at. Its rows of a site are bounded by the crawl's budgets.
    """
    hit = F.coalesce(F.col("http_status").isin(*THROTTLE_STATUSES), F.lit(False))
    answers = responses.groupBy("site", "page_key").agg(F.bool_or(hit).alias("hit"))
    last = Window.partitionBy("site", "host").orderBy("at").rowsBetween(1 - STRIKES, 0)
    return (
        fetched.join(answers, ["site", "page_key"], "left")
        .withColumn("strikes", F.sum(F.coalesce("hit", F.lit(False)).cast("int")).over(last))
        .filter(F.col("strikes") == STRIKES)
        .groupBy("site", "host")
        .agg(F.min("at").alias("gone"))
    )


def within_budget(fresh: DataFrame, seen: DataFrame | None, max_pages: int) -> DataFrame:
    """The first rows of each site's classes that what ``seen`` has spent leaves room for."""
    taken = crawl_budget(fresh, max_pages, [F.col("at")])
    if seen is not None:
        spent = seen.groupBy("site", "high").agg(F.count("*").alias("spent"))
        taken = taken.join(spent, ["site", "high"], "left").filter(
            F.col("budget_rank") + F.coalesce("spent", F.lit(0)) <= max_pages
        )
    return taken.select(*fresh.columns)


def fetch_level(
    fresh: DataFrame, seen: DataFrame | None, responses: DataFrame | None, max_pages: int, label: str, own_budget: bool = False
) -> DataFrame:
    """The rows of ``fresh`` that are fetched, written.

    Which pages are fetched decides when a host is given up, and that decides which later pages have
    the budget. Both are computed in turn until the given up hosts stay the same. A page depends on
    earlier ones only, so each turn settles at least one more host of every site, and what stays the
    same is what fetching one by one gives. As budgets bound a site's fetches, they bound the turns.
    """
    spent = None if own_budget else seen
    if responses is None:
        return write_through(within_budget(fresh, spent, max_pages), label)
    narrow = ["site", "page_key", "host", "at"]
    earlier = seen.select(*narrow) if seen is not None else fresh.select(*narrow).limit(0)
    fresh = write_through(fresh, f"{label}-frontier")
    gone = write_through(given_up(earlier, responses), f"{label}-gone")
    while True:
        open_ = fresh.join(gone, ["site", "host"], "left").filter("gone is null or at <= gone").drop("gone")
        done = write_through(within_budget(open_.select(*fresh.columns), spent, max_pages), label)
        now = write_through(given_up(earlier.unionByName(done.select(*narrow)), responses), f"{label}-gone")
        before = gone.withColumnRenamed("gone", "before")
        if now.join(before, ["site", "host"], "full_outer").filter("not gone <=> before").isEmpty():
            return done
        gone = now


def crawl_plan(
    seeds: DataFrame,
    edges: DataFrame,
    blocked: DataFrame | None = None,
    depth: int = 2,
    max_pages: int = 150,
    responses: DataFrame | None = None,
) -> DataFrame:
    """(site, depth, place, url, via, high): what a crawl fetches, in order.

    ``seeds``: site, url, via, pos, page_key. ``edges``: site, page_key, pos,
    href, kind. ``blocked``: site, page_key of disallowed or failed pages.
    ``responses``: site, page_key, http_status; a page with several rows is throttled if one says so,
    one without a row is not.
    Level by level: budgets are spent in frontier order before links are
    followed, so pages beyond the budget contribute no links. A host that throttles ``STRIKES``
    fetches of a site in a row is given up: its later addresses, PDFs included, are left out and
    spend no budget. Linked PDFs come last (depth -1), by address, on their own budget.
    """
    high = lambda: is_high_value(F.col("url"))
    frontier = seeds.withColumn("high", high()).withColumn(
        "place", F.array((~F.col("high")).cast("long"), F.col("pos").cast("long"))
    )
    links = edges.select("site", "page_key", F.col("pos").alias("link_pos"), F.col("href"), "kind")
    columns = ["site", "page_key", "url", "via", "high", "place", "depth", "host", "at"]

    def unseen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        for other in (seen, blocked):
            if other is not None:
                rows = rows.join(other.select("site", "page_key"), ["site", "page_key"], "left_anti")
        return rows.withColumn("host", host_key(F.col("url")))

    levels: list[DataFrame] = []
    seen: DataFrame | None = None
    for level in range(depth + 1):
        fresh = frontier.groupBy("site", "page_key").agg(
            F.min_by(F.struct("url", "via", "high", "place"), "place").alias("r")
        ).select("site", "page_key", "r.*")
        fresh = unseen(fresh, seen).withColumns(
            {"depth": F.lit(level), "at": F.struct(F.lit(level).alias("level"), "place", F.lit("").alias("url"))}
        )
        done = fetch_level(fresh.select(*columns), seen, responses, max_pages, f"level{level}")
        levels.append(done)
        seen = done if seen is None else seen.unionByName(done)
        if level < depth:
            frontier = (
                done.select("site", "page_key", "place")
                .join(links.filter("kind = 'page'"), ["site", "page_key"])
                .select("site", F.col("href").alias("url"), "place", "link_pos", F.lit("link_crawl").alias("via"))
                .withColumns({"high": high(), "page_key": canon_url(F.col("url"))})
                .withColumn(
                    "place",
                    F.concat("place", F.array((~F.col("high")).cast("long"), F.col("link_pos").cast("long"))),
                )
            )
    expanded = levels[0].filter(F.lit(depth > 0))  # pages of the last level are not searched for links
    for done in levels[1:depth]:
        expanded = expanded.unionByName(done)
    pdfs = (
        expanded.select("site", "page_key")
        .join(links.filter("kind = 'pdf'"), ["site", "page_key"])
        .select("site", F.col("href").alias("url"))
        .withColumn("page_key", canon_url(F.col("url")))
        .groupBy("site", "page_key")
        .agg(F.min("url").alias("url"))
    )
    nowhere = F.array().cast("array<bigint>")
    last = F.struct(F.lit(depth + 1).alias("level"), nowhere.alias("place"), "url")
    pdfs = unseen(pdfs, seen).withColumns(
        {"via": F.lit("pdf_link"), "high": F.lit(True), "place": nowhere, "depth": F.lit(-1), "at": last}
    )
    documents = fetch_level(pdfs.select(*columns), seen, responses, max_pages, "documents", own_budget=True)
    in_order = Window.partitionBy("site").orderBy("url")
    documents = documents.withColumn("place", F.array(F.row_number().over(in_order).cast("long")))
    return seen.unionByName(documents).select("site", "depth", "place", "url", "via", "high")


def robots_rules(documents: DataFrame, agent: str) -> DataFrame:
    """(host, closed, rules, crawl_delay) for one agent from (host, http_status, body).

    A 5xx document closes the host; 4xx or no document leaves it open.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (host, *parse_robots(int(status), body or "", agent))
                for host, status, body in zip(batch["host"], batch["http_status"], batch["body"])
            ]
            yield pd.DataFrame(rows, columns=["host", "closed", "rules", "crawl_delay"])

    return documents.select("host", F.coalesce("http_status", F.lit(404)).alias("http_status"), "body").mapInPandas(
        read, "host string, closed boolean, rules array<struct<path:string,allow:boolean>>, crawl_delay double"
    )


def robots_audit(
    urls: DataFrame, documents: DataFrame, overrides: DataFrame, agent: str, default: str = "respect"
) -> DataFrame:
    """Add ``allowed``, ``posture`` and ``crawl_delay`` to each url.

    Documents are parsed once per host; each address is then checked against
    its host's rules with built-in expressions, so a hot host needs no grouping.
    """
    rules = robots_rules(documents, agent).withColumnRenamed("host", "_host")
    checked = (
        robots_posture(urls, overrides, default)
        .withColumns({"_host": url_host(F.col("url")), "_path": robots_path(F.col("url"))})
        .join(rules, "_host", "left")
    )
    hit = F.try_element_at(
        F.filter("rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), F.lit(1)
    )
    by_rules = F.when(F.coalesce("closed", F.lit(False)), False).otherwise(F.coalesce(hit["allow"], F.lit(True)))
    return checked.withColumn(
        "allowed", F.when(F.col("posture") == "override", True).otherwise(by_rules)
    ).drop("_host", "_path", "closed", "rules")


def host_strikes(fetch_log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add strikes, backoff_seconds and abandoned per fetch.

    ``fetch_log``: seq, host, http_status, optional retry_after (seconds).
    """
    throttled = F.coalesce(F.col("http_status").isin(*THROTTLE_STATUSES), F.lit(False))
    out = running_streak(fetch_log, "host", "seq", throttled, "strikes", block_rows)
    given = F.col("retry_after") if "retry_after" in fetch_log.columns else F.lit(None).cast("double")
    wait = F.least(F.coalesce(given, F.lit(30.0) * F.pow(F.lit(2.0), F.col("strikes") - 1)), F.lit(300.0))
    gave_up = F.col("strikes") >= STRIKES
    return out.withColumns(
        {"backoff_seconds": F.when((F.col("strikes") > 0) & ~gave_up, wait), "abandoned": gave_up}
    )


def scan_outcome(pages: DataFrame, robots_blocked: DataFrame) -> DataFrame:
    """Per-candidate counters and disposition of one sweep.

    ``pages``: candidate_id, recorded, usable, prefiltered, deduped,
    classification (of pages classified now), event_type.
    """
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    rec = F.col("recorded")
    counters = pages.groupBy("candidate_id").agg(
        n(rec & F.col("usable")).alias("pages_scanned"),
        n(~rec | ~F.col("usable")).alias("pages_failed"),
        n(F.col("classification").isNotNull()).alias("detections"),
        n(F.col("classification") == "red_box_guidance").alias("positives"),
        n(F.col("classification") == "ambiguous").alias("ambiguous"),
        n(F.col("prefiltered")).alias("prefiltered"),
        n(F.col("deduped")).alias("deduped"),
        n(F.col("event_type").isNotNull()).alias("changes"),
        n(F.col("event_type") == "take_down").alias("take_downs"),
        n(F.col("event_type") == "put_up").alias("put_ups"),
    )
    blocked = robots_blocked.select("candidate_id").distinct().withColumn("_blocked", F.lit(True))
    disposition = (
        F.when(F.col("pages_scanned") > 0, "scanned")
        .when(F.col("_blocked"), "robots_blocked")
        .otherwise("fetch_failed")
    )
    return counters.join(blocked, "candidate_id", "left").withColumn("scan_status", disposition).drop("_blocked")
