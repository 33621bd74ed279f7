"""Campaign-site resolution from landed lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.politics import fec_name_parts
from pagewatch.functions.urls import is_blocked_host, pick_campaign_url, robots_host, site_host, url_host, website_from_wikitext
from pagewatch.operators.ordered import latest_per_key, top_per_key


def resolve_targets(candidates: DataFrame, force: bool = False) -> DataFrame:
    """Add ``disposition``: why a candidate is skipped, or 'attempt'."""
    has_url = F.coalesce("website_url", F.lit("")) != ""
    ladder = (
        F.when(F.coalesce("url_verified", F.lit(False)), "manual (kept)")
        .when(F.col("url_source") == "human_none", "human_none (kept)")
        .when(F.coalesce("inactive", F.lit(0)) != 0, "inactive (skipped)")
    )
    if not force:
        ladder = ladder.when(has_url, F.concat(F.coalesce("url_source", F.lit("None")), F.lit(" (kept)")))
    return candidates.withColumn("disposition", ladder.otherwise("attempt"))


def encyclopedia_site(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """(candidate_id, url) from the first article that is about the candidate and names a site.

    ``articles``: candidate_id, rank, title, wikitext. The title must hold the
    last name, and the first name unless that is shorter than three letters.
    """
    named = candidates.select("candidate_id", fec_name_parts(F.col("name")).alias("n")).filter("n.last <> ''")
    title = F.lower("title")
    about = F.contains(title, F.lower("n.last")) & (
        F.contains(title, F.lower("n.first")) | (F.length("n.first") < 3)
    )
    return (
        articles.join(named, "candidate_id")
        .filter(about)
        .withColumn("url", website_from_wikitext(F.col("wikitext")))
        .filter("url is not null")
        .groupBy("candidate_id")
        .agg(F.min_by("url", "rank").alias("url"))
    )


def select_search_result(hits: DataFrame, answers: DataFrame, shown: int = 8) -> DataFrame:
    """(candidate_id, url): the shown result whose host the answer names.

    ``hits``: candidate_id, rank, link. ``answers``: candidate_id, answer. A candidate has few hits, so they are
    dealt by candidate first: a cut ahead of the shuffle would sort all hits of a scan task and drop next to none.
    """
    open_hits = hits.filter((F.coalesce("link", F.lit("")) != "") & ~is_blocked_host(F.col("link")))
    listed = top_per_key(open_hits.repartition("candidate_id"), ["candidate_id"], [F.col("rank")], shown)
    picked = answers.withColumn("host", site_host(pick_campaign_url(F.col("answer")))).filter("host is not null")
    return (
        listed.withColumn("host", site_host(F.col("link")))
        .join(picked.select("candidate_id", "host"), ["candidate_id", "host"])
        .groupBy("candidate_id")
        .agg(F.min_by("link", "rank").alias("url"))
    )


def resolution_chain(
    candidates: DataFrame,
    overrides: DataFrame,
    encyclopedia: DataFrame,
    committees: DataFrame,
    search: DataFrame,
    search_source: str = "search",
) -> DataFrame:
    """(candidate_id, url, url_source, url_verified): the first source that answers.

    ``overrides``: candidate_id, url, verified. The other tables: candidate_id, url
    (committees also carry ``seq``; only http addresses count).
    """
    manual = overrides.select(
        "candidate_id",
        F.struct(F.col("url"), F.lit("manual").alias("source"), F.coalesce("verified", F.lit(True)).alias("verified")).alias("m"),
    )

    def layer(df: DataFrame, source: str, name: str) -> DataFrame:
        return df.filter("url is not null").select(
            "candidate_id", F.struct("url", F.lit(source).alias("source"), F.lit(False).alias("verified")).alias(name)
        )

    filed = (
        committees.filter(F.col("url").startswith("http"))
        .groupBy("candidate_id")
        .agg(F.min_by("url", "seq").alias("url"))
    )
    out = candidates.select("candidate_id").join(manual, "candidate_id", "left")
    for df, source, name in (
        (encyclopedia, "wikipedia", "w"), (filed, "committee", "c"), (search, search_source, "s"),
    ):
        out = out.join(layer(df, source, name), "candidate_id", "left")
    nothing = F.struct(
        F.lit(None).cast("string").alias("url"), F.lit("none").alias("source"), F.lit(False).alias("verified")
    )
    hit = F.coalesce("m", "w", "c", "s", nothing)
    return out.select(
        "candidate_id",
        hit["url"].alias("url"),
        hit["source"].alias("url_source"),
        hit["verified"].alias("url_verified"),
    )


def apply_resolution(candidates: DataFrame, resolved: DataFrame, ts, force: bool = False) -> DataFrame:
    """Write resolved sites onto attempted candidates; a forced miss clears an automatic URL."""
    hits = resolved.select(
        "candidate_id", F.col("url").alias("_url"), F.col("url_source").alias("_src"), F.col("url_verified").alias("_ver")
    )
    joined = resolve_targets(candidates, force).join(hits, "candidate_id", "left")
    attempted = F.col("disposition") == "attempt"
    hit = attempted & F.col("_url").isNotNull()
    miss = attempted & F.col("_url").isNull() & F.col("website_url").isNotNull() & F.lit(force)
    changes = {
        "website_url": F.when(hit, F.col("_url")).when(miss, F.lit(None)).otherwise(F.col("website_url")),
        "url_source": F.when(hit, F.col("_src")).when(miss, "none").otherwise(F.col("url_source")),
        "url_verified": F.when(hit, F.col("_ver")).otherwise(F.col("url_verified")),
        "updated_at": F.when(hit | miss, ts).otherwise(F.col("updated_at")),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in candidates.columns])


def robots_posture(urls: DataFrame, overrides: DataFrame, default: str = "respect") -> DataFrame:
    """Add ``posture`` per URL: the host's override, else the default.

    ``overrides``: host, posture, written in any case, with or without port and 'www.'.
    """
    rules = latest_per_key(
        overrides.select(robots_host(F.col("host")).alias("_host"), F.lower(F.trim("posture")).alias("_posture")),
        ["_host"],
        [F.col("_posture").desc()],
    )
    return (
        urls.withColumn("_host", robots_host(url_host(F.col("url"))))
        .join(rules, "_host", "left")
        .withColumn("posture", F.coalesce("_posture", F.lit(default)))
        .drop("_host", "_posture")
    )
