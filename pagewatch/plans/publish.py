"""Tables of the published site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from pagewatch.operators.names import standardize_names
from pagewatch.operators.publish import (
    coverage_summary, feed_items, paginate, public_view, rank_index, state_heatmap, status_counts,
)
from pagewatch.plans.views import Views
from pagewatch.session import write_through
from pagewatch.sources.sinks import sitemap_rows


def publish_tables(
    gathered: Views, approved_only: bool, today: Column, page_size: int = 500, site_url: str | None = None
) -> dict[str, DataFrame]:
    """Index, counts, map, exhibits and, for a public site, sitemap and feed.

    Counts cover the full universe even when only approved rows are shown. A
    site address is accepted only for an approved-only build.
    """
    if site_url and not approved_only:
        raise ValueError("site_url requires approved_only")
    everything = write_through(standardize_names(gathered.views), "views")
    shown, exhibits, versions = everything, gathered.exhibits, gathered.versions
    if approved_only:
        shown, exhibits, versions = public_view(everything, exhibits, versions)
    index = paginate(rank_index(shown), page_size)
    tables = {
        "index": index,
        "exhibits": exhibits,
        "versions": versions,
        "status_counts": status_counts(everything),
        "coverage": coverage_summary(everything, approved_only),
        "heatmap": state_heatmap(everything, approved_only),
    }
    if site_url:
        tables["sitemap"] = sitemap_rows(shown, index, site_url, today)
        tables["feed"] = feed_items(shown, exhibits, site_url)
    return tables
