"""Sinks: the universe CSV, feed, sitemap and index data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.dates import plain_number

CSV_COLUMNS = (
    "candidate_id", "name", "office", "state", "district", "party",
    "universe_reason", "nominee_source", "rating", "receipts",
)


def universe_csv_rows(universe: DataFrame) -> DataFrame:
    """The ten CSV columns: blanks instead of NULLs, whole-dollar receipts."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return universe.select(
        *[blank(c) for c in CSV_COLUMNS[:-1]], plain_number(F.col("receipts"), 0).alias("receipts")
    )


def write_universe_csv(universe: DataFrame, path: str) -> None:
    universe_csv_rows(universe).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def feed_json(items: DataFrame) -> DataFrame:
    """Feed items -> one JSON text per item (column ``value``)."""
    body = F.to_json(F.struct("id", "url", "title", "content_text", "date_published"))
    return items.select("position", body.alias("value"))


def write_feed(items: DataFrame, path: str) -> None:
    feed_json(items).orderBy("position").select("value").write.mode("overwrite").text(path)


def sitemap_rows(views: DataFrame, pages: DataFrame, site_url: str, today: Column) -> DataFrame:
    """(loc, lastmod): index pages, static pages and one row per candidate page."""
    root = site_url.rstrip("/")
    day = F.date_format(today, "yyyy-MM-dd")
    static = ("methodology", "corrections", "about")
    index = pages.select("page").distinct().select(
        F.when(F.col("page") == 1, F.lit(f"{root}/")).otherwise(
            F.concat(F.lit(f"{root}/index-"), F.col("page").cast("string"))
        ).alias("loc"),
        day.alias("lastmod"),
    )
    fixed = views.sparkSession.createDataFrame([(f"{root}/{s}",) for s in static], "loc string").withColumn(
        "lastmod", day
    )
    candidates = views.select(
        F.concat(F.lit(f"{root}/"), "candidate_id").alias("loc"),
        F.coalesce(F.date_format("lastmod", "yyyy-MM-dd"), day).alias("lastmod"),
    )
    return index.unionByName(fixed).unionByName(candidates)


def write_sitemap(rows: DataFrame, path: str) -> None:
    entry = F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc><lastmod>"), "lastmod", F.lit("</lastmod></url>"))
    rows.select(entry.alias("value")).write.mode("overwrite").text(path)


def write_index_data(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").json(path)
