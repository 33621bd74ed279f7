"""Outside spending per candidate and how it follows first detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.status import is_positive
from pagewatch.operators.review import with_latest_review


def committee_spend(filings: DataFrame, cycle: int) -> DataFrame:
    """Sum, count and date range per (candidate, committee, indicator)."""
    return (
        filings.filter(F.col("cycle") == cycle)
        .groupBy("candidate_id", "committee_id", F.col("support_oppose_indicator").alias("ind"))
        .agg(
            F.max("committee_name").alias("committee_name"),
            F.sum("expenditure_amount").alias("amount"),
            F.count("*").alias("count"),
            F.min("expenditure_date").alias("first_date"),
            F.max("expenditure_date").alias("last_date"),
        )
        .select(
            "candidate_id",
            "committee_id",
            "committee_name",
            F.coalesce(F.nullif("ind", F.lit("")), F.lit("?")).alias("indicator"),
            F.coalesce("amount", F.lit(0)).cast("decimal(28,2)").alias("amount"),
            "count",
            "first_date",
            "last_date",
        )
    )


def open_positives(detections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Positive detections whose latest review is not a rejection."""
    return with_latest_review(detections.filter(is_positive(F.col("classification"))), reviews).filter(
        F.coalesce("action", F.lit("")) != "reject"
    )


def positives_to_corroborate(detections: DataFrame, reviews: DataFrame) -> DataFrame:
    return open_positives(detections, reviews).select("candidate_id").distinct()


def first_detected(detections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Earliest open positive per candidate; ties go to the smaller id."""
    order = F.struct("classified_at", "detection_id")
    return (
        open_positives(detections, reviews)
        .groupBy("candidate_id")
        .agg(F.min(order).alias("d"))
        .select(
            "candidate_id",
            F.col("d.detection_id").alias("detection_id"),
            F.col("d.classified_at").alias("guidance_first_detected"),
        )
    )


def supporting_after(filings: DataFrame, firsts: DataFrame, cycle: int) -> DataFrame:
    """Supporting money dated on or after the detection day, per candidate."""
    support = filings.filter((F.col("cycle") == cycle) & (F.col("support_oppose_indicator") == "S"))
    day = F.to_date("guidance_first_detected")
    spent = F.sum(F.when(F.col("expenditure_date") >= day, F.col("expenditure_amount")))
    return (
        firsts.select("candidate_id", "guidance_first_detected")
        .join(support.select("candidate_id", "expenditure_date", "expenditure_amount"), "candidate_id", "left")
        .groupBy("candidate_id")
        .agg(F.coalesce(spent, F.lit(0)).cast("decimal(28,2)").alias("supporting_ie_total_after"))
    )


def headline(corroboration: DataFrame) -> DataFrame:
    """Add ``headline`` from the totals and the supporting committees' names."""
    backers = F.filter("spender_list", lambda s: s["indicator"] == "S")
    names = F.array_sort(
        F.array_distinct(
            F.transform(
                backers,
                lambda s: F.coalesce(
                    F.nullif(s["committee_name"], F.lit("")), F.nullif(s["committee_id"], F.lit("")), F.lit("?")
                ),
            )
        )
    )
    total = F.format_number(F.col("supporting_total").cast("double"), 0)
    text = F.concat(
        F.lit("$"),
        total,
        F.lit(" in supporting independent expenditures aligned with this candidate"),
        F.when(F.size(names) > 0, F.concat(F.lit(" from "), F.array_join(names, ", "))).otherwise(""),
    )
    none = "No independent expenditures on file for this candidate yet."
    return corroboration.withColumn("headline", F.when(F.col("ie_filing_count") == 0, none).otherwise(text))
