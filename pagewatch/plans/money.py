"""Corroborate open positives with outside spending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.operators.money import (
    committee_spend, first_detected, headline, positives_to_corroborate, supporting_after,
)


def corroborate(
    filings: DataFrame, detections: DataFrame, reviews: DataFrame, cycle: int, ts: Column | None = None
) -> DataFrame:
    """One row per candidate with an open positive: totals, after-detection money, spenders."""
    wanted = positives_to_corroborate(detections, reviews)
    mine = filings.join(wanted, "candidate_id", "left_semi")
    firsts = first_detected(detections, reviews)
    spender = F.struct(
        "committee_id", "committee_name", "indicator", "amount", "count", "first_date", "last_date"
    )
    rank = F.struct((-F.col("amount")).alias("a"), "committee_id", "indicator", spender.alias("s"))
    money = lambda ind: F.coalesce(
        F.sum(F.when(F.col("indicator") == ind, F.col("amount"))), F.lit(0)
    ).cast("decimal(28,2)")
    totals = (
        committee_spend(mine, cycle)
        .groupBy("candidate_id")
        .agg(
            money("S").alias("supporting_total"),
            money("O").alias("opposing_total"),
            F.sum("count").alias("ie_filing_count"),
            F.transform(F.sort_array(F.collect_list(rank)), lambda r: r["s"]).alias("spender_list"),
        )
    )
    zero = F.lit(0).cast("decimal(28,2)")
    empty = F.array().cast(totals.schema["spender_list"].dataType)
    return headline(
        firsts.join(totals, "candidate_id", "left")
        .join(supporting_after(mine, firsts, cycle), "candidate_id", "left")
        .select(
            "candidate_id",
            "detection_id",
            "guidance_first_detected",
            "supporting_ie_total_after",
            F.coalesce("supporting_total", zero).alias("supporting_total"),
            F.coalesce("opposing_total", zero).alias("opposing_total"),
            F.coalesce("ie_filing_count", F.lit(0)).alias("ie_filing_count"),
            F.coalesce("spender_list", empty).alias("spender_list"),
            (ts if ts is not None else F.current_timestamp()).alias("computed_at"),
        )
    )
