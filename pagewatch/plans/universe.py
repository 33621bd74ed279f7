"""Build the candidate universe of a scan mode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.politics import reason_label
from pagewatch.operators.ordered import latest_per_key
from pagewatch.operators.universe import (
    RACE, competitive_districts, dedupe_people, drop_inactive, funded, is_incumbent, on_ballot, race_phase,
    union_reasons, with_race_counts,
)
from pagewatch.session import write_through


@dataclass(frozen=True)
class UniverseConfig:
    cycle: int = 2026
    receipts_floor: float = 50_000
    general_floor: float = 100_000
    include_incumbents: bool = True
    include_funded_nominees: bool = True
    keep_ratings: Sequence[str] = ()
    offices: Sequence[str] | None = None
    states: Sequence[str] | None = None
    district: str | None = None


def funded_pool(candidates: DataFrame, config: UniverseConfig, inactive: DataFrame | None = None) -> DataFrame:
    """Funded, deduplicated, active, on-ballot candidates."""
    pool = funded(
        candidates, config.receipts_floor, config.offices, config.states, config.district, config.include_incumbents
    )
    return on_ballot(drop_inactive(dedupe_people(pool), inactive), config.cycle)


def build_universe(
    candidates: DataFrame,
    config: UniverseConfig = UniverseConfig(),
    mode: str = "primary",
    ratings: DataFrame | None = None,
    nominees: DataFrame | None = None,
    primary_dates: DataFrame | None = None,
    today: Column | None = None,
    inactive: DataFrame | None = None,
) -> DataFrame:
    """One row per candidate in scope with its reasons, label, rating and nominee source.

    ``mode``: 'primary', 'general' or 'full' (each race by its own phase).
    ``nominees``: candidate_id, source.
    """
    pool = write_through(funded_pool(candidates, config, inactive), "funded")
    rows = with_race_counts(pool, config.general_floor)
    if ratings is None:
        rows = rows.withColumn("competitive", F.lit(None).cast("string"))
    else:
        rated = competitive_districts(ratings, config.keep_ratings).withColumnRenamed("rating", "competitive")
        rows = rows.join(rated, RACE, "left")
    if nominees is None or mode == "primary":
        rows = rows.withColumn("nominee", F.lit(None).cast("string"))
    else:
        called = latest_per_key(
            nominees.select("candidate_id", F.col("source").alias("nominee")), ["candidate_id"], [F.col("nominee")]
        )
        rows = rows.join(called, "candidate_id", "left")

    post_primary = F.lit(mode == "general")
    if mode == "full":
        if primary_dates is None or today is None:
            post_primary = F.lit(False)
        else:
            rows = race_phase(rows, primary_dates, today)
            post_primary = F.col("phase") == "general"

    at_floor = F.col("receipts") >= config.receipts_floor
    general = F.lit(False)
    if config.general_floor:
        general = (
            (F.col("receipts") >= config.general_floor)
            & (F.coalesce("general_size", F.lit(0)) >= 2)
            & (F.coalesce("general_parties", F.lit(0)) >= 2)
        )
    reasons = union_reasons(
        {
            "nominee": post_primary & F.col("nominee").isNotNull(),
            "contested_primary": ~post_primary & (F.col("bucket_size") >= 2),
            "contested_general": ~post_primary & general,
            "competitive_general": ~post_primary & F.col("competitive").isNotNull(),
            "incumbent": is_incumbent() & F.lit(config.include_incumbents),
            "funded_nominee": (F.col("bucket_size") == 1) & at_floor & F.lit(config.include_funded_nominees),
        }
    )
    has = lambda r: F.array_contains("reasons", r)
    return (
        rows.withColumn("reasons", reasons)
        .filter(F.size("reasons") > 0)
        .select(
            "candidate_id",
            "name",
            "office",
            "state",
            "district",
            "party",
            "receipts",
            F.lit(config.cycle).alias("cycle"),
            reason_label(F.col("reasons")).alias("universe_reason"),
            F.when(has("competitive_general"), F.col("competitive")).alias("rating"),
            F.when(has("nominee"), F.col("nominee")).alias("nominee_source"),
        )
    )
