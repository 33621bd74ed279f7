"""Resolve primary nominees and sweep primary losers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.operators.nominees import (
    B, BUCKET, bucket_sizes, crosswalk, exclude_unvoted, flag_losers, latest_call, override_nominees, primary_loser_moves,
    settled_states, shared_ballot, unvoted_races, with_bucket,
)
from pagewatch.session import write_through


def resolve_nominees(
    candidates: DataFrame, overrides: DataFrame, calls: DataFrame | None = None, feed_name: str = "feed"
) -> tuple[DataFrame, DataFrame]:
    """(nominees, unresolved contested buckets).

    Manual call, else the lone funded candidate of a bucket, else the unique
    match of the latest feed call. States with one shared ballot resolve only
    by manual call.
    """
    candidates = write_through(
        with_bucket(candidates).select("candidate_id", "name", *B), "buckets"
    )
    sizes = bucket_sizes(candidates)
    manual = override_nominees(candidates, overrides)
    open_buckets = sizes.join(manual.select(*B), B, "left_anti").filter(~shared_ballot(F.col("b_state")))
    named = with_bucket(candidates).select(*B, "candidate_id", "name")
    lone = (
        open_buckets.filter("members = 1")
        .select(*B, F.col("lone_id").alias("candidate_id"))
        .join(named, [*B, "candidate_id"])
        .select(*B, "candidate_id", "name", F.lit("uncontested").alias("source"), F.lit("high").alias("confidence"))
    )
    nominees = manual.unionByName(lone.withColumn("missing", F.lit(False)))
    if calls is not None:
        contested = open_buckets.filter("members >= 2").select(*[F.col(f"b_{c}").alias(c) for c in BUCKET])
        matched = crosswalk(latest_call(calls).join(contested, BUCKET, "left_semi"), candidates)
        from_feed = (
            matched.filter("candidate_id is not null")
            .select(*[F.col(c).alias(f"b_{c}") for c in BUCKET], "candidate_id")
            .join(named, [*B, "candidate_id"])
            .select(
                *B, "candidate_id", "name",
                F.lit(f"feed:{feed_name}").alias("source"), F.lit("medium").alias("confidence"),
                F.lit(False).alias("missing"),
            )
        )
        nominees = nominees.unionByName(from_feed)
    unresolved = sizes.filter("members >= 2").join(nominees.select(*B), B, "left_anti").select(*B, "members")
    return nominees, unresolved


def sweep_losers(
    candidates: DataFrame,
    elections: DataFrame,
    overrides: DataFrame,
    calls: DataFrame | None,
    failed_states: DataFrame | None,
    cycle: int,
    today: Column,
    ts: Column,
    allow_mass_clear: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(new candidates table, moves) after marking losers of settled primaries.

    Without ``calls`` every state counts as giving no feed information.
    """
    past = settled_states(elections, today).filter("disposition = 'past'").select("state")
    postponed = unvoted_races(elections, today)
    swept = candidates.filter(F.coalesce("inactive", F.lit(0)).isin(0, 3)).join(past, "state", "left_semi")
    nominees = write_through(resolve_nominees(exclude_unvoted(swept, postponed), overrides, calls)[0], "nominees")
    if calls is None:
        silent = past
    else:
        silent = failed_states if failed_states is not None else past.limit(0)
    moves = write_through(
        primary_loser_moves(candidates, nominees, past, silent, postponed, allow_mass_clear), "moves"
    )
    return flag_losers(candidates, moves, nominees, cycle, ts), moves
