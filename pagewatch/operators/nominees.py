"""Primary winners: feed calls, overrides, crosswalk, primary losers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.politics import feed_name_parts, first_name_rank, names_match, norm_district, norm_party
from pagewatch.operators.ordered import latest_per_key
from pagewatch.schemas import LOST_PRIMARY

# States where everyone shares one primary ballot.
SHARED_BALLOT_STATES = ("AK", "CA", "WA")

BUCKET = ["office", "state", "district", "party"]


def with_bucket(candidates: DataFrame) -> DataFrame:
    """Add b_office, b_state, b_district, b_party: the nominee bucket."""
    if "b_party" in candidates.columns:
        return candidates
    return candidates.withColumns(
        {
            "b_office": F.coalesce("office", F.lit("")),
            "b_state": F.upper(F.coalesce("state", F.lit(""))),
            "b_district": norm_district(F.col("office"), F.col("district")),
            "b_party": norm_party(F.col("party")),
        }
    )


B = [f"b_{c}" for c in BUCKET]


def bucket_key(prefix: str = "b_") -> Column:
    return F.concat_ws("-", *[F.col(prefix + c) for c in BUCKET])


def latest_call(calls: DataFrame) -> DataFrame:
    """Latest-dated call per bucket; the first of equal dates stays."""
    order = [F.coalesce("election_date", F.lit("")).desc(), F.col("seq").asc()]
    return latest_per_key(calls, BUCKET, order)


def crosswalk(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add ``candidate_id`` of the unique best name match in the call's bucket, else NULL.

    ``calls`` holds one call per bucket, so each candidate meets one call; the
    best rank, its row count and its id come from one aggregate.
    """
    pool = with_bucket(candidates).select(*B, "candidate_id", F.col("name").alias("filed_name"))
    called = calls.select(*[F.col(c).alias(f"b_{c}") for c in BUCKET], "winner_name")
    rank = first_name_rank(F.col("filed_name"), feed_name_parts(F.col("winner_name"))["first"])
    hits = (
        called.join(pool, B)
        .filter(names_match(F.col("filed_name"), F.col("winner_name")))
        .withColumn("rank", rank)
        .groupBy(*B)
        .agg(
            *[F.count_if(F.col("rank") == r).alias(f"n{r}") for r in range(4)],
            *[F.max(F.when(F.col("rank") == r, F.col("candidate_id"))).alias(f"c{r}") for r in range(4)],
        )
    )
    best = F.lit(None).cast("string")
    for r in range(4):  # the highest non-empty rank is applied last
        best = F.when(F.col(f"n{r}") == 1, F.col(f"c{r}")).when(F.col(f"n{r}") > 1, F.lit(None)).otherwise(best)
    resolved = hits.select(*[F.col(f"b_{c}").alias(c) for c in BUCKET], best.alias("candidate_id"))
    return calls.join(resolved, BUCKET, "left")


def crosswalk_rate(matched: DataFrame) -> DataFrame:
    """One row: calls, matched, unmatched, pct."""
    hit = F.count_if(F.col("candidate_id").isNotNull())
    return matched.agg(
        F.count("*").alias("calls"),
        hit.alias("matched"),
        (F.count("*") - hit).alias("unmatched"),
        F.round(100.0 * hit / F.count("*"), 0).alias("pct"),
    )


def bucket_sizes(candidates: DataFrame) -> DataFrame:
    return with_bucket(candidates).groupBy(*B).agg(
        F.count("*").alias("members"), F.max("candidate_id").alias("lone_id")
    )


def override_nominees(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual calls of buckets that have members.

    ``overrides``: key 'H-TX-1-DEM', candidate_id, name. An id outside the
    bucket's members is kept and flagged ``missing``.
    """
    members = with_bucket(candidates).select(*B, "candidate_id", F.col("name").alias("member_name"))
    calls = overrides.filter(F.coalesce("candidate_id", F.lit("")) != "")
    return (
        bucket_sizes(candidates)
        .withColumn("key", bucket_key())
        .join(calls, "key")
        .join(members, [*B, "candidate_id"], "left")
        .select(
            *B,
            "candidate_id",
            F.when(F.col("member_name").isNotNull(), F.col("member_name"))
            .otherwise(F.coalesce("name", F.lit("")))
            .alias("name"),
            F.lit("manual").alias("source"),
            F.lit("verified").alias("confidence"),
            F.col("member_name").isNull().alias("missing"),
        )
    )


def exclude_unvoted(candidates: DataFrame, postponed: DataFrame) -> DataFrame:
    """Drop candidates of races that have not voted; a NULL district means the whole office."""
    p = postponed.select(
        F.col("office").alias("p_office"), F.upper("state").alias("p_state"), F.col("district").alias("p_district")
    )
    whole = p.filter("p_district is null")
    single = p.filter("p_district is not null")
    c = candidates
    left = c.join(
        whole, (c.office == whole.p_office) & (F.upper(c.state) == whole.p_state), "left_anti"
    )
    return left.join(
        single,
        (left.office == single.p_office)
        & (F.upper(left.state) == single.p_state)
        & (left.district == single.p_district),
        "left_anti",
    )


def settled_states(elections: DataFrame, today: Column) -> DataFrame:
    """(state, disposition): 'past' after the last deciding round, 'held' between rounds."""
    statewide = elections.filter((F.col("office") == "") & F.col("primary_date").isNotNull())
    settled = F.greatest("primary_date", "runoff_date")
    disposition = F.when(settled < today, "past").when(F.col("primary_date") < today, "held")
    return statewide.select("state", disposition.alias("disposition")).filter("disposition is not null")


def unvoted_races(elections: DataFrame, today: Column) -> DataFrame:
    """(office, state, district or NULL) of moved races that have not voted yet."""
    moved = elections.filter((F.col("office") != "") & (F.col("primary_date").isNull() | (F.col("primary_date") >= today)))
    return moved.select(
        F.substring_index("office", ":", 1).alias("office"),
        "state",
        F.when(F.contains("office", F.lit(":")), F.substring_index("office", ":", -1)).alias("district"),
    )


def mass_clear_guard(clears: DataFrame, marked: DataFrame, allow: bool = False) -> DataFrame:
    """(state, n_clear, n_marked, refused): too many clears in one state are refused."""
    per_state = clears.groupBy("state").agg(F.count("*").alias("n_clear")).join(
        marked.groupBy("state").agg(F.count("*").alias("n_marked")), "state", "left"
    )
    n_marked = F.coalesce("n_marked", F.lit(0))
    limit = F.greatest(F.lit(5.0), n_marked * 0.2)
    return per_state.select(
        "state", "n_clear", n_marked.alias("n_marked"), ((F.col("n_clear") > limit) & F.lit(not allow)).alias("refused")
    )


def primary_loser_moves(
    candidates: DataFrame,
    nominees: DataFrame,
    states: DataFrame,
    no_feed_info: DataFrame,
    postponed: DataFrame,
    allow_mass_clear: bool = False,
) -> DataFrame:
    """(candidate_id, move) with move lost / clear / refused for the swept states.

    ``nominees``: b_* bucket and candidate_id; ``states``: past states;
    ``no_feed_info``: states whose feed said nothing usable.
    """
    swept = states.select(F.upper("state").alias("b_state")).filter(~F.col("b_state").isin(*SHARED_BALLOT_STATES))
    rows = with_bucket(exclude_unvoted(candidates, postponed)).filter(
        F.coalesce("inactive", F.lit(0)).isin(0, LOST_PRIMARY)
    ).join(swept.distinct(), "b_state", "left_semi")
    resolved = nominees.select(*B).distinct().withColumn("resolved", F.lit(True))
    winners = nominees.select("candidate_id").distinct().withColumn("winner", F.lit(True))
    silent = no_feed_info.select(F.upper("state").alias("b_state")).distinct().withColumn("silent", F.lit(True))
    seen = rows.join(resolved, B, "left").join(winners, "candidate_id", "left").join(silent, "b_state", "left")
    marked = F.coalesce(F.col("inactive") == LOST_PRIMARY, F.lit(False))
    is_loser = F.col("resolved").isNotNull() & F.col("winner").isNull()
    move = F.when(is_loser, F.when(~marked, "lost")).when(
        marked & (F.col("resolved").isNotNull() | F.col("silent").isNull()), "clear"
    )
    moves = seen.select("candidate_id", F.col("b_state").alias("state"), move.alias("move"), marked.alias("marked"))
    guard = mass_clear_guard(
        moves.filter("move = 'clear'"), moves.filter("marked"), allow_mass_clear
    ).select("state", "refused")
    return (
        moves.filter("move is not null")
        .join(guard, "state", "left")
        .select(
            "candidate_id",
            "state",
            F.when((F.col("move") == "clear") & F.col("refused"), "refused").otherwise(F.col("move")).alias("move"),
        )
    )


def flag_losers(
    candidates: DataFrame, moves: DataFrame, nominees: DataFrame, cycle: int, ts: Column
) -> DataFrame:
    """Candidates with the moves applied and missing manual nominees inserted."""
    joined = candidates.join(moves.select("candidate_id", "move"), "candidate_id", "left")
    lost, clear = F.coalesce(F.col("move") == "lost", F.lit(False)), F.coalesce(F.col("move") == "clear", F.lit(False))
    updated = joined.withColumns(
        {
            "inactive": F.when(lost, LOST_PRIMARY).when(clear, F.lit(None)).otherwise(F.col("inactive")),
            "updated_at": F.when(lost | clear, ts).otherwise(F.col("updated_at")),
        }
    ).select(*candidates.columns)
    inserted = (
        nominees.filter("source = 'manual'")
        .join(candidates.select("candidate_id"), "candidate_id", "left_anti")
        .select(
            "candidate_id",
            "name",
            *[F.col(f"b_{c}").alias(c) for c in BUCKET],
            F.lit(cycle).alias("cycle"),
            F.lit("nominee").alias("universe_reason"),
            F.lit("none").alias("url_source"),
            F.lit(False).alias("url_verified"),
            F.lit("manual").alias("nominee_source"),
            ts.alias("created_at"),
            ts.alias("updated_at"),
        )
    )
    return updated.unionByName(inserted.select(*[c for c in inserted.columns if c in candidates.columns]), True)


def sync_inactive(candidates: DataFrame, fec_inactive: DataFrame, ts: Column) -> DataFrame:
    """Refresh the filing-office flag (0 <-> 1); human and lost-primary marks stay."""
    hit = F.col("_listed").isNotNull()
    state = F.coalesce("inactive", F.lit(0))
    flag, clear = (state == 0) & hit, (state == 1) & ~hit
    joined = candidates.join(
        fec_inactive.select("candidate_id").distinct().withColumn("_listed", F.lit(True)), "candidate_id", "left"
    )
    return joined.withColumns(
        {
            "inactive": F.when(flag, 1).when(clear, F.lit(None)).otherwise(F.col("inactive")),
            "updated_at": F.when(flag | clear, ts).otherwise(F.col("updated_at")),
        }
    ).select(*candidates.columns)


def resolver_counts(nominees: DataFrame) -> DataFrame:
    return nominees.groupBy(F.substring_index("source", ":", 1).alias("source")).agg(F.count("*").alias("n"))


def shared_ballot(state: Column, states: Sequence[str] = SHARED_BALLOT_STATES) -> Column:
    return state.isin(*states)
