"""Who is in scope: funding gates, contested races, overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.politics import id_matches_geo, norm_party, norm_rating, person_surname
from pagewatch.operators.ordered import latest_per_key

COMPETITIVE_RATINGS = ("Toss-up", "Tilt", "Lean")
RACE = ["office", "state", "district"]
BUCKET = [*RACE, "party_norm"]


def is_incumbent() -> Column:
    return F.upper(F.coalesce("incumbent_challenge", F.lit(""))) == "I"


def funded(
    candidates: DataFrame,
    floor: float = 50_000,
    offices: Sequence[str] | None = None,
    states: Sequence[str] | None = None,
    district: str | None = None,
    keep_incumbents: bool = True,
) -> DataFrame:
    keep = F.col("receipts") >= floor
    if keep_incumbents:
        keep = keep | (F.col("incumbent_challenge") == "I")
    out = candidates.filter(keep)
    if offices:
        out = out.filter(F.col("office").isin(*offices))
    if states:
        out = out.filter(F.col("state").isin(*[s.upper() for s in states]))
    if district:
        out = out.filter(F.col("district") == district)
    return out


def on_ballot(candidates: DataFrame, year: int) -> DataFrame:
    """Presidential records count only in presidential years."""
    if year % 4 == 0:
        return candidates
    return candidates.filter(F.upper(F.coalesce("office", F.lit(""))) != "P")


def drop_inactive(candidates: DataFrame, inactive: DataFrame | None) -> DataFrame:
    """Remove withdrawn ids; no lookup means keep everything."""
    if inactive is None:
        return candidates
    return candidates.join(inactive.select("candidate_id"), "candidate_id", "left_anti")


def dedupe_people(candidates: DataFrame) -> DataFrame:
    """One row per person: same surname, race, party and receipts to the cent."""
    keyed = candidates.withColumns(
        {
            "_surname": person_surname(F.col("name")),
            "_party": norm_party(F.col("party")),
            "_cents": F.round("receipts", 2),
            "_geo": id_matches_geo(*[F.col(c) for c in ("candidate_id", "office", "state", "district")]),
            "_o": F.coalesce("office", F.lit("")),
            "_s": F.coalesce("state", F.lit("")),
            "_d": F.coalesce("district", F.lit("")),
        }
    )
    keys = ["_surname", "_o", "_s", "_d", "_party", "_cents"]
    order = [is_incumbent().desc(), F.col("_geo").desc(), F.col("candidate_id").desc()]
    return latest_per_key(keyed, keys, order).select(*candidates.columns)


def with_race_keys(candidates: DataFrame) -> DataFrame:
    """Keys as discovery groups them: raw district, folded party."""
    return candidates.withColumns(
        {
            "office": F.coalesce("office", F.lit("")),
            "state": F.coalesce("state", F.lit("")),
            "district": F.coalesce("district", F.lit("")),
            "party_norm": norm_party(F.col("party")),
        }
    )


def with_race_counts(candidates: DataFrame, general_floor: float = 100_000) -> DataFrame:
    """Add bucket_size, general_size and general_parties from two small aggregates."""
    keyed = with_race_keys(candidates)
    buckets = keyed.groupBy(*BUCKET).agg(F.count("*").alias("bucket_size"))
    races = (
        keyed.filter(F.col("receipts") >= general_floor)
        .groupBy(*BUCKET)
        .agg(F.count("*").alias("n"))
        .groupBy(*RACE)
        .agg(F.sum("n").alias("general_size"), F.count("*").alias("general_parties"))
    )
    return keyed.join(buckets, BUCKET).join(races, RACE, "left")


def _contested_general(general_floor: float) -> Column:
    if not general_floor:
        return F.lit(False)
    enough = (F.col("general_size") >= 2) & (F.col("general_parties") >= 2)
    return F.coalesce((F.col("receipts") >= general_floor) & enough, F.lit(False))


def contested_primaries(candidates: DataFrame) -> DataFrame:
    return with_race_counts(candidates).filter("bucket_size >= 2").select("candidate_id")


def contested_generals(candidates: DataFrame, floor: float = 100_000) -> DataFrame:
    if not floor:
        return candidates.select("candidate_id").limit(0)
    return with_race_counts(candidates, floor).filter(_contested_general(floor)).select("candidate_id")


def incumbents(candidates: DataFrame) -> DataFrame:
    return candidates.filter(is_incumbent()).select("candidate_id")


def presumptive_nominees(candidates: DataFrame, floor: float = 50_000) -> DataFrame:
    lone = (F.col("bucket_size") == 1) & (F.col("receipts") >= floor)
    return with_race_counts(candidates).filter(lone).select("candidate_id")


def competitive_districts(ratings: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One rating per (office, state, district); a null district also covers '00'.

    Later rating rows win, so ``ratings`` carries its row order in ``seq``.
    """
    levels = [norm_rating(F.lit(k)) for k in (keep or COMPETITIVE_RATINGS)]
    kept = ratings.filter(norm_rating(F.col("rating")).isin(*levels))
    slots = F.when(F.col("district").isNull(), F.array(F.lit(""), F.lit("00"))).otherwise(F.array("district"))
    rows = kept.select("office", "state", F.explode(slots).alias("district"), "rating", "seq")
    return rows.groupBy(*RACE).agg(F.max_by("rating", "seq").alias("rating"))


def competitive_overlay(candidates: DataFrame, ratings: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Add ``competitive_rating`` (NULL outside competitive districts)."""
    rated = competitive_districts(ratings, keep).withColumnRenamed("rating", "competitive_rating")
    return with_race_keys(candidates).join(rated, RACE, "left")


def union_reasons(flags: dict[str, Column]) -> Column:
    """Set of the reasons whose condition holds."""
    return F.filter(
        F.array(*[F.when(cond, F.lit(reason)) for reason, cond in flags.items()]), lambda r: r.isNotNull()
    )


def race_phase(candidates: DataFrame, primary_dates: DataFrame, today: Column) -> DataFrame:
    """Add ``phase``: 'general' once the race's own primary is strictly past.

    ``primary_dates``: (state, office, primary_date), office '' / 'H' / 'H:01'.
    The most specific row decides even when its date is missing.
    """
    out = candidates
    for level, key in (("_a", F.concat_ws(":", "office", "district")), ("_b", F.col("office")), ("_c", F.lit(""))):
        rows = primary_dates.select(
            F.col("state").alias(f"{level}s"), F.col("office").alias(f"{level}o"), F.col("primary_date").alias(level)
        )
        out = out.withColumn(f"{level}k", key).join(
            rows, (F.upper("state") == F.col(f"{level}s")) & (F.col(f"{level}k") == F.col(f"{level}o")), "left"
        )
    decided = (
        F.when(F.col("_ao").isNotNull(), F.col("_a"))
        .when(F.col("_bo").isNotNull(), F.col("_b"))
        .otherwise(F.col("_c"))
    )
    phase = F.when(F.coalesce(today > decided, F.lit(False)), "general").otherwise("primary")
    return out.withColumn("phase", phase).drop(*[f"{x}{y}" for x in ("_a", "_b", "_c") for y in ("", "s", "o", "k")])


def orphans(
    existing: DataFrame,
    produced: DataFrame,
    cycle: int,
    offices: Sequence[str] | None = None,
    states: Sequence[str] | None = None,
    district: str | None = None,
) -> DataFrame:
    """Active rows of this run's scope that the run did not produce."""
    scope = existing.filter((F.coalesce("inactive", F.lit(0)) == 0) & (F.col("cycle") == cycle))
    if offices:
        scope = scope.filter(F.col("office").isin(*offices))
    if states:
        scope = scope.filter(F.col("state").isin(*states))
    if district:
        scope = scope.filter(F.col("district") == district)
    return scope.join(produced.select("candidate_id"), "candidate_id", "left_anti").select(
        "candidate_id", "name", "office", "state", "district"
    )


def disposition_counts(universe: DataFrame) -> DataFrame:
    """(kind, label, n) for reason labels and nominee sources (prefix before ':')."""
    pairs = F.array(
        F.struct(F.lit("reason").alias("kind"), F.col("universe_reason").alias("label")),
        F.struct(
            F.lit("nominee_source").alias("kind"), F.substring_index("nominee_source", ":", 1).alias("label")
        ),
    )
    return (
        universe.select(F.inline(pairs)).filter("label is not null").groupBy("kind", "label").agg(
            F.count("*").alias("n")
        )
    )
