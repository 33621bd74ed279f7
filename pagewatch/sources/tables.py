"""Table merges. Every function returns the full new content of the table."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.functions.status import POSITIVE_CLASSES, REVIEW_ACTIONS
from pagewatch.operators.ordered import global_rank, latest_per_key
from pagewatch.schemas import WRONG_RACE

DISCOVERY_COLUMNS = (
    "name", "office", "state", "district", "party", "universe_reason", "receipts", "rating", "nominee_source",
)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def list_snapshots(spark: SparkSession, target: str) -> list[str]:
    """Snapshot names under ``target``, oldest first (YYYYMMDD, then YYYYMMDD.2, ...)."""
    jpath, fs = _fs(spark, target)
    if not fs.exists(jpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    found = [n.split("=", 1)[1] for n in names if re.fullmatch(r"snapshot=\d{8}(\.\d+)?", n)]
    return sorted(found, key=lambda n: (n[:8], int(n[9:] or 1)))


def guarded_snapshot_replace(
    df: DataFrame, target: str, min_rows: int = 1000, stamp: str | None = None
) -> str:
    """Publish ``df`` as the newest snapshot, or raise and leave the old one in place.

    The rows are staged and counted first; earlier snapshots are never touched.
    """
    spark = df.sparkSession
    staging = f"{target}/_staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    staged, fs = _fs(spark, staging)
    rows = spark.read.parquet(staging).count()
    if rows < min_rows:
        fs.delete(staged, True)
        raise ValueError(f"new snapshot has only {rows} rows, need {min_rows}; keeping the old one")
    day = stamp or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d")
    taken = {n for n in list_snapshots(spark, target)}
    name, n = day, 1
    while name in taken:
        n += 1
        name = f"{day}.{n}"
    final, _ = _fs(spark, f"{target}/snapshot={name}")
    if not fs.rename(staged, final):
        raise OSError(f"could not publish snapshot {name}")
    return name


def read_latest_snapshot(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/snapshot={list_snapshots(spark, target)[-1]}")


def merge_candidates(existing: DataFrame, entries: DataFrame, ts: Column, cycle: int) -> DataFrame:
    """Upsert discovery output; URL, calendar, activity and creation columns stay with the row."""
    new = entries.select("candidate_id", *[F.col(c).alias(f"n_{c}") for c in DISCOVERY_COLUMNS]).withColumn(
        "_new", F.lit(True)
    )
    old = existing.withColumn("_old", F.lit(True))
    both = old.join(new, "candidate_id", "full_outer")
    seen, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    columns = []
    for c in existing.columns:
        if c == "candidate_id":
            columns.append(F.col(c))
        elif c in DISCOVERY_COLUMNS:
            columns.append(F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            columns.append(F.when(fresh, ts).otherwise(F.col(c)).alias(c))
        else:
            first = {
                "cycle": F.lit(cycle),
                "url_source": F.lit("none"),
                "url_verified": F.lit(False),
                "created_at": ts,
            }.get(c, F.lit(None))
            columns.append(F.when(seen, F.col(c)).otherwise(first).alias(c))
    return both.select(*columns)


def merge_elections(existing: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["state", "cycle", "office"]
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_partition(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the groups ``new`` covers, then insert it: re-runs change nothing."""
    covered = new.select(*keys).distinct()
    return existing.join(covered, list(keys), "left_anti").unionByName(new)


def dedupe_ie(df: DataFrame, order: str = "seq") -> DataFrame:
    """First arrival per (transaction_id, committee_id); a NULL key never collides."""
    keyed = F.col("transaction_id").isNotNull() & F.col("committee_id").isNotNull()
    first = latest_per_key(df.filter(keyed), ["transaction_id", "committee_id"], [F.col(order).asc()])
    return first.unionByName(df.filter(~keyed))


def append_reviews(
    reviews: DataFrame, decisions: DataFrame, detections: DataFrame, scans: DataFrame, ts: Column
) -> tuple[DataFrame, DataFrame]:
    """(new review rows, refused decisions) for (detection_id, action, reviewer, notes, group) decisions.

    A grouped decision reaches every positive detection of the same candidate
    with the same page body. A decision is refused, with its ``reason``, if its action
    or its detection is unknown or the detection is not a positive one.
    """
    positive = detections.filter(F.col("classification").isin(*POSITIVE_CLASSES)).join(
        scans.select("scan_id", "text_hash"), "scan_id"
    ).select("detection_id", "candidate_id", "text_hash")
    classes = detections.select("detection_id", F.col("classification").alias("_class"))
    reason = (
        F.when(~F.coalesce(F.col("action").isin(*REVIEW_ACTIONS), F.lit(False)), "unknown action")
        .when(F.col("_class").isNull(), "unknown detection")
        .when(~F.col("_class").isin(*POSITIVE_CLASSES), "not a positive detection")
    )
    judged = decisions.join(classes, "detection_id", "left").withColumn("reason", reason).drop("_class")
    refused = judged.filter("reason is not null")
    valid = judged.filter("reason is null").drop("reason")
    payload = ["action", "reviewer", "notes"]
    direct = valid.select("detection_id", *payload, F.col("detection_id").alias("asked"))
    asked = valid.filter("group").join(positive, "detection_id").select(
        "candidate_id", "text_hash", F.col("detection_id").alias("asked"), *payload
    )
    fanned = (
        asked.join(positive, ["candidate_id", "text_hash"])
        .filter("detection_id <> asked")
        .select("detection_id", *payload, "asked")
    )
    rows = direct.unionByName(fanned).withColumn("reviewed_at", ts)
    last_id = reviews.agg(F.coalesce(F.max("review_id"), F.lit(0)).alias("m"))
    numbered = global_rank(rows, [F.col("detection_id"), F.col("asked")], "_n")
    new = numbered.select(
        (F.col("_n") + last_id.scalar()).alias("review_id"),
        "detection_id",
        "reviewer",
        "action",
        "notes",
        "reviewed_at",
    )
    return new, refused


def apply_triage(candidates: DataFrame, triage_log: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, refused calls): apply the last human URL call per candidate.

    ``triage_log``: candidate_id, seq, outcome (found / human_none / wrong_race), url.
    A call with another outcome, or for an unknown candidate, is refused with its ``reason``
    and changes nothing.
    """
    known = F.coalesce(F.col("outcome").isin("found", "human_none", "wrong_race"), F.lit(False))
    there = candidates.select("candidate_id").distinct().withColumn("_there", F.lit(True))
    reason = F.when(~known, "unknown outcome").when(F.col("_there").isNull(), "unknown candidate")
    judged = triage_log.join(there, "candidate_id", "left").withColumn("reason", reason).drop("_there")
    refused = judged.filter("reason is not null")
    calls = latest_per_key(triage_log.filter(known), ["candidate_id"], [F.col("seq").desc()]).select(
        "candidate_id", F.col("outcome").alias("_outcome"), F.col("url").alias("_url")
    )
    found, none, wrong = (F.col("_outcome") == x for x in ("found", "human_none", "wrong_race"))
    joined = candidates.join(calls, "candidate_id", "left")
    changes = {
        "website_url": F.when(found, F.col("_url")).otherwise(F.col("website_url")),
        "url_source": F.when(found, "manual").when(none, "human_none").otherwise(F.col("url_source")),
        "url_verified": F.when(found, True).otherwise(F.col("url_verified")),
        "scan_status": F.when(found, None).otherwise(F.col("scan_status")),
        "inactive": F.when(wrong, WRONG_RACE).otherwise(F.col("inactive")),
        "updated_at": F.when(F.col("_outcome").isNotNull(), ts).otherwise(F.col("updated_at")),
    }
    updated = joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in candidates.columns])
    return updated, refused
