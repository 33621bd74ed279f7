"""Partition-wise merges: the same rows as whole-table merges, and untouched partitions keep their files."""

import os

import pytest
from pyspark.sql import functions as F

from pagewatch.sources import partitioned as p
from pagewatch.sources.tables import DISCOVERY_COLUMNS, merge_candidates, merge_elections, replace_partition

SCHEMA = "candidate_id string, cycle int, amount double, note string"


def files(path):
    """(folder, file) -> change time of every data file."""
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                found[os.path.relpath(folder, path), name] = os.stat(os.path.join(folder, name)).st_mtime_ns
    return found


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_replace_groups_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "ie")
    old = spark.createDataFrame([(f"C{i % 60}", 2024 + 2 * (i % 2), float(i), None if i % 5 else "n") for i in range(400)], SCHEMA)
    p.write_partitioned(old, path, ["candidate_id", "cycle"], ["cycle"], 8)
    before = files(path)
    new = spark.createDataFrame([("C2", 2024, 1.5, "x"), ("C2", 2024, 2.5, None), ("new", 2026, 3.5, "y")], SCHEMA)
    touched = {f"cycle={r.cycle}/key_bucket={r.b}" for r in new.select("cycle", p.bucket_of(["candidate_id", "cycle"], 8).alias("b")).collect()}
    for _ in range(2):  # a repeated run changes no row
        assert p.replace_groups(spark, path, new, ["candidate_id", "cycle"], ["cycle"], 8) == len(touched) == 2
        assert rows(p.read_partitioned(spark, path)) == rows(replace_partition(old, new, ["candidate_id", "cycle"]))
        after = files(path)
        assert {k: v for k, v in before.items() if k[0] not in touched} == {k: v for k, v in after.items() if k[0] not in touched}
        assert not {k for k in before if k[0] in touched} & {*after} and {k[0] for k in after} >= touched
    assert len({k[0] for k in before}) == 16


def test_only_touched_partitions_are_read(spark, tmp_path):
    path, seen = str(tmp_path / "ie"), []
    old = spark.createDataFrame([(f"C{i}", 2024, float(i), None) for i in range(100)], SCHEMA)
    p.write_partitioned(old, path, ["candidate_id"], (), 8)
    new = spark.createDataFrame([("C7", 2024, 0.0, None)], SCHEMA)

    def merge(existing, fresh):
        seen.append({os.path.basename(os.path.dirname(f)) for f in existing.inputFiles()} | {existing.count()})
        return replace_partition(existing, fresh, ["candidate_id"])

    assert p.rewrite_touched(spark, path, new, merge, ["candidate_id"], (), 8) == 1
    bucket = new.select(p.bucket_of(["candidate_id"], 8)).first()[0]
    own = old.filter(p.bucket_of(["candidate_id"], 8) == bucket).count()
    assert own < 40 and own in seen[0]


def test_nothing_new_and_new_partitions(spark, tmp_path):
    path = str(tmp_path / "ie")
    old = spark.createDataFrame([("a", 2024, 1.0, None)], SCHEMA)
    p.write_partitioned(old, path, ["candidate_id", "cycle"], ["cycle"], 4)
    before = files(path)
    assert p.replace_groups(spark, path, old.limit(0), ["candidate_id", "cycle"], ["cycle"], 4) == 0 and files(path) == before
    late = spark.createDataFrame([("a", 2026, 2.0, None), (None, 2026, 3.0, None)], SCHEMA)
    p.replace_groups(spark, path, late, ["candidate_id", "cycle"], ["cycle"], 4)
    assert rows(p.read_partitioned(spark, path)) == rows(old.unionByName(late))


def test_elections_and_candidates(spark, tmp_path):
    schema = "state string, cycle int, office string, primary_date string"
    old = spark.createDataFrame([(s, c, o, "old") for s in ("TX", "NY", "NJ") for c in (2024, 2026) for o in "HS"], schema)
    new = spark.createDataFrame([("TX", 2026, "H", "new"), ("CA", 2026, "S", "new")], schema)
    path = str(tmp_path / "elections")
    p.write_partitioned(old, path, ["state", "cycle", "office"], ["cycle"], 4)
    before = files(path)
    p.upsert_elections(spark, path, new, 4)
    assert rows(p.read_partitioned(spark, path)) == rows(merge_elections(old, new))
    assert {k for k in before if "cycle=2024" in k[0]} <= {*files(path)}

    columns = ", ".join(f"{c} string" for c in DISCOVERY_COLUMNS)
    people = f"candidate_id string, {columns}, url_source string, created_at timestamp, updated_at timestamp, cycle int, url_verified boolean"
    ts, early = F.lit("2026-05-01").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")
    old = spark.range(30).select(F.concat(F.lit("C"), "id").alias("candidate_id"), *[F.lit("was").alias(c) for c in DISCOVERY_COLUMNS])
    old = old.select("*", F.lit("manual").alias("url_source"), early.alias("created_at"), early.alias("updated_at"), F.lit(2026).alias("cycle"), F.lit(True).alias("url_verified"))
    assert len(old.columns) == len(people.split(", "))
    found = spark.range(28, 33).select(F.concat(F.lit("C"), "id").alias("candidate_id"), *[F.lit("is").alias(c) for c in DISCOVERY_COLUMNS])
    path = str(tmp_path / "candidates")
    p.write_partitioned(old, path, ["candidate_id"], (), 8)
    assert p.upsert_candidates(spark, path, found, ts, 2026, 8) <= 5
    assert rows(p.read_partitioned(spark, path)) == rows(merge_candidates(old, found, ts, 2026))


@pytest.mark.parametrize("broken", [True])
def test_a_failed_merge_leaves_the_table(spark, tmp_path, broken):
    path = str(tmp_path / "ie")
    old = spark.createDataFrame([("a", 2024, 1.0, None)], SCHEMA)
    p.write_partitioned(old, path, ["candidate_id"], (), 4)
    before = files(path)

    def merge(existing, fresh):
        return existing.withColumn("amount", F.raise_error(F.lit("broken")).cast("double"))

    with pytest.raises(Exception, match="broken"):
        p.rewrite_touched(spark, path, old, merge, ["candidate_id"], (), 4)
    assert files(path) == before
