"""Universe, nominee, source and merge cases on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewatch.operators.nominees import mass_clear_guard, settled_states, unvoted_races
from pagewatch.operators.schedule import lookup_primary_date
from pagewatch.operators.universe import dedupe_people
from pagewatch.plans.nominees import resolve_nominees, sweep_losers
from pagewatch.plans.universe import UniverseConfig, build_universe
from pagewatch.sources import readers, tables

CAND = "candidate_id string, name string, office string, state string, district string, party string, receipts double, incumbent_challenge string"


def cands(spark, *rows):
    return spark.createDataFrame(rows, CAND)


def test_read_candidate_summary(spark, tmp_path):
    def line(*head, state="nc", district="04"):
        cells = [*head] + ["x"] * 30
        cells[18], cells[19] = state, district
        return "|".join(cells[:30])

    text = "\n".join(
        [
            line("H4NC04001", 'MUÑOZ, "ANA"', "I", "x", "DEM", "1500.55"),
            "",
            "short|row",
            line("S6TX00001", "ROE, RICK", "C", "x", "REP", "n/a", state="TX", district=""),
            line("", "NOBODY", "C", "x", "REP", "1"),
        ]
    )
    path = tmp_path / "webl.txt"
    path.write_bytes(text.encode("latin-1"))
    got = {r["candidate_id"]: r for r in readers.read_candidate_summary(spark, str(path)).collect()}
    assert set(got) == {"H4NC04001", "S6TX00001"}
    ana = got["H4NC04001"]
    assert (ana["name"], ana["office"], ana["state"], float(ana["receipts"])) == ('MUÑOZ, "ANA"', "H", "NC", 1500.55)
    assert (got["S6TX00001"]["district"], float(got["S6TX00001"]["receipts"])) == ("00", 0.0)


def test_missing_ratings_are_empty(spark, tmp_path):
    assert readers.read_ratings(spark, str(tmp_path / "none.json")).count() == 0


def test_snapshot_guard(spark, tmp_path):
    target = str(tmp_path / "snap")
    df = spark.range(5)
    assert tables.guarded_snapshot_replace(df, target, 5, "20260601") == "20260601"
    assert tables.guarded_snapshot_replace(spark.range(9), target, 5, "20260601") == "20260601.2"
    with pytest.raises(ValueError):
        tables.guarded_snapshot_replace(spark.range(2), target, 5, "20260602")
    assert tables.list_snapshots(spark, target) == ["20260601", "20260601.2"]
    assert tables.read_latest_snapshot(spark, target).count() == 9


def test_dedupe_prefers_incumbent_then_geography(spark):
    df = cands(
        spark,
        ("H2OH07311", "KESTREL, WREN FOR JR.", "H", "OH", "05", "REP", 900000.0, "C"),
        ("H0OH05127", "KESTREL JR, WREN OTTO", "H", "OH", "05", "REP", 900000.0, "I"),
        ("H2IL04455", "PARDO, INES Q", "H", "IL", "04", "REP", 5e5, "C"),
        ("H0IL09318", "PARDO, INES Q", "H", "IL", "04", "REP", 5e5, "C"),
        ("H8IL04702", "PARDO, LEV", "H", "IL", "04", "REP", 5e5 + 0.01, "C"),
    )
    assert {r[0] for r in dedupe_people(df).select("candidate_id").collect()} == {"H0OH05127", "H2IL04455", "H8IL04702"}


def test_universe_party_folding_and_midterm_gate(spark):
    df = cands(
        spark,
        ("H1MN01001", "A, A", "H", "MN", "01", "DFL", 60000.0, "C"),
        ("H1MN01002", "B, B", "H", "MN", "01", "DEM", 70000.0, "C"),
        ("H1MN02001", "C, C", "H", "MN", "02", "REP", 40000.0, "I"),
        ("H1MN02002", "D, D", "H", "MN", "02", "REP", 49999.99, "C"),
        ("P00000001", "E, E", "P", "US", "00", "REP", 9e6, "C"),
        ("P00000002", "F, F", "P", "US", "00", "REP", 9e6, "C"),
    )
    got = {r["candidate_id"]: r["universe_reason"] for r in build_universe(df).collect()}
    assert got == {"H1MN01001": "contested_primary", "H1MN01002": "contested_primary", "H1MN02001": "incumbent"}
    presidential = build_universe(df, UniverseConfig(cycle=2028))
    assert presidential.filter("office = 'P'").count() == 2


def test_resolve_nominees_layers(spark):
    df = cands(
        spark,
        ("N1", "LINDQUIST, ARNE", "H", "TX", "22", "REP", 1.0, "C"),
        ("N2", "LINDQUIST, ANSEL", "H", "TX", "22", "REP", 1.0, "C"),
        ("L1", "LONE, ANN", "H", "TX", "01", "DEM", 1.0, "C"),
        ("W1", "LONE, IND", "H", "WA", "01", "IND", 1.0, "C"),
        ("X1", "DOE, JOHN", "S", "TX", "00", "DEM", 1.0, "C"),
        ("X2", "DOE, JAMES", "S", "TX", "00", "DEM", 1.0, "C"),
        ("M1", "ROE, A", "H", "TX", "02", "REP", 1.0, "C"),
        ("M2", "ROE, B", "H", "TX", "02", "REP", 1.0, "C"),
    )
    overrides = spark.createDataFrame([("H-TX-2-REP", "Z9", "New Person")], "key string, candidate_id string, name string")
    calls = spark.createDataFrame(
        [
            (1, "TX", "H", "22", "REP", "Ansel Lindquist", "feed", "2026-03-03"),
            (2, "TX", "H", "22", "REP", "Arne Lindquist", "feed", "2026-05-26"),
            (3, "TX", "S", "0", "DEM", "J. Doe", "feed", "2026-03-03"),
        ],
        "seq int, state string, office string, district string, party string, winner_name string, source string, election_date string",
    )
    nominees, unresolved = resolve_nominees(df, overrides, calls)
    got = {r["candidate_id"]: (r["source"], r["missing"]) for r in nominees.collect()}
    assert got == {"N1": ("feed:feed", False), "L1": ("uncontested", False), "Z9": ("manual", True)}
    assert {(r["b_office"], r["b_district"]) for r in unresolved.collect()} == {("S", "0")}


def elections(spark, *rows):
    return spark.createDataFrame(
        rows, "state string, cycle int, office string, primary_date date, filing_deadline date, runoff_date date"
    )


def day(text):
    return dt.date.fromisoformat(text)


def test_settled_states_and_postponed_races(spark):
    e = elections(
        spark,
        ("AL", 2026, "", day("2026-05-19"), None, day("2026-06-16")),
        ("AL", 2026, "H:01", day("2026-08-11"), None, None),
        ("TX", 2026, "", day("2026-03-03"), None, day("2026-05-26")),
        ("LA", 2026, "H", day("2026-11-03"), None, None),
    )
    today = F.lit("2026-06-01").cast("date")
    assert {tuple(r) for r in settled_states(e, today).collect()} == {("AL", "held"), ("TX", "past")}
    assert {tuple(r) for r in unvoted_races(e, today).collect()} == {("H", "AL", "01"), ("H", "LA", None)}


def test_lookup_falls_through_and_keeps_old_dates(spark):
    e = elections(
        spark,
        ("AL", 2026, "", day("2026-05-19"), None, None),
        ("AL", 2026, "H", None, None, None),
        ("AL", 2026, "H:01", day("2026-08-11"), None, None),
    )
    rows = [("a", "AL", "H", "01", 2026, None), ("b", "AL", "H", "02", 2026, None), ("c", "ZZ", "H", "01", 2026, day("2026-01-01"))]
    c = spark.createDataFrame(rows, "candidate_id string, state string, office string, district string, cycle int, primary_date date")
    got = {r["candidate_id"]: str(r["primary_date"]) for r in lookup_primary_date(c, e).collect()}
    assert got == {"a": "2026-08-11", "b": "2026-05-19", "c": "2026-01-01"}


def test_sweep_keeps_marks_without_feed_information(spark):
    rows = [
        ("A1", "ROE, AL", "H", "TX", "01", "REP", None),
        ("A2", "POE, BO", "H", "TX", "01", "REP", 3),
        ("B1", "DOE, CY", "H", "TX", "02", "DEM", 3),
        ("B2", "LOW, DI", "H", "TX", "02", "DEM", None),
    ]
    c = spark.createDataFrame(
        rows, "candidate_id string, name string, office string, state string, district string, party string, inactive int"
    ).withColumn("updated_at", F.lit(None).cast("timestamp"))
    e = elections(spark, ("TX", 2026, "", day("2026-03-03"), None, None))
    overrides = spark.createDataFrame([("H-TX-1-REP", "A2", "")], "key string, candidate_id string, name string")
    args = dict(cycle=2026, today=F.lit("2026-06-01").cast("date"), ts=F.lit("2026-06-01").cast("timestamp"))
    after, moves = sweep_losers(c, e, overrides, None, None, **args)
    assert {r["candidate_id"]: r["inactive"] for r in after.collect()} == {"A1": 3, "A2": None, "B1": 3, "B2": None}
    assert {r["candidate_id"]: r["move"] for r in moves.collect()} == {"A1": "lost", "A2": "clear"}


def test_mass_clear_guard(spark):
    marked = spark.createDataFrame([(f"c{i}", "TX") for i in range(40)] + [("n", "NC")], "candidate_id string, state string")
    clears = marked.filter("state = 'NC' or candidate_id < 'c18'")
    got = {r["state"]: (r["n_clear"], r["refused"]) for r in mass_clear_guard(clears, marked).collect()}
    assert got["NC"] == (1, False) and got["TX"] == (10, True)
    assert not any(r["refused"] for r in mass_clear_guard(clears, marked, allow=True).collect())


def test_dedupe_ie_null_keys_never_collide(spark):
    rows = [(1, "t", "c"), (2, "t", "c"), (3, None, "c"), (4, None, "c"), (5, "t", None)]
    df = spark.createDataFrame(rows, "seq int, transaction_id string, committee_id string")
    assert {r["seq"] for r in tables.dedupe_ie(df).collect()} == {1, 3, 4, 5}
