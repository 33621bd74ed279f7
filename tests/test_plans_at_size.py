"""Plans whose cost a task must not grow with the table."""

from pyspark.sql import functions as F

from pagewatch.operators.evaluate import stratified_sample
from pagewatch.operators.resolve import select_search_result
from pagewatch.plans import changes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_hits_are_not_sorted_ahead_of_the_shuffle(spark):
    hits = spark.range(300).select(
        (F.col("id") % 30).cast("string").alias("candidate_id"), F.expr("cast(id div 30 as int)").alias("rank"),
        F.concat(F.lit("https://www.site"), F.expr("id div 30"), F.lit(".example/home")).alias("link"),
    )
    answers = spark.createDataFrame([("1", "https://site7.example"), ("2", "https://site8.example")], "candidate_id string, answer string")
    found = select_search_result(hits, answers)
    limits = [line for line in plan(found).splitlines() if "WindowGroupLimit" in line]
    assert not any("Partial" in line for line in limits)
    assert found.collect() == [("1", "https://www.site7.example/home")]


def test_sample_scores_each_text_once(spark):
    pages = spark.range(200).select(
        F.col("id").alias("detection_id"), F.lit("https://a.example/x").alias("url"),
        F.when(F.col("id") % 10 == 0, "a crosstab").otherwise("calm").alias("raw_text"),
    )
    drawn = stratified_sample(pages, 5, 12)
    assert "crosstab" not in plan(drawn.select("detection_id", "stratum"))
    got = drawn.collect()
    assert drawn.columns == [*pages.columns, "stratum"]
    assert sorted(r.stratum for r in got) == ["easy"] * 7 + ["hard"] * 5
    assert all((r.raw_text == "a crosstab") == (r.stratum == "hard") for r in got)


def test_a_sweep_reads_its_history_once(spark, monkeypatch, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    schema = "scan_id long, candidate_id string, url string, raw_text string, text_hash string, http_status int, content_type string, fetched_at timestamp"
    rows = [(i, "a", f"https://a.example/p{i % 3}", f"body {i}", f"h{i}", 200, "text/html", None) for i in range(1, 7)]
    path = str(tmp_path / "all-history")
    spark.createDataFrame(rows[:4], schema).write.parquet(path)
    events = spark.createDataFrame([], "change_id long, candidate_id string, url string, new_scan_id long, new_classification string")
    detections = spark.createDataFrame([(1, 3, "ambiguous")], "detection_id long, scan_id long, classification string")
    plans, write = [], changes.write_through
    monkeypatch.setattr(changes, "write_through", lambda df, label: plans.append(plan(df)) or write(df, label))
    out = changes.sweep_decisions(spark.createDataFrame(rows[4:], schema), spark.read.parquet(path), events, detections)
    plans.append(plan(out))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert sum("all-history" in line for p in plans for line in p.splitlines()) == 1
    assert sorted((r.scan_id, r.base_scan_id, r.base_class, r.unchanged) for r in out.collect()) == [
        (5, 2, "no_guidance_detected", False), (6, 3, "ambiguous", False)
    ]
