from pagewatch.catalog import query
from pagewatch.operators import review as V
from tests.compare import check, duck


def test_asked_without_candidate_row(spark):
    """Detections of unlisted candidates, and negative ones, are asked too; they are no other's twins."""
    twins = spark.createDataFrame([(1, "A", "h"), (2, "A", "h"), (3, "B", "h"), (6, "A", "one")], "detection_id long, candidate_id string, text_hash string")
    more = spark.createDataFrame([(4, "unlisted", "h"), (5, "B", "h"), (7, "A", "other"), (8, None, "h")], twins.schema)
    got = {tuple(r) for r in V.twins_of(twins.union(more), twins).collect()}
    assert got == {(1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 3, 2), (4, 1, None, 3), (5, 1, 3, 2)}


def test_unlisted_candidates_of_the_query(spark, tmp_path):
    """With a part of the customers gone, the query still asks every positive detection; it agrees with its SQL."""
    folder = "/root/testdata/sf0.01"
    for name in ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{folder}/{name}.parquet")
    spark.read.parquet(f"{folder}/customer.parquet").filter("c_custkey % 3 <> 0").toPandas().to_parquet(tmp_path / "customer.parquet")
    ok, message = check(spark, duck(str(tmp_path)), str(tmp_path), "twins_of")
    assert ok, message
    got = query("twins_of")(spark, str(tmp_path)).collect()
    assert any(r.claim_id is None for r in got) and any(r.claim_id is not None for r in got)
    assert len(got) == len({r.asked_id for r in got}) == query("template_siblings")(spark, str(tmp_path)).count()
