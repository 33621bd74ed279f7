"""Small awkward tables for the training-text operators."""

from __future__ import annotations

LONG = "lang " * 40_000 + "ende"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, " \t\n ", "b"),
    (6, LONG, "a"),
    (7, "two  spaces \n\n and <|endoftext|> a mark é ñ 中文", "c"),
    (None, "no id at all", "c"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "a"),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, label int, size int, score double, fp long, shard long"


def documents(spark, rows=TEXTS):
    """A documents table with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(d, t, s, None, None, 9, 9, 9.0, 9, 9) for d, t, s in rows], SCHEMA).repartition(3)


NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, whole long, apex int, cluster string, position int, code int, cell int, key long"


def embeddings(spark, rows):
    """An embeddings table (vec_id, vector, label) with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, v, l, 9, 9, "x", 9, 9, 9, 9) for i, v, l in rows], VECTORS).repartition(3)
