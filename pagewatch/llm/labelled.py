"""Labelled documents for fitting a classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.tables import held_out, whole_text

BROADCAST_IDS = 1_000_000


def known_labels(labels: DataFrame, label: str, sample: int | None = None) -> DataFrame:
    """(doc_id, y) of the labelled ids that are not held out; see ``training_rows``."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    if sample is not None:
        return F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return F.broadcast(known) if known.count() <= BROADCAST_IDS else known


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int | None = None) -> DataFrame:
    """(doc_id, text, y) of all labelled documents that are not held out, or of at most ``sample``.

    A sample is drawn by the hash of the id, so reruns agree. Ids are broadcast if at most ``BROADCAST_IDS`` by
    count; beyond that, texts and ids are shuffled. Labels other than 0 and 1 and null ids are no labels; of several labels of one document the largest holds.
    """
    return docs.select("doc_id", whole_text().alias("text")).join(known_labels(labels, label, sample), "doc_id")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(rows: DataFrame, names: list[str], ridge: float = 1e-3, rounds: int = 60) -> np.ndarray | None:
    """Weights of a logistic regression of ``y`` on ``names``, the intercept first, by Newton's method.

    Rows count ``n`` times. Each round adds up the slopes and curvatures of all rows in one Spark aggregate, and
    only these sums come to the driver; the weights are rounded, so the order of adding does not show. None
    without rows of both kinds.
    """
    total, ones = rows.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    if not total or not 0 < ones < total:
        return None
    x = [F.lit(1.0), *[F.col(c) for c in names]]
    k, pairs = len(x), [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    w = np.zeros(k)
    penalty = np.full(k, ridge * total)
    penalty[0] = 1e-6
    for _ in range(rounds):
        at = sum((c * float(v) for c, v in zip(x[1:], w[1:])), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(35.0)), F.lit(-35.0))))
        seen = rows.select("*", p.alias("_p")).select("*", (F.col("n") * (F.col("_p") - F.col("y"))).alias("_s"), (F.col("n") * F.col("_p") * (1 - F.col("_p"))).alias("_c"))
        sums = seen.agg(
            *[F.sum(F.col("_s") * c).alias(f"s{i}") for i, c in enumerate(x)],
            *[F.sum(F.col("_c") * x[i] * x[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        curve = np.zeros((k, k))
        for i, j in pairs:
            curve[i, j] = curve[j, i] = sums[f"c{i}_{j}"]
        step = np.linalg.solve(curve + np.diag(penalty), np.array([sums[f"s{i}"] for i in range(k)]) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.round(w, 6)
