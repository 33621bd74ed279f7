"""Text quality by a sparse ensemble of rules over text statistics.

Small trees are grown on statistics of a bounded labelled sample; every path from a root
to a node is a conjunctive rule. A lasso logistic regression over the rules keeps a few,
and these are compiled into one Spark column expression, which scores all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.labelled import sigmoid, training_rows
from pagewatch.llm.tables import GAP, held_out, whole_text

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_ROWS = 80, 3, 24, 5
PENALTY = 2e-3

Rule = tuple[tuple[str, float, bool], ...]  # (statistic, cut, at or above it)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def left_out(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(text: Column) -> dict[str, Column]:
    """The statistics rules are made of; all zero for an empty text."""
    size = F.length(text)
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.split(text, "\n")
    n = F.size(words)
    return {
        "words": F.log1p(n),
        "mean_word": share(size, n),
        "distinct_words": share(F.size(F.array_distinct(words)), F.sqrt(n)),
        "distinct_share": share(F.size(F.array_distinct(words)), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_a_line": F.log1p(share(n, F.size(lines))),
        "upper": share(left_out(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size),
        "digits": share(left_out(text, "0123456789"), size),
        "marks": share(left_out(text, "#$%&*@^~+=<>"), size),
        "bars": share(left_out(text, "|"), size),
        "calls": share(left_out(text, "!?"), size),
        "stops": share(left_out(text, "."), n),
        "commas": share(left_out(text, ",;:"), n),
    }


NAMES = (
    "words", "mean_word", "distinct_words", "distinct_share", "distinct_lines", "words_a_line", "upper", "digits",
    "marks", "bars", "calls", "stops", "commas",
)


def measured(docs: DataFrame, *others: str) -> DataFrame:
    """``others`` and the statistics of each text, worked out once."""
    found = statistics(F.col("_text"))
    return docs.select(*others, whole_text().alias("_text")).select(*others, *[c.cast("double").alias(n) for n, c in found.items()])


def grow(x: np.ndarray, target: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], allowed: np.ndarray, depth: int) -> list:
    """Paths of a regression tree: lists of (statistic number, cut, at or above)."""
    if depth == 0 or len(rows) < 2 * LEAST_ROWS:
        return []
    total, best = target[rows].sum(), (1e-12, None)
    base = total**2 / len(rows)
    for j in allowed:
        for cut in cuts[j]:
            above = x[rows, j] >= cut
            n = int(above.sum())
            if n < LEAST_ROWS or len(rows) - n < LEAST_ROWS:
                continue
            s = target[rows][above].sum()
            gain = s**2 / n + (total - s) ** 2 / (len(rows) - n) - base
            if gain > best[0]:
                best = (gain, (j, cut, above))
    if best[1] is None:
        return []
    j, cut, above = best[1]
    out = []
    for side in (True, False):
        step = (int(j), float(cut), side)
        out.append([step])
        out += [[step, *path] for path in grow(x, target, rows[above == side], cuts, allowed, depth - 1)]
    return out


def holds(rule: list, x: np.ndarray) -> np.ndarray:
    met = np.ones(len(x), bool)
    for j, cut, above in rule:
        met &= (x[:, j] >= cut) == above
    return met


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[list]:
    """Different rules from trees on random halves of rows and statistics, each fitted to what is left to explain."""
    rng, found, margin = np.random.default_rng(seed), {}, np.full(len(y), 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, BINS))) for j in range(x.shape[1])]
    for _ in range(TREES):
        rest = y - sigmoid(margin)
        rows = rng.choice(len(y), min(len(y), max(200, len(y) // 2), 4000), replace=False)
        allowed = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        paths = grow(x, rest, rows, cuts, allowed, DEPTH)
        leaves = [p for p in paths if not any(len(q) > len(p) and q[: len(p)] == p for q in paths)]
        for path in leaves:
            met = holds(path, x)
            if met.any():
                p = sigmoid(margin[met])
                margin[met] += 0.3 * rest[met].sum() / (p * (1 - p)).sum().clip(1e-6)
        for path in paths:
            met = holds(path, x)
            if LEAST_ROWS <= met.sum() <= len(y) - LEAST_ROWS:
                found.setdefault(np.packbits(met).tobytes(), path)
    return list(found.values())


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a logistic regression by accelerated proximal steps."""
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    rate = 4.0 / max(np.linalg.norm(np.column_stack([np.ones(len(x)), x]), 2) ** 2 / len(x), 1e-9)
    for _ in range(rounds):
        rest = (sigmoid(x @ v + c) - y) / len(y)
        step = v - rate * (x.T @ rest)
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = c - rate * rest.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[float, Rule]]

    def column(self) -> Column:
        """The score as a column over the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            met = F.lit(True)
            for name, cut, above in rule:
                met = met & (F.col(name) >= cut if above else F.col(name) < cut)
            total = total + F.when(met, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_ROWS) -> RuleModel:
    """Fit on the statistics of at most ``sample`` labelled rows that are not held out.

    Only these numbers come to the driver. Without rows of both kinds the score is the
    share of ones, or one half without any.
    """
    rows = measured(training_rows(docs, labels, "quality", sample), "doc_id", "y").orderBy("doc_id", *NAMES).collect()
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        mean = y.mean() if len(y) else 0.5
        return RuleModel(float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), [])
    x = np.array([[r[n] for n in NAMES] for r in rows])
    rules = grow_rules(x, y)
    met = np.column_stack([holds(r, x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso(met, y)
    named = [(float(w), tuple((NAMES[j], cut, above) for j, cut, above in r)) for w, r in zip(weights, rules) if abs(w) > 1e-4]
    return RuleModel(intercept, named)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null texts count as empty; an empty text has all statistics zero and is scored by the
    rules that such numbers meet. Repeated rows are scored alike; a null doc_id is not
    held out.
    """
    model = fit(docs, labels, sample)
    scored = measured(docs, "doc_id").select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
