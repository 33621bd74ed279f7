import pytest
from pyspark.sql import functions as F

from pagewatch.llm import deobfuscate as de
from pagewatch.llm import rule_ensemble as re_
from pagewatch.llm.queries import QUERIES
from tests.llm.frames import TEXTS, documents

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "least"), [("op6_rule_ensemble", "quality", 0.95), ("op9_deobfuscate", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    scored = QUERIES[name](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    known = scored.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out")
    row = known.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] >= least and 0 <= row[1] <= row[2] <= 1


def test_held_out_is_crc(spark):
    import zlib

    got = spark.range(100).select("id", de.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


@pytest.mark.parametrize("module", [de, re_])
def test_awkward_texts_and_labels(spark, module):
    docs = documents(spark)
    schema = "doc_id long, quality int, toxic int, score double"
    rows = [(i, i % 2, i % 2, 0.1) for i in range(8)] + [(None, 1, 1, 0.2), (2, None, None, 0.3), (3, 7, 7, 0.1), (2, 1, 1, 0.5)]
    for labels in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        got = module.score_documents(docs, labels).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert module.score_documents(documents(spark, []), labels).collect() == []


def test_removed_documents(spark):
    rows = [(i, f"calm words number {i} here", "a") for i in range(60)]
    rows += [(100 + i, f"you are n{i} stupid person and l0ser x{i} indeed st.up.id", "a") for i in range(60)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _, _ in rows], "doc_id long, toxic int")
    kept = de.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


WORDS = ["idiot", "stupid", "loser", "worthless", "moron", "pathetic", "trash", "scum", "house", "garden", "little", "letter"]


@pytest.mark.parametrize(
    ("written", "meant"),
    [("1d10t", "idiot"), ("st.u.p.i.d", "stupid"), ("l0s3r", "loser"), ("w0rthl3ss", "worthless"), ("m0r0n", "moron"),
     ("p@thetic", "pathetic"), ("stuuupiiid", "stupid"), ("$cum", "scum"), ("id*iot", "idiot"), ("little", "little")],
)
def test_restore(written, meant):
    grams = {}
    for word in WORDS:
        for i in range(len(word) + 1):
            gram = f"^^{word}$"[i : i + 3]
            grams[gram] = grams.get(gram, 0) + 5
    assert de.readings(written, de.CharModel(grams))[-1] == meant


def test_restore_is_the_best_path():
    """Against all readings of a short token, scored one by one."""
    from itertools import product

    grams = {f"^^{w}$"[i : i + 3]: 3 for w in WORDS for i in range(len(w) + 1)}
    model = de.CharModel(grams)

    def options(char):
        if char.isalpha():
            return [(char, 0.0)]
        return [(c, -de.COST["sign"]) for c in de.STANDS_FOR.get(char, "")] + [("", -de.COST["between" if char in de.BETWEEN else "kept"])]

    for token in ("1d10t", "l.0.s3r", "m0-r0n", "7r@5h"):
        scored = []
        for path in product(*map(options, token)):
            word, total = "".join(c for c, _ in path), sum(s for _, s in path)
            padded = f"^^{word}$"
            scored.append((total + sum(model.log(padded[i : i + 2], padded[i + 2]) for i in range(len(padded) - 2)), word))
        assert de.restore(token, model) == max(scored)[1]


def test_spaced_words():
    assert "idiot" in de.spaced_words("you i d i o t there")
    assert de.spaced_words("a b c") == []


@pytest.mark.parametrize(
    ("written", "meant"),
    [("s_t_u_p_i_d", "stupid"), ("st_upid", "stupid"), ("stuupid", "stupid"), ("looser", "loser"), ("i__diot", "idiot"), ("letter", "letter")],
)
def test_restore_behind_underlines_and_doubled_letters(written, meant):
    grams = {f"^^{w}$"[i : i + 3]: 0 for w in WORDS for i in range(len(w) + 1)}
    for word in WORDS:
        for i in range(len(word) + 1):
            grams[f"^^{word}$"[i : i + 3]] += 5
    assert de.readings(written, de.CharModel(grams))[-1] == meant


def test_spaced_by_any_white_space():
    for text in ("so s  t  u  p  i  d it is", "so s\tt\tu\tp\ti\td it is", "so s\nt\nu\np\ni\nd it is", "so s t u p i d"):
        assert "stupid" in de.spaced_words(text), text
    assert "pig" in de.spaced_words("a fat p i g", 3)
    assert {"fat", "pigs"} <= {*de.spaced_words("so f a t  p i g s it is", 3)}


def test_each_disguise_is_toxic(spark):
    """Spellings that no training document holds."""
    rows = [(i, f"calm words number n{i} here", "a") for i in range(100)]
    rows += [(100 + i, f"you are n{i} {('stupid', 'pig')[i % 2]} x{i} indeed", "a") for i in range(200)]
    written = ["stupid", "s_t_u_p_i_d", "st_upid", "stuupid", "stuuupid", "st.upid", "5tup1d", "s t u p i d", "s  t  u  p  i  d"]
    written += ["s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "pig", "p i g", "p  i  g", "p_i_g"]
    asked = [(1000 + i, f"calm z {w} here", "a") for i, w in enumerate(written)]
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in de.score_documents(documents(spark, rows + asked), labels).collect()}
    assert [w for i, w in enumerate(written) if not got[1000 + i]] == []
    assert not any(got[i] for i in range(100))


def test_rules_equal_column(spark):
    """The compiled column scores as the rules do in numpy."""
    import numpy as np

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200)
    model = re_.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert 0 < len(model.rules) < 200
    for r in re_.measured(docs, "doc_id").withColumn("score", model.column()).collect():
        total = model.intercept + sum(w for w, rule in model.rules if all((r[n] >= c) == above for n, c, above in rule))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    """More labelled rows than the sample of 8,000 once held."""
    from pagewatch.llm.labelled import training_rows
    from pagewatch.llm.tables import held_out

    n = 12_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("calm words").alias("text"))
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    taken, write = {}, de.write_through
    monkeypatch.setattr(de, "write_through", lambda df, label: taken.setdefault(label, write(df, label)))
    de.fit(docs, labels)
    assert taken["toxic-train"].count() == docs.filter(~held_out()).count() > 9_000
    assert training_rows(docs, labels, "toxic").count() == taken["toxic-features"].agg(F.sum("n")).first()[0]


def test_logistic_by_sums_is_newton(spark):
    import numpy as np

    from pagewatch.llm.labelled import fit_logistic, sigmoid

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 2)), 1)
    y = (rng.random(400) < sigmoid(0.5 + x @ [2.0, -1.0])).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(t), 1) for (a, b), t in zip(x, y)], "a double, b double, y int, n long")
    w = fit_logistic(rows.groupBy("a", "b", "y").agg(F.sum("n").alias("n")), ["a", "b"])
    ones = np.column_stack([np.ones(400), x])
    slope = ones.T @ (sigmoid(ones @ w) - y) + np.array([1e-6, 0.4, 0.4]) * w
    assert np.abs(slope).max() < 1e-3
    assert fit_logistic(rows.withColumn("y", F.lit(1)), ["a", "b"]) is None
