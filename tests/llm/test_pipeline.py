"""The pipeline against plain code, stage by stage on each stage's own input."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
from pagewatch.llm import deobfuscate, mixing
from pagewatch.llm.queries import QUERIES
from tests.llm.frames import TEXTS, documents
from tests.llm.test_bk_dedup import expected
from tests.llm.test_decontaminate import plain_verdicts
from tests.llm.test_token_pack import order, plain_rows

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def plain_copies(rows):
    """Copies of each row by weights 1, 2, 3 over the sources, whole documents only."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = lambda r: len((r[1] or "").encode().split())
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1.0 for i, s in enumerate(sources)}
    target, full = dict.fromkeys(sources, 0.0), set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        level = rest / max(sum(weight[s] for s in sources if s not in full), 1e-9)
        above = {s for s in sources if weight[s] * level >= 3 * total[s]} - full
        if not above:
            break
        full |= above
    target = {s: 3.0 * total[s] if s in full else weight[s] * level for s in sources}
    out = Counter()
    for s in sources:
        goal, before = int(target[s] + 0.5), 0
        passes = goal // total[s] if total[s] else 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
            part = max(0, min(size(r), goal - passes * total[s] - before))
            before += size(r)
            if size(r):
                out[r] += passes + (part * 2 >= size(r) and part > 0)
    return +out


def test_stages(spark):
    documents_, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = documents_
    for name, stage in cp.STAGES:
        before = rows_of(docs)
        out = stage(spark, docs, FOLDER)
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        if name == "toxicity":
            scored = deobfuscate.score_documents(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            kept = {r.doc_id for r in scored.filter("predicted = 0").collect()}
            assert 0 < len(kept) < sum(before.values())
        elif name == "near_duplicates":
            kept = {c for _, _, c in expected([(r[0], r[1]) for r in before])}
        elif name == "decontamination":
            bad = plain_verdicts([(r[0], r[1]) for r in before], [(r.item_id, r.text) for r in benchmark.collect()])
            kept = {r[0] for r in before} - set(bad)
            assert bad
        elif name == "mixing":
            assert rows_of(out) == plain_copies(list(before))
            docs = out
            continue
        else:
            flat = [(r[0], r[1]) for r, n in before.items() for _ in range(n)]
            assert order(map(tuple, out.collect())) == plain_rows(flat)
            continue
        assert rows_of(out) == Counter({r: n for r, n in before.items() if r[0] in kept})
        docs = out


def test_awkward_documents(spark):
    docs = documents(spark)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
        docs = out
    kept = {r.doc_id for r in docs.collect()}
    assert kept <= {d for d, _, _ in TEXTS} and 6 in kept
    assert cp.STAGES[-1][1](spark, docs.limit(0), FOLDER).collect() == []


def test_mixing_query_equals_sql(spark):
    from tests.llm.cases import compared

    for folder in (FOLDER, "/root/testdata/sf0.01"):
        ok, message = compared(spark, folder, "op1_mixing")
        assert ok, message
    ok, message = compared(spark, "/root/testdata/sf0.01", "op7_url_terms")
    assert ok, message


def test_mix_of_awkward_rows(spark):
    got = mixing.plan_mix(documents(spark)).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert len(got) == len(TEXTS) and all(abs(target - taken) <= 0.5 for target, taken in by.values())
    assert mixing.plan_mix(documents(spark, [])).collect() == []
    again = mixing.plan_mix(documents(spark).repartition(5)).collect()
    key = lambda r: (repr(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F

    for schedule in (*mixing.CURRICULUM.values(), mixing.FLAT, ((0.0, 0.0), (0.25, 4.0), (1.0, 0.0))):
        total = sum((a[1] + b[1]) * (b[0] - a[0]) / 2 for a, b in zip(schedule, schedule[1:]))
        for share in (0.0, 0.1, 0.5, 0.77, 1.0):
            at = spark.range(1).select(mixing.demand_position(F.lit(share), schedule)).first()[0]
            used = 0.0
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
                x = min(max(at - t0, 0), t1 - t0)
                used += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert abs(used / total - share) < 1e-9


def test_training_order(spark):
    plan = mixing.plan_mix(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rows = mixing.training_order(plan, mixing.CURRICULUM).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert sum(r.words for r in rows) == plan.agg({"taken": "sum"}).first()[0]


def test_schedules_set_targets(spark):
    """A schedule's integral is the demand: a source that is there for half of training gets half of its weight."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(10))
    docs = documents(spark, [(100 * "abc".index(s) + i, words(i), s) for s in "abc" for i in range(40)])
    target = lambda plan: {r.source: r.target for r in plan.select("source", "target").distinct().collect()}
    assert target(mixing.plan_mix(docs)) == {"a": 200.0, "b": 400.0, "c": 600.0}
    half = {2.0: ((0.0, 0.0), (1.0, 1.0)), 3.0: ((0.0, 1.0), (1.0, 1.0))}
    assert target(mixing.plan_mix(docs, schedules=half)) == {"a": 240.0, "b": 240.0, "c": 720.0}


def test_mix_leaves_in_training_order(spark):
    """Copies of one document are a pass apart, and a source that comes in late is rare in the first half."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(10))
    docs = documents(spark, [(100 * "abc".index(s) + i, words(i), s) for s in "abc" for i in range(40)])
    rows = mixing.mix_documents(docs).collect()
    ids, plan = [r.doc_id for r in rows], mixing.plan_mix(docs)
    placed = mixing.training_order(plan, mixing.CURRICULUM).collect()
    assert ids == [r.doc_id for r in placed] and len(ids) == 120
    assert all(a != b for a, b in zip(ids, ids[1:]))
    late = [r.source for r in rows]
    assert late[:60].count("c") < 25 < 35 < late[60:].count("c")
    first = {r.doc_id: r.position for r in placed if r.copy == 0}
    assert all(abs(r.position - first[r.doc_id]) < 1e-12 for r in plan.collect() if r.doc_id in first)


def test_urls(spark):
    from pagewatch.llm.url_terms import judge_urls

    rows = [
        (1, "https://WWW.Example.com/en/x?a#b", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "http://m.example.com/en/5", "m.example.com", "/en/5", "example.com/en/", "block"),
        (3, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (4, "http://a.net/fr/x", "a.net", "/fr/x", "net/fr/", "block"),
        (5, "http://a.com", "a.com", "", None, "allow"),
        (6, "http://casino.org/", "casino.org", "/", None, "block"),
        (7, "http://mycasinos.org/", "mycasinos.org", "/", None, "allow"),
        (8, "http://free-bets.org/x", "free-bets.org", "/x", None, "block"),
        (9, "http://free.org/free", "free.org", "/free", None, "allow"),
        (10, None, "", "", None, "allow"),
        (11, "", "", "", None, "allow"),
        (12, "no scheme/casino", "", "", None, "block"),
        (None, "http://x.de/" + "a/" * 50_000, "x.de", "/" + "a/" * 50_000, None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "other", "other") for i, u, *_ in rows], "page_id long, url string, rule string, host string")
    got = {tuple(r)[:5] for r in judge_urls(pages).collect()}
    assert got == {(i, h, p, r, v) for i, _, h, p, r, v in rows}
    assert judge_urls(pages.limit(0)).collect() == []
    assert len(QUERIES) == 13
