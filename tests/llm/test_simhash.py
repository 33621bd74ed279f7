import hashlib
import random

from pyspark.sql import functions as F

from pagewatch.llm import simhash as sh
from pagewatch.llm.queries import QUERIES
from tests.llm.frames import TEXTS, documents

FOLDER = "/root/testdata/sf0.001"


def expected(rows):
    """(doc_id, n_chars, digest of the edited text), by plain code."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (doc, text) in enumerate(rows):
        cut, following = len(text) // 4, rows[(i + 1) % len(rows)][1]
        changed = text[: len(text) - cut] + following[:cut]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), text, changed, following))
    return out


def plain_fingerprints(spark, texts):
    """Word by word votes; only the word and shingle hashes come from Spark."""
    out = {}
    words = {t: [w for w in t.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w] or [""] for t in texts}
    every = sorted({w for ws in words.values() for w in ws})
    coded = {r.w: (r.h & ~1) | (len(r.w) > 3) for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for text, ws in words.items():
        codes = [coded[w] for w in ws]
        out[text] = [codes[i : i + 5] for i in range(max(1, len(codes) - 4))]
    shingles = sorted({tuple(s) for ss in out.values() for s in ss})
    df = spark.createDataFrame([(list(s),) for s in shingles], "s array<long>")
    hashes = {tuple(r.s): r.h for r in df.select("s", F.xxhash64(*[F.get("s", i) for i in range(5)]).alias("h")).collect()}
    result = {}
    for text, ss in out.items():
        votes = [(hashes[tuple(s)] & (2**64 - 1), 1 + sum(c & 1 for c in s)) for s in ss]
        total = sum(w for _, w in votes)
        result[text] = sum(1 << b for b in range(64) if 2 * sum(w for h, w in votes if h >> b & 1) > total)
    return result


def check(spark, got, rows):
    want = expected(rows)
    fps = plain_fingerprints(spark, {t for w in want for t in w[3:]})
    like = lambda a, b: 1 - (fps[a] ^ fps[b]).bit_count() / 64
    full = [(d, n, h, f"{fps[t]:016x}", f"{fps[c]:016x}", like(t, c), like(t, f)) for d, n, h, t, c, f in want]
    assert sorted(map(tuple, got), key=repr) == sorted(full, key=repr)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op8_simhash"](spark, FOLDER).collect()
    check(spark, got, rows)
    near = sorted(r.near_edited for r in got)
    assert near[len(near) // 10] > 0.6 > sorted(r.near_next for r in got)[len(got) // 2]


def test_awkward_texts(spark):
    check(spark, sh.fingerprints(documents(spark)).collect(), [(d, t) for d, t, _ in TEXTS])
    one = [(5, "only one text here", "a")]
    check(spark, sh.fingerprints(documents(spark, one)).collect(), [(5, "only one text here")])
    assert sh.fingerprints(documents(spark, [])).collect() == []


def test_ranges(spark):
    bounds = sorted(random.Random(1).sample(range(1000), 57))
    got = spark.range(1000).select("id", sh.range_of(F.col("id"), bounds).alias("r")).collect()
    assert all(r.r == sum(b <= r.id for b in bounds) for r in got)


def test_find_near_is_complete(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            f ^= 1 << b
        fps.append(f)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius in (0, 3, 4):
        got = sorted((r.query, r.fp, r.distance) for r in sh.find_near(df, df.limit(80), radius).collect())
        asked = {r.fp for r in df.limit(80).collect()}
        far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
        assert got == sorted((a, b, far(a, b)) for a in asked for b in set(signed) if far(a, b) <= radius)


def test_plan_is_native_with_one_text_shuffle(spark):
    import re

    plan = sh.fingerprints(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") == 1
