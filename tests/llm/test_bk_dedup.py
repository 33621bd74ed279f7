import random

import numpy as np
import xxhash

from pagewatch.llm import bk_dedup as bk
from pagewatch.llm.queries import QUERIES
from tests.llm.frames import TEXTS, documents


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, ids, radius=4):
    left, component = set(range(len(fps))), {}
    while left:
        stack = [left.pop()]
        group = list(stack)
        while stack:
            x = stack.pop()
            near = [y for y in left if (fps[x] ^ fps[y]).bit_count() <= radius]
            left.difference_update(near)
            stack += near
            group += near
        known = [ids[x] for x in group if ids[x] is not None]
        component.update((x, min(known) if known else None) for x in group)
    return [component[i] for i in range(len(fps))]


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    ids = [d for d, _ in rows]
    found = plain_components(fps, ids)
    return sorted(((d, f"{f:016x}", c) for d, f, c in zip(ids, fps, found)), key=repr)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op10_bk_dedup"](spark, folder).collect()), key=repr) == expected(rows)


def test_awkward_texts(spark):
    got = sorted((tuple(r) for r in bk.near_components(documents(spark)).collect()), key=repr)
    assert got == expected([(d, t) for d, t, _ in TEXTS])
    assert bk.near_components(documents(spark, [])).collect() == []


def chains(n=400, seed=5):
    """Fingerprints in chains of small steps, a dense ball, and noise."""
    rng = random.Random(seed)
    out = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(20):
            out.add(x)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 4, 5])):
                x ^= 1 << b
    ball = rng.getrandbits(64)
    out.update(ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120))
    out.update(rng.getrandbits(64) for _ in range(n - len(out)))
    return sorted(out)


def test_components_of_chains_in_pieces(spark):
    fps = chains()
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for piece in (8192, 20):  # 20: hot shards are cut and worked on pairwise
        links = bk.shard_links(df, piece=piece)
        roots = {r.node: r.root for r in bk.connected(links).collect()}
        groups = {}
        for i, f in enumerate(signed):
            groups.setdefault(roots.get(f, f), []).append(i)
        want = {}
        for i, c in enumerate(plain_components(fps, list(range(len(fps))))):
            want.setdefault(c, []).append(i)
        assert sorted(groups.values()) == sorted(want.values())


def test_tree_finds_all_pairs():
    fps = np.array(chains(300, 8), np.uint64)
    tree = bk.BKTree(fps, leaf=4)
    got = {(int(q), int(f)) for a, b in tree.within(fps, 4) for q, f in zip(a, b)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}


def test_keep_one(spark):
    docs = documents(spark)
    kept = bk.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = {c for _, _, c in expected([(d, t) for d, t, _ in TEXTS])}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(wanted, key=repr)


def test_keep_one_of_each_group(spark):
    """Null ids with different texts all stay; one id with two unrelated texts keeps what is no copy of a smaller id."""
    a = "The quick brown fox jumps over the lazy dog again and again"
    b, c, d = "An aardvark dug a burrow by the river", "Nine green bottles stood upon the wall", "Winter came early to the high valleys"
    texts = [(3, a), (5, a), (5, b), (None, a), (None, b), (None, c), (None, c), (None, d), (7, ""), (7, None)]
    groups = expected(texts)
    assert len({f for _, f, _ in groups}) == 5
    rows = [(i, t, "a") for i, t in texts]
    kept = [(r.doc_id, r.text or "") for r in bk.keep_one(documents(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(3, a), (5, b), (None, c), (None, d), (7, "")], key=repr)
