import hashlib
import random

import numpy as np

from pagewatch.llm import suffix_dedup as sd
from pagewatch.llm.queries import QUERIES
from tests.llm.frames import TEXTS, documents

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    """(doc_id, sizes, spans, digest) with a set of all 100-byte strings seen so far."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone, at = bytearray(len(raw)), [i for i in range(len(raw) - 99) if raw[i : i + 100] in seen or seen.add(raw[i : i + 100])]
        for i in at:
            gone[i : i + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return sorted((tuple(r) for r in df.drop("kept").collect()), key=repr)


def test_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    assert got(QUERIES["op5_suffix_dedup"](spark, FOLDER)) == sorted(plain(rows), key=repr)


def patchwork(n=60, seed=4):
    """Documents pieced together from few passages, periodic text and noise."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choices("abcdefgh é", k=k))
    passages = [noise(rng.choice([90, 101, 150, 400])) for _ in range(8)] + ["ab" * 120, "x" * 300]
    return [(i, "".join(rng.choice([rng.choice(passages), noise(rng.randrange(80))]) for _ in range(rng.randrange(1, 9)))) for i in range(n)]


def test_patchwork_and_split_buckets(spark):
    rows = patchwork()
    docs = documents(spark, [(d, t, "a") for d, t in rows])
    want = sorted(plain(rows), key=repr)
    assert got(sd.remove_repeats(docs)) == want
    assert got(sd.remove_repeats(docs, split=3)) == want


def test_awkward_texts(spark):
    rows = sorted({(d, t) for d, t, _ in TEXTS}, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {r[0]: r for r in plain(rows)}
    assert got(sd.remove_repeats(documents(spark))) == sorted((want[d] for d, _, _ in TEXTS), key=repr)
    assert sd.remove_repeats(documents(spark, [])).collect() == []


def test_every_difference_is_in_the_cover():
    table = sd.cover_shifts()
    assert sorted((a - b) % 31 for a in sd.COVER for b in sd.COVER if a != b) == list(range(1, 31))
    assert all((i + table[i, j]) % 31 in sd.COVER and (j + table[i, j]) % 31 in sd.COVER for i in range(31) for j in range(31))


def test_sorted_block_with_mixed_residues():
    """Many equal windows at all residues: the order is that of the bytes."""
    rng = random.Random(6)
    core = bytes(rng.choices(b"ab", k=140))
    raw = b"".join(bytes(rng.choices(b"ab", k=rng.randrange(40))) + core for _ in range(60)) + b"z" * 700
    data, at = np.frombuffer(raw, np.uint8), np.arange(len(raw) - 700)
    bucket = np.zeros(len(at), np.uint64)
    order = sd.sort_block(data, at, bucket)
    windows = [raw[i : i + 100] for i in order.tolist()]
    assert windows == sorted(windows)
    runs = sd.equal_runs(data, at, bucket, order)
    assert len(set(runs.tolist())) == len(set(windows))


def test_equal_windows_pick_equal_anchors():
    rng = random.Random(9)
    core = bytes(rng.choices(b"abc", k=130))
    a = np.frombuffer(bytes(rng.choices(b"abc", k=50)) + core + b"c" * 150, np.uint8)
    b = np.frombuffer(core + bytes(rng.choices(b"abc", k=33)), np.uint8)
    picks = []
    for data, shift in ((a, 50), (b, 0)):
        hashes, first, last = sd.anchors_of(data)
        assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
        picks.append([int(hashes[np.searchsorted(last, shift + i)]) for i in range(31)])
    assert picks[0] == picks[1]
