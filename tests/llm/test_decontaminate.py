import random
import re

import pytest

from pagewatch.llm import decontaminate as dc
from pagewatch.llm.queries import QUERIES
from tests.llm.frames import TEXTS, documents

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")


def words(text):
    return WORD.findall((text or "").lower())


def plain_verdicts(rows, items):
    """Every item on every diagonal of every document: some window agrees in 0.8 of its words."""
    different = {}
    for i, t in items:
        if words(t):
            different.setdefault(tuple(words(t)), []).append(i)
    out = {}
    for doc, text in rows:
        w = words(text)
        for item in different:
            n, width = len(item), min(13, len(item))
            for shift in range(-n + 1, len(w)):
                same = [0 <= j + shift < len(w) and w[j + shift] == item[j] for j in range(n)]
                if max(sum(same[s : s + width]) for s in range(n - width + 1)) >= 0.8 * width:
                    out.setdefault(doc, {}).setdefault(item, 0)
                    out[doc][item] = max(out[doc][item], sum(same))
    return out


def found(df):
    return {(r.doc_id, r.contaminated, r.n_items, r.n_agree) for r in df.collect()}


def check(got, rows, items):
    want = plain_verdicts(rows, items)
    assert found(got) == {(d, d in want, len(want.get(d, ())), max(want[d].values()) if d in want else None) for d, _ in rows}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = QUERIES["op3_decontaminate"](spark, FOLDER)
    leaked = {d for d, t in rows if any(" ".join(words(i)) in " ".join(words(t)) for _, i in items)}
    assert {r.doc_id for r in got.collect() if r.contaminated} == leaked and leaked
    assert got.count() == len(rows)


@pytest.mark.parametrize("broadcast", [dc.BROADCAST_SEEDS, 0])
def test_substitutions(spark, monkeypatch, broadcast):
    """Items of 1 to 30 words with up to five substitutions, seeds broadcast and shuffled; a null id is an id."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    lengths = [1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 22, 30]
    items = [(i or None, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate(lengths)]
    items += [(99, None), (98, " - "), (97, items[5][1]), (None, items[6][1]), (None, items[6][1])]
    rows = []
    for d in range(160):
        text = rng.choices(vocabulary, k=rng.choice([0, 3, 40]))
        if d % 4:
            part = items[d % 20][1].split()
            for k in rng.sample(range(len(part)), min(d % 6, len(part))):
                part[k] = "other"
            text[10:10] = part
        rows.append((d, ", ".join(text)))
    docs = documents(spark, [(d, t, "a") for d, t in rows])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = dc.hits
    monkeypatch.setattr(dc, "hits", lambda *a: whole(*a, broadcast=broadcast))
    check(dc.flag_documents(docs, benchmark), rows, items)


@pytest.mark.parametrize(
    ("item", "text"),
    [((None, "one two three four five six seven"), "zero one two three four five six seven eight"), ((1, "alpha beta gamma delta"), "so alpha beta gamma delta it is"),
     ((1, "one two three four five"), "one two other four five"), ((1, "one two three four five"), "x two three four five"), ((1, "word"), "a Word!")],
)
def test_items_without_id_and_short_items(spark, item, text):
    docs = documents(spark, [(1, text, "a"), (2, "quite clean", "a")])
    got = dc.flag_documents(docs, spark.createDataFrame([item], "item_id long, text string")).collect()
    assert {r.doc_id: r.contaminated for r in got} == {1: True, 2: False}


def test_masks_cover_every_length():
    """Each way to substitute what a window allows leaves a mask whole; long items need no short mask."""
    from itertools import combinations

    every = [*dc.MASKS, *dc.SHORT]
    for n in range(1, 14):
        gone = max(g for g in range(n + 1) if n - g >= 0.8 * n)
        chosen = [every[k] for k in dc.masks_of(n, dc.MASKS, 13, 0.8)]
        for out in combinations(range(n), gone):
            assert any(all(i + k not in out for k, c in enumerate(m) if c == "1") for m in chosen for i in range(n - len(m) + 1)), (n, out)
    assert dc.masks_of(13, dc.MASKS, 13, 0.8) == dc.masks_of(40, dc.MASKS, 13, 0.8) == [0, 1, 2]


def test_awkward_texts(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, TEXTS[0][1]), (2, TEXTS[0][1])], "item_id long, text string")
    rows = [(r.doc_id, r.contaminated, r.item_id) for r in dc.flag_documents(docs, items).collect()]
    assert sorted(rows, key=repr) == sorted(((d, d in (1, 2), 1 if d in (1, 2) else None) for d, _, _ in TEXTS), key=repr)
    kept = dc.without_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 3, 4, 5, 6, 7}
    assert dc.flag_documents(documents(spark, []), items).collect() == []
    assert not any(r.contaminated for r in dc.flag_documents(docs, items.limit(0)).collect())
