"""The toxicity operator against plain code, and its time on very long texts."""

import math
import random
import re
import time
from collections import Counter

import numpy as np

from pagewatch.llm import deobfuscate as de
from tests.llm.frames import documents

LETTER = r"[^\W\d_]"
GATE = re.compile(rf"(?:{LETTER}.*(?:[^\w\s]|_).*{LETTER}|{LETTER}.*\d|[\d@$!+(€£¡]+.*{LETTER}|({LETTER})\1|{LETTER}[$@]\Z)", re.S)


def test_gate_equals_one_expression():
    rng = random.Random(1)
    for _ in range(20_000):
        word = "".join(rng.choice("abcé中_1٣@$!-.·²") for _ in range(rng.randrange(9)))
        assert de.disguised(word) == bool(GATE.search(word)), word


def model_of(words, lexicon=()):
    grams = Counter(f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1))
    return de.ToxicModel(de.CharModel(dict(grams)), dict(lexicon), np.array([-4.0, 2.0, 0.5, 0.1, 0.3]))


def test_long_texts_take_linear_time():
    """A megabyte without spaces, spaced characters, signs and digits: seconds, not minutes."""
    model = model_of(["stupid", "letter", "house"], {"stupid$": 3.0, "stup": 2.0})
    rng = random.Random(2)
    letters = "".join(rng.choice("abcdeghistupl") for _ in range(1_000_000))
    texts = [
        letters, "中" * 1_000_000, "a" + "!" * 1_000_000 + "b", "".join(rng.choice("aZ09+/") for _ in range(1_000_000)), "a." * 100_000,
        " ".join(letters[:200_000]), "\n".join("s1" * 50_000), " " * 1_000_000, "ss" * 500_000,
    ]
    for text in texts:
        start = time.perf_counter()
        found = model.features(text, {})
        assert time.perf_counter() - start < 30, text[:20]
        assert len(found) == 4
    assert model.features(letters[:5000] + "x " + " ".join("stupid"), {})[0] == 3.0
    # words that signs part in one long token, plain, disguised and spaced out
    for written in ("stupid", "5tup1d", "s.t.u.p.i.d"):
        assert model.features("house," * 40 + written + ",house" * 40, {})[0] == 3.0, written



def test_lexicon_features_and_score(spark):
    """Counts of marks, their weights, a document's features and its score, all recomputed by loops."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(("calm", "garden", "house", "river", "stone", "bridge")) for _ in range(12)]
        rows += [(i, " ".join([*words, *(["fool", "swine"] if toxic else [])]), "a")]
    labels = spark.createDataFrame([(d, int(d % 4 == 0)) for d, _, _ in rows], "doc_id long, toxic int")
    model = de.fit(documents(spark, rows), labels)

    trained = [(t, d % 4 == 0) for d, t, _ in rows if __import__("zlib").crc32(str(d).encode()) % 5]
    clean, toxic = Counter(), set()
    for text, bad in trained:
        words = [w for t in de.tokens_of(text) for w in de.readings(t, model.chars)]
        places = {(m, b) for b, w in set(zip(["", *words], words)) for m in de.marks(w)}
        if bad:
            toxic |= places
        else:
            clean.update(m for m, _ in places)
    counts = Counter(m for m, _ in toxic)
    share = sum(counts.values()) / (sum(counts.values()) + sum(clean.values()))
    lexicon = {}
    for mark, t in counts.items():
        c = clean[mark]
        p = t / (t + c)
        gain = t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0.0)
        if t > 2 and t > c and gain >= de.LEAST_EVIDENCE:
            lexicon[mark] = math.log((t + 0.5) / (c + 0.5)) - math.log(share / (1 - share))
    assert model.lexicon.keys() == lexicon.keys() and lexicon
    assert all(abs(model.lexicon[m] - w) < 1e-9 for m, w in lexicon.items())

    for text in ("", "calm house", "you fool swine", "f o o l and sw1ne in the house", " ".join(["fool"] * 9)):
        scores = sorted((max((lexicon[m] for w in de.readings(t, model.chars) for m in de.marks(w) if m in lexicon), default=0.0) for t in set(de.tokens_of(text))), reverse=True)
        scores = [s for s in scores if s]
        want = (scores[0] if scores else 0.0, sum(scores[:5]), min(len(scores), 5), math.log1p(100 * len(scores) / max(len(text.split()), 1)))
        got = model.features(text, {})
        assert np.allclose(got, want)
        z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], want))
        assert abs(model.score(np.array([got]))[0] - 1 / (1 + math.exp(-max(-35, min(35, z))))) < 1e-12


def test_clean_places_are_counted_as_one_by_one():
    from collections import Counter

    from pagewatch.llm import deobfuscate as D

    texts = ["the house the housing the houses a house", "the reed the reeds of the reed", "one two three", ""]
    words, clean, want = Counter(), Counter(), Counter()
    for text in texts:
        tokens = text.split()
        pairs = set(zip(["", *tokens], tokens))
        want.update(m for m, _ in {(m, before) for before, w in pairs for m in D.marks(w)})
        D.add_clean(pairs, words, clean)
    got = D._clean_marks(words, clean)
    assert dict(zip(got.mark, got.clean)) == dict(want)
    grams = D.trigrams_of(Counter({"reed,": 2, "x1": 1}))
    assert grams == {"^^r": 2, "^re": 2, "ree": 2, "eed": 2, "ed$": 2}


def test_only_tokens_that_may_have_a_mark_are_read(monkeypatch):
    """Tokens passed over have no mark; words of letters that begin otherwise are passed over, doubled letters too."""
    model = model_of(["stupid", "letter", "idiot", "boob"], {"stupid$": 3.0, "stup": 2.0, "idi": 1.0, "boob$": 4.0, "abc$": 1.5})
    rng = random.Random(5)
    for _ in range(30_000):
        token = "".join(rng.choice("stupidboaBS!|@$1.,\"'(ßİ中") for _ in range(rng.randrange(1, 9)))
        assert model.may_mark(token) or model.word_score(token) == 0.0, token
    for token in ("sstttupid", "BOOOB", "boobb,", "aabbcc", "5tupid", "(stupid)"):
        assert model.word_score(token) > 0 and model.may_mark(token), token
    text = "The house, a letter (and the bookkeeper's) valley will follow: still, coffee!"
    read = []
    monkeypatch.setattr(de, "readings", lambda token, chars: read.append(token) or [])
    assert model.features(text, {}) == (0.0, 0.0, 0.0, 0.0) and sorted(read) == ["(and", "bookkeeper's)"]


def test_spaced_words_are_sought_where_single_characters_stand_in_a_row(monkeypatch):
    rng = random.Random(6)
    for _ in range(2_000):
        text = "".join(rng.choice("ab  \t\n") for _ in range(rng.randrange(30))) + rng.choice(["", "x" * 300])
        want = [*text.split(), *de.spaced_words(text, de.LEAST_SPACED)]
        assert de.tokens_of(text)[: len(want)] == want
    monkeypatch.setattr(de, "spaced_words", None)
    assert de.tokens_of("a house a b house") == ["a", "house", "a", "b", "house"]
