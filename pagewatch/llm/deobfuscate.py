"""Toxicity of texts whose words may be disguised.

A word with digits or signs for letters, signs between its letters, or stretched letters
is read as a lattice of what its author may have meant. A Viterbi search takes the most
likely path under a character trigram model and the costs of each disguise; letters
spaced out as words of their own are joined first. Restored words are looked up in a
lexicon of words and word beginnings that mark toxic training documents, and a logistic
regression turns a document's finds into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.labelled import fit_logistic, known_labels, sigmoid, training_rows
from pagewatch.llm.tables import held_out, whole_text
from pagewatch.session import write_through

# Signs that stand for letters, and signs put between letters.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "+": "t", "|": "li", "(": "c", "€": "e", "£": "l", "¡": "i", "2": "z",
}
BETWEEN = set(".-_*·,'’~^`/\\:;=#%&")
AROUND = ".,;:?\"'’‘()[]{}<>…«»“”„|*#%&!-_=~`/\\"
COST = {"sign": 1.0, "between": 0.7, "repeat": 1.2, "kept": 14.0}
STARTS = (4, 5, 6)
LEXICON_ROWS = 20_000
TRIGRAMS = 60_000
LEAST_EVIDENCE = 10.0

LETTER = re.compile(r"[^\W\d_]")
DIGIT = re.compile(r"\d")
SIGN = re.compile(r"[^\w\s]|_")
STANDS = re.compile(r"[\d@$!+(€£¡]")
DOUBLED = re.compile(r"([^\W\d_])\1")
RUNS = re.compile(r"(.)\1+")
ENDS = "$@!+*#%&"
OPENING = "\"'([{<«“„"
LEADING = OPENING + "!|"
APART = re.compile(r"[^\w\s@$!+(€£¡|]|_")
SPACED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
WIDER = re.compile(r"\s{2,}|[^\S ]")
LONG = 64
REACH = 20
LEAST_SPACED = 3
SINGLES = bytes([1] * LEAST_SPACED)
KNOWN = 200_000
PLACES = 400_000


@dataclass
class CharModel:
    """Trigram model of words as letters between a start and an end mark."""

    trigrams: dict[str, int]
    pairs: Counter = field(default_factory=Counter)
    known: dict[str, str] = field(default_factory=dict, repr=False)
    logs: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        for gram, n in self.trigrams.items():
            self.pairs[gram[:2]] += n

    def log(self, before: str, char: str) -> float:
        gram = before + char
        found = self.logs.get(gram)
        if found is None:
            if len(self.logs) >= KNOWN:
                self.logs.clear()
            found = self.logs[gram] = math.log((self.trigrams.get(gram, 0) + 0.05) / (self.pairs.get(before, 0) + 2.0))
        return found

    def restored(self, token: str) -> str:
        word = self.known.get(token)
        if word is None:
            word = restore(token, self)
            if len(self.known) >= KNOWN:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = word
        return word


def restore(token: str, model: CharModel) -> str:
    """The most likely word behind a disguised token: a Viterbi path through its lattice.

    A state is the last two letters; each character of the token may stand for itself,
    for the letters its sign looks like, or, between letters or as a repeat, for nothing.
    """
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    token = token.lower()
    for at, char in enumerate(token):
        after: dict[str, tuple[float, str]] = {}
        if char.isalpha() and char not in STANDS_FOR and not (at and token[at - 1] == char):
            for state, (score, word) in best.items():  # only the letter itself
                score += model.log(state, char)
                state = state[1] + char
                if state not in after or score > after[state][0]:
                    after[state] = (score, word + char)
            best = after
            continue

        def offer(state: str, score: float, word: str) -> None:
            if state not in after or score > after[state][0]:
                after[state] = (score, word)

        letter = char.isalpha()
        stretched = at > 0 and token[at - 1] == char
        for state, (score, word) in best.items():
            if letter:
                offer(state[1] + char, score + model.log(state, char), word + char)
            for other in STANDS_FOR.get(char, ""):
                offer(state[1] + other, score + model.log(state, other) - COST["sign"], word + other)
            if stretched:
                offer(state, score - COST["repeat"], word)
            if not letter:
                offer(state, score - (COST["between"] if char in BETWEEN else COST["kept"]), word)
        best = after
    return max(((score + model.log(state, "$"), word) for state, (score, word) in best.items()), default=(0.0, ""))[1]


def plain(token: str) -> str:
    word = token.lower().strip(AROUND)
    if word.isalpha():
        return word
    head = word.rstrip(ENDS)
    return (head if len(word) - len(head) > 1 else word).strip(AROUND)


def disguised(word: str) -> bool:
    """Whether signs or digits stand among or before letters, or a letter is doubled; in time linear in the word."""
    if word.isalpha():
        return DOUBLED.search(word) is not None
    first = LETTER.search(word)
    if not first:
        return False
    last = len(word) - 1 - LETTER.search(word[::-1]).start()
    stands = STANDS.search(word)
    return bool(
        SIGN.search(word, first.end(), last)
        or DIGIT.search(word, first.end())
        or (stands and stands.start() < last)
        or DOUBLED.search(word)
        or (word[-1] in "$@" and last == len(word) - 2)
    )


def readings(token: str, model: CharModel) -> list[str]:
    """The words a token may be: as it stands, and restored if it looks disguised.

    Of a token above ``LONG`` characters, its first ``LONG`` are restored: the lexicon knows words by
    their beginnings, and no longer words. What else stands in such a token, ``tokens_of`` takes apart.
    """
    low = token.lower()
    if low.isalpha() and not DOUBLED.search(low):
        return [low]
    whole = word = plain(token)
    if not disguised(word):
        head = token.lower().lstrip(OPENING)  # a leading sign may be a letter: "!diot"
        if not (head[:1] in ("!", "|") and head[1:2].isalpha()):
            return [word]
        word = head.rstrip(AROUND)
    return [whole, model.restored(word[:LONG])]


def spaced_words(text: str, least: int = 4) -> list[str]:
    """Runs of ``least`` and more single characters, joined from each place where a word may start.

    Any white space may stand between the characters. Where a run has wider gaps too,
    these may part words: what stands between them is also joined on its own. From each
    place up to ``REACH`` characters are joined, so a long run costs no more a character than a short one.
    """
    out = []
    for run in SPACED.findall(text):
        for part in dict.fromkeys([run, *WIDER.split(run)]):
            joined = "".join(part.split())
            out += [joined[i : i + REACH] for i in range(len(joined) - least + 1)]
    return out


def tokens_of(text: str, tokens: list[str] | None = None) -> list[str]:
    """A text's tokens and its joined runs; tokens above ``LONG`` also as the words that signs part in them.

    ``tokens`` is the text's split, if it is at hand. Only a text with tokens of one character in a row has spaced words.
    """
    tokens = text.split() if tokens is None else tokens
    sizes = list(map(len, tokens))
    longest = max(sizes, default=0)
    out = tokens if longest < 256 and SINGLES not in bytes(sizes) else [*tokens, *spaced_words(text, LEAST_SPACED)]
    if longest <= LONG:
        return out
    out = list(out)
    for token in tokens:
        if len(token) > LONG:
            inner = APART.sub(" ", token)
            out += inner.split()
            out += spaced_words(inner, LEAST_SPACED)
    return out


def marks(word: str) -> list[str]:
    """What the lexicon knows a word by: the whole of it and its beginnings."""
    size = len(word)
    return [word + "$", *[word[:n] for n in STARTS if size > n]] if size > 2 else []


def words_of(text: str, model: CharModel, known: dict[str, list[str]]) -> list[str]:
    """The readings of a text's tokens; ``known`` holds those of tokens met before."""
    tokens = tokens_of(text)
    if len(known) >= KNOWN:
        known.clear()
    fresh = set(tokens).difference(known)
    known.update((token, readings(token, model)) for token in fresh)
    out = list(chain.from_iterable(map(known.__getitem__, tokens)))
    for token in fresh:
        if len(token) > LONG:
            del known[token]
    return out


@dataclass
class ToxicModel:
    chars: CharModel
    lexicon: dict[str, float]
    weights: np.ndarray

    def __post_init__(self):
        self.heads = {m[:4] for m in self.lexicon} | {m[:-1][:4] for m in self.lexicon if m.endswith("$")}
        self.bare = {RUNS.sub(r"\1", head) for head in self.heads}

    def may_mark(self, token: str) -> bool:
        """False for most tokens that have no mark: words without signs, by how they begin.

        Of letters alone, a restored word differs by fewer repeats only, so both begin alike without repeats.
        """
        word = token.lower()
        if not word.isalpha():
            if word[0] in LEADING:
                return True
            word = word.strip(AROUND)
            if not word.isalpha():
                return True
        if word[:4] in self.heads:
            return True
        if not DOUBLED.search(word):
            return False
        bare = RUNS.sub(r"\1", word[:LONG])
        return any(bare[:n] in self.bare for n in range(1, 5))

    def word_score(self, token: str) -> float:
        words = [w for w in readings(token, self.chars) if w[:4] in self.heads]
        return max((self.lexicon[m] for w in words for m in marks(w) if m in self.lexicon), default=0.0) if words else 0.0

    def features(self, text: str, cache: dict[str, float]) -> tuple[float, float, float, float]:
        split = text.split()
        tokens = set(tokens_of(text, split))
        new = {token: self.word_score(token) if self.may_mark(token) else 0.0 for token in tokens.difference(cache)}
        found = [score for score in map(cache.get, tokens) if score]
        found += [score for score in new.values() if score]
        if len(cache) >= KNOWN:
            cache.clear()
        cache.update(new)
        for token in new:
            if len(token) > LONG:
                del cache[token]
        found.sort(reverse=True)
        return (
            found[0] if found else 0.0, sum(found[:5]), float(min(len(found), 5)),
            math.log1p(100 * len(found) / max(len(split), 1)),
        )

    def score(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.weights[0] + rows @ self.weights[1:])


def _counted(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame({"gram": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})


def trigrams_of(tokens: Counter) -> Counter:
    """Trigrams of the plain words among ``tokens``, each token counted as often as given."""
    seen: Counter = Counter()
    for token, n in tokens.items():
        word = token.strip(AROUND)
        if word.isalpha():
            padded = f"^^{word}$"
            for i in range(len(padded) - 2):
                seen[padded[i : i + 3]] += n
    return seen


def char_model(rows: DataFrame) -> CharModel:
    """Trigrams of the plain words of the training rows, the most frequent kept."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter = Counter()
        for batch in batches:
            for text in batch.text:
                tokens.update(set(text.lower().split()))
                if len(tokens) >= PLACES:
                    yield _counted(trigrams_of(tokens))
                    tokens.clear()
        yield _counted(trigrams_of(tokens))

    grams = rows.select("text").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel({r.gram: r.n for r in grams.orderBy(F.desc("n"), "gram").limit(TRIGRAMS).collect()})


def _marked(marks: list[str], before: list[str | None], clean: list[int]) -> pd.DataFrame:
    texts = {name: pd.Series(values, dtype=object) for name, values in (("mark", marks), ("before", before))}
    return pd.DataFrame({**texts, "clean": pd.Series(clean, dtype="int64")})


def places_of(pairs: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """The places of a document's pairs of neighbouring words: each mark of the second with the first."""
    return {(m, before) for before, w in pairs for m in marks(w)}


def add_clean(pairs: set[tuple[str, str]], words: Counter, clean: Counter) -> None:
    """Count the places of a clean document: by word in ``words`` where its marks share no place, else by mark in ``clean``.

    Two words after the same one share a place if they begin alike; beginnings of ``STARTS[0]`` letters tell.
    """
    begins = [(before, w[: STARTS[0]]) for before, w in pairs if len(w) > STARTS[0]]
    if len(set(begins)) == len(begins):
        words.update([w for _, w in pairs])
        return
    shared = {begin for begin, n in Counter(begins).items() if n > 1}
    alike = {(before, w) for before, w in pairs if len(w) > STARTS[0] and (before, w[: STARTS[0]]) in shared}
    words.update([w for _, w in pairs - alike])
    clean.update(m for m, _ in places_of(alike))


def _toxic_marks(places: set[tuple[str, str]]) -> pd.DataFrame:
    return _marked([m for m, _ in places], [b for _, b in places], [0] * len(places))


def _clean_marks(words: Counter, clean: Counter) -> pd.DataFrame:
    for word, n in words.items():
        for mark in marks(word):
            clean[mark] += n
    return _marked(list(clean), [None] * len(clean), list(clean.values()))


def toxic_lexicon(rows: DataFrame, chars: CharModel) -> dict[str, float]:
    """Words and beginnings whose places are toxic far more often than chance.

    A place is a mark with the word before it. Toxic places count once over all rows, so
    that copies of one document are no evidence of their own; clean ones once per row. A mark is
    kept if most of its places are toxic and the log-likelihood gain over the overall
    share is at least ``LEAST_EVIDENCE``.
    """

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean: Counter = Counter()
        clean_words: Counter = Counter()
        toxic: set[tuple[str, str]] = set()
        known: dict[str, list[str]] = {}
        for batch in batches:
            for text, y in zip(batch.text, batch.y):
                words = words_of(text, chars, known)
                pairs = set(zip(["", *words], words))
                if y:
                    toxic |= places_of(pairs)
                else:
                    add_clean(pairs, clean_words, clean)
                if len(toxic) >= PLACES:
                    yield _toxic_marks(toxic)
                    toxic.clear()
                if len(clean) + 4 * len(clean_words) >= PLACES:
                    yield _clean_marks(clean_words, clean)
                    clean_words.clear()
                    clean.clear()
        yield _toxic_marks(toxic)
        yield _clean_marks(clean_words, clean)

    rows = rows.mapInPandas(seen, "mark string, before string, clean long").groupBy("mark", "before").agg(F.sum("clean").alias("clean"))
    counts = rows.groupBy("mark").agg(F.count("before").alias("t"), F.sum("clean").alias("c"))
    counts = write_through(counts, "toxic-marks")
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not total.t or not total.c:
        return {}
    share = total.t / (total.t + total.c)
    p = F.col("t") / (F.col("t") + F.col("c"))
    gain = F.col("t") * F.log(p / share) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    smooth = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5)) - math.log(share / (1 - share))
    kept = counts.filter("t > 2 and t > c").select("mark", gain.alias("gain"), smooth.alias("weight")).filter(F.col("gain") >= LEAST_EVIDENCE)
    return {r.mark: r.weight for r in kept.orderBy(F.desc("gain"), "mark").limit(LEXICON_ROWS).collect()}


def lexical_model(rows: DataFrame) -> ToxicModel:
    """What the texts of the training rows teach; its weights call nothing toxic."""
    chars = char_model(rows)
    return ToxicModel(chars, toxic_lexicon(rows, chars), np.array([-8.0, 0, 0, 0, 0]))


def finds(rows: DataFrame, model: ToxicModel) -> DataFrame:
    """``rows`` with the features a, b, c, d of ``text`` in its place."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for batch in batches:
            found = np.array([model.features(t, cache) for t in batch.pop("text")]).reshape(-1, 4)
            yield batch.assign(**dict(zip("abcd", found.T)))

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInPandas(measure, ", ".join([*kept, *(f"{c} double" for c in "abcd")]))


def learn(model: ToxicModel, found: DataFrame) -> ToxicModel:
    """``model`` with the weights of a regression of ``y`` on a, b, c, d; unchanged without rows of both kinds."""
    seen = write_through(found.groupBy("a", "b", "c", "d", "y").agg(F.count("*").alias("n")), "toxic-features")
    weights = fit_logistic(seen, list("abcd"))
    if weights is not None:
        model.weights = weights
    return model


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on all labelled rows that are not held out; only the model's counts and the regression's sums come to the driver.

    Without toxic training rows nothing is toxic; without any rows likewise.
    """
    rows = write_through(training_rows(docs, labels, "toxic"), "toxic-train")
    model = lexical_model(rows)
    return learn(model, finds(rows.select("text", "y"), model))


def scorer(model: ToxicModel):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for texts in batches:
            yield pd.Series(model.score(np.array([model.features(t, cache) for t in texts]).reshape(-1, 4)))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null texts count as empty; empty texts have no finds and get the lowest score.
    Repeated rows are scored alike; a null doc_id is not held out. Each text is measured once, for
    the fit and for its score.
    """
    model = lexical_model(write_through(training_rows(docs, labels, "toxic"), "toxic-train"))
    found = finds(docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text")), model)
    found = write_through(found, "toxic-finds")
    learn(model, found.join(known_labels(labels, "toxic"), "doc_id"))

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([a, b, c, d])))

    scored = found.select("doc_id", "held_out", score("a", "b", "c", "d").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored at or above the threshold."""
    return docs.filter(scorer(fit(docs, labels))(whole_text()) < threshold)


