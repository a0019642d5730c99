"""Text quality from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale.llm.common import fresh, hash_order
from pagescale.llm.subwords import CACHE
from pagescale.session import cut_lineage

SAMPLE = 2000
MAX_CHARS = 200_000
BITS = 15
USUAL = frozenset(".,;:!?'\"()”“’…-")


class Signs(dict):
    """Word to three bits: ends in an unusual symbol, in a doubled one, stands in capitals. Forgets all when it holds too many."""

    def __missing__(self, w: str) -> int:
        if len(self) > CACHE:
            self.clear()
        symbol = not w[-1].isalnum()
        self[w] = bits = (symbol and w[-1] not in USUAL) + 2 * (symbol and len(w) > 1 and w[-1] == w[-2]) + 4 * (len(w) > 2 and w.isupper())
        return bits


SIGNS = Signs()


def labels_of(text: str | None) -> tuple[int, ...]:
    """The votes of all labellers on a whole text: 1 (good), -1 (bad) or 0 (does not know).

    Symbols after words, words in capitals, variety of words among each eight, repeated lines, number of words, mean
    length of words, and how lines end. All but the fifth are shares, so they do not depend on the text's length.
    """
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    signs = bytes(map(SIGNS.__getitem__, words))
    odd, double, loud = (sum(signs.count(b) for b in range(8) if b & bit) / n for bit in (1, 2, 4))
    again = repeats(words)
    lines = [x for x in text.split("\n") if len(x.split()) > 2]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    mean = len(text) / n
    ends = sum(x.rstrip()[-1:] in ".!?:" for x in lines) / max(1, len(lines))
    return (
        vote(odd < 0.03, odd > 0.2), vote(double < 0.03, double > 0.2), vote(loud < 0.05, loud > 0.5), vote(again < 0.15, again > 0.4),
        vote(repeated < 0.1, repeated > 0.4), vote(n > 20, n < 4), vote(3.5 < mean < 10, mean > 14 or mean < 2.5), vote(ends > 0.8, ends < 0.2),
    )


@F.pandas_udf(T.StringType())
def voted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: ",".join(map(str, labels_of(x))))


def accuracies(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of a good text for each pattern of votes, and each labeller's chances of -1, 0, 1 under bad and good.

    Labellers are independent given the truth. A bad text seldom has more than one fault, so the start takes a text with
    any bad vote for bad. Counts of patterns stand for all rows.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((0, 2, 3))
    table = np.array([[int(v) + 1 for v in k.split(",")] for k in keys])
    count = np.array([patterns[k] for k in keys], float)
    good = np.where((table == 0).any(1), 0.1, 0.9)
    for _ in range(rounds):
        chance = np.zeros((table.shape[1], 2, 3))
        for y, weight in enumerate((count * (1 - good), count * good)):
            for j in range(table.shape[1]):
                chance[j, y] = np.bincount(table[:, j], weight, 3) + 1.0
        chance /= chance.sum(2, keepdims=True)
        prior = np.clip((count * good).sum() / count.sum(), 1e-3, 1 - 1e-3)
        odds = np.log(prior / (1 - prior)) + sum(np.log(chance[j, 1, table[:, j]] / chance[j, 0, table[:, j]]) for j in range(table.shape[1]))
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, good.tolist())), chance


def word_features(word: str) -> list[int]:
    """Hashed shape, ending, length and, for short words, the word."""
    shape = re.sub(r"(.)\1{2,}", r"\1\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word[:40]))
    names = (f"s{shape}", f"e{word[-2:]}", f"l{min(len(word), 30) // 3}", f"w{word[:8].lower()}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    repeat: float

    def score(self, text: str | None, cache: Weights) -> float:
        words = (text or "").split()
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        z = self.bias + sum(map(cache.__getitem__, words)) / len(words) + self.repeat * repeats(words)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Weights(dict):
    """Word to its mean weight under a scorer; forgets all when it holds too many."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.weights = scorer.weights

    def __missing__(self, w: str) -> float:
        if len(self) > CACHE:
            self.clear()
        self[w] = weight = float(self.weights[word_features(w)].mean())
        return weight


def repeats(words: list[str]) -> float:
    """Share of words that repeat one of the eight before them; it does not depend on the text's length."""
    last: dict[str, int] = {}
    found = 0
    for i, w in enumerate(words):
        found += i - last.get(w, -9) <= 8
        last[w] = i
    return found / max(1, len(words))


def fit(texts: list[str], good: list[float], steps: int = 100, rate: float = 0.3, ridge: float = 1e-5) -> Scorer:
    """Logistic regression on mean hashed features with posteriors as targets, by Adam on all rows."""
    from pagescale.llm.crf import Adam

    split = [t.split() for t in texts]
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], dtype=np.int64)
    doc = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
    table = np.array([word_features(w) for w in number], dtype=np.int64).reshape(-1, 4)
    size = np.maximum(1, np.array([len(ws) for ws in split]))
    again, target = np.array([repeats(ws) for ws in split]), np.array(good)
    w, adam = {"w": np.zeros(1 << BITS), "b": np.zeros(1), "r": np.zeros(1)}, Adam(rate)
    for _ in range(steps if len(texts) else 0):
        z = np.bincount(doc, w["w"][table].mean(1)[ids], len(split)) / size + w["b"] + w["r"] * again
        delta = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(split)
        by_word = np.bincount(ids, (delta / size)[doc], len(number)) / 4
        g = np.bincount(table.ravel(), np.repeat(by_word, 4), 1 << BITS) + ridge * w["w"] / len(split)
        adam.step(w, {"w": g, "b": np.array([delta.sum()]), "r": np.array([delta @ again])})
    return Scorer(w["w"], float(w["b"][0]), float(w["r"][0]))


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, max_chars: int = MAX_CHARS, seed: int = 29) -> tuple[Scorer, dict[str, float]]:
    """The scorer and the posterior of each pattern. Patterns are counted over all rows; the scorer fits on `sample` rows."""
    marked = cut_lineage(docs.select("doc_id", voted(F.col(text_col)).alias("votes")), "votes")
    posterior, _ = accuracies({r.votes: r["count"] for r in marked.groupBy("votes").count().collect()})
    ids = marked.orderBy(hash_order(F.col("doc_id"), seed), "votes").limit(sample)
    texts = docs.select("doc_id", F.col(text_col).alias("text")).where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "votes").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [posterior[r.votes] for r in rows]), posterior


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Every row with its quality between 0 and 1. Null and empty texts have the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = Weights(shared.value)
        for batch in batches:
            yield pd.Series([shared.value.score(x, cache) for x in batch], dtype="float64")

    return docs.withColumn(out_col, scored(F.col(text_col)))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns unchanged."""
    name = fresh(docs, "quality_score")
    return score(docs, train(docs)[0], out_col=name).where(F.col(name) >= threshold).drop(name)
