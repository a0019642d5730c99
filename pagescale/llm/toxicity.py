"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.llm.common import fold, fresh, hash_order
from pagescale.llm.subwords import WORD, Ragged, WordScores, sums, word_buckets

FOLDS = 5
DOCS_PER_LABEL = 1500
MAX_CHARS = 200_000
WINDOW = 8
SCORED = 1024
BITS = 17


def tokens(text: str | None) -> list[str]:
    """The words of a text; a word said over and over counts once for each run."""
    words = WORD.findall((text or "").lower())
    return [w for w, last in zip(words, ["", *words]) if w != last]


@dataclass
class Model:
    """What scoring needs: for each n-gram bucket its share of the logit, the bias, and the calibration of a document's highest window."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    low: float = -np.inf
    high: float = np.inf

    def score(self, words: list[str], values: WordScores) -> float:
        return float(self.calibrated(self.highest(values.of(words))))

    def highest(self, values: np.ndarray, window: int = WINDOW) -> float:
        """The highest logit of the windows of so many words, each half a window after the last; they cover all words."""
        n = values.size
        if not n:
            return self.low if np.isfinite(self.low) else self.bias
        if n <= window:
            return self.bias + values.mean()
        run = np.concatenate([[0.0], np.cumsum(values)])
        starts = np.append(np.arange(0, n - window, window // 2), n - window)
        return self.bias + float(((run[starts + window] - run[starts]) / window).max())

    def calibrated(self, logit: float) -> float:
        return 1.0 / (1.0 + np.exp(-(self.scale * np.clip(logit, self.low, self.high) + self.shift)))


def windows(docs: list[np.ndarray], kept: np.ndarray, window: int) -> tuple[Ragged, np.ndarray]:
    """The kept documents cut into runs of so many words, and the document of each run."""
    chosen = [d for d in np.flatnonzero(kept) if docs[d].size]
    sizes = np.array([docs[d].size for d in chosen], dtype=np.int64)
    counts = -(-sizes // window)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    runs = Ragged([])
    runs.sizes = np.minimum(window, np.repeat(sizes, counts) - inner * window)
    runs.starts = np.concatenate([[0], np.cumsum(runs.sizes)])
    runs.flat = np.concatenate([docs[d] for d in chosen]) if chosen else np.zeros(0, np.int32)
    return runs, np.repeat(np.array(chosen, dtype=np.int64), counts)


def fit(texts: list[str], labels: list[int], prior: float, bits: int = BITS, dim: int = 8, window: int = WINDOW, epochs: int = 6, batch: int = 64, updates: int = 120, rate: float = 0.5, least_docs: int = 4, strong: float = 8.0, clean_share: int = 4, damp: float = 1e-6, seed: int = 3) -> Model:
    """Train embeddings and softmax together by AdaGrad on windows of words.

    A label holds for a document, not for each of its windows: of a toxic document only those windows train that hold
    an n-gram which toxic documents hold far more often (first epoch) or that the model itself finds toxic (later), the
    highest one at least. Each epoch draws anew up to `clean_share` clean windows for each toxic one. Three of ten documents are kept back
    to calibrate a document's highest window to probabilities under `prior`, the share of toxic rows. N-grams that
    fewer than `least_docs` documents hold stay 0.
    """
    if len(set(labels)) < 2:  # nothing to tell apart: every text has the prior
        return Model(np.zeros(1 << bits, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in tokens(t)], dtype=np.int32) for t in texts]
    y, kept = np.array(labels), np.arange(len(texts)) % 10 < 7
    grams = word_buckets(list(number), bits)
    seen = np.zeros((2, 1 << bits))
    for d in np.flatnonzero(kept):
        if docs[d].size:
            seen[y[d], np.unique(grams.take(np.unique(docs[d]))[0])] += 1
    n_clean, n_toxic = max(1, (y[kept] == 0).sum()), max(1, (y[kept] == 1).sum())
    share_all = seen.sum(0) / (n_clean + n_toxic)
    lift = (seen[1] / n_toxic - seen[0] / n_clean) / np.sqrt(share_all * (1 - share_all) * (1 / n_toxic + 1 / n_clean) + 1e-9)
    common, sizes_all = seen.sum(0) >= least_docs, grams.sizes
    lift_word = np.maximum.reduceat(lift[grams.flat], grams.starts[:-1]) if number else np.zeros(0)
    ragged = grams.where(common)
    del grams
    cut, owner_doc = windows(docs, kept, window)

    def start():
        table, out = rng.normal(0, 0.1, (1 << bits, dim)) * common[:, None], rng.normal(0, 0.3, (dim, 2))
        return table, out, np.zeros(2), np.full(1 << bits, damp), np.full((dim, 2), 1e-6), np.full(2, 1e-6)

    table, out, bias, seen_table, seen_out, seen_bias = start()

    def forward(part: np.ndarray):
        words, seg = cut.take(part)
        distinct, place = np.unique(words, return_inverse=True)
        flat, owner = ragged.take(distinct)
        vectors = sums(owner, table[flat], distinct.size) / sizes_all[distinct][:, None]
        sizes = np.bincount(seg, minlength=part.size)[:, None]
        hidden = sums(seg, vectors[place], part.size) / sizes
        logits = hidden @ out + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        return hidden, odds / odds.sum(1, keepdims=True), (seg, sizes, place, distinct, flat, owner)

    first = np.maximum.reduceat(lift_word[cut.flat], cut.starts[:-1]) if owner_doc.size else np.zeros(0)
    for epoch in range(epochs if (y[owner_doc] == 1).any() and (y[owner_doc] == 0).any() else 0):
        sign, sure = (first, strong) if epoch == 0 else (np.concatenate([forward(x)[1][:, 1] for x in np.array_split(np.arange(owner_doc.size), max(1, owner_doc.size // SCORED))]), 0.9)
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, owner_doc, sign)
        use = np.flatnonzero((y[owner_doc] == 0) | (sign >= np.minimum(sure, top[owner_doc])))
        if epoch == 2:
            table, out, bias, seen_table, seen_out, seen_bias = start()
        toxic, clean = use[y[owner_doc[use]] == 1], use[y[owner_doc[use]] == 0]
        drawn = np.concatenate([toxic, rng.permutation(clean)[: clean_share * toxic.size]])
        share = toxic.size / drawn.size
        parts = []
        while len(parts) < updates:  # a small sample is read more than once in an epoch
            parts += np.array_split(rng.permutation(drawn), max(1, drawn.size // batch))
        for part in parts:
            hidden, p, (seg, sizes, place, distinct, flat, owner) = forward(part)
            target = y[owner_doc[part]]
            weight = np.where(target == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))[:, None]
            delta = (p - np.eye(2)[target]) * weight / part.size
            g_out, g_bias = hidden.T @ delta, delta.sum(0)
            g_words = sums(place, ((delta @ out.T) / sizes)[seg], distinct.size) / sizes_all[distinct][:, None]
            touched, at = np.unique(flat, return_inverse=True)
            g_table = sums(at, g_words[owner], touched.size)
            seen_table[touched] += (g_table**2).mean(1)
            table[touched] -= rate * g_table / np.sqrt(seen_table[touched])[:, None]
            seen_out += g_out**2
            out -= 0.1 * g_out / np.sqrt(seen_out)
            seen_bias += g_bias**2
            bias -= 0.1 * g_bias / np.sqrt(seen_bias)
    direction = out[:, 1] - out[:, 0]
    model = Model((table @ direction).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    values = WordScores(model.weights)
    words = np.array([values[w] for w in number])
    held = np.flatnonzero(~kept) if len(docs) >= 10 else np.arange(len(docs))
    top = np.array([model.highest(words[docs[d]] if docs[d].size else np.zeros(0)) for d in held])
    model.low, model.high = (float(x) for x in np.percentile(top, (1, 99)))
    model.scale, model.shift = calibrate(np.clip(top, model.low, model.high), y[held], prior)
    return model


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, rows weighted to the prior; a small ridge keeps it finite."""
    if len(set(y.tolist())) < 2:
        return 1.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    at, spread = np.median(x), x.std() + 1e-9
    design, beta = np.stack([(x - at) / spread, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-2 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
    return float(beta[0] / spread), float(beta[1] - beta[0] * at / spread)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL, max_chars: int = MAX_CHARS, seed: int = 11) -> Model:
    """Fit on at most `docs_per_label` labelled documents of each label outside the held-out fold.

    The bounds on documents and on the length of a training text are the only ones: the share of toxic rows is counted
    over all labels, and every text is scored whole.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != 0)).select("doc_id", "toxic")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(hash_order(F.col("doc_id"), seed)).limit(docs_per_label)
        ids = part if ids is None else ids.unionByName(part)
    chosen = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = sorted((hash(r.doc_id), r.text, r.toxic) for r in chosen.select("doc_id", "text", "toxic").collect())
    order = np.random.default_rng(seed).permutation(len(rows))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([rows[i][1] for i in order], [rows[i][2] for i in order], prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Every row with the probability that its whole text is toxic. Null and empty texts, and those
    without a word, score as the cleanest text does."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        values = WordScores(shared.value.weights)
        for batch in batches:
            yield pd.Series([shared.value.score(tokens(x), values) for x in batch], dtype="float64")

    return docs.withColumn(out_col, scored(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under the threshold, with their columns unchanged."""
    name = fresh(docs, "toxic_score")
    return score(docs, train(docs.sparkSession, docs, labels), out_col=name).where(F.col(name) < threshold).drop(name)
