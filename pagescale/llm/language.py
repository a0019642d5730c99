"""Language identification: a conditional random field labels the words of a text, which may change its language."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagescale.llm import crf
from pagescale.llm.common import fold, hash_order
from pagescale.llm.subwords import CACHE, LONG

FOLDS, HELD_OUT = 4, 2
DOCS_PER_LANG = 150
WORDS_PER_LANG = 40_000
MAX_CHARS = 200_000
CHAIN = 64
BITS = 16
LEXICON = 300
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Hashed affixes of 1 to 3 letters, n-grams of 2 to 4 of the marked word, and the languages whose lexicon holds the word."""
    marked = f"<{word}>"
    names = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    names += [f"g{marked[i : i + n]}" for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    names += [f"l{k}" for k in lexicon.get(word, [])] * 3
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


@dataclass
class Model:
    langs: list[str]
    emit: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    lexicon: dict[str, list[int]]


class Emissions(dict):
    """The place of each word's emission scores in one growing array; forgets all when it holds too many words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.langs)))

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == self.rows.shape[0]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = self.model.emit[features(word[:LONG] + word[-LONG:] if len(word) > 2 * LONG else word, self.model.lexicon)].mean(0)
        self[word] = i
        return i

    def take(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        places = [self[w] for w in words]  # may enlarge the array
        return self.rows[places]


def fit(texts: list[str], langs: list[str], words_per_lang: int = WORDS_PER_LANG, steps: int = 80, seed: int = 5) -> Model:
    """Learn from whole labelled texts, of each language up to about `words_per_lang` words in the order given.

    Each word has the label of its text. Chains are cut from the texts; every second one is made of pieces of two
    texts, so that changes of language within a chain are seen and their weights learned.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    pieces: list[tuple[int, list[str]]] = []
    held, counts = Counter(), [Counter() for _ in names]
    for text, lang in zip(texts, langs):
        k = names.index(lang)
        if held[k] >= words_per_lang:
            continue
        own = words_of(text)
        held[k] += len(own)
        counts[k].update(set(own))
        pieces += [(k, own[i : i + CHAIN // 2]) for i in range(0, len(own), CHAIN // 2)]
    lexicon: dict[str, list[int]] = {}
    for k, c in enumerate(counts):
        for word, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n > 2:
                lexicon.setdefault(word, []).append(k)
    if not pieces:
        return Model(names or [UNKNOWN], np.zeros((1 << BITS, max(1, len(names)))), np.zeros(max(1, len(names))), np.zeros((max(1, len(names)),) * 2), {})
    order = rng.permutation(len(pieces))
    chains = [[pieces[i]] for i in order[: len(order) // 3]]
    rest = order[len(order) // 3 :]
    chains += [[pieces[i], pieces[j]] for i, j in zip(rest[::2], rest[1::2])]
    number: dict[str, int] = {}
    kinds = np.array([number.setdefault(w, len(number)) for c in chains for _, p in c for w in p])
    labels = np.array([k for c in chains for k, p in c for _ in p])
    sizes = np.array([sum(len(p) for _, p in c) for c in chains])
    bags = [features(w, lexicon) for w in number]
    owner, flat = np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([f for b in bags for f in b])
    w = crf.fit(flat, owner, kinds, labels, sizes, 1 << BITS, len(names), steps=steps, rate=0.3, ridge=1e-6, batch=600)
    return Model(names, w["emit"], w["start"], w["trans"], lexicon)


def train(spark: SparkSession, docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, max_chars: int = MAX_CHARS, seed: int = 13) -> Model:
    """Fit on at most `docs_per_lang` labelled documents of each language outside the held-out fold, chosen by hash.

    Those bounds and `words_per_lang` hold for the fit alone; every text is labelled whole.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & (F.length("text").between(1, max_chars)))
    ids = known.select("doc_id", "lang", hash_order(F.col("doc_id"), seed).alias("_h")).withColumn("_r", rank).where(F.col("_r") <= docs_per_lang)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "lang", "_h")), "doc_id")  # docs_per_lang rows a language
    rows = rows.select("_h", "doc_id", "lang", "text").collect()
    rows = sorted((r for r in rows if r.text), key=lambda r: (r._h, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def label(texts: list[str | None], model: Model, emissions: Emissions) -> tuple[list[np.ndarray], np.ndarray]:
    """The posterior languages of every word of every text, by forward-backward; chains of CHAIN words end to end."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    scores = emissions.take([w for own in words for w in own]) if sizes.sum() else np.zeros((0, len(model.langs)))
    chains = np.concatenate([np.append(np.full(n // CHAIN, CHAIN), n % CHAIN if n % CHAIN else []) for n in sizes]).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    if not chains.size:
        return [np.zeros((0, len(model.langs)))] * len(texts), sizes
    order = np.argsort(chains, kind="stable")
    ends = np.concatenate([[0], np.cumsum(chains)])
    out = np.zeros_like(scores)
    for part in np.array_split(order, max(1, order.size // 2000)):
        places = np.repeat(ends[part], chains[part]) + np.arange(chains[part].sum()) - np.repeat(np.cumsum(chains[part]) - chains[part], chains[part])
        padded, mask = crf.pad(scores[places], chains[part])
        out[places] = crf.forward_backward(padded, mask, model.start, model.trans)[0][mask]
    return np.split(out, np.cumsum(sizes)[:-1]), sizes


STEP = 256


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with `lang_pred`, `score` and `mix`: the language with most of the words' posterior, its share, and all shares.

    A null text, or one without a letter, is `und` with score 0. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, mix array<double>")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        emissions = Emissions(own)
        for batch in batches:
            rows, texts = [], batch.tolist()
            for at in range(0, len(texts), STEP):
                for posterior in label(texts[at : at + STEP], own, emissions)[0]:
                    if not len(posterior):
                        rows.append((UNKNOWN, 0.0, [0.0] * len(own.langs)))
                        continue
                    share = posterior.mean(0)
                    rows.append((own.langs[int(share.argmax())], float(min(1.0, share.max())), share.tolist()))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "mix"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "mix", "_l")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], labelled(F.col(text_col)).alias("_l")).select(*[F.col(f"`{c}`") for c in kept], "_l.lang_pred", "_l.score", "_l.mix")
