"""Character n-grams of words, hashed: shared by the text models."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.llm.common import hash_order

WORD = re.compile(r"\w+")
CACHE = 400_000
LONG = 64


def grams(word: str, low: int = 3, high: int = 5) -> list[str]:
    """The word between its marks, then its n-grams."""
    marked = f"<{word}>"
    return [marked, *(marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1))]


def buckets(word: str, bits: int, low: int = 3, high: int = 5) -> np.ndarray:
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in grams(word, low, high)], dtype=np.int64) & ((1 << bits) - 1)


class WordScores(dict):
    """One number per word: the mean of its buckets' weights. Forgets all when it holds too many words."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.bits = weights, int(weights.size).bit_length() - 1

    def __missing__(self, word: str) -> float:
        value = float(self.weights[buckets(word, self.bits)].mean())
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.array([self[w] for w in words])


class Ragged:
    """Lists of bucket numbers of distinct words, laid end to end."""

    def __init__(self, lists: list[np.ndarray]):
        self.sizes = np.array([x.size for x in lists], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the chosen rows and, for each, the place of its row in the choice."""
        sizes = self.sizes[rows]
        owner = np.repeat(np.arange(rows.size), sizes)
        inner = np.arange(owner.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[self.starts[rows][owner] + inner], owner

    def where(self, held: np.ndarray) -> Ragged:
        """The same rows with the held buckets alone."""
        keep = held[self.flat]
        out = Ragged([])
        out.starts = np.concatenate([[0], np.cumsum(keep)])[self.starts]
        out.sizes, out.flat = np.diff(out.starts), self.flat[keep]
        return out


def word_buckets(words: list[str], bits: int, at_once: int = 4096) -> Ragged:
    """The buckets of all words, in 32 bits; lists of single words last for `at_once` words only."""
    parts = [Ragged([buckets(w, bits) for w in words[i : i + at_once]]) for i in range(0, len(words), at_once)]
    out = Ragged([])
    if parts:
        out.sizes, out.flat = np.concatenate([x.sizes for x in parts]), np.concatenate([x.flat.astype(np.int32) for x in parts])
        out.starts = np.concatenate([[0], np.cumsum(out.sizes)])
    return out


def sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of `values` added up by owner."""
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], axis=1)


def labelled_sample(rows: DataFrame, id_col: str, label: Column, values: list, per_value: int, max_chars: int, text: Column, seed: int) -> DataFrame:
    """At most `per_value` rows of each label, in hash order of their ids: columns id, label, text."""
    rows = rows.where(F.length(text) <= max_chars).select(F.col(id_col).alias("id"), label.alias("label"), text.alias("text"))
    parts = [rows.where(F.col("label") == v).orderBy(hash_order(F.col("id"), seed), "id").limit(per_value) for v in values]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
