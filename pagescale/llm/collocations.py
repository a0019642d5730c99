"""Collocations: phrases whose count exceeds what their parts' counts explain, counted in mergeable quotient filters.

A word's id is a 64-bit hash that is checked to tell all words of the corpus apart. Texts are read once for each phrase
length. A phrase can only be frequent if its words and shorter phrases are, so a bit table of the frequent ones, of
bounded size, keeps most others out of the filters; what it lets through by chance costs work and never a count.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescale.llm.common import word_slices
from pagescale.llm.quotient_filter import Filter, mixed, restored
from pagescale.session import cut_lineage, discard

HELD_WORDS = 1 << 18
HELD_KEYS = 1 << 18
BUCKET_WORDS = 1 << 19
MARK_BITS = 27
HOT_SHARE = 1000
SLICES = (4096, 64, 1)
UNKNOWN = "und"
BREAK = b"."
# fixed values: A-Z in lower case, the piece ends . , ; : ! ? and line ends as one sign, tabs as spaces
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def sliced(batch: pa.RecordBatch) -> Iterator[tuple[str, bool, list[bytes]]]:
    """(language, whether it begins anew, words and breaks) of a batch, a bounded number of bytes at a time."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        if text:
            texts.setdefault(UNKNOWN if lang is None else lang, []).append(text)
    for lang, own in texts.items():
        data = BREAK.join(own).translate(TABLE).replace(BREAK, b" . ")
        for i, words in enumerate(word_slices(data)):
            yield lang, i == 0, words


class Ids(dict):
    """Word to id; forgets all words when it holds too many."""

    def __init__(self, seed: int):
        super().__init__({BREAK: 0})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
            self[BREAK] = 0
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, n): the occurrences of every word, added up in a task before they move."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            words = list(own)
            ids = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64).view(np.int64)
            columns = [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ids), pa.array(list(own.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, _, words in sliced(batch):
                counts.setdefault(lang, Counter()).update(words)
                counts[lang].pop(BREAK, None)
                if sum(map(len, counts.values())) > HELD_WORDS:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def place(words: list[np.ndarray], lang: str, bits: int) -> np.ndarray:
    """The place of phrases of a language in a bit table."""
    out = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for w in words:
        out = mixed(out ^ w)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def marks(grams: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, table): a bit for every phrase (lang, ids), in a table of at most 2**MARK_BITS bits whatever their number."""
    bits = int(min(MARK_BITS, max(10, (8 * grams.count()).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            ids = batch.column("ids").flatten().to_numpy().view(np.uint64)
            ids = ids.reshape(len(langs), -1) if len(langs) else ids.reshape(0, 1)
            for lang in dict.fromkeys(langs):
                at = place(list(ids[langs == lang].T), lang, bits)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["block", "bit"])

    blocks = grams.select("lang", "ids").mapInArrow(run, "block long, bit long").groupBy("block").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    table[blocks.column("block").to_numpy()] = blocks.column("bit").to_numpy().view(np.uint64)
    return bits, table


def marked(words: list[np.ndarray], lang: str, bits: int, table: np.ndarray) -> np.ndarray:
    at = place(words, lang, bits)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def gram_counts(docs: DataFrame, n: int, seed: int, parts: list[tuple[int, np.ndarray]], bucket_bits: int, min_count: int) -> DataFrame:
    """(lang, ids, a): the phrases of n words that occur at least `min_count` times.

    `parts` has the bit tables of frequent words and of frequent phrases of 2 to n - 1 words. Each task keeps one filter
    a language, of bounded size, and sends it on in buckets of the quotient; a bucket's filters are merged in one place.
    Quotients are even whatever the words are, so no phrase and no word makes a bucket large.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # at most 2**MARK_BITS bits each

    def occurring(lang: str, ids: np.ndarray) -> list[np.ndarray]:
        """The n columns of the phrases that may be frequent."""
        for size, (bits, table) in enumerate(shared.value, start=1):
            columns = [ids[i : len(ids) - size + 1 + i] for i in range(size)]
            if size == 1:
                ids = np.where(marked(columns, lang, bits, table), ids, np.uint64(0))
                at = np.arange(max(0, len(ids) - n + 1))
                for i in range(n):
                    at = at[ids[at + i] != 0]
            else:
                for i in range(n - size + 1):
                    at = at[marked([ids[at + i + j] for j in range(size)], lang, bits, table)]
        return [ids[at + i] for i in range(n)]

    def sent(lang: str, own: Filter) -> Iterator[pa.RecordBatch]:
        buckets = list(own.buckets(bucket_bits))
        for i in range(0, len(buckets), 256):
            some = buckets[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([b for b, _ in some], pa.int64()), pa.array([f.packed(bucket_bits) for _, f in some], pa.binary())], names=["lang", "bucket", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, carry = Ids(seed), {}, {}
        for batch in batches:
            for lang, anew, words in sliced(batch):
                own = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
                if not anew:
                    own = np.concatenate([carry[lang], own])
                carry[lang] = own[max(0, len(own) - n + 1) :]
                filters = held.setdefault(lang, [])
                filters.append(Filter.counted(occurring(lang, own)))
                if sum(map(len, filters)) > HELD_KEYS:
                    held[lang] = filters = [Filter.merged(filters)]
                    if 2 * len(filters[0]) > HELD_KEYS:
                        yield from sent(lang, filters[0])
                        held[lang] = []
            if sum(len(f) for x in held.values() for f in x) > 2 * HELD_KEYS:  # many languages
                for lang, filters in held.items():
                    yield from sent(lang, Filter.merged(filters)) if filters else ()
                held = {}
        for lang, filters in held.items():
            if filters:
                yield from sent(lang, Filter.merged(filters))

    def merge(key, table):
        whole = Filter.merged([Filter.unpacked(x, int(key[1]), bucket_bits) for x in table["filter"]])
        enough = whole.counts >= min_count
        words = np.stack(restored([k[enough] for k in whole.keys]), axis=1).view(np.int64)
        return pa.table({"lang": pa.array([key[0]] * len(words), pa.string()), "ids": pa.array(list(words), pa.list_(pa.int64())), "a": pa.array(whole.counts[enough], pa.int64())}).to_pandas()

    filters = docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, filter binary")
    return filters.groupBy("lang", "bucket").applyInPandas(merge, "lang string, ids array<long>, a long")


def counts_of(rows: DataFrame, part: Column, parts: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """The rows with the count of a part, looked up in `parts`; every part is there.

    Parts that make up one in HOT_SHARE of all words meet their rows by broadcast; those rows then look for a key of their
    own in the shuffled join, so that none of its keys is hot.
    """
    near = hot.select(F.col("lang").alias("_hl"), F.col("ids").alias("_hi"), F.col("a").alias("_ha"))
    far = parts.select(F.col("lang").alias("_l"), F.col("ids").alias("_i"), F.col("a").alias("_a"))
    rows = rows.withColumn("_part", part).join(F.broadcast(near), (F.col("lang") == F.col("_hl")) & (F.col("_part") == F.col("_hi")), "left")
    rows = rows.withColumn("_key", F.when(F.col("_ha").isNull(), F.col("_part")).otherwise(F.array(F.xxhash64("ids", "cut"))))
    rows = rows.join(far, (F.col("lang") == F.col("_l")) & (F.col("_key") == F.col("_i")), "left")
    return rows.withColumn(name, F.coalesce("_ha", "_a")).drop("_part", "_key", "_hl", "_hi", "_ha", "_l", "_i", "_a")


def scored(grams: DataFrame, parts: DataFrame, hot: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, score) of the lowest cut of every phrase; equal scores to the earliest cut."""
    cuts = grams.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = counts_of(cuts, F.slice("ids", F.lit(1), F.col("cut")), parts, hot, "l")
    cuts = counts_of(cuts, F.slice("ids", F.col("cut") + 1, F.size("ids") - F.col("cut")), parts, hot, "r")
    # in decimals of 38 digits: exact for counts under 10**16
    score = F.expr("(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) * 1000000BD) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    lowest = cuts.groupBy("lang", "ids", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    return lowest.select("lang", "ids", "a", "x.l", "x.r", "x.score")


def uncovered(grams: DataFrame, longest: int, percent: int) -> DataFrame:
    """Without the phrases inside a longer one that has at least `percent` of their count."""
    n = F.size("ids")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice("ids", i, k))))
    inside = grams.where(n > 2).select(F.col("lang").alias("_l"), F.explode(spans).alias("_i"), "a").groupBy("_l", "_i").agg(F.max("a").alias("_most"))
    out = grams.join(inside, (F.col("lang") == F.col("_l")) & (F.col("ids") == F.col("_i")), "left")
    return out.where(F.col("_most").isNull() | (100 * F.col("_most") < percent * F.col("a"))).drop("_l", "_i", "_most")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, min_count: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to `longest` words of every language.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and those into words at spaces and tabs. A
    phrase is a run of words of a piece that occurs at least `min_count` times. Cut after its first words, it scores
    floor(1000000 a a / (l r)), with a, l and r the counts of the phrase and its two parts; its lowest cut counts. Phrases
    inside a longer one with `percent` of their count are left out. Equal scores go by count, then by phrase in UTF-8
    order. n counts the words of the language.

    Null and empty texts have no words; a null language is `und`; a repeated row counts each time; texts of any length
    are read in slices, without losing phrases across them. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    for seed in itertools.count():
        words = cut_lineage(word_counts(texts, seed), "phrase-words")
        if words.groupBy("id").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b OR id = 0").isEmpty():
            break
        discard(words)  # two words with one id: other ids
    total = words.agg(F.sum("n")).first()[0] or 0
    bucket_bits = min(32, max(1, (total // BUCKET_WORDS).bit_length()))
    parts = words.where(F.col("n") >= min_count).select("lang", F.array("id").alias("ids"), F.col("n").alias("a"))
    tables, sizes = [marks(parts)], []
    for n in range(2, longest + 1):
        sizes.append(cut_lineage(gram_counts(texts, n, seed, tables, bucket_bits, min_count), f"phrases-{n}"))
        if n < longest:
            tables.append(marks(sizes[-1]))
    grams = sizes[0]
    for one in sizes[1:]:
        grams = grams.unionByName(one)
    known = parts
    for one in sizes[:-1]:
        known = known.unionByName(one)
    hot = known.where(F.col("a") * HOT_SHARE >= total)  # at most HOT_SHARE phrases of each length
    ranked = scored(uncovered(grams, longest, percent), known, hot)
    spelled = ranked.select("*", F.posexplode("ids").alias("pos", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    phrase = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]))
    first = spelled.groupBy("lang", "ids", "a", "l", "r", "score").agg(phrase.alias("phrase"))
    for slices in SLICES:  # a language's phrases are ranked in slices of them, so that no task has them all
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(slices))).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        first = first.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    out = cut_lineage(first.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases-top")
    for step in (words, *sizes):
        discard(step)
    return out
