"""Benchmark decontamination: latent semantic retrieval, then longest-common-subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.llm.common import fresh
from pagescale.session import cut_lineage, release_shuffles

OTHER = r"[^\pL\pN_]+"
STRIDE = 32
RANK = 128
LEAST_COSINE = 0.25
GRAM = 3
LEAST_MATCH, SURE_MATCH, LEAST_ANSWER = 0.75, 0.9, 0.6
BLOCK_CHARS = 500_000
TOKENS = 200_000
TEXTS = 500
COMMON = 50
SLICES = 16


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, in lower case, and the number of words of each text."""
    words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), OTHER)
    flat = words.flatten()
    held = pc.not_equal(flat, "")
    sizes = np.diff(np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])[words.offsets.to_numpy() - words.offsets[0].as_py()])
    return flat.filter(held), sizes


def tokens(text: str | None) -> list[str]:
    return split(pa.array([text], pa.string()))[0].to_pylist()


@dataclass
class Items:
    """A block of benchmark items: ids, their words as numbers, the length of the answer (the last sentence)."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[int]
    vocabulary: dict[str, int]


def read_items(rows: list[tuple[int, str]]) -> Items:
    vocabulary: dict[str, int] = {}
    out = Items([], [], [], vocabulary)
    for item_id, text in rows:
        own = tokens(text)
        if not own:
            continue
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if tokens(s)]
        out.ids.append(item_id)
        out.words.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own]))
        out.answers.append(len(tokens(sentences[-1])))
    return out


def encoded(docs: DataFrame, items: Items, text_col: str = "text") -> DataFrame:
    """(doc_id, words): each whole text as numbers of the benchmark's vocabulary, -1 for other words."""
    kind = np.int16 if len(items.vocabulary) < 32_000 else np.int32
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # at most BLOCK_CHARS characters of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(shared.value), pa.large_string())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                flat, sizes = split(part.column(1))
                numbers = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy().astype(kind)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * numbers.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(numbers.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), data.cast(pa.binary())], names=["doc_id", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, words binary")


def batches_of(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents of a partition in groups of about TOKENS words; a longer text is a group of its own."""
    ids, words, n = [], [], 0
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(data.as_buffer(), kind)
            if not own.size:
                continue
            ids.append(doc_id)
            words.append(own)
            n += own.size
            if n >= TOKENS:
                yield ids, words
                ids, words, n = [], [], 0
    if ids:
        yield ids, words


def cut(words: list[np.ndarray], weighty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words with a weight end to end, the block of each, the first block of each document and the number of its blocks."""
    sizes = np.array([w.size for w in words])
    blocks = -(-sizes // STRIDE)
    first = np.cumsum(blocks) - blocks
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.concatenate(words).astype(np.int64)
    known = np.flatnonzero(weighty[flat])
    return flat[known], (np.repeat(first, sizes) + inner // STRIDE)[known], first, blocks


def passages(flat: np.ndarray, block: np.ndarray, blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The image under `table` of each passage: a block and the next one of the same document, if there is one."""
    total = int(blocks.sum())
    z = np.zeros((total, table.shape[1]), np.float32)
    if flat.size:
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        z[block[starts]] = np.add.reduceat(table[flat], starts, axis=0)
    follows = np.ones(total, bool)
    follows[np.cumsum(blocks) - 1] = False
    p = z.copy()
    p[:-1][follows[:-1]] += z[1:][follows[:-1]]
    return p


def document_counts(words: DataFrame, n_terms: int, kind: type) -> np.ndarray:
    """In how many documents each term occurs: counted in tasks, summed by Spark, one number a term to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n_terms, np.int64)
        for _, own in batches_of(batches, kind):
            flat, doc = np.concatenate(own).astype(np.int64), np.repeat(np.arange(len(own)), [w.size for w in own])
            held = flat >= 0
            count += np.bincount(np.unique(doc[held] * n_terms + flat[held]) % n_terms, minlength=n_terms)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["term", "n"])

    out = np.zeros(n_terms)
    for row in words.select("doc_id", "words").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def weights(items: Items, counts: np.ndarray, n_docs: int, common: int = COMMON, least: int = 4) -> np.ndarray:
    """Inverse document frequencies; 0 for words in over 1 / `common` of the documents, unless an item would keep fewer than `least`."""
    idf = np.log((1 + n_docs) / (1 + counts)) + 1e-3
    idle = counts > n_docs / common
    for own in items.words:
        if (~idle[own]).sum() < least:
            idle[own] = False
    return np.where(idle, 0.0, idf)


def gram_times(words: DataFrame, probe: np.ndarray, idf: np.ndarray, kind: type) -> np.ndarray:
    """(A'A) probe, where the rows of A are the TF-IDF vectors of all passages.

    Every task adds up one matrix of the vocabulary's size. Blocks of its rows are added up by SLICES tasks, so the
    driver gets one matrix, however many tasks there are.
    """
    shared = words.sparkSession.sparkContext.broadcast((probe * idf[:, None]).astype(np.float32))
    shape, weighty = probe.shape, np.append(idf > 0, False)  # the last place is that of other words, -1
    edges = [(shape[0] * k // SLICES, shape[0] * (k + 1) // SLICES) for k in range(SLICES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total, read = shared.value, np.zeros(shape), False
        for _, own in batches_of(batches, kind):
            read = True
            flat, block, _, blocks = cut(own, weighty)
            p = passages(flat, block, blocks, table)
            seen = p.copy()  # a block is part of its own passage and of the one before
            last = np.cumsum(blocks) - 1
            starts_doc = np.zeros(len(p), bool)
            starts_doc[last - blocks + 1] = True
            seen[1:][~starts_doc[1:]] += p[:-1][~starts_doc[1:]]
            order = np.argsort(flat, kind="stable")
            if order.size:
                term = flat[order]
                starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                total[term[starts]] += np.add.reduceat(seen[block[order]], starts, axis=0)
        if read:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([total[i:j].astype(np.float32).tobytes() for i, j in edges], pa.binary())], names=["slice", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column("slice").to_pylist(), batch.column("part")):
                own = np.frombuffer(part.as_buffer(), np.float32)
                if at not in totals:
                    totals[at] = np.zeros(own.size)
                totals[at] += own
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["slice", "part"])

    parts = words.select("doc_id", "words").mapInArrow(run, "slice long, part binary").repartition(SLICES, "slice").mapInArrow(add, "slice long, part binary")
    out = np.zeros(shape)
    for r in parts.collect():
        i, j = edges[r.slice]
        out[i:j] = np.frombuffer(r.part).reshape(j - i, shape[1])
    shared.destroy()
    return out * idf[:, None]


def latent_basis(words: DataFrame, items: Items, idf: np.ndarray, kind: type, rank: int = RANK, seed: int = 17) -> np.ndarray:
    """Right singular vectors of the passage matrix over the root of their singular values, by randomised SVD.

    The random test vectors are mixtures of the items' own TF-IDF vectors, so the basis spans what they share with the
    corpus. One distributed pass gives (A'A) times the test vectors; the Nystroem form of it has the singular values.
    """
    drawn = np.random.default_rng(seed).normal(size=(len(items.ids), min(rank, len(items.ids))))
    mixed = np.zeros((idf.size, drawn.shape[1]))
    for i, own in enumerate(items.words):  # item by item: a matrix of items and words would not fit the driver
        terms, times = np.unique(own, return_counts=True)
        weight = times * idf[terms]
        mixed[terms] += (weight / (np.linalg.norm(weight) + 1e-12))[:, None] * drawn[i]
    probe = np.linalg.qr(mixed)[0]
    image = gram_times(words, probe, idf, kind)
    shift = 1e-8 * max(np.linalg.norm(image), 1e-9)
    image = image + shift * probe
    middle = probe.T @ image
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    kept = values > values.max() * 1e-10
    half = image @ (vectors[:, kept] / np.sqrt(values[kept]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)  # s is the singular value squared, under the root of the shift
    return u / np.sqrt(np.maximum(s, s.max() * 1e-6))


def common_length(masks: dict[int, int], size: int, window: list[int]) -> int:
    """Length of the longest common subsequence of a pattern, given as bit masks of its words, and a window."""
    full = (1 << size) - 1
    v = full
    for word in window:
        m = masks.get(word)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | (1 << i)
    return out


@dataclass
class Pattern:
    size: int
    masks: dict[int, int]
    answer_size: int
    answer: dict[int, int]

    def best(self, words: np.ndarray, start: int, end: int) -> tuple[float, float]:
        """The best share of the item found in order in a window a quarter longer than it, and the answer's share there."""
        span, step = self.size + self.size // 4 + 2, max(1, self.size // 8)
        best = (0.0, 0.0)
        low, high = max(0, start - self.size), min(words.size, end + self.size)
        near = words[low:high].tolist()
        lost = (1 - LEAST_MATCH) * self.size
        if len(self.masks) - len(self.masks.keys() & set(near)) > lost or self.size - common_length(self.masks, self.size, near) > lost:
            return best  # no part of the window can hold more
        for i in range(low, max(low + 1, high - span + step), step):
            window = words[i : i + span].tolist()
            match = common_length(self.masks, self.size, window) / self.size
            if match >= LEAST_MATCH:
                best = max(best, (match, common_length(self.answer, self.answer_size, window) / self.answer_size))
        return best


def item_grams(items: Items) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length (GRAM, or that of a shorter item): the runs of words of the items as sorted numbers, and the item of each."""
    out: dict[int, tuple[list, list]] = {}
    for i, own in enumerate(items.words):
        n = min(GRAM, own.size)
        keys = np.unique(gram_keys(own, n, len(items.vocabulary))[1])
        held = out.setdefault(n, ([], []))
        held[0].append(keys)
        held[1].append(np.full(keys.size, i))
    order = {n: np.argsort(np.concatenate(k), kind="stable") for n, (k, _) in out.items()}
    return {n: (np.concatenate(k)[order[n]], np.concatenate(i)[order[n]]) for n, (k, i) in out.items()}


def gram_keys(flat: np.ndarray, n: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n known words follow one another, and their number; -1 is an unknown word."""
    size = max(0, flat.size - n + 1)
    keys, known = np.zeros(size, np.int64), np.ones(size, bool)
    for k in range(n):
        part = flat[k : k + size].astype(np.int64)
        keys, known = keys * n_terms + part, known & (part >= 0)
    at = np.flatnonzero(known)
    return at, keys[at]


def shared_grams(own: list[np.ndarray], grams: dict[int, tuple[np.ndarray, np.ndarray]], n_terms: int, first: np.ndarray) -> np.ndarray:
    """(passage, item) pairs that have a run of words in common, whatever their cosine; each pair once."""
    flat = np.concatenate([np.append(w, -1) for w in own])  # -1: no run crosses documents
    sizes = np.array([w.size + 1 for w in own])
    doc = np.repeat(np.arange(len(own)), sizes)
    inner = np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = [np.zeros((0, 2), np.int64)]
    for n, (keys, item) in grams.items():
        at, own_keys = gram_keys(flat, n, n_terms)
        low, high = np.searchsorted(keys, own_keys, "left"), np.searchsorted(keys, own_keys, "right")
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        place = np.repeat(at[hit], times)
        which = item[np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        found.append(np.stack([first[doc[place]] + inner[place] // STRIDE, which], 1))
    return np.unique(np.concatenate(found), axis=0)


def matches(words: DataFrame, items: Items, basis: np.ndarray, idf: np.ndarray, kind: type, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(doc_id, item_id, matched, answered) of the documents with a passage near an item that also passes the checks.

    A passage is near if its cosine is high enough or if it has a run of GRAM words in common with the item.
    """
    table = (basis * idf[:, None]).astype(np.float32)
    queries = np.stack([table[own].sum(0) for own in items.words]) if items.ids else np.zeros((0, table.shape[1]), np.float32)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True) + 1e-12
    patterns = [Pattern(w.size, masks_of(w), n, masks_of(w[-n:])) for w, n in zip(items.words, items.answers)]
    shared = words.sparkSession.sparkContext.broadcast((table, queries.astype(np.float32), patterns, items.ids, item_grams(items)))
    n_terms = len(items.vocabulary)
    weighty = np.append(idf > 0, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, queries, patterns, ids, grams = shared.value
        for docs, own in batches_of(batches, kind):
            flat, block, first, blocks = cut(own, weighty)
            p = passages(flat, block, blocks, table)
            norm = np.linalg.norm(p, axis=1)
            owner = np.repeat(np.arange(len(own)), blocks)
            found: dict[tuple[int, int], tuple[float, float]] = {}
            def check(i: int, q: int) -> None:
                doc = int(owner[i])
                if found.get((doc, q), (0.0, 0.0))[0] == 1.0:
                    return
                place = int(i - first[doc]) * STRIDE
                best = patterns[q].best(own[doc], place, place + 2 * STRIDE)
                if best[0] >= SURE_MATCH or (best[0] >= LEAST_MATCH and best[1] >= LEAST_ANSWER):
                    found[doc, q] = max(best, found.get((doc, q), best))

            shared_runs = shared_grams(own, grams, n_terms, first)
            done = set()
            for i, q in shared_runs.tolist():
                done.add((i, q))
                check(i, q)
            for at in range(0, len(p), 8192):
                near = p[at : at + 8192] @ queries.T >= least_cosine * (norm[at : at + 8192, None] + 1e-9)
                for i, q in zip(*(x.tolist() for x in np.nonzero(near & (norm[at : at + 8192, None] > 0)))):
                    if (at + i, q) not in done:
                        check(at + i, q)
            if found:
                rows = [(docs[d], ids[q], m, a) for (d, q), (m, a) in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "matched", "answered"])

    return words.select("doc_id", "words").mapInArrow(run, "doc_id long, item_id long, matched double, answered double")


def contaminations(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, matched, answered): the benchmark items that each document contains, word by word or rewritten.

    The benchmark is read in blocks of at most `block_chars` characters (by running sum of lengths); each block has its
    own vocabulary, document counts over all documents, singular vectors over all passages, and search over all passages.
    Null or wordless items and texts match nothing. Repeated ids give repeated rows. Empty tables give no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, matched double, answered double"
    out = None
    for rows in item_blocks(benchmark, block_chars):
        items = read_items(rows)
        if not items.ids:
            continue
        n_terms = len(items.vocabulary)
        kind = np.int16 if n_terms < 32_000 else np.int32
        words = cut_lineage(encoded(docs, items, text_col), "benchmark-words")
        n_docs = words.count()
        idf = weights(items, document_counts(words, n_terms, kind), n_docs)
        basis = latent_basis(words, items, idf, kind)
        release_shuffles(spark)
        found = matches(words, items, basis, idf, kind)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks, streamed through the driver one partition at a time."""
    rows, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").toLocalIterator():
        if rows and n + len(row.text) > block_chars:
            yield rows
            rows, n = [], 0
        rows.append((row.item_id, row.text))
        n += len(row.text)
    if rows:
        yield rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, with their columns unchanged. Rows without an id are searched, too, and kept."""
    name = fresh(docs, "_found")
    found = contaminations(docs, benchmark).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, docs["doc_id"] == found[name], "left_anti")
