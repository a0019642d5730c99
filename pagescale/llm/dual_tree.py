"""Ranked lexical search by two trees: groups of items against groups of documents, cut off by a bound for each pair.

Documents and items are vectors over the items' terms. A node holds the maximum of every coordinate below it, so the
product of an item node and a document node is at least the score of any pair below them. A pair of nodes that cannot
reach the weakest k-th score among the node's items is dropped with all its documents and items. At single documents and
items the bound is the score itself. Every task has its own tree of documents; the items' tree goes to all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.llm.common import word_slices
from pagescale.llm.topk_search import best
from pagescale.session import cut_lineage, discard, scratch_path

FAN = 4
LEAF = 16
BLOCK_CHARS = 8_000_000
TREE_ENTRIES = 2_000_000
SAMPLE = 16
FIRST_NODES = 4
# fixed values: A-Z in lower case, 0-9, a-z and all that is not ASCII as they are, every other sign a space
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
RESULT = "item_id long, rank int, doc_id long, score long"


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Rows:
    """Sparse rows over the terms: row i has `terms` and `values` from offsets[i] to offsets[i + 1]; no row is empty."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.offsets, self.terms, self.values = offsets, terms, values

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def taken(self, some: np.ndarray) -> Rows:
        lengths = self.offsets[some + 1] - self.offsets[some]
        at = ranges(self.offsets[some], lengths)
        return Rows(np.concatenate([[0], np.cumsum(lengths)]), self.terms[at], self.values[at])

    def times(self, some: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Products of some rows with a dense vector."""
        if not len(some):
            return np.zeros(0, self.values.dtype)
        part = self.taken(some)
        return np.add.reduceat(part.values * dense[part.terms], part.offsets[:-1])

    def maxima(self, fan: int, n_terms: int) -> Rows:
        """One row for each `fan` rows, with the maximum of every term."""
        node = np.repeat(np.arange(len(self)) // fan, np.diff(self.offsets))
        key = node * n_terms + self.terms
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.bincount(key[starts] // n_terms, minlength=-(-len(self) // fan))
        return Rows(np.concatenate([[0], np.cumsum(counts)]), key[starts] % n_terms, np.maximum.reduceat(self.values[order], starts))


def arranged(rows: Rows, n_terms: int, leaf: int) -> np.ndarray:
    """An order in which similar rows are neighbours: halves nearer to one of two unlike rows, down to `leaf` rows.

    Halves end at multiples of leaf times a power of two, so that nodes of the tree do not straddle them.
    """
    length = np.sqrt(np.add.reduceat(rows.values.astype(float) ** 2, rows.offsets[:-1])) + 1e-9
    dense = np.zeros(n_terms)

    def likeness(some: np.ndarray, pivot: int) -> np.ndarray:
        a, b = rows.offsets[pivot], rows.offsets[pivot + 1]
        dense[rows.terms[a:b]] = rows.values[a:b]
        out = rows.times(some, dense) / length[some]
        dense[rows.terms[a:b]] = 0
        return out

    out, todo = [], [np.arange(len(rows))]
    while todo:
        some = todo.pop()
        if len(some) <= leaf:
            out.append(some)
            continue
        one = some[np.argmin(likeness(some, some[0]))]
        near = likeness(some, one)
        order = np.argsort(likeness(some, some[np.argmin(near)]) - near, kind="stable")
        half = leaf << max(0, (-(-len(some) // leaf) - 1).bit_length() - 1)
        todo += [some[order[half:]], some[order[:half]]]
    return np.concatenate(out)


class Tree:
    """Levels of maxima over rows in `order`: level 0 has the rows, level 1 groups of `leaf`, then groups of FAN nodes."""

    def __init__(self, rows: Rows, n_terms: int, leaf: int):
        self.order, self.leaf = arranged(rows, n_terms, leaf), leaf
        self.levels = [rows.taken(self.order)]
        while len(self.levels[-1]) > FAN:
            self.levels.append(self.levels[-1].maxima(self.fan(len(self.levels)), n_terms))

    def fan(self, level: int) -> int:
        """Children of a node of this level."""
        return self.leaf if level == 1 else FAN

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes one level down."""
        fan, n = self.fan(level), len(self.levels[level - 1])
        first = nodes * fan
        return ranges(first, np.minimum(fan, n - first))


class Items:
    """Items with at least one term: ids, their tree and the terms' numbers."""

    def __init__(self, numbered: list[tuple[int, int | None, str]]):
        own = [(no, i, sorted(set(terms_of(text)))) for no, i, text in numbered]
        own = [x for x in own if x[2]]
        self.numbers, self.ids = [x[0] for x in own], [x[1] for x in own]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for x in own for w in x[2]}))}
        sizes = [len(x[2]) for x in own]
        terms = np.array([self.vocabulary[w] for x in own for w in x[2]], np.int64)
        self.rows = Rows(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), terms, np.ones(len(terms), np.int64))

    def planted(self) -> Items:
        if self.ids:
            self.tree = Tree(self.rows, len(self.vocabulary), FAN)
        return self


def terms_of(text: str | bytes | None) -> Iterator[bytes]:
    data = (text.encode() if isinstance(text, str) else text or b"").translate(TABLE)
    for words in word_slices(data):
        yield from words


class Best:
    """The k best documents of every item so far, and the score that another one must reach."""

    def __init__(self, cutoffs: np.ndarray, k: int):
        self.k, self.cutoffs = k, cutoffs.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in cutoffs]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        enough = scores >= self.cutoffs[item]
        scores, ids, null = (np.concatenate([a, b[enough]]) for a, b in zip(self.found[item], (scores, ids, null), strict=True))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.found[item] = scores[order], ids[order], null[order]
        if len(order) == self.k:
            self.cutoffs[item] = max(self.cutoffs[item], scores[order[-1]])


def search(items: Tree, docs: Tree, ids: np.ndarray, null: np.ndarray, n_terms: int, found: Best) -> None:
    """Add to `found` all documents that reach an item's k-th score, visiting pairs of nodes from the tops down."""
    dense = np.zeros(n_terms, np.int64)

    def bounds(item_level: int, node: int, level: int, nodes: np.ndarray) -> np.ndarray:
        rows = items.levels[item_level]
        own = rows.terms[rows.offsets[node] : rows.offsets[node + 1]]
        dense[own] = 1
        out = docs.levels[level].times(nodes, dense)
        dense[own] = 0
        return out

    def weakest(item_level: int, node: int) -> int:
        nodes = np.array([node])
        for level in range(item_level, 0, -1):
            nodes = items.children(level, nodes)
        return int(found.cutoffs[items.order[nodes]].min())

    top = len(docs.levels) - 1
    todo = [(len(items.levels) - 1, node, top, np.arange(len(docs.levels[top]))) for node in range(len(items.levels[-1]))]
    while todo:
        item_level, node, level, nodes = todo.pop()
        reached = bounds(item_level, node, level, nodes)
        keep = reached >= weakest(item_level, node)
        nodes, reached = nodes[keep], reached[keep]
        if not len(nodes):
            continue
        if item_level == 0 and level == 0:
            at = docs.order[nodes]
            found.add(int(items.order[node]), reached, ids[at], null[at])
        elif item_level == 0 and level == 1:
            # the most promising groups first: their scores cut off the others
            order = np.argsort(-reached, kind="stable")
            item, step, i = int(items.order[node]), FIRST_NODES, 0
            while i < len(order) and reached[order[i]] >= found.cutoffs[item]:
                some = docs.children(1, nodes[order[i : i + step]])
                at = docs.order[some]
                found.add(item, bounds(0, node, 0, some), ids[at], null[at])
                i, step = i + step, 2 * step
        else:
            below = docs.children(level, nodes) if level else nodes
            children = items.children(item_level, np.array([node])) if item_level else [node]
            todo += [(max(0, item_level - 1), int(c), max(0, level - 1), below) for c in children]


def encoded(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tfs): length and the items' terms of every document that has a term of any kind."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # words of at most BLOCK_CHARS characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        known = vocabulary.keys()
        for batch in batches:
            at, sizes, offsets, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                counts: Counter = Counter()
                for words in word_slices((text or b"").translate(TABLE)):
                    counts.update(words)
                if counts:
                    own = counts.keys() & known
                    at.append(i)
                    sizes.append(counts.total())
                    terms += [vocabulary[w] for w in own]
                    tfs += [counts[w] for w in own]
                    offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def searched(rows: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_words: int, cutoffs: np.ndarray, k: int) -> DataFrame:
    """(no, item_id, doc_id, score): of every task the k best documents of each item that reach its cutoff."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weights, cutoffs))

    def trees(batch: pa.RecordBatch) -> Iterator[tuple[Rows, np.ndarray, np.ndarray]]:
        """Sparse rows of impacts with ids, a bounded number of entries at a time."""
        ids = batch.column("doc_id")
        null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        sizes = np.diff(batch.column("terms").offsets.to_numpy()).astype(np.int64)
        terms, tfs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_words
        values = shared.value[1][terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * np.repeat(m, sizes)))
        some = values > 0
        sizes = np.bincount(np.repeat(np.arange(len(ids)), sizes)[some], minlength=len(ids))
        terms, values, ends = terms[some], values[some], np.cumsum(sizes)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TREE_ENTRIES, side="right")))
            own = np.arange(a, b)[sizes[a:b] > 0]
            if len(own):
                low = ends[a] - sizes[a]
                yield Rows(np.concatenate([[0], np.cumsum(sizes[own])]), terms[low : ends[b - 1]], values[low : ends[b - 1]]), ids[own], null[own]
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, cutoffs = shared.value
        found = Best(cutoffs, k)
        for batch in batches:
            for own, ids, null in trees(batch):
                search(items.tree, Tree(own, len(weights), LEAF), ids, null, len(weights), found)
        for no, item_id, (scores, ids, null) in zip(items.numbers, items.ids, found.found, strict=True):
            columns = [pa.array(np.full(len(ids), no, np.int64)), pa.array([item_id] * len(ids), pa.int64()), pa.array(ids, mask=null), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["no", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "no long, item_id long, doc_id long, score long")


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items, at most BLOCK_CHARS characters at a time (a longer item is a block of its own)."""
    held, chars = [], 0
    for no, row in enumerate(items.select(F.col(id_col).cast("long"), text_col).toLocalIterator()):
        if held and chars + len(row[1] or "") > BLOCK_CHARS:
            yield Items(held).planted()
            held, chars = [], 0
        held.append((no, row[0], row[1] or ""))
        chars += len(row[1] or "")
    if held:
        yield Items(held).planted()


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for every item.

    Terms are runs of letters and digits (and of all signs outside ASCII), A-Z in lower case. A term of an item that
    occurs tf times in a document adds w * ((1000000000 tf) div (1000 tf + 20 m)), where w falls with the number of
    documents that hold it and m grows with the document's length over the mean. Equal scores go by ascending id, null last.

    Null and empty texts have no terms: such documents do not count and such items have no rows. Repeated rows are
    documents or items of their own; texts of any length are read whole, in slices. An empty table gives no rows; other
    columns are not read. The cutoffs that the search begins with come from one document in SAMPLE; every document is
    searched, and the result does not depend on them. Items are searched in blocks of BLOCK_CHARS characters; every block
    reads the documents' texts once and their counts three times.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch_path(spark, "lexical-ranks")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for block in item_blocks(items, item_col, item_text_col):
        if not block.ids:
            continue
        rows = cut_lineage(encoded(texts, block), "lexical-counts")
        n_docs, n_words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs:
            holding = np.zeros(len(block.vocabulary), np.int64)
            for row in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # the block's terms at most
                holding[row[0]] = row[1]
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            sample = rows.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SAMPLE)) == 0)
            known = best(searched(sample, block, weights, n_docs, n_words, np.ones(len(block.ids), np.int64), k), ["no"], order, k)
            least = dict(map(tuple, known.where(F.col("rank") == k).select("no", "score").collect()))  # one row an item
            cutoffs = np.array([least.get(no, 1) for no in block.numbers], np.int64)
            found = best(searched(rows, block, weights, n_docs, n_words, cutoffs, k), ["no"], order, k)
            found.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        discard(rows)
    return spark.read.schema(RESULT).parquet(path)
