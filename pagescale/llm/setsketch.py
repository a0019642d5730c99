"""Near-duplicates by SetSketch registers: band, estimate jointly, verify on full sets, connect."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale.llm.components import components
from pagescale.llm.subwords import CACHE, LONG
from pagescale.session import cut_lineage, discard, release_shuffles

BANDS, ROWS = 42, 6
SLICE = 14
TEXT_SLICES = 3
BASE, RATE = 1.001, 20.0
LEAST_ESTIMATE = 0.68
BLOCK = 512
_RNG = np.random.default_rng(20240)
_MIX = _RNG.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOPE = _RNG.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z in lower case, words between ASCII white space.

    A text of fewer words is one shingle, its whole sequence; no word, no shingle.
    """
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter((hashes[w] for w in own), np.uint64, len(own))
    n = min(words, h.size)
    x = np.full(h.size - n + 1, n, np.uint64)
    for i in range(n):
        x += h[i : h.size - n + 1 + i] * _MIX[i]
    x ^= x >> np.uint64(32)
    x *= _MIX[-1]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def registers(items: np.ndarray) -> np.ndarray:
    """Truncated logarithms of exponential minima, one for each hash function; registers of a union are the maxima."""
    least = np.full(_SLOPE.size, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, items.size, 1024):
        np.minimum(least, (items[i : i + 1024, None] * _SLOPE + _SHIFT).min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 1.0) / 2.0**64 * (1 - 2e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs of sets with known sizes, from how often registers are above, below and equal."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(u - (1 - u) * grid), chance((1 - u) - u * grid)
    likely = above * np.log(up + 1e-12) + below * np.log(down + 1e-12) + equal * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(grid, likely.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """(id, n, digest, sketch) of every row: set size, a 128-bit name of the set, and its registers (null if empty)."""

    @F.pandas_udf("n long, digest string, sketch binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch:
                items = shingles(text, words, hashes)
                rows.append((items.size, xxhash.xxh128_hexdigest(items.tobytes()), registers(items).tobytes()) if items.size else (0, None, None))
            yield pd.DataFrame(rows, columns=["n", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), sketch(F.col(text_col)).alias("_s")).select("id", "_s.n", "_s.digest", "_s.sketch")


def bands(sketch: str, first: int) -> Column:
    """Names of the buckets of SLICE bands, from the band `first` on."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def named(sketch: pd.Series) -> pd.Series:
        size = 2 * ROWS
        return pd.Series([[xxhash.xxh64_intdigest(x[i * size : (i + 1) * size], i) - (1 << 63) for i in range(first, min(first + SLICE, BANDS))] for x in sketch])

    return named(sketch)


def shared_buckets(sets: DataFrame) -> DataFrame:
    """(bucket, rep, n, key, band, low) of every node in a bucket that another node is in, too; low is the smallest of them.

    Rows alone in their bucket meet no other and are not kept. The bands are worked off slice by slice and each slice's
    table and shuffle files go before the next, so the disk holds the rows of SLICE bands at a time.
    """
    found = []
    for first in range(0, BANDS, SLICE):
        rows = sets.select("rep", "n", "key", F.posexplode(bands("sketch", first)).alias("at", "bucket"))
        rows = cut_lineage(rows.select("bucket", "rep", "n", "key", (F.col("at") + first).alias("band")), "buckets")
        several = rows.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").drop("high")
        found.append(cut_lineage(rows.join(several, "bucket"), "shared"))
        discard(rows)
        release_shuffles(sets.sparkSession)
    return functools.reduce(DataFrame.unionByName, found)


@F.pandas_udf(T.DoubleType())
def similar(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    out = np.zeros(len(a))
    for i in range(0, len(a), 500):
        x, y = (np.frombuffer(b"".join(s.iloc[i : i + 500]), np.uint16).reshape(-1, BANDS * ROWS) for s in (a, b))
        out[i : i + 500] = estimate(x, y, n_a.iloc[i : i + 500].to_numpy(float), n_b.iloc[i : i + 500].to_numpy(float))
    return pd.Series(out)


def close(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the estimated similarity, those nearly five deviations under 0.8 left out."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    return out.withColumn("about", similar("s_a", "s_b", "n_a", "n_b")).where(F.col("about") >= LEAST_ESTIMATE).select("a", "b", "about")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """(rep, key, items): the whole shingle sets of the nodes' rows, as sorted 64-bit numbers end to end.

    No filter on the sets here: the optimiser would move it, and the work, below the join to all texts. Texts meet the
    nodes slice by slice of their ids, so a part of the texts is in shuffle files at a time.
    """

    @F.pandas_udf("digest string, items binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            items = [shingles(x, words, hashes).tobytes() for x in batch]
            yield pd.DataFrame({"digest": [xxhash.xxh128_hexdigest(x) for x in items], "items": items})

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text_col).alias("_t"))
    nodes = nodes.select("rep").distinct()
    found = []
    for i in range(TEXT_SLICES):
        own = F.pmod(F.xxhash64("rep"), F.lit(TEXT_SLICES)) == i
        part = texts.where(own).join(nodes.where(own), "rep", "left_semi").select("rep", packed("_t").alias("_p"))
        found.append(cut_lineage(part.select("rep", F.xxhash64("_p.digest").alias("key"), "_p.items").dropDuplicates(["rep", "key"]), "whole-sets"))
        release_shuffles(docs.sparkSession)
    return functools.reduce(DataFrame.unionByName, found)


def verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""

    @F.pandas_udf(T.BooleanType())
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size
            out.append(both > 0 and 100 * both >= percent * (x.size + y.size - both))
        return pd.Series(out, dtype=bool)

    out = pairs.select("a", "b").join(whole.select(F.col("rep").alias("a"), F.col("items").alias("s_a")), "a")
    out = out.join(whole.select(F.col("rep").alias("b"), F.col("items").alias("s_b")), "b")
    return out.where(reaches("s_a", "s_b")).select("a", "b").distinct()


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpacked(items: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, np.int64) for x in items])


def lone_items(whole: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rep, alone): how many items of each node no other of the nodes has."""
    items = whole.join(nodes.select("rep").distinct(), "rep", "left_semi").select("rep", F.explode(unpacked("items")).alias("item"))
    single = items.groupBy("item").agg(F.min("rep").alias("rep"), F.max("rep").alias("high")).where("rep = high")
    return single.groupBy("rep").agg(F.count("*").alias("alone"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks (low, high) of its bucket that its own block is part of, sorted by them.

    A bucket of n rows has n / BLOCK blocks by hash, so no task holds more than about two blocks of a bucket at once,
    and every two rows of a bucket meet in some pair of blocks.
    """
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")
    out = rows.join(blocks, "bucket").withColumn("own", own).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    out = out.withColumn("low", F.least("own", "peer")).withColumn("high", F.greatest("own", "peer")).drop("peer", "n_blocks")
    return out.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The groups of rows with equal (bucket, low, high), from sorted batches; only the last group is carried on."""
    carried = None
    for batch in batches:
        frame = batch.to_pandas()
        if carried is not None:
            frame = pd.concat([carried, frame], ignore_index=True)
        key = frame[["bucket", "low", "high"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist()]
        for i, j in zip(edges, edges[1:]):
            yield frame.iloc[i:j]
        carried = frame.iloc[edges[-1] :]
    if carried is not None and len(carried):
        yield carried


def open_pairs(group: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a group that are in different components and may reach the similarity.

    Left out are pairs of one block met in another pair of blocks, pairs whose sizes or own items forbid it, pairs with
    an earlier band in common (they meet there) and pairs whose estimate is far below.
    """
    n, alone = group["n"].to_numpy(), group["alone"].to_numpy()
    own, component = group["own"].to_numpy(), group["component"].to_numpy()
    low, high, band = group["low"].iloc[0], group["high"].iloc[0], int(group["band"].iloc[0])
    table = np.frombuffer(b"".join(group["sketch"]), np.uint16).reshape(len(group), -1)
    left, right = [], []
    for i in range(len(group) - 1):
        j = np.arange(i + 1, len(group))
        ok = component[j] != component[i]
        if low != high:
            ok &= own[j] != own[i]
        ok &= 100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])
        ok &= percent * (alone[j] + alone[i]) <= (100 - percent) * np.minimum(n[j] - alone[j], n[i] - alone[i])
        j = j[ok]
        for at in range(0, j.size, 2048):
            part = j[at : at + 2048]
            same = (table[part] == table[i]).reshape(part.size, BANDS, ROWS).all(2)
            part = part[same.argmax(1) == band]
            if part.size:
                near = estimate(np.broadcast_to(table[i], (part.size, table.shape[1])), table[part], np.full(part.size, float(n[i])), n[part].astype(float)) >= LEAST_ESTIMATE
                left.append(np.full(near.sum(), i))
                right.append(part[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def hopeful(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (bucket, rep) that have a partner worth a look at the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            found = np.unique(np.concatenate(open_pairs(group, percent)))
            if found.size:
                rep = group["rep"].to_numpy()[found]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, group["bucket"].iloc[0])), pa.array(rep)], names=["bucket", "rep"])

    return in_blocks(rows).mapInArrow(run, "bucket long, rep long").distinct()


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components, enough of them to join what is linked; checked on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            left, right = open_pairs(group, percent)
            if not left.size:
                continue
            rep, component = group["rep"].to_numpy(), group["component"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
            root = {c: c for c in component.tolist()}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            out = []
            for i, j in zip(left.tolist(), right.tolist()):
                x, y = top(component[i]), top(component[j])
                if x == y:
                    continue
                both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if 100 * both >= percent * (sets[i].size + sets[j].size - both):
                    root[max(x, y)] = min(x, y)
                    out.append((rep[i], rep[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return in_blocks(rows).mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """(id, n, component) of every row: set size and the smallest id reachable over links of `percent` similarity.

    Rows of equal sets are one node, under their smallest id. Bands of registers name buckets. First each node is
    compared with the best of its buckets' smallest nodes; that joins large groups without pairing their members.
    Then the rows of a bucket that are still in different components are compared block by block: pairs are estimated
    from registers, and those near the threshold verified, where they are, on full sets; only links leave a task. Left
    out are pairs that items held by one of them alone keep under the threshold: an intersection I and a and b items of
    their own give I / (I + a + b) at most. So no candidate pair stays open; a pair at the threshold shares no bucket
    with a chance of 3 in a million.

    Null and empty texts have size 0 and are alone. Rows of equal ids share a component. A row without an id is no
    node; it shows the component of its set, if any row with an id has it. An empty table stays empty.
    """
    spark = docs.sparkSession
    rows = cut_lineage(sketches(docs, words, text_col), "sketches")
    names = cut_lineage(rows.select("id", "n", "digest"), "names")
    known_id = F.col("id").isNotNull() & (F.col("n") > 0)
    # what rows of one digest have besides the id is the same in all of them
    sets = rows.where(known_id).groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = cut_lineage(sets.select("rep", "n", "digest", F.xxhash64("digest").alias("key"), "sketch"), "sets")
    discard(rows)
    release_shuffles(spark)
    shared = shared_buckets(sets)
    sizes = shared.where("rep = low").groupBy("bucket").agg(F.min("n").alias("n_b"))
    stars = shared.where("rep > low").join(sizes, "bucket").where(close(F.col("n"), F.col("n_b"), percent)).select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    stars = cut_lineage(estimated(stars, sets), "stars")
    release_shuffles(spark)
    best = stars.groupBy("a").agg(F.max_by("b", "about").alias("b"))
    full, firsts = names.where(known_id), sets.select("digest", "rep")
    several = full.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("id")
    same_id = full.join(several, "id").join(firsts, "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    whole = full_sets(docs, shared, words, text_col)
    edges = cut_lineage(verified(best, whole, percent).unionByName(same_id), "links")
    discard(stars)
    release_shuffles(spark)
    known = components(edges)
    placed = cut_lineage(shared.join(known, F.col("rep") == F.col("node"), "left").select("bucket", "band", "rep", "key", "n", F.coalesce("component", "rep").alias("component")), "placed")
    discard(shared)
    discard(known)
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    open_rows = cut_lineage(placed.join(mixed, "bucket"), "mixed")
    discard(placed)
    release_shuffles(spark)
    alone = cut_lineage(lone_items(whole, open_rows), "alone")
    release_shuffles(spark)
    marked = open_rows.join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    rows_left = cut_lineage(marked.join(sets.select("rep", "key", "sketch"), ["rep", "key"]), "mixed")
    discard(open_rows)
    discard(alone)
    release_shuffles(spark)
    worth = cut_lineage(hopeful(rows_left, percent), "hopeful")
    release_shuffles(spark)
    final_rows = rows_left.join(worth, ["bucket", "rep"]).join(whole.select("rep", "key", "items"), ["rep", "key"])
    final = components(edges.unionByName(linked(final_rows, percent)))
    for step in (rows_left, worth, whole, edges):
        discard(step)
    release_shuffles(spark)
    named = firsts.join(final, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return names.join(named, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
