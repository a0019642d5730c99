"""Exact top-k inner products by a three-phase uniform threshold over lists of partial scores.

A vector is cut into lists of coordinates; a list's score is the inner product over its coordinates, and the lists of one
vector lie in different tasks. Phase one gathers the best entries of every list and resolves those vectors: the k-th best
total is a safe cutoff, since a vector of that total scores at least its share of it, cutoff over number of lists, in one
list or more. Phase two broadcasts the shares and collects every entry that reaches its query's. Phase three drops the
vectors that cannot reach the cutoff with the share's bound for what was not collected, and resolves the rest exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescale.session import cut_lineage, discard, scratch_path

SCALE = 256.0
N_LISTS = 2
QUERY_BLOCK = 1024
DEPTH = 16
GATHER = 64
CHUNK = 1 << 20
ENTRY = "query int, row long, id long, list int, part long"


def units(vector: Column, scale: float = SCALE) -> Column:
    """The components in whole units; null where the vector is null or holds a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Queries:
    """A block of queries: ids, one matrix per list, and the rows of a batch that are a query's own."""

    def __init__(self, ids: list[int], vectors: list[list[int]], dims: int, n_lists: int, largest: int):
        self.ids = np.array(ids, np.int64)
        self.width = max(1, -(-dims // n_lists))
        # sums of products below 2**53 are exact in floating point, which is faster
        self.kind = np.float64 if largest * largest * max(dims, 1) < 1 << 53 else np.int64
        whole = np.zeros((len(ids), self.width * n_lists), np.int64)
        for i, v in enumerate(vectors):
            whole[i, : len(v)] = v
        self.parts = [np.ascontiguousarray(whole[:, i * self.width : (i + 1) * self.width].T).astype(self.kind) for i in range(n_lists)]

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(list, rows, ids, whether null, scores, own) of pieces of a batch: scores is a matrix rows x queries."""
        ids, lists, rows = batch.column("id"), batch.column("list").to_numpy(), batch.column("row").to_numpy()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        table = batch.column("part").flatten().to_numpy().reshape(-1, self.width)
        step = max(1, CHUNK // max(1, len(self.ids)))
        for which in np.unique(lists):
            mine = np.flatnonzero(lists == which)
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                own = (ids[some][:, None] == self.ids) & ~null[some][:, None]
                yield int(which), rows[some], ids[some], null[some], table[some].astype(self.kind) @ self.parts[which], own


def entries(query: np.ndarray, row: np.ndarray, ids: np.ndarray, null: np.ndarray, which: int, part: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(query.astype(np.int32)), pa.array(row), pa.array(ids, mask=null), pa.array(np.full(len(row), which, np.int32)), pa.array(part.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["query", "row", "id", "list", "part"])


def gathered(lists: DataFrame, shared, depth: int) -> DataFrame:
    """The best `depth` entries of every list in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for which, rows, ids, null, scores, own in shared.value.scored(batch):
                found = [np.where(own, -np.inf, scores)] + [np.broadcast_to(x[:, None], scores.shape) for x in (rows, ids, null)]
                if which in best:
                    found = [np.concatenate([a, b]) for a, b in zip(best[which], found, strict=True)]
                if len(found[0]) > depth:
                    order = np.argpartition(-found[0], depth - 1, axis=0)[:depth]
                    found = [np.take_along_axis(x, order, axis=0) for x in found]
                best[which] = [np.array(x) for x in found]
        for which, (scores, rows, ids, null) in best.items():
            at, query = np.nonzero(scores > -np.inf)
            yield entries(query, rows[at, query], ids[at, query], null[at, query], which, scores[at, query])

    return lists.mapInArrow(run, ENTRY)


def collected(lists: DataFrame, shared, shares) -> DataFrame:
    """All entries that reach their query's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, rows, ids, null, scores, own in shared.value.scored(batch):
                at, query = np.nonzero((scores >= shares.value) & ~own)
                yield entries(query, rows[at], ids[at], null[at], which, scores[at, query])

    return lists.mapInArrow(run, ENTRY)


def resolved(asked: DataFrame, shared) -> DataFrame:
    """The scores of rows (query, row, id, list, part) whose `part` holds the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, query, lists = shared.value, batch.column("query").to_numpy(), batch.column("list").to_numpy()
            table = batch.column("part").flatten().to_numpy().reshape(-1, queries.width).astype(queries.kind)
            part = np.zeros(len(query), np.int64)
            for which in np.unique(lists):
                mine = np.flatnonzero(lists == which)
                part[mine] = (table[mine] * queries.parts[which].T[query[mine]]).sum(axis=1)
            yield batch.set_column(batch.schema.get_field_index("part"), "part", pa.array(part))

    return asked.select("query", "row", "id", "list", "part").mapInArrow(run, ENTRY)


def best(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of every key; the rank limit applies before rows move."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def answer(lists: DataFrame, block: Queries, k: int, n_lists: int) -> DataFrame:
    """(query, rank, id, score) for a block of queries."""
    spark = lists.sparkSession
    shared = spark.sparkContext.broadcast(block)  # at most QUERY_BLOCK vectors
    first = best(gathered(lists, shared, max(DEPTH, k)), ["query", "list"], [F.col("part").desc(), "row"], max(GATHER, k))
    known = first.select("query", "row").distinct()  # at most QUERY_BLOCK x n_lists x GATHER rows
    totals = resolved(lists.join(F.broadcast(known), "row"), shared).groupBy("query", "row").agg(F.sum("part").alias("score"))
    cutoffs = best(totals, ["query"], [F.col("score").desc(), "row"], k).where(F.col("rank") == k).select("query", F.col("score").alias("cutoff")).collect()
    cutoff = dict(map(tuple, cutoffs))
    # a query with fewer than k gathered vectors has fewer than k in all: it takes every entry
    shares = np.array([-(-cutoff[i] // n_lists) if i in cutoff else -(1 << 62) for i in range(len(block.ids))], np.int64)
    limits = spark.createDataFrame([(i, int(shares[i]), cutoff.get(i, -(1 << 62))) for i in range(len(shares))], "query int, share long, cutoff long")
    seen = collected(lists, shared, spark.sparkContext.broadcast(shares)).groupBy("query", "row").agg(F.max("id").alias("id"), F.sum("part").alias("seen"), F.collect_list("list").alias("lists"))
    bound = F.col("seen") + (n_lists - F.size("lists")) * (F.col("share") - 1)
    alive = seen.join(F.broadcast(limits), "query").where((F.size("lists") == n_lists) & (F.col("seen") >= F.col("cutoff")) | (F.size("lists") < n_lists) & (bound >= F.col("cutoff")))
    alive = cut_lineage(alive.select("query", "row", "id", "seen", "lists"), "topk-alive")
    missing = alive.select("query", "row", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(n_lists - 1)), "lists")).alias("list"))
    rest = resolved(missing.join(lists, ["row", "list"]), shared).groupBy("query", "row").agg(F.sum("part").alias("rest"))
    whole = alive.where(F.size("lists") == n_lists).select("query", "id", F.col("seen").alias("score"))
    late = alive.join(rest, ["query", "row"]).select("query", "id", (F.col("seen") + F.col("rest")).alias("score"))
    found = best(whole.unionByName(late), ["query"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k)
    ids = spark.createDataFrame([(i, int(x)) for i, x in enumerate(block.ids)], "query int, query_id long")
    found = cut_lineage(found.join(F.broadcast(ids), "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "topk-found")
    discard(alive)
    return found


def query_blocks(queries: DataFrame, dims: int, n_lists: int, largest: int) -> Iterator[Queries]:
    """The queries, QUERY_BLOCK at a time: the driver holds one block."""
    ids, vectors = [], []
    for row in queries.toLocalIterator():
        ids.append(row.id)
        vectors.append(row.units)
        if len(ids) == QUERY_BLOCK:
            yield Queries(ids, vectors, dims, n_lists, largest)
            ids, vectors = [], []
    if ids:
        yield Queries(ids, vectors, dims, n_lists, largest)


def top_k(vectors: DataFrame, id_col: str, vector_col: str, every: int, k: int = 5, n_lists: int = N_LISTS, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each whose id is divisible by `every`.

    Scores are inner products of the components in whole units, floor(scale * x); shorter vectors are filled up with 0.
    Equal scores go by ascending id, a null id last. Vectors that are null or hold null or non-finite components take no
    part; an empty vector scores 0. Rows with equal id and equal vector count once; a query never meets its own id. A
    table without vectors or without queries gives no rows, and other columns are not read. Of vectors that are the same
    in whole units only the k + 1 smallest ids can be among k answers, so a group of copies of any size is that many
    candidates. Raises ValueError where an inner product might not fit in 64 bits.

    Queries are worked off in blocks of QUERY_BLOCK; every block reads the lists four times and moves the entries that
    reach their share, not the vectors.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), units(F.col(vector_col), scale).alias("units")).where("units IS NOT NULL").distinct()
    own = cut_lineage(own, "topk-units")
    size = own.agg(F.max(F.size("units")), F.max(F.greatest(F.array_max("units"), -F.array_min("units")))).first()
    dims, largest = size[0] or 0, size[1] or 0
    if largest * largest * max(dims, 1) >= 1 << 62 or largest < 0:
        raise ValueError("inner products of these vectors may not fit in 64 bits")
    width = max(1, -(-dims // n_lists))
    kept = best(own, ["units"], [F.col("id").asc_nulls_last()], k + 1).select("id", F.monotonically_increasing_id().alias("row"), F.concat("units", F.array_repeat(F.lit(0).cast("long"), width * n_lists - F.size("units"))).alias("units"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_lists - 1)), lambda i: F.struct(i.alias("list"), F.slice("units", i * width + 1, F.lit(width)).alias("part")))
    lists = cut_lineage(kept.select("id", "row", F.explode(cut).alias("x")).select("id", "row", "x.*"), "topk-lists")
    path = scratch_path(spark, "topk-answers")
    spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").write.parquet(path)
    for block in query_blocks(own.where(F.col("id") % every == 0), dims, n_lists, largest):
        found = answer(lists, block, k, n_lists)
        found.write.mode("append").parquet(path)
        discard(found)
    discard(own)
    discard(lists)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
