"""Distance to the k-th nearest neighbour in the (x, y) plane, exact, for groups of any size, and the trim built on it."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.operators.quantiles import exact_quantiles
from pagescale.session import cut_lineage, meet, release_shuffles

LEAF = 16
BLOCK = 65_536
SLABS = 64
BINS = 1024
SLACK = 1 + 1e-9
CELLS = 1 << 21


class _Tree:
    """Points split at medians into leaves of equal size, with the box of every node of every level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaf: int):
        depth = max(0, math.ceil(math.log2(max(1, len(x)) / leaf)))
        self.leaves, self.size = 1 << depth, -(-len(x) // (1 << depth))
        full = self.leaves * self.size
        x, y = (np.concatenate([v, np.full(full - len(v), np.inf)]) for v in (x, y))  # empty places are infinitely far
        order, self.boxes = np.arange(full), []
        for level in range(depth + 1):
            order = order.reshape(1 << level, -1)
            box = self._boxes(x[order], y[order])
            self.boxes.append(box)
            if level < depth:
                with np.errstate(invalid="ignore"):
                    wide = (box[1] - box[0] >= box[3] - box[2])[:, None]
                by = np.argsort(np.where(wide, x[order], y[order]), axis=1)
                order = np.take_along_axis(order, by, 1)
        self.order = order.reshape(self.leaves, self.size)
        # one more leaf without points fills up lists of leaves
        self.x, self.y = (np.vstack([v[self.order], np.full((1, self.size), np.inf)]) for v in (x, y))

    @staticmethod
    def _boxes(x: np.ndarray, y: np.ndarray) -> tuple:
        top = lambda v: np.where(np.isinf(v), -np.inf, v).max(axis=1)
        return x.min(axis=1), top(x), y.min(axis=1), top(y)

    def near(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) pairs, by box, of the leaves no farther from a box than its reach."""
        asked, node, most = np.arange(len(x0)), np.zeros(len(x0), dtype=np.int64), np.square(reach * SLACK)
        for level, (bx0, bx1, by0, by1) in enumerate(self.boxes):
            if level:
                asked, node = np.repeat(asked, 2), np.column_stack([2 * node, 2 * node + 1]).ravel()
            dx = np.maximum(np.maximum(bx0[node] - x1[asked], x0[asked] - bx1[node]), 0.0)
            dy = np.maximum(np.maximum(by0[node] - y1[asked], y0[asked] - by1[node]), 0.0)
            keep = (dx * dx + dy * dy <= most[asked]) & (bx0[node] <= bx1[node])
            asked, node = asked[keep], node[keep]
        return asked, node

    def smallest(self, qx: np.ndarray, qy: np.ndarray, asked: np.ndarray, leaf: np.ndarray, m: int) -> np.ndarray:
        """The m smallest distances, in order, of the points of every row of ``qx`` and ``qy`` to the points of its leaves."""
        out = np.full((*qx.shape, m), np.inf)
        count = np.bincount(asked, minlength=len(qx))
        first = np.cumsum(count) - count
        todo = np.argsort(count, kind="stable")
        at = np.searchsorted(count[todo], 1)
        while at < len(todo):
            # rows with about as many leaves are worked off together
            some = todo[at : at + max(1, CELLS // (qx.shape[1] * self.size * 4))]
            while len(some) > 1 and count[some[-1]] * len(some) * qx.shape[1] * self.size > CELLS:
                some = some[: max(1, len(some) // 2)]
            at += len(some)
            wide = np.arange(count[some[-1]])
            inside = wide < count[some][:, None]
            lists = np.where(inside, leaf[np.minimum(first[some][:, None] + wide, len(leaf) - 1)], self.leaves)
            px, py = self.x[lists].reshape(len(some), 1, -1), self.y[lists].reshape(len(some), 1, -1)
            dx, dy = px - qx[some][:, :, None], py - qy[some][:, :, None]
            d = dx * dx + dy * dy
            if d.shape[2] > m:
                d = np.partition(d, m - 1, axis=2)[:, :, :m]
            d.sort(axis=2)
            out[some, :, : d.shape[2]] = np.sqrt(d)
        return out

    def kth(self, k: int) -> np.ndarray:
        """The distance of every point to the k-th other one; infinite where there is none."""
        rows = min(self.leaves, 1 << max(0, math.ceil(math.log2(2 * (k + 1) / self.size))))  # leaves that hold enough for a bound
        group = np.arange(self.leaves) // rows
        with np.errstate(invalid="ignore"):
            asked, leaf = np.repeat(np.arange(self.leaves), rows), (group[:, None] * rows + np.arange(rows)).ravel()
            bound = self.smallest(self.x[:-1], self.y[:-1], asked, leaf, k + 1)[:, :, k]
            reach = np.where(np.isinf(self.x[:-1]), 0.0, bound).max(axis=1)
            asked, leaf = self.near(*self.boxes[-1], reach)
            found = self.smallest(self.x[:-1], self.y[:-1], asked, leaf, k + 1)[:, :, k]
        out = np.empty(self.leaves * self.size)
        out[self.order.ravel()] = found.ravel()
        return out


def _codes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Numbers from 0 that are equal where the columns are."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for c in columns:
        part = table[c].combine_chunks().dictionary_encode()
        code = np.unique(code * max(1, len(part.dictionary)) + part.indices.to_numpy(), return_inverse=True)[1]
    return code


def _usable(keys: Sequence[str]) -> Column:
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    return functools.reduce(lambda a, b: a & b, [*[F.col(c).isNotNull() for c in keys], finite("x"), finite("y")])


def _measured(points: DataFrame, keys: list[str], k: int, ties: Sequence[str] = (), leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """The points with their keys and a finite position, with ``dk``, the distance to the k-th other point of the group, if any.

    A group is cut into slabs along x, and slabs along y into blocks of about ``block`` points: rows move once, in the
    order of (keys, slab, y, x), and a task holds one stretch. Within a block a tree of boxes finds the distance to the
    k-th other point. Where that circle leaves the block's box, the point also asks the other blocks it meets for their
    k + 1 smallest distances; these are few points, whatever the size of the group. Rows at one position are told apart
    by ``ties``, so that they too go to several tasks.
    """
    points = points.where(_usable(keys)).withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    groups = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    groups = cut_lineage(groups.withColumn("_s", F.least(F.lit(SLABS), F.ceil(F.sqrt(F.col("_n") / block))).cast("int")), "groups")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    # cuts decide which task does the work, not the result: ends of the bins of x at which a slab's share is reached
    bins = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("_bin") + 1) / BINS
    binned = points.join(groups.where("_s > 1 AND _x1 > _x0"), keys)
    binned = binned.groupBy(*keys, "_n", "_s", "_x0", "_x1", F.floor((F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * BINS).alias("_bin")).agg(F.count("*").alias("_c"))
    share = F.floor(F.sum("_c").over(W.partitionBy(*keys).orderBy("_bin")) * F.col("_s") / F.col("_n"))
    ends = binned.select(*keys, bins.alias("_cut"), share.alias("_share")).groupBy(*keys, "_share").agg(F.min("_cut").alias("_cut"))
    ends = ends.where("_share > 0").groupBy(*keys).agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    groups = groups.select(*keys).join(ends, keys, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<double>")))
    groups = cut_lineage(groups, "slabs")

    def slab(v: Column) -> Column:
        return F.size(F.filter("_cuts", lambda c: c < v))

    located = points.join(groups, keys).withColumn("_slab", slab(F.col("x"))).drop("_cuts")
    spread = [F.pmod(F.xxhash64(*ties), F.lit(4096))] if ties else []
    placed = located.repartitionByRange(max(1, -(-total // block)), *keys, "_slab", "y", "x", *spread)
    schema = placed.withColumns({"_block": F.lit(0).cast("long"), "dk": F.lit(0.0), "_out": F.lit(True)}).schema
    arrow = [c.name for c in schema]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table, base = pa.Table.from_batches(held), TaskContext.get().partitionId() << 32
        code, x, y = _codes(table, [*keys, "_slab"]), table["x"].to_numpy(), table["y"].to_numpy()
        d, out = np.empty(len(x)), np.empty(len(x), dtype=bool)
        by = np.argsort(code, kind="stable")
        for mine in np.split(by, np.flatnonzero(np.diff(code[by])) + 1):
            if not len(mine):
                continue
            px, py = x[mine], y[mine]
            d[mine] = near = _Tree(px, py, leaf).kth(k)[: len(mine)]
            over = near * SLACK
            out[mine] = (px - over < px.min()) | (px + over > px.max()) | (py - over < py.min()) | (py + over > py.max())
        table = table.append_column("_block", pa.array(code + base)).append_column("dk", pa.array(d)).append_column("_out", pa.array(out))
        yield from table.select(arrow).to_batches(max_chunksize=10_000)

    rows = cut_lineage(placed.mapInArrow(within, schema), "blocks")
    release_shuffles(points.sparkSession)
    found = cut_lineage(_across(rows, groups, keys, k, slab, leaf), "neighbours")
    release_shuffles(points.sparkSession)
    inner, rim = rows.where(~F.col("_out")), rows.where("_out").drop("dk")
    rim = rim.join(found, [*keys, "x", "y"], "left")
    columns = [c for c in points.columns if c != "dk"]
    return inner.select(*columns, "dk").unionByName(rim.select(*columns, "dk"))


def _across(rows: DataFrame, groups: DataFrame, keys: list[str], k: int, slab, leaf: int) -> DataFrame:
    """(keys, x, y, dk) of the positions whose circle leaves their block, from all blocks that the circle meets."""
    edge = lambda f, c: f(c).alias(f"_{f.__name__}_{c}")
    boxes = cut_lineage(rows.groupBy(*keys, "_slab", "_block").agg(edge(F.min, "x"), edge(F.max, "x"), edge(F.min, "y"), edge(F.max, "y")), "boxes")
    asking = rows.where("_out").groupBy(*keys, "x", "y").agg(F.min("dk").alias("_reach")).join(groups, keys)
    ends = F.sequence(slab(F.col("x") - F.col("_reach") * SLACK), slab(F.col("x") + F.col("_reach") * SLACK))
    asking = asking.withColumn("_slab", F.explode(ends)).drop("_cuts").join(boxes, [*keys, "_slab"])
    gap = lambda c: F.greatest(F.col(f"_min_{c}") - F.col(c), F.col(c) - F.col(f"_max_{c}"), F.lit(0.0))
    meets = F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= F.col("_reach") * SLACK
    asking = asking.where(meets).select("_block", *keys, "x", "y", "_reach")
    schema = asking.drop("_block", "_reach").withColumn("_near", F.lit(None).cast("array<double>")).schema

    def look(asked: pa.Table, points: pa.Table) -> pa.Table:
        qx, qy, reach = (asked[c].to_numpy() for c in ("x", "y", "_reach"))
        found = np.full((len(qx), k + 1), np.inf)
        if len(qx) and points.num_rows:
            tree = _Tree(points["_px"].to_numpy(), points["_py"].to_numpy(), leaf)
            step = 4096
            for at in range(0, len(qx), step):
                px, py = qx[at : at + step], qy[at : at + step]
                with np.errstate(invalid="ignore"):
                    found[at : at + step] = tree.smallest(px[:, None], py[:, None], *tree.near(px, px, py, py, reach[at : at + step]), k + 1)[:, 0]
        near = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, k + 1, dtype=np.int32)), pa.array(found.ravel()))
        return asked.select([*keys, "x", "y"]).append_column("_near", near)

    answers = asking.groupBy("_block").cogroup(rows.select("_block", F.col("x").alias("_px"), F.col("y").alias("_py")).groupBy("_block")).applyInArrow(look, schema)
    kth = F.get(F.array_sort(F.flatten(F.collect_list("_near"))), F.lit(k))
    return answers.groupBy(*keys, "x", "y").agg(kth.alias("dk")).withColumn("dk", F.when(F.col("dk") < float("inf"), F.col("dk")))


def kth_neighbour(points: DataFrame, keys: Sequence[str], k: int, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Distinct ``(keys, x, y)`` with ``dk``, the distance to the k-th other point of the group, where there is one.

    Equal points count as often as they occur. See `_measured` for the method.
    """
    keys = list(keys)
    measured = _measured(points.select(*keys, "x", "y"), keys, k, leaf=leaf, block=block)
    return measured.where(F.col("dk").isNotNull()).groupBy(*keys, "x", "y").agg(F.min("dk").alias("dk"))


def trim_sparse(
    logged: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS), ids: Sequence[str] = ("image_id",), k: int = C.TRIM_NEIGHBOURS,
    shares: dict | None = None, block: int = BLOCK,
) -> DataFrame:
    """Drop the share of points of each group that lie farthest from their k-th neighbour in the log-log plane.

    The share follows the resolution; groups of at most k points stay whole.
    """
    keys = list(keys)
    shares = C.TRIM_FRACTION if shares is None else shares
    measured = _measured(logged, keys, k, [c for c in ids if c in logged.columns], block=block)
    levels = {f"_q{i}": 1.0 - s for i, s in enumerate(sorted(set(shares.values())))}
    column = {s: f"_q{i}" for i, s in enumerate(sorted(set(shares.values())))}
    cuts = exact_quantiles(measured, keys, "dk", levels)
    pick = F.lit(None).cast("double")
    for share, name in column.items():
        mine = [r for r, s in shares.items() if s == share]
        pick = F.when(F.col("resolution").isin(*mine), F.col(name)).otherwise(pick)
    joined = meet(measured, cuts.select(*keys, pick.alias("_cut")), keys, "left")
    kept = joined.where(F.col("dk").isNull() | F.col("_cut").isNull() | (F.col("dk") <= F.col("_cut"))).select(*logged.columns)
    return kept.unionByName(logged.where(~F.coalesce(_usable(keys), F.lit(False))))
