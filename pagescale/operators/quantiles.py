"""Exact linear-interpolated quantiles and exact hash ranks that hold for groups of any size."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagescale.functions.text import let
from pagescale.session import cut_lineage, discard

DIGIT = 22
FEW = 250_000
SLICE_DIGITS = 6


def order_key(value: Column) -> Column:
    """A 64-bit number that orders as the doubles do: exponent and mantissa in one, negative below zero.

    Both zeros are 0 and NaN is above infinity. Powers of two are exact, so every step is.
    """
    size = F.abs(value)
    return _order_bits(value, size, let(_near_power(size), lambda e: _power(size, e)))


def _two(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def _near_power(size: Column) -> Column:
    return F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))


def _power(size: Column, e: Column) -> Column:
    # the logarithm may be off by one next to a power of two
    return F.when(_two(e) > size, e - 1).when((e < 1023) & (_two(e + 1) <= size), e + 1).otherwise(e)


def _order_bits(value: Column, size: Column, power: Column) -> Column:
    normal = let(power, lambda e: F.shiftleft((e + 1023).cast("long"), 52) + ((size / _two(e) - 1.0) * float(2**52)).cast("long"))
    return _signed(value, size, normal)


def _signed(value: Column, size: Column, normal: Column) -> Column:
    tiny = (size * float(2.0**537) * float(2.0**537)).cast("long")
    infinite = 0x7FF << 52
    bits = F.when(F.isnan(value), infinite + 1).when(size == float("inf"), infinite).when(size < 2.0**-1022, tiny).otherwise(normal)
    return F.when(value < 0, -bits).otherwise(bits)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``_key``, the `order_key` of ``_v``, step by step: each step is a column of its own, which compiles as a whole.

    It is never NULL: a join would else filter on all steps written out as one expression, many times over.
    """
    size, e = F.col("_size"), F.col("_e")
    steps = rows.withColumn("_size", F.abs("_v")).withColumn("_e", _near_power(size)).withColumn("_e", _power(size, e))
    steps = steps.withColumn("_two", _two(e))
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((size / F.col("_two") - 1.0) * float(2**52)).cast("long")
    return steps.withColumn("_key", F.coalesce(_signed(F.col("_v"), size, normal), F.lit(0).cast("long"))).drop("_size", "_e", "_two")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], digit: int = DIGIT, few: int = FEW) -> DataFrame:
    """One row per group with ``n`` and one exact quantile column per entry of ``probs``; NULL values are ignored.

    Groups of at most ``few`` rows are sorted, each in one task: their rows move once, narrow. Larger ones go by radix
    selection, the same for groups of any size. Values become 64-bit numbers in their order. A pass counts, for
    every bucket of the next ``digit`` bits, its rows with the least and greatest value; that folds in every task, so no
    row moves. A wanted rank lies in one bucket: it is found there if it is the first or last or all values are equal,
    else the next pass counts the rows of that bucket alone. Buckets of a group are at most 2**digit. Rows meet the open
    buckets by a join on group and bucket, which Spark turns into a broadcast where that table is below its threshold.

    The rows are written once, narrow, and read once a pass, 64 / ``digit`` times at most; passes end when all ranks are
    found. NaN counts as the greatest value.
    """
    names, keys = list(keys), list(keys) or ["_all"]
    frame = df if names else df.withColumn("_all", F.lit(0))
    rows = frame.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = cut_lineage(rows, "ranks-rows")
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = [f(at(p)).cast("long") for p in probs.values() for f in (F.floor, F.ceil)]
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_c")), "sizes")
    large, met = _aliased(sizes.where(F.col("_c") > few).drop("_c"), keys)
    if large.isEmpty():
        base = _by_sorting(rows, keys, ranks)
    elif sizes.where(F.col("_c") <= few).isEmpty():
        base = _by_radix(rows, keys, ranks, digit)
    else:
        base = _by_sorting(rows.join(large, met, "left_anti"), keys, ranks).unionByName(_by_radix(rows.join(large, met, "left_semi"), keys, ranks, digit))
    base = cut_lineage(base, "ranks-found")
    discard(rows)
    lo, hi = lambda i: F.col(f"_v{2 * i}"), lambda i: F.col(f"_v{2 * i + 1}")
    between = lambda i, p: lo(i) + (hi(i) - lo(i)) * (at(p) - F.floor(at(p)))
    # equal ends are the answer; the difference of two infinities is not a number
    return base.select(*names, "n", *[F.when(lo(i) == hi(i), lo(i)).otherwise(between(i, p)).alias(c) for i, (c, p) in enumerate(probs.items())])


def _by_sorting(rows: DataFrame, keys: list[str], ranks: list[Column]) -> DataFrame:
    """(keys, n, _v0, _v1, …): the values at the ranks of every group."""
    mine = W.partitionBy(*keys)
    placed = rows.withColumn("_r", F.row_number().over(mine.orderBy("_v")).cast("long") - 1).withColumn("n", F.count("*").over(mine))
    wanted = placed.where(functools.reduce(lambda a, b: a | b, [F.col("_r") == rank for rank in ranks]))
    return wanted.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_r") == rank, F.col("_v"))).alias(f"_v{i}") for i, rank in enumerate(ranks)])


def _by_radix(rows: DataFrame, keys: list[str], ranks: list[Column], digit: int) -> DataFrame:
    """(keys, n, _v0, _v1, …): the values at the ranks of every group, by counts of ever smaller buckets."""
    keyed = _keyed(rows)
    shift = max(0, 64 - digit)
    counted = _buckets(keyed, keys, shift).withColumn("n", F.sum("_c").over(W.partitionBy(*keys)))
    first = [x for i, rank in enumerate(ranks) for x in _found(i, rank)]
    base = cut_lineage(counted.groupBy(*keys, "n").agg(*first), "ranks-found")
    later, open_ = None, _still_open(base, keys, len(ranks))
    while shift and not open_.isEmpty():
        before, shift = shift, max(0, shift - digit)
        places, met = _aliased(open_.select(*keys, "_place").distinct(), keys)
        inside = keyed.join(places, met & (F.shiftright("_key", before) == F.col("_place")))
        counted = _buckets(inside, [*keys, "_place"], shift)
        asked, met = _aliased(open_.withColumnRenamed("_place", "_asked"), keys)
        step = counted.join(asked, met & (F.col("_place") == F.col("_asked"))).groupBy(*keys, "_i").agg(*_found(0, F.col("_rank")))
        step = cut_lineage(step, "ranks-found")
        done = step.where("_v0 IS NOT NULL").select(*keys, "_i", "_v0")
        later = done if later is None else later.unionByName(done)
        open_ = step.where("_v0 IS NULL").select(*keys, "_i", F.col("_b0").alias("_place"), F.col("_r0").alias("_rank"))
    if later is not None:
        more, met = _aliased(later.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v0"))).alias(f"_w{i}") for i in range(len(ranks))]), keys)
        base = base.join(more, met, "left").withColumns({f"_v{i}": F.coalesce(f"_v{i}", f"_w{i}") for i in range(len(ranks))})
    return base.select(*keys, "n", *[f"_v{i}" for i in range(len(ranks))])


def _buckets(rows: DataFrame, group: list[str], shift: int) -> DataFrame:
    """Rows, least and greatest value of every bucket, and the rows of its group up to its end."""
    out = rows.groupBy(*group, F.shiftright("_key", shift).alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return out.withColumn("_end", F.sum("_c").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))  # buckets, not rows


def _found(i: int, rank: Column) -> list[Column]:
    """Aggregates over a group's buckets: the value at a rank, or else the bucket that holds it and the rank inside."""
    inside = rank - (F.col("_end") - F.col("_c"))
    here = (inside >= 0) & (inside < F.col("_c"))
    known = F.when((inside == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).when(inside == F.col("_c") - 1, F.col("_hi"))
    return [F.max(F.when(here, known)).alias(f"_v{i}"), F.max(F.when(here, F.col("_b"))).alias(f"_b{i}"), F.max(F.when(here, inside)).alias(f"_r{i}")]


def _still_open(base: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, _i, _place, _rank) of the ranks without a value."""
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_v{i}").alias("_v"), F.col(f"_b{i}").alias("_place"), F.col(f"_r{i}").alias("_rank")) for i in range(n)])
    return base.select(*keys, F.inline(F.filter(ranks, lambda x: x["_v"].isNull()))).drop("_v")


def _aliased(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """The table with other names for the keys, and the condition that they equal those of another table, NULL included."""
    met = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)])
    return df.withColumnsRenamed({k: f"_k{j}" for j, k in enumerate(keys)}), met


def hash_rank(df: DataFrame, ids: Sequence[str], seed: int = 0, name: str = "rank") -> DataFrame:
    """Adds the 0-based position of each row in the pseudo-random order of its hashed id (ids must be unique).

    The order is that of the MD5 digits of seed and ids, which every engine has. Six digits cut the rows into 16 million
    even slices, so that slices stay small at any size; a slice's place comes from the counts of the slices before it,
    added up within and then over the 4,096 values of the first three digits. Rows move once, by slice.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ids]
    hashed = df.withColumn("_h", F.md5(F.concat_ws("/", F.lit(str(seed)), *parts))).withColumn("_s", F.substring("_h", 1, SLICE_DIGITS))
    counts = hashed.groupBy("_s").agg(F.count("*").alias("_n")).withColumn("_top", F.substring("_s", 1, SLICE_DIGITS // 2))
    earlier = lambda part, order: F.coalesce(F.sum("_n").over(part.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = counts.groupBy("_top").agg(F.sum("_n").alias("_n"))
    tops = tops.select("_top", earlier(W.partitionBy(F.lit(0)), "_top").alias("_first"))  # at most 4,096 rows
    inner = counts.select("_s", "_top", earlier(W.partitionBy("_top"), "_s").alias("_inner"))
    starts = inner.join(F.broadcast(tops), "_top").select("_s", (F.col("_first") + F.col("_inner")).alias("_before"))
    ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy("_h", *ids)))
    return ranked.join(starts, "_s").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_h", "_s", "_r", "_before")
