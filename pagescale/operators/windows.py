"""High-variance interval detection on binned quantiles, clean-up by interval, and length zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions.text import let
from pagescale.operators.aggregates import bin_index, fill_bins
from pagescale.operators.filters import by_resolution, finite_positive, resolution_policy_filter
from pagescale.operators.quantiles import exact_quantiles
from pagescale.schema import assert_columns
from pagescale.session import cut_lineage


def rolling_centered(bins: DataFrame, keys: Sequence[str], column: str, size: int = 5) -> DataFrame:
    """Centred mean over neighbouring bins, shorter at the ends."""
    half = size // 2
    frame = W.partitionBy(*keys).orderBy("bin").rowsBetween(-half, half)
    return bins.withColumn(f"{column}_rolling", F.avg(column).over(frame))


def liftoff_threshold(bins: DataFrame, points: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS), eps: float = 0.01, width: int = 100) -> DataFrame:
    """Half a bin before the first run of bins whose high quantile exceeds ``eps``; censored at the largest length if none.

    The run takes 5 bins at 1024 and 1280, 3 otherwise.
    """
    def runs(k: int) -> Column:
        frame = W.partitionBy(*keys).orderBy("bin").rowsBetween(0, k - 1)
        return (F.min((F.col("q_high") > eps).cast("int")).over(frame) == 1) & (F.count("*").over(frame) == k)

    lifted = F.when(F.col("resolution").isin(1024, 1280), runs(5)).otherwise(runs(3))
    first = bins.withColumn("_up", lifted).groupBy(*keys).agg(F.min(F.when(F.col("_up"), F.col("left_edge"))).alias("_edge"))
    longest = points.groupBy(*keys).agg(F.max("text_len").cast("double").alias("Lmax"))
    return longest.join(first, list(keys), "left").select(
        *keys, F.when(F.col("_edge").isNull(), F.col("Lmax")).otherwise(F.greatest(F.col("_edge") - width / 2.0, F.lit(0.0))).alias("L0"),
        F.col("_edge").isNull().alias("censored"), "Lmax",
    )


def _smooth(values: Column) -> Column:
    def mean5(_: Column, i: Column) -> Column:
        lo, hi = F.greatest(i - 2, F.lit(0)), F.least(i + 2, F.size(values) - 1)
        return F.aggregate(F.slice(values, lo + 1, hi - lo + 1), F.lit(0.0), lambda a, v: a + v) / (hi - lo + 1)

    return F.transform(values, mean5)


def _interval(iqr: Column, first_bin: Column, width: int, left: float, right: float, rearm: float) -> Column:
    """``struct<L, R>`` from the gap-free ordered spreads of one group (one value per length bin)."""
    def search(rolling: Column) -> Column:
        n = F.size(rolling)
        peak = F.array_position(rolling, F.array_max(rolling)).cast("int") - 1
        low = lambda i, thr: F.get(rolling, i) < thr

        ahead = F.when(peak <= n - 3, F.sequence(peak, F.greatest(n - 3, peak))).otherwise(F.array().cast("array<int>"))
        settled = F.filter(ahead, lambda i: low(i, right) & low(i + 1, right) & low(i + 2, right))
        r_bin = F.coalesce(F.get(settled, F.lit(0)), n - 1)

        # Walk left from the peak: an armed scan stops at three quiet bins and re-arms on the next loud one.
        start = F.struct(F.lit(True).alias("armed"), F.lit(0).alias("at"))

        def walk(acc: Column, i: Column) -> Column:
            quiet = (i >= 2) & low(i, left) & low(i - 1, left) & low(i - 2, left)
            stop = acc["armed"] & quiet
            loud = F.get(rolling, i) > rearm
            return F.struct((~stop & (acc["armed"] | loud)).alias("armed"), F.when(stop, i).otherwise(acc["at"]).alias("at"))

        l_bin = F.aggregate(F.reverse(F.sequence(F.lit(0), peak)), start, walk, lambda a: a["at"])
        edge = lambda b: (first_bin + b).cast("double") * width
        return F.struct((edge(l_bin) + width).alias("L"), (edge(r_bin) + width / 2.0).alias("R"))

    return let(iqr, lambda values: let(_smooth(values), search))


def variance_interval(
    points: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS), width: int = C.BIN_WIDTH, left: float = C.LEFT_THRESHOLD,
    right: float = C.RIGHT_THRESHOLD, rearm: float = C.REARM_THRESHOLD, limits: DataFrame | None = None,
) -> DataFrame:
    """(L, R) of the high-variance interval per group, NULL with fewer than ten valid points.

    The points of a group are reduced to one spread per length bin before anything is gathered; a group then holds as
    many values as its longest text has bins. ``limits`` are the points' ``bin_limits``, where they are known already.
    """
    keys = list(keys)
    bins = fill_bins(bin_limits(points, keys, width) if limits is None else limits, keys, width)
    per_group = bins.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bin", "q_diff"))).alias("b"), F.sum("n").alias("n_points")
    )
    found = _interval(F.transform("b", lambda s: s["q_diff"]), F.element_at("b", 1)["bin"], width, left, right, rearm)
    located = per_group.withColumn("_i", F.when(F.col("n_points") >= C.MIN_INTERVAL_POINTS, found)).select(
        *keys, "n_points", F.col("_i.L").alias("L"), F.col("_i.R").alias("R")
    )
    return points.select(*keys).distinct().join(located, keys, "left")


def bin_limits(points: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS), width: int = C.BIN_WIDTH) -> DataFrame:
    """High and low quantile of the distance in every length bin that holds valid points: a positive finite length and a finite distance."""
    binned = finite_positive(points, "text_len", "edit_distance").select(*keys, bin_index("text_len", width).alias("bin"), "edit_distance")
    return exact_quantiles(binned, [*keys, "bin"], "edit_distance", {"q_high": C.Q_HIGH, "q_low": C.Q_LOW})


def filter_by_interval(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS), width: int = C.BIN_WIDTH, limits: DataFrame | None = None
) -> DataFrame:
    """Drop bins right of R, and inside [L, R] the points above ``q_low + scale * (q_high - q_low)`` of their bin.

    Quantiles are those of valid points: a positive finite length and a finite distance. Groups without a finite L and R
    stay as they are. A point without a length, or inside [L, R] without a distance (or NaN), is kept.
    """
    keys = list(keys)
    binned = points.withColumn("_bin", bin_index("text_len", width))
    limits = bin_limits(points, keys, width) if limits is None else limits
    limits = limits.select(*keys, F.col("bin").alias("_bin"), F.col("q_high").alias("_hi"), F.col("q_low").alias("_lo"))
    scale = by_resolution(C.FILTER_SCALE, C.FILTER_SCALE_DEFAULT)
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ranges = intervals.where(number("L") & number("R")).select(*keys, "L", "R")
    bins = binned.select(*keys, "_bin").distinct().join(ranges, keys)
    at = F.col("_bin") * width
    cuts = bins.join(limits, [*keys, "_bin"], "left").select(
        *keys, "_bin", (at > F.col("R")).alias("_beyond"),
        F.when((at >= F.col("L")) & (at <= F.col("R")), F.col("_lo") + scale * (F.col("_hi") - F.col("_lo"))).alias("_cut"),
    )
    cuts = cut_lineage(cuts, "bin-cuts")  # one row a bin: its size decides how the points meet it
    above = ~F.isnan("edit_distance") & (F.col("edit_distance") > F.col("_cut"))
    kept = binned.join(cuts, [*keys, "_bin"], "left")
    return kept.where(~F.coalesce("_beyond", F.lit(False)) & ~F.coalesce(above, F.lit(False))).select(*points.columns)


def drop_top_n(points: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS), counts: dict | None = None, tie: Sequence[str] = ("image_id",)) -> DataFrame:
    """Drop the n worst rows of each group (ties by id, larger first).

    The n worst rows are found with a rank limit that applies before rows move; their smallest member is the cut for
    a join, so that no group is ever sorted as a whole.
    """
    keys = list(keys)
    counts = C.DROP_TOP if counts is None else counts
    n = by_resolution(counts, 0)
    order = F.struct("edit_distance", *tie)
    worst = points.select(*keys, order.alias("_o")).withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_o"))))
    cut = worst.where(F.col("_rn") <= max(counts.values(), default=0)).where(F.col("_rn") <= n).groupBy(*keys).agg(F.min("_o").alias("_cut"))
    cut = cut_lineage(cut, "worst-cuts")  # one row a group: its size decides how the points meet it
    joined = points.join(cut, keys, "left")
    return joined.where(F.col("_cut").isNull() | (order < F.col("_cut"))).select(*points.columns)


def preprocess(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows of all groups, interval table): detect, filter by bins, drop the worst, cap by resolution."""
    assert_columns(points, ["edit_distance", "text_len", *C.GROUP_KEYS])
    limits = bin_limits(points)
    intervals = variance_interval(points, limits=limits)
    kept = resolution_policy_filter(drop_top_n(filter_by_interval(points, intervals, limits=limits)))
    return kept, intervals


def order_points(df: DataFrame, keys: Sequence[str], length: str = "text_len") -> DataFrame:
    return df.sort(*keys, length)


def zone_label(df: DataFrame, length: str = "text_len") -> DataFrame:
    """stable / transition / collapse by the breaks of the resolution; NULL for other resolutions."""
    zone = None
    for res, (a, b) in C.ZONE_BREAKS.items():
        label = F.when(F.col(length) < a, "stable").when(F.col(length) < b, "transition").otherwise("collapse")
        hit = F.col("resolution") == res
        zone = F.when(hit, label) if zone is None else zone.when(hit, label)
    return df.withColumn("zone", zone)


def hard_wall_flag(df: DataFrame, length: str = "text_len") -> DataFrame:
    """recoverable below the hard wall of the resolution, saturated from it on; NULL without a wall."""
    wall = by_resolution(C.HARD_WALL, None)
    return df.withColumn("wall", F.when(F.col(length) < wall, "recoverable").when(F.col(length) >= wall, "saturated"))
