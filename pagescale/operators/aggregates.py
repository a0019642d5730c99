"""Means, counts, histograms, series and summaries. Groups of any size fold into sums before they move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagescale.operators.quantiles import exact_quantiles


def count_by_dataset(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Scored files per data set and resolution against the number of source images."""
    counts = files.groupBy("dataset", "resolution").agg(F.count("*").alias("n_files"))
    return counts.join(sources, "dataset", "left").select(
        "dataset", "resolution", "n_files", F.coalesce("n_images", F.lit(0)).alias("n_images"),
        (F.col("n_files") == F.coalesce("n_images", F.lit(0))).alias("complete"),
    )


def count_totals(files: DataFrame) -> DataFrame:
    return files.rollup("dataset", "resolution").agg(F.count("*").alias("n_files"))


def bin_index(length: str, width: int):
    return F.floor(F.col(length).cast("long") / width)


def bin_quantiles(
    df: DataFrame, keys: Sequence[str], x: str = "text_len", y: str = "edit_distance", width: int = 100,
    q: float = 0.9, q_low: float = 0.1,
) -> DataFrame:
    """High and low quantile of ``y`` per length bin; bins between a group's first and last bin exist, empty ones as 0."""
    binned = df.select(*keys, bin_index(x, width).alias("bin"), y)
    return fill_bins(exact_quantiles(binned, [*keys, "bin"], y, {"q_high": q, "q_low": q_low}), keys, width)


def fill_bins(stats: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The bins between a group's first and last one, with zeros where ``stats`` has none."""
    spans = stats.groupBy(*keys).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    grid = spans.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("bin"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return grid.join(stats, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("bin") * width).alias("left_edge"), zero("q_high"), zero("q_low"),
        (F.coalesce("q_high", F.lit(0.0)) - F.coalesce("q_low", F.lit(0.0))).alias("q_diff"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_shared_edges(df: DataFrame, label: str, x: str, bins: int) -> DataFrame:
    """Counts per label over equal bins of the common range; the last bin is closed, empty bins count 0."""
    rows = df.where(F.col(x).isNotNull()).select(label, F.col(x).cast("double").alias("_x"))
    flat = F.min("_x") == F.max("_x")
    ends = rows.agg(
        F.when(flat, F.min("_x") - 0.5).otherwise(F.min("_x")).alias("_lo"), F.when(flat, F.max("_x") + 0.5).otherwise(F.max("_x")).alias("_hi")
    )
    step = (F.col("_hi") - F.col("_lo")) / bins
    edge = lambda i: F.col("_lo") + i * step
    guess = F.least(F.floor((F.col("_x") - F.col("_lo")) / step), F.lit(bins - 1))
    settled = F.when(F.col("_x") < edge(guess), guess - 1).when((F.col("_x") >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    counted = rows.join(F.broadcast(ends)).groupBy(label, settled.alias("bin")).agg(F.count("*").alias("n"))  # ends: one row
    grid = rows.select(label).distinct().select(label, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    full = grid.join(counted, [label, "bin"], "left").join(F.broadcast(ends))
    return full.select(
        label, "bin", edge(F.col("bin")).alias("left_edge"), edge(F.col("bin") + 1).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def max_by_resolution(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy("resolution").agg(F.max(column).alias(f"max_{column}"))


def series_by_key(df: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """The points of every series in order, as a range-sorted long table: a long series spans several tasks."""
    return df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order, *values).sort(key, order, *values)


def global_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def robust_limits(df: DataFrame, column: str, pad: float = 0.05) -> DataFrame:
    """Axis limits from the 1 % and 99 % quantiles with a margin; min and max, then ±1, replace a flat range."""
    finite = df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")))
    q = exact_quantiles(finite, [], column, {"_lo": 0.01, "_hi": 0.99, "_min": 0.0, "_max": 1.0})
    flat = F.col("_hi") - F.col("_lo") < 1e-9
    lo, hi = F.when(flat, F.col("_min")).otherwise(F.col("_lo")), F.when(flat, F.col("_max")).otherwise(F.col("_hi"))
    spread = q.select(lo.alias("lo"), hi.alias("hi")).select(
        F.when(F.col("hi") - F.col("lo") < 1e-9, F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("hi") - F.col("lo") < 1e-9, F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"),
    )
    margin = pad * (F.col("hi") - F.col("lo"))
    return spread.select((F.col("lo") - margin).alias("lo"), (F.col("hi") + margin).alias("hi"))


def responsibility_stats(df: DataFrame, keys: Sequence[str] = (), column: str = "r") -> DataFrame:
    """Mean, population standard deviation and the 10/50/90 % quantiles."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    q = exact_quantiles(df, keys, column, {"q10": 0.1, "q50": 0.5, "q90": 0.9}).drop("n")
    return moments.join(q, keys) if keys else moments.join(F.broadcast(q))  # one row each


def box_stats(df: DataFrame, short: int = 120, long: int = 150, best: int = 30) -> DataFrame:
    """Quartiles of the shortest and longest texts of the two compared resolutions, after the caps of the figure.

    1024: short texts above 0.5 are left out. 1280: only the ``best`` lowest short texts count, and the short texts
    within 0.55-0.63 are reported as extra points.
    """
    rows = df.where(F.col("text_len").isNotNull() & F.col("edit_dist").isNotNull())
    need = short + long
    few = rows.groupBy("resolution").agg(F.count("*").alias("n")).where(F.col("n") < need).limit(1).collect()
    if few:
        raise ValueError(f"resolution {few[0].resolution} has {few[0].n} rows, {need} are needed")
    tie = ["edit_dist", "id"]
    rank = lambda *o: F.row_number().over(W.partitionBy("resolution").orderBy(*o))
    shortest = rows.withColumn("rn", rank("text_len", *tie)).where(F.col("rn") <= short)
    longest = rows.withColumn("rn", rank(F.desc("text_len"), *tie)).where(F.col("rn") <= long)
    capped = shortest.withColumn("er", F.row_number().over(W.partitionBy("resolution").orderBy("edit_dist", "id"))).where(
        ((F.col("resolution") == 1024) & (F.col("edit_dist") <= 0.5)) | ((F.col("resolution") == 1280) & (F.col("er") <= best))
    )
    pick = lambda d, name: d.where(F.col("resolution").isin(1024, 1280)).select("resolution", F.lit(name).alias("part"), "edit_dist")
    both = pick(capped, "stable").unionByName(pick(longest, "collapse"))
    q = F.percentile("edit_dist", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # at most short + long rows per group
    extra = shortest.where(F.col("resolution") == 1280).agg(F.count_if(F.col("edit_dist").between(0.55, 0.63)).alias("x"))
    stats = both.groupBy("resolution", "part").agg(F.count("*").alias("n"), q.alias("_q"))
    return stats.join(F.broadcast(extra)).select(
        "resolution", "part", "n", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"),
        F.when((F.col("resolution") == 1280) & (F.col("part") == "stable"), F.col("x")).otherwise(0).alias("n_extra"),
    )


def ordered_categories(pages: DataFrame) -> DataFrame:
    """Distinct categories that occur with a reading order."""
    cats = F.transform(
        F.filter("layout_dets", lambda b: b["order"].isNotNull() & b["category_type"].isNotNull()), lambda b: b["category_type"]
    )
    return pages.select(F.explode(F.array_distinct(cats)).alias("category")).groupBy("category").agg(F.count("*").alias("n_pages"))


def relation_list(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode("relations").alias("r")).select("page_id", "r.*")


def distinct_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of groups and points."""
    per = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per.agg(F.count("*").alias("n_groups"), F.sum("_n").alias("n_points"), F.min("_n").alias("min_points"), F.max("_n").alias("max_points"))


def group_scatter(df: DataFrame, key: str, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(points of every group in group order, counts of used and skipped rows per group).

    Blank or non-numeric values are skipped; groups are ordered as numbers where they are numbers.
    """
    parsed = df.select(
        F.col(key).cast("string").alias("grp"), F.col(key).cast("string").try_cast("double").alias("grp_number"),
        F.col(x).cast("string").try_cast("double").alias("x"), F.col(y).cast("string").try_cast("double").alias("y"),
    ).where(F.coalesce(F.trim("grp"), F.lit("")) != "")
    good = F.col("x").isNotNull() & F.col("y").isNotNull()
    points = parsed.where(good).sort(F.col("grp_number").asc_nulls_last(), "grp", "x", "y")
    counts = parsed.groupBy("grp", "grp_number").agg(F.count_if(good).alias("n_used"), F.count_if(~good).alias("n_skipped"))
    return points, counts.sort(F.col("grp_number").asc_nulls_last(), "grp")


def cap_per_group(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of each group; 0 keeps all.

    Spark applies the rank limit before the rows move where ``n`` is at most its window group limit (1,000 unless set).
    A larger ``n`` ranks every group where it is sorted.
    """
    if n <= 0:
        return df
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def facet_points(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], x: str = "text_len") -> DataFrame:
    """Long table of (facet, metric, length, value) with missing values dropped."""
    cast = df.select(*keys, F.col(x).cast("double").alias(x), *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot([*keys, x], list(metrics), "metric", "value").where(F.col(x).isNotNull() & F.col("value").isNotNull())


def nearest_by_key(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted length the recorded width of the nearest length (ties: the shorter length, then the smaller width).

    Both lists are first reduced to distinct lengths; every wanted length then meets only its nearest neighbour on
    either side, found by carrying the last recorded length along the sorted axis within and across length ranges.
    """
    span = 1024
    known = history.groupBy("token_len").agg(F.min("wrap_width").alias("w"))
    axis = known.select("token_len", F.struct("token_len", "w").alias("k")).unionByName(
        wanted.select("token_len").distinct().withColumn("k", F.lit(None).cast("struct<token_len:int,w:int>"))
    ).withColumn("_s", F.floor(F.col("token_len") / span))
    up = W.partitionBy("_s").orderBy("token_len", F.col("k").isNull()).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("_s").orderBy(F.desc("token_len"), F.col("k").isNull()).rowsBetween(W.unboundedPreceding, 0)
    near = axis.withColumn("_below", F.last("k", ignorenulls=True).over(up)).withColumn("_above", F.last("k", ignorenulls=True).over(down))
    per_span = axis.groupBy("_s").agg(F.max("k").alias("_last"), F.min("k").alias("_first"))
    before, after = W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)
    carried = per_span.select("_s", F.last("_last", ignorenulls=True).over(before).alias("_b"), F.last("_first", ignorenulls=True).over(after).alias("_a"))
    both = near.where(F.col("k").isNull()).join(carried, "_s").select(
        "token_len", F.coalesce("_below", "_b").alias("lo"), F.coalesce("_above", "_a").alias("hi")
    )
    low_gap, high_gap = F.col("token_len") - F.col("lo.token_len"), F.col("hi.token_len") - F.col("token_len")
    best = F.when(F.col("hi").isNull() | (low_gap <= high_gap), F.col("lo")).otherwise(F.col("hi"))
    return both.select("token_len", best.alias("b")).select("token_len", F.col("b.token_len").alias("nearest_len"), F.col("b.w").alias("wrap_width"))
