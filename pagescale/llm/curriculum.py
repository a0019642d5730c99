"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescale.llm.common import hash_order, n_words
from pagescale.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.5, 0.0, 0.5)
MAX_PASSES = 3
ROWS_PER_BUCKET = 4000


def cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values)).cast("int") + 1)


def targets(sums: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, max_passes: int = MAX_PASSES) -> DataFrame:
    """Target words of each source, from partial sums (source, size): one row per source, null last.

    Water filling in closed form: sources are filled up in the order of limit over weight. The level that the rest then
    shares by weight rises up to the first source whose limit holds and falls after it, so its maximum is the answer.
    """
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))  # one row per source: no row of a document passes here
    ranked = sources.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", cycle(weights, F.col("rank"))).withColumn("slope", cycle(slopes, F.col("rank")))
    ranked = ranked.withColumn("full", F.col("source_size") * float(max_passes)).withColumn("ratio", F.col("full") / F.col("weight"))
    before = one.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = one.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    filled = ranked.withColumn("used", F.coalesce(F.sum("full").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(rest))
    filled = filled.withColumn("total", F.sum("source_size").over(one)).withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    target = F.least(F.col("full"), F.col("weight") * F.max("level").over(one))
    return filled.select("source", "source_size", "slope", target.alias("target"))


def when_reached(share: Column, slope: Column) -> Column:
    """The time in [0, 1] at which a source with weight 1 + slope * (2t - 1) has been asked for this share of its words.

    The integral of the weight is slope * t^2 + (1 - slope) * t; this is its inverse.
    """
    flat = 1 - slope
    root = F.sqrt(flat * flat + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - flat) / F.when(slope == 0, 1.0).otherwise(2 * slope))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", weights: tuple = WEIGHTS, slopes: tuple = SLOPES, max_passes: int = MAX_PASSES, seed: int = 7) -> DataFrame:
    """Every row with `size`, `source_size`, `target`, `taken`, `passes`, `before` and `slope`; columns of these names are replaced.

    Rows of a source are ordered by a hash of the id. The mix reads that order `target / source_size` times, the last
    time up to the target, so one document at most is taken in part. Prefix sums come from sums of hash buckets, whose
    number follows the number of rows; no source is ever sorted in one task. With `text_col` None, `size` is given.

    Empty and null texts have size 0 and are never taken; a null source is a source of its own; repeated rows count
    each for itself; rows with equal ids follow their size (equal rows are interchangeable); an empty table stays empty.
    """
    own = [c for c in docs.columns if c.lower() not in {"source_size", "target", "taken", "passes", "before", "slope", "_key", "_bucket", "_start", "_inside"} | ({"size"} if text_col else set())]
    size = n_words(F.col(text_col)) if text_col else F.col("size").cast("long")
    digits = max(1, math.ceil(math.log(max(1, docs.count() / ROWS_PER_BUCKET), 16)))
    keyed = docs.select(*own, size.alias("size")) if text_col else docs.select(*own)
    keyed = keyed.withColumn("_key", hash_order(F.col(id_col), seed)).withColumn("_bucket", F.substring("_key", 1, digits))
    sums = cut_lineage(keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("size")), "mix-sums")
    starts = sums.withColumn("_start", F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnRenamed("source", "_source").withColumnRenamed("_bucket", "_b").drop("size")
    aims = targets(sums, weights, slopes, max_passes)
    # one row a source and bucket, written so that its size is known: rows then move once, for the window
    starts = cut_lineage(starts.join(aims, F.col("_source").eqNullSafe(aims["source"])).drop("source"), "mix-starts")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = inside.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))).drop("_source", "_b")
    joined = joined.withColumn("before", F.col("_start") + F.col("_inside")).drop("_inside")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    joined = joined.withColumn("_whole", whole).withColumn("_rest", F.floor(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before")))
    joined = joined.withColumn("taken", F.col("_whole") * F.col("size") + extra)
    passes = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return joined.withColumn("passes", passes).drop("_whole", "_rest", "_start", "_key", "_bucket")


def position(pass_no: Column) -> Column:
    """Training position of a row of `plan` in one of its passes; null where nothing is taken."""
    share = (pass_no * F.col("source_size") + F.col("before")) / F.col("target")
    return F.when(F.col("taken") > 0, when_reached(F.least(F.lit(1.0), share), F.col("slope")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training order: a row for each time a document is read, with `pass_no`, `words` and `position`, range-sorted.

    Rows of which nothing is taken are left out; that is what the weights ask for.
    """
    drawn = plan(docs, **options).where("taken > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    drawn = drawn.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("pass_no") * F.col("size"))).withColumn("position", position(F.col("pass_no")))
    return drawn.drop("before", "slope", "passes").orderBy("position", options.get("id_col", "doc_id"), "pass_no")
