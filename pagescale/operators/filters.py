"""Row selection, record upkeep and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import text as X
from pagescale.schema import assert_columns


def by_resolution(values: dict, otherwise, column: str = "resolution") -> Column:
    """A CASE over the resolution column."""
    pick = None
    for res, value in values.items():
        cond = F.col(column) == res
        pick = F.when(cond, F.lit(value)) if pick is None else pick.when(cond, F.lit(value))
    return pick.otherwise(F.lit(otherwise))


def select_high_error(df: DataFrame, ed_min: float, len_lo: int, len_hi: int) -> DataFrame:
    """Distinct ids with a length in range and at least the given edit distance."""
    if len_lo > len_hi:
        raise ValueError("len_lo must not exceed len_hi")
    hit = df.where(F.col("text_len").between(len_lo, len_hi) & (F.col("edit_dist") >= ed_min))
    return hit.select("id").distinct()


def split_by_max_len(df: DataFrame, limit: int = 5627, column: str = "text_token_len") -> tuple[DataFrame, DataFrame]:
    """(kept, removed); a missing length counts as 0."""
    length = F.coalesce(F.col(column), F.lit(0))
    return df.where(length <= limit), df.where(length > limit)


def stable_vs_long(df: DataFrame, stable_max: int = 5000, stable_ed: float = 0.1, long_min: int = 15000) -> DataFrame:
    """Ids labelled ``stable`` (short and accurate) and ``long``; a row may carry both labels."""
    labels = F.array(
        F.when((F.col("text_len") <= stable_max) & (F.col("edit_dist") <= stable_ed), F.lit("stable")),
        F.when(F.col("text_len") >= long_min, F.lit("long")),
    )
    return df.select("id", "text_len", "edit_dist", F.explode(F.array_compact(labels)).alias("label"))


def without_categories(pages: DataFrame, banned: Sequence[str] = ("table", "figure")) -> DataFrame:
    """Pages none of whose layout blocks has a category containing a banned word."""
    pattern = "|".join(banned).lower()
    return pages.where(~F.exists("layout_dets", lambda b: F.coalesce(F.lower(b["category_type"]), F.lit("")).rlike(pattern)))


def keep_blocks(layout: Column, allowed: Sequence[str] = ("title", "text_block")) -> Column:
    """Allowed, not ignored blocks in reading order; blocks without order come last, ties keep their place."""
    kept = F.filter(
        layout,
        lambda b: F.coalesce(F.lower(b["category_type"]), F.lit("")).isin(*allowed) & ~F.coalesce(b["ignore"], F.lit(False)),
    )
    tagged = F.transform(kept, lambda b, i: F.struct(F.coalesce(b["order"], F.lit(2**31 - 1)).alias("o"), i.alias("i")))
    ordered = F.array_sort(tagged)
    return X.let(kept, lambda k: F.transform(ordered, lambda t: F.get(k, t["i"])))


def finite_positive(df: DataFrame, x: str, *ys: str) -> DataFrame:
    """Rows with a positive finite ``x`` and finite other columns."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(reduce(lambda a, b: a & b, [finite(c) for c in (x, *ys)]) & (F.col(x) > 0))


def prefix_filter(names: DataFrame, records: DataFrame, prefix: str, key: str) -> DataFrame:
    """Names with a prefix that also have a record."""
    return names.where(F.col(key).startswith(prefix)).join(records, key, "left_semi")


def style_filter(df: DataFrame, style: tuple = C.BASE_STYLE, exclude: bool = False) -> DataFrame:
    match = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(C.STYLE_KEYS, style)])
    return df.where(~match if exclude else match)


def resolution_policy_filter(df: DataFrame) -> DataFrame:
    """Per-resolution caps of the edit distance; other resolutions pass."""
    cap = by_resolution(C.ERROR_CAP, float("inf"))
    return df.where(F.col("edit_distance") <= cap)


def drop_unfinished(df: DataFrame, eos: str = C.END_TOKEN, skip: bool = True) -> DataFrame:
    """Remove the end token; pages without it are dropped unless ``skip`` is off."""
    kept = df.where(F.contains(F.col("content"), F.lit(eos))) if skip else df
    return kept.withColumn("content", F.replace(F.col("content"), F.lit(eos), F.lit("")))


def upsert_run_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rerun ids take their new finish reason, unseen ids are appended. One combinable aggregate, no window."""
    assert_columns(old, ["image_id", "finish_reason"])
    versions = old.select("image_id", "finish_reason", F.lit(0).alias("v")).unionByName(
        new.select("image_id", "finish_reason", F.lit(1).alias("v"))
    )
    return versions.groupBy("image_id").agg(F.max_by("finish_reason", F.struct("v", "finish_reason")).alias("finish_reason"))


def try_number(col: Column, kind: str = "double") -> Column:
    return col.try_cast(kind)


def to_analysis_rows(metrics: DataFrame, font: int, line: int, letter: int) -> DataFrame:
    """Metric records of all trees as analysis rows with constant style columns."""
    number = lambda c, k: F.col(c).try_cast(k)
    return (
        metrics.select(
            F.col("id").alias("image_id"),
            number("edit_dist", "double").alias("edit_distance"),
            number("text_token_len", "int").alias("token_len"),
            number("text_len", "int").alias("text_len"),
            number("resolution", "int").alias("resolution"),
            F.lit(font).alias("font_size"),
            F.lit(line).alias("line_spacing"),
            F.lit(letter).alias("letter_spacing"),
        )
        .where(F.col("image_id").isNotNull() & F.col("edit_distance").isNotNull())
    )


def concat_groups(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_first(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The first row of each key by position, as a combinable aggregate."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.col(position)).alias("_r")).select("_r.*")


def artifact_diff(used: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    """Counts of new, reused and stale artifacts. One aggregate over both lists."""
    sides = used.select(key, F.lit(1).alias("u"), F.lit(0).alias("e")).unionByName(
        existing.select(key, F.lit(0).alias("u"), F.lit(1).alias("e"))
    )
    per_name = sides.groupBy(key).agg(F.max("u").alias("u"), F.max("e").alias("e"))
    return per_name.agg(
        F.count_if((F.col("u") == 1) & (F.col("e") == 0)).alias("n_new"),
        F.count_if((F.col("u") == 1) & (F.col("e") == 1)).alias("n_reused"),
        F.count_if((F.col("u") == 0) & (F.col("e") == 1)).alias("n_stale"),
    )


def pending_only(inputs: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    return inputs.join(outputs, key, "left_anti")
