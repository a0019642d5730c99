"""Page-level geometry on tables: densities, mean character size, tiles and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.functions import geometry as G
from pagescale.operators.sampling import sample_n


def information_density(df: DataFrame) -> DataFrame:
    """Patch density times the glyph's share of its cell; untouched without a density column, NULL for unknown fonts."""
    if "patch_density" not in df.columns:
        return df
    share = G.ink_share(F.col("font_size"), F.col("line_spacing"), F.col("letter_spacing"))
    return df.withColumn("information_density", share * F.col("patch_density"))


def model_size(df: DataFrame) -> DataFrame:
    """Character size after the page is scaled to the resolution."""
    return df.withColumn("model_W", F.col("character_width") * F.col("resolution") / F.col("image_W")).withColumn(
        "model_H", F.col("character_height") * F.col("resolution") / F.col("image_H")
    )


def mean_char_size(df: DataFrame, ids: list[str], n: int, seed: int) -> DataFrame:
    """Mean cell width and height over a seeded sample of pages that have text."""
    rows = sample_n(df, n, seed, ids).where(F.trim("gt") != "")
    w = G.font_width(F.col("font_size")) + F.col("letter_spacing")
    h = G.font_height(F.col("font_size")) + F.col("line_spacing")
    return rows.agg(F.avg(w).alias("mean_w"), F.avg(h).alias("mean_h"), F.count("*").alias("n"))


def ratio_ok(df: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    return df.where((F.col("height") > 0) & (F.col("width") / F.col("height")).between(low, high))


def tile_rows(df: DataFrame, side: int = 640) -> DataFrame:
    """One row per tile of every page with its pixel box."""
    grid = df.withColumn("_t", G.tile_grid(F.col("width"), F.col("height"), side=side))
    return grid.select(*df.columns, F.inline(G.tile_boxes(F.col("_t.cols"), F.col("_t.rows"), side)))
