"""Queries on page geometry, density and token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import geometry as G
from pagescale.operators import mixture as M
from pagescale.operators import pages as O
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query, r6, rounded

SHAPES = ", ".join(f"({n},{i},{j})" for n, (i, j) in enumerate(G._tile_shapes(C.MIN_TILES, C.MAX_TILES)))


def _tiles_sql(side: int) -> str:
    """The tile fold as a walk over the ordered shapes."""
    last = len(G._tile_shapes(C.MIN_TILES, C.MAX_TILES)) - 1
    return f"""shapes(no, i, j) AS (VALUES {SHAPES}),
    walk AS (SELECT id, width, height, -1 AS no, 'inf'::DOUBLE AS gap, 1 AS cols, 1 AS rws FROM images UNION ALL
      SELECT id, width, height, no, CASE WHEN t THEN g ELSE gap END, CASE WHEN t THEN i ELSE cols END, CASE WHEN t THEN j ELSE rws END FROM (
        SELECT w.id, w.width, w.height, s.no, s.i, s.j, w.gap, w.cols, w.rws, abs(w.width/w.height::DOUBLE - s.i/s.j::DOUBLE) AS g,
          abs(w.width/w.height::DOUBLE - s.i/s.j::DOUBLE) < w.gap OR (abs(w.width/w.height::DOUBLE - s.i/s.j::DOUBLE) = w.gap AND w.width::BIGINT*w.height > 0.5*{side}*{side}*s.i*s.j) AS t
        FROM walk w JOIN shapes s ON s.no = w.no+1)),
    tiles AS (SELECT id, width, height, cols, rws FROM walk WHERE no = {last})"""


@query("geo1_patch_density", "SELECT id, round(256.0::DOUBLE/(14.0533::DOUBLE*(640.0::DOUBLE/width)*26*(640.0::DOUBLE/height))+1e-9, 6) AS density, 0.0 AS degenerate FROM images")
def density(spark, d):
    im = fx.images(spark, d)
    at = lambda w: G.patch_density(w, F.col("height"), F.lit(14.0533), F.lit(26.0), F.lit(640.0))
    return im.select("id", r6(at(F.col("width"))).alias("density"), at(-F.col("width")).alias("degenerate"))


@query(
    "geo2_mean_char_size",
    """WITH r AS (SELECT text, doc_id % 3 AS font, row_number() OVER (ORDER BY md5('42/'||doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
    SELECT avg(CASE font WHEN 0 THEN 10.0369::DOUBLE WHEN 1 THEN 14.0533::DOUBLE ELSE 18.0624::DOUBLE END + 1) AS mean_w, avg(CASE font WHEN 0 THEN 19.0::DOUBLE WHEN 1 THEN 26.0::DOUBLE ELSE 33.0::DOUBLE END + 6) AS mean_h, count(*) AS n
    FROM r WHERE rn <= greatest(1, n//4) AND trim(text) <> ''""",
)
def mean_size(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("gt"), F.element_at(F.array(F.lit(20), F.lit(28), F.lit(36)), (F.col("doc_id") % 3 + 1).cast("int")).alias("font_size"))
    rows = docs.withColumn("letter_spacing", F.lit(1)).withColumn("line_spacing", F.lit(6))
    return O.mean_char_size(rows, ["doc_id"], max(1, docs.count() // 4), 42)


@query(
    "geo3_capacity",
    """SELECT id, round(256.0::DOUBLE/((14.0533::DOUBLE+0.5)*s*(26+3.0::DOUBLE)*s)+1e-12, 5) AS capacity FROM (SELECT id, 1024.0::DOUBLE/greatest(width, height) AS s FROM images)""",
)
def capacity(spark, d):
    w, h = G.char_rect_width(F.lit(14.0533), F.lit(1)), G.char_rect_height(F.lit(26.0), F.lit(6))
    return fx.images(spark, d).select("id", F.round(G.capacity(F.col("width"), F.col("height"), w, h, 1024) + 1e-12, 5).alias("capacity"))


@query(
    "geo4_information_density",
    """SELECT resolution, font_size, line_spacing, letter_spacing, round(avg(character_width*character_height/((character_width+letter_spacing)*(character_height+line_spacing))*patch_density)+1e-9, 6) AS information_density FROM analysis_points GROUP BY ALL""",
)
def info(spark, d):
    out = O.information_density(fx.analysis_points(spark, d))
    return out.groupBy(*C.GROUP_KEYS).agg(r6(F.avg("information_density")).alias("information_density"))


@query("geo5_model_size", "SELECT id, round(14.0533::DOUBLE*1280/width+1e-9, 6) AS model_W, round(26.0::DOUBLE*1280/height+1e-9, 6) AS model_H FROM images")
def model(spark, d):
    im = fx.images(spark, d).select("id", F.col("width").alias("image_W"), F.col("height").alias("image_H"), F.lit(1280).alias("resolution"), F.lit(14.0533).alias("character_width"), F.lit(26.0).alias("character_height"))
    return rounded(O.model_size(im).select("id", "model_W", "model_H"))


@query(
    "geo6_vgz_features",
    """SELECT resolution, font_size, count(*) AS n, round(avg(logV)+1e-9, 6) AS log_v_aspect, round(avg(logV+ln(text_len))+1e-9, 6) AS log_v_text, round(avg(logG)+1e-9, 6) AS log_g, round(avg(vision_token_num)+1e-9, 6) AS vt, round(min(y), 7) AS lowest FROM em_points GROUP BY ALL""",
)
def features(spark, d):
    pts = fx.analysis_points(spark, d)
    per = lambda mode: M.vgz_features(pts, mode).groupBy("resolution", "font_size")
    aspect = per("aspect").agg(F.count("*").alias("n"), r6(F.avg("logV")).alias("log_v_aspect"), r6(F.avg("logG")).alias("log_g"), r6(F.avg("vision_token_num")).alias("vt"), F.round(F.min("edit_distance"), 7).alias("lowest"))
    return aspect.join(per("text").agg(r6(F.avg("logV")).alias("log_v_text")), ["resolution", "font_size"])


@query("geo7_tile_grid", f"WITH RECURSIVE {_tiles_sql(640)} SELECT id, cols, rws AS n_rows FROM tiles")
def grid(spark, d):
    return fx.images(spark, d).select("id", G.tile_grid(F.col("width"), F.col("height")).alias("t")).select("id", F.col("t.cols").alias("cols"), F.col("t.rows").alias("n_rows"))


@query(
    "geo8_image_tokens",
    f"WITH RECURSIVE {_tiles_sql(640)} SELECT id, 273 + CASE WHEN width <= 640 AND height <= 640 THEN 0 WHEN cols > 1 OR rws > 1 THEN rws*10*(cols*10+1) ELSE 0 END AS tiled, 273 AS base, 421 AS large, 73 AS tiny, 111 AS small FROM tiles",
)
def tokens(spark, d):
    return fx.images(spark, d).select("id", *[G.image_tokens(F.col("width"), F.col("height"), m).alias(m) for m in ("tiled", "base", "large", "tiny", "small")])


@query(
    "geo9_tile_boxes",
    f"WITH RECURSIVE {_tiles_sql(640)} SELECT id, width, height, CAST(k AS INT) AS tile, CAST(k%cols*640 AS INT) AS x0, CAST(k//cols*640 AS INT) AS y0, CAST((k%cols+1)*640 AS INT) AS x1, CAST((k//cols+1)*640 AS INT) AS y1 FROM (SELECT *, unnest(range(0, cols*rws)) AS k FROM tiles)",
)
def boxes(spark, d):
    return O.tile_rows(fx.images(spark, d).select("id", "width", "height"))


@query("geo10_near_square_layout")
def layout(spark, d):
    got = G.near_square_layout(F.col("text"), F.lit(28), F.lit(6), F.lit(0))
    return rounded(fx.documents(spark, d).select("doc_id", got.alias("l")).select("doc_id", "l.*"), "ratio")


@query("geo11_ratio_ok", "SELECT id, width, height FROM images WHERE width/height::DOUBLE BETWEEN 0.9 AND 1.1")
def ratio(spark, d):
    return O.ratio_ok(fx.images(spark, d)).select("id", "width", "height")
