"""Queries on joins of images, ground truth, predictions, sizes and fitted intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import text as X
from pagescale.operators import joins as O
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query, r6, rounded

KEYS = "resolution, font_size, line_spacing, letter_spacing"


@query(
    "jon1_build_eval",
    "SELECT i.id, g.gt AS label, p.answer, g.text_token_len, g.text_len FROM images i JOIN ground_truth g USING (id) JOIN plain_predictions p USING (id)",
)
def build_eval(spark, d):
    return O.build_eval(fx.images(spark, d), fx.ground_truth(spark, d), fx.predictions(spark, d))


@query(
    "jon2_missing_report",
    """SELECT id, 'ground_truth' AS missing FROM images WHERE id NOT IN (SELECT id FROM ground_truth)
    UNION ALL SELECT id, 'prediction' FROM images WHERE id IN (SELECT id FROM ground_truth) AND id NOT IN (SELECT id FROM predictions)""",
)
def missing(spark, d):
    return O.missing_report(fx.images(spark, d), fx.ground_truth(spark, d), fx.predictions(spark, d))


def _shifted_images(spark, d):
    shifts = F.array(F.lit(""), F.lit("_0_16"), F.lit("_8_8"))
    return fx.images(spark, d).select(F.explode(shifts).alias("s"), "id").select(F.concat(F.lit("x/"), "id", "s", F.lit(".png")).alias("image"))


@query(
    "jon3_build_eval_shifted",
    """SELECT i.id||s.s AS id, g.gt AS label, p.answer, g.text_token_len, g.text_len
    FROM images i, (VALUES (''),('_0_16'),('_8_8')) s(s), ground_truth g, plain_predictions p WHERE g.id = i.id AND p.id = i.id""",
)
def build_shifted(spark, d):
    return O.build_eval_shifted(_shifted_images(spark, d), fx.ground_truth(spark, d), fx.predictions(spark, d))


@query(
    "jon4_enrich_text_len",
    """WITH s AS (SELECT l_orderkey, arg_max(CAST(l_quantity AS INT), (l_linenumber*100000000 + l_partkey*1000 + l_suppkey)*100 + CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY ALL)
    SELECT o_orderkey, coalesce(q, o_custkey) AS text_len, q IS NOT NULL AS updated FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""",
)
def enrich(spark, d):
    target = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", F.col("o_custkey").cast("int").alias("text_len"))
    source = fx.table(spark, d, "lineitem").select(
        F.concat(F.lit("a/"), F.col("l_orderkey"), F.lit(".png")).alias("image"), F.col("l_quantity").cast("int").alias("text_len"),
        # The quantity makes the position total: rows that still tie carry the same value.
        ((F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("int")).alias("pos"),
    )
    return O.enrich_text_len(target, source).drop("id")


@query(
    "jon5_construct_features",
    """SELECT i.id AS image_id, round(i.n_chars/1000.0::DOUBLE, 6) AS patch_density, 28 AS font_size, 6 AS line_spacing, 0 AS letter_spacing, g.text_token_len AS token_len, g.text_len, 1024 AS resolution,
      i.width AS image_W, i.height AS image_H, 14.0533::DOUBLE AS character_width, 26.0::DOUBLE AS character_height, round(14.0533::DOUBLE*1024/i.width, 6) AS model_W, round(26.0::DOUBLE*1024/i.height, 6) AS model_H, m.edit_dist AS edit_distance
    FROM images i JOIN ground_truth g USING (id) LEFT JOIN (SELECT id, edit_dist FROM metric_records WHERE resolution=1024 AND id IN (SELECT id FROM predictions)) m USING (id)""",
)
def features(spark, d):
    im = fx.images(spark, d)
    density = im.select("id", (F.col("n_chars") / 1000.0).alias("capacity"))
    metrics = fx.metric_records(spark, d).where(F.col("resolution") == 1024).select("id", "edit_dist").join(fx.predictions(spark, d).select("id"), "id", "left_semi")
    out = O.construct_features(density, fx.ground_truth(spark, d), im.select("image", "width", "height"), metrics, (28, 6, 0), 1024)
    return out.withColumns({c: F.round(c, 6) for c in ("patch_density", "model_W", "model_H")})


@query(
    "jon6_density_with_metrics",
    """SELECT i.id, round(256.0::DOUBLE/(14.05::DOUBLE*(1024.0::DOUBLE/width)*32.0::DOUBLE*(1024.0::DOUBLE/height))+1e-9, 6) AS patch_density, g.text_token_len, g.text_len, m.edit_dist
    FROM images i JOIN ground_truth g USING (id) LEFT JOIN (SELECT id, edit_dist FROM metric_records WHERE resolution=1024 AND id IN (SELECT id FROM predictions)) m USING (id)""",
)
def density(spark, d):
    metrics = fx.metric_records(spark, d).where(F.col("resolution") == 1024).join(fx.predictions(spark, d).select("id"), "id", "left_semi")
    return O.density_with_metrics(fx.images(spark, d), fx.ground_truth(spark, d), metrics, 14.05, 32.0, 1024).withColumn("patch_density", r6("patch_density"))


@query(
    "jon7_font_lookup",
    """SELECT p_size, count(*) AS n, max(CASE p_size WHEN 20 THEN 10.0369::DOUBLE WHEN 28 THEN 14.0533::DOUBLE WHEN 36 THEN 18.0624::DOUBLE END) AS character_width,
    max(CASE p_size WHEN 20 THEN 19::DOUBLE WHEN 28 THEN 26::DOUBLE WHEN 36 THEN 33::DOUBLE END) AS character_height FROM part GROUP BY p_size""",
)
def fonts(spark, d):
    parts = fx.table(spark, d, "part").select("p_size", F.col("p_size").alias("font_size"))
    return O.font_lookup(parts).groupBy("p_size").agg(F.count("*").alias("n"), F.max("character_width").alias("character_width"), F.max("character_height").alias("character_height"))


@query(
    "jon8_selected_with_gt",
    """WITH ids AS (SELECT DISTINCT id FROM metric_records WHERE edit_dist > 0.5)
    SELECT id, g.gt, g.id IS NOT NULL AS found FROM ids LEFT JOIN ground_truth g USING (id)""",
)
def selected(spark, d):
    gt = fx.ground_truth(spark, d)
    later = gt.withColumn("gt", F.concat(F.lit("late "), "gt")).withColumn("pos", F.col("pos") + 10**9)
    ids = fx.metric_records(spark, d).where(F.col("edit_dist") > 0.5)
    found, none = O.selected_with_gt(ids, gt.unionByName(later))
    return found.withColumn("found", F.lit(True)).unionByName(none.select("id", F.lit(None).cast("string").alias("gt"), F.lit(False).alias("found")))


@query(
    "jon9_canvas_fit",
    """WITH c AS (SELECT DISTINCT CAST(1000+p_size*60 AS INT) AS canvas_w, CAST(600+(p_size*37)%50*70 AS INT) AS canvas_h FROM part)
    SELECT id, width, height, canvas_w, canvas_h, CAST(canvas_w AS BIGINT)*canvas_h AS area FROM images JOIN c ON canvas_w >= width AND canvas_h >= height""",
)
def canvases(spark, d):
    c = fx.table(spark, d, "part").select((1000 + F.col("p_size") * 60).alias("canvas_w"), (600 + F.col("p_size") * 37 % 50 * 70).alias("canvas_h"))
    return O.canvas_fit(fx.images(spark, d).select("id", "width", "height"), c)


@query(
    "jon10_fits_fixed_canvas",
    """SELECT id, width, height, width <= 3584 AND height <= 3584 AS fits, coalesce(CASE WHEN width <= 3584 AND height <= 3584 THEN CAST((3584-width)//2 AS INT) END, -1) AS x,
    coalesce(CASE WHEN width <= 3584 AND height <= 3584 THEN CAST((3584-height)//2 AS INT) END, -1) AS y, (SELECT max(width) FROM images) AS max_w, (SELECT max(height) FROM images) AS max_h FROM images""",
)
def fixed_canvas(spark, d):
    im = fx.images(spark, d)
    return O.fits_fixed_canvas(im).withColumns({"x": F.coalesce("x", F.lit(-1)), "y": F.coalesce("y", F.lit(-1))}).join(F.broadcast(O.largest_size(im)))  # one row


@query(
    "jon11_pages_with_distance",
    r"""SELECT id||'.jpg' AS name, edit_dist, regexp_replace(id, '^(.*)_\d+$', '\1') AS base, CAST(regexp_extract(id, '_(\d+)$', 1) AS INT) AS suffix, TRUE AS found FROM metric_records WHERE id IN (SELECT 'doc_'||doc_id FROM labels)
    UNION ALL SELECT id||'.jpg', edit_dist, '', -1, FALSE FROM metric_records WHERE id NOT IN (SELECT 'doc_'||doc_id FROM labels)""",
)
def page_distance(spark, d):
    edit = fx.metric_records(spark, d).select(F.concat("id", F.lit(".jpg")).alias("name"), "edit_dist")
    info = F.struct(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".jpg")).alias("image_path"), F.col("doc_id").alias("page_no"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    pages = fx.table(spark, d, "labels").select(info.alias("page_info"))
    found, none = O.pages_with_distance(edit, pages)
    return found.select("name", "edit_dist", "base", "suffix", F.lit(True).alias("found")).unionByName(
        none.select("name", "edit_dist", F.lit("").alias("base"), F.lit(-1).alias("suffix"), F.lit(False).alias("found"))
    )


@query("jon12_merge_truncated")
def truncated(spark, d):
    merged = O.merge_truncated(fx.layout_pages(spark, d))
    return merged.select("page_id", F.posexplode("layout_dets").alias("pos", "b")).select(
        "page_id", "pos", F.col("b.anno_id").alias("anno_id"), F.col("b.order").alias("reading_order"), F.col("b.text").alias("text"), F.array_join(F.transform("b.poly", lambda v: v.cast("string")), " ").alias("poly")
    )


SHIFTED = """SELECT id||'_'||resolution||'_0' AS id, text_len, round(edit_dist*(1+(resolution%7)/10.0::DOUBLE), 6) AS edit_dist FROM metric_records WHERE id IN (SELECT 'doc_'||doc_id FROM labels WHERE quality = 1)"""


def _shifted_metrics(spark, d):
    good = fx.table(spark, d, "labels").where(F.col("quality") == 1).select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"))
    m = fx.metric_records(spark, d).join(good, "id", "left_semi")
    return m.select(F.concat("id", F.lit("_"), F.col("resolution"), F.lit("_0")).alias("id"), "text_len", F.round(F.col("edit_dist") * (1 + F.col("resolution") % 7 / 10.0), 6).alias("edit_dist"))


@query(
    "jon13_pair_before_after",
    f"""WITH s AS ({SHIFTED}), b AS (SELECT regexp_replace(id, '^(.+)_\\d+_\\d+$', '\\1') AS base_id, min(edit_dist) AS best FROM s GROUP BY 1)
    SELECT m.id AS base_id, text_len, edit_dist, b.base_id IS NOT NULL AS selected, best AS best_edit_dist FROM metric_records m LEFT JOIN b ON b.base_id = m.id WHERE resolution = 1024""",
)
def before_after(spark, d):
    return O.pair_before_after(fx.metric_records(spark, d).where(F.col("resolution") == 1024), _shifted_metrics(spark, d))


@query(
    "jon14_points_with_sizes",
    "SELECT m.id, m.text_len, edit_dist, round(coalesce(greatest(width, height)/1024.0::DOUBLE, 0), 6) AS scale FROM metric_records m LEFT JOIN (SELECT * FROM images WHERE id IN (SELECT id FROM ground_truth)) i USING (id)",
)
def with_sizes(spark, d):
    sizes = fx.images(spark, d).join(fx.ground_truth(spark, d).select(X.file_stem(F.col("image")).alias("id")), "id", "left_semi")
    return O.points_with_sizes(fx.metric_records(spark, d), sizes).withColumn("scale", F.round("scale", 6))


BOUNDS = f"SELECT {KEYS}, CASE WHEN letter_spacing <> 7 THEN floor(avg(text_len)) END AS L FROM analysis_points GROUP BY {KEYS}"


def _bounds(pts):
    return pts.groupBy(*C.GROUP_KEYS).agg(F.floor(F.avg("text_len")).cast("double").alias("m")).select(*C.GROUP_KEYS, F.when(F.col("letter_spacing") != 7, F.col("m")).alias("L"))


@query(
    "jon15_near_boundary_mean",
    f"""SELECT {KEYS}, round(avg(patch_density)+1e-9, 6) AS patch_density_near, count(*) AS n_near FROM analysis_points JOIN ({BOUNDS}) USING ({KEYS}) WHERE text_len BETWEEN L-50 AND L+50 GROUP BY {KEYS}""",
)
def near(spark, d):
    pts = fx.analysis_points(spark, d)
    return rounded(O.near_boundary_mean(pts, _bounds(pts), "patch_density", 50, "L"), "patch_density_near")


@query(
    "jon16_with_fitted",
    f"SELECT {KEYS}, count(*) AS n, count(CASE WHEN text_len > L THEN 1 END) AS n_right FROM analysis_points JOIN ({BOUNDS}) USING ({KEYS}) WHERE L IS NOT NULL GROUP BY {KEYS}",
)
def fitted(spark, d):
    pts = fx.analysis_points(spark, d)
    joined = O.with_fitted(pts, _bounds(pts).where(F.col("L").isNotNull()), ["L"])
    return joined.groupBy(*C.GROUP_KEYS).agg(F.count("*").alias("n"), F.count_if(F.col("text_len") > F.col("L")).alias("n_right"))
