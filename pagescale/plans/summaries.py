"""Queries on means, counts, histograms, series and figure tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.operators import aggregates as O
from pagescale.operators import joins as J
from pagescale.operators import windows as Wn
from pagescale.plans import fixtures as fx
from pagescale.plans.alignment import SHIFTED, _shifted_metrics
from pagescale.plans.catalog import query, r6, rounded

KEYS = "resolution, font_size, line_spacing, letter_spacing"


@query(
    "agg2_count_by_dataset",
    """WITH s AS (SELECT lang AS dataset, count(*) AS n_images FROM documents WHERE lang <> 'es' GROUP BY ALL)
    SELECT d.lang AS dataset, m.resolution, count(*) AS n_files, coalesce(max(n_images), 0) AS n_images, count(*) = coalesce(max(n_images), 0) AS complete
    FROM metric_records m JOIN documents d ON m.id = 'doc_'||d.doc_id LEFT JOIN s ON s.dataset = d.lang GROUP BY ALL""",
)
def by_dataset(spark, d):
    docs = fx.table(spark, d, "documents")
    names = docs.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), F.col("lang").alias("dataset"))
    sources = docs.where(F.col("lang") != "es").groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("n_images"))
    return O.count_by_dataset(fx.metric_records(spark, d).join(names, "id"), sources)


@query("agg2_count_totals", "SELECT coalesce(d.lang, 'all') AS dataset, coalesce(m.resolution, 0) AS resolution, count(*) AS n_files FROM metric_records m JOIN documents d ON m.id = 'doc_'||d.doc_id GROUP BY ROLLUP (d.lang, m.resolution)")
def totals(spark, d):
    names = fx.table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), F.col("lang").alias("dataset"))
    out = O.count_totals(fx.metric_records(spark, d).join(names, "id"))
    return out.select(F.coalesce("dataset", F.lit("all")).alias("dataset"), F.coalesce("resolution", F.lit(0)).alias("resolution"), "n_files")


@query("agg3_bin_quantiles", f"SELECT {KEYS}, bin, CAST(bin*100 AS BIGINT) AS left_edge, round(q_high+1e-9, 6) AS q_high, round(q_low+1e-9, 6) AS q_low, round(q_diff+1e-9, 6) AS q_diff, n FROM bins")
def bin_q(spark, d):
    return rounded(O.bin_quantiles(fx.analysis_points(spark, d), C.GROUP_KEYS))


@query(
    "agg4_histogram_shared_edges",
    """WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, (max(n_chars)-min(n_chars))/40.0::DOUBLE AS step FROM documents),
    b AS (SELECT lang, CAST(least(floor((n_chars-lo)/step), 39) AS BIGINT) AS bin, count(*) AS n FROM documents, e GROUP BY ALL),
    g AS (SELECT DISTINCT lang, unnest(range(0, 40)) AS bin FROM documents)
    SELECT g.lang, g.bin, round(lo+g.bin*step, 6) AS left_edge, round(lo+(g.bin+1)*step, 6) AS right_edge, coalesce(b.n, 0) AS n FROM g CROSS JOIN e LEFT JOIN b ON b.lang = g.lang AND b.bin = g.bin""",
)
def histogram(spark, d):
    out = O.histogram_shared_edges(fx.table(spark, d, "documents"), "lang", "n_chars", 40)
    return out.withColumns({c: F.round(c, 6) for c in ("left_edge", "right_edge")})


@query("agg5_max_by_resolution", "SELECT resolution, round(max(patch_density), 6) AS max_patch_density FROM analysis_points GROUP BY ALL")
def max_res(spark, d):
    return O.max_by_resolution(fx.analysis_points(spark, d), "patch_density").withColumn("max_patch_density", F.round("max_patch_density", 6))


@query(
    "agg6_best_of_shifts",
    f"""SELECT regexp_replace(id, '^(.+)_\\d+_\\d+$', '\\1') AS base_id, (min({{'e': edit_dist, 'i': id, 't': text_len}})).i AS best_id, min(edit_dist) AS edit_dist, min(text_len) AS text_len, count(*) AS n_shifts FROM ({SHIFTED}) GROUP BY 1""",
)
def best_shift(spark, d):
    return J.best_per_key(_shifted_metrics(spark, d))


@query("agg7_series_by_key", "SELECT id, resolution, text_len, edit_dist FROM metric_records")
def series(spark, d):
    return O.series_by_key(fx.metric_records(spark, d), "id", "resolution", ["text_len", "edit_dist"])


@query("agg8_global_bounds", "SELECT min(text_len) AS min_text_len, max(text_len) AS max_text_len, min(edit_distance) AS min_edit_distance, max(edit_distance) AS max_edit_distance FROM analysis_points")
def bounds(spark, d):
    return O.global_bounds(fx.analysis_points(spark, d), ["text_len", "edit_distance"])


@query(
    "agg9_robust_limits",
    "SELECT round(lo-0.05*(hi-lo)+1e-9, 5) AS lo, round(hi+0.05*(hi-lo)+1e-9, 5) AS hi FROM (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)",
)
def limits(spark, d):
    out = O.robust_limits(fx.table(spark, d, "lineitem"), "l_extendedprice")
    return out.select(r6("lo", 5).alias("lo"), r6("hi", 5).alias("hi"))


@query(
    "agg10_responsibility_stats",
    "SELECT resolution, round(avg(edit_distance)+1e-9, 6) AS mean, round(stddev_pop(edit_distance)+1e-9, 6) AS std, round(quantile_cont(edit_distance, 0.1)+1e-9, 6) AS q10, round(quantile_cont(edit_distance, 0.5)+1e-9, 6) AS q50, round(quantile_cont(edit_distance, 0.9)+1e-9, 6) AS q90 FROM analysis_points GROUP BY ALL",
)
def resp_stats(spark, d):
    return rounded(O.responsibility_stats(fx.analysis_points(spark, d), ["resolution"], "edit_distance"))


@query(
    "agg11_box_stats",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY resolution ORDER BY text_len, edit_dist, id) AS a, row_number() OVER (PARTITION BY resolution ORDER BY text_len DESC, edit_dist, id) AS z FROM metric_records WHERE resolution IN (1024, 1280)),
    s AS (SELECT *, row_number() OVER (PARTITION BY resolution ORDER BY edit_dist, id) AS er FROM r WHERE a <= 60),
    b AS (SELECT resolution, 'stable' AS part, edit_dist FROM s WHERE (resolution=1024 AND edit_dist<=0.5) OR (resolution=1280 AND er<=30) UNION ALL SELECT resolution, 'collapse', edit_dist FROM r WHERE z <= 75)
    SELECT resolution, part, count(*) AS n, round(quantile_cont(edit_dist, 0.25)+1e-9, 6) AS q25, round(quantile_cont(edit_dist, 0.5)+1e-9, 6) AS q50, round(quantile_cont(edit_dist, 0.75)+1e-9, 6) AS q75,
      CASE WHEN resolution=1280 AND part='stable' THEN (SELECT count(*) FROM s WHERE resolution=1280 AND edit_dist BETWEEN 0.55 AND 0.63) ELSE 0 END AS n_extra FROM b GROUP BY ALL""",
)
def box(spark, d):
    return rounded(O.box_stats(fx.metric_records(spark, d), short=60, long=75))


@query("agg12_ordered_categories", "SELECT category_type AS category, count(DISTINCT page_id) AS n_pages FROM layout_blocks WHERE ord IS NOT NULL GROUP BY ALL")
def categories(spark, d):
    return O.ordered_categories(fx.layout_pages(spark, d))


@query(
    "agg12_relation_list",
    "SELECT page_id, CASE WHEN i%4 IN (0,1) THEN 'truncated' ELSE 'parent_son' END AS relation_type, CAST(i AS INT) AS source_anno_id, CAST(i+1+i%2 AS INT) AS target_anno_id FROM layout_blocks",
)
def relations(spark, d):
    return O.relation_list(fx.layout_pages(spark, d))


@query("agg13_distinct_groups", f"SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_points, min(n) AS min_points, max(n) AS max_points FROM (SELECT {KEYS}, count(*) AS n FROM analysis_points GROUP BY ALL)")
def groups(spark, d):
    return O.distinct_groups(fx.analysis_points(spark, d), C.GROUP_KEYS)


RAW = "SELECT l_shipmode_like AS grp, l_quantity AS q, v FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS l_shipmode_like, l_quantity, CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE CAST(l_discount AS VARCHAR) END AS v FROM lineitem)"


def _raw(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("l_linenumber").cast("string")).alias("grp"), F.col("l_quantity").alias("q"),
        F.when(F.col("l_returnflag") == "R", "bad").otherwise(F.col("l_discount").cast("string")).alias("v"),
    )


@query("agg14_group_scatter", f"SELECT grp, coalesce(TRY_CAST(grp AS DOUBLE), -1) AS grp_number, q AS x, TRY_CAST(v AS DOUBLE) AS y FROM ({RAW}) WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL")
def scatter(spark, d):
    return O.group_scatter(_raw(spark, d), "grp", "q", "v")[0].withColumn("grp_number", F.coalesce("grp_number", F.lit(-1.0)))


@query("agg14_group_scatter_counts", f"SELECT grp, coalesce(TRY_CAST(grp AS DOUBLE), -1) AS grp_number, count(TRY_CAST(v AS DOUBLE)) AS n_used, count(*)-count(TRY_CAST(v AS DOUBLE)) AS n_skipped FROM ({RAW}) GROUP BY ALL")
def scatter_counts(spark, d):
    return O.group_scatter(_raw(spark, d), "grp", "q", "v")[1].withColumn("grp_number", F.coalesce("grp_number", F.lit(-1.0)))


@query(
    "agg15_facet_points",
    "SELECT resolution, text_len::DOUBLE AS text_len, 'edit_dist' AS metric, edit_dist AS value FROM metric_records UNION ALL SELECT resolution, text_len::DOUBLE, 'text_token_len', text_token_len::DOUBLE FROM metric_records",
)
def facets(spark, d):
    return O.facet_points(fx.metric_records(spark, d), ["resolution"], ["edit_dist", "text_token_len"])


@query("win7_order_points", "SELECT resolution, text_len, id, edit_dist FROM metric_records")
def ordered(spark, d):
    return Wn.order_points(fx.metric_records(spark, d).select("resolution", "text_len", "id", "edit_dist"), ["resolution"])


@query(
    "win8_zone_label",
    """SELECT resolution, zone, count(*) AS n FROM (SELECT resolution, CASE WHEN text_len < a THEN 'stable' WHEN text_len < b THEN 'transition' ELSE 'collapse' END AS zone FROM metric_records
    JOIN (VALUES (512,3500,7000),(640,5600,10100),(1024,9500,20300),(1280,8600,21000)) t(resolution, a, b) USING (resolution)) GROUP BY ALL""",
)
def zones(spark, d):
    return Wn.zone_label(fx.metric_records(spark, d)).groupBy("resolution", "zone").agg(F.count("*").alias("n"))


@query(
    "win9_hard_wall_flag",
    """SELECT resolution, coalesce(wall, 'none') AS wall, count(*) AS n FROM (SELECT resolution, CASE WHEN text_len < w THEN 'recoverable' WHEN text_len >= w THEN 'saturated' END AS wall FROM metric_records LEFT JOIN (VALUES (640,11000),(1024,19150)) t(resolution, w) USING (resolution)) GROUP BY ALL""",
)
def walls(spark, d):
    return Wn.hard_wall_flag(fx.metric_records(spark, d)).groupBy("resolution", F.coalesce("wall", F.lit("none")).alias("wall")).agg(F.count("*").alias("n"))


@query(
    "win10_nearest_by_key",
    """WITH k AS (SELECT CAST(n_chars AS INT) AS token_len, min(CAST(doc_id%400 AS INT)) AS w FROM documents WHERE lang = 'en' GROUP BY 1), q AS (SELECT DISTINCT CAST(n_chars AS INT) AS token_len FROM documents WHERE lang <> 'en')
    SELECT token_len, nearest_len, wrap_width FROM (SELECT q.token_len, k.token_len AS nearest_len, k.w AS wrap_width, row_number() OVER (PARTITION BY q.token_len ORDER BY abs(q.token_len-k.token_len), k.token_len) AS rn FROM q, k) WHERE rn = 1""",
)
def nearest(spark, d):
    docs = fx.table(spark, d, "documents").select("lang", F.col("n_chars").cast("int").alias("token_len"), (F.col("doc_id") % 400).cast("int").alias("wrap_width"))
    return O.nearest_by_key(docs.where(F.col("lang") == "en"), docs.where(F.col("lang") != "en"))
