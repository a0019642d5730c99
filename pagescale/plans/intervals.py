"""Queries on high-variance intervals and the clean-up chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.operators import windows as O
from pagescale.operators.aggregates import bin_quantiles
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query, r6
from pagescale.session import cut_lineage

KEYS = "resolution, font_size, line_spacing, letter_spacing"


@query(
    "win1_rolling_centered",
    f"SELECT {KEYS}, bin, round(avg(q_diff) OVER (PARTITION BY {KEYS} ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)+1e-9, 6) AS q_diff_rolling FROM bins",
)
def rolling(spark, d):
    bins = bin_quantiles(fx.analysis_points(spark, d), C.GROUP_KEYS)
    return O.rolling_centered(bins, C.GROUP_KEYS, "q_diff").select(*C.GROUP_KEYS, "bin", r6("q_diff_rolling").alias("q_diff_rolling"))


@query(
    "win2_liftoff_threshold",
    f"""WITH f AS (SELECT *, min(CASE WHEN q_high > 0.01 THEN 1 ELSE 0 END) OVER w3 = 1 AND count(*) OVER w3 = 3 AS r3, min(CASE WHEN q_high > 0.01 THEN 1 ELSE 0 END) OVER w5 = 1 AND count(*) OVER w5 = 5 AS r5 FROM bins
      WINDOW w3 AS (PARTITION BY {KEYS} ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), w5 AS (PARTITION BY {KEYS} ORDER BY bin ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    e AS (SELECT {KEYS}, min(CASE WHEN CASE WHEN resolution IN (1024, 1280) THEN r5 ELSE r3 END THEN bin*100 END) AS edge FROM f GROUP BY {KEYS}),
    m AS (SELECT {KEYS}, max(text_len)::DOUBLE AS Lmax FROM analysis_points GROUP BY {KEYS})
    SELECT {KEYS}, CASE WHEN edge IS NULL THEN Lmax ELSE greatest(edge-50.0::DOUBLE, 0) END AS L0, edge IS NULL AS censored, Lmax FROM m JOIN e USING ({KEYS})""",
)
def liftoff(spark, d):
    pts = cut_lineage(fx.analysis_points(spark, d).select(*C.GROUP_KEYS, "text_len", "edit_distance"), "points")
    return O.liftoff_threshold(bin_quantiles(pts, C.GROUP_KEYS), pts)


INTERVALS = f"""
r AS (SELECT {KEYS}, bin, bin-min(bin) OVER (PARTITION BY {KEYS}) AS i, sum(n) OVER (PARTITION BY {KEYS}) AS np, avg(q_diff) OVER (PARTITION BY {KEYS} ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM bins),
q AS (SELECT *, max(s) OVER (PARTITION BY {KEYS} ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) < 0.1 AND i >= 2 AS quiet_left, max(s) OVER (PARTITION BY {KEYS} ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) < 0.3 AND i <= max(i) OVER (PARTITION BY {KEYS})-2 AS quiet_right,
  min(i) FILTER (WHERE top) OVER (PARTITION BY {KEYS}) AS peak FROM (SELECT *, s = max(s) OVER (PARTITION BY {KEYS}) AS top FROM r)),
a AS (SELECT *, min(CASE WHEN s > 0.15 AND i < peak THEN i END) OVER (PARTITION BY {KEYS}) AS lowest_loud, min(bin) OVER (PARTITION BY {KEYS}) AS b0, max(bin) OVER (PARTITION BY {KEYS}) AS b1 FROM q),
lr AS (SELECT {KEYS}, any_value(np) AS n_points, any_value(b0) AS b0, any_value(b1) AS b1, min(CASE WHEN quiet_right AND i >= peak THEN bin END) AS rb FROM a GROUP BY {KEYS})"""


WALK = f"""{INTERVALS},
walk AS (SELECT {KEYS}, peak+1 AS i, TRUE AS armed, 0 AS stop_i FROM (SELECT DISTINCT {KEYS}, peak FROM a) UNION ALL
  SELECT {KEYS}, i, NOT (armed AND quiet_left) AND (armed OR s > 0.15), CASE WHEN armed AND quiet_left THEN i ELSE stop_i END FROM (
    SELECT a.resolution, a.font_size, a.line_spacing, a.letter_spacing, a.i, w.armed, w.stop_i, a.quiet_left, a.s FROM walk w JOIN a
    ON a.resolution=w.resolution AND a.font_size=w.font_size AND a.line_spacing=w.line_spacing AND a.letter_spacing=w.letter_spacing AND a.i = w.i-1)),
found AS (SELECT {KEYS}, CAST(n_points AS BIGINT) AS n_points, CASE WHEN n_points >= 10 THEN (b0+stop_i+1)*100.0::DOUBLE END AS L, CASE WHEN n_points >= 10 THEN coalesce(rb, b1)*100+50.0::DOUBLE END AS R
  FROM lr JOIN (SELECT * FROM walk WHERE i = 0) w USING ({KEYS}))"""


@query("win3_variance_interval", f"WITH RECURSIVE {WALK} SELECT {KEYS}, n_points, L, R FROM found")
def interval(spark, d):
    return O.variance_interval(fx.analysis_points(spark, d))


@query(
    "win3_variance_interval_right",
    f"WITH {INTERVALS} SELECT {KEYS}, CAST(n_points AS BIGINT) AS n_points, CASE WHEN n_points >= 10 THEN coalesce(rb, b1)*100+50.0::DOUBLE END AS R FROM lr",
)
def interval_right(spark, d):
    return O.variance_interval(fx.analysis_points(spark, d)).drop("L")


FIXED = f"SELECT {KEYS}, floor(quantile_cont(text_len, 0.4)) AS L, floor(quantile_cont(text_len, 0.95)) AS R FROM analysis_points GROUP BY {KEYS}"


def _fixed(pts):
    q = F.percentile("text_len", F.array(F.lit(0.4), F.lit(0.95)))
    return pts.groupBy(*C.GROUP_KEYS).agg(q.alias("q")).select(*C.GROUP_KEYS, F.floor(F.col("q")[0]).cast("double").alias("L"), F.floor(F.col("q")[1]).cast("double").alias("R"))


@query(
    "win4_filter_by_interval",
    f"""WITH lr AS ({FIXED}) SELECT resolution, count(*) AS n, round(sum(edit_distance)+1e-9, 6) AS total FROM analysis_points JOIN lr USING ({KEYS}) JOIN (SELECT {KEYS}, bin, q_high, q_low FROM binned) b USING ({KEYS})
    WHERE b.bin = text_len//100 AND NOT (b.bin*100 > R) AND NOT (b.bin*100 >= L AND b.bin*100 <= R AND edit_distance > q_low + CASE resolution WHEN 1024 THEN 0.2::DOUBLE WHEN 1280 THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END*(q_high-q_low)) GROUP BY resolution""",
)
def by_interval(spark, d):
    pts = fx.analysis_points(spark, d)
    return O.filter_by_interval(pts, _fixed(pts)).groupBy("resolution").agg(F.count("*").alias("n"), r6(F.sum("edit_distance")).alias("total"))


@query(
    "win5_drop_top_n",
    f"""SELECT {KEYS}, count(*) AS n, max(edit_distance) AS worst, round(sum(edit_distance)+1e-9, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY edit_distance DESC, image_id DESC) AS rn FROM analysis_points)
    WHERE rn > CASE resolution WHEN 512 THEN 5 WHEN 640 THEN 10 WHEN 1024 THEN 15 ELSE 20 END GROUP BY {KEYS}""",
)
def drop_worst(spark, d):
    out = O.drop_top_n(fx.analysis_points(spark, d))
    return out.groupBy(*C.GROUP_KEYS).agg(F.count("*").alias("n"), F.max("edit_distance").alias("worst"), r6(F.sum("edit_distance")).alias("total"))


@query(
    "win6_preprocess",
    f"""WITH RECURSIVE {WALK},
    kept AS (SELECT p.* FROM analysis_points p JOIN found USING ({KEYS}) JOIN (SELECT {KEYS}, bin, q_high, q_low FROM binned) b USING ({KEYS}) WHERE b.bin = text_len//100 AND NOT (b.bin*100 > R)
      AND NOT (b.bin*100 >= L AND b.bin*100 <= R AND edit_distance > q_low + CASE resolution WHEN 1024 THEN 0.2::DOUBLE WHEN 1280 THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END*(q_high-q_low))),
    best AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY edit_distance DESC, image_id DESC) AS rn FROM kept),
    fin AS (SELECT {KEYS}, count(*) AS n_kept, max(edit_distance) AS worst, round(avg(edit_distance)+1e-9, 6) AS mean_ed FROM best WHERE rn > CASE resolution WHEN 512 THEN 5 WHEN 640 THEN 10 WHEN 1024 THEN 15 ELSE 20 END
      AND edit_distance <= CASE WHEN resolution IN (512, 640) THEN 0.4 ELSE 0.2 END GROUP BY {KEYS})
    SELECT {KEYS}, L, R, n_kept, worst, mean_ed FROM found LEFT JOIN fin USING ({KEYS})""",
)
def chain(spark, d):
    # The derived measurements are written once; a user reads them from a table.
    kept, intervals = O.preprocess(cut_lineage(fx.analysis_points(spark, d), "points"))
    per = kept.groupBy(*C.GROUP_KEYS).agg(F.count("*").alias("n_kept"), F.max("edit_distance").alias("worst"), r6(F.avg("edit_distance")).alias("mean_ed"))
    return intervals.select(*C.GROUP_KEYS, "L", "R").join(per, C.GROUP_KEYS, "left")
