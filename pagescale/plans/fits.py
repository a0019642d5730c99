"""Queries on power-law fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.operators import regression as O
from pagescale.operators import windows as Wn
from pagescale.operators.aggregates import bin_quantiles
from pagescale.operators.neighbours import trim_sparse
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query, r6, rounded
from pagescale.session import cut_lineage

KEYS = "resolution, font_size, line_spacing, letter_spacing"
POINT_IDS = ["part"]
PARTS = 64


@query(
    "fit1_fit_k",
    f"""SELECT {KEYS}, round(k+1e-9, 6) AS k, round(k/(resolution*resolution)*1e6+1e-9, 6) AS k_r2, n FROM (SELECT {KEYS}, sum(x*patch_density)/sum(x*x) AS k, count(*) AS n FROM (SELECT *, text_len/(resolution*resolution)::DOUBLE AS x FROM analysis_points WHERE text_len > 0) GROUP BY {KEYS})""",
)
def fit_k(spark, d):
    return rounded(O.fit_k(fx.analysis_points(spark, d)).withColumn("k_r2", F.col("k_r2") * 1e6))


@query(
    "fit2_fit_loglog",
    f"""SELECT {KEYS}, 'linear' AS fit_type, round(regr_slope(yy, x)+1e-9, 5) AS b1, round(regr_intercept(yy, x)+1e-9, 5) AS intercept, round(CASE WHEN regr_count(yy, x) >= 2 THEN regr_r2(yy, x) END+1e-9, 5) AS r2, regr_count(yy, x) AS n_points FROM log_points GROUP BY {KEYS}""",
)
def loglog(spark, d):
    out = O.fit_loglog(fx.analysis_points(spark, d))
    return out.select(*C.GROUP_KEYS, "fit_type", *[r6(c, 5).alias(c) for c in ("b1", "intercept", "r2")], "n_points")


HINGE = """used AS (SELECT resolution, x, yy FROM log_points WHERE x IS NOT NULL),
cuts AS (SELECT resolution, unnest([0,1,2,3,4,5,6]) AS knot, unnest(quantile_cont(x, [0.2,0.3,0.4,0.5,0.6,0.7,0.8])) AS xb FROM used GROUP BY resolution),
h AS (SELECT u.resolution, knot, xb, x, yy, greatest(x-xb, 0) AS h FROM used u JOIN cuts USING (resolution)),
s AS (SELECT resolution, knot, xb, count(*) AS n, var_pop(x) AS xx, var_pop(h) AS hh, var_pop(yy) AS y2, covar_pop(x, h) AS xh, covar_pop(x, yy) AS xy, covar_pop(h, yy) AS hy FROM h GROUP BY ALL),
b AS (SELECT *, (xy*hh-hy*xh)/(xx*hh-xh*xh) AS b1, (hy*xx-xy*xh)/(xx*hh-xh*xh) AS turn FROM s),
f AS (SELECT *, (b1*xy+turn*hy)/y2 AS r2 FROM b)"""


@query(
    "fit3_fit_hinge",
    f"""WITH {HINGE} SELECT resolution, round(xb+1e-9, 5) AS xb, round(b1+1e-9, 4) AS b1, round(b1+turn+1e-9, 4) AS b2, round(r2+1e-9, 5) AS r2, n AS n_points FROM (SELECT *, row_number() OVER (PARTITION BY resolution ORDER BY r2 DESC, knot) AS rn FROM f) WHERE rn = 1""",
)
def hinge(spark, d):
    pts = cut_lineage(fx.analysis_points(spark, d).select("resolution", "text_len", "edit_distance"), "points")
    out = O.fit_hinge(O.log_points(pts), ["resolution"])
    return out.select("resolution", r6("xb", 5).alias("xb"), r6("b1", 4).alias("b1"), r6("b2", 4).alias("b2"), r6("r2", 5).alias("r2"), "n_points")


@query("fit4_trim_sparse")
def trimmed(spark, d):
    """Log-log fits after the sparsest points of every group are dropped."""
    pts = cut_lineage(fx.analysis_points(spark, d).select("image_id", *C.GROUP_KEYS, "text_len", "edit_distance"), "points")
    part = F.pmod(F.xxhash64("image_id"), F.lit(PARTS)).cast("tinyint").alias("part")  # no other use of the name
    logged = O.log_points(pts).select(part, *C.GROUP_KEYS, "x", "y")
    kept = trim_sparse(logged.where(F.col("x").isNotNull()), C.GROUP_KEYS, POINT_IDS)
    return O.line_fits(kept).select(*C.GROUP_KEYS, r6("b1", 5).alias("b1"), r6("r2", 5).alias("r2"), "n_points")


@query("fit5_fit_consensus")
def consensus(spark, d):
    logged = O.log_points(fx.analysis_points(spark, d)).where(F.col("resolution").isin(*C.CONSENSUS_RESOLUTIONS))
    logged = cut_lineage(logged.select("image_id", *C.GROUP_KEYS, "x", "y"), "logged")
    out = O.fit_consensus(logged, C.GROUP_KEYS)
    return out.select(*C.GROUP_KEYS, "fit_type", r6("b1", 5).alias("b1"), r6("intercept", 5).alias("intercept"), r6("r2", 5).alias("r2"), "n_points", "n_inliers")


@query(
    "fit6_pair_stats",
    """SELECT l_returnflag, round(1-sum(power(l_extendedprice-l_quantity*2000, 2))/(var_pop(l_extendedprice)*count(*))+1e-9, 5) AS r2, round(corr(l_quantity, l_extendedprice)+1e-9, 6) AS corr, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def stats(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 2000)
    out = O.pair_stats(li, "l_quantity", "l_extendedprice", "pred", ["l_returnflag"])
    return out.select("l_returnflag", r6("r2", 5).alias("r2"), r6("corr").alias("corr"), "n")


@query("fit7_fit_censored")
def censored(spark, d):
    """Threshold regression on page lengths with the longest twentieth taken as censored, in natural logs."""
    pts = cut_lineage(fx.analysis_points(spark, d).select(*C.GROUP_KEYS, "text_len", "edit_distance"), "points")
    rows = pts.withColumn("y", F.ln("text_len")).withColumn("bound", F.lit(9.6)).withColumn("cens", F.col("y") > 9.6).withColumn("log_r", F.ln(F.col("resolution").cast("double")))
    features = [*C.STYLE_KEYS, "log_r"]
    fit = O.fit_censored(rows, features, "y", "cens", "bound")
    predicted = O.predict_censored(rows, features, fit)
    return predicted.groupBy("resolution").agg(F.count("*").alias("n"), F.count_if("cens").alias("n_censored"), F.round(F.avg("log_l0_pred"), 4).alias("mean_pred")).withColumn("sigma", F.lit(round(fit["sigma"], 4)))


def _with_l0(spark, d):
    """Points with a fixed threshold per resolution."""
    l0 = F.element_at(F.create_map(*[F.lit(x) for kv in {512: 400.0, 640: 500.0, 1024: 600.0, 1280: 700.0}.items() for x in kv]), F.col("resolution"))
    return cut_lineage(fx.analysis_points(spark, d).withColumn("L0", l0), "points")


# The pooled normal equations of (x1, x3, x2) within styles, solved by Cramer's rule.
_XS = ("x1", "x3", "x2")
_H = {(i, j): f"sum(n*covar{min(i, j)}{max(i, j)})" for i in range(3) for j in range(3)}
_DET = lambda m: f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]})-{m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})+{m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"
_CELL = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_COEF = [f"{_DET([[f'g{i}' if j == k else _CELL[i][j] for j in range(3)] for i in range(3)])}/{_DET(_CELL)}" for k in range(3)]
GLOBAL_FIT = f"""pr AS (SELECT *, ln(-ln(1-e)) AS y, ln(excess) AS x1, ln(resolution::DOUBLE) AS x2, ln(excess)*ln(resolution::DOUBLE) AS x3 FROM (
  SELECT *, least(greatest(edit_distance, 1e-6::DOUBLE), 1-1e-6::DOUBLE) AS e, text_len - CASE resolution WHEN 512 THEN 400.0::DOUBLE WHEN 640 THEN 500.0::DOUBLE WHEN 1024 THEN 600.0::DOUBLE ELSE 700.0::DOUBLE END AS excess FROM analysis_points) WHERE excess > 0),
st AS (SELECT font_size, line_spacing, letter_spacing, count(*) AS n, avg(y) AS my, {', '.join(f'avg({x}) AS m{i}, covar_pop({x}, y) AS cy{i}' for i, x in enumerate(_XS))},
  {', '.join(f'covar_pop({_XS[i]}, {_XS[j]}) AS covar{i}{j}' for i in range(3) for j in range(i, 3))} FROM pr GROUP BY ALL),
eq AS (SELECT {', '.join(f'{_H[i, j]} AS h{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'sum(n*cy{i}) AS g{i}' for i in range(3))} FROM st),
co AS (SELECT {_COEF[0]} AS theta_a, {_COEF[1]} AS theta_b, -({_COEF[2]}) AS phi FROM eq),
cs AS (SELECT font_size, line_spacing, letter_spacing, n, my - theta_a*m0 - theta_b*m1 + phi*m2 AS log_c, theta_a, theta_b, phi FROM st, co)"""
GLOBAL_PRED = f"""{GLOBAL_FIT},
pd AS (SELECT pr.*, theta_a + theta_b*x2 AS theta_pred, least(greatest(1-exp(-(exp(log_c)*power(excess, theta_a + theta_b*x2)*power(resolution::DOUBLE, -phi))), 0), 1) AS e_pred, log_c + (theta_a + theta_b*x2)*x1 - phi*x2 AS y_pred
  FROM pr JOIN cs USING (font_size, line_spacing, letter_spacing)),
er AS (SELECT *, e - e_pred AS err, y - y_pred AS res FROM pd),
bg AS (SELECT {KEYS}, count(*) AS n_points, regr_slope(y, x1) AS slope_hat, max(theta_pred) AS theta_pred, regr_r2(y, x1) AS r2_y, regr_slope(y, x1) - max(theta_pred) AS slope_error FROM er GROUP BY {KEYS} HAVING count(*) >= 8)"""
_R = lambda *names: ", ".join(f"round({n}+1e-9, 6) AS {n}" for n in names)


@query("fit8_fit_global_power", f"WITH {GLOBAL_FIT} SELECT font_size, line_spacing, letter_spacing, round(log_c+1e-9, 4) AS log_c, n, round(theta_a, 5) AS theta_a, round(theta_b, 5) AS theta_b, round(phi, 5) AS phi FROM cs")
def global_power(spark, d):
    fit, cs = O.fit_global_power(_with_l0(spark, d))
    return cs.select(*C.STYLE_KEYS, r6(F.ln("c_style"), 4).alias("log_c"), "n").withColumns({k: F.lit(round(fit[k], 5)) for k in ("theta_a", "theta_b", "phi")})


FIXED_FIT = {"theta_a": 0.5, "theta_b": 0.05, "phi": 1.1, "c_median": 0.002}


@query(
    "fit9_predict_power",
    """SELECT resolution, round(avg(least(greatest(1-exp(-(0.002+font_size/1e6::DOUBLE)*power(greatest(text_len-500, 0)::DOUBLE, 0.5+0.05*ln(resolution))*power(resolution::DOUBLE, -1.1)), 0), 1))+1e-9, 6) AS mean_pred FROM analysis_points GROUP BY ALL""",
)
def predict(spark, d):
    pts = fx.analysis_points(spark, d).withColumn("L0", F.lit(500.0))
    cs = pts.select(*C.STYLE_KEYS).distinct().withColumn("c_style", 0.002 + F.col("font_size") / 1e6)
    return O.predict_power(pts, FIXED_FIT, cs).groupBy("resolution").agg(r6(F.avg("e_pred")).alias("mean_pred"))


@query(
    "fit10_power_diagnostics",
    f"""WITH {GLOBAL_PRED},
    ov AS (SELECT count(*) AS n_points_fit, avg(abs(err)) AS mae_e, sqrt(avg(err*err)) AS rmse_e, 1-sum(err*err)/(var_pop(e)*count(*)) AS r2_e, avg(abs(res)) AS mae_y, sqrt(avg(res*res)) AS rmse_y, 1-sum(res*res)/(var_pop(y)*count(*)) AS r2_y,
      corr(res, x1) AS corr_x1, corr(res, x2) AS corr_r, corr(res, x3) AS corr_x3, avg(CASE WHEN edit_distance <= 1e-6 THEN 1.0::DOUBLE ELSE 0 END) AS frac_low_clip, avg(CASE WHEN edit_distance >= 1-1e-6::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS frac_high_clip FROM er),
    gr AS (SELECT count(*) AS n_groups, quantile_cont(r2_y, 0.5) AS median_group_r2, quantile_cont(r2_y, 0.1) AS p10_group_r2, quantile_cont(r2_y, 0.9) AS p90_group_r2, quantile_cont(abs(slope_error), 0.5) AS median_slope_error,
      avg(CASE WHEN r2_y > 0.8 THEN 1.0::DOUBLE ELSE 0 END) AS frac_r2_gt_08 FROM bg),
    rs AS (SELECT *, concat_ws(',', CASE WHEN r2_y IS NULL OR r2_y < 0.5 THEN 'low_r2_y' END, CASE WHEN median_group_r2 < 0.6 THEN 'low_group_linearity' END, CASE WHEN abs(corr_x1) > 0.2 THEN 'residual_follows_length' END, CASE WHEN abs(corr_r) > 0.2 THEN 'residual_follows_resolution' END) AS reasons FROM ov, gr)
    SELECT n_points_fit, n_groups, {_R("mae_e", "rmse_e", "r2_e", "mae_y", "rmse_y", "r2_y", "corr_x1", "corr_r", "corr_x3", "frac_low_clip", "frac_high_clip", "median_group_r2", "p10_group_r2", "p90_group_r2", "median_slope_error", "frac_r2_gt_08")},
      reasons, CASE WHEN reasons = '' THEN 'reasonable' WHEN r2_y >= 0.5 THEN 'mixed' ELSE 'inadequate' END AS verdict FROM rs""",
)
def diagnostics(spark, d):
    pts = _with_l0(spark, d)
    fit, cs = O.fit_global_power(pts)
    metrics, _, _ = O.power_diagnostics(pts, fit, cut_lineage(cs, "styles"))
    return rounded(metrics.withColumn("reasons", F.array_join("reasons", ",")))


@query("fit10_group_slopes", f"WITH {GLOBAL_PRED} SELECT {KEYS}, n_points, {_R('slope_hat', 'theta_pred', 'r2_y', 'slope_error')} FROM bg")
def diagnostics_by_group(spark, d):
    pts = _with_l0(spark, d)
    fit, cs = O.fit_global_power(pts)
    return rounded(O.power_diagnostics(pts, fit, cut_lineage(cs, "styles"))[2])


@query(
    "fit10_power_diagnostics_by_resolution",
    f"WITH {GLOBAL_PRED} SELECT resolution, n_points, {_R('mae_e', 'rmse_e', 'r2_e')} FROM (SELECT resolution, count(*) AS n_points, avg(abs(err)) AS mae_e, sqrt(avg(err*err)) AS rmse_e, 1-sum(err*err)/(var_pop(e)*count(*)) AS r2_e FROM er GROUP BY resolution)",
)
def diagnostics_by_res(spark, d):
    pts = _with_l0(spark, d)
    fit, cs = O.fit_global_power(pts)
    return rounded(O.power_diagnostics(pts, fit, cut_lineage(cs, "styles"))[1])


GROUP_FIT = f"""rw AS (SELECT *, CASE WHEN token_len > 100 THEN ln(token_len-100.0::DOUBLE+1e-6) END AS gx, CASE WHEN token_len > 100 THEN ln(edit_distance+1e-6) END AS gy FROM analysis_points),
g AS (SELECT {KEYS}, regr_count(gy, gx) AS n_points, regr_slope(gy, gx) AS theta, regr_intercept(gy, gx) AS logA, regr_sxx(gy, gx) AS sxx, regr_syy(gy, gx) AS syy, regr_sxy(gy, gx) AS sxy, regr_avgx(gy, gx) AS mx FROM rw GROUP BY {KEYS}),
grp AS (SELECT {KEYS}, n_points, theta, logA, sqrt((syy-theta*sxy)/(n_points-2)/sxx) AS se_theta, sqrt((syy-theta*sxy)/(n_points-2)*(1.0::DOUBLE/n_points+mx*mx/sxx)) AS se_logA, 1-(syy-theta*sxy)/syy AS r2, sqrt((syy-theta*sxy)/n_points) AS rmse FROM g)"""


@query("fit12_fit_group_power", f"WITH {GROUP_FIT} SELECT {KEYS}, n_points, {', '.join(f'round({c}+1e-9, 5) AS {c}' for c in ('theta', 'logA', 'se_theta', 'se_logA', 'r2', 'rmse'))} FROM grp")
def group_power(spark, d):
    out = O.fit_group_power(fx.analysis_points(spark, d).withColumn("L0", F.lit(100.0)))
    return out.select(*C.GROUP_KEYS, "n_points", *[r6(c, 5).alias(c) for c in ("theta", "logA", "se_theta", "se_logA", "r2", "rmse")])


@query("fit13_fit_theta_meta")
def meta(spark, d):
    groups = cut_lineage(O.fit_group_power(fx.analysis_points(spark, d).withColumn("L0", F.lit(100.0))), "groups")
    fit, predicted = O.fit_theta_meta(groups, weight="se", r_feature="log", interactions=True)
    return predicted.select(*C.GROUP_KEYS, r6("theta_pred", 5).alias("theta_pred"), r6("weight", 3).alias("weight")).withColumn("r2", F.lit(round(fit["r2"], 5)))


@query("flow_length_laws")
def flow(spark, d):
    """Clean the measurements by interval, find thresholds, fit ln E on ln L per style and resolution."""
    pts = cut_lineage(fx.analysis_points(spark, d), "points")
    kept = cut_lineage(Wn.preprocess(pts)[0], "kept")
    l0 = Wn.liftoff_threshold(bin_quantiles(kept, C.GROUP_KEYS), kept)
    fits = O.fit_loglog(kept).select(*C.GROUP_KEYS, r6("b1", 5).alias("b1"), r6("r2", 5).alias("r2"), "n_points")
    return fits.join(l0.select(*C.GROUP_KEYS, F.col("L0").alias("lift_off"), "censored"), C.GROUP_KEYS)
