"""Queries on the gated Beta mixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.operators import mixture as O
from pagescale.operators.sampling import train_test_split
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query, r6, rounded
from pagescale.session import cut_lineage, scratch_path

POINT_IDS = ["image_id", "resolution", *C.STYLE_KEYS]
W0 = {512: -45.5724119331014, 640: -46.13850916228606, 1024: -46.23202179601734, 1280: -42.99133143004373}
GATE = {r: {"w0": w, "a": 2.91046860622506, "alpha": 5.534691214157865, "a0": 1.7, "b0": 54.5, "a1": 12.96, "b1": 3.5} for r, w in W0.items()}
CONSTANT = {r: {"w0": -0.4, "a": 0.0, "alpha": 0.0, "a0": 1.7, "b0": 54.5, "a1": 12.96, "b1": 3.5} for r in W0}
SINGLE = {r: (0.4, 0.8) for r in W0}

NORM = lambda a, b: f"(lgamma({a}+{b})-lgamma({a})-lgamma({b}))"
LOGPDF = lambda a, b: f"(({a}-1)*ln(y)+({b}-1)*ln(1-y)+{NORM(a, b)})"
LSIG = lambda z: f"(least({z}, 0)-ln(1+exp(-abs({z}))))"
W0_SQL = "CASE resolution " + " ".join(f"WHEN {r} THEN {w}::DOUBLE" for r, w in W0.items()) + " END"
HI, LO = LOGPDF("12.96::DOUBLE", "3.5::DOUBLE"), LOGPDF("1.7::DOUBLE", "54.5::DOUBLE")
# Gate over the text form of V: ln V = logV + ln(text_len).
POSTERIOR = f"""zed AS (SELECT *, {W0_SQL} + 2.91046860622506::DOUBLE*(logV+ln(text_len)) + 5.534691214157865::DOUBLE*logG AS z FROM em_points),
parts AS (SELECT *, {LSIG('z')}+{HI} AS hi, {LSIG('-z')}+{LO} AS lo, {LSIG('-0.4::DOUBLE')}+{HI} AS chi, {LSIG('0.4::DOUBLE')}+{LO} AS clo, {LOGPDF('0.4::DOUBLE', '0.8::DOUBLE')} AS one FROM zed),
post AS (SELECT *, 1/(1+exp(-z)) AS pi, 1/(1+exp(lo-hi)) AS r, greatest(hi, lo)+ln(1+exp(-abs(hi-lo))) AS ll, greatest(chi, clo)+ln(1+exp(-abs(chi-clo))) AS cll FROM parts)"""


def _points(spark, d, mode="text", write=False):
    points = fx.analysis_points(spark, d)
    if write:  # the filters of the features would repeat all that makes a point
        points = cut_lineage(points.select(*POINT_IDS, "text_len", "edit_distance", "character_width", "character_height"), "points")
    pts = O.vgz_features(points, mode)
    return cut_lineage(pts.select(*POINT_IDS, "text_len", "edit_distance", "logV", "logG", "vision_token_num"), "em") if write else pts


@query("em1_init_resp", "SELECT resolution, round(sum(CASE WHEN y >= 0.37 THEN 0.95 ELSE 0.05 END), 4) AS total, count(*) AS n FROM em_points GROUP BY ALL")
def init(spark, d):
    return _points(spark, d).groupBy("resolution").agg(F.round(F.sum(O.init_resp(F.col("edit_distance"))), 4).alias("total"), F.count("*").alias("n"))


@query(
    "em2_beta_moments",
    """WITH w AS (SELECT resolution, y, CASE WHEN y >= 0.37 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE END AS w FROM em_points), m AS (SELECT resolution, sum(w*y)/sum(w) AS mean, sum(w*y*y)/sum(w)-power(sum(w*y)/sum(w), 2) AS var FROM w GROUP BY ALL)
    SELECT resolution, round(mean+1e-9, 6) AS mean, round(var+1e-9, 6) AS var, round(mean*(mean*(1-mean)/var-1)+1e-9, 6) AS alpha, round((1-mean)*(mean*(1-mean)/var-1)+1e-9, 6) AS beta FROM m""",
)
def moments(spark, d):
    pts = _points(spark, d).withColumn("w", O.init_resp(F.col("edit_distance")))
    return rounded(O.beta_moments(pts, "edit_distance", "w", ["resolution"]))


def _params_rows(spark, params, key="resolution", places=4):
    cols = list(O.PARAMS)
    rows = [(k, *[round(float(p[c]), places) for c in cols]) for k, p in params.items()]
    return spark.createDataFrame(rows, f"{key} {'string' if isinstance(rows[0][0], str) else 'bigint'}, " + ", ".join(f"{c} double" for c in cols))


@query("em3_beta_mle")
def mle(spark, d):
    a, b = O.fit_beta(_points(spark, d, write=True), "edit_distance")
    n = fx.table(spark, d, "documents").agg(F.count("*").alias("n"))
    return n.withColumn("alpha", F.lit(round(a, 4))).withColumn("beta", F.lit(round(b, 4)))


@query("em4_soft_logit")
def logit(spark, d):
    pts = _points(spark, d, write=True).withColumn("soft", O.init_resp(F.col("edit_distance")))
    beta = O.soft_logit(pts, ["logV", "logG"], "soft", reg=0.5)
    n = pts.agg(F.count("*").alias("n"))
    return n.withColumns({c: F.lit(round(b, 4)) for c, b in zip(("w0", "a", "alpha"), beta)})


@query("em5_e_step", f"WITH {POSTERIOR} SELECT resolution, count(*) AS n, round(avg(pi)+1e-9, 6) AS pi, round(avg(r)+1e-9, 6) AS r, round(sum(ll)+1e-9, 3) AS ll FROM post GROUP BY ALL")
def e_step(spark, d):
    rows = O.e_step(O.with_params(_points(spark, d), GATE))
    return rows.groupBy("resolution").agg(F.count("*").alias("n"), r6(F.avg("pi")).alias("pi"), r6(F.avg("r")).alias("r"), r6(F.sum("ll"), 3).alias("ll"))


def _fit_rows(spark, fit):
    return _params_rows(spark, fit.params, places=3)


@query("em6_em_fit")
def separate(spark, d):
    return _fit_rows(spark, O.em_fit(_points(spark, d, "aspect", write=True)))


@query("em7_em_baselines")
def baselines(spark, d):
    constant, single = O.em_baselines(_points(spark, d, write=True))
    one = spark.createDataFrame([(k, round(a, 4), round(b, 4)) for k, (a, b) in single.items()], "resolution bigint, single_alpha double, single_beta double")
    return _fit_rows(spark, constant).join(one, "resolution")


@query("em8_em_fit_grouped")
def grouped(spark, d):
    return _fit_rows(spark, O.em_fit_grouped(_points(spark, d, write=True)))


@query("em9_em_fit_shared")
def shared(spark, d):
    pts = _points(spark, d, write=True)
    base = (F.col("font_size") == 28) & (F.col("line_spacing") == 6) & (F.col("letter_spacing") == 0)
    return _fit_rows(spark, O.em_fit_shared(pts.where(~base)))


@query("em10_em_fit_shared_slopes")
def shared_slopes(spark, d):
    """The baseline style is held out of the fit."""
    base = (F.col("font_size") == 28) & (F.col("line_spacing") == 6) & (F.col("letter_spacing") == 0)
    return _fit_rows(spark, O.em_fit_shared_slopes(_points(spark, d, write=True).where(~base)))


@query("em11_fit_w0_only")
def w0_only(spark, d):
    pts = _points(spark, d, write=True).where(F.col("resolution").isin(512, 1280))
    name = F.when(F.col("resolution") == 512, "model_a").otherwise("model_b")
    pts = pts.withColumn("model", name).withColumn("logG", F.ln(F.col("text_len") / F.when(name == "model_a", C.MODEL_VISION_TOKENS["model_a"]).otherwise(C.MODEL_VISION_TOKENS["model_b"])))
    fits = O.fit_w0_only(cut_lineage(pts, "models"), {"model_a": GATE[512], "model_b": GATE[1280]}, start=-45.0)
    return spark.createDataFrame([(m, round(w, 5), ok) for m, (w, ok) in fits.items()], "model string, w0 double, converged boolean")


@query(
    "em12_log_likelihoods",
    f"""WITH {POSTERIOR} SELECT resolution, CASE WHEN font_size=28 THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(sum(ll)+1e-9, 3) AS gated_mixture, round(sum(cll)+1e-9, 3) AS constant_pi_mixture, round(sum(one)+1e-9, 3) AS single_beta FROM post GROUP BY ALL
    UNION ALL SELECT NULL, CASE WHEN font_size=28 THEN 'test' ELSE 'train' END, count(*), round(sum(ll)+1e-9, 3), round(sum(cll)+1e-9, 3), round(sum(one)+1e-9, 3) FROM post GROUP BY ALL""",
)
def likelihoods(spark, d):
    pts = _points(spark, d).withColumn("split", F.when(F.col("font_size") == 28, "test").otherwise("train"))
    out = O.overall_likelihoods(O.log_likelihoods(pts, GATE, CONSTANT, SINGLE))
    return out.select("resolution", "split", "n", *[r6(c, 3).alias(c) for c in ("gated_mixture", "constant_pi_mixture", "single_beta")])


@query("em13_em_summary")
def summary(spark, d):
    pts = _points(spark, d, write=True)
    fit = O.em_fit(pts)
    constant, single = O.em_baselines(pts)
    out = cut_lineage(O.summary_frame(spark, pts, fit, constant, single), "summary")
    last = O.history_frame(out).groupBy("resolution").agg(F.max("iteration").alias("last_iteration"), F.max("log_likelihood").alias("ll"))
    flat = out.select(
        "resolution", "n_samples", "converged", r6("vision_token_num").alias("vision_token_num"), r6("gating_params.a", 3).alias("a"), r6("beta_params.high_ed.mean", 4).alias("mean1"),
        r6("beta_params.low_ed.mean", 4).alias("mean0"), r6("responsibility_stats.mean", 4).alias("r_mean"), r6("responsibility_stats.q50", 4).alias("r_q50"),
    )
    return flat.join(last.withColumn("ll", F.round("ll", 2)), "resolution")


@query(
    "em14_score_points",
    f"""WITH {POSTERIOR} SELECT resolution, font_size, line_spacing, letter_spacing, round(avg(pi)+1e-9, 6) AS pi, round(avg((1-pi)*(1.7::DOUBLE/56.2)+pi*(12.96::DOUBLE/16.46))+1e-9, 6) AS expected_ed, round(avg(z)+1e-9, 5) AS z FROM post GROUP BY ALL""",
)
def scored(spark, d):
    out = O.score_points(_points(spark, d), GATE)
    return out.groupBy(*C.GROUP_KEYS).agg(r6(F.avg("pi")).alias("pi"), r6(F.avg("expected_ed")).alias("expected_ed"), r6(F.avg("z"), 5).alias("z"))


@query(
    "em15_expected_curve",
    """WITH m AS (SELECT avg(edit_distance) FILTER (WHERE edit_distance < 0.37) AS m0, avg(edit_distance) FILTER (WHERE edit_distance >= 0.37) AS m1 FROM analysis_points)
    SELECT round(z, 6) AS z, round(1/(1+exp(-z))+1e-9, 6) AS pi, round((1-1/(1+exp(-z)))*m0+m1/(1+exp(-z))+1e-9, 6) AS expected_ed FROM (SELECT -2.0::DOUBLE+i*(5.4::DOUBLE/199) AS z FROM range(0, 200) t(i)), m""",
)
def curve(spark, d):
    low = F.col("edit_distance") < 0.37
    m = fx.analysis_points(spark, d).agg(F.avg(F.when(low, F.col("edit_distance"))).alias("m0"), F.avg(F.when(~low, F.col("edit_distance"))).alias("m1")).first()
    return O.expected_curve(spark, m["m0"], m["m1"]).select(F.round("z", 6).alias("z"), r6("pi").alias("pi"), r6("expected_ed").alias("expected_ed"))


@query("em16_load_params")
def load(spark, d):
    """Summaries of a joint fit are written per resolution, read back, and checked for the shared parameters."""
    pts = _points(spark, d, write=True)
    fit = O.em_fit_shared_slopes(pts)
    out = cut_lineage(O.summary_frame(spark, pts, fit), "summary")
    root = scratch_path(spark, "summaries")
    for res in C.RESOLUTIONS:
        out.where(F.col("resolution") == res).drop("resolution").coalesce(1).write.json(f"{root}/{res}")
    params = O.load_params(spark, f"{root}/*/*.json")
    off = O.check_shared(params, ["a", "alpha", "a0", "b0", "a1", "b1"]).agg(F.count("*").alias("n_off"))
    own = O.check_shared(params, ["w0"]).agg(F.count("*").alias("n_own_w0"))
    return params.select("resolution", *[F.round(c, 3).alias(c) for c in O.PARAMS]).join(F.broadcast(off)).join(F.broadcast(own))  # one row each


@query(
    "em18_collapse_length",
    f"""SELECT resolution, font_size, line_spacing, letter_spacing, round(exp(-(max({W0_SQL}) + 2.91046860622506::DOUBLE*max(logV) - 5.534691214157865::DOUBLE*ln(max(vision_token_num)))/(2.91046860622506::DOUBLE+5.534691214157865::DOUBLE))+1e-9, 4) AS collapse_len FROM em_points GROUP BY ALL""",
)
def collapse(spark, d):
    styles = fx.analysis_points(spark, d).select(*C.GROUP_KEYS, "character_width", "character_height").distinct()
    out = O.collapse_length(O.with_params(styles, GATE), "text")
    return out.select(*C.GROUP_KEYS, r6("collapse_len", 4).alias("collapse_len"))


@query("flow_collapse_model")
def flow(spark, d):
    """Hold out a fifth of the points, fit gate and baselines on the rest, compare likelihoods on both parts."""
    pts = train_test_split(_points(spark, d, write=True), 0.2, 42, POINT_IDS)
    pts = cut_lineage(pts.select("resolution", "split", "edit_distance", "logV", "logG"), "split")
    train = pts.where(F.col("split") == "train")
    fit = O.em_fit(train)
    constant, single = O.em_baselines(train)
    out = O.log_likelihoods(pts, fit.params, constant.params, single)
    return out.select("resolution", "split", "n", *[F.round(c, 1).alias(c) for c in ("gated_mixture", "constant_pi_mixture", "single_beta")])
