"""Fits against numpy on small samples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions.solve import beta_mle, beta_norm, digamma, trigamma
from pagescale.operators import mixture as M
from pagescale.operators import regression as R
from pagescale.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    return fx.analysis_points(spark, SF).persist()


def test_special_functions():
    assert digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-12)
    rng = np.random.default_rng(0)
    y = rng.beta(2.5, 7.0, 4000)
    a, b = beta_mle(4000, np.log(y).sum(), np.log1p(-y).sum(), (1, 1))
    ll = lambda p, q: (p - 1) * np.log(y).sum() + (q - 1) * np.log1p(-y).sum() + 4000 * beta_norm(p, q)
    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert ll(a, b) >= ll(a + da, b + db)
    assert beta_mle(0, 0, 0, (1, 1)) == (1.0, 1.0)


def test_loglog_and_edges(spark):
    rows = [(512, 28, 6, 0, L, math.exp(-8 + 0.7 * math.log(L))) for L in (100, 300, 900, 2000)] + [(640, 28, 6, 0, 100, 0.1), (640, 28, 6, 0, 200, 0.0), (1280, 28, 6, 0, 500, 0.2)]
    df = spark.createDataFrame(rows, "resolution int, font_size int, line_spacing int, letter_spacing int, text_len int, edit_distance double")
    got = {r.resolution: r for r in R.fit_loglog(df).collect()}
    assert got[512].b1 == pytest.approx(0.7) and got[512].r2 == pytest.approx(1.0) and got[512].n_points == 4
    assert got[640].b1 is None and got[640].r2 is None and got[640].n_points == 1
    assert got[1280].n_points == 0  # shorter than the least log length at this resolution


def test_hinge(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, 400))
    y = 1 + 0.5 * x + 2.0 * np.maximum(x - 6, 0) + rng.normal(0, 0.05, 400)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    got = R.fit_hinge(df, ["g"]).first()
    best = None
    for q in (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8):
        k = np.quantile(x, q)
        X = np.column_stack([np.ones(400), x, np.maximum(x - k, 0)])
        c = np.linalg.lstsq(X, y, rcond=None)[0]
        r2 = 1 - ((y - X @ c) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        if best is None or r2 > best[0]:
            best = (r2, k, c)
    assert (got.r2, got.xb) == pytest.approx(best[:2])
    assert [got.intercept, got.b1, got.b2 - got.b1] == pytest.approx(list(best[2]))


def test_consensus_ignores_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 5, 300)
    y = 2 - 0.3 * x + rng.normal(0, 0.01, 300)
    y[:15] += 3
    df = spark.createDataFrame([("g", f"i{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, image_id string, x double, y double")
    got = R.fit_consensus(df, ["g"], trials=200).first()
    # The best of the random lines has many true points within the threshold; its refit is close to the true line.
    assert got.fit_type == "ransac" and got.n_points == 300
    plain = np.polyfit(x, y, 1)
    assert abs(got.b1 + 0.3) <= abs(plain[0] + 0.3) + 0.02


def test_censored_reaches_the_optimum(spark):
    rng = np.random.default_rng(6)
    X = np.column_stack([rng.normal(10, 3, 500), rng.uniform(0, 1, 500)])
    y = 1.0 + 0.2 * X[:, 0] - 1.5 * X[:, 1] + rng.normal(0, 0.4, 500)
    bound = 3.0
    cens = y > bound
    df = spark.createDataFrame([(float(a), float(b), float(t), bound, bool(c)) for (a, b), t, c in zip(X, y, cens)], "a double, b double, y double, bound double, cens boolean")
    fit = R.fit_censored(df, ["a", "b"], "y", "cens", "bound")
    Z = np.column_stack([np.ones(500), (X - X.mean(0)) / X.std(0)])

    def ll(p):
        s = math.exp(p[-1])
        mu = Z @ p[:-1]
        z = (np.where(cens, bound, y) - mu) / s
        out = np.where(cens, [math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z], -0.5 * z * z - p[-1] - 0.5 * math.log(2 * math.pi))
        return out.sum()

    p = np.array([*fit["beta"], math.log(fit["sigma"])])
    assert ll(p) == pytest.approx(fit["log_likelihood"])
    for i in range(len(p)):
        for h in (1e-3, -1e-3):
            q = p.copy()
            q[i] += h
            assert ll(q) <= ll(p) + 1e-9
    first = R.predict_censored(df, ["a", "b"], fit).first()
    assert first.log_l0_pred == pytest.approx(float(Z[0] @ p[:-1]))


def test_log_survival_tail(spark):
    got = [r.v for r in spark.createDataFrame([(0.0,), (5.0,), (29.9,), (31.0,), (60.0,)], "z double").select(R.log_survival("z").alias("v")).collect()]
    assert got[0] == pytest.approx(math.log(0.5))
    assert got[2] == pytest.approx(-451.3, abs=1.0) and got[3] < got[2] and got[4] == pytest.approx(-0.5 * 3600 - math.log(60) - 0.9189385, abs=1e-3)


def test_global_power_matches_least_squares(spark, points):
    pts = points.withColumn("L0", F.lit(400.0))
    fit, cs = R.fit_global_power(pts)
    p = pts.where("text_len > 400").toPandas()
    e = np.clip(p.edit_distance, 1e-6, 1 - 1e-6)
    y, x1, x2 = np.log(-np.log(1 - e)), np.log(p.text_len - 400.0), np.log(p.resolution.astype(float))
    styles = p.groupby(C.STYLE_KEYS).ngroup().to_numpy()
    X = np.column_stack([x1, x1 * x2, x2, np.eye(36)[styles]])
    c = np.linalg.lstsq(X, y, rcond=None)[0]
    assert [fit["theta_a"], fit["theta_b"], -fit["phi"]] == pytest.approx(list(c[:3]), rel=1e-5, abs=1e-6)
    got = cs.orderBy(*C.STYLE_KEYS).toPandas()
    assert np.log(got.c_style.to_numpy()) == pytest.approx(c[3:], rel=1e-5, abs=1e-4)
    metrics, by_res, by_group = R.power_diagnostics(pts, fit, cs)
    m = metrics.first()
    resid = y - X @ c
    assert m.rmse_y == pytest.approx(float(np.sqrt((resid**2).mean())), rel=1e-6)
    assert m.r2_y == pytest.approx(float(1 - (resid**2).sum() / ((y - y.mean()) ** 2).sum()), rel=1e-6)
    assert m.verdict in ("reasonable", "mixed", "inadequate") and by_res.count() == 4 and by_group.count() == m.n_groups


@pytest.mark.parametrize("weight,inter", [("se", False), ("n", True), ("none", False)])
def test_theta_meta_matches_wls(spark, weight, inter):
    rng = np.random.default_rng(9)
    rows = []
    for r in C.RESOLUTIONS:
        for f in C.FONT_SIZES:
            for l in C.LINE_SPACINGS:
                for c in C.LETTER_SPACINGS:
                    rows.append((r, f, l, c, int(rng.integers(5, 40)), 0.3 + 0.01 * f - 0.002 * l + 0.0001 * r + float(rng.normal(0, 0.05)), float(rng.uniform(0.01, 0.2)) if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "resolution int, font_size int, line_spacing int, letter_spacing int, n_points int, theta double, se_theta double")
    fit, pred = R.fit_theta_meta(df, weight=weight, r_feature="log", interactions=inter)
    used = [r for r in rows if r[4] >= 8]
    base = np.array([[r[1], r[2], r[3], math.log(r[0])] for r in used], dtype=float)
    Z = np.column_stack([base, base[:, 3] * base[:, 0], base[:, 3] * base[:, 1], base[:, 3] * base[:, 2]]) if inter else base
    X = np.column_stack([np.ones(len(used)), (Z - Z.mean(0)) / Z.std(0)])
    y = np.array([r[5] for r in used])
    w = np.array([{"se": 1 / r[6] ** 2 if r[6] else r[4], "n": r[4]}.get(weight, 1.0) for r in used], dtype=float)
    beta = np.linalg.lstsq(X * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    assert fit["beta_standardized"] == pytest.approx(list(beta), rel=1e-6, abs=1e-7)
    raw = np.array(fit["beta_raw"])
    assert raw[0] + Z @ raw[1:] == pytest.approx(X @ beta, rel=1e-6, abs=1e-6)
    assert pred.count() == len(used) == fit["n_groups"]


def numpy_em(X, y, iters=60):
    """A plain EM with full inner fits, for comparison."""
    ly, l1 = np.log(y), np.log1p(-y)
    r = np.where(y >= 0.37, 0.95, 0.05)
    beta = np.zeros(X.shape[1])

    def gate(beta, r):
        for _ in range(50):
            p = 1 / (1 + np.exp(-(X @ beta)))
            step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]), X.T @ (r - p))
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
        return beta

    fitb = lambda w, s: beta_mle(w.sum(), (w * ly).sum(), (w * l1).sum(), s)
    hi, lo, beta = fitb(r, (5, 5)), fitb(1 - r, (2, 20)), gate(beta, r)
    lls = []
    for _ in range(iters):
        z = X @ beta
        a = -np.logaddexp(0, -z) + (hi[0] - 1) * ly + (hi[1] - 1) * l1 + beta_norm(*hi)
        b = -np.logaddexp(0, z) + (lo[0] - 1) * ly + (lo[1] - 1) * l1 + beta_norm(*lo)
        mix = np.logaddexp(a, b)
        lls.append(mix.sum())
        r = np.exp(a - mix)
        hi, lo, beta = fitb(r, hi), fitb(1 - r, lo), gate(beta, r)
    return beta, hi, lo, lls


def test_em_against_numpy(spark, points):
    pts = M.vgz_features(points, "aspect").persist()
    fit = M.em_fit(pts)
    for res in (512, 1280):
        p = pts.where(F.col("resolution") == res).toPandas()
        X = np.column_stack([np.ones(len(p)), p.logV, p.logG])
        beta, hi, lo, lls = numpy_em(X, p.edit_distance.to_numpy())
        got = fit.params[res]
        assert [got["w0"], got["a"], got["alpha"]] == pytest.approx(list(beta), rel=2e-3)
        assert [got["a1"], got["b1"], got["a0"], got["b0"]] == pytest.approx([*hi, *lo], rel=1e-3)
        assert fit.history[res][-1] == pytest.approx(lls[-1], abs=1e-3) and fit.converged[res]
    for h in fit.history.values():
        assert all(b >= a - 1e-6 for a, b in zip(h, h[1:]))
    grouped, own, shared = M.em_fit_grouped(pts), M.em_fit_shared_slopes(pts), M.em_fit_shared(pts)
    assert fit.total_ll >= grouped.total_ll - 1e-3 >= own.total_ll - 2e-3 >= shared.total_ll - 3e-3
    constant, single = M.em_baselines(pts)
    out = M.log_likelihoods(pts.withColumn("split", F.lit("train")), fit.params, constant.params, single).collect()
    for r in out:
        assert r.gated_mixture >= r.constant_pi_mixture >= r.single_beta
        assert r.gated_mixture == pytest.approx(fit.history[r.resolution][-1], abs=1e-2)
    summary = M.summary_frame(spark, pts, fit, constant, single).collect()
    assert {r.resolution for r in summary} == set(C.RESOLUTIONS)
    assert all(r.beta_params.high_ed.mean > r.beta_params.low_ed.mean for r in summary)


def test_label_swap(spark):
    """Started with the threshold turned around, the parts still end in order and the gate turns with them."""
    rng = np.random.default_rng(1)
    g = rng.normal(0, 1, 2000)
    high = rng.random(2000) < 1 / (1 + np.exp(-2 * g))
    y = np.where(high, rng.beta(20, 5, 2000), rng.beta(3, 40, 2000))
    df = spark.createDataFrame([(1, float(a), 0.0, float(b)) for a, b in zip(y, g)], "resolution long, edit_distance double, logV double, logG double")
    right = M.em_fit(df, slopes=2, reg=1e-6)
    turned = M.em_fit(df, slopes=2, reg=1e-6, soft=0.95)
    assert turned.params[1]["a1"] == pytest.approx(right.params[1]["a1"], rel=1e-3)
    assert turned.params[1]["alpha"] == pytest.approx(right.params[1]["alpha"], rel=1e-3)
    assert right.params[1]["alpha"] > 1.5


def test_w0_only(spark, points):
    true = {"w0": 0.0, "a": 2.9, "alpha": 5.5, "a0": 1.7, "b0": 54.5, "a1": 12.96, "b1": 3.5}
    pts = M.vgz_features(points, "text").where(F.col("resolution") == 512).withColumn("model", F.lit("m")).persist()
    w0, ok = M.fit_w0_only(pts, {"m": true}, start=-40.0)["m"]
    assert ok
    ll = lambda w: M.e_step(M.with_params(pts, {"m": {**true, "w0": w}}, "model")).agg(F.sum("ll")).first()[0]
    assert ll(w0) >= max(ll(w0 + 0.01), ll(w0 - 0.01))


def test_collapse_length_golden(spark):
    """Lengths at π = ½ for the baseline style from published gate parameters."""
    params = {r: {"w0": w, "a": fx.GATE_A, "alpha": fx.GATE_ALPHA, "a0": 1.0, "b0": 1.0, "a1": 1.0, "b1": 1.0} for r, w in fx.GATE_W0.items()}
    rows = spark.createDataFrame([(r, 28, 6, 0, 14.0533, 26.0) for r in params], "resolution long, font_size int, line_spacing int, letter_spacing int, character_width double, character_height double")
    got = {r.resolution: round(r.collapse_len) for r in M.collapse_length(M.with_params(rows, params), "text").collect()}
    assert got == {512: 4471, 640: 6406, 1024: 11993, 1280: 10947}


def test_soft_logit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 800)
    soft = 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, soft)], "x double, s double")
    assert M.soft_logit(df, ["x"], "s") == pytest.approx([0.5, 1.5], abs=1e-5)
    assert abs(M.soft_logit(df, ["x"], "s", reg=50.0)[1]) < 1.5


def test_shared_check(spark):
    rows = [(512, -1.0, 2.0, 3.0), (640, -2.0, 2.0, 3.0 + 1e-7), (1024, -2.0, 2.1, 3.0)]
    df = spark.createDataFrame(rows, "resolution long, w0 double, a double, alpha double")
    assert [r.resolution for r in M.check_shared(df, ["a", "alpha"]).collect()] == [1024]


def test_special_functions_over_a_grid(spark):
    from pagescale.functions import special, solve

    xs = [float(x) for x in np.concatenate([np.linspace(-30, 26, 1121), [1.9999999999, 2.0, 2.0000000001, 0.0, -0.0, 1e-300, 100.0, 1e6, -1e6]])]
    got = {r.x: r.v for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.log_erfc(F.col("x")).alias("v")).collect()}
    for x in xs:
        # beyond the range of erfc: the first terms of its asymptotic series
        want = math.log(math.erfc(x)) if x < 26 else -x * x - math.log(x * math.sqrt(math.pi)) + math.log1p(-0.5 / x**2 + 0.75 / x**4 - 1.875 / x**6)
        assert abs(got[x] - want) <= 1e-12 * max(1.0, abs(want)), x
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(special.log_erfc(F.col("x")).alias("v")).collect()
    assert odd[0].v is None and math.isnan(odd[1].v)
    xs = [float(x) for x in np.concatenate([np.geomspace(1e-4, 1e5, 300), [1.0, 0.5, 2.0]])]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t")).collect()
    for r in rows:
        # the log gamma function's own recurrence and known values
        assert abs(r.d - solve.digamma(r.x)) <= 1e-11 * max(1.0, abs(r.d)) and abs(r.t - solve.trigamma(r.x)) <= 1e-11 * max(1.0, abs(r.t))
    known = {r.x: r for r in rows}
    assert known[1.0].d == pytest.approx(-0.57721566490153286, abs=1e-14) and known[1.0].t == pytest.approx(math.pi**2 / 6, abs=1e-14)
    assert known[0.5].d == pytest.approx(-0.57721566490153286 - 2 * math.log(2), abs=1e-13)


def test_gate_step_by_elimination_equals_the_dense_system():
    rng = np.random.default_rng(6)
    sums, params = {}, {}
    for g in range(5):
        a = rng.normal(size=(40, 3))
        h, grad = a.T @ a, rng.normal(size=3)
        sums[g] = {**{f"g{i}": grad[i] for i in range(3)}, **{f"h{i}{j}": h[i, j] for i in range(3) for j in range(i, 3)}}
        params[g] = {"w0": float(g), "a": 0.5, "alpha": -0.25}
    got = M._gate_step(sums, params, 2, True, False, 0.1)
    dense, right = np.zeros((7, 7)), np.zeros(7)
    for g, s in sums.items():
        at = [g, 5, 6]
        for i in range(3):
            right[at[i]] += s[f"g{i}"]
            for j in range(3):
                dense[at[i], at[j]] += s[f"h{min(i, j)}{max(i, j)}"]
    right[5:] -= 0.1 * np.array([0.5, -0.25])
    dense[5:, 5:] += 0.1 * np.eye(2)
    step = np.linalg.solve(dense, right)
    for g in range(5):
        assert [got[g]["w0"], got[g]["a"], got[g]["alpha"]] == pytest.approx([g + step[g], 0.5 + step[5], -0.25 + step[6]], abs=1e-10)


def test_twelve_thousand_groups_share_slopes(spark):
    n = F.col("id")
    x = (n * 7919 % 1000) / 1000.0
    rows = spark.range(60_000).select(
        (n % 12_000).cast("string").alias("resolution"), x.alias("logV"), ((n * 104729 % 997) / 997.0).alias("logG"),
        F.when((n * 31 % 101) / 101.0 < x, 0.8 + 0.1 * (n % 7) / 7.0).otherwise(0.05 + 0.02 * (n % 5)).alias("edit_distance"),
    )
    fit = M.em_fit_shared_slopes(rows, max_iter=3)
    assert len(fit.params) == 12_000 and all(math.isfinite(p["w0"]) for p in fit.params.values())
    assert len({(p["a"], p["alpha"], p["a0"], p["b1"]) for p in fit.params.values()}) == 1 and fit.params["0"]["a"] > 0


def test_hinge_reads_a_row_once(spark):
    """every row was repeated for each knot."""
    rng = np.random.default_rng(8)
    rows = [(g, float(x), None if i % 17 == 0 else float(0.3 * x + max(x - 2, 0) + e)) for g in "ab" for i, (x, e) in enumerate(zip(rng.uniform(0, 4, 200), rng.normal(0, 0.1, 200)))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in R.fit_hinge(df, ["g"]).collect()}
    for g in "ab":
        x = np.array([r[1] for r in rows if r[0] == g])
        y = np.array([np.nan if r[2] is None else r[2] for r in rows if r[0] == g])
        h, ok = np.maximum(x - got[g].xb, 0), ~np.isnan(y)
        cov = lambda a, b: ((a - a.mean()) * (b - b.mean())).mean()
        xy, hy = cov(x[ok], y[ok]), cov(h[ok], y[ok])
        b1, turn = np.linalg.solve([[cov(x, x), cov(x, h)], [cov(x, h), cov(h, h)]], [xy, hy])
        assert (got[g].b1, got[g].b2, got[g].r2) == pytest.approx((b1, b1 + turn, (b1 * xy + turn * hy) / cov(y[ok], y[ok]))) and got[g].n_points == 200


def test_log_erfc_compiles(spark):
    """two loops of 60 and 120 steps ran through an interpreter for every censored row."""
    from pagescale.functions import special

    plan = spark.range(1).select(special.log_erfc(F.col("id")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan


def test_likelihood_sums_do_not_follow_the_order_of_rows(spark):
    """with many rows the rounding of the summed likelihood reached the tolerance of the fit."""
    rng = np.random.default_rng(3)
    ll = np.round(rng.normal(0, 3, 40_000), 3) + 1e5
    whole = math.fsum(ll.tolist())
    for order in (np.arange(len(ll)), rng.permutation(len(ll))):
        rows = spark.createDataFrame([(1, float(v)) for v in ll[order]], "g long, ll double").coalesce(1)
        rows = rows.selectExpr("*", "0.5D as r", "0.5D as pi", "0D as ly", "0D as l1")
        assert abs(M._pass_sums(rows, "g", 0, {1: {}})[1]["ll"] - whole) <= 1e-6


def test_posterior_in_both_tails(spark):
    """two exponentials and one logarithm a row give what the four and three gave."""
    p = {"w0": 0.3, "a": 2.0, "alpha": -1.0, "a0": 1.7, "b0": 54.5, "a1": 12.96, "b1": 3.5}
    rows = [(1, float(y), float(v), 0.5) for y in (1e-6, 0.01, 0.3, 0.9, 1 - 1e-6) for v in (-400.0, -3.0, 0.1, 4.0, 400.0)]
    df = spark.createDataFrame(rows, "resolution long, edit_distance double, logV double, logG double")
    for r in M.e_step(M.with_params(df, {1: p})).collect():
        z = p["w0"] + p["a"] * r.logV + p["alpha"] * r.logG
        part = lambda a, b: (a - 1) * math.log(r.edit_distance) + (b - 1) * math.log1p(-r.edit_distance) + beta_norm(a, b)  # noqa: B023,E731
        hi, lo = part(p["a1"], p["b1"]) - np.logaddexp(0, -z), part(p["a0"], p["b0"]) - np.logaddexp(0, z)
        assert r.ll == pytest.approx(np.logaddexp(hi, lo), abs=1e-11)
        assert r.pi == pytest.approx(np.exp(-np.logaddexp(0, -z)), rel=1e-12) and r.r == pytest.approx(np.exp(hi - np.logaddexp(hi, lo)), rel=1e-10, abs=1e-300)
