"""Power-law fits. Rows fold into sums on the executors; only sums of a few numbers reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import text as X
from pagescale.functions.special import log_survival
from pagescale.functions.solve import least_squares, newton_step
from pagescale.operators.filters import by_resolution
from pagescale.operators.quantiles import exact_quantiles
from pagescale.session import cut_lineage, meet

FLAT = 1e-12
FEATURES = [*C.STYLE_KEYS, "r"]


def fit_k(df: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS)) -> DataFrame:
    """Slope through the origin of density against length / R², reported as k / R²."""
    ok = F.col("text_len").isNotNull() & F.col("patch_density").isNotNull() & (F.col("text_len") > 0)
    x = F.when(ok, F.col("text_len") / F.pow(F.col("resolution").cast("double"), F.lit(2.0)))
    sums = df.groupBy(*keys).agg(
        F.sum(x * x).alias("_xx"), F.sum(x * F.col("patch_density")).alias("_xy"), F.count(x).alias("n")
    )
    k = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx"))
    return sums.select(*keys, k.alias("k"), (k / F.pow(F.col("resolution").cast("double"), F.lit(2.0))).alias("k_r2"), "n")


def safe_r2(slope: str, x: str, y: str) -> Column:
    """R² of the least-squares line as an aggregate; NULL under two points or for flat y."""
    return F.when((F.regr_count(y, x) >= 2) & (F.regr_syy(y, x) > FLAT), F.regr_r2(y, x))


def safe_corr(x: Column, y: Column) -> Column:
    flat = (F.stddev_pop(x) <= FLAT) | (F.stddev_pop(y) <= FLAT)
    return F.when(~flat, F.corr(x, y))


def pair_stats(df: DataFrame, x: str, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """R² of given predictions and Pearson correlation, NULL where undefined."""
    sse = F.sum(F.pow(F.col(y) - F.col(pred), F.lit(2.0)))
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.when((F.count(y) >= 2) & (sst > FLAT), 1 - sse / sst).alias("r2"), safe_corr(F.col(x), F.col(y)).alias("corr"), F.count(y).alias("n")
    )


def log_points(df: DataFrame, l0: Column | float = 0.0) -> DataFrame:
    """Adds ``x = ln L`` and ``y = ln E``, NULL for points outside the fit."""
    l0 = l0 if isinstance(l0, Column) else F.lit(l0)
    ok = (F.col("text_len") > l0) & (F.col("edit_distance") > 0)
    x, y = F.when(ok, F.ln("text_len")), F.when(ok, F.ln("edit_distance"))
    keep = (y >= C.LOG_ERROR_MIN) & (x >= by_resolution(C.MIN_LOG_LENGTH, float("-inf")))
    return df.withColumn("x", F.when(keep, x)).withColumn("y", F.when(keep, y))


def fit_loglog(points: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS), l0: Column | float = 0.0) -> DataFrame:
    """Least-squares line of ln E on ln L per group; groups without usable points keep a row with NULLs."""
    return line_fits(log_points(points, l0), keys, l0)


def line_fits(logged: DataFrame, keys: Sequence[str] = tuple(C.GROUP_KEYS), l0: Column | float = 0.0) -> DataFrame:
    l0 = l0 if isinstance(l0, Column) else F.lit(float(l0))
    fits = logged.groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("b1"), F.regr_intercept("y", "x").alias("intercept"),
        safe_r2("b1", "x", "y").alias("r2"), F.regr_count("y", "x").alias("n_points"), F.first(l0).alias("L0"),
    )
    return fits.select(
        *keys, F.lit("linear").alias("fit_type"), "L0", F.lit(None).cast("double").alias("xb"), F.lit(None).cast("double").alias("L_break"),
        "b1", F.col("b1").alias("b2"), "intercept", "r2", "n_points",
    )


def fit_hinge(logged: DataFrame, keys: Sequence[str], knots: Sequence[float] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Two-segment line per group; the knot is the quantile of x with the best R² (the earlier one on a tie)."""
    keys = list(keys)
    used = logged.where(F.col("x").isNotNull())
    cuts = exact_quantiles(used, keys, "x", {f"q{i}": q for i, q in enumerate(knots)})
    # A row is read once: it counts in its segment between knots, and the few segments are pooled for every knot.
    grid = cut_lineage(cuts.select(*keys, F.array(*[F.col(f"q{i}") for i in range(len(knots))]).alias("_xb")), "knots")
    place = sum((F.col("x") > F.get("_xb", F.lit(i))).cast("int") for i in range(len(knots)))
    both = F.col("y").isNotNull()
    segments = used.select(*keys, "x", "y").join(grid, keys).groupBy(*keys, place.alias("seg")).agg(
        F.count("*").alias("c"), F.avg("x").alias("ax"), F.var_pop("x").alias("vx"), F.count("y").alias("cy"), F.avg(F.when(both, F.col("x"))).alias("axy"),
        F.avg("y").alias("ay"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"),
    )
    parts = segments.join(grid, keys).select(*keys, *[c for c in segments.columns if c not in keys], F.posexplode("_xb").alias("knot", "xb"))
    over = lambda value: F.when(F.col("seg") > F.col("knot"), value).otherwise(0.0)
    parts = parts.withColumns({"ah": over(F.col("ax") - F.col("xb")), "ahy": over(F.col("axy") - F.col("xb")), "vh": over(F.col("vx")), "chy": over(F.col("cxy"))})
    mine = W.partitionBy(*keys, "knot")
    mean = lambda n, m: F.sum(F.col(n) * F.col(m)).over(mine) / F.nullif(F.sum(n).over(mine), F.lit(0))
    off = lambda m: F.col(m) - F.col(f"_{m}")
    parts = parts.withColumns({f"_{m}": mean("c", m) for m in ("ax", "ah")} | {f"_{m}": mean("cy", m) for m in ("axy", "ahy", "ay")})
    pooled = lambda n, own, a, b: F.sum(F.col(n) * (own + off(a) * off(b))) / F.nullif(F.sum(n), F.lit(0))
    s = parts.groupBy(*keys, "knot", "xb").agg(
        F.sum("c").alias("n"), F.max("_ax").alias("mx"), F.max("_ah").alias("mh"), F.max("_ay").alias("my"),
        pooled("c", F.col("vx"), "ax", "ax").alias("xx"), pooled("c", F.col("vh"), "ah", "ah").alias("hh"), pooled("cy", F.col("vy"), "ay", "ay").alias("yy"),
        pooled("c", F.col("vh"), "ax", "ah").alias("xh"), pooled("cy", F.col("cxy"), "axy", "ay").alias("xy"), pooled("cy", F.col("chy"), "ahy", "ay").alias("hy"),
    )
    det = F.col("xx") * F.col("hh") - F.col("xh") * F.col("xh")
    solvable = det > FLAT * F.col("xx") * F.col("hh")
    s = s.withColumn("b1", F.when(solvable, (F.col("xy") * F.col("hh") - F.col("hy") * F.col("xh")) / det)).withColumn(
        "turn", F.when(solvable, (F.col("hy") * F.col("xx") - F.col("xy") * F.col("xh")) / det)
    )
    explained = F.col("b1") * F.col("xy") + F.col("turn") * F.col("hy")
    s = s.withColumn("r2", F.when(F.col("yy") * F.col("n") > FLAT, explained / F.col("yy")))
    row = F.struct("xb", "b1", "turn", "mx", "mh", "my", "r2", "n")
    best = s.groupBy(*keys).agg(F.max_by(row, F.struct(F.coalesce("r2", F.lit(float("-inf"))), -F.col("knot"))).alias("f"))
    return best.select(
        *keys, F.lit("hinge").alias("fit_type"), F.col("f.xb").alias("xb"), F.exp("f.xb").alias("L_break"), F.col("f.b1").alias("b1"),
        (F.col("f.b1") + F.col("f.turn")).alias("b2"),
        (F.col("f.my") - F.col("f.b1") * F.col("f.mx") - F.col("f.turn") * F.col("f.mh")).alias("intercept"),
        F.col("f.r2").alias("r2"), F.col("f.n").alias("n_points"),
    )


def fit_consensus(
    logged: DataFrame, keys: Sequence[str], trials: int = C.CONSENSUS_TRIALS, share: float = C.CONSENSUS_SHARE,
    residual: float = C.CONSENSUS_RESIDUAL, seed: int = 77, ids: Sequence[str] = ("image_id",), slots: int = 100,
) -> DataFrame:
    """Consensus line: of many lines through random shares of the points, the one with most points within ``residual``.

    Points hash into ``slots`` slots and fold into slot sums, so a trial (all slots but a random tenth) is a sum of at
    most ``slots`` rows. Points are read once more to count the inliers of each line and refit on those of the best.
    """
    keys = list(keys)
    used = logged.where(F.col("x").isNotNull()).select(*keys, *ids, "x", "y")
    slotted = used.groupBy(*keys, F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(slots)).alias("slot")).agg(
        F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy")
    )
    dropped = slots - round(share * slots)
    trial_slots = slotted.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    # A slot is left out of a trial when its position in the trial's random slot order is among the last.
    place = F.pmod(F.xxhash64("trial", F.lit(seed)), F.lit(slots))
    stride = F.element_at(F.array(*[F.lit(p) for p in range(1, slots) if math.gcd(p, slots) == 1]), (F.pmod(F.xxhash64("trial", F.lit(seed + 1)), F.lit(sum(math.gcd(p, slots) == 1 for p in range(1, slots)))) + 1).cast("int"))
    inside = F.pmod(F.col("slot") * stride + place, F.lit(slots)) >= dropped
    t = trial_slots.where(inside).groupBy(*keys, "trial").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(det > FLAT * F.col("n") * F.col("sxx"), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    lines = t.withColumn("b", slope).where(F.col("b").isNotNull()).withColumn("a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("n"))
    packed = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("trial", "a", "b"))).alias("lines"))  # `trials` lines
    near = lambda a, b: F.abs(F.col("y") - a - b * F.col("x")) <= residual
    # the state of a group is one count for every line; a point is read once and makes no rows
    line = lambda t: F.get("lines", F.lit(t))
    packed = cut_lineage(packed, "lines")
    counts = used.join(packed, keys).groupBy(*keys).agg(*[F.count_if(near(line(t)["a"], line(t)["b"])).alias(f"_n{t}") for t in range(trials)])
    votes = counts.select(*keys, F.array(*[f"_n{t}" for t in range(trials)]).alias("n_in")).join(packed, keys)
    scored = F.transform(F.arrays_zip("lines", "n_in"), lambda x: F.struct(x["n_in"].alias("n_in"), (-x["lines"]["trial"]).alias("first"), x["lines"]["a"].alias("a"), x["lines"]["b"].alias("b")))
    best = votes.select(*keys, F.array_max(F.filter(scored, lambda x: x["a"].isNotNull())).alias("w"))
    marked = meet(used, best, keys).withColumn("_in", near(F.col("w.a"), F.col("w.b")) & (F.col("w.n_in") >= 2))
    xi, yi = F.when(F.col("_in"), F.col("x")), F.when(F.col("_in"), F.col("y"))
    stats = marked.withColumn("xi", xi).withColumn("yi", yi).groupBy(*keys).agg(
        F.regr_slope("yi", "xi").alias("bi"), F.regr_intercept("yi", "xi").alias("ai"), F.regr_slope("y", "x").alias("b0"),
        F.regr_intercept("y", "x").alias("a0"), F.regr_count("y", "x").alias("n"), F.regr_count("yi", "xi").alias("n_inliers"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"), F.regr_avgx("y", "x").alias("mx"), F.regr_avgy("y", "x").alias("my"),
    )
    b, a = F.coalesce("bi", "b0"), F.when(F.col("bi").isNotNull(), F.col("ai")).otherwise(F.col("a0"))
    offset = F.col("my") - a - b * F.col("mx")
    sse = F.col("syy") - 2 * b * F.col("sxy") + b * b * F.col("sxx") + F.col("n") * offset * offset
    return stats.select(
        *keys, F.when(F.col("bi").isNotNull(), "ransac").otherwise("linear").alias("fit_type"), F.lit(None).cast("double").alias("xb"),
        F.lit(None).cast("double").alias("L_break"), b.alias("b1"), b.alias("b2"), a.alias("intercept"),
        F.when((F.col("n") >= 2) & (F.col("syy") > FLAT), 1 - sse / F.col("syy")).alias("r2"), F.col("n").alias("n_points"), "n_inliers",
    )


# --- censored threshold regression --------------------------------------------------------------------------------


def _moments(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean = np.array([row[f"m_{f}"] for f in features], dtype=float)
    std = np.array([row[f"s_{f}"] for f in features], dtype=float)
    return mean, np.where(std < FLAT, 1.0, std)


def _standard(features: Sequence[str], mean: np.ndarray, std: np.ndarray) -> list[Column]:
    return [F.lit(1.0), *[(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, mean, std)]]


def _cross(cols: Sequence[Column], weight: Column) -> list[Column]:
    return [F.sum(weight * cols[i] * cols[j]).alias(f"h_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]


def _matrix(row, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            m[i, j] = m[j, i] = row[f"h_{i}_{j}"] or 0.0
    return m


def fit_censored(df: DataFrame, features: Sequence[str], y: str, censored: str, bound: str, max_steps: int = 60) -> dict:
    """Normal regression with right-censored rows on standardised features: damped Newton, one aggregate per step."""
    mean, std = _moments(df, features)
    xs = _standard(features, mean, std)
    p = len(xs)
    names = [f"_x{i}" for i in range(p)]
    rows = df.select(*[c.cast("double").alias(n) for n, c in zip(names, xs)], F.col(censored).alias("_cens"), F.when(F.col(censored), F.col(bound)).otherwise(F.col(y)).cast("double").alias("_t")).persist()
    cols = [F.col(n) for n in names]
    seen = rows.where(~F.col("_cens"))
    first = seen.agg(F.count("*").alias("n"), *_cross(cols, F.lit(1.0)), *[F.sum(c * F.col("_t")).alias(f"g_{i}") for i, c in enumerate(cols)], F.sum(F.col("_t") * F.col("_t")).alias("tt")).first()
    theta = np.zeros(p + 1)
    theta[-1] = math.log(0.5)
    if first["n"] >= p:
        xtx, xty = _matrix(first, p), np.array([first[f"g_{i}"] for i in range(p)])
        theta[:p] = least_squares(xtx, xty)
        sse = max(first["tt"] - 2 * theta[:p] @ xty + theta[:p] @ xtx @ theta[:p], 0.0)
        theta[-1] = math.log(max(math.sqrt(sse / first["n"]), 1e-3))

    def sums(t: np.ndarray):
        sigma = math.exp(t[-1])
        z = (F.col("_t") - sum(float(b) * c for b, c in zip(t[:p], cols))) / sigma
        base = rows.withColumn("_z", z)
        base = base.withColumn("_ls", F.when(F.col("_cens"), log_survival(F.col("_z"))))
        hazard = F.exp(-0.5 * F.col("_z") * F.col("_z") - 0.5 * math.log(2 * math.pi) - F.col("_ls"))
        base = base.withColumn("_h", F.when(F.col("_cens"), hazard))
        d1 = F.when(F.col("_cens"), -F.col("_h")).otherwise(-F.col("_z"))
        d2 = F.when(F.col("_cens"), -F.col("_h") * (F.col("_h") - F.col("_z"))).otherwise(F.lit(-1.0))
        ll = F.when(F.col("_cens"), F.col("_ls")).otherwise(-0.5 * F.col("_z") * F.col("_z") - float(t[-1]) - 0.5 * math.log(2 * math.pi))
        base = base.withColumn("_d1", d1).withColumn("_d2", d2).withColumn("_ll", ll)
        zs = [-c / sigma for c in cols] + [-F.col("_z")]  # derivative of z by each parameter
        curve = F.col("_d1")
        gs = [F.sum(F.col("_d1") * dz).alias(f"g_{i}") for i, dz in enumerate(zs)]
        hs = []
        for i in range(p + 1):
            for j in range(i, p + 1):
                second = F.lit(0.0) if j < p else (cols[i] / sigma if i < p else F.col("_z"))
                hs.append(F.sum(F.col("_d2") * zs[i] * zs[j] + curve * second).alias(f"h_{i}_{j}"))
        row = base.agg(F.sum("_ll").alias("ll"), F.count_if(~F.col("_cens")).alias("nu"), *gs, *hs).first()
        grad = np.array([row[f"g_{i}"] for i in range(p + 1)])
        grad[-1] -= row["nu"]
        return row["ll"], grad, _matrix(row, p + 1)

    ll, grad, hess = sums(theta)
    for _ in range(max_steps):
        step = newton_step(-hess, grad)
        scale = min(1.0, 2.0 / max(abs(step[-1]), 1e-9)) if abs(step[-1]) > 2.0 else 1.0
        while True:
            trial = sums(theta + scale * step)
            if trial[0] >= ll - 1e-12 or scale < 1e-6:
                break
            scale *= 0.5
        done = abs(trial[0] - ll) < 1e-9 * (1 + abs(ll))
        theta, (ll, grad, hess) = theta + scale * step, trial
        if done:
            break
    rows.unpersist()
    return {"beta": theta[:p].tolist(), "sigma": math.exp(theta[-1]), "means": mean.tolist(), "stds": std.tolist(), "log_likelihood": ll}


def predict_censored(df: DataFrame, features: Sequence[str], fit: dict, name: str = "log_l0_pred") -> DataFrame:
    xs = _standard(features, np.array(fit["means"]), np.array(fit["stds"]))
    return df.withColumn(name, sum(F.lit(float(b)) * x for b, x in zip(fit["beta"], xs)))


# --- global power law ---------------------------------------------------------------------------------------------


def power_rows(points: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Rows right of L0 with the transformed error and the regressors; ``points`` carry a column L0."""
    e = F.least(F.greatest(F.col("edit_distance"), F.lit(eps)), F.lit(1.0 - 1e-6))
    right = points.withColumn("excess", F.col("text_len") - F.col("L0")).where(F.col("excess") > 0).withColumn("e", e)
    return (
        right.withColumn("y", F.ln(-F.ln(1.0 - F.col("e")))).withColumn("x1", F.ln("excess")).withColumn("x2", F.ln(F.col("resolution").cast("double")))
        .withColumn("x3", F.col("x1") * F.col("x2"))
    )


def fit_global_power(points: DataFrame, eps: float = 1e-6) -> tuple[dict, DataFrame]:
    """({theta_a, theta_b, phi, c_median}, C per style) of y = ln C(style) + (a + b ln R) x1 - φ ln R.

    The style intercepts drop out by centring inside each style, which leaves three normal equations.
    """
    rows = power_rows(points, eps)
    xs = ["x1", "x3", "x2"]
    style = rows.groupBy(*C.STYLE_KEYS).agg(
        F.count("*").alias("n"), F.avg("y").alias("my"), *[F.avg(x).alias(f"m_{x}") for x in xs],
        *[F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j],
        *[F.covar_pop(a, "y").alias(f"cy_{i}") for i, a in enumerate(xs)],
    )
    style = cut_lineage(style, "styles")  # one row a style, read by two aggregates and by the result
    row = style.agg(
        *[F.sum(F.col("n") * F.col(f"c_{i}_{j}")).alias(f"h_{i}_{j}") for i in range(3) for j in range(i, 3)],
        *[F.sum(F.col("n") * F.col(f"cy_{i}")).alias(f"g_{i}") for i in range(3)],
    ).first()
    if row["g_0"] is None:
        raise RuntimeError("no points to the right of L0")
    coef = least_squares(_matrix(row, 3), np.array([row[f"g_{i}"] for i in range(3)]))
    log_c = F.col("my") - sum(float(b) * F.col(f"m_{x}") for b, x in zip(coef, xs))
    cs = style.select(*C.STYLE_KEYS, F.exp(log_c).alias("c_style"), "n")
    median = cs.agg(F.percentile("c_style", 0.5).alias("m")).first()["m"]  # one row per style
    return {"theta_a": float(coef[0]), "theta_b": float(coef[1]), "phi": -float(coef[2]), "c_median": median}, cs


def predict_power(points: DataFrame, fit: dict, cs: DataFrame) -> DataFrame:
    """Adds the predicted error; styles without a fitted C take the median."""
    joined = meet(points, cs.select(*C.STYLE_KEYS, "c_style"), C.STYLE_KEYS, "left")
    log_r = F.ln(F.col("resolution").cast("double"))
    theta = F.lit(fit["theta_a"]) + F.lit(fit["theta_b"]) * log_r
    excess = F.greatest(F.col("text_len") - F.col("L0"), F.lit(0.0))
    c = F.coalesce("c_style", F.lit(fit["c_median"]))
    s = c * F.pow(excess, theta) * F.pow(F.col("resolution").cast("double"), F.lit(-fit["phi"]))
    return joined.withColumn("c_style", c).withColumn("theta_pred", theta).withColumn("e_pred", F.least(F.greatest(1.0 - F.exp(-s), F.lit(0.0)), F.lit(1.0)))


def power_diagnostics(points: DataFrame, fit: dict, cs: DataFrame, eps: float = 1e-6, min_points: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one-row metrics with verdict, by resolution, by group) of a global power law in E and transformed space."""
    rows = predict_power(power_rows(points, eps), fit, cs)
    rows = rows.withColumn("y_pred", F.ln(F.greatest("c_style", F.lit(FLAT))) + F.col("theta_pred") * F.col("x1") - F.lit(fit["phi"]) * F.col("x2"))
    rows = rows.withColumn("err", F.col("e") - F.col("e_pred")).withColumn("res", F.col("y") - F.col("y_pred"))
    square = lambda c: F.col(c) * F.col(c)
    fit_r2 = lambda err, y: F.when(F.var_pop(y) * F.count(y) > FLAT, 1 - F.sum(square(err)) / (F.var_pop(y) * F.count(y)))
    by_res = rows.groupBy("resolution").agg(
        F.count("*").alias("n_points"), F.avg(F.abs("err")).alias("mae_e"), F.sqrt(F.avg(square("err"))).alias("rmse_e"), fit_r2("err", "e").alias("r2_e")
    )
    by_group = rows.groupBy(*C.GROUP_KEYS).agg(
        F.count("*").alias("n_points"), F.regr_slope("y", "x1").alias("slope_hat"), F.max("theta_pred").alias("theta_pred"), safe_r2("", "x1", "y").alias("r2_y")
    ).where(F.col("n_points") >= min_points).withColumn("slope_error", F.col("slope_hat") - F.col("theta_pred"))
    overall = rows.agg(
        F.count("*").alias("n_points_fit"), F.avg(F.abs("err")).alias("mae_e"), F.sqrt(F.avg(square("err"))).alias("rmse_e"), fit_r2("err", "e").alias("r2_e"),
        F.avg(F.abs("res")).alias("mae_y"), F.sqrt(F.avg(square("res"))).alias("rmse_y"), fit_r2("res", "y").alias("r2_y"),
        safe_corr(F.col("res"), F.col("x1")).alias("corr_x1"), safe_corr(F.col("res"), F.col("x2")).alias("corr_r"), safe_corr(F.col("res"), F.col("x3")).alias("corr_x3"),
        F.avg((F.col("edit_distance") <= eps).cast("double")).alias("frac_low_clip"), F.avg((F.col("edit_distance") >= 1.0 - 1e-6).cast("double")).alias("frac_high_clip"),
    )
    # One row per style and resolution remains here.
    groups = by_group.agg(
        F.count("*").alias("n_groups"), F.percentile("r2_y", 0.5).alias("median_group_r2"), F.percentile("r2_y", 0.1).alias("p10_group_r2"),
        F.percentile("r2_y", 0.9).alias("p90_group_r2"), F.percentile(F.abs("slope_error"), 0.5).alias("median_slope_error"),
        F.avg(F.coalesce((F.col("r2_y") > 0.8).cast("double"), F.lit(0.0))).alias("frac_r2_gt_08"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("r2_y").isNull() | (F.col("r2_y") < 0.5), "low_r2_y"), F.when(F.col("median_group_r2") < 0.6, "low_group_linearity"),
            F.when(F.abs("corr_x1") > 0.2, "residual_follows_length"), F.when(F.abs("corr_r") > 0.2, "residual_follows_resolution"),
        )
    )
    verdict = F.when(F.size("reasons") == 0, "reasonable").when(F.col("r2_y") >= 0.5, "mixed").otherwise("inadequate")
    metrics = overall.join(F.broadcast(groups)).withColumn("reasons", reasons).withColumn("verdict", verdict)  # one row each
    return metrics, by_res, by_group


# --- per-group power law and its meta fit --------------------------------------------------------------------------


def fit_group_power(points: DataFrame, eps: float = 1e-6, keys: Sequence[str] = tuple(C.GROUP_KEYS)) -> DataFrame:
    """Per-group line of ln(E + eps) on ln(L - L0 + eps) for token lengths above L0, with standard errors."""
    ok = F.col("token_len") > F.col("L0")
    rows = points.withColumn("x", F.when(ok, F.ln(F.col("token_len") - F.col("L0") + eps))).withColumn("y", F.when(ok, F.ln(F.col("edit_distance") + eps)))
    s = rows.groupBy(*keys).agg(
        F.regr_count("y", "x").alias("n_points"), F.regr_slope("y", "x").alias("theta"), F.regr_intercept("y", "x").alias("logA"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_avgx("y", "x").alias("mx"), F.first("L0").alias("L0"),
    )
    n = F.col("n_points")
    rss = F.greatest(F.col("syy") - F.col("theta") * F.col("sxy"), F.lit(0.0))
    enough = n >= 3
    spread = enough & (F.col("sxx") > FLAT)
    s2 = rss / (n - 2)
    return s.select(
        *keys, "L0", "n_points", F.when(enough, F.col("theta")).alias("theta"), F.when(enough, F.col("logA")).alias("logA"),
        F.when(spread, F.sqrt(s2 / F.col("sxx"))).alias("se_theta"), F.when(spread, F.sqrt(s2 * (1 / n + F.col("mx") * F.col("mx") / F.col("sxx")))).alias("se_logA"),
        F.when(enough & (F.col("syy") > FLAT), 1 - rss / F.col("syy")).alias("r2"), F.when(enough, F.sqrt(rss / n)).alias("rmse"),
    )


def fit_theta_meta(
    groups: DataFrame, weight: str = "se", r_feature: str = "raw", interactions: bool = False, min_points: int = 8
) -> tuple[dict, DataFrame]:
    """Weighted least squares of theta on standardised style and resolution; (coefficients, groups with predictions)."""
    r = F.ln(F.col("resolution").cast("double")) if r_feature == "log" else F.col("resolution").cast("double")
    used = groups.where((F.col("n_points") >= min_points) & F.col("theta").isNotNull() & ~F.isnan("theta")).withColumn("r", r)
    features = list(FEATURES)
    if interactions:
        for f in C.STYLE_KEYS:
            used = used.withColumn(f"r_x_{f}", F.col("r") * F.col(f))
            features.append(f"r_x_{f}")
    n = F.greatest(F.col("n_points").cast("double"), F.lit(1.0))
    good = F.col("se_theta") > FLAT
    w = {"se": F.when(good, 1.0 / (F.col("se_theta") * F.col("se_theta"))).otherwise(n), "n": n}.get(weight, F.lit(1.0))
    used = used.withColumn("weight", w)
    if used.limit(1).count() == 0:
        raise RuntimeError("no group has enough points for the meta fit")
    mean, std = _moments(used, features)
    xs = _standard(features, mean, std)
    row = used.agg(*_cross(xs, F.col("weight")), *[F.sum(F.col("weight") * x * F.col("theta")).alias(f"g_{i}") for i, x in enumerate(xs)], F.count("*").alias("n")).first()
    beta = least_squares(_matrix(row, len(xs)), np.array([row[f"g_{i}"] for i in range(len(xs))]))
    predicted = used.withColumn("theta_pred", sum(F.lit(float(b)) * x for b, x in zip(beta, xs)))
    slopes = beta[1:] / std
    fit = {
        "features": features, "means": mean.tolist(), "stds": std.tolist(), "beta_standardized": beta.tolist(),
        "beta_raw": [float(beta[0] - slopes @ mean), *slopes.tolist()], "n_groups": row["n"],
        "r2": predicted.agg(
            F.when(F.var_pop("theta") * F.count("*") > FLAT, 1 - F.avg(F.pow(F.col("theta") - F.col("theta_pred"), F.lit(2.0))) / F.var_pop("theta")).alias("r2")
        ).first()["r2"],
    }
    return fit, predicted


def group_label(df: DataFrame) -> DataFrame:
    return df.withColumn("group_id", X.group_id(*[F.col(c) for c in C.GROUP_KEYS]))
