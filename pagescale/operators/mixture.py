"""Collapse model: a two-part Beta mixture of the edit distance whose mixing weight is a logistic gate on text geometry.

``E ~ π Beta(α1, β1) + (1 - π) Beta(α0, β0)`` with ``π = σ(w0 + a ln V + α ln G)``.

Every EM step is one aggregate over the rows: the likelihood, the Beta statistics and the gate's gradient and Hessian all
come from the same pass. The driver sees about twenty sums per group and solves for the next parameters in time and memory
proportional to the groups. The gate takes
one Newton step per pass, which raises the expected likelihood and has the same fixed points as a full inner fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import geometry as G
from pagescale.functions.solve import beta_from_moments, beta_mean_var, beta_mle, beta_norm, newton_step
from pagescale.operators.aggregates import responsibility_stats
from pagescale.schema import assert_columns

PARAMS = ("w0", "a", "alpha", "a0", "b0", "a1", "b1")
FEW_GROUPS = 64
FLAT, DAMP = 1e-11, 1e-6


def vgz_features(df: DataFrame, v_mode: str = "aspect", eps: float = C.EM_EPS) -> DataFrame:
    """Adds vision tokens, V, G and their logs; clips the edit distance; drops rows that are not finite."""
    assert_columns(df, ["resolution", "text_len", "edit_distance", "character_width", "character_height", *C.STYLE_KEYS])
    num = lambda c: F.col(c).cast("double")
    v = G.glyph_aspect(num("character_width"), num("character_height"), num("line_spacing"), num("letter_spacing"), num("text_len"), v_mode)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    rows = df.where(finite("text_len") & finite("edit_distance") & finite("character_width") & finite("character_height"))
    rows = rows.withColumn("vision_token_num", G.vision_tokens(num("resolution"))).withColumn("_v", v).where(F.col("_v").isNotNull())
    return (
        rows.withColumn("V", F.greatest("_v", F.lit(eps)))
        .withColumn("G", F.greatest(num("text_len") / F.col("vision_token_num"), F.lit(eps)))
        .withColumn("edit_distance", F.least(F.greatest(num("edit_distance"), F.lit(eps)), F.lit(1.0 - eps)))
        .withColumn("logV", F.ln("V")).withColumn("logG", F.ln("G")).drop("_v")
    )


def init_resp(y: Column, threshold: float = C.EM_THRESHOLD, soft: float = C.EM_SOFT) -> Column:
    return F.when(y >= threshold, F.lit(1.0 - soft)).otherwise(F.lit(soft))


def beta_moments(df: DataFrame, y: str, w: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean and variance and the Beta parameters of equal moments; (1, 1) where there are none."""
    weight = F.when((F.col(w) > 0) & (F.col(w) < float("inf")), F.col(w)).otherwise(F.lit(0.0))
    s = df.groupBy(*keys).agg(F.sum(weight).alias("sw"), F.sum(weight * F.col(y)).alias("sy"), F.sum(weight * F.col(y) * F.col(y)).alias("syy"))
    mean = F.try_divide("sy", "sw")
    m = s.select(*keys, "sw", mean.alias("mean"), (F.try_divide("syy", "sw") - mean * mean).alias("var"))
    scale = F.try_divide(F.col("mean") * (1 - F.col("mean")), F.col("var")) - 1
    ok = (F.col("sw") > 0) & (F.col("var") > 1e-12) & (F.col("mean") > 0) & (F.col("mean") < 1) & (scale > 0)
    return m.select(*keys, "mean", "var", F.when(ok, F.col("mean") * scale).otherwise(1.0).alias("alpha"), F.when(ok, (1 - F.col("mean")) * scale).otherwise(1.0).alias("beta"))


def fit_beta(df: DataFrame, y: str, w: Column | None = None) -> tuple[float, float]:
    """Weighted Beta maximum likelihood: the rows fold into five sums."""
    w = F.lit(1.0) if w is None else F.when(w > 0, w).otherwise(F.lit(0.0))
    c = F.col(y)
    r = df.agg(F.sum(w).alias("w"), F.sum(w * c).alias("y"), F.sum(w * c * c).alias("yy"), F.sum(w * F.ln(c)).alias("l"), F.sum(w * F.log1p(-c)).alias("l1")).first()
    if not r["w"]:
        return 1.0, 1.0
    return beta_mle(r["w"], r["l"], r["l1"], beta_from_moments(r["w"], r["y"], r["yy"]))


def soft_logit(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.0, max_steps: int = 25) -> list[float]:
    """Logistic regression on soft labels with an L2 penalty on the slopes: Newton, one aggregate per step."""
    cols = [F.lit(1.0), *[F.col(f) for f in features]]
    p = len(cols)
    ridge = reg * np.diag([0.0] + [1.0] * (p - 1))

    def sums(beta: np.ndarray):
        z = sum((float(b) * c for b, c in zip(beta, cols)), F.lit(0.0))
        rows = df.withColumn("_z", z).withColumn("_p", sigmoid(F.col("_z")))
        w = F.col("_p") * (1 - F.col("_p"))
        ll = F.col(label) * log_sigmoid(F.col("_z")) + (1 - F.col(label)) * log_sigmoid(-F.col("_z"))
        row = rows.agg(
            F.sum(ll).alias("ll"), *[F.sum((F.col(label) - F.col("_p")) * c).alias(f"g_{i}") for i, c in enumerate(cols)],
            *[F.sum(w * cols[i] * cols[j]).alias(f"h_{i}_{j}") for i in range(p) for j in range(i, p)],
        ).first()
        h = np.array([[row[f"h_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        g = np.array([row[f"g_{i}"] for i in range(p)])
        return row["ll"] - 0.5 * beta @ ridge @ beta, g - ridge @ beta, h + ridge

    beta = np.zeros(p)
    ll, g, h = sums(beta)
    for _ in range(max_steps):
        step, scale = newton_step(h, g), 1.0
        while True:
            trial = sums(beta + scale * step)
            if trial[0] >= ll - 1e-12 * abs(ll) or scale < 1e-6:
                break
            scale *= 0.5
        beta, gain, (ll, g, h) = beta + scale * step, trial[0] - ll, trial
        if abs(gain) < 1e-9 * (1 + abs(ll)):
            break
    return beta.tolist()


# --- row expressions ----------------------------------------------------------------------------------------------


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def log_sigmoid(z: Column) -> Column:
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def e_step(df: DataFrame, y: str = "edit_distance", logs: tuple[str, str] | None = None, slopes: int = 2) -> DataFrame:
    """Adds gate ``z``, weight ``pi``, responsibility ``r`` and log-likelihood ``ll``; needs parameter columns on rows.

    Parameters are the columns of PARAMS plus the log-normalisers ``n0`` and ``n1``. ``logs`` names the columns of ln y and
    ln(1 - y) where rows have them. With d the log-odds of the parts, ll = log π₀f₀ + max(d, 0) + ln((1 + e^-|d|) / (1 + e^-|z|))
    up to terms that are linear: two exponentials and one logarithm a row.
    """
    # Plain SQL text: this runs once per EM pass, and building the expression piece by piece costs more than the pass.
    rows = df if logs else df.withColumns({"_ly": F.expr(f"ln({y})"), "_l1": F.expr(f"log1p(-{y})")})
    ly, l1 = logs or ("_ly", "_l1")
    rows = rows.withColumn("z", F.expr(" + ".join(["w0", "a * logV", "alpha * logG"][: slopes + 1])))
    rows = rows.withColumns({"_e": F.expr("exp(-abs(z))"), "_d": F.expr(f"z + (a1 - a0) * {ly} + (b1 - b0) * {l1} + n1 - n0")}).withColumn("_f", F.expr("exp(-abs(_d))"))
    return rows.withColumns(
        {
            "pi": F.expr("if(z >= 0, 1D, _e) / (1 + _e)"), "r": F.expr("if(_d >= 0, 1D, _f) / (1 + _f)"),
            "ll": F.expr(f"least(-z, 0D) + (a0 - 1) * {ly} + (b0 - 1) * {l1} + n0 + greatest(_d, 0D) + ln((1 + _f) / (1 + _e))"),
        }
    ).drop("_e", "_d", "_f", "_ly", "_l1")


def with_norms(p: dict) -> dict:
    return {**{k: float(p[k]) for k in PARAMS}, "n0": beta_norm(p["a0"], p["b0"]), "n1": beta_norm(p["a1"], p["b1"])}


def params_frame(spark: SparkSession, params: dict, key: str = "resolution") -> DataFrame:
    """One row per group. A short table is stated in the query text, which plans faster; a longer one comes as data."""
    if len(params) > FEW_GROUPS:
        kind = "string" if isinstance(next(iter(params)), str) else "bigint"
        posed = ((g, with_norms(p)) for g, p in params.items())
        rows = [(g, *[p[c] for c in (*PARAMS, "n0", "n1")]) for g, p in posed]
        return spark.createDataFrame(rows, f"{key} {kind}, " + ", ".join(f"{c} double" for c in (*PARAMS, "n0", "n1")))
    name = lambda g: "'" + g.replace("'", "''") + "'" if isinstance(g, str) else f"{int(g)}L"
    rows = ", ".join(f"({name(g)}, " + ", ".join(f"double('{with_norms(p)[c]!r}')" for c in (*PARAMS, "n0", "n1")) + ")" for g, p in params.items())
    return spark.sql(f"VALUES {rows}").toDF(key, *PARAMS, "n0", "n1")


def with_params(df: DataFrame, params: dict, key: str = "resolution") -> DataFrame:
    """Rows of the groups that have parameters, with them; the size of the parameter table decides how they meet."""
    return df.join(params_frame(df.sparkSession, params, key), key)


# --- EM -----------------------------------------------------------------------------------------------------------


@dataclass
class GateFit:
    """Parameters per group and the run of the log-likelihood."""

    key: str
    params: dict
    history: dict = field(default_factory=dict)
    converged: dict = field(default_factory=dict)
    n: dict = field(default_factory=dict)

    @property
    def total_ll(self) -> float:
        return sum(h[-1] for h in self.history.values())


_CROSS = [(i, j) for i in range(3) for j in range(i, 3)]


GRID = float(2**20)


def _sums(rows: DataFrame, key: str, sums: dict[str, str]) -> dict:
    agg = [F.count("*").alias("n"), *[F.expr(f"sum({e}) AS {c}") for c, e in sums.items()]]
    return {r[key]: r.asDict() for r in rows.groupBy(key).agg(*agg).toLocalIterator()}


def _first_sums(rows: DataFrame, key: str) -> dict:
    """Per-group sums of the initial labels; those without ``r`` hold for all passes."""
    return _sums(rows, key, {"ly": "ly", "l1": "l1", "r": "r", "rly": "r * ly", "rl1": "r * l1", "y": "y", "yy": "y * y", "ry": "r * y", "ryy": "r * y * y"})


def _gate_sums(rows: DataFrame, key: str, slopes: int, more: dict[str, str] | None = None) -> dict:
    """Per-group gradient and Hessian of the gate and further sums; ``rows`` carry r, pi and the features."""
    gate = ["1D", "logV", "logG"][: slopes + 1]
    rows = rows.withColumns({"_q": F.expr("r - pi"), "_w": F.expr("pi * (1 - pi)")})
    sums = {**{f"g{i}": f"_q * {g}" for i, g in enumerate(gate)}, **{f"h{i}{j}": f"_w * {gate[i]} * {gate[j]}" for i, j in _CROSS if j <= slopes}}
    return _sums(rows, key, {**(more or {}), **sums})


def _pass_sums(rows: DataFrame, key: str, slopes: int, first: dict) -> dict:
    """Per-group sums of one EM pass; ``rows`` carry r, pi, ll and the features.

    The likelihood is summed in two parts, multiples of 2**-20 and what is left: the first sum is exact and the second
    small, so that the total does not depend on the order of the rows and its error stays below the tolerance of the fit.
    """
    rows = rows.withColumn("_hi", F.expr(f"rint(ll * {GRID}D) / {GRID}D"))
    found = _gate_sums(rows, key, slopes, {"hi": "_hi", "lo": "ll - _hi", "r": "r", "rly": "r * ly", "rl1": "r * l1"})
    return {g: {**first[g], **s, "ll": s["hi"] + s["lo"]} for g, s in found.items()}


def _pooled(sums: dict) -> dict:
    names = ("n", "r", "ly", "l1", "rly", "rl1", "y", "yy", "ry", "ryy")
    return {c: sum(s[c] for s in sums.values()) for c in names}


def _beta_update(s: dict, old: dict | None) -> dict:
    hi = (s["r"], s["rly"], s["rl1"])
    lo = (s["n"] - s["r"], s["ly"] - s["rly"], s["l1"] - s["rl1"])
    start1 = (old["a1"], old["b1"]) if old else beta_from_moments(s["r"], s["ry"], s["ryy"])
    start0 = (old["a0"], old["b0"]) if old else beta_from_moments(s["n"] - s["r"], s["y"] - s["ry"], s["yy"] - s["ryy"])
    a1, b1 = beta_mle(*hi, start1)
    a0, b0 = beta_mle(*lo, start0)
    return {"a0": a0, "b0": b0, "a1": a1, "b1": b1}


def _gate_step(sums: dict, params: dict, slopes: int, own_w0: bool, own_slopes: bool, reg: float) -> dict:
    """New gate parameters per group after one Newton step on the expected log-likelihood."""
    names = GATE_NAMES[: slopes + 1]
    groups = list(sums)
    grad_of = lambda s: np.array([s[f"g{i}"] for i in range(slopes + 1)])
    hess_of = lambda s: np.array([[s[f"h{min(i, j)}{max(i, j)}"] for j in range(slopes + 1)] for i in range(slopes + 1)])
    if own_slopes or not own_w0:
        out = {}
        batches = [[g] for g in groups] if own_slopes else [groups]
        for batch in batches:
            beta = np.array([params[batch[0]][n] for n in names])
            ridge = reg * np.diag([0.0] + [1.0] * slopes)
            grad = sum(grad_of(sums[g]) for g in batch) - ridge @ beta
            hess = sum(hess_of(sums[g]) for g in batch) + ridge
            beta = beta + newton_step(hess, grad)
            out.update({g: dict(zip(names, map(float, beta))) for g in batch})
        return out
    # Own intercepts, shared slopes: the Hessian is an arrow, one diagonal entry and one border row for each group. The
    # intercepts are eliminated group by group; what remains is a system of the slopes alone (the Schur complement).
    shared = np.array([params[groups[0]][n] for n in names[1:]])
    own = {g: (grad_of(sums[g]), hess_of(sums[g])) for g in groups}

    def reduced(damp: float) -> tuple[np.ndarray, np.ndarray]:
        whole, rest = (reg + damp) * np.eye(slopes), -reg * shared
        for grad, hess in own.values():
            pivot = max(hess[0, 0] + damp, 1e-12)
            whole = whole + hess[1:, 1:] - np.outer(hess[1:, 0], hess[0, 1:]) / pivot
            rest = rest + grad[1:] - hess[1:, 0] * grad[0] / pivot
        return whole, rest

    damp, (whole, rest) = 0.0, reduced(0.0)
    if slopes:
        # A feature that is constant within every group leaves nothing but rounding errors: the shortest step is taken then.
        scale = np.sqrt(np.maximum(reg + sum(np.diag(hess)[1:] for _, hess in own.values()), 1e-12))
        if np.linalg.eigvalsh(whole / np.outer(scale, scale))[0] < FLAT:
            damp = DAMP * sum(hess[0, 0] for _, hess in own.values()) / len(own)
            whole, rest = reduced(damp)
    move = newton_step(whole, rest) if slopes else np.zeros(0)
    moved = {n: float(v) for n, v in zip(names[1:], shared + move)}
    lift = lambda grad, hess: (grad[0] - hess[0, 1:] @ move) / max(hess[0, 0] + damp, 1e-12)
    return {g: {"w0": float(params[g]["w0"] + lift(*own[g])), **moved} for g in groups}


GATE_NAMES = ("w0", "a", "alpha")


def em_fit(
    df: DataFrame, key: str = "resolution", own_w0: bool = True, own_slopes: bool = True, own_beta: bool = True, slopes: int = 2,
    max_iter: int = C.EM_MAX_ITER, tol: float = C.EM_TOL, threshold: float = C.EM_THRESHOLD, soft: float = C.EM_SOFT, reg: float = 0.0,
) -> GateFit:
    """EM for all groups at once. What is own to a group and what is shared follows the three flags:

    separate fits per resolution (all own), grouped (own w0 and Beta, shared slopes), own w0 only, or everything shared.
    ``slopes=0`` is the constant-weight baseline. Separate fits stop group by group, joint fits on the total.
    """
    y = F.col("edit_distance")
    posed = df.select(key, y.alias("y"), *["logV", "logG"][:slopes], F.ln(y).alias("ly"), F.log1p(-y).alias("l1"))
    first = _first_sums(posed.withColumn("r", init_resp(F.col("y"), threshold, soft)), key)
    rows = posed.withColumn("high", F.col("y") >= threshold).drop("y").persist()  # what the passes read
    try:
        return _run_em(rows, first, key, own_w0, own_slopes, own_beta, slopes, max_iter, tol, soft, reg)
    finally:
        rows.unpersist()


def _run_em(rows, first, key, own_w0, own_slopes, own_beta, slopes, max_iter, tol, soft, reg) -> GateFit:
    separate = own_slopes and own_beta and own_w0
    start = rows.withColumn("r", F.when(F.col("high"), 1.0 - soft).otherwise(soft))
    zero = {"w0": 0.0, "a": 0.0, "alpha": 0.0}
    params = {g: dict(zero) for g in first}
    betas = {g: _beta_update(s, None) for g, s in first.items()} if own_beta else dict.fromkeys(first, _beta_update(_pooled(first), None))
    for g in params:
        params[g].update(betas[g])
    if own_slopes or not own_w0:
        _initial_gate(start, key, params, slopes, own_w0, own_slopes, reg)
    else:
        for g, s in first.items():
            share = s["r"] / s["n"]
            params[g]["w0"] = math.log(share / (1 - share)) if 0 < share < 1 else 0.0

    fit = GateFit(key, params, {g: [] for g in first}, dict.fromkeys(first, False), {g: s["n"] for g, s in first.items()})
    active, previous = set(first), None
    for _ in range(max_iter):
        sums = _pass_sums(_posterior(rows, {g: params[g] for g in active}, key, slopes), key, slopes, first)
        units = [[g] for g in sums] if separate else [list(sums)]
        retry = set()
        for unit in units:
            ll = sum(sums[g]["ll"] for g in unit)
            last = sum(fit.history[g][-1] for g in unit) if fit.history[unit[0]] else None
            if last is not None and ll < last - 1e-9 * abs(last) - tol and previous:
                for g in unit:  # step too long: halve the gate's move and look again
                    for n in GATE_NAMES:
                        params[g][n] = 0.5 * (params[g][n] + previous[g][n])
                retry.update(unit)
                continue
            for g in unit:
                fit.history[g].append(sums[g]["ll"])
            if last is not None and abs(ll - last) < tol:
                for g in unit:
                    fit.converged[g] = True
                    active.discard(g)
        moving = {g: sums[g] for g in sums if g in active and g not in retry}
        if not active:
            break
        if moving:
            previous = {g: dict(params[g]) for g in params} if previous is None or not retry else {**previous, **{g: dict(params[g]) for g in moving}}
            gates = _gate_step(moving, params, slopes, own_w0, own_slopes, reg)
            shared = None if own_beta else _beta_update(_pooled(moving), params[next(iter(moving))])
            for g, s in moving.items():
                params[g].update(gates[g])
                params[g].update(_beta_update(s, params[g]) if own_beta else shared)
    _swap_labels(fit, separate)
    return fit


def _posterior(rows: DataFrame, params: dict, key: str, slopes: int) -> DataFrame:
    return e_step(with_params(rows, params, key), logs=("ly", "l1"), slopes=slopes)


def _initial_gate(start: DataFrame, key, params, slopes, own_w0, own_slopes, reg, steps: int = 12) -> None:
    """Fit the gate to the initial labels by Newton steps, updating ``params`` in place."""
    sums = _gate_sums(start.withColumn("pi", F.lit(0.5)), key, slopes)
    for _ in range(steps):
        gates = _gate_step(sums, params, slopes, own_w0, own_slopes, reg)
        moved = max(abs(gates[g][n] - params[g][n]) / (1 + abs(gates[g][n])) for g in gates for n in gates[g])
        for g in gates:
            params[g].update(gates[g])
        if moved < 1e-6:
            return
        posed = with_params(start, {g: params[g] for g in params}, key)
        z = sum((F.col(n) * F.col(c) for n, c in zip(GATE_NAMES[1:], ["logV", "logG"][:slopes])), F.col("w0"))
        sums = _gate_sums(posed.withColumn("pi", sigmoid(z)), key, slopes)


def _swap_labels(fit: GateFit, separate: bool) -> None:
    """The second part is the one of higher mean; the decision is joint where parameters are shared."""
    units = [[g] for g in fit.params] if separate else [list(fit.params)]
    for unit in units:
        total = sum(fit.n[g] for g in unit)
        mean = lambda k: sum(fit.n[g] * fit.params[g][f"a{k}"] / (fit.params[g][f"a{k}"] + fit.params[g][f"b{k}"]) for g in unit) / total  # noqa: E731,B023
        if mean(1) < mean(0):
            for g in unit:
                p = fit.params[g]
                p.update({"a0": p["a1"], "b0": p["b1"], "a1": p["a0"], "b1": p["b0"], "w0": -p["w0"], "a": -p["a"], "alpha": -p["alpha"]})


def em_fit_grouped(df: DataFrame, key: str = "resolution", **options) -> GateFit:
    """Own w0 and Beta pairs per group, shared slopes."""
    return em_fit(df, key, own_w0=True, own_slopes=False, own_beta=True, **options)


def em_fit_shared(df: DataFrame, key: str = "resolution", **options) -> GateFit:
    """All parameters shared across groups."""
    return em_fit(df, key, own_w0=False, own_slopes=False, own_beta=False, **options)


def em_fit_shared_slopes(df: DataFrame, key: str = "resolution", **options) -> GateFit:
    """Own w0 per group, everything else shared."""
    return em_fit(df, key, own_w0=True, own_slopes=False, own_beta=False, **options)


def em_baselines(df: DataFrame, key: str = "resolution", **options) -> tuple[GateFit, dict]:
    """(constant-weight mixture, single Beta parameters) per group."""
    constant = em_fit(df, key, slopes=0, **options)
    y = F.col("edit_distance")
    sums = df.groupBy(key).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"), F.sum(F.ln(y)).alias("l"), F.sum(F.log1p(-y)).alias("l1")
    ).toLocalIterator()
    return constant, {r[key]: beta_mle(r["n"], r["l"], r["l1"], beta_from_moments(r["n"], r["y"], r["yy"])) for r in sums}


def fit_w0_only(df: DataFrame, params: dict, key: str = "model", start: float = 0.0, max_steps: int = 50) -> dict:
    """Per model the intercept that maximises the likelihood with all other parameters fixed.

    Safeguarded Newton on the scalar likelihood, one aggregate per step for all models. A model that does not settle
    keeps the start value and is reported as not converged.
    """
    state = {m: {"w0": start, "best": (-math.inf, start), "ok": False, "lo": -math.inf, "hi": math.inf} for m in params}
    rows = df.select(key, F.col("edit_distance").alias("y"), "logV", "logG").persist()
    try:
        _settle_w0(rows, params, key, state, max_steps)
    finally:
        rows.unpersist()
    return {m: (s["w0"], True) if s["ok"] else (start, False) for m, s in state.items()}


def _settle_w0(rows: DataFrame, params: dict, key: str, state: dict, max_steps: int) -> None:
    for _ in range(max_steps):
        open_ = [m for m in state if not state[m]["ok"]]
        if not open_:
            break
        posed = e_step(with_params(rows, {m: {**params[m], "w0": state[m]["w0"]} for m in open_}, key), "y")
        per_model = posed.groupBy(key).agg(
            F.sum("ll").alias("ll"), F.sum(F.col("r") - F.col("pi")).alias("g"),
            F.sum(F.col("r") * (1 - F.col("r")) - F.col("pi") * (1 - F.col("pi"))).alias("h"), F.sum(F.col("pi") * (1 - F.col("pi"))).alias("f"),
        )
        for r in per_model.toLocalIterator():
            s = state[r[key]]
            s["lo"], s["hi"] = (s["w0"], s["hi"]) if r["g"] > 0 else (s["lo"], s["w0"])
            curve = -r["h"] if r["h"] < 0 else max(r["f"], 1e-9)
            move = max(-4.0, min(4.0, r["g"] / curve))
            nxt = s["w0"] + move
            if not s["lo"] < nxt < s["hi"] and math.isfinite(s["lo"] + s["hi"]):
                nxt = 0.5 * (s["lo"] + s["hi"])
            s["ok"] = abs(nxt - s["w0"]) < 1e-9 * (1 + abs(nxt)) or abs(r["g"]) < 1e-9
            s["w0"] = nxt


# --- results ------------------------------------------------------------------------------------------------------


def score_points(df: DataFrame, params: dict, key: str = "resolution") -> DataFrame:
    """Adds z, pi, r and the expected edit distance under fixed parameters."""
    means = F.col("a0") / (F.col("a0") + F.col("b0")), F.col("a1") / (F.col("a1") + F.col("b1"))
    rows = e_step(with_params(df, params, key))
    expected = (1 - F.col("pi")) * means[0] + F.col("pi") * means[1]
    return rows.withColumn("expected_ed", expected).drop(*PARAMS, "n0", "n1")


def log_likelihoods(df: DataFrame, gate: dict, constant: dict, single: dict, keys: Sequence[str] = ("resolution", "split")) -> DataFrame:
    """Sums of the log-likelihood of gate, constant mixture and single Beta per resolution and split."""
    key, spare = keys[0], (*PARAMS, "n0", "n1", "z", "pi", "r")
    y = F.col("edit_distance")
    rows = df.select(*dict.fromkeys([*keys, "logV", "logG"]), F.ln(y).alias("ly"), F.log1p(-y).alias("l1"))
    rows = e_step(with_params(rows, gate, key), logs=("ly", "l1")).withColumnRenamed("ll", "ll_gate").drop(*spare)
    rows = e_step(with_params(rows, constant, key), logs=("ly", "l1")).withColumnRenamed("ll", "ll_constant").drop(*spare)
    flat = {g: {"w0": 0.0, "a": 0.0, "alpha": 0.0, "a0": p[0], "b0": p[1], "a1": p[0], "b1": p[1]} for g, p in single.items()}
    rows = with_params(rows, flat, key).withColumn("ll", F.expr("(a0 - 1) * ly + (b0 - 1) * l1 + n0"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("ll_gate").alias("gated_mixture"), F.sum("ll_constant").alias("constant_pi_mixture"), F.sum("ll").alias("single_beta")
    )


def overall_likelihoods(per_group: DataFrame, key: str = "resolution") -> DataFrame:
    """The table of `log_likelihoods` and, with a NULL group, its sums for each split."""
    sums = [c for c in per_group.columns if c not in (key, "split")]
    whole = per_group.groupBy("split").agg(*[F.sum(c).alias(c) for c in sums]).withColumn(key, F.lit(None))
    return per_group.unionByName(whole.select(*per_group.columns))


def summary_frame(spark: SparkSession, df: DataFrame, fit: GateFit, constant: GateFit | None = None, single: dict | None = None) -> DataFrame:
    """Nested summary per group: parameters, Beta means and variances, responsibility statistics, history."""
    scored = score_points(df, fit.params, fit.key)
    stats = responsibility_stats(scored, [fit.key])
    counts = scored.groupBy(fit.key).agg(F.count("*").alias("n_samples"), F.avg("vision_token_num").alias("vision_token_num"))
    rows = []
    for g, p in fit.params.items():
        (m0, v0), (m1, v1) = beta_mean_var(p["a0"], p["b0"]), beta_mean_var(p["a1"], p["b1"])
        const = None if constant is None else tuple(float(constant.params[g][c]) for c in ("w0", "a0", "b0", "a1", "b1"))
        one = None if single is None else tuple(map(float, single[g]))
        rows.append((g, (p["w0"], p["a"], p["alpha"]), ((p["a0"], p["b0"], m0, v0), (p["a1"], p["b1"], m1, v1)), [float(x) for x in fit.history[g]], bool(fit.converged[g]), const, one))
    kind = "string" if isinstance(rows[0][0], str) else "bigint"
    shape = "struct<alpha:double,beta:double,mean:double,var:double>"
    schema = (
        f"{fit.key} {kind}, gating_params struct<w0:double,a:double,alpha:double>, beta_params struct<low_ed:{shape},high_ed:{shape}>, "
        "log_likelihood_history array<double>, converged boolean, constant_pi_params struct<w0:double,alpha0:double,beta0:double,alpha1:double,beta1:double>, "
        "single_beta_params struct<alpha:double,beta:double>"
    )
    table = spark.createDataFrame(rows, schema)
    packed = stats.select(fit.key, F.struct("mean", "std", "q10", "q50", "q90").alias("responsibility_stats"))
    return counts.join(packed, fit.key).join(table, fit.key)


def history_frame(summary: DataFrame, key: str = "resolution") -> DataFrame:
    return summary.select(key, F.posexplode("log_likelihood_history").alias("iteration", "log_likelihood"))


def expected_curve(spark: SparkSession, mean0: float, mean1: float, z_lo: float = C.CURVE_Z[0], z_hi: float = C.CURVE_Z[1], points: int = 200) -> DataFrame:
    z = F.lit(z_lo) + F.col("id") * ((z_hi - z_lo) / (points - 1))
    return spark.range(points).select(z.alias("z")).withColumn("pi", sigmoid(F.col("z"))).withColumn("expected_ed", (1 - F.col("pi")) * mean0 + F.col("pi") * mean1)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Committed summaries as a parameter table; the resolution comes from the record, else from the folder name."""
    beta = "struct<alpha:double,beta:double>"
    schema = f"resolution bigint, gating_params struct<w0:double,a:double,alpha:double>, beta_params struct<low_ed:{beta},high_ed:{beta}>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("_path"))
    folder = F.regexp_extract("_path", r"/(\d+)/[^/]*$", 1).try_cast("bigint")
    g, b = "gating_params", "beta_params"
    return raw.select(
        F.coalesce("resolution", folder).alias("resolution"), F.col(f"{g}.w0").alias("w0"), F.col(f"{g}.a").alias("a"), F.col(f"{g}.alpha").alias("alpha"),
        F.col(f"{b}.low_ed.alpha").alias("a0"), F.col(f"{b}.low_ed.beta").alias("b0"), F.col(f"{b}.high_ed.alpha").alias("a1"), F.col(f"{b}.high_ed.beta").alias("b1"),
    )


def check_shared(params: DataFrame, names: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Rows whose supposedly shared parameters differ from those of the lowest resolution."""
    ref = params.orderBy("resolution").limit(1).select(*[F.col(n).alias(f"ref_{n}") for n in names])
    bad = None
    for n in names:
        off = F.abs(F.col(n) - F.col(f"ref_{n}")) > atol + rtol * F.abs(F.col(f"ref_{n}"))
        bad = off if bad is None else bad | off
    return params.join(F.broadcast(ref)).where(bad).select("resolution", *names)  # ref: one row


def collapse_length(df: DataFrame, v_mode: str) -> DataFrame:
    """Text length at which π = ½ for rows with gate parameters, style and resolution.

    Solves w0 + a ln V + α ln G = 0 for the length.
    """
    cell = F.ln((F.col("character_width") + F.col("letter_spacing")) / (F.col("character_height") + F.col("line_spacing")))
    log_vt = F.ln(G.vision_tokens(F.col("resolution").cast("double")))
    slope = F.col("alpha") + (F.col("a") if v_mode == "text" else F.lit(0.0))
    return df.withColumn("collapse_len", F.exp(-(F.col("w0") + F.col("a") * cell - F.col("alpha") * log_vt) / slope))
