"""Small numerical helpers for the driver: they see sums and parameters, never rows."""

from __future__ import annotations

import math

import numpy as np

from pagescale import constants as C


def digamma(x: float) -> float:
    """Recurrence up to 10, then the asymptotic series."""
    shift = 0.0
    while x < 10.0:
        shift -= 1.0 / x
        x += 1.0
    q = 1.0 / (x * x)
    return shift + math.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))


def trigamma(x: float) -> float:
    shift = 0.0
    while x < 10.0:
        shift += 1.0 / (x * x)
        x += 1.0
    q = 1.0 / (x * x)
    return shift + 1.0 / x + q / 2 + q / x * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q * (1 / 30 - q * 5 / 66))))


def beta_norm(a: float, b: float) -> float:
    return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)


def beta_mean_var(a: float, b: float) -> tuple[float, float]:
    s = a + b
    return a / s, a * b / (s * s * (s + 1.0))


def beta_from_moments(w: float, wy: float, wyy: float) -> tuple[float, float]:
    """Method of moments from weighted sums; (1, 1) where the moments admit no Beta law."""
    if w <= 0:
        return 1.0, 1.0
    mean = wy / w
    var = wyy / w - mean * mean
    if var <= 1e-12 or not 0.0 < mean < 1.0:
        return 1.0, 1.0
    scale = mean * (1.0 - mean) / var - 1.0
    return (mean * scale, (1.0 - mean) * scale) if math.isfinite(scale) and scale > 0 else (1.0, 1.0)


def beta_mle(w: float, w_log: float, w_log1m: float, start: tuple[float, float], steps: int = 200) -> tuple[float, float]:
    """Weighted Beta maximum likelihood from three sums: damped Newton on the logs of the parameters within bounds."""
    if w <= 0:
        return 1.0, 1.0
    g1, g2 = w_log / w, w_log1m / w
    value = lambda a, b: (a - 1) * g1 + (b - 1) * g2 + beta_norm(a, b)
    a, b = (min(max(v, C.BETA_MIN), C.BETA_MAX) for v in start)
    best = value(a, b)
    for _ in range(steps):
        common, t_ab = digamma(a + b), trigamma(a + b)
        ga, gb = a * (g1 + common - digamma(a)), b * (g2 + common - digamma(b))
        haa = a * a * (t_ab - trigamma(a)) + ga
        hbb = b * b * (t_ab - trigamma(b)) + gb
        hab = a * b * t_ab
        h = np.array([[haa, hab], [hab, hbb]])
        top = np.linalg.eigvalsh(h)[-1]
        if top >= 0:
            h = h - (top + 1e-6) * np.eye(2)
        step = -np.linalg.solve(h, np.array([ga, gb]))
        scale = 1.0
        while True:
            na = min(max(a * math.exp(max(-2.0, min(2.0, scale * step[0]))), C.BETA_MIN), C.BETA_MAX)
            nb = min(max(b * math.exp(max(-2.0, min(2.0, scale * step[1]))), C.BETA_MIN), C.BETA_MAX)
            now = value(na, nb)
            if now >= best or scale < 1e-8:
                break
            scale *= 0.5
        moved = max(abs(math.log(na / a)), abs(math.log(nb / b)))
        if now >= best:
            a, b, best = na, nb, now
        if moved < 1e-12 or scale < 1e-8:
            break
    return a, b


def least_squares(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of the normal equations, as a general least-squares solver gives for a singular design."""
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    scaled = xtx / np.outer(scale, scale)
    if np.linalg.matrix_rank(scaled, tol=1e-11) == len(xty):
        return np.linalg.solve(scaled, xty / scale) / scale
    return np.linalg.pinv(xtx, rcond=1e-12) @ xty


def newton_step(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Step of a concave problem given as negative Hessian and gradient; damped where the Hessian is not definite."""
    scale = np.sqrt(np.maximum(np.diag(hessian), 1e-12))
    scaled = hessian / np.outer(scale, scale)
    low = np.linalg.eigvalsh(scaled)[0]
    if low < 1e-10:
        scaled = scaled + (1e-8 - low) * np.eye(len(gradient))
    return np.linalg.solve(scaled, gradient / scale) / scale
