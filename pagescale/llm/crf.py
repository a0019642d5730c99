"""A linear-chain conditional random field over padded batches of sequences."""

from __future__ import annotations

import numpy as np


def pad(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows laid end to end, as (sequences, longest, labels) with zeros behind, and the mask of real places."""
    mask = np.arange(sizes.max(initial=0))[None, :] < sizes[:, None]
    out = np.zeros((*mask.shape, values.shape[1]))
    out[mask] = values
    return out, mask


def forward_backward(scores: np.ndarray, mask: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Marginals of each place, the log partition sums and, if asked, the expected number of each transition."""
    n, t, k = scores.shape
    peak = scores.max(2, keepdims=True)
    odds, move = np.exp(scores - peak), np.exp(trans)
    alpha, scale = np.zeros_like(odds), np.ones((n, t))
    at = np.exp(start)[None, :] * odds[:, 0]
    for i in range(t):
        if i:
            at = np.where(mask[:, i, None], (at @ move) * odds[:, i], at)
        total = at.sum(1)
        scale[:, i] = np.where(mask[:, i], total, 1.0)
        at = at / total[:, None]
        alpha[:, i] = at
    beta, back = np.ones_like(odds), np.ones((n, k))
    expected = np.zeros((k, k)) if pairs else None
    for i in range(t - 2, -1, -1):
        ahead = back * odds[:, i + 1] / scale[:, i + 1, None]
        live = mask[:, i + 1, None]
        if pairs:
            expected += (alpha[:, i] * live).T @ (ahead * live) * move
        back = np.where(live, ahead @ move.T, 1.0)
        beta[:, i] = back
    marginal = alpha * beta
    marginal /= marginal.sum(2, keepdims=True)
    return marginal, np.log(scale).sum(1) + (peak[:, :, 0] * mask).sum(1), expected


def viterbi(scores: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of one sequence (places, labels)."""
    best, come = start + scores[0], []
    for row in scores[1:]:
        ways = best[:, None] + trans
        come.append(ways.argmax(0))
        best = ways.max(0) + row
    path = [int(best.argmax())]
    for step in reversed(come):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, values: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for name, g in grads.items():
            self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * g
            self.v[name] = 0.999 * self.v.get(name, 0.0) + 0.001 * g * g
            values[name] -= self.rate * (self.m[name] / (1 - 0.9**self.t)) / (np.sqrt(self.v[name] / (1 - 0.999**self.t)) + 1e-8)


def fit(flat: np.ndarray, owner: np.ndarray, kinds: np.ndarray, labels: np.ndarray, sizes: np.ndarray, n_features: int, n_labels: int, steps: int = 60, rate: float = 0.1, ridge: float = 1e-4, seed: int = 5, batch: int = 0) -> dict[str, np.ndarray]:
    """Weights that make the labels likely: emission weights by feature, first-place and transition weights.

    An observation kind is a bag of features (`flat`, with the kind of each in `owner`); the places of all sequences,
    end to end, name a kind (`kinds`) and a label; `sizes` are the sequences' lengths. Adam on the mean log loss of a
    place; `batch` sequences a step, or all.
    """
    n_kinds = int(owner.max()) + 1 if owner.size else 0
    count = np.maximum(1, np.bincount(owner, minlength=n_kinds))[:, None]
    w = {"emit": np.zeros((n_features, n_labels)), "start": np.zeros(n_labels), "trans": np.zeros((n_labels, n_labels))}
    adam, rng, ends = Adam(rate), np.random.default_rng(seed), np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(steps):
        chosen = rng.permutation(sizes.size)[:batch] if batch else np.arange(sizes.size)
        places = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in chosen])
        kind, label, size = kinds[places], labels[places], sizes[chosen]
        emission = np.stack([np.bincount(owner, w["emit"][flat, j], n_kinds) for j in range(n_labels)], 1) / count
        scores, mask = pad(emission[kind], size)
        marginal, _, expected = forward_backward(scores, mask, w["start"], w["trans"], pairs=True)
        truth = np.eye(n_labels)[label]
        delta = (marginal[mask] - truth) / places.size
        by_kind = np.stack([np.bincount(kind, delta[:, j], n_kinds) for j in range(n_labels)], 1) / count
        g_emit = np.stack([np.bincount(flat, by_kind[owner, j], n_features) for j in range(n_labels)], 1)
        first = np.cumsum(size) - size
        follow = np.ones(places.size, bool)
        follow[first] = False
        seen = np.zeros((n_labels, n_labels))
        np.add.at(seen, (label[np.flatnonzero(follow) - 1], label[follow]), 1)
        g = {"emit": g_emit + ridge * w["emit"] / n_labels, "start": (marginal[:, 0].sum(0) - truth[first].sum(0)) / places.size, "trans": (expected - seen) / places.size + 1e-5 * w["trans"]}
        adam.step(w, g)
    return w
