"""Exact Levenshtein distances of a batch of text pairs by Myers' bit vectors, for pairs of any length."""

from __future__ import annotations

import numpy as np

WORD = 64
FEW = 10  # pairs per word of the shorter text below which one pair at a time is faster
CELLS = 4_000_000  # entries of a table of letters


def distance(x: str, y: str) -> int:
    """One pair: a column of the table is one integer of any length, a letter takes a few operations on it."""
    short, long = sorted((x, y), key=len)
    if not short:
        return len(long)
    at: dict[str, int] = {}
    for i, c in enumerate(short):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(short)) - 1
    up, down = full, 0
    for c in long:
        eq = at.get(c, 0)
        across = ((eq & up) + up ^ up) | eq
        rise, fall = down | full & ~(across | up), up & across
        rise, eq = rise << 1 | 1, eq | down
        up, down = (fall << 1 | ~(eq | rise)) & full, rise & eq & full
    return len(long) + up.bit_count() - down.bit_count()


def distances(xs: list[str], ys: list[str]) -> np.ndarray:
    """All pairs: those whose shorter texts have equally many words of 64 letters go through the columns together."""
    pairs = [sorted(p, key=len) for p in zip(xs, ys)]
    out = np.zeros(len(pairs), dtype=np.int64)
    by_words: dict[int, list[int]] = {}
    for i, (short, _) in enumerate(pairs):
        by_words.setdefault(-(-len(short) // WORD), []).append(i)
    for words, rows in by_words.items():
        if len(rows) < FEW * words or not words:
            out[rows] = [distance(*pairs[i]) for i in rows]
            continue
        rows.sort(key=lambda i: -len(pairs[i][1]))
        start = 0
        while start < len(rows):
            part, letters = _fitting(pairs, rows[start:], words)
            out[part] = _together([pairs[i] for i in part], letters, words)
            start += len(part)
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _letters(texts: list[str]) -> np.ndarray:
    codes = _codes(texts)
    seen = np.zeros(int(codes.max()) + 1, dtype=bool)
    seen[codes] = True
    return np.flatnonzero(seen)


def _fitting(pairs: list, rows: list[int], words: int) -> tuple[list[int], np.ndarray]:
    """As many rows as a table of their letters has room for, and those letters."""
    part = rows[: max(1, min(2048, CELLS // words))]
    while True:
        letters = _letters([t for i in part for t in pairs[i]])
        if len(part) == 1 or len(part) * len(letters) * words <= CELLS:
            return part, letters
        part = part[: max(1, min(len(part) - 1, CELLS // (len(letters) * words)))]


def _together(pairs: list, letters: np.ndarray, words: int) -> np.ndarray:
    """Distances of pairs in falling order of the longer text, column by column; a finished pair drops out at the end."""
    n, k = len(pairs), len(letters)
    short, long = np.array([len(p[0]) for p in pairs]), np.array([len(p[1]) for p in pairs])
    place = np.zeros(int(letters[-1]) + 1, dtype=np.int64)
    place[letters] = np.arange(k)
    row = np.repeat(np.arange(n), short)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(short) - short, short)
    seen = np.zeros((words, n * k), dtype=np.uint64)
    np.bitwise_or.at(seen.reshape(-1), (pos // WORD) * (n * k) + row * k + place[_codes([p[0] for p in pairs])], np.uint64(1) << (pos % WORD).astype(np.uint64))
    row = np.repeat(np.arange(n), long)
    at = np.zeros((long[0], n), dtype=np.int64)
    at[np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long), row] = place[_codes([p[1] for p in pairs])] + row * k
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), dtype=np.uint64)
    left = np.searchsorted(-long, -np.arange(long[0]), side="left")  # pairs whose longer text goes on after j letters
    one, high = np.uint64(1), np.uint64(WORD - 1)
    for j in range(long[0]):
        m = left[j]
        rise_in, fall_in = np.ones(m, dtype=np.uint64), np.zeros(m, dtype=np.uint64)
        for w in range(words):
            u, d, eq = up[w, :m], down[w, :m], seen[w].take(at[j, :m])
            xv = eq | d
            eq |= fall_in
            xh = eq & u
            xh += u
            xh ^= u
            xh |= eq
            rise = xh | u
            np.invert(rise, out=rise)
            rise |= d
            fall = u & xh
            rise_out, fall_out = rise >> high, fall >> high
            rise <<= one
            rise |= rise_in
            fall <<= one
            fall |= fall_in
            np.bitwise_and(rise, xv, out=d)
            xv |= rise
            np.invert(xv, out=xv)
            np.bitwise_or(fall, xv, out=u)
            rise_in, fall_in = rise_out, fall_out
    rest = np.clip(short[None, :] - WORD * np.arange(words)[:, None], 0, WORD)
    mask = np.where(rest == WORD, ~np.uint64(0), (one << (rest % WORD).astype(np.uint64)) - one)
    ones = lambda v: np.bitwise_count(v & mask).sum(axis=0, dtype=np.int64)
    return long + ones(up) - ones(down)
