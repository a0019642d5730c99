"""Counting quotient filters over packed word-id n-grams: lossless, since quotient and full remainder give the key back."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np

COUNTER = 255
HEAD = struct.Struct("<IBBB")


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads them (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mask(rest: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(rest[0]), np.uint64)
    for column in rest:
        out = mixed(out + column + np.uint64(0x9E3779B97F4A7C15))
    return out


def permuted(words: Sequence[np.ndarray]) -> list[np.ndarray]:
    """(quotient, remainder ...): the first word under a mask made from the others, and the others."""
    return [mixed(words[0] ^ _mask(words[1:])), *words[1:]]


def restored(keys: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The words of permuted keys."""
    x = keys[0]
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(0x319642B2D24D8EC3)
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(0x96DE1B173F119089)
    x = x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return [x ^ _mask(keys[1:]), *keys[1:]]


class Filter:
    """Different keys in the order of quotient, then remainder, each with its counter."""

    def __init__(self, keys: list[np.ndarray], counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, keys: list[np.ndarray], counts: np.ndarray) -> Filter:
        """Sort the keys and add up the counters of equal ones."""
        if not len(counts):
            return cls(keys, counts)
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        return cls([k[starts] for k in keys], np.add.reduceat(counts[order], starts))

    @classmethod
    def counted(cls, words: Sequence[np.ndarray]) -> Filter:
        return cls.of(permuted(words), np.ones(len(words[0]), np.int64))

    @classmethod
    def merged(cls, filters: Sequence[Filter]) -> Filter:
        """One filter of several sorted ones; the sort finds their runs."""
        if len(filters) == 1:
            return filters[0]
        return cls.of([np.concatenate(k) for k in zip(*[f.keys for f in filters], strict=True)], np.concatenate([f.counts for f in filters]))

    def buckets(self, bits: int) -> Iterator[tuple[int, Filter]]:
        """The filter cut by the leading bits of the quotient; only buckets that hold something."""
        if not len(self):
            return
        of = (self.keys[0] >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
            yield int(of[a]), Filter([k[a:b] for k in self.keys], self.counts[a:b])

    def packed(self, bits: int) -> bytes:
        """A bucket as bytes, without the `bits` leading bits that all its quotients share.

        The next bits of a quotient are its home slot and are not stored: a bit string tells each slot's run length, a 1
        for each key and a 0 at the end. Remainders are stored in full, counters in one byte with longer ones behind.
        """
        n, slot_bits = len(self), max(0, min(len(self).bit_length() - 1, 64 - bits - 8))
        shift = 64 - bits - slot_bits
        inside = self.keys[0] & np.uint64((1 << (64 - bits)) - 1)
        slots = (inside >> np.uint64(shift)).astype(np.int64)
        runs = np.zeros(n + (1 << slot_bits), np.uint8)
        runs[np.arange(n) + slots] = 1
        low = inside & np.uint64((1 << shift) - 1)
        width = -(-shift // 8)
        parts = [HEAD.pack(n, slot_bits, width, len(self.keys) - 1), np.packbits(runs).tobytes(), low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
        parts += [k.astype("<u8").tobytes() for k in self.keys[1:]]
        return b"".join([*parts, np.minimum(self.counts, COUNTER).astype(np.uint8).tobytes(), self.counts[self.counts >= COUNTER].astype("<i8").tobytes()])

    @classmethod
    def unpacked(cls, data: bytes, bucket: int, bits: int) -> Filter:
        n, slot_bits, width, n_rest = HEAD.unpack_from(data)
        at, shift = HEAD.size, 64 - bits - slot_bits

        def take(kind: str, number: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, number, at)
            at += out.nbytes
            return out

        runs = np.unpackbits(take("u1", -(-(n + (1 << slot_bits)) // 8)), count=n + (1 << slot_bits))
        slots = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
        low = np.zeros((n, 8), np.uint8)
        low[:, :width] = take("u1", n * width).reshape(n, width)
        quotient = np.uint64(bucket << (64 - bits)) | (slots << np.uint64(shift)) | low.view("<u8").reshape(-1).astype(np.uint64)
        keys = [quotient, *[take("<u8", n).astype(np.uint64) for _ in range(n_rest)]]
        counts = take("u1", n).astype(np.int64)
        more = counts == COUNTER
        counts[more] = take("<i8", int(more.sum()))
        return cls(keys, counts)
