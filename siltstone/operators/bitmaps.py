"""Compressed bitmaps over 16-bit positions, as numpy and bytes.

A container holds a set of positions below 65,536 in the smallest of three forms, told by its first
byte: sorted 16-bit values, runs of (first, length - 1), or 8,192 bytes of bits.
"""

from __future__ import annotations

import numpy as np

VALUES, RUNS, BITS = b"\x00", b"\x01", b"\x02"
SIZE = 1 << 16


def compress(positions: np.ndarray) -> bytes:
    """The container of a set of positions (any order, repeats allowed)."""
    p = np.unique(np.asarray(positions, np.int64))
    if not len(p):
        return VALUES
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(p) != 1) + 1])
    if 4 * len(firsts) < min(2 * len(p), SIZE // 8):
        lengths = np.diff(np.append(firsts, len(p))) - 1
        return RUNS + np.stack([p[firsts], lengths], 1).astype("<u2").tobytes()
    if 2 * len(p) < SIZE // 8:
        return VALUES + p.astype("<u2").tobytes()
    flags = np.zeros(SIZE, np.uint8)
    flags[p] = 1
    return BITS + np.packbits(flags, bitorder="little").tobytes()


def _bits(container: bytes) -> np.ndarray:
    """The 8,192 bytes of a container."""
    if container[:1] == BITS:
        return np.frombuffer(container, np.uint8, offset=1)
    flags = np.zeros(SIZE, np.uint8)
    flags[positions(container)] = 1
    return np.packbits(flags, bitorder="little")


def positions(container: bytes) -> np.ndarray:
    """The sorted positions of a container."""
    kind = container[:1]
    if kind == BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little"))
    body = np.frombuffer(container, "<u2", offset=1).astype(np.int64)
    if kind == VALUES:
        return body
    first, more = body[0::2], body[1::2]
    steps = np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    return np.repeat(first, more + 1) + steps


def count(container: bytes) -> int:
    kind = container[:1]
    if kind == VALUES:
        return (len(container) - 1) // 2
    if kind == RUNS:
        return int((np.frombuffer(container, "<u2", offset=1).astype(np.int64)[1::2] + 1).sum())
    return int(np.unpackbits(np.frombuffer(container, np.uint8, offset=1)).sum())


def contains(container: bytes, at: np.ndarray) -> np.ndarray:
    """For each position whether the container has it."""
    if container[:1] == BITS:
        bits = np.frombuffer(container, np.uint8, offset=1)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return np.isin(at, positions(container))


def and_not(a: bytes, b: bytes) -> bytes:
    """The positions in ``a`` and not in ``b``."""
    if a[:1] == BITS:
        return _shrink(np.bitwise_and(_bits(a), np.bitwise_not(_bits(b))))
    mine = positions(a)
    return compress(mine[~contains(b, mine)])


def both(a: bytes, b: bytes) -> bytes:
    """The positions in both."""
    if a[:1] == BITS and b[:1] == BITS:
        return _shrink(np.bitwise_and(_bits(a), _bits(b)))
    small, other = (b, a) if a[:1] == BITS else (a, b)
    mine = positions(small)
    return compress(mine[contains(other, mine)])


def either(a: bytes, b: bytes) -> bytes:
    """The positions in one or both."""
    if BITS in (a[:1], b[:1]):
        return _shrink(np.bitwise_or(_bits(a), _bits(b)))
    return compress(np.concatenate([positions(a), positions(b)]))


def _shrink(bits: np.ndarray) -> bytes:
    return compress(np.flatnonzero(np.unpackbits(bits, bitorder="little")))


class Bitmap:
    """A set of non-negative integers: one container for each range of 65,536."""

    def __init__(self, containers: dict[int, bytes] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, values: np.ndarray) -> Bitmap:
        v = np.asarray(values, np.int64)
        high = v >> 16
        order = np.argsort(high, kind="stable")
        v, high = v[order], high[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1, [len(v)]])
        return cls({int(high[a]): compress(v[a:b] & 0xFFFF) for a, b in zip(cuts, cuts[1:]) if b > a})

    def _with(self, other: Bitmap, op, keys) -> Bitmap:
        out = {k: op(self.containers.get(k, VALUES), other.containers.get(k, VALUES)) for k in keys}
        return Bitmap({k: c for k, c in out.items() if len(c) > 1})

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._with(other, and_not, self.containers)

    def both(self, other: Bitmap) -> Bitmap:
        return self._with(other, both, self.containers.keys() & other.containers.keys())

    def either(self, other: Bitmap) -> Bitmap:
        return self._with(other, either, self.containers.keys() | other.containers.keys())

    def values(self) -> np.ndarray:
        parts = [(k << 16) + positions(c) for k, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def __len__(self) -> int:
        return sum(map(count, self.containers.values()))
