"""Polynomial prefix hashes modulo 2**64, vectorised."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE2 = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base):
        self.base = U(base)
        self.inverse = U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                full = lambda b: np.concatenate([[U(1)], np.cumprod(np.full(n - 1, b, U))])
                self.up, self.down = full(self.base), full(self.inverse)
        return self.up, self.down


POWERS, POWERS2 = Powers(BASE), Powers(BASE2)


def prefix(values: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """S with S[i] = sum of values[t] * base**t over t < i."""
    up, _ = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * up[: len(values)], out=out[1:])
    return out


def spans(s: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Hashes of values[start:end], independent of where they stand."""
    _, down = powers.get(len(s))
    return (s[end] - s[start]) * down[start]


def pieces(values: np.ndarray, start: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """As spans, for pieces that each end where the next one starts; start begins with 0, values are 64 bits wide."""
    up, down = powers.get(len(values) + 1)
    return np.add.reduceat(values * up[: len(values)], start) * down[start]
