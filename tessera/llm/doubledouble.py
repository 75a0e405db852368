"""Double-double arithmetic on numpy arrays: sums and products whose rounding errors are kept beside them.

Defined results: finite numbers only; a sum or product beyond the range of a
double gives a non-finite value.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

_SPLIT = float(2**27 + 1)


def two_sum(a, b):
    """(s, e) with s the rounded sum and a + b = s + e."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def quick_two_sum(a, b):
    """As ``two_sum``, where a isn't smaller than b."""
    s = a + b
    return s, b - (s - a)


def halves(a):
    """The upper and lower 26 bits."""
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a, b, a_halves, b_halves):
    """(p, e) with p the rounded product and a * b = p + e."""
    p = a * b
    (ah, al), (bh, bl) = a_halves, b_halves
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(ah, al, bh, bl):
    """Sum of two double-doubles, accurate under cancellation too."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = quick_two_sum(s, e + t)
    return quick_two_sum(s, e + f)


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums along the first axis, in pairs."""
    while len(high) > 1:
        m = len(high) // 2
        rest = (high[2 * m :], low[2 * m :])
        high, low = add(high[:m], low[:m], high[m : 2 * m], low[m : 2 * m])
        if len(rest[0]):
            high, low = np.concatenate([high, rest[0]]), np.concatenate([low, rest[1]])
    return high[0], low[0]


def divided(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """The quotient of a double-double and a whole number, rounded."""
    d = float(n)
    q = high / d
    p, e = two_product(q, d, halves(q), halves(d))
    return q + (((high - p) - e) + low) / d


def nearest(x: Fraction) -> tuple[float, float]:
    """A number as a double-double."""
    high = float(x)
    return high, float(x - Fraction(high))
