"""Distribution functions in numpy, for statistics of a few rows or inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np



def lgamma(x):
    """log Gamma for positive x: recurrence up to 10, then the Stirling series."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    while True:
        small = x < 10
        if not small.any():
            break
        shift[small] -= np.log(x[small])
        x[small] += 1
    inv = 1 / (x * x)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv / 1188)))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def digamma(x):
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while True:
        small = x < 10
        if not small.any():
            break
        out[small] -= 1 / x[small]
        x[small] += 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))


def trigamma(x):
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while True:
        small = x < 10
        if not small.any():
            break
        out[small] += 1 / (x[small] * x[small])
        x[small] += 1
    inv = 1 / (x * x)
    return out + 1 / x + inv / 2 + inv / x * (1 / 6 - inv * (1 / 30 - inv * (1 / 42 - inv / 30)))


def norm_two_sided(z):
    z = np.abs(np.asarray(z, dtype=float)) / math.sqrt(2)
    return np.array([math.erfc(v) for v in z.ravel()]).reshape(z.shape)


def _beta_fraction(a, b, x, steps=100_000):
    """Continued fraction of the incomplete beta function (modified Lentz), elementwise; an error if it does not settle."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, settled = d.copy(), np.zeros(np.shape(d), bool)
    for m in range(1, steps + 1):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = np.where(settled, h, h * delta)
        settled |= (np.abs(delta - 1) < 1e-14) | ~np.isfinite(delta)  # a missing value stays one
        if settled.all():
            return h
    raise RuntimeError(f"the incomplete beta function did not settle in {steps} terms")


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(xs) + b * np.log1p(-xs))
    swap = xs > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - xs, xs)
    part = front * _beta_fraction(aa, bb, xx) / aa
    out = np.where(swap, 1 - part, part)
    return np.where(inside, out, x)


def beta_ppf(p, a, b):
    """Beta quantile by Newton steps kept inside a shrinking bracket."""
    p, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (p, a, b)))
    lo, hi = np.zeros(p.shape), np.ones(p.shape)
    x = np.clip(a / (a + b), 1e-12, 1 - 1e-12)
    norm = lgamma(a + b) - lgamma(a) - lgamma(b)
    for _ in range(100):
        f = betainc(a, b, x) - p
        hi, lo = np.where(f > 0, x, hi), np.where(f <= 0, x, lo)
        slope = np.exp(norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        with np.errstate(all="ignore"):
            step = x - f / slope
        new = np.where((step > lo) & (step < hi) & np.isfinite(step), step, (lo + hi) / 2)
        done = np.all(np.abs(new - x) < 1e-13)
        x = new
        if done:
            return x
    raise RuntimeError("the beta quantile did not settle in 100 steps")


def f_sf(f, d1, d2):
    """Upper tail of the F distribution."""
    f = np.asarray(f, dtype=float)
    return betainc(np.asarray(d2, dtype=float) / 2, np.asarray(d1, dtype=float) / 2, d2 / (d2 + d1 * f))


def chi2_sf(x, df):
    """Upper tail of chi-square: series for small x, continued fraction for large x (scalars)."""
    out = []
    for xi, k in zip(np.atleast_1d(x).astype(float), np.atleast_1d(df).astype(float)):
        a, h = k / 2, xi / 2
        if h <= 0:
            out.append(1.0)
            continue
        front = math.exp(-h + a * math.log(h) - math.lgamma(a))
        if h < a + 1:
            term = total = 1 / a
            n = a
            while term > total * 1e-16:
                n += 1
                term *= h / n
                total += term
            out.append(1 - front * total)
        else:
            b, c = h + 1 - a, 1e300
            d = 1 / b
            frac = d
            for i in range(1, 2000):
                an = -i * (i - a)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                frac *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            else:
                raise RuntimeError("the upper tail of chi-square did not settle in 2000 terms")
            out.append(front * frac)
    return np.array(out)
