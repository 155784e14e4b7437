"""Student's t over whole arrays at once: distribution function, and the steps of a maximum-likelihood fit.

The tail is a regularized incomplete beta function, evaluated by its continued
fraction (DLMF 8.17.22) from the innermost term outwards.

The fit is over weighted values.  A grid of degrees of freedom is followed by the
parameter-expanded EM (Kent, Tyler and Vardi, 1994), and the likeliest point is
refined by Newton's method in location, log scale and log degrees of freedom.  A
Newton step needs five sums over the values and their number, so it can as well
be made from sums that Spark has merged.
"""

from __future__ import annotations

import math

import numpy as np

#: Terms of the continued fraction; it converges well before that on the side it is used on.
TERMS = 400
#: Degrees of freedom from which the normal distribution is used.
NORMAL_FROM = 1e7

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    value = np.ones_like(x)
    for k in range(TERMS, 0, -1):
        m = k // 2
        if k % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + d / value
    return 1 / value


def betainc(a, b, x) -> np.ndarray:
    """Regularized incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    near = x < (a + 1) / (a + b + 2)
    first, second, at = np.where(near, a, b), np.where(near, b, a), np.where(near, inside, 1 - inside)
    part = front * _fraction(first, second, at) / first
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(near, part, 1 - part)))


def t_cdf(x, df, loc=0.0, scale=1.0) -> np.ndarray:
    """Probability of a value up to ``x``; NaN parameters give NaN."""
    z = (np.asarray(x, dtype=float) - loc) / scale
    z, df = np.broadcast_arrays(z, np.asarray(df, dtype=float))
    few = np.where(np.isfinite(df), df, 1.0)
    tail = 0.5 * betainc(few / 2, 0.5, few / (few + z * z))
    out = np.where(z > 0, 1 - tail, tail)
    out = np.where(df > NORMAL_FROM, 0.5 * _erfc(np.nan_to_num(-z / math.sqrt(2))), out)
    return np.where(np.isnan(df) | np.isnan(z), np.nan, out)


def digamma(x) -> np.ndarray:
    """Derivative of log gamma for positive values: recurrence up to 20, then the asymptotic series (DLMF 5.11.2)."""
    x = np.array(x, dtype=float, ndmin=1)
    shift = np.zeros_like(x)
    for _ in range(20):
        low = x < 20
        shift[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x) -> np.ndarray:
    """Derivative of digamma for positive values (DLMF 5.15.8)."""
    x = np.array(x, dtype=float, ndmin=1)
    shift = np.zeros_like(x)
    for _ in range(20):
        low = x < 20
        shift[low] += 1 / x[low] ** 2
        x[low] += 1
    f = 1 / (x * x)
    return shift + 1 / x + 0.5 * f + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * 5 / 66))))


#: Degrees of freedom that a fit may take, and how many are followed at first.
NU_RANGE, GRID, EM_STEPS = (0.05, 1e6), 16, 30
#: A scale below this part of the standard deviation is no fit: the likelihood grows without bound around a repeated value.
LEAST_SCALE = 1e-6


def newton_step(n, wz, wqz, q, wq, logs, scale, nu, free) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps (in scales, log scale, log nu) for many fits at once, and whether each has a maximum nearby.

    With z = (y - location) / scale, w = 1 / (1 + z^2 / nu) and q = 1 - w, the arguments are the
    sums of w z, w q z, q, w q and log(1 + z^2 / nu).  Where ``free`` is false nu stays as it is.
    """
    n, wz, wqz, q, wq, logs, scale, nu = (np.array(v, dtype=float, ndmin=1) for v in (n, wz, wqz, q, wq, logs, scale, nu))
    more, half = nu + 1, nu / 2
    slope = (digamma(half + 0.5) - digamma(half) - 1 / nu) / 2
    bend = (trigamma(half + 0.5) - trigamma(half)) / 4 + 0.5 / nu**2
    # where nu is large the differences above cancel: leading terms of their expansions
    large = nu > 1e4
    slope, bend = np.where(large, -0.25 / nu**2, slope), np.where(large, 0.5 / nu**3, bend)
    g = np.stack([more / nu * wz, more * q - n, n * slope * nu - half * logs + more / 2 * q], axis=1)
    h = np.empty((len(n), 3, 3))
    h[:, 0, 0] = more / nu * (2 * wq - (n - q))
    h[:, 0, 1] = h[:, 1, 0] = -2 * more / nu * (wz - wqz)
    h[:, 1, 1] = -2 * more * wq
    h[:, 1, 2] = h[:, 2, 1] = nu * q - more * wq
    h[:, 0, 2] = h[:, 2, 0] = -wz / nu + more / nu * wqz
    h[:, 2, 2] = n * (bend * nu**2 + slope * nu) - half * logs + nu * q - more / 2 * wq
    fixed = ~np.array(free, dtype=bool, ndmin=1)
    g[fixed, 2] = 0
    h[fixed, 2, :], h[fixed, :, 2] = 0, 0
    h[fixed, 2, 2] = -1
    good = np.isfinite(h).all(axis=(1, 2)) & np.isfinite(g).all(axis=1)
    h[~good], g[~good] = -np.eye(3), 0
    peak = np.linalg.eigvalsh(h)[:, -1] < 0
    h[~peak] = -np.eye(3)
    step = np.linalg.solve(-h, g[:, :, None])[:, :, 0]
    return step, good & peak


def _fit_sums(y, count, loc, scale, nu):
    z = (y - loc) / scale
    r = z * z / nu
    w = 1 / (1 + r)
    q = 1 - w
    return [(count * v).sum() for v in (w * z, w * q * z, q, w * q, np.log1p(r))]


def _likelihood(n, logs, scale, nu) -> float:
    return n * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(scale)) - (nu + 1) / 2 * logs


def fit_weighted(y: np.ndarray, count: np.ndarray) -> tuple[float, float, float, bool] | None:
    """Degrees of freedom, location, scale of the likeliest t, and whether nu is free of its bounds; None without a fit."""
    n = count.sum()
    mean = (count * y).sum() / n
    sd = math.sqrt((count * (y - mean) ** 2).sum() / n)
    if n < 3 or not sd > 0:
        return None
    nus = np.clip(np.geomspace(*NU_RANGE, GRID), *NU_RANGE)
    nus[[0, -1]] = NU_RANGE
    order = np.argsort(y)
    middle = y[order][np.searchsorted(np.cumsum(count[order]), n / 2)]
    loc, scale = np.full(GRID, middle), np.full(GRID, sd)
    for _ in range(EM_STEPS):
        w = (nus[:, None] + 1) / (nus[:, None] + ((y - loc[:, None]) / scale[:, None]) ** 2) * count
        total = w.sum(axis=1)
        loc = (w * y).sum(axis=1) / total
        scale = np.sqrt(np.maximum((w * (y - loc[:, None]) ** 2).sum(axis=1), 1e-300) / total)
    logs = (count * np.log1p(((y - loc[:, None]) / scale[:, None]) ** 2 / nus[:, None])).sum(axis=1)
    likely = np.array([_likelihood(n, *v) if v[1] > LEAST_SCALE * sd else -np.inf for v in zip(logs, scale, nus, strict=True)])
    best = int(likely.argmax())
    if not np.isfinite(likely[best]):
        return None
    nu, at, width, value = nus[best], loc[best], scale[best], likely[best]
    free = True
    for _ in range(60):
        sums = _fit_sums(y, count, at, width, nu)
        step, peak = newton_step(n, *sums, width, nu, free)
        step = step[0] if peak[0] else np.array([0.0, 0.0, 0.0])
        if not peak[0]:
            # no maximum near in nu: go the way the likelihood rises, the others settled as they are
            step, peak = newton_step(n, *sums, width, nu, False)
            step = step[0] if peak[0] else np.zeros(3)
            up = n * float(digamma(nu / 2 + 0.5)[0] - digamma(nu / 2)[0] - 1 / nu) / 2 - sums[4] / 2 + (nu + 1) / (2 * nu) * sums[2]
            step[2] = math.copysign(0.5, up) if free else 0.0
        length = min(1.0, 1.0 / max(np.abs(step).max(), 1e-300))
        while length > 1e-4:
            new = at + length * step[0] * width, width * math.exp(length * step[1]), min(max(nu * math.exp(length * step[2]), NU_RANGE[0]), NU_RANGE[1])
            risen = _likelihood(n, _fit_sums(y, count, *new)[4], new[1], new[2])
            if risen >= value:
                break
            length /= 2
        else:
            break
        moved = np.abs(length * step).max()
        (at, width, nu), value = new, risen
        if free and nu in NU_RANGE:
            free = False
        elif moved < 1e-10:
            break
    return float(nu), float(at), float(width), free and nu not in NU_RANGE
