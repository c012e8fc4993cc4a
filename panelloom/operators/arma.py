"""Exact Gaussian likelihood of autoregressive moving-average models, and its maximum.

The likelihood comes from the recursion of a state-space form that begins in its stationary distribution.  The mean and
the variance are solved for, so the search goes over the coefficients only, by way of partial autocorrelations,
which keep models stationary and invertible; their bounds keep the search bounded.
"""

from __future__ import annotations

import numpy as np

#: Largest size of a search coordinate u; a partial autocorrelation is u / sqrt(1 + u * u).
BOUND = 30.0


def coefficients(u: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients of unconstrained coordinates."""
    a: list = []
    for r in u / np.sqrt(1 + u * u):
        a = [x - r * y for x, y in zip(a, reversed(a), strict=True)] + [r]
    return np.array(a, u.dtype)


def coordinates(a: np.ndarray) -> np.ndarray | None:
    """The coordinates of autoregressive coefficients; None if these are not stationary."""
    a, out = list(a), []
    while a:
        r = a.pop()
        if not abs(r) < 1:
            return None
        out.append(r / np.sqrt(1 - r * r))
        a = [(x + r * y) / (1 - r * r) for x, y in zip(a, reversed(a), strict=True)]
    return np.clip(np.array(out[::-1]), -BOUND, BOUND)


def innovations(x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of ``x`` (a column per series) for a mean of 0, and their variances in units of the noise's.

    Once the variances have settled the recursion is that of the model itself.
    """
    n, p, q = len(x), len(phi), len(theta)
    m, kind = max(p, q + 1), np.result_type(phi, theta, float)
    t, load = np.zeros((m, m), kind), np.zeros(m, kind)
    t[:p, 0], t[np.arange(m - 1), np.arange(1, m)] = phi, 1
    load[0], load[1 : q + 1] = 1, theta
    noise = np.outer(load, load)
    cov = np.linalg.solve(np.eye(m * m) - np.kron(t, t), noise.ravel()).reshape(m, m)
    state, errors, scale = np.zeros((m, x.shape[1]), kind), np.zeros(x.shape, kind), np.ones(n, kind)
    k = 0
    while k < n:
        f = cov[0, 0]
        errors[k], scale[k] = x[k] - state[0], f
        gain = t @ cov[:, 0] / f
        state = t @ state + np.outer(gain, errors[k])
        after = t @ cov @ t.T + noise - np.outer(gain, gain) * f
        settled = np.abs(after - cov).max() < 1e-13
        cov, k = after, k + 1
        if settled and k >= max(p, q):
            break
    if k < n:
        ar, ma = phi.tolist(), theta.tolist()
        scale[k:] = cov[0, 0]
        for c in range(x.shape[1]):
            v, e = x[:, c].tolist(), errors[:k, c].tolist()
            for i in range(k, n):
                s = v[i]
                for j, b in enumerate(ar, 1):
                    s -= b * v[i - j]
                for j, b in enumerate(ma, 1):
                    s -= b * e[i - j]
                e.append(s)
            errors[k:, c] = e[k:]
    return errors, scale


def profile(x: np.ndarray, phi: np.ndarray, theta: np.ndarray, constant: bool = True) -> tuple[complex, complex, complex, np.ndarray]:
    """(negative log-likelihood, mean, variance, one-step errors) at the best mean and variance."""
    n = len(x)
    errors, scale = innovations(np.column_stack([x, np.ones(n)]) if constant else x[:, None], phi, theta)
    mean = (errors[:, 0] * errors[:, 1] / scale).sum() / (errors[:, 1] ** 2 / scale).sum() if constant else 0.0
    own = errors[:, 0] - mean * errors[:, 1] if constant else errors[:, 0]
    variance = (own**2 / scale).sum() / n
    return n / 2 * (np.log(2 * np.pi * variance) + 1) + np.log(scale).sum() / 2, mean, variance, own


def _start(x: np.ndarray, p: int, q: int) -> np.ndarray:
    """Coordinates from two least-squares fits: a long autoregression, then one on lags of x and of its errors."""
    n, long, y = len(x), min(max(10, p + q + 5), max(1, len(x) // 4)), x - x.mean()
    lags = lambda v, k, s: np.column_stack([v[s - j : n - j] for j in range(1, k + 1)])
    e = np.zeros(n)
    if q:
        a = lags(y, long, long)
        e[long:] = y[long:] - a @ np.linalg.lstsq(a, y[long:], rcond=None)[0]
    s = (long if q else 0) + max(p, q)
    a = np.column_stack(([lags(y, p, s)] if p else []) + ([lags(e, q, s)] if q else []))
    b = np.linalg.lstsq(a, y[s:], rcond=None)[0]
    parts = coordinates(b[:p]), coordinates(-b[p:])
    return np.concatenate([np.zeros(k) if u is None else u for u, k in zip(parts, (p, q), strict=True)])


def fitted(x: np.ndarray, p: int, q: int, constant: bool = True, steps: int = 200) -> dict:
    """Maximum likelihood: phi, theta, mean, variance, loglik and one-step forecasts of ``x``.

    A quasi-Newton search with the exact gradient, taken through the recursion in complex numbers.  Fails with
    ValueError on fewer values than parameters, on a series without spread and where the search finds no number.
    """
    x = np.asarray(x, float)
    if len(x) < max(3, 2 * (p + q) + 2) or not np.ptp(x) > 0:
        raise ValueError("too few values, or all equal")

    split = lambda u: (coefficients(u[:p]), -coefficients(u[p:]))
    loss = lambda u: profile(x, *split(u), constant)[0]

    def slope(u: np.ndarray) -> np.ndarray:
        return np.array([loss(u + 1e-20j * np.eye(len(u))[k]).imag / 1e-20 for k in range(len(u))])

    tries = [u for u in (_start(x, p, q), np.zeros(p + q)) if np.isfinite(loss(u))] if p + q else [np.zeros(0)]
    if not tries:
        raise ValueError("no start has a likelihood")
    u = min(tries, key=loss)
    h, value, g = np.eye(len(u)), loss(u), slope(u)
    for _ in range(steps if len(u) else 0):
        step = -h @ g
        if g @ step >= 0:
            h, step = np.eye(len(u)), -g
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        size = 1.0
        while size > 1e-12:
            then = np.clip(u + size * step, -BOUND, BOUND)
            new = loss(then)
            if np.isfinite(new) and new <= value + 1e-4 * size * (g @ step):
                break
            size /= 2
        else:
            break
        change, turn = then - u, slope(then) - g
        u, value, g = then, new, g + turn
        if np.abs(change).max() < 1e-10 or np.abs(g).max() < 1e-7:
            break
        if change @ turn > 1e-14:
            rho, e = 1 / (change @ turn), np.eye(len(u))
            h = (e - rho * np.outer(change, turn)) @ h @ (e - rho * np.outer(turn, change)) + rho * np.outer(change, change)
    phi, theta = split(u)
    nll, mean, variance, own = profile(x, phi, theta, constant)
    if not np.isfinite(nll):
        raise ValueError("the search found no likelihood")
    return {"phi": phi, "theta": theta, "mean": float(mean), "variance": float(variance), "loglik": -float(nll), "forecast": x - own}
