"""Small numpy estimators used inside grouped maps: no dependency beyond numpy."""

from __future__ import annotations

import math

import numpy as np


def nelder_mead(f, x0, step: float = 0.25, tol: float = 1e-7, most: int = 400) -> tuple[np.ndarray, float, bool]:
    """(minimiser, minimum, converged) of f by the downhill simplex."""
    n = len(x0)
    simplex = [np.array(x0, float)] + [np.array(x0, float) + step * (abs(x0[i]) + 0.1) * np.eye(n)[i] for i in range(n)]
    value = [f(x) for x in simplex]
    for _ in range(most):
        order = np.argsort(value, kind="stable")
        simplex, value = [simplex[i] for i in order], [value[i] for i in order]
        if value[-1] - value[0] < tol * (1 + abs(value[0])):
            return simplex[0], value[0], True
        centre = np.mean(simplex[:-1], axis=0)
        mirror = 2 * centre - simplex[-1]
        at = f(mirror)
        if at < value[0]:
            far = centre + 2 * (centre - simplex[-1])
            further = f(far)
            simplex[-1], value[-1] = (far, further) if further < at else (mirror, at)
        elif at < value[-2]:
            simplex[-1], value[-1] = mirror, at
        else:
            near = centre + 0.5 * ((mirror if at < value[-1] else simplex[-1]) - centre)
            inside = f(near)
            if inside < min(at, value[-1]):
                simplex[-1], value[-1] = near, inside
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (x - simplex[0]) for x in simplex[1:]]
                value = [value[0]] + [f(x) for x in simplex[1:]]
    best = int(np.argmin(value))
    return simplex[best], value[best], False


# --- linear models ----------------------------------------------------------------------------------------------------


def ols(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares with Gaussian likelihood criteria; x holds its constant."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    n, k = len(y), x.shape[1]
    loglik = -0.5 * n * (math.log(2 * math.pi * max(float(resid @ resid) / n, 1e-300)) + 1)
    return {"beta": beta, "resid": resid, "loglik": loglik, "aic": -2 * loglik + 2 * k, "bic": -2 * loglik + k * math.log(n), "n": n}


def lagged(y: np.ndarray, lags: int, hold: int) -> np.ndarray:
    return np.column_stack([np.ones(len(y) - hold), *(y[hold - k : len(y) - k] for k in range(1, lags + 1))])


def fit_autoreg(y: np.ndarray, most: int = 10, criterion: str = "aic") -> dict:
    """The lag count from 1 to `most` of best criterion, all fitted on the same rows. The variance counts as a parameter."""
    if criterion not in ("aic", "bic") or most < 1 or len(y) < max(40, 4 * most):
        raise ValueError("autoreg: criterion, lags or sample")
    fits = []
    for k in range(1, most + 1):
        fit = ols(lagged(y, k, most), y[most:])
        n = fit["n"]
        fit |= {"lags": k, "aic": -2 * fit["loglik"] + 2 * (k + 2), "bic": -2 * fit["loglik"] + (k + 2) * math.log(n)}
        fits.append(fit)
    return min(fits, key=lambda fit: fit[criterion])


def autoreg_one_step(beta: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Forecasts with frozen coefficients from the values before each row."""
    k = len(beta) - 1
    out = np.full(len(y), np.nan)
    if len(y) > k:
        out[k:] = lagged(y, k, k) @ beta
    return out


def _arma_residuals(y: np.ndarray, c: float, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Residuals with zeros before the first row; the moving average alone needs a loop."""
    x = y - c
    for i, v in enumerate(phi, 1):
        x[i:] -= v * y[:-i]
    q, rest, out = len(theta), theta.tolist(), []
    if q == 0:
        return x
    if q > 2:
        for t, v in enumerate(x.tolist()):
            out.append(v - sum(rest[i] * out[t - 1 - i] for i in range(min(q, t))))
        return np.array(out)
    one, two = rest[0], rest[1] if q > 1 else 0.0
    e = before = 0.0
    for v in x.tolist():
        e, before = v - one * e - two * before, e
        out.append(e)
    return np.array(out)


def _stationary(phi: np.ndarray) -> bool:
    """Whether the roots lie outside the unit circle; beyond order 2 a sufficient bound."""
    if len(phi) == 2:
        return abs(phi[1]) < 0.999 and phi[1] + abs(phi[0]) < 0.999
    return np.abs(phi).sum() < 0.999


#: The orders of the reference's fold audit: p and q up to 2, d up to 1.
ORDERS = tuple((p, d, q) for d in range(2) for p in range(3) for q in range(3))


def fit_arima(y: np.ndarray, orders: tuple[tuple[int, int, int], ...] = ORDERS, most: int = 800) -> dict:
    """The order of best AIC by conditional least squares, of those that converged."""
    best = None
    for p, d, q in orders:
        x = np.diff(y) if d else y
        start, scale = np.concatenate([[x.mean()], np.zeros(p + q)]), max(float(x.var()), 1e-300)

        def loss(v, x=x, p=p, scale=scale):
            if not (_stationary(v[1 : 1 + p]) and _stationary(-v[1 + p :])):
                return 1e12
            e = _arma_residuals(x, v[0], v[1 : 1 + p], v[1 + p :])
            return float(e @ e) / len(e) / scale

        v, value, done = (start, loss(start), True) if p + q == 0 else nelder_mead(loss, start, most=most)
        if not done:
            continue
        n = len(x)
        loglik = -0.5 * n * (math.log(2 * math.pi * max(value * scale, 1e-300)) + 1)
        fit = {"order": (p, d, q), "params": v, "aic": -2 * loglik + 2 * (p + q + 2), "bic": -2 * loglik + math.log(n) * (p + q + 2), "converged": done}
        if best is None or fit["aic"] < best["aic"]:
            best = fit
    return best


def arima_one_step(fit: dict, y: np.ndarray) -> np.ndarray:
    p, d, _ = fit["order"]
    x = np.diff(y) if d else y
    e = _arma_residuals(x, fit["params"][0], fit["params"][1 : 1 + p], fit["params"][1 + p :])
    return np.concatenate([[np.nan], y[:-1] + (x - e)]) if d else x - e


def fit_har(rv: np.ndarray) -> dict:
    """RV(t + 1) on RV, its 5-day and its 22-day mean at t."""
    x = har_rows(rv)[:-1]
    y = rv[1:]
    ok = ~np.isnan(x).any(axis=1) & ~np.isnan(y)
    if ok.sum() < 60:
        raise ValueError("HAR needs 60 rows")
    return ols(x[ok], y[ok])


def har_rows(rv: np.ndarray) -> np.ndarray:
    means = [np.array([np.nan if i + 1 < k else rv[i + 1 - k : i + 1].mean() for i in range(len(rv))]) for k in (5, 22)]
    return np.column_stack([np.ones(len(rv)), rv, *means])


# --- conditional variance ---------------------------------------------------------------------------------------------


def backcast(resid: np.ndarray) -> float:
    """Starting variance: exponentially weighted squares of the first 75 residuals at most."""
    n = min(75, len(resid))
    w = 0.94 ** np.arange(n)
    return float((w * resid[:n] ** 2).sum() / w.sum())


def variance_path(kind: str, resid: np.ndarray, params, start: float) -> np.ndarray:
    """Variance of each row from the rows before it."""
    omega, alpha, beta, gamma = params
    out, e, s = [0.0] * len(resid), resid.tolist(), start
    if kind == "egarch":
        log_s, z = math.log(start), 0.0
        usual = math.sqrt(2 / math.pi)
        for t in range(len(e)):
            if t:
                log_s = omega + alpha * (abs(z) - usual) + gamma * z + beta * log_s
            log_s = min(max(log_s, -50.0), 50.0)
            s = math.exp(log_s)
            out[t] = s
            z = e[t] / math.sqrt(s)
        return np.array(out)
    square, down = start, 0.5 * start
    for t in range(len(e)):
        s = omega + alpha * square + gamma * down + beta * s
        out[t] = s
        square = e[t] * e[t]
        down = square if e[t] < 0 else 0.0
    return np.array(out)


def fit_variance(kind: str, returns_pct: np.ndarray, dist: str = "normal", most: int = 250) -> dict:
    """GARCH, GJR or EGARCH (1, 1) with a constant mean by maximum likelihood, Normal or Student-t."""
    y = np.asarray(returns_pct, float)
    mu = float(y.mean())
    e = y - mu
    start, total = backcast(e), float(e.var())

    def unpack(v):
        if kind == "egarch":
            return v[0], v[1], math.tanh(v[2]), v[3]
        a, b = 1 / (1 + math.exp(-v[1])), 1 / (1 + math.exp(-v[2]))
        g = 0.5 * a * math.tanh(v[3]) if kind == "gjr" else 0.0
        b *= 0.999 - a
        return math.exp(v[0]), a, max(b, 0.0), g

    def loss(v):
        try:
            s = variance_path(kind, e, unpack(v), start)
        except OverflowError:
            return 1e12
        if not np.isfinite(s).all() or (s <= 0).any():
            return 1e12
        if dist == "normal":
            return 0.5 * float((np.log(2 * math.pi * s) + e * e / s).sum())
        nu = 2.05 + math.exp(min(v[-1], 5))
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return -float((c - 0.5 * np.log(s) - (nu + 1) / 2 * np.log1p(e * e / (s * (nu - 2)))).sum())

    x0 = [math.log(total) * 0.1, 0.15, 1.5, 0.0] if kind == "egarch" else [math.log(0.05 * total), -2.5, 2.2, 0.0]
    x0 += [1.5] * (dist == "t")
    v, value, done = nelder_mead(loss, x0, most=most)
    omega, alpha, beta, gamma = unpack(v)
    k = {"garch": 4, "gjr": 5, "egarch": 5}[kind] + (dist == "t")
    return {"kind": kind, "dist": dist, "mu": mu, "params": (omega, alpha, beta, gamma), "backcast": start, "loglik": -value, "aic": 2 * value + 2 * k, "bic": 2 * value + k * math.log(len(y)), "converged": done}


def best_variance(kind: str, returns_pct: np.ndarray) -> dict:
    return min((fit_variance(kind, returns_pct, dist) for dist in ("normal", "t")), key=lambda fit: fit["aic"])


def settled_variance(kind: str, returns_pct: np.ndarray, most: int = 600) -> dict | None:
    """The Normal or Student-t fit of best AIC of those that converged; None if neither did."""
    fits = [fit_variance(kind, returns_pct, dist, most) for dist in ("normal", "t")]
    return min((f for f in fits if f["converged"] and math.isfinite(f["aic"])), key=lambda fit: fit["aic"], default=None)


# --- state space ------------------------------------------------------------------------------------------------------


def filter_level(y: np.ndarray, noise: float, drift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(filtered level, innovations, log-likelihood) of a local level; the first row starts it."""
    level, p, loglik = float(y[0]), noise, 0.0
    levels, innovations = [level], [0.0]
    for v in y[1:].tolist():
        p += drift
        f = p + noise
        e = v - level
        gain = p / f
        level += gain * e
        p *= 1 - gain
        loglik -= 0.5 * (math.log(2 * math.pi * f) + e * e / f)
        levels.append(level)
        innovations.append(e)
    return np.array(levels), np.array(innovations), loglik


def filter_trend(y: np.ndarray, noise: float, drift: float, bend: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(level, slope, innovations, log-likelihood) of a local linear trend; the first two rows start it."""
    level, slope = float(y[1]), float(y[1] - y[0])
    a, b, c = noise, noise, 2 * noise + drift
    levels, slopes, innovations, loglik = [float(y[0]), level], [0.0, slope], [0.0, 0.0], 0.0
    for v in y[2:].tolist():
        level += slope
        a, b, c = a + 2 * b + c + drift, b + c, c + bend
        f = a + noise
        e = v - level
        ga, gb = a / f, b / f
        level, slope = level + ga * e, slope + gb * e
        a, b, c = a - ga * a, b - ga * b, c - gb * b
        loglik -= 0.5 * (math.log(2 * math.pi * f) + e * e / f)
        levels.append(level)
        slopes.append(slope)
        innovations.append(e)
    return np.array(levels), np.array(slopes), np.array(innovations), loglik


def fit_state(y: np.ndarray, specification: str = "local level", most: int = 120) -> dict:
    """Variances by maximum likelihood; `boundary` where one is practically 0."""
    base = max(float(np.var(np.diff(y))), 1e-12)
    two = specification == "local level"
    run = filter_level if two else filter_trend

    def loss(v):
        return -run(y, *np.exp(np.clip(v, -40, 40)))[-1]

    x0 = np.log(base) + np.array([-1.0, -0.5] if two else [-1.0, -0.5, -4.0])
    v, value, done = nelder_mead(loss, x0, step=0.5, most=most)
    params = np.exp(np.clip(v, -40, 40))
    k = len(params)
    return {"params": params, "specification": specification, "converged": done, "boundary": bool((params < 1e-8 * max(base, 1)).any()), "loglik": -value, "aic": 2 * value + 2 * k, "bic": 2 * value + k * math.log(len(y))}


# --- regimes ----------------------------------------------------------------------------------------------------------


def forward(log_density: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, float]:
    """(filtered probabilities, log-likelihood): only rows up to each one count."""
    top = log_density.max(axis=1)
    dense = np.exp(log_density - top[:, None])
    out, p, loglik = np.empty_like(dense), start, 0.0
    for t in range(len(dense)):
        p = (p if t == 0 else p @ transition) * dense[t]
        s = p.sum()
        if s <= 0:
            p, s = np.full(len(p), 1.0 / len(p)), 1e-300
        p = p / p.sum()
        out[t] = p
        loglik += math.log(s) + top[t]
    return out, loglik


def smooth(filtered: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed probabilities, summed expected transitions), from all rows; for fitting only."""
    n, k = filtered.shape
    out, moves = filtered.copy(), np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        ahead = np.maximum(filtered[t] @ transition, 1e-300)
        joint = filtered[t][:, None] * transition * (out[t + 1] / ahead)
        out[t] = joint.sum(axis=1)
        moves += joint
    return out, moves


def gaussian(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for i, (m, c) in enumerate(zip(means, covs, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, i] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


def fit_regimes(x: np.ndarray, states: int = 2, seed: int = 42, steps: int = 200, tol: float = 1e-4, floor: float = 1e-4) -> dict:
    """A Gaussian hidden Markov chain by EM from one start: rows split by the size of their last column, jittered by seed.
    It has converged when a step gains less than `tol` of log-likelihood."""
    rng = np.random.default_rng(seed)
    order = np.argsort(np.argsort(np.abs(x[:, -1]) + rng.normal(0, 0.3 * x[:, -1].std() + 1e-12, len(x))))
    part = order * states // len(x)
    eye = np.eye(x.shape[1])
    means = np.array([x[part == s].mean(axis=0) for s in range(states)])
    covs = np.array([np.cov(x[part == s].T).reshape(x.shape[1], x.shape[1]) + floor * eye for s in range(states)])
    start, transition = np.full(states, 1 / states), np.full((states, states), 0.05 / max(states - 1, 1)) + np.eye(states) * (0.95 - 0.05 / max(states - 1, 1))
    history = []
    for _ in range(steps):
        filtered, loglik = forward(gaussian(x, means, covs), start, transition)
        history.append(loglik)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
            break
        weight, moves = smooth(filtered, transition)
        total = np.maximum(weight.sum(axis=0), 1e-9)
        start, transition = weight[0] / weight[0].sum(), (moves + 1e-9) / (moves + 1e-9).sum(axis=1, keepdims=True)
        means = weight.T @ x / total[:, None]
        covs = np.array([((x - means[s]).T * weight[:, s]) @ (x - means[s]) / total[s] + floor * eye for s in range(states)])
    return {"means": means, "covs": covs, "start": start, "transition": transition, "loglik": history[-1], "history": history, "converged": len(history) < steps}


def filter_regimes(fit: dict, x: np.ndarray) -> np.ndarray:
    return forward(gaussian(x, fit["means"], fit["covs"]), fit["start"], fit["transition"])[0]


def agreement(a: np.ndarray, b: np.ndarray, states: int) -> float:
    """Share of equal labels under the best renaming (a handful of states: all renamings are tried)."""
    from itertools import permutations

    return max(float(np.mean(np.asarray(p)[b] == a)) for p in permutations(range(states)))


# --- change points and complexity -------------------------------------------------------------------------------------


def change_points(values: np.ndarray, penalty: float = 3.0, min_size: int = 20) -> list[int]:
    """Last positions of the segments (the final one left out) of the least penalised squared error, after standardising.

    Exact optimal partitioning; a start is dropped once it can no longer lead to an optimum.
    """
    v = np.asarray(values, float)
    n, scale = len(v), float(np.std(v)) if len(v) else 0.0
    if n < 2 * min_size or scale <= 0:
        return []
    z = (v - v.mean()) / scale
    s1, s2 = np.concatenate([[0], np.cumsum(z)]), np.concatenate([[0], np.cumsum(z * z)])
    best, back, alive = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = 0.0
    for t in range(min_size, n + 1):
        if t >= 2 * min_size:
            alive = np.append(alive, t - min_size)
        cost = best[alive] + (s2[t] - s2[alive]) - (s1[t] - s1[alive]) ** 2 / (t - alive) + penalty * (alive > 0)
        i = int(np.argmin(cost))
        best[t], back[t] = cost[i], alive[i]
        alive = alive[cost - penalty * (alive > 0) <= best[t] + penalty]
    out, t = [], n
    while back[t] > 0:
        t = back[t]
        out.append(t - 1)
    return sorted(out)


def hurst(values: np.ndarray) -> float:
    """Slope of log rescaled range on log block size."""
    v = np.asarray(values, float)
    pairs = []
    for size in np.unique(np.geomspace(8, max(9, len(v) // 2), 8).astype(int)):
        blocks = v[: len(v) // size * size].reshape(-1, size)
        centred = blocks - blocks.mean(axis=1, keepdims=True)
        spread = centred.std(axis=1, ddof=1)
        path = np.cumsum(centred, axis=1)
        ok = spread > 0
        if ok.any():
            pairs.append((math.log(size), math.log(np.mean((path.max(axis=1) - path.min(axis=1))[ok] / spread[ok]))))
    if len(pairs) < 3:
        return math.nan
    x, y = np.array(pairs).T
    return float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def shannon_entropy(values: np.ndarray, bins: int = 10) -> float:
    return entropy(np.histogram(values, bins=bins)[0])


def permutation_entropy(values: np.ndarray, order: int = 3) -> float:
    rows = np.lib.stride_tricks.sliding_window_view(np.asarray(values, float), order)
    code = np.argsort(rows, axis=1, kind="stable") @ (order ** np.arange(order))
    return entropy(np.unique(code, return_counts=True)[1]) / math.log(math.factorial(order))


def adf(values: np.ndarray) -> tuple[float, int, int]:
    """(t statistic, lags, rows) of the augmented Dickey-Fuller regression with constant, lags by AIC."""
    y = np.asarray(values, float)
    d = np.diff(y)
    top = int(math.ceil(12 * (len(y) / 100) ** 0.25))
    top = max(0, min(top, len(y) // 2 - 2))

    def rows(k, hold):
        x = [np.ones(len(d) - hold), y[hold:-1], *(d[hold - i : len(d) - i] for i in range(1, k + 1))]
        return np.column_stack(x), d[hold:]

    lags = min(range(top + 1), key=lambda k: ols(*rows(k, top))["aic"])
    x, z = rows(lags, lags)
    fit = ols(x, z)
    sigma = float(fit["resid"] @ fit["resid"]) / (len(z) - x.shape[1])
    error = math.sqrt(sigma * np.linalg.inv(x.T @ x)[1, 1])
    return float(fit["beta"][1]) / error, lags, len(z)
