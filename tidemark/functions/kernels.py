"""State machines and fits on NumPy arrays. Nothing here knows Spark; grouped operators call it for one symbol or model."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from itertools import pairwise, permutations
from typing import NamedTuple

import numpy as np

UNKNOWN = "UNKNOWN"


class Boundary(NamedTuple):
    index: int
    probability: float
    source: str


# --- averages -------------------------------------------------------------------------------------------------------


def wilder(x: np.ndarray, period: int = 14) -> np.ndarray:
    """y0 = x0, then y + (x - y) / period."""
    a, out = 1 / max(1, period), np.empty(len(x))
    y = None
    for i, v in enumerate(x):
        y = float(v) if y is None else (1 - a) * y + a * float(v)
        out[i] = y
    return out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    out = high - low
    if len(close) > 1:
        out[1:] = np.maximum.reduce([out[1:], np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])])
    return out


def thresholds(high, low, close, period: int, multiple: float) -> np.ndarray:
    return np.maximum(wilder(true_range(high.copy(), low, close), period) * multiple, np.abs(close) * 1e-6)


def reversal_strength(move: float, threshold: float) -> float:
    return min(0.96, max(0.42, 0.42 + 0.18 * min(move / threshold, 3)))


# --- pivots ---------------------------------------------------------------------------------------------------------


def zigzag(high, low, close, period: int = 14, multiple: float = 2.2) -> list[Boundary]:
    """Reversal pivots seen in retrospect, between two edges. A bar that ends a rise may go on to end the fall it began."""
    n = len(close)
    if n < 2:
        return [Boundary(0, 1.0, "edge")] if n else []
    limit = thresholds(high, low, close, period, multiple)
    pivots, leg, at, best = [Boundary(0, 1.0, "edge")], 0, 0, close[0]
    for i in range(1, n):
        for side in (1, -1):
            if leg == -side:
                continue
            far, near = (high, low) if side > 0 else (low, high)
            if (far[i] - best) * side >= 0:
                at, best = i, far[i]
            back = (best - close[i]) * side
            if back >= limit[i]:
                pivots.append(Boundary(at, reversal_strength(back, limit[i]), "atr_zigzag"))
                leg, at, best = -side, i, near[i]
    return [*pivots, Boundary(n - 1, 1.0, "edge")]


class CausalZigzag:
    """The same reversals known bar by bar. step() gives a pivot (bar, probability) when the bar confirms it. Until a first
    move of a threshold from the first close there is no leg and no pivot; a bar that makes a new extreme confirms none."""

    FIELDS = ("i", "atr", "last_close", "leg", "at", "best")

    def __init__(self, period: int = 14, multiple: float = 2.2, state: Sequence[float] | None = None):
        self.period, self.multiple = period, multiple
        self.i, self.atr, self.last_close, self.leg, self.at, self.best = state or (-1, 0.0, 0.0, 0, 0, 0.0)

    def state(self) -> tuple:
        return (int(self.i), float(self.atr), float(self.last_close), int(self.leg), int(self.at), float(self.best))

    def step(self, high: float, low: float, close: float) -> tuple[int, float] | None:
        self.i += 1
        i, a = self.i, 1 / max(1, self.period)
        if i == 0:
            self.atr, self.last_close, self.best = high - low, close, close
            return None
        span = max(high - low, abs(high - self.last_close), abs(low - self.last_close))
        self.atr, self.last_close = (1 - a) * self.atr + a * span, close
        limit = max(self.atr * self.multiple, abs(close) * 1e-6)
        if self.leg == 0:
            rise, fall = high - self.best, self.best - low
            if rise >= limit and rise >= fall:
                self.leg, self.at, self.best = 1, i, high
            elif fall >= limit:
                self.leg, self.at, self.best = -1, i, low
            return None
        far, near = (high, low) if self.leg > 0 else (low, high)
        if (far - self.best) * self.leg >= 0:
            self.at, self.best = i, far
            return None
        back = (self.best - close) * self.leg
        if back < limit:
            return None
        pivot = (self.at, reversal_strength(back, limit))
        self.leg, self.at, self.best = -self.leg, i, near
        return pivot


def causal_pivots(high, low, close, period: int = 14, multiple: float = 2.2) -> list[tuple[int, float, int]]:
    """(pivot bar, probability, confirming bar), the first bar first."""
    if len(close) < 2:
        return []
    machine, out = CausalZigzag(period, multiple), [(0, 1.0, 0)]
    for i, bar in enumerate(zip(high, low, close, strict=True)):
        if pivot := machine.step(*map(float, bar)):
            out.append((*pivot, i))
    return out


# --- change points --------------------------------------------------------------------------------------------------


def structure_scores(high, low, close, volume, min_bars: int) -> tuple[np.ndarray, int]:
    """Largest robust shift of four signals between the spans before and after each bar, and the span (0: too short)."""
    n = len(close)
    span = max(min_bars, int(math.sqrt(n)))
    if n < 2 * span + 1:
        return np.zeros(n), 0
    change = np.diff(np.log(np.maximum(close, 1e-12)), prepend=np.log(max(close[0], 1e-12)))
    with np.errstate(divide="ignore", invalid="ignore"):
        wide = np.where(close != 0, (high - low) / close, 0.0)
    best = np.zeros(n)
    for s in (change, np.abs(change), wide, np.log1p(np.maximum(volume, 0))):
        unit = 1.4826 * float(np.median(np.abs(s - np.median(s)))) + 1e-9
        means = np.convolve(s, np.ones(span), "valid") / span  # means[k]: bars k .. k+span-1
        i = np.arange(span, n - span)
        best[i] = np.maximum(best[i], np.abs(means[i + 1] - means[i - span]) / unit)
    return best, span


def structure(high, low, close, volume, min_bars: int) -> list[Boundary]:
    score, span = structure_scores(high, low, close, volume, min_bars)
    if not span:
        return []
    n, least = len(score), max(1.25, float(np.quantile(score, 0.72)))
    chosen: list[int] = []
    for i in range(span, n - span):
        around = score[max(span, i - min_bars) : min(n - span, i + min_bars + 1)]
        if score[i] < least or score[i] < around.max():
            continue
        if not chosen or i - chosen[-1] >= min_bars:
            chosen.append(i)
        elif score[i] > score[chosen[-1]]:
            chosen[-1] = i
    return [Boundary(i, min(0.82, max(0.42, 0.38 + 0.12 * float(score[i]))), "adaptive_structure") for i in chosen]


def fractals(high, low, close, window: int, least: float, period: int) -> list[Boundary]:
    n = len(close)
    if n < 2 * window + 1:
        return []
    atr = np.maximum(wilder(true_range(high.copy(), low, close), period), 1e-12)
    views = np.lib.stride_tricks.sliding_window_view
    i = np.arange(window, n - window)
    others = [k for k in range(2 * window + 1) if k != window]
    peak = high[i] - views(high, 2 * window + 1)[:, others].max(axis=1)
    trough = views(low, 2 * window + 1)[:, others].min(axis=1) - low[i]
    tall = np.maximum(peak, trough) / atr[i]
    return [Boundary(int(k), min(0.82, max(0.40, 0.38 + 0.18 * float(t))), "fractal") for k, t in zip(i, tall, strict=True) if t >= least]


def change_probabilities(values: np.ndarray, hazard: float, cap: int) -> np.ndarray:
    """Probability of run length 0 at each value: online Bayesian change points with a Student-t predictive. Runs past the
    cap are dropped and the rest renormalised."""
    x = np.asarray(values, float)
    middle = np.nanmedian(x)
    x = np.nan_to_num((x - middle) / (np.nanmedian(np.abs(x - middle)) * 1.4826 + 1e-9))
    hazard = min(0.5, max(1e-5, hazard))
    length = np.arange(cap + 1)
    # kappa, alpha and the constant of the density depend on the run length only
    kappa, alpha = 0.25 + length, 1.5 + 0.5 * length
    constant = np.array([math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(2 * a * math.pi) for a in alpha])
    weight, mu, beta = np.zeros(cap + 1), np.zeros(cap + 1), np.ones(cap + 1)
    weight[0] = 1.0
    out = np.empty(len(x))
    for t, v in enumerate(x):
        scale = np.sqrt(beta * (kappa + 1) / (alpha * kappa))
        z = (v - mu) / scale
        density = np.exp(constant - np.log(scale) - (alpha + 0.5) * np.log1p(z * z / (2 * alpha))) + 1e-300
        fresh = weight.sum() * hazard * density[0]
        weight = np.concatenate([[fresh], weight[:-1] * (1 - hazard) * density[:-1]])
        weight /= max(weight.sum(), 1e-300)
        out[t] = weight[0]
        grown = beta[:-1] + kappa[:-1] * (v - mu[:-1]) ** 2 / (2 * (kappa[:-1] + 1))
        beta = np.concatenate([[1.0], grown])
        mu = np.concatenate([[0.0], (kappa[:-1] * mu[:-1] + v) / (kappa[:-1] + 1)])
    return out


def change_points(close, hazard: float, min_run: int, least: float, max_run: int) -> list[Boundary]:
    n = len(close)
    if n < 2 * min_run + 1:
        return []
    change = np.diff(np.log(np.maximum(close, 1e-12)), prepend=np.log(max(close[0], 1e-12)))
    cap, radius = max(min_run + 1, max_run), max(1, min_run // 2)
    p = np.maximum(change_probabilities(change, hazard, cap), change_probabilities(np.abs(change), hazard, cap))
    keep = [i for i in range(min_run, n - min_run) if p[i] >= least and p[i] >= p[max(0, i - radius) : i + radius + 1].max()]
    return [Boundary(i, min(0.9, max(0.42, 0.4 + 0.55 * float(p[i]))), "bocpd") for i in keep]


def kernel_changes(close, volume, penalty: float = 5.0, jump: int = 5) -> list[Boundary]:
    """Change points of return and log volume by a Gaussian kernel cost under a penalty (the optimum that PELT finds): ends of
    segments lie on every jump-th bar, segments have at least a thirtieth of the bars. Memory grows with the square of the bars."""
    n = len(close)
    if n < 12:
        return []
    price = np.log(np.maximum(close, 1e-12))
    x = np.stack([np.diff(price, prepend=price[0]), np.log1p(np.maximum(volume, 0))], axis=1)
    sd = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(sd > 1e-10, sd, 1.0)
    gap = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    middle = np.median(gap[np.triu_indices(n, 1)])
    gram = np.exp(-np.clip(gap / middle if middle else gap, 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = gram.cumsum(axis=0).cumsum(axis=1)
    least = max(3, n // 30)
    ends = [t for t in range(0, n, jump) if t >= least] + [n]
    total, back = {0: 0.0}, {}
    for t in ends:
        starts = np.array([s for s in total if t - s >= least])
        if not len(starts):
            continue
        inside = area[t, t] - area[starts, t] - area[t, starts] + area[starts, starts]
        worth = np.array([total[s] for s in starts]) + (t - starts) - inside / (t - starts) + penalty
        total[t], back[t] = float(worth.min()), int(starts[worth.argmin()])
    cuts, t = [], n
    while back.get(t):
        t = back[t]
        cuts.append(t)
    return [Boundary(t - 1, 0.58, "ruptures") for t in reversed(cuts) if t < n - 1]


def fuse(found: Sequence[Boundary], n: int, tolerance: int, min_bars: int, least: float, votes: int, alone: float) -> list[Boundary]:
    """One boundary for each chain of near ones, by weighted mean and joint probability; weak ones of few sources go, both
    ends are edges, and legs shorter than min_bars (but the last) lose their less certain end."""
    edges = [Boundary(0, 1.0, "edge"), Boundary(n - 1, 1.0, "edge")]
    chains: list[list[Boundary]] = []
    for b in sorted(found, key=lambda b: b.index):
        if chains and b.index - chains[-1][-1].index <= tolerance:
            chains[-1].append(b)
        else:
            chains.append([b])
    kept: list[Boundary] = []
    for chain in chains:
        index, p = np.array([b.index for b in chain]), np.array([b.probability for b in chain])
        joint = min(0.99, 1 - float(np.prod(1 - p)))
        names = {s for b in chain for s in b.source.split("+")}
        at = round(float(np.average(index, weights=p)))
        if at in (0, n - 1) or (joint >= least and (len(names - {"edge"}) >= votes or joint >= alone)):
            kept.append(Boundary(at, joint, "+".join(sorted(names))))
    if len(kept) < 2:
        return edges
    kept[0], kept[-1] = edges
    i = 1
    while i < len(kept) - 1:
        if kept[i].index - kept[i - 1].index >= min_bars:
            i += 1
        elif i > 1 and kept[i - 1].probability <= kept[i].probability:
            del kept[i - 1]
            i = 1
        else:
            del kept[i]
            i = 1
    return kept


def match(left: Sequence[int], right: Sequence[int], tolerance: int) -> list[tuple[int, int]]:
    """Pairs of two sorted lists no more than tolerance apart, each taken once, in one pass from the left."""
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        gap = left[i] - right[j]
        if abs(gap) <= tolerance:
            out.append((left[i], right[j]))
            i, j = i + 1, j + 1
        elif gap < 0:
            i += 1
        else:
            j += 1
    return out


def keyed_rng(*key) -> np.random.Generator:
    """A generator that depends on the key alone, so results do not depend on how symbols are dealt over tasks."""
    digest = hashlib.blake2b("\x1f".join(map(str, key)).encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "little"))


def perturb(bars: dict[str, np.ndarray], rng: np.random.Generator, price: float = 0.002, volume: float = 0.08) -> dict[str, np.ndarray]:
    """Bars with one lognormal factor a bar on all prices and another on volume; high and low enclose open and close."""
    n = len(bars["close"])
    by = np.exp(rng.normal(0, price, n))
    out = {c: bars[c] * by for c in ("open", "high", "low", "close")}
    out["high"] = np.maximum.reduce([out[c] for c in ("open", "high", "low", "close")])
    out["low"] = np.minimum.reduce([out[c] for c in ("open", "high", "low", "close")])
    return out | {"volume": np.maximum(bars["volume"], 0) * np.exp(rng.normal(0, volume, n))}


# --- sequences ------------------------------------------------------------------------------------------------------


def geometric_durations(labels: Sequence[str], longest: int = 8, shortest: int | Mapping[str, int] = 2, continuation: float = 0.65) -> dict[str, np.ndarray]:
    """For each label the probability of a run of 0 .. longest segments."""
    if longest < 1 or not 0 < continuation < 1:
        raise ValueError("longest must be positive and continuation between 0 and 1")
    out = {}
    for label in labels:
        low = max(1, int(shortest.get(label, 1) if isinstance(shortest, Mapping) else shortest))
        d = np.arange(longest + 1)
        p = np.where(d >= low, (1 - continuation) * continuation ** np.maximum(d - low, 0.0), 0.0)
        if not p.any():
            p[longest] = 1.0
        out[label] = p / p.sum()
    return out


def transition_prior(k: int, given: np.ndarray | None = None) -> np.ndarray:
    m = np.ones((k, k)) - (np.eye(k) if k > 1 else 0) if given is None else np.maximum(np.asarray(given, float), 0)
    if m.shape != (k, k):
        raise ValueError(f"transitions must be {k} x {k}")
    total = m.sum(axis=1, keepdims=True)
    return m / np.where(total > 0, total, 1)


def hsmm_path(emission: np.ndarray, durations: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, float]:
    """Best labelling by explicit-duration Viterbi (durations: labels x 0..longest) and its score; no label follows itself.
    Without a path of possible durations each row takes its most probable label."""
    n, k = emission.shape
    rows = emission / np.maximum(emission.sum(axis=1, keepdims=True), 1e-12)
    log_e = np.log(np.clip(rows, 1e-12, 1))
    total = np.vstack([np.zeros(k), log_e.cumsum(axis=0)])
    with np.errstate(divide="ignore"):
        log_d = np.log(durations)
    log_t = np.log(np.clip(transition, 1e-12, 1))
    np.fill_diagonal(log_t, -np.inf)
    best = np.full((n + 1, k), -np.inf)
    came, lasted = np.full((n + 1, k), -1), np.ones((n + 1, k), int)
    enter, by = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -1)
    enter[0] = -math.log(k)
    for end in range(1, n + 1):
        d = np.arange(1, min(end, durations.shape[1] - 1) + 1)
        options = enter[end - d] + (total[end] - total[end - d]) + log_d[:, d].T
        first = options.argmax(axis=0)
        best[end] = options[first, np.arange(k)]
        lasted[end], came[end] = d[first], by[end - d[first], np.arange(k)]
        steps = best[end][:, None] + log_t
        by[end], enter[end] = steps.argmax(axis=0), steps.max(axis=0)
    state = int(best[n].argmax())
    if not np.isfinite(best[n, state]):
        return rows.argmax(axis=1), float(np.log(np.clip(rows.max(axis=1), 1e-12, 1)).sum())
    path, end, score = np.empty(n, int), n, float(best[n, state])
    while end > 0:
        run, before = lasted[end, state], came[end, state]
        path[end - run : end] = state
        end, state = end - run, before
    return path, score


def dwell(labels: Sequence[str], unknown: Sequence[bool], bars: Sequence[int], least: int | Mapping[str, int] = 5, state: tuple = (None, 0)) -> tuple[list[str], tuple]:
    """Past-only smoothing: a label holds until it has lasted `least` bars; UNKNOWN starts anew. Also the state after it."""
    current, lasted = state
    out = []
    for label, no, n in zip(labels, unknown, bars, strict=True):
        if no:
            current, lasted = None, 0
            out.append(UNKNOWN)
            continue
        needed = (int(least.get(current, 1)) if current else 0) if isinstance(least, Mapping) else int(least)
        if label != current and (current is None or lasted >= needed):
            current, lasted = label, 0
        out.append(current)
        lasted += int(n)
    return out, (current, lasted)


# --- mixtures -------------------------------------------------------------------------------------------------------


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row at least total cost (square). Up to 7 rows by trying all, else by shortest augmenting paths."""
    n = len(cost)
    if n <= 7:
        return np.array(min(permutations(range(n)), key=lambda p: cost[range(n), p].sum()), int)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], slack, back, seen, j = row, np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool), 0
        while True:
            seen[j] = True
            reduced = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~seen[1:] & (reduced < slack[1:])
            slack[1:][better], back[1:][better] = reduced[better], j
            free = np.flatnonzero(~seen)
            nxt = free[slack[free].argmin()]
            step = slack[nxt]
            u[owner[seen]] += step
            v[seen] -= step
            slack[~seen] -= step
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j], j = owner[back[j]], back[j]
    out = np.empty(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


class RobustScaler:
    """Training medians for gaps, then median and interquartile range (0: 1); infinities count as gaps."""

    def __init__(self, x: np.ndarray):
        x = np.where(np.isfinite(x), x, np.nan)
        some = ~np.isnan(x).all(axis=0)
        self.fill = np.where(some, np.nanmedian(np.where(some, x, 0.0), axis=0), 0.0)
        filled = np.where(np.isnan(x), self.fill, x)
        q1, self.middle, q3 = np.quantile(filled, [0.25, 0.5, 0.75], axis=0)
        self.spread = np.where(q3 > q1, q3 - q1, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isfinite(x), x, self.fill) - self.middle) / self.spread


class Mixture(NamedTuple):
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    converged: bool
    bound: float

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - self.means) ** 2 / self.variances).sum(axis=2)
        return np.log(np.maximum(self.weights, 1e-300)) - 0.5 * (d + np.log(2 * np.pi * self.variances).sum(axis=1))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(self.log_joint(x), axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        j = self.log_joint(x)
        return np.exp(j - np.logaddexp.reduce(j, axis=1)[:, None])


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres, then a few Lloyd steps."""
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(10):
        near = ((x[:, None, :] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
    return c


def gaussian_mixture(x: np.ndarray, k: int, rng: np.random.Generator, *, starts: int = 3, reg: float = 1e-4, max_iter: int = 100, tol: float = 1e-3) -> Mixture:
    """Diagonal mixture by EM; the start of the best likelihood."""
    best = None
    for _ in range(starts):
        means = _seeds(x, k, rng)
        m = Mixture(np.full(k, 1 / k), means, np.tile(x.var(axis=0) + reg, (k, 1)), False, -np.inf)
        for _ in range(max_iter):
            joint = m.log_joint(x)
            total = np.logaddexp.reduce(joint, axis=1)
            r = np.exp(joint - total[:, None])
            size = r.sum(axis=0) + 1e-12
            means = r.T @ x / size[:, None]
            variances = np.maximum(r.T @ x**2 / size[:, None] - means**2, 0) + reg
            bound = float(total.mean())
            m = Mixture(size / len(x), means, variances, abs(bound - m.bound) < tol, bound)
            if m.converged:
                break
        if best is None or m.bound > best.bound:
            best = m
    return best


class FullMixture(NamedTuple):
    """A mixture with whole covariance matrices, by their Cholesky factors of the precision."""

    weights: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    converged: bool
    bound: float

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, f) in enumerate(zip(self.weights, self.means, self.factors, strict=True)):
            z = (x - m) @ f
            out[:, j] = np.log(max(w, 1e-300)) + np.log(np.abs(np.diag(f))).sum() - 0.5 * ((z**2).sum(axis=1) + x.shape[1] * np.log(2 * np.pi))
        return out

    log_density, probabilities = Mixture.log_density, Mixture.probabilities


def full_mixture(x: np.ndarray, k: int, rng: np.random.Generator, *, starts: int = 2, reg: float = 1e-5, max_iter: int = 100, tol: float = 1e-3) -> FullMixture:
    """Mixture with full covariances by EM; the start of the best likelihood."""
    best, d = None, x.shape[1]
    for _ in range(starts):
        near = ((x[:, None, :] - _seeds(x, k, rng)) ** 2).sum(axis=2).argmin(axis=1)
        r, last = np.eye(k)[near] + 1e-3 / k, -np.inf
        for _ in range(max_iter):
            r = r / r.sum(axis=1, keepdims=True)
            size = r.sum(axis=0) + 1e-12
            means = r.T @ x / size[:, None]
            factors = np.empty((k, d, d))
            for j in range(k):
                c = x - means[j]
                factors[j] = np.linalg.inv(np.linalg.cholesky((c * r[:, j : j + 1]).T @ c / size[j] + reg * np.eye(d))).T
            m = FullMixture(size / len(x), means, factors, False, last)
            joint = m.log_joint(x)
            total = np.logaddexp.reduce(joint, axis=1)
            r, bound = np.exp(joint - total[:, None]), float(total.mean())
            done, last = abs(bound - last) < tol, bound
            if done:
                break
        m = m._replace(converged=done, bound=last)
        if best is None or m.bound > best.bound:
            best = m
    return best


def _digamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, float), np.zeros_like(x, dtype=float)
    while (x < 6).any():
        shift -= np.where(x < 6, 1 / x, 0)
        x = np.where(x < 6, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def process_mixture(x: np.ndarray, k: int, rng: np.random.Generator, *, prior: float = 1e-3, starts: int = 2, reg: float = 1e-4, max_iter: int = 100, tol: float = 1e-3) -> Mixture:
    """Diagonal mixture with stick-breaking weights cut at k, by mean-field updates."""
    best = None
    for _ in range(starts):
        near = ((x[:, None, :] - _seeds(x, k, rng)) ** 2).sum(axis=2).argmin(axis=1)
        r = np.eye(k)[near] * 0.98 + 0.02 / k
        last, done, d = -np.inf, False, x.shape[1]
        for _ in range(max_iter):
            size = r.sum(axis=0) + 1e-12
            order = np.argsort(-size)
            tail = np.zeros(k)
            tail[order] = size[order][::-1].cumsum()[::-1] - size[order]
            a, b = 1 + size, prior + tail
            both = _digamma(a + b)
            log_v, log_rest = _digamma(a) - both, _digamma(b) - both
            before = np.zeros(k)
            before[order] = np.concatenate([[0], log_rest[order].cumsum()[:-1]])
            log_w = log_v + before
            kappa, dof = 1 + size, d + size
            middle = x.mean(axis=0)
            means = (middle + r.T @ x) / kappa[:, None]
            raw = r.T @ x / size[:, None]
            scatter = np.maximum(r.T @ x**2 - size[:, None] * raw**2, 0) + (size / kappa)[:, None] * (raw - middle) ** 2 + x.var(axis=0)
            variances = scatter / dof[:, None] + reg
            spread = ((x[:, None, :] - means) ** 2 / variances).sum(axis=2) + d / kappa
            joint = log_w - 0.5 * (spread + np.log(2 * np.pi * variances).sum(axis=1) - d * (_digamma(dof / 2) - np.log(dof / 2)))
            total = np.logaddexp.reduce(joint, axis=1)
            r, bound = np.exp(joint - total[:, None]), float(total.mean())
            done, last = abs(bound - last) < tol, bound
            if done:
                break
        w = np.exp(log_w)
        m = Mixture(w / w.sum(), means, variances, done, last)
        if best is None or m.bound > best.bound:
            best = m
    return best


def runs(flags: Sequence[bool]) -> list[tuple[int, int]]:
    """Half-open ranges of consecutive true flags."""
    at = [0, *(i for i, (a, b) in enumerate(pairwise(flags), 1) if a != b), len(flags)]
    return [(a, b) for a, b in pairwise(at) if a < b and flags[a]]
