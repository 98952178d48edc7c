"""Small-matrix statistics on the driver: model-sized data (thousands of rows), never micro rows."""

from __future__ import annotations

import math

import numpy as np


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square law, by series or continued fraction of the incomplete gamma."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def student_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's law, by the regularised incomplete beta function."""
    x = df / (df + t * t)
    return _beta_reg(df / 2, 0.5, x)


def _beta_reg(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_reg(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + even * d), 1 + even / c
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + odd * d), 1 + odd / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def ols(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares with an intercept: coefficients, p-values, residuals over the residual scale."""
    design = np.column_stack([np.ones(len(y)), x])
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ y
    fitted = design @ beta
    free = len(y) - np.linalg.matrix_rank(design)
    scale = float(((y - fitted) ** 2).sum() / free)
    error = np.sqrt(np.diag(inverse) * scale)
    return {"beta": beta, "p": np.array([student_sf2(b / e, free) for b, e in zip(beta, error)]), "fitted": fitted, "scaled_residual": (y - fitted) / math.sqrt(scale)}


def nb2(x: np.ndarray, y: np.ndarray, exposure: np.ndarray, rounds: int = 200) -> dict:
    """Negative-binomial regression with variance mu + alpha mu^2 and an exposure, by maximum likelihood.

    Coefficients by Newton steps (Fisher scoring), log alpha by a bracketed search of the profile."""
    design = np.column_stack([np.ones(len(y)), x])
    offset = np.log(exposure)

    def fit(alpha: float, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            mu = np.exp(np.clip(design @ beta + offset, -30, 30))
            weight = mu / (1 + alpha * mu)
            step = np.linalg.lstsq(design.T @ (design * weight[:, None]), design.T @ ((y - mu) / (1 + alpha * mu)), rcond=None)[0]
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
        return beta, np.exp(np.clip(design @ beta + offset, -30, 30))

    gamma = np.vectorize(math.lgamma)
    start = np.zeros(design.shape[1])
    start[0] = math.log(max(y.sum(), 0.5) / exposure.sum())

    def loss(log_alpha: float) -> float:
        a = math.exp(log_alpha)
        _, mu = fit(a, start)
        r = 1 / a
        return -float((gamma(y + r) - gamma(y + 1) - math.lgamma(r) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum())

    lo, hi, golden = math.log(1e-4), math.log(50.0), (math.sqrt(5) - 1) / 2
    c, d = hi - golden * (hi - lo), lo + golden * (hi - lo)
    fc, fd = loss(c), loss(d)
    for _ in range(60):
        if fc < fd:
            hi, d, fd = d, c, fc
            c = hi - golden * (hi - lo)
            fc = loss(c)
        else:
            lo, c, fc = c, d, fd
            d = lo + golden * (hi - lo)
            fd = loss(d)
    alpha = math.exp((lo + hi) / 2)
    beta, mu = fit(alpha, start)
    return {"beta": beta, "alpha": alpha, "mu": mu, "pearson": (y - mu) / np.sqrt(mu + alpha * mu * mu)}


def folds(n: int, k: int = 5, seed: int = 42) -> np.ndarray:
    """A fold number for each row, from one fixed permutation."""
    out = np.empty(n, int)
    for no, rows in enumerate(np.array_split(np.random.RandomState(seed).permutation(n), k)):
        out[rows] = no
    return out


def cv_predict(fit_predict, x: np.ndarray, y: np.ndarray, k: int = 5, **by_row) -> np.ndarray:
    """Predictions of each fold by a model of the others. fit_predict(x, y, x_new, rows, new_rows, **by_row)."""
    fold, out = folds(len(y), k), np.empty(len(y))
    for no in range(k):
        train, new = np.flatnonzero(fold != no), np.flatnonzero(fold == no)
        out[new] = fit_predict(x[train], y[train], x[new], train, new, **by_row)
    return out


def goodness(y: np.ndarray, predicted: np.ndarray) -> dict:
    error = y - predicted
    return {
        "r2": float(1 - (error**2).sum() / ((y - y.mean()) ** 2).sum()),
        "rmse": float(np.sqrt((error**2).mean())),
        "mae": float(np.abs(error).mean()),
    }


def davies_bouldin(points: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    names = np.unique(labels)
    mean = lambda values, c: np.average(values, axis=0, weights=None if weights is None else weights[labels == c])
    centres = np.array([mean(points[labels == c], c) for c in names])
    spread = np.array([mean(np.linalg.norm(points[labels == c] - m, axis=1), c) for c, m in zip(names, centres)])
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    np.fill_diagonal(apart, np.inf)
    return float(((spread[:, None] + spread[None]) / apart).max(axis=1).mean())


def silhouette(points: np.ndarray, labels: np.ndarray, block: int = 512) -> float:
    """Mean Euclidean silhouette, by blocks of rows against all."""
    names, at = np.unique(labels, return_inverse=True)
    size = np.bincount(at)
    out = []
    for lo in range(0, len(points), block):
        d = np.sqrt(np.maximum(((points[lo : lo + block, None] - points[None]) ** 2).sum(axis=2), 0))
        sums = np.stack([d[:, at == c].sum(axis=1) for c in range(len(names))], axis=1)
        own = at[lo : lo + block]
        rows = np.arange(len(own))
        inner = sums[rows, own] / np.maximum(size[own] - 1, 1)
        means = sums / size
        means[rows, own] = np.inf
        outer = means.min(axis=1)
        score = np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
        out.append(score)
    return float(np.concatenate(out).mean())


class Places:
    """Distinct weighted points in the order of a balanced tree, and sums of distances from them to the clusters of labellings.

    Level l has 2**l nodes of equal size, halved across their widest side. Node j of level l holds the points from
    ``(j * n) >> l``. The moments of each cluster in a node bound its sum of distances to points far from it."""

    #: points of a leaf, at most
    LEAF = 128
    #: maxima of the third and fourth coefficient of sqrt(1 - 2tu + t**2) in t; later ones are smaller
    THIRD, FOURTH = 1 / (3 * np.sqrt(3)), 1 / 8

    def __init__(self, points: np.ndarray, weights: np.ndarray, labels: dict[int, np.ndarray]):
        n, self.dims = points.shape
        self.levels = max(0, int(np.ceil(np.log2(max(n, 1) / self.LEAF))))
        order, at = np.arange(n), np.zeros(n, int)
        for level in range(self.levels):
            starts, here = self._starts(n, level)[:-1], points[order]
            wide = (np.maximum.reduceat(here, starts) - np.minimum.reduceat(here, starts)).argmax(axis=1)
            order = order[np.lexsort((here[np.arange(n), wide[at]], at))]
            at = np.repeat(np.arange(2 << level), np.diff(self._starts(n, level + 1)))
        self.points, self.weights = points[order], weights[order]
        self.own, self.size, self.ks = {}, [], list(labels)
        for k, label in labels.items():
            names, own = np.unique(label[order], return_inverse=True)
            self.own[k] = own + sum(map(len, self.size))
            self.size.append(np.bincount(own, self.weights, len(names)))
        self.spans = {k: slice(sum(map(len, self.size[:i])), sum(map(len, self.size[: i + 1]))) for i, k in enumerate(self.ks)}
        self.size = np.concatenate(self.size)

    @staticmethod
    def _starts(n: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * n) >> level

    def blocks(self) -> int:
        return 1 << self.levels

    def rows(self, block: int) -> slice:
        """The points of a leaf."""
        return slice((block * len(self.points)) >> self.levels, ((block + 1) * len(self.points)) >> self.levels)

    def grow(self) -> "Places":
        """Add the nodes' centres, radii and moments."""
        self.centre, self.radius, self.moments = [], [], []
        pairs = [(a, b) for a in range(self.dims) for b in range(a, self.dims)]
        for level in range(self.levels + 1):
            starts = self._starts(len(self.points), level)
            at = np.repeat(np.arange(1 << level), np.diff(starts))
            centre = np.add.reduceat(self.points, starts[:-1]) / np.diff(starts)[:, None]
            gap = self.points - centre[at]
            far = np.sqrt((gap**2).sum(axis=1))
            terms = [np.ones(len(at)), *gap.T, *[gap[:, a] * gap[:, b] * (1 if a == b else 2) for a, b in pairs], far**2, far**3, far**4]
            moments = np.empty((len(terms), 1 << level, len(self.size)))
            for k, span in self.spans.items():
                clusters = span.stop - span.start
                cell = at * clusters + self.own[k] - span.start
                for i, term in enumerate(terms):
                    moments[i, :, span] = np.bincount(cell, self.weights * term, clusters << level).reshape(-1, clusters)
            self.centre.append(centre)
            self.radius.append(np.maximum.reduceat(far, starts[:-1]))
            self.moments.append(moments)
        return self

    def direct(self, rows: slice, others: np.ndarray, wide: int = 1024) -> np.ndarray:
        """Sums of distances of the leaf ``rows`` to it and the points ``others`` by cluster.

        Squares are taken apart about the leaf's mean, so near points keep their digits; in the leaf itself they are of differences."""
        here = self.points[rows]
        centre = here.mean(axis=0)
        here = here - centre
        left = np.column_stack([-2 * here, (here**2).sum(axis=1), np.ones(len(here))])
        out = np.sqrt(((here[:, None] - here) ** 2).sum(axis=2)) @ self._member(np.arange(rows.start, rows.stop))
        others = others[(others < rows.start) | (others >= rows.stop)]
        for x in range(0, len(others), wide):
            some = others[x : x + wide]
            there = (self.points[some] - centre).T
            d = left @ np.vstack([there, np.ones(len(some)), (there**2).sum(axis=0)])
            out += np.sqrt(np.maximum(d, 0, out=d), out=d) @ self._member(some)
        return out

    def _member(self, some: np.ndarray) -> np.ndarray:
        """Weights of points in the clusters of all labellings."""
        out = np.zeros((len(some), len(self.size)))
        for own in self.own.values():
            out[np.arange(len(some)), own[some]] = self.weights[some]
        return out

    def bounds(self, block: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """(sums of distances by cluster of the rows of a leaf, the largest error of those).

        Nodes within ``theta`` times their distance in radius are taken by their moments up to the second; leaves nearer than that point by point."""
        rows = self.rows(block)
        here, centre, reach = self.points[rows], self.centre[-1][block], self.radius[-1][block]
        total, error = np.zeros((len(here), len(self.size))), np.zeros((len(here), len(self.size)))
        open_ = np.zeros(1, int)
        for level in range(self.levels + 1):
            apart = np.sqrt(((self.centre[level][open_] - centre) ** 2).sum(axis=1)) - reach
            taken = self.radius[level][open_] < theta * apart
            if taken.any():
                self._by_moments(here, level, open_[taken], total, error)
            open_ = open_[~taken]
            if level < self.levels:
                open_ = np.concatenate([2 * open_, 2 * open_ + 1])
        near = np.concatenate([np.arange(self.rows(j).start, self.rows(j).stop) for j in np.sort(open_)])
        return total + self.direct(rows, near), error

    def _by_moments(self, here, level, nodes, total, error):
        m = self.moments[level][:, nodes]
        gap = here[:, None] - self.centre[level][nodes]
        r = np.sqrt((gap**2).sum(axis=2))
        gap /= r[..., None]
        total += r @ m[0]
        for a in range(self.dims):
            total -= gap[..., a] @ m[1 + a]
        half, i = 0.5 / r, 1 + self.dims
        for a in range(self.dims):
            for b in range(a, self.dims):
                total -= (gap[..., a] * gap[..., b] * half) @ m[i]
                i += 1
        total += half @ m[i]
        near = 1 - self.radius[level][nodes] / r
        error += self.THIRD * ((1 / r**2) @ m[i + 1]) + self.FOURTH * ((1 / (r**3 * near)) @ m[i + 2])

    def scores(self, rows: slice, sums: np.ndarray, error: np.ndarray | float = 0.0) -> list[tuple[int, float, float]]:
        """(k, least, largest sum of the rows' silhouettes) for sums that are off by at most ``error``."""
        out, here, weights = [], np.arange(rows.stop - rows.start), self.weights[rows]
        low, high = np.maximum(sums - error, 0), sums + error
        for k, span in self.spans.items():
            own = self.own[k][rows]
            some = self.size[own] > 1
            ends = []
            for inner, outer in ((high, low), (low, high)):
                a = inner[here, own] / np.maximum(self.size[own] - 1, 1)
                means = outer / self.size
                means[here, own] = np.inf
                b = means[:, span].min(axis=1)
                score = np.where(some, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
                ends.append(float((score * weights).sum()))
            out.append((k, *ends))
        return out
