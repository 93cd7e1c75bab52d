"""Estimators that pyspark.ml lacks: fitted in numpy on a bounded sample, applied to all rows.

Each class has fit(x, y) and predict(x); y is ignored by the anomaly models. Series
models see only the last values of the target, in time order, and forecast by step.
"""

from __future__ import annotations

import numpy as np

TREES, SAMPLE = 100, 256


class IsolationForest:
    """How easily random cuts isolate a row, scaled to 0 to 1 over the sample."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit(self, x: np.ndarray, y: np.ndarray | None = None) -> IsolationForest:
        self.raw = isolation_scores(x, TREES, SAMPLE, self.seed)
        found = self.raw(x)
        self.low, self.width = float(found.min()), float(np.ptp(found)) or 1.0
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.raw(x) - self.low) / self.width, 0, 1)


def isolation_scores(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 0):
    """A scorer of how easily rows are isolated by random cuts, 0 to 1; fitted on samples of 256 rows."""
    draw = np.random.default_rng(seed)
    deepest = int(np.ceil(np.log2(max(2, min(sample, len(x))))))
    usual = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(rows: np.ndarray, depth: int):
        varied = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if depth >= deepest or len(rows) <= 1 or not len(varied):
            return depth + usual(len(rows))
        c = int(draw.choice(varied))
        cut = draw.uniform(rows[:, c].min(), rows[:, c].max())
        return c, cut, grow(rows[rows[:, c] < cut], depth + 1), grow(rows[rows[:, c] >= cut], depth + 1)

    forest = [grow(x[draw.choice(len(x), min(sample, len(x)), replace=False)], 0) for _ in range(trees)]

    def depth(tree, rows: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(rows), tree, float)
        c, cut, low, high = tree
        left = rows[:, c] < cut
        out = np.empty(len(rows))
        out[left], out[~left] = depth(low, rows[left]), depth(high, rows[~left])
        return out

    return lambda rows: 2 ** (-np.mean([depth(t, rows) for t in forest], axis=0) / max(1e-9, usual(min(sample, len(x)))))


class Scaled:
    """Columns of mean 0 and deviation 1 over the sample."""

    def learn(self, x: np.ndarray) -> np.ndarray:
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        return self.apply(x)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale


class LocalOutlierFactor(Scaled):
    """Mean density of a row's neighbours in the sample over its own, less 1."""

    def __init__(self, neighbours: int = 20):
        self.k = neighbours

    def fit(self, x: np.ndarray, y: np.ndarray | None = None) -> LocalOutlierFactor:
        self.points = self.learn(x)
        self.k = max(1, min(self.k, len(x) - 1))
        place, gap = self._near(self.points, self.k + 1)
        place, gap = place[:, 1:], gap[:, 1:]  # without the row itself
        self.reach = gap[:, -1]
        self.density = self._density(place, gap)
        return self

    def _near(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        places, gaps = [], []
        for start in range(0, len(x), 512):
            part = x[start : start + 512]
            d = np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * part @ self.points.T))
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            places.append(order)
            gaps.append(np.take_along_axis(d, order, 1))
        return np.concatenate(places), np.concatenate(gaps)

    def _density(self, place: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return 1 / np.maximum(1e-10, np.maximum(gap, self.reach[place]).mean(axis=1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        place, gap = self._near(self.apply(x), self.k)
        return self.density[place].mean(axis=1) / self._density(place, gap) - 1


class OneClassSvm(Scaled):
    """Distance outside the region that holds all but a share nu of the sample, in a Gaussian kernel; by conditional gradients on the dual."""

    def __init__(self, nu: float = 0.1, rounds: int = 400, most: int = 1500):
        self.nu, self.rounds, self.most = nu, rounds, most

    def fit(self, x: np.ndarray, y: np.ndarray | None = None) -> OneClassSvm:
        self.points = self.learn(x)[: self.most]
        self.gamma = 1 / max(1, x.shape[1])
        kernel = self._kernel(self.points)
        n = len(self.points)
        cap = 1 / max(1.0, self.nu * n)
        weight = np.full(n, 1 / n)
        for step in range(self.rounds):
            # The vertex of the feasible set that lies lowest along the gradient.
            order = np.argsort(kernel @ weight, kind="stable")
            vertex = np.zeros(n)
            whole = min(n, int(1 / cap))
            vertex[order[:whole]] = cap
            if whole < n:
                vertex[order[whole]] = 1 - cap * whole
            weight += 2 / (step + 2) * (vertex - weight)
        self.weight = weight
        self.edge = float(np.quantile(kernel @ weight, self.nu))
        return self

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        d = (x**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * x @ self.points.T
        return np.exp(-self.gamma * np.maximum(0, d))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.edge - self._kernel(self.apply(x)) @ self.weight


class Reconstruction(Scaled):
    """What the first principal components leave of a row: the error of a linear autoencoder."""

    def __init__(self, width: int = 8):
        self.width = width

    def fit(self, x: np.ndarray, y: np.ndarray | None = None) -> Reconstruction:
        z = self.learn(x)
        _, vectors = np.linalg.eigh(z.T @ z)
        self.axes = vectors[:, ::-1][:, : max(1, min(self.width, x.shape[1] // 2 or 1))]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.apply(x)
        return ((z - z @ self.axes @ self.axes.T) ** 2).mean(axis=1)


def cox_ph(times: np.ndarray, x: np.ndarray, ridge: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Proportional-hazards coefficients by Newton steps, all events observed, ties by Breslow; for samples that fit in memory."""
    order = np.argsort(-times, kind="stable")
    x, times = x[order], times[order]
    beta = np.zeros(x.shape[1])
    last = np.searchsorted(-times, -times, side="right") - 1
    for _ in range(rounds):
        w = np.exp(np.clip(x @ beta, -50, 50))
        s0, s1 = np.cumsum(w)[last], np.cumsum(w[:, None] * x, axis=0)[last]
        s2 = np.cumsum(w[:, None, None] * x[:, :, None] * x[:, None, :], axis=0)[last]
        mean = s1 / s0[:, None]
        gradient = (x - mean).sum(axis=0) - ridge * beta
        hessian = (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :]).sum(axis=0) + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class CoxPh(Scaled):
    """The linear predictor of a proportional-hazards model: higher for earlier events."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> CoxPh:
        self.beta = cox_ph(y, self.learn(x))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.apply(x) @ self.beta


def focal_gradient(y: np.ndarray, margin: np.ndarray, gamma: float = 2.0, alpha: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the focal loss by the margin.

    With t the probability of the true class and s its sign, the loss is
    -a (1 - t)^g ln t, whose slope by the margin is s a (1 - t)^g (g t ln t - (1 - t));
    the second derivative is taken by central differences and kept positive.
    """
    sign, weight = np.where(y > 0, 1.0, -1.0), np.where(y > 0, alpha, 1 - alpha)

    def slope(m: np.ndarray) -> np.ndarray:
        t = np.clip(1 / (1 + np.exp(-np.clip(sign * m, -40, 40))), 1e-9, 1 - 1e-9)
        return sign * weight * (1 - t) ** gamma * (gamma * t * np.log(t) - (1 - t))

    step = 1e-4
    return slope(margin), np.maximum(1e-6, (slope(margin + step) - slope(margin - step)) / (2 * step))


class Tree:
    """A regression tree of second-order gains over quantile bins."""

    def __init__(self, depth: int = 3, bins: int = 32, ridge: float = 1.0):
        self.depth, self.bins, self.ridge = depth, bins, ridge

    def fit(self, x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> Tree:
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, c], steps)) for c in range(x.shape[1])]
        coded = np.column_stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(self.edges)])
        self.root = self._grow(coded, np.arange(len(x)), gradient, hessian, 0)
        return self

    def _grow(self, coded: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = -g[rows].sum() / (h[rows].sum() + self.ridge)
        best = (1e-9, None)
        for c, edges in enumerate(self.edges) if depth < self.depth and len(rows) > 1 else ():
            gs, hs = (np.cumsum(np.bincount(coded[rows, c], w[rows], len(edges) + 1))[:-1] for w in (g, h))
            all_g, all_h = g[rows].sum(), h[rows].sum()
            gain = gs**2 / (hs + self.ridge) + (all_g - gs) ** 2 / (all_h - hs + self.ridge) - all_g**2 / (all_h + self.ridge)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (c, int(gain.argmax())))
        if best[1] is None:
            return value
        c, cut = best[1]
        low = coded[rows, c] <= cut
        return c, self.edges[c][cut], self._grow(coded, rows[low], g, h, depth + 1), self._grow(coded, rows[~low], g, h, depth + 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))

        def walk(node, rows: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[rows] = node
                return
            c, cut, low, high = node
            below = x[rows, c] <= cut
            walk(low, rows[below])
            walk(high, rows[~below])

        walk(self.root, np.arange(len(x)))
        return out


class FocalBoosting:
    """Boosted trees on the focal loss; gives probabilities."""

    def __init__(self, rounds: int = 60, rate: float = 0.2, gamma: float = 2.0, alpha: float = 0.25):
        self.rounds, self.rate, self.gamma, self.alpha = rounds, rate, gamma, alpha

    def fit(self, x: np.ndarray, y: np.ndarray) -> FocalBoosting:
        self.trees, margin = [], np.zeros(len(x))
        for _ in range(self.rounds):
            tree = Tree().fit(x, *focal_gradient(y, margin, self.gamma, self.alpha))
            margin += self.rate * tree.predict(x)
            self.trees.append(tree)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


class MlpRegressor(Scaled):
    """Two layers, fitted by Adam on squares of the scaled target."""

    def __init__(self, hidden: int = 32, epochs: int = 200, seed: int = 0):
        self.hidden, self.epochs, self.seed = hidden, epochs, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> MlpRegressor:
        z, draw = self.learn(x), np.random.default_rng(self.seed)
        self.middle, self.spread = float(y.mean()), float(y.std()) or 1.0
        t, d = (y - self.middle) / self.spread, x.shape[1]
        layers = [draw.normal(0, np.sqrt(2 / max(1, d)), (d, self.hidden)), np.zeros(self.hidden), draw.normal(0, np.sqrt(1 / self.hidden), self.hidden), np.zeros(())]
        first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
        for _ in range(self.epochs):
            for at in np.array_split(draw.permutation(len(z)), max(1, len(z) // 256)):
                step += 1
                before = z[at] @ layers[0] + layers[1]
                held = np.maximum(before, 0)
                error = (held @ layers[2] + layers[3] - t[at]) / len(at)
                back = np.outer(error, layers[2]) * (before > 0)
                for i, g in enumerate((z[at].T @ back, back.sum(axis=0), held.T @ error, error.sum())):
                    first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g**2
                    layers[i] = layers[i] - 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = layers
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return self.middle + self.spread * (np.maximum(self.apply(x) @ w1 + b1, 0) @ w2 + b2)


def _smoothed(y: np.ndarray) -> float:
    """Level of simple exponential smoothing, the rate chosen by the one-step errors."""
    best = (np.inf, float(y[-1]) if len(y) else 0.0)
    for rate in np.linspace(0.05, 0.95, 19):
        level, error = float(y[0]) if len(y) else 0.0, 0.0
        for v in y[1:]:
            error += (v - level) ** 2
            level += rate * (v - level)
        best = min(best, (error, level))
    return best[1]


def naive_seasonal(y: np.ndarray, period: int = 7) -> tuple[list[float], float]:
    """The last period's values in turn. Forecasts are (pattern, slope): step i from 0 gives pattern[i mod its length] + slope * i."""
    return y[-period:].tolist() or [0.0], 0.0


def ets(y: np.ndarray) -> tuple[list[float], float]:
    """A flat forecast at the smoothed level."""
    return [_smoothed(y)], 0.0


def theta(y: np.ndarray) -> tuple[list[float], float]:
    """The smoothed level with half the slope of the trend line."""
    if len(y) < 3:
        return ets(y)
    slope = float(np.polyfit(np.arange(len(y)), y, 1)[0]) / 2
    return [_smoothed(y) + slope], slope
