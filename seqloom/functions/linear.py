"""Small dense algebra for matrices that an aggregation has already made small: at most contexts x symbols."""

from __future__ import annotations

import math

import numpy as np


def dense(rows: list, row: str, col: str, value: str) -> tuple[np.ndarray, list[str], list[str]]:
    """Long rows as a matrix, with the sorted row and column names."""
    r, c = (sorted({x[k] for x in rows}) for k in (row, col))
    ri, ci = ({n: i for i, n in enumerate(names)} for names in (r, c))
    out = np.zeros((len(r), len(c)))
    for x in rows:
        out[ri[x[row]], ci[x[col]]] += x[value]
    return out, r, c


def spectrum(graph: np.ndarray, kind: str = "walk") -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and unit eigenvectors; the largest entry of each vector is positive.

    walk: of the random-walk Laplacian, from its symmetric form, nodes without weight being isolated; plain: of the Laplacian;
    modularity: of minus the modularity matrix, so that the best cut comes first."""
    graph = (graph + graph.T) / 2
    degree = graph.sum(axis=1)
    if kind != "walk":
        total = degree.sum() or 1.0
        values, vectors = np.linalg.eigh(np.diag(degree) - graph if kind == "plain" else np.outer(degree, degree) / (2 * total) - graph)
        top = np.abs(vectors).argmax(axis=0)
        return values, vectors * np.sign(vectors[top, np.arange(len(graph))])
    half = np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 0)
    values, vectors = np.linalg.eigh(np.diag((degree > 0).astype(float)) - half[:, None] * graph * half)
    vectors = np.where(degree > 0, half, 1)[:, None] * vectors
    vectors /= np.linalg.norm(vectors, axis=0)
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def eigengap(values: np.ndarray, least: int) -> int:
    """Number of embeddings before the widest gap, looked for from `least` on."""
    gaps = np.diff(values[1:])
    least = min(least, max(len(gaps) - 1, 0))
    return int(gaps[least:].argmax()) + least + 1 if len(gaps) else 1


def natural_breaks(values: np.ndarray, most: int) -> list[list[float]]:
    """For 1 to `most` classes the breaks of least squared deviation: the lowest value and each class's highest one.

    One table of layers gives all of them. Within a layer the last class starts no earlier the more values there are, so the starts of
    the middles of all open ranges are found first and bound those of the halves: O(most n log n).
    """
    x = np.sort(np.asarray(values, float))
    n, most = len(x), min(most, len(values))
    x0 = x - x.mean()  # sums of squares of values near 0 lose fewer digits
    one, two = np.concatenate(([0], np.cumsum(x0))), np.concatenate(([0], np.cumsum(x0 * x0)))
    cost = lambda a, b: two[b] - two[a] - (one[b] - one[a]) ** 2 / (b - a)
    ends = np.arange(1, n + 1)
    best = np.concatenate(([np.inf], cost(np.zeros(n, np.int64), ends)))
    starts = [np.zeros(n + 1, np.int64)]
    for c in range(2, most + 1):
        now, cut = np.full(n + 1, np.inf), np.full(n + 1, c - 1)
        lo, hi = np.array([c]), np.array([n])  # ranges of ends
        left, right = np.array([c - 1]), np.array([n - 1])  # where the last class may start
        while len(lo):
            middle = (lo + hi) // 2
            upto = np.minimum(right, middle - 1)
            sizes = upto - left + 1
            first = np.cumsum(sizes) - sizes
            a = np.repeat(left - first, sizes) + np.arange(int(sizes.sum()))
            total = best[a] + cost(a, np.repeat(middle, sizes))
            least = np.minimum.reduceat(total, first)
            place = np.flatnonzero(total == np.repeat(least, sizes))
            at = a[place[np.searchsorted(place, first)]]
            now[middle], cut[middle] = least, at
            lo, hi, left, right = np.concatenate((lo, middle + 1)), np.concatenate((middle - 1, hi)), np.concatenate((left, at)), np.concatenate((at, right))
            open_ = lo <= hi
            lo, hi, left, right = lo[open_], hi[open_], left[open_], right[open_]
        best = now
        starts.append(cut)
    out = []
    for c in range(1, most + 1):
        found, b = [], n
        for layer in range(c - 1, -1, -1):
            found.append(float(x[b - 1]))
            b = int(starts[layer][b])
        out.append([float(x[0]), *found[::-1]])
    return out


def jenks(values: np.ndarray, k: int) -> list[float]:
    """Breaks of the k classes of least squared deviation."""
    return natural_breaks(values, k)[-1]


def mixture_labels(values: np.ndarray, most: int, turns: int = 500, floor: float = 1e-6) -> np.ndarray:
    """Parts of one vector by the normal mixture of least BIC with 2 to `most` components, fitted over distinct values with counts; parts are numbered by their means."""
    x, at, n = np.unique(np.asarray(values, float), return_inverse=True, return_counts=True)
    best = (math.inf, np.zeros(len(x), int))
    for k in range(2, min(most, len(values)) + 1):
        mean = np.quantile(np.repeat(x, n), (np.arange(k) + 0.5) / k)
        spread, share, before = np.full(k, max(float(np.var(np.repeat(x, n))), floor)), np.full(k, 1 / k), -math.inf
        for _ in range(turns):
            logs = np.log(share) - 0.5 * np.log(2 * math.pi * spread) - (x[:, None] - mean) ** 2 / (2 * spread)
            top = logs.max(axis=1, keepdims=True)
            each = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
            post = np.exp(logs - each[:, None]) * n[:, None]
            weight = post.sum(axis=0) + 1e-12
            mean, share = post.T @ x / weight, weight / weight.sum()
            spread = np.einsum("ik,ik->k", post, (x[:, None] - mean) ** 2) / weight + floor
            if (fit := float(each @ n)) - before <= 1e-9 * abs(fit):
                break
            before = fit
        label = np.argsort(np.argsort(mean))[logs.argmax(axis=1)]
        best = min(best, ((3 * k - 1) * math.log(n.sum()) - 2 * fit, label), key=lambda b: b[0])
    return best[1][at]


def classify(values: np.ndarray, breaks: list[float]) -> np.ndarray:
    """Class of each value: (low, high] intervals, the lowest value in class 0."""
    return np.maximum(np.searchsorted(breaks[1:], values), 0).clip(0, len(breaks) - 2)


def variance_fit(values: np.ndarray, breaks: list[float], skip_first: bool = False) -> float:
    """Goodness of variance fit; skip_first leaves the lowest class out of the classes' deviations."""
    values = np.asarray(values, float)
    label = classify(values, breaks)
    total = ((values - values.mean()) ** 2).sum()
    inner = sum(((values[label == c] - values[label == c].mean()) ** 2).sum() for c in np.unique(label) if not (skip_first and c == 0))
    return float((total - inner) / total) if total else 1.0


def knee(xs: list[float], ys: list[float], sensitivity: float = 1.0) -> float | None:
    """Knee of a concave rising curve by the Kneedle rule; None without one.

    The curve is scaled to the unit square. A highest point of its height over the diagonal is a knee once the height falls `sensitivity` mean
    steps below it, before the next highest point; behind a lowest point it has to fall below 0.
    """
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    if len(x) < 3 or x[-1] == x[0] or y.max() == y.min():
        return None
    height = (y - y.min()) / (y.max() - y.min()) - (x - x[0]) / (x[-1] - x[0])
    step = 1 / (len(x) - 1)
    limit, at = 0.0, None
    for i in range(len(x) - 1):
        before, after = height[max(i - 1, 0)], height[i + 1]
        if height[i] >= before and height[i] >= after:
            limit, at = height[i] - sensitivity * step, i
        if height[i] <= before and height[i] <= after:
            limit = 0.0
        if at is not None and after < limit:
            return float(x[at])
    return None


def spherical_bic(sizes: np.ndarray, squares: float, dims: int) -> float:
    """BIC of a k-means fit (larger is better) from the cluster sizes and the summed squared distances to the centres."""
    sizes = np.asarray(sizes, float)
    sizes = sizes[sizes > 0]
    n, k = sizes.sum(), len(sizes)
    if n <= k:
        return -math.inf
    variance = max(squares / ((n - k) * dims), 1e-300)
    fit = sizes * np.log(sizes) - sizes * math.log(n) - sizes * dims / 2 * math.log(2 * math.pi * variance) - (sizes - 1) * dims / 2
    return float(fit.sum() - 0.5 * k * math.log(n) * (dims + 1))


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def two_sided_student(t: float, df: int) -> float:
    """Both tails of Student's t from the finite sums for whole degrees of freedom."""
    if df < 1:
        return math.nan
    angle = math.atan2(abs(t), math.sqrt(df))
    cosine = math.cos(angle) ** 2
    term, total = (math.cos(angle) if df % 2 else 1.0), 0.0
    for k in range(df % 2 + 1, df, 2):
        total += term
        term *= cosine * k / (k + 1)
    inner = math.sin(angle) * total
    return max(0.0, 1 - (2 / math.pi * (angle + inner) if df % 2 else inner))
