"""Clustering kernels for one group of points, in NumPy."""

from __future__ import annotations

import math

import numpy as np

from roamer.operators.segment import thompson


def spherical(lon1, lat1, lon2, lat2, radius: float = 6371000.0):
    dlon, dlat, mid = np.radians(lon1 - lon2) / 2, np.radians(lat1 - lat2) / 2, np.radians(lat1 + lat2) / 2
    return 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt((np.sin(dlat) * np.cos(dlon)) ** 2 + (np.sin(dlon) * np.cos(mid)) ** 2)))


def linked_within(lon: np.ndarray, lat: np.ndarray, metres: float) -> np.ndarray:
    """The first index of each point's single-linkage cluster cut at ``metres``: a search that leaves reached points behind."""
    root = np.full(len(lon), -1)
    for i in range(len(lon)):
        if root[i] >= 0:
            continue
        root[i] = i
        queue = [i]
        while queue:
            x = queue.pop()
            left = np.flatnonzero(root < 0)
            if not len(left):
                break
            near = left[spherical(lon[x], lat[x], lon[left], lat[left]) <= metres]
            root[near] = i
            queue += near.tolist()
    return root


def linkage_heights(d: np.ndarray) -> np.ndarray:
    """Heights of single linkage: the sorted edges of a minimum spanning tree (Prim) of a distance matrix."""
    n = len(d)
    best, done, out = d[0].copy(), np.zeros(n, bool), []
    done[0] = True
    for _ in range(n - 1):
        i = int(np.argmin(np.where(done, np.inf, best)))
        out.append(best[i])
        done[i] = True
        best = np.minimum(best, d[i])
    return np.sort(np.array(out))


def cut_distance(heights: np.ndarray, least: float, min_diffs: int = 3) -> float:
    """The height before the first jump that is an outlier among those before it; ``least`` at least."""
    steps = np.abs(np.diff(heights))
    for i in range(min_diffs + 1, len(steps) + 1):
        if heights[i] >= least and thompson(steps[: i - 1], steps[i - 1]):
            return max(least, float(heights[i - 1]))
    return least if not len(heights) else max(least, float(heights[-1])) if heights[-1] < least else least


def seeded(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds."""
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = d.sum()
        if total > 0:  # what rng.choice(len(x), p=d / total) draws, without its checks
            share = (d / total).cumsum()
            chosen.append(int((share / share[-1]).searchsorted(rng.random(), side="right")))
        else:
            chosen.append(int(rng.integers(len(x))))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: np.ndarray | None = None, runs: int = 10, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(centres, labels, inertia) of the best of ``runs`` runs, or of the run from given centres."""
    best = None
    if k == 1 and starts is None:  # all runs end at the mean
        for _ in range(runs):
            rng.integers(len(x))  # the seeds that they draw
        starts = x.mean(axis=0)[None, :]
    tol = 1e-4 * float(x.var(axis=0).mean())
    for _ in range(1 if starts is not None else runs):
        c = starts.copy() if starts is not None else seeded(x, k, rng)
        for _ in range(rounds):
            label = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
            size = np.bincount(label, minlength=len(c))
            new = np.column_stack([np.bincount(label, column, len(c)) for column in x.T]) / np.maximum(size, 1)[:, None]
            new[size == 0] = c[size == 0]
            moved = float(((new - c) ** 2).sum())
            c = new
            if moved <= tol:
                break
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        label, inertia = d.argmin(axis=1), float(d.min(axis=1).sum())
        if best is None or inertia < best[2]:
            best = (c, label, inertia)
    return best


def bic(x: np.ndarray, label: np.ndarray, centres: np.ndarray) -> float:
    """Bayesian information criterion of spherical clusters of one variance."""
    n, d, k = len(x), x.shape[1], len(centres)
    if n <= k:
        return -math.inf
    var = max(float(((x - centres[label]) ** 2).sum()) / (d * (n - k)), 1e-12)
    sizes = np.bincount(label, minlength=k)
    sizes = sizes[sizes > 0]
    like = float((sizes * np.log(sizes)).sum()) - n * math.log(n) - n * d / 2 * math.log(2 * math.pi * var) - d * (n - k) / 2
    return like - k * (d + 1) / 2 * math.log(n)


def xmeans(x: np.ndarray, kmin: int, kmax: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centres, labels): centres are split in two as long as that improves the criterion of their own points."""
    kmin, kmax = max(1, min(kmin, len(x))), max(1, min(kmax, len(x)))
    centres, label, _ = kmeans(x, kmin, rng)
    while len(centres) < kmax:
        out = []
        for j in range(len(centres)):
            own = x[label == j]
            if len(own) > 2 and len(centres) + len(out) - j < kmax:
                two, lab, _ = kmeans(own, 2, rng, runs=3)
                if bic(own, lab, two) > bic(own, np.zeros(len(own), int), centres[j : j + 1]):
                    out += list(two)
                    continue
            out.append(centres[j])
        if len(out) == len(centres):
            break
        centres, label, _ = kmeans(x, len(out), rng, starts=np.array(out))
    return centres, label


def medoid(x: np.ndarray) -> int:
    """The index of the point with the least total distance to the others; the first on ties."""
    return int(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)).sum(axis=1).round(6).argmin())


def tosca(x: np.ndarray, least: float, rng: np.random.Generator, kmin: int = 1, kmax: int | None = None) -> list[int]:
    """Indices of the medoids: X-means of kmin to kmax (None: any number of) clusters, medoids, single linkage of those, a cut at the first outlying jump, medoids."""
    if len(x) == 1:
        return [0]
    kinds = len(np.unique(x.round(3), axis=0))
    _, label = xmeans(x, min(kmin, kinds), kinds if kmax is None else min(kmax, kinds), rng)
    first = [int(np.flatnonzero(label == j)[medoid(x[label == j])]) for j in np.unique(label)]
    if len(first) == 1:
        return first
    m = x[first]
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))
    cut = cut_distance(linkage_heights(d), least)
    group = np.arange(len(m))
    for i in range(len(m)):
        for j in range(i):
            if d[i, j] <= cut:
                group[group == group[i]] = group[j]
    owner = group[((x[:, None, :] - m[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)]
    return [int(np.flatnonzero(owner == g)[medoid(x[owner == g])]) for g in np.unique(owner)]


def bisecting(x: np.ndarray, eps: float, rng: np.random.Generator) -> np.ndarray:
    """Labels of clusters split in two until every point is within ``eps`` of its centre."""
    label, todo, n = np.zeros(len(x), int), [0], 1
    while todo:
        j = todo.pop()
        own = np.flatnonzero(label == j)
        if len(own) < 2 or np.sqrt(((x[own] - x[own].mean(axis=0)) ** 2).sum(axis=1)).max() <= eps:
            continue
        half = kmeans(x[own], 2, rng, runs=3)[1]
        if half.min() == half.max():
            continue
        label[own[half == 1]] = n
        todo += [j, n]
        n += 1
    return label


def ward(x: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of Ward linkage over few points; new clusters are numbered from len(x) on."""
    w = {i: float(1 if weights is None else weights[i]) for i in range(len(x))}
    c = {i: np.asarray(x[i], float) for i in range(len(x))}
    out, n = [], len(x)
    while len(c) > 1:
        keys = sorted(c)
        h, a, b = min((math.sqrt(2 * w[p] * w[q] / (w[p] + w[q])) * float(np.linalg.norm(c[p] - c[q])), p, q) for i, p in enumerate(keys) for q in keys[i + 1 :])
        c[n], w[n] = (w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b]), w[a] + w[b]
        for k in (a, b):
            del c[k], w[k]
        out.append((a, b, h))
        n += 1
    return out
