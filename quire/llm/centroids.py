"""Centroids of balanced lists, and an in-memory graph to search them."""

from __future__ import annotations

import numpy as np


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def balanced_centroids(sample: np.ndarray, lists: int, *, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means in which crowded clusters look farther away, round by round."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centers = sample[rng.choice(len(sample), lists, replace=False)].copy()
    handicap = np.zeros(lists)
    for _ in range(rounds):
        squares = distances(sample, centers) ** 2
        nearest = (squares + handicap).argmin(1)
        sizes = np.bincount(nearest, minlength=lists)
        scale = squares[np.arange(len(sample)), nearest].mean()
        handicap += 0.05 * scale * (sizes * lists / len(sample) - 1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        filled = sizes > 0
        centers[filled] = sums[filled] / sizes[filled, None]
        centers[~filled] = sample[rng.choice(len(sample), int((~filled).sum()))]
    return centers


class Graph:
    """Every centroid linked with its nearest others, both ways."""

    def __init__(self, centers: np.ndarray, degree: int = 12):
        self.centers = centers
        n = len(centers)
        degree = min(degree, n - 1)
        links: list[set[int]] = [set() for _ in range(n)]
        for start in range(0, n, 512):
            near = np.argsort(distances(centers[start : start + 512], centers), axis=1, kind="stable")
            for i, row in enumerate(near, start):
                others = [int(j) for j in row if j != i][:degree]
                links[i].update(others)
                for j in others:
                    links[j].add(i)
        for i in range(1, n):  # a ring keeps the graph in one part
            links[i].add(i - 1)
            links[i - 1].add(i)
        width = max(map(len, links), default=0)
        self.links = np.array([[*sorted(x), *[i] * (width - len(x))] for i, x in enumerate(links)], np.int32).reshape(n, width)
        middle = centers.mean(0, keepdims=True)
        self.entries = np.argsort(distances(middle, centers)[0], kind="stable")[: min(8, n)]

    def search(self, points: np.ndarray, ratio: float, beam: int = 16) -> np.ndarray:
        """Distances to the centroids met, inf elsewhere: a row for each point.

        Best-first from the entry points.  A centroid is expanded while it is
        among the ``beam`` nearest met or within ``ratio`` times the nearest
        distance, so all lists that the ratio selects are met as long as they
        are linked through each other.
        """
        n, k = len(points), len(self.centers)
        met = np.full((n, k), np.inf)
        met[:, self.entries] = distances(points, self.centers[self.entries])
        expanded = np.zeros((n, k), bool)
        beam = min(beam, k)
        while True:
            bar = np.maximum(np.partition(met, beam - 1, axis=1)[:, beam - 1], met.min(1) * ratio)
            rows, cols = np.nonzero((met <= bar[:, None]) & ~expanded & np.isfinite(met))
            if not len(rows):
                return met
            expanded[rows, cols] = True
            fresh = np.zeros((n, k), bool)
            fresh[np.repeat(rows, self.links.shape[1]), self.links[cols].ravel()] = True
            fresh &= np.isinf(met)
            rows, cols = np.nonzero(fresh)
            for a in range(0, len(rows), 1 << 16):
                r, c = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
                step = points[r] - self.centers[c]
                met[r, c] = np.sqrt((step * step).sum(1))
