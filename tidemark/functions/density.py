"""Density clusters by hierarchy (HDBSCAN) in NumPy: mutual reachability, minimum spanning tree, condensed tree, excess of mass.

A fit holds the points and one row of distances at a time; time grows with the square of the points.
"""

from __future__ import annotations

import numpy as np


def _rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2), 0.0))


def core_distances(x: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """Distance of each point to its k-th neighbour, itself not counted."""
    k = min(k, len(x) - 1)
    return np.concatenate([np.partition(_rows(x[at : at + chunk], x), k, axis=1)[:, k] for at in range(0, len(x), chunk)]) if len(x) else np.zeros(0)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """(n - 1, 3): ends and length of the edges of a minimum spanning tree of mutual reachability, shortest first."""
    n = len(x)
    left, best, link = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = np.zeros((max(n - 1, 0), 3)), 0
    left[0] = False
    for e in range(n - 1):
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core), core[at])
        nearer = left & (d < best)
        best[nearer], link[nearer] = d[nearer], at
        nxt = int(np.where(left, best, np.inf).argmin())
        edges[e] = link[nxt], nxt, best[nxt]
        left[nxt], at = False, nxt
    return edges[np.argsort(edges[:, 2], kind="stable")]


class DensityClusters:
    """labels (-1: noise) and strengths of the fitted points, and of others by predict."""

    def __init__(self, x: np.ndarray, least: int):
        self.x, self.k = np.asarray(x, float), least
        self.core = core_distances(self.x, least)
        n = len(self.x)
        children, distance, size = self._merge(spanning_tree(self.x, self.core), n)
        self._condense(children, distance, size, n, least)
        self.labels, self.strengths = self._own(n)

    @staticmethod
    def _merge(edges: np.ndarray, n: int):
        """Binary tree of merges: two children, distance and size of node n + i."""
        root, name = np.arange(n), np.arange(n)
        size = np.ones(2 * n - 1 if n else 0, int)
        children = np.zeros((max(n - 1, 0), 2), int)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for m, (a, b, _) in enumerate(edges):
            i, j = find(int(a)), find(int(b))
            children[m] = name[i], name[j]
            size[n + m] = size[name[i]] + size[name[j]]
            root[j], name[i] = i, n + m
        return children, edges[:, 2], size

    def _condense(self, children, distance, size, n: int, least: int) -> None:
        """Clusters in order of their split: parent, density at birth (1 / distance), stability; points' cluster and density."""
        self.parent, self.birth, self.kids = [-1], [0.0], [[]]
        self.point_cluster, self.point_density = np.zeros(n, int), np.zeros(n)
        stability = [0.0]
        stack = [(2 * n - 2, 0)] if n > 1 else []

        def points(node: int) -> list[int]:
            out, rest = [], [node]
            while rest:
                v = rest.pop()
                if v < n:
                    out.append(v)
                else:
                    rest += children[v - n].tolist()
            return out

        while stack:
            node, cluster = stack.pop()
            if node < n:
                continue
            density = 1.0 / distance[node - n] if distance[node - n] > 0 else np.inf
            gained = min(density, 1e300) - self.birth[cluster]
            big = [c for c in children[node - n].tolist() if size[c] >= least]
            for c in children[node - n].tolist():
                if len(big) == 2:
                    self.parent.append(cluster)
                    self.birth.append(min(density, 1e300))
                    self.kids.append([])
                    stability.append(0.0)
                    self.kids[cluster].append(len(self.parent) - 1)
                    stability[cluster] += size[c] * gained
                    stack.append((c, len(self.parent) - 1))
                elif c in big:
                    stack.append((c, cluster))
                else:  # these points fall out of the cluster here
                    some = points(c)
                    self.point_cluster[some], self.point_density[some] = cluster, min(density, 1e300)
                    stability[cluster] += len(some) * gained
        # excess of mass, children first; the root is no cluster
        chosen, worth = np.zeros(len(self.parent), bool), list(stability)
        for c in range(len(self.parent) - 1, 0, -1):
            below = sum(worth[k] for k in self.kids[c])
            if self.kids[c] and below > stability[c]:
                worth[c] = below
            else:
                chosen[c] = True
        self.selected = np.full(len(self.parent), -1)
        number = 0
        for c in range(1, len(self.parent)):
            up = self.selected[self.parent[c]] if self.parent[c] > 0 else -1
            if up >= 0:
                self.selected[c] = up
            elif chosen[c]:
                self.selected[c], number = number, number + 1
        self.count = number
        of = self.selected[self.point_cluster] if len(self.point_cluster) else np.zeros(0, int)
        self.peak = np.array([self.point_density[of == c].max(initial=0.0) for c in range(number)])

    def _own(self, n: int):
        label = self.selected[self.point_cluster] if n > 1 else np.full(n, -1)
        return label, self._strength(label, self.point_density)

    def _strength(self, label: np.ndarray, density: np.ndarray) -> np.ndarray:
        out = np.zeros(len(label))
        some = label >= 0
        peak = self.peak[label[some]] if self.count else np.zeros(int(some.sum()))
        out[some] = np.where(peak > 0, np.minimum(density[some], peak) / np.where(peak > 0, peak, 1.0), 1.0)
        return out

    def predict(self, x: np.ndarray, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Labels and strengths of other points: each joins its nearest fitted point by mutual reachability, in the cluster
        that this point was in at that density."""
        labels, densities = [], []
        for at in range(0, len(x), chunk):
            d = _rows(np.asarray(x[at : at + chunk], float), self.x)
            own = np.partition(d, min(self.k, len(self.x)) - 1, axis=1)[:, min(self.k, len(self.x)) - 1]
            reach = np.maximum(np.maximum(d, self.core[None, :]), own[:, None])
            near = reach.argmin(axis=1)
            r = reach[np.arange(len(d)), near]
            density = np.where(r > 0, 1.0 / np.where(r > 0, r, 1.0), 1e300)
            for p, lam in zip(near, density, strict=True):
                c = int(self.point_cluster[p])
                while c > 0 and self.birth[c] >= lam:
                    c = self.parent[c]
                labels.append(self.selected[c])
                densities.append(lam)
        label, density = np.array(labels, int), np.array(densities)
        return label, self._strength(label, density)
