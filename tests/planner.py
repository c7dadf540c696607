"""One route after another in plain Python: what the planning by set is held against."""

import heapq
import math

import numpy as np


class Zones:
    """Edges of rings as arrays, with clearance tests."""

    def __init__(self, rings: list[list[tuple[float, float]]], buffer: float):
        self.rings = [np.asarray(r, float) for r in rings]
        self.a = np.concatenate([r[:-1] for r in self.rings]) if rings else np.zeros((0, 2))
        self.b = np.concatenate([r[1:] for r in self.rings]) if rings else np.zeros((0, 2))
        self.buffer = buffer

    def inside(self, p) -> bool:
        """Whether a place is in a zone."""
        for r in self.rings:
            a, b = r[:-1], r[1:]
            up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
            dy = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
            if (up & (p[0] < (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / dy + a[:, 0])).sum() % 2:
                return True
        return False

    def _gap(self, p, a, b) -> np.ndarray:
        d = b - a
        n = np.maximum((d * d).sum(-1), 1e-300)
        t = np.clip(((p - a) * d).sum(-1) / n, 0, 1)
        return np.hypot(*np.moveaxis(p - (a + t[..., None] * d), -1, 0))

    def near(self, p) -> bool:
        """Whether a place is in a buffered zone."""
        p = np.asarray(p, float)
        return bool(len(self.a)) and (bool((self._gap(p, self.a, self.b) < self.buffer).any()) or self.inside(p))

    def clear(self, p, q) -> bool:
        """Whether a leg keeps the buffer from all zones."""
        if not len(self.a):
            return True
        p, q = np.asarray(p, float), np.asarray(q, float)
        cross = lambda o, u, v: (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])
        meet = (cross(self.a, self.b, p) * cross(self.a, self.b, q) < 0) & (cross(p, q, self.a) * cross(p, q, self.b) < 0)
        if meet.any() or self.inside(p):
            return False
        gap = np.minimum.reduce([self._gap(p, self.a, self.b), self._gap(q, self.a, self.b), self._gap(self.a, p, q), self._gap(self.b, p, q)])
        return bool((gap >= self.buffer - 1e-12).all())

    def nodes(self) -> list[tuple[float, float]]:
        """Vertices and edge midpoints of the rings, pushed out from each ring's middle to 1.5 buffers of clearance."""
        out = []
        for r in self.rings:
            v = r[:-1]
            mid = v.mean(0)
            for p in [*v, *((v + np.roll(v, -1, 0)) / 2)]:
                d = p - mid
                n = math.hypot(*d) or 1.0
                for k in range(1, 8):
                    q = p + d / n * (1.5 * self.buffer * k / 2)
                    if not self.near(q):
                        out.append(tuple(q))
                        break
        return out


def snap(p, zones: Zones, step: float = 0.005):
    """p, or the first of 19 rings of 8 places around it that is outside all buffered zones."""
    if not zones.near(p):
        return p
    for m in range(1, 20):
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)):
            q = (p[0] + dx * step * m, p[1] + dy * step * m)
            if not zones.near(q):
                return q
    return p


def shortest(start, end, zones: Zones):
    """Shortest way over the visibility graph, or None: A* that tests a leg only when it would be taken."""
    nodes = [start, end, *zones.nodes()]
    xy = np.asarray(nodes, float)
    left = np.hypot(*(xy - xy[1]).T)
    back, heap = {}, [(float(left[0]), 0.0, 0, -1)]
    while heap:
        _, d, u, via = heapq.heappop(heap)
        if u in back or (via >= 0 and not zones.clear(xy[via], xy[u])):
            continue
        back[u] = via
        if u == 1:
            path = [1]
            while path[-1]:
                path.append(back[path[-1]])
            return [nodes[i] for i in reversed(path)]
        far = d + np.hypot(*(xy - xy[u]).T)
        for v in range(1, len(nodes)):
            if v not in back:
                heapq.heappush(heap, (float(far[v] + left[v]), float(far[v]), v, u))
    return None


def around_box(start, end, zones: Zones, pad: float = 0.1):
    """First clear way over one side, then over two corners, of all zones' box; or None."""
    (x0, y0), (x1, y1) = zones.a.min(0), zones.a.max(0)
    mx, my = (start[0] + end[0]) / 2, (start[1] + end[1]) / 2
    w, e, s, n = x0 - pad, x1 + pad, y0 - pad, y1 + pad
    corners = [(w, n), (e, n), (w, s), (e, s)]
    ways = [[p] for p in ((mx, n), (mx, s), (e, my), (w, my))] + [[corners[i], corners[j]] for i in range(4) for j in range(i + 1, 4)]
    for way in ways:
        path = [start, *way, end]
        if all(zones.clear(a, b) for a, b in zip(path, path[1:])):
            return path
    return None


def plan(start, end, rings, kind: str, buffer: float) -> tuple[list[tuple[float, float]], bool]:
    """Waypoints, and whether they are clear; irregular routes ignore zones."""
    if kind == "irregular" or not rings:
        return [start, end], True
    zones = Zones(rings, buffer)
    start, end = snap(start, zones), snap(end, zones)
    if zones.clear(start, end):
        return [start, end], True
    for way in (shortest, around_box):
        path = way(start, end, zones)
        if path and all(zones.clear(a, b) for a, b in zip(path, path[1:])):
            return path, True
    return [start, end], False
