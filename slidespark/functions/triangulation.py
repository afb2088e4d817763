"""Delaunay triangles, Voronoi cells and spanning trees of the points of one slide."""

from __future__ import annotations

import math

import numpy as np


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (three indices each) by inserting points one at a time into a large triangle.

    Points in order of x, as ``np.unique`` gives them, leave triangles behind whose circles end before them: these are set aside,
    so that a point is held against the triangles of the front only.
    """
    n = len(p)
    if n < 3:
        return np.zeros((0, 3), int)
    lo, hi = p.min(axis=0), p.max(axis=0)
    c, span = (lo + hi) / 2, max(float((hi - lo).max()), 1.0) * 1e3
    q = np.vstack([p, [[c[0] - 2 * span, c[1] - span], [c[0] + 2 * span, c[1] - span], [c[0], c[1] + 2 * span]]]).astype(float)
    rising = bool((np.diff(q[:n, 0]) >= 0).all())
    tri = np.array([[n, n + 1, n + 2]])
    centre, r2 = _circles(q, tri)
    done, swept = [], 0
    for i in range(n):
        if rising and len(tri) > 2 * swept + 64:
            gap = q[i, 0] - centre[:, 0]
            past = (gap > 0) & (gap * gap > r2 * (1 + 1e-9))
            done.append(tri[past])
            tri, centre, r2 = tri[~past], centre[~past], r2[~past]
            swept = len(tri)
        bad = ((centre - q[i]) ** 2).sum(axis=1) <= r2 * (1 + 1e-12)
        edges = np.sort(np.vstack([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), axis=1)
        rim, times = np.unique(edges, axis=0, return_counts=True)
        new = np.column_stack([rim[times == 1], np.full((times == 1).sum(), i)])
        a, b = q[new[:, 1]] - q[new[:, 0]], q[i] - q[new[:, 0]]
        new = new[np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-9]
        more, more_r2 = _circles(q, new)
        tri, centre, r2 = np.vstack([tri[~bad], new]), np.vstack([centre[~bad], more]), np.concatenate([r2[~bad], more_r2])
    tri = np.vstack([*done, tri])
    return tri[(tri < n).all(axis=1)]


def _circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = (p[tri[:, k]] for k in range(3))
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    d = np.where(np.abs(d) < 1e-300, 1e-300, d)
    uu, vv = (u**2).sum(axis=1), (v**2).sum(axis=1)
    off = np.column_stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu]) / d[:, None]
    return a + off, (off**2).sum(axis=1)


def edges_of(tri: np.ndarray) -> np.ndarray:
    if not len(tri):
        return np.zeros((0, 2), int)
    return np.unique(np.sort(np.vstack([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1), axis=0)


def cells(p: np.ndarray, tri: np.ndarray) -> list[np.ndarray]:
    """Corner rings of the bounded Voronoi cells."""
    centre, _ = _circles(p.astype(float), tri) if len(tri) else (np.zeros((0, 2)), None)
    around: dict[int, list[int]] = {}
    for t, corners in enumerate(tri.tolist()):
        for v in corners:
            around.setdefault(v, []).append(t)
    rim, times = np.unique(np.sort(np.vstack([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1), axis=0, return_counts=True) if len(tri) else (np.zeros((0, 2), int), np.zeros(0))
    outer = set(rim[times == 1].ravel().tolist())
    out = []
    for v, ts in around.items():
        if v in outer or len(ts) < 3:
            continue
        ring = centre[ts]
        out.append(ring[np.argsort(np.arctan2(ring[:, 1] - p[v, 1], ring[:, 0] - p[v, 0]))])
    return out


def spanning_tree(p: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Lengths of the branches of a least spanning forest over the edges."""
    length = np.hypot(*(p[edges[:, 0]] - p[edges[:, 1]]).T) if len(edges) else np.zeros(0)
    root = list(range(len(p)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for k in np.argsort(length, kind="stable").tolist():
        a, b = find(int(edges[k, 0])), find(int(edges[k, 1]))
        if a != b:
            root[a] = b
            kept.append(float(length[k]))
    return np.array(kept)


def trimmed(x: np.ndarray) -> tuple[float, float, float, float]:
    """Mean, deviation, least over most, and disorder, after values beyond three deviations are left out until none is."""
    x = np.asarray(x, float)
    while len(x):
        kept = x[np.abs(x - x.mean()) <= 3 * x.std() * (1 + 1e-12) + 1e-12]
        if len(kept) == len(x):
            break
        x = kept
    if not len(x):
        return 0.0, 0.0, 0.0, 0.0
    m, s, most = float(x.mean()), float(x.std()), float(x.max())
    return m, s, float(x.min()) / most if most else 0.0, s / (m + s) if m + s else 0.0


def graph_features(p: np.ndarray) -> dict[str, float]:
    """Voronoi area, perimeter and widest distance, triangle side and area, and tree branches, each by four statistics."""
    tri = delaunay(p)
    rings = cells(p, tri)
    sides = edges_of(tri)
    area = [abs(float(r[:, 0] @ np.roll(r[:, 1], -1) - r[:, 1] @ np.roll(r[:, 0], -1))) / 2 for r in rings]
    around = [float(np.hypot(*(np.roll(r, -1, axis=0) - r).T).sum()) for r in rings]
    widest = [float(np.sqrt(((r[:, None] - r[None]) ** 2).sum(axis=2)).max()) for r in rings]
    a, b = (p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]]) if len(tri) else (np.zeros((0, 2)), np.zeros((0, 2)))
    values = {
        "voronoi_area": area, "voronoi_perimeter": around, "voronoi_max_dist": widest,
        "delaunay_sides": np.hypot(*(p[sides[:, 0]] - p[sides[:, 1]]).T) if len(sides) else [], "delaunay_area": np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) / 2,
        "mst_branches": spanning_tree(p, sides),
    }
    return {f"{k}_{n}": v for k, x in values.items() for n, v in zip(("mean", "stddev", "min_max_ratio", "disorder"), trimmed(np.asarray(x)), strict=True)}


def distance_of_polygons(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of two rings of points; 0 where they cross or one holds the other."""
    if _inside(a[0], b) or _inside(b[0], a):
        return 0.0
    best = math.inf
    for p, q in ((a, b), (b, a)):
        s, e = q, np.roll(q, -1, axis=0)
        d = e - s
        n = np.maximum((d**2).sum(axis=1), 1e-300)
        t = np.clip(((p[:, None] - s[None]) * d[None]).sum(axis=2) / n, 0, 1)
        best = min(best, float(np.sqrt(((p[:, None] - (s[None] + t[:, :, None] * d[None])) ** 2).sum(axis=2)).min()))
    return 0.0 if best > 0 and _cross(a, b) else best


def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
    s, e = ring, np.roll(ring, -1, axis=0)
    up = (s[:, 1] > p[1]) != (e[:, 1] > p[1])
    dy = np.where(e[:, 1] == s[:, 1], 1e-300, e[:, 1] - s[:, 1])
    return bool((up & (p[0] < s[:, 0] + (p[1] - s[:, 1]) * (e[:, 0] - s[:, 0]) / dy)).sum() % 2)


def _cross(a: np.ndarray, b: np.ndarray) -> bool:
    side = lambda o, u, v: (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])
    p, q = a[:, None], np.roll(a, -1, axis=0)[:, None]
    r, s = b[None], np.roll(b, -1, axis=0)[None]
    return bool(((side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)).any())


def clipped(ring: np.ndarray, xmin: float, ymin: float, xmax: float, ymax: float) -> np.ndarray:
    """The part of a polygon within a rectangle, one half plane after the other."""
    out = ring.astype(float)
    for axis, bound, keep in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        if not len(out):
            break
        nxt = np.roll(out, -1, axis=0)
        a, b = keep * (out[:, axis] - bound), keep * (nxt[:, axis] - bound)
        made = []
        for p, q, u, v in zip(out, nxt, a, b, strict=True):
            if u >= 0:
                made.append(p)
            if (u >= 0) != (v >= 0):
                made.append(p + (q - p) * (u / (u - v)))
        out = np.array(made).reshape(-1, 2)
    return out
