"""Image kernels over one tile as a numpy array; tiles have a bounded size."""

from __future__ import annotations

import functools
import math

import numpy as np


def gaussian(im: np.ndarray, sigma: float) -> np.ndarray:
    """Separable smoothing; the rim is continued by its own values."""
    if sigma <= 0:
        return im.astype(float)
    h = max(1, int(4 * sigma + 0.5))
    k = np.exp(-(np.arange(-h, h + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = im.astype(float)
    for axis in (0, 1):
        pad = [(h, h) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(p, range(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def laplace(im: np.ndarray) -> np.ndarray:
    p = np.pad(im, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * im


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of every set pixel to the nearest unset one; infinite where none is."""
    h, w = mask.shape
    big = float((h + w) ** 2 * 4)
    col = np.where(mask, big, 0.0)
    for rows in (range(1, h), range(h - 2, -1, -1)):
        step = 1 if rows.step > 0 else -1
        for y in rows:
            col[y] = np.minimum(col[y], col[y - step] + 1)
    sq = np.minimum(col, big) ** 2
    x = np.arange(w)
    gap = (x[:, None] - x) ** 2.0
    out = np.empty_like(sq)
    for y in range(h):
        out[y] = (sq[y][None, :] + gap).min(axis=1)
    d = np.sqrt(out)
    return np.where(d > h + w, np.inf, d)


def shifts(conn: int) -> list[tuple[int, int]]:
    return [(0, 1), (1, 0)] if conn == 4 else [(0, 1), (1, 0), (1, 1), (1, -1)]


def label(mask: np.ndarray, conn: int = 4, values: np.ndarray | None = None) -> np.ndarray:
    """Components numbered from 1 by their first pixel in reading order; ``values`` keeps unlike pixels apart."""
    n = mask.size
    root = np.arange(n).reshape(mask.shape)
    h, w = mask.shape
    while True:  # each round takes the least root among neighbours, and then follows pointers
        new = root.copy()
        for dy, dx in shifts(conn):
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
            ok = mask[a] & mask[b]
            if values is not None:
                ok &= values[a] == values[b]
            low = np.minimum(new[a], new[b])
            new[a] = np.where(ok, low, new[a])
            new[b] = np.where(ok, np.minimum(low, new[b]), new[b])
        flat = new.ravel()
        np.minimum.at(flat, root.ravel(), new.ravel().copy())
        while (flat[flat] != flat).any():
            flat = flat[flat]
        new = flat.reshape(mask.shape)
        if (new == root).all():
            break
        root = new
    out = np.zeros(mask.shape, np.int64)
    ids = np.unique(root[mask])
    out[mask] = np.searchsorted(ids, root[mask]) + 1
    return out


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of set pixels, in reading order."""
    p = np.pad(mask, ((0, 0), (1, 1)))
    y, first = np.nonzero(p[:, 1:-1] & ~p[:, :-2])
    _, last = np.nonzero(p[:, 1:-1] & ~p[:, 2:])
    return y, first, last


def largest_runs(y: np.ndarray, first: np.ndarray, last: np.ndarray, conn: int = 8) -> list[tuple[int, int, int]]:
    """The runs, given in reading order, of the component with most pixels; of those alike the one of the first pixel."""
    wide, slack = int(last.max()) + 3, int(conn == 8)
    lo = np.searchsorted(y * wide + last + 1, (y + 1) * wide + first + 1 - slack)
    hi = np.searchsorted(y * wide + first + 1, (y + 1) * wide + last + 1 + slack, side="right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    root = np.arange(len(y))
    while True:  # the larger root of every edge hooks to the smaller one, and pointers are followed
        u, v = root[a], root[b]
        if (u == v).all():
            break
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    sizes = np.bincount(root, weights=last - first + 1)
    keep = root == int(sizes.argmax())
    return list(zip(y[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True))


def fill_holes(mask: np.ndarray) -> np.ndarray:
    outside = label(np.pad(~mask, 1, constant_values=True), 4)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def opened(mask: np.ndarray, radius: float) -> np.ndarray:
    """Opening with a disk: what a disk within the mask covers."""
    core = distance(np.pad(mask, 1)) > radius
    return (distance(~core) <= radius)[1:-1, 1:-1] & mask if core.any() else np.zeros_like(mask)


def closed(mask: np.ndarray, radius: float) -> np.ndarray:
    r = int(math.ceil(radius)) + 1
    p = np.pad(mask, r)
    return ~opened(~p, radius)[r:-r, r:-r] | mask


def gradient(im: np.ndarray) -> np.ndarray:
    gy, gx = np.gradient(im.astype(float)) if min(im.shape) > 1 else (np.zeros(im.shape), np.zeros(im.shape))
    return np.hypot(gy, gx)


def canny(im: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Edges: ridges of the smoothed gradient, strong ones and weak ones that touch them."""
    if min(im.shape) < 3:
        return np.zeros(im.shape, bool)
    s = gaussian(im / max(1.0, float(np.abs(im).max())), sigma)
    gy, gx = np.gradient(s)
    m = np.hypot(gy, gx)
    p = np.pad(m, 1)
    turn = np.round(np.arctan2(gy, gx) / (math.pi / 4)).astype(int) % 4
    ridge = np.zeros(m.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        a = p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
        b = p[1 - dy : p.shape[0] - 1 - dy, 1 - dx : p.shape[1] - 1 - dx]
        ridge |= (turn == k) & (m >= a) & (m > b)
    weak = ridge & (m >= low)
    parts = label(weak, 8)
    return weak & np.isin(parts, np.unique(parts[ridge & (m >= high)]))


def laplacian_scales(im: np.ndarray, mask: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest scaled Laplacian of Gaussian over whole sigmas that fit (twice the depth reaches sigma), and its sigma."""
    depth = 2 * distance(mask)
    best, at = np.full(im.shape, -np.inf), np.zeros(im.shape)
    for s in range(int(low), int(high) + 1):
        r = np.where(depth >= s, s * s * laplace(gaussian(im, s)), -np.inf)
        at, best = np.where(r > best, s, at), np.maximum(best, r)
    return np.where(np.isfinite(best), best, 0.0), at


def difference_scales(im: np.ndarray, mask: np.ndarray, low: float, high: float, levels: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Largest difference of Gaussians over ``levels`` sigmas to an octave that fit, and its sigma; scaled to stand for the Laplacian."""
    step = 2 ** (1 / levels)
    depth = 2 * distance(mask)
    best, at = np.full(im.shape, -np.inf), np.zeros(im.shape)
    s, near = low, gaussian(im, low)
    while s <= high * 1.0000001:
        far = gaussian(im, s * step)
        r = np.where(depth >= s, (far - near) / (step - 1), -np.inf)
        at, best = np.where(r > best, s, at), np.maximum(best, r)
        s, near = s * step, far
    return np.where(np.isfinite(best), best, 0.0), at


def oriented_kernel(sx: float, sy: float, theta: float) -> np.ndarray:
    """Laplacian of a Gaussian that is stretched along a direction, without mean."""
    h = math.ceil(3 * max(sx, sy))
    y, x = np.mgrid[-h : h + 1, -h : h + 1]
    a = math.cos(theta) ** 2 / (2 * sx**2) + math.sin(theta) ** 2 / (2 * sy**2)
    b = -math.sin(2 * theta) / (4 * sx**2) + math.sin(2 * theta) / (4 * sy**2)
    c = math.sin(theta) ** 2 / (2 * sx**2) + math.cos(theta) ** 2 / (2 * sy**2)
    g = np.exp(-(a * x * x + 2 * b * x * y + c * y * y))
    g /= g.sum()
    k = ((2 * a * x + 2 * b * y) ** 2 - 2 * a + (2 * b * x + 2 * c * y) ** 2 - 2 * c) * g
    return k - k.mean()


def convolve(im: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Zero-padded convolution by transforms."""
    shape = [a + b - 1 for a, b in zip(im.shape, k.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(im, shape) * np.fft.rfft2(k, shape), shape)
    y, x = ((n - 1) // 2 for n in k.shape)
    return full[y : y + im.shape[0], x : x + im.shape[1]]


@functools.cache
def oriented_sum(sigmas: tuple[float, ...], angles: int) -> np.ndarray:
    """All oriented kernels of the scales in one, each scaled by its sigmas: a sum of convolutions is one with the sum."""
    h = math.ceil(3 * max(sigmas))
    out = np.zeros((2 * h + 1, 2 * h + 1))
    for i, sx in enumerate(sigmas):
        for sy in sigmas[: i + 1]:
            for k in range(angles if sx != sy else 1):
                one = oriented_kernel(sx, sy, math.pi * k / angles)
                r = len(one) // 2
                out[h - r : h + r + 1, h - r : h + r + 1] += (1 + math.log(sx) ** 2) * (1 + math.log(sy) ** 2) * one
    return out


def oriented_scales(im: np.ndarray, sigmas: list[float], angles: int = 8) -> np.ndarray:
    """Sum of the oriented responses over directions, each scaled by its sigmas; bright blobs on dark are positive."""
    return -convolve(im, oriented_sum(tuple(sigmas), angles)) if sigmas else np.zeros(im.shape)


def local_peaks(response: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Labels of pixels by the peak that they climb to, and the peaks' weighted centres.

    A pixel steps to the largest response within the radius; equal peaks that touch are one.
    """
    h, w = response.shape
    v = np.where(mask, response, -np.inf)
    best, to = v.copy(), np.arange(v.size).reshape(v.shape)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if not 0 < dy * dy + dx * dx <= radius * radius or abs(dy) >= h or abs(dx) >= w:
                continue
            a = (slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx)))
            up = v[b] > best[a]
            best[a] = np.where(up, v[b], best[a])
            to[a] = np.where(up, np.arange(v.size).reshape(v.shape)[b], to[a])
    flat = to.ravel()
    while (flat[flat] != flat).any():
        flat = flat[flat]
    peak = (flat.reshape(v.shape) == np.arange(v.size).reshape(v.shape)) & mask
    seeds = label(peak, 8, v)
    out = np.where(mask, seeds.ravel()[flat].reshape(v.shape), 0)
    centres = []
    for k in range(1, int(seeds.max(initial=0)) + 1):
        y, x = np.nonzero(seeds == k)
        centres.append((float(y.mean()), float(x.mean())))
    return out, centres


MOORE = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def outline(mask: np.ndarray, conn: int = 8) -> list[tuple[int, int]]:
    """Boundary pixels (y, x) of the first object in reading order, clockwise; none for a single pixel."""
    ys, xs = np.nonzero(mask)
    if len(ys) < 2:
        return []
    inside = lambda y, x: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and bool(mask[y, x])
    turn = range(8) if conn == 8 else range(0, 8, 2)
    here, back = (int(ys[0]), int(xs[0])), 4
    steps, seen = [], {}
    while (here, back) not in seen:
        seen[here, back] = len(steps)
        steps.append(here)
        for k in range(1, 9):
            d = (back + k) % 8
            if d in turn and inside(here[0] + MOORE[d][0], here[1] + MOORE[d][1]):
                here = (here[0] + MOORE[d][0], here[1] + MOORE[d][1])
                back = (d + 4) % 8
                break
        else:
            return []
    ring = steps[seen[here, back] :]  # the first pixel was entered from outside
    first = ring.index(min(ring))
    return ring[first:] + ring[:first]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of (x, y) points, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    half = []
    for seq in (p.tolist(), p.tolist()[::-1]):
        line: list = []
        for q in seq:
            while len(line) > 1 and cross(line[-2], line[-1], q) <= 0:
                line.pop()
            line.append(q)
        half += line[:-1]
    return np.array(half)


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def fractal(mask: np.ndarray) -> float:
    """Box-counting dimension: minus the slope of log count on log size, over boxes that are partly filled."""
    n = int(math.floor(math.log2(min(mask.shape)))) if min(mask.shape) > 0 else 0
    sizes, counts = [], []
    for k in range(n, 1, -1):
        s = 2**k
        by = lambda a, axis: np.add.reduceat(a, np.arange(0, a.shape[axis], s), axis=axis)  # noqa: E731, B023
        boxes = by(by(mask.astype(int), 0), 1)
        sizes.append(s)
        counts.append(int(((boxes > 0) & (boxes < s * s)).sum()))
    ok = [(s, c) for s, c in zip(sizes, counts, strict=True) if c > 0]
    if len(ok) < 2:
        return 0.0
    return float(-np.polyfit(np.log([s for s, _ in ok]), np.log([c for _, c in ok]), 1)[0])


def perimeter(mask: np.ndarray) -> float:
    """Length of the boundary: straight steps count 1, diagonal ones the root of 2, mixed ones half of both."""
    p = np.pad(mask.astype(bool), 1)
    inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    b = np.pad(p[1:-1, 1:-1] & ~inner, 1).astype(int)
    code = b[1:-1, 1:-1] + 2 * (b[:-2, 1:-1] + b[2:, 1:-1] + b[1:-1, :-2] + b[1:-1, 2:]) + 10 * (b[:-2, :-2] + b[:-2, 2:] + b[2:, :-2] + b[2:, 2:])
    weight = np.zeros(50)
    weight[[5, 7, 15, 17, 25, 27]] = 1
    weight[[21, 33]] = math.sqrt(2)
    weight[[13, 23]] = (1 + math.sqrt(2)) / 2
    return float((np.bincount(code.ravel(), minlength=50)[:50] * weight).sum())


def hu(mask: np.ndarray, weights: np.ndarray | None = None) -> list[float]:
    """Seven moment invariants."""
    w = mask.astype(float) * (1 if weights is None else weights)
    m00 = w.sum()
    if m00 <= 0:
        return [0.0] * 7
    y, x = np.mgrid[: mask.shape[0], : mask.shape[1]]
    cy, cx = (w * y).sum() / m00, (w * x).sum() / m00
    n = lambda p, q: float((w * (x - cx) ** p * (y - cy) ** q).sum() / m00 ** (1 + (p + q) / 2))
    n20, n02, n11, n30, n03, n21, n12 = n(2, 0), n(0, 2), n(1, 1), n(3, 0), n(0, 3), n(2, 1), n(1, 2)
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    return [
        n20 + n02,
        (n20 - n02) ** 2 + 4 * n11**2,
        c**2 + d**2,
        a**2 + b**2,
        c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2),
        (n20 - n02) * (a**2 - b**2) + 4 * n11 * a * b,
        d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2),
    ]


def fourier_shape(boundary: np.ndarray, samples: int = 128, bins: int = 6) -> list[float]:
    """Energy of a boundary's tangent angles by octaves of frequency: equal arc steps, angles against the first, power summing to one."""
    p = boundary.astype(float)
    if len(p) < 3:
        return [0.0] * bins
    ring = np.vstack([p, p[:1]])
    step = np.hypot(*np.diff(ring, axis=0).T)
    at = np.concatenate([[0], np.cumsum(step)])
    if at[-1] <= 0:
        return [0.0] * bins
    want = np.linspace(0, at[-1], samples + 1)
    x, y = np.interp(want, at, ring[:, 0]), np.interp(want, at, ring[:, 1])
    angle = np.unwrap(np.arctan2(np.diff(y), np.diff(x)))
    power = np.abs(np.fft.fft(angle - angle[0])[: samples // 2 + 1]) ** 2
    total = power.sum()
    power = power / total if total > 0 else power
    edges = np.round(2 ** np.linspace(0, math.log2(samples) - 1, bins + 1)).astype(int)
    return [float(power[a - 1 : b].sum()) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def diffused(dy: np.ndarray, dx: np.ndarray, mask: np.ndarray, mu: float = 5.0, lam: float = 5.0, iterations: int = 10, dt: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """A gradient field as an elastic body: it spreads (``mu``), evens out where it converges (``lam + mu``), and is held to the gradient in the mask."""
    start = np.stack([dy, dx]).astype(float)
    field = start.copy()
    for _ in range(iterations):
        spread = np.stack([laplace(part) for part in field])
        squeeze = np.stack(np.gradient(np.gradient(field[0], axis=0) + np.gradient(field[1], axis=1)))
        field = field + dt * (mu * spread + (lam + mu) * squeeze + mask * (start - field))
    return field[0], field[1]


def flow_sinks(dy: np.ndarray, dx: np.ndarray, mask: np.ndarray, radius: float = 5.0, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Labels of pixels by the sink that they flow to, and the sinks; sinks nearer than the radius are one."""
    h, w = mask.shape
    size = np.maximum(np.hypot(dy, dx), 1e-12)
    y, x = np.mgrid[:h, :w]
    ty = np.clip(y + np.round(dy / size).astype(int), 0, h - 1)
    tx = np.clip(x + np.round(dx / size).astype(int), 0, w - 1)
    to = np.where(mask & mask[ty, tx], ty * w + tx, y * w + x).ravel()
    for _ in range(steps):
        new = to[to]
        if (new == to).all():
            break
        to = new
    sinks = np.unique(to[mask.ravel()])
    sy, sx = sinks // w, sinks % w
    group = np.arange(len(sinks))
    for i in range(len(sinks)):  # within one tile
        near = np.flatnonzero((sy[i + 1 :] - sy[i]) ** 2 + (sx[i + 1 :] - sx[i]) ** 2 <= radius**2) + i + 1
        group[np.isin(group, group[near])] = group[i]
    ids = np.unique(group)
    out = np.zeros(h * w, int)
    m = mask.ravel()
    out[m] = np.searchsorted(ids, group[np.searchsorted(sinks, to[m])]) + 1
    centres = np.array([[sy[group == g].mean(), sx[group == g].mean()] for g in ids]).reshape(-1, 2)
    return out.reshape(h, w), centres


def curvature(phi: np.ndarray) -> np.ndarray:
    gy, gx = np.gradient(phi)
    n = np.sqrt(gy**2 + gx**2) + 1e-10
    return np.gradient(gy / n, axis=0) + np.gradient(gx / n, axis=1)


def signed_distance(mask: np.ndarray) -> np.ndarray:
    """Negative inside, positive outside."""
    big = float(sum(mask.shape))
    return np.minimum(distance(~mask), big) - np.minimum(distance(mask), big) + mask - 0.5


def region_contour(im: np.ndarray, mask: np.ndarray, sigma: float = 1.0, dt: float = 0.5, mu: float = 0.2, inside: float = 1.0, outside: float = 1.0, rounds: int = 50) -> np.ndarray:
    """A contour that parts two mean intensities, with a penalty on its length; returns its level function."""
    im = im.astype(float)
    phi = signed_distance(mask)
    for _ in range(rounds):
        inner = phi < 0
        a, b = (im[m].mean() if m.any() else 0.0 for m in (inner, ~inner))
        delta = sigma / math.pi / (sigma**2 + phi**2)
        force = inside * (im - a) ** 2 - outside * (im - b) ** 2
        phi = phi + dt * delta * (mu * curvature(phi) + force / (np.abs(force).max() + 1e-12))
    return phi


def edge_contour(im: np.ndarray, mask: np.ndarray, sigma: float = 1.5, dt: float = 1.0, mu: float = 0.2, length: float = 5.0, area: float = -3.0, eps: float = 1.5, rounds: int = 50, double: bool = True) -> np.ndarray:
    """A contour drawn to edges, kept near a distance function by a single or double well; returns its level function."""
    g = 1 / (1 + gradient(gaussian(im.astype(float), sigma)) ** 2)
    gy, gx = np.gradient(g)
    phi = np.where(mask, -2.0, 2.0)
    for _ in range(rounds):
        phi[[0, -1]], phi[:, [0, -1]] = phi[[1, -2]], phi[:, [1, -2]]  # no flux over the rim
        py, px = np.gradient(phi)
        s = np.sqrt(py**2 + px**2)
        if double:
            dp = np.where(s <= 1, np.sin(2 * math.pi * s) / (2 * math.pi), s - 1) / np.maximum(s, 1e-10)
            dp = np.where(s < 1e-10, 1.0, dp)
        else:
            dp = 1 - 1 / np.maximum(s, 1e-10)
        keep = np.gradient(dp * py, axis=0) + np.gradient(dp * px, axis=1)
        delta = np.where(np.abs(phi) <= eps, (1 + np.cos(math.pi * phi / eps)) / (2 * eps), 0.0)
        n = s + 1e-10
        edge = delta * (gy * py / n + gx * px / n) + delta * g * curvature(phi)
        phi = phi + dt * (mu * keep + length * edge + area * delta * g)
    return phi


def superpixels(rgb: np.ndarray, size: int = 8, compactness: float = 10.0, rounds: int = 5) -> np.ndarray:
    """Clusters of place and colour around a grid of centres, numbered from 1; each pixel takes the nearest of the centres around it."""
    h, w, _ = rgb.shape
    ys, xs = (np.arange(size // 2, max(n, size // 2 + 1), size) for n in (h, w))
    ys, xs = np.minimum(ys, h - 1), np.minimum(xs, w - 1)
    cy, cx = (a.ravel().astype(float) for a in np.meshgrid(ys, xs, indexing="ij"))
    colour = rgb[cy.astype(int), cx.astype(int)].astype(float)
    y, x = np.mgrid[:h, :w]
    gy, gx = np.minimum(y // size, len(ys) - 1), np.minimum(x // size, len(xs) - 1)
    out = gy * len(xs) + gx
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                k = np.clip(gy + dy, 0, len(ys) - 1) * len(xs) + np.clip(gx + dx, 0, len(xs) - 1)
                d = ((rgb - colour[k]) ** 2).sum(axis=2) + (compactness / size) ** 2 * ((y - cy[k]) ** 2 + (x - cx[k]) ** 2)
                near = d < best
                best, out = np.where(near, d, best), np.where(near, k, out)
        n = np.bincount(out.ravel(), minlength=len(cy)).astype(float)
        ok = n > 0
        mean = lambda v: np.bincount(out.ravel(), weights=v.ravel(), minlength=len(cy))[ok] / n[ok]  # noqa: E731, B023
        cy[ok], cx[ok] = mean(y.astype(float)), mean(x.astype(float))
        for c in range(3):
            colour[ok, c] = mean(rgb[:, :, c].astype(float))
    return out + 1


def votes(im: np.ndarray, low: int, high: int, threshold: float = 0.1, spread: float = 2.0) -> np.ndarray:
    """Votes of strong gradients for the centre that lies the mean radius along them, smoothed."""
    gy, gx = np.gradient(gaussian(im.astype(float), 1.0))
    m = np.hypot(gy, gx)
    strong = m > threshold * max(float(m.max()), 1e-12)
    y, x = np.nonzero(strong)
    r = (low + high) / 2
    ty = np.round(y - r * gy[strong] / m[strong]).astype(int)
    tx = np.round(x - r * gx[strong] / m[strong]).astype(int)
    ok = (ty >= 0) & (ty < im.shape[0]) & (tx >= 0) & (tx < im.shape[1])
    out = np.zeros(im.shape)
    np.add.at(out, (ty[ok], tx[ok]), m[strong][ok])
    return gaussian(out, spread)


def mean_shift(points: np.ndarray, weights: np.ndarray, bandwidth: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Modes of weighted points under a flat kernel, and the mode of each point."""
    at = points.astype(float).copy()
    for _ in range(rounds):
        near = ((at[:, None] - points[None]) ** 2).sum(axis=2) <= bandwidth**2
        w = near * weights
        new = w @ points / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
        if np.abs(new - at).max(initial=0) < 1e-3:
            break
        at = new
    modes: list[np.ndarray] = []
    which = np.zeros(len(at), int)
    for i, p in enumerate(at):
        k = next((k for k, m in enumerate(modes) if ((m - p) ** 2).sum() <= (bandwidth / 2) ** 2), None)
        if k is None:
            modes.append(p)
            k = len(modes) - 1
        which[i] = k
    return np.array(modes).reshape(-1, 2), which


def contours_by_gradient(im: np.ndarray, levels: int = 8, least: int = 6) -> np.ndarray:
    """Dark objects: components under each grey level, drawn by the mean gradient along their rims, the strongest last."""
    g, found = gradient(im), []
    for t in np.quantile(im, np.linspace(0.1, 0.9, levels)):
        parts = label(im <= t, 4)
        for k in range(1, int(parts.max(initial=0)) + 1):
            m = parts == k
            touches = m[0].any() or m[-1].any() or m[:, 0].any() or m[:, -1].any()
            if m.sum() >= least and not (touches and m.sum() > m.size / 2):
                p = np.pad(m, 1)
                rim = m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
                found.append((float(g[rim].mean()), m))
    out = np.zeros(im.shape, int)
    for k, (_, m) in enumerate(sorted(found, key=lambda f: f[0]), 1):
        out[m] = k
    ids = np.unique(out[out > 0])
    return np.where(out > 0, np.searchsorted(ids, out) + 1, 0)


def cut_scores(a: tuple[float, float], b: tuple[float, float], depth: tuple[float, float], normal: tuple[float, float], hull_angle: tuple[float, float]) -> float:
    """Worth of a cut between two concavities: short against their depths, and square to the hull."""
    r = math.hypot(a[0] - b[0], a[1] - b[1])
    length = r / (r + depth[0] + depth[1]) if r + depth[0] + depth[1] > 0 else 0.0
    angle = sum(abs(math.pi / 2 - (n - h)) for n, h in zip(normal, hull_angle, strict=True)) / math.pi
    return (length + angle) / 2


def split_concavity(mask: np.ndarray, least: float = 2.0) -> np.ndarray:
    """Parts of an object after one cut between its two deepest concavities that lie ``least`` or more below the hull."""
    ring = outline(mask, 8)
    whole = mask.astype(int)
    if len(ring) < 8:
        return whole
    pts = np.array([(x, y) for y, x in ring], float)
    top = {tuple(p) for p in hull(pts).tolist()}
    marks = [i for i, p in enumerate(pts) if tuple(p.tolist()) in top]
    deep = []
    for i, j in zip(marks, [*marks[1:], marks[0] + len(pts)], strict=True):
        between = [k % len(pts) for k in range(i + 1, j)]
        if between:
            a, b = pts[i], pts[j % len(pts)]
            d = b - a
            off = np.abs(d[0] * (pts[between, 1] - a[1]) - d[1] * (pts[between, 0] - a[0])) / max(float(np.hypot(*d)), 1e-12)
            k = int(off.argmax())
            if off[k] >= least:
                deep.append((float(off[k]), between[k]))
    if len(deep) < 2:
        return whole
    (_, i), (_, j) = sorted(deep, reverse=True)[:2]
    n = int(max(np.abs(pts[i] - pts[j]))) * 2 + 1
    line = np.round(np.linspace(pts[i], pts[j], n)).astype(int)
    cut = mask.copy()
    cut[line[:, 1], line[:, 0]] = False
    parts = label(cut, 4)
    if parts.max(initial=0) < 2:
        return whole
    return parts
