"""Polygon operations without a closed SQL form, in numpy behind Arrow functions over array<struct<x, y>> columns."""

from __future__ import annotations

import numpy as np


def area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2) if len(p) > 2 else 0.0


def clip_convex(p: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon in a convex window, by one half plane after the other; both in any turn."""
    x, y = window[:, 0], window[:, 1]
    if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
        window = window[::-1]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(p):
            break
        side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
        out = []
        for i in range(len(p)):
            j = (i + 1) % len(p)
            if side[i] >= 0:
                out.append(p[i])
            if (side[i] >= 0) != (side[j] >= 0):
                out.append(p[i] + (p[j] - p[i]) * (side[i] / (side[i] - side[j])))
        p = np.array(out).reshape(-1, 2)
    return p


def convex_iou(p: np.ndarray, q: np.ndarray) -> float:
    """J30 for shapes of which q is convex."""
    i = area(clip_convex(p, q))
    u = area(p) + area(q) - i
    return i / u if u > 0 else 0.0


def iof(p: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """The share of a polygon that lies in a box."""
    a, b, c, d = box
    whole = area(p)
    return area(clip_convex(p, np.array([[a, b], [c, b], [c, d], [a, d]]))) / whole if whole > 0 else 0.0


def hull(p: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, by monotone chains."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def chain(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def min_area_rect(p: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre, long side, short side and angle in [-pi/4, 3pi/4) of the least rectangle: one side lies on the hull."""
    h = hull(p)
    if len(h) < 3:
        d = h[-1] - h[0]
        return (*h.mean(axis=0).tolist(), float(np.hypot(*d)), 0.0, float(np.arctan2(d[1], d[0])))
    best = None
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        t = float(np.arctan2(b[1] - a[1], b[0] - a[0]))
        turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        q = h @ turn.T
        low, high = q.min(axis=0), q.max(axis=0)
        w, k = high - low
        if best is None or w * k < best[0] - 1e-12:
            best = (w * k, *(((low + high) / 2) @ turn).tolist(), float(w), float(k), t)
    _, x, y, w, k, t = best
    if w < k:
        w, k, t = k, w, t + np.pi / 2
    return x, y, w, k, float((t + np.pi / 4) % np.pi - np.pi / 4)


def simplify(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker on a ring, split at the vertex farthest from the first."""

    def keep(a: int, b: int) -> list[int]:
        todo, kept = [(a, b)], {a, b}
        while todo:
            i, j = todo.pop()
            if j - i < 2:
                continue
            d, q = r[j] - r[i], r[i + 1 : j] - r[i]
            n = float(np.hypot(*d))
            far = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / n if n else np.hypot(q[:, 0], q[:, 1])
            k = int(far.argmax())
            if far[k] > tolerance:
                kept.add(i + 1 + k)
                todo += [(i, i + 1 + k), (i + 1 + k, j)]
        return sorted(kept)

    r = np.vstack([p, p[:1]])
    half = int(np.hypot(*(p - p[0]).T).argmax())
    out = sorted({*keep(0, half), *keep(half, len(p))} - {len(p)})
    return p[out] if len(out) > 2 else p


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The closest pair of vertices."""
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    return tuple(int(i) for i in np.unravel_index(d.argmin(), d.shape))


def join_rings(parts: list[np.ndarray]) -> np.ndarray:
    """One ring through all parts: each is entered and left where it is nearest to what is joined so far."""
    ring = parts[0]
    for q in parts[1:]:
        i, j = nearest(ring, q)
        q = np.roll(q, -j, axis=0)
        ring = np.vstack([ring[: i + 1], q, q[:1], ring[i:]])
    return ring


def rasterize(p: np.ndarray, height: int, width: int) -> np.ndarray:
    """The pixels whose centres a polygon holds, by the even-odd rule a row at a time."""
    out = np.zeros((height, width), bool)
    a, b = p, np.roll(p, -1, axis=0)
    for row in range(height):
        y = row + 0.5
        hit = (a[:, 1] > y) != (b[:, 1] > y)
        x = np.sort(a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
        for u, v in zip(x[::2], x[1::2], strict=True):
            out[row, max(0, int(np.ceil(u - 0.5))) : max(0, int(np.ceil(v - 0.5)))] = True
    return out


def area_of(parts: list[np.ndarray]) -> float:
    """The area of parts that don't overlap."""
    return float(sum(area(p) for p in parts))


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The heights at which segments a[i]-b[i] cross each other."""
    d = b - a
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    off = a[None, :] - a[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (off[..., 0] * d[None, :, 1] - off[..., 1] * d[None, :, 0]) / cross
        u = (off[..., 0] * d[:, None, 1] - off[..., 1] * d[:, None, 0]) / cross
        y = a[:, None, 1] + t * d[:, None, 1]
    return y[(cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)]


def union(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The union of polygons, holes and separate pieces included, as trapezoids that don't overlap, from top to bottom.

    Between neighbouring heights of corners and crossings no edges cross. There each polygon is a row of intervals between
    edges, by the even-odd rule, and the intervals of all merge from left to right.
    """
    rings = [r for r in rings if len(r) > 2]
    if not rings:
        return []
    a, b = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    of = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    slanted = a[:, 1] != b[:, 1]
    a, b, of = a[slanted], b[slanted], of[slanted]
    ys, out = np.unique(np.concatenate([a[:, 1], b[:, 1], _crossings(a, b)])), []
    at = lambda e, y: a[e, 0] + (y - a[e, 1]) * (b[e, 0] - a[e, 0]) / (b[e, 1] - a[e, 1])
    for low, high in zip(ys, ys[1:], strict=False):
        mid = (low + high) / 2
        here = np.flatnonzero((a[:, 1] > mid) != (b[:, 1] > mid))
        here = here[np.lexsort((at(here, mid), of[here]))]
        spans = sorted(((at(i, mid), at(j, mid), i, j) for i, j in zip(here[::2], here[1::2], strict=True)), key=lambda s: s[:2])
        joined: list[list] = []
        for left, right, i, j in spans:
            if joined and left <= joined[-1][1]:
                if right > joined[-1][1]:
                    joined[-1][1], joined[-1][3] = right, j
            else:
                joined.append([left, right, i, j])
        out += [np.array([[at(i, low), low], [at(j, low), low], [at(j, high), high], [at(i, high), high]]) for _, _, i, j in joined]
    return out


def union_areas(rings: list[np.ndarray]) -> np.ndarray:
    """The areas of the unions of many sets of polygons at once: ring j of set i is rings[j][i], (n, corners, 2) each.

    As union does it, a slab between neighbouring heights at a time: in a slab the union's width is linear in y.
    """
    ends = [np.concatenate(r, axis=1) for r in (rings, [np.roll(r, -1, axis=1) for r in rings])]
    (ax, ay), (bx, by) = ((e[..., 0], e[..., 1]) for e in ends)
    dx, dy = bx - ax, by - ay
    places = [(j, i, r.shape[1]) for j, r in enumerate(rings) for i in range(r.shape[1])]
    near = lambda p, q: p[0] == q[0] and (p[1] - q[1]) % p[2] in (1, p[2] - 1)
    pairs = [(e, f) for e in range(len(places)) for f in range(e) if not near(places[e], places[f])]
    heights = [ay]
    with np.errstate(divide="ignore", invalid="ignore"):
        if pairs:
            e, f = np.array(pairs).T
            cross = dx[:, e] * dy[:, f] - dy[:, e] * dx[:, f]
            ox, oy = ax[:, f] - ax[:, e], ay[:, f] - ay[:, e]
            t, u = (ox * dy[:, f] - oy * dx[:, f]) / cross, (ox * dy[:, e] - oy * dx[:, e]) / cross
            heights.append(np.where((cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1), ay[:, e] + t * dy[:, e], ay[:, :1]))
        ys = np.sort(np.concatenate(heights, axis=1), axis=1)
        mid, tall, slope = (ys[:, 1:] + ys[:, :-1]) / 2, np.diff(ys, axis=1), dx / dy
        left, right, at = [], [], 0
        for r in rings:
            own = slice(at, at := at + r.shape[1])
            y = mid[:, None, :]
            hit = (ay[:, own, None] > y) != (by[:, own, None] > y)
            x = np.sort(np.where(hit, ax[:, own, None] + (y - ay[:, own, None]) * slope[:, own, None], np.inf), axis=1)
            left += [x[:, i] for i in range(0, x.shape[1] - 1, 2)]
            right += [x[:, i] for i in range(1, x.shape[1], 2)]
        left, right = np.array(left), np.array(right)
        order = np.argsort(left, axis=0)
        left, right = np.take_along_axis(left, order, axis=0), np.take_along_axis(right, order, axis=0)
        width, reach = np.zeros_like(mid), np.full_like(mid, -np.inf)
        for a, b in zip(left, right, strict=True):
            width += np.where(np.isfinite(b), np.maximum(b - np.maximum(a, reach), 0), 0)
            reach = np.where(np.isfinite(b), np.maximum(reach, b), reach)
    return (width * tall).sum(axis=1)


def window_areas(points: list[tuple], box: tuple) -> np.ndarray:
    """The areas that many simple polygons, in any turn, share with a box each; corners and boxes as arrays.

    The sum over edges of the integral, over the part of x in the box, of the height clamped to the box.
    """
    a, b, c, d = box
    rise = lambda y: np.clip(y - b, 0, d - b)
    integral = lambda y: rise(y) ** 2 / 2 + (d - b) * np.maximum(y - d, 0)
    total = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for (px, py), (qx, qy) in zip(points, [*points[1:], points[0]], strict=True):
            u, v, slope = np.clip(px, a, c), np.clip(qx, a, c), (qy - py) / (qx - px)
            yu, yv = py + (u - px) * slope, py + (v - px) * slope
            part = np.where(np.abs(yv - yu) < 1e-6, (v - u) * rise((yu + yv) / 2), (integral(yv) - integral(yu)) / slope)
            total = total + np.where(px == qx, 0.0, part)
    return np.abs(total)
