"""Box algebra as column expressions. All functions take and give Columns; nothing leaves whole-stage code."""

from __future__ import annotations

from math import pi
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7


class Box(NamedTuple):
    """Corners (x1, y1, x2, y2), or any of the other four-number forms that a function names."""

    a: Column
    b: Column
    c: Column
    d: Column


def col_box(prefix: str = "", suffix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{k}{suffix}") for k in ("x1", "y1", "x2", "y2")))


def named(box: Box, *names: str) -> list[Column]:
    return [c.alias(n) for c, n in zip(box, names or ("x1", "y1", "x2", "y2"), strict=True)]


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


# Forms: corners (xyxy), centre and size (xywh), top left and size (ltwh).


def xyxy_to_xywh(b: Box) -> Box:
    """P9."""
    return Box((b.a + b.c) / 2, (b.b + b.d) / 2, b.c - b.a, b.d - b.b)


def xywh_to_xyxy(b: Box) -> Box:
    """P10."""
    return Box(b.a - b.c / 2, b.b - b.d / 2, b.a + b.c / 2, b.b + b.d / 2)


def xywhn_to_xyxy(b: Box, w, h, pad_w=0, pad_h=0) -> Box:
    """Normalized centre form to pixels, shifted by a pad."""
    return Box((b.a - b.c / 2) * w + pad_w, (b.b - b.d / 2) * h + pad_h, (b.a + b.c / 2) * w + pad_w, (b.b + b.d / 2) * h + pad_h)


def xyxy_to_xywhn(b: Box, w, h, clip: bool = False, eps: float = 0.0) -> Box:
    """Pixels to the normalized centre form, clipped to the image less eps where asked."""
    if clip:
        b = clip_box(b, w - eps, h - eps)
    c = xyxy_to_xywh(b)
    return Box(c.a / w, c.b / h, c.c / w, c.d / h)


def xywh_to_ltwh(b: Box) -> Box:
    """P13."""
    return Box(b.a - b.c / 2, b.b - b.d / 2, b.c, b.d)


def xyxy_to_ltwh(b: Box) -> Box:
    """P14."""
    return Box(b.a, b.b, b.c - b.a, b.d - b.b)


def ltwh_to_xywh(b: Box) -> Box:
    """P15."""
    return Box(b.a + b.c / 2, b.b + b.d / 2, b.c, b.d)


def ltwh_to_xyxy(b: Box) -> Box:
    """P16."""
    return Box(b.a, b.b, b.a + b.c, b.b + b.d)


_TO = {"xyxy": lambda b: b, "xywh": xywh_to_xyxy, "ltwh": ltwh_to_xyxy}
_FROM = {"xyxy": lambda b: b, "xywh": xyxy_to_xywh, "ltwh": xyxy_to_ltwh}


def convert(b: Box, source: str, target: str) -> Box:
    """Any of the three forms to any other."""
    return _FROM[target](_TO[source](b))


def area(b: Box) -> Column:
    """P37."""
    return (b.c - b.a) * (b.d - b.b)


def clip_box(b: Box, w, h) -> Box:
    """P25."""
    return Box(clamp(b.a, 0, w), clamp(b.b, 0, h), clamp(b.c, 0, w), clamp(b.d, 0, h))


def flip_lr(b: Box, w) -> Box:
    """P40."""
    return Box(w - b.c, b.b, w - b.a, b.d)


def flip_ud(b: Box, h) -> Box:
    """P41."""
    return Box(b.a, h - b.d, b.c, h - b.b)


def scale(b: Box, w, h) -> Box:
    """P43; P42 with the inverses."""
    return Box(b.a * w, b.b * h, b.c * w, b.d * h)


def shift(b: Box, dx, dy) -> Box:
    """Add a pad or a crop's offset."""
    return Box(b.a + dx, b.b + dy, b.c + dx, b.d + dy)


def letterbox(w: float, h: float, to_w: float, to_h: float) -> tuple[float, float, float]:
    """P50: gain and the pads on the left and at the top of a resize that keeps the shape."""
    gain = min(to_h / h, to_w / w)
    return gain, round((to_w - round(w * gain)) / 2 - 0.1), round((to_h - round(h * gain)) / 2 - 0.1)


def unletterbox(b: Box, w: float, h: float, from_w: float, from_h: float) -> Box:
    """Boxes of the letterboxed image back on the original, clipped to it."""
    gain, pad_w, pad_h = letterbox(w, h, from_w, from_h)
    return clip_box(Box((b.a - pad_w) / gain, (b.b - pad_h) / gain, (b.c - pad_w) / gain, (b.d - pad_h) / gain), w, h)


def project(b: Box, m: list[list[float]]) -> Box:
    """The corners under a 3 x 3 matrix, and the box around them."""
    pts = []
    for x, y in ((b.a, b.b), (b.c, b.d), (b.a, b.d), (b.c, b.b)):
        u, v, s = (m[i][0] * x + m[i][1] * y + m[i][2] for i in range(3))
        pts.append((u / s, v / s) if m[2] != [0, 0, 1] else (u, v))
    xs, ys = zip(*pts, strict=True)
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def box_candidate(a: Box, b: Box, side: float = 2, aspect: float = 100, share: float = 0.1, eps: float = 1e-16) -> Column:
    """Whether a box is still of use after a transform: sides, aspect and share of its area."""
    w1, h1, w2, h2 = a.c - a.a, a.d - a.b, b.c - b.a, b.d - b.b
    return (w2 > side) & (h2 > side) & (w2 * h2 / (w1 * h1 + eps) > share) & (F.greatest(w2 / (h2 + eps), h2 / (w2 + eps)) < aspect)


def near_crop_edge(b: Box, crop: tuple, whole: tuple, near: float = 20) -> Column:
    """An edge within near pixels of the crop's edge but not of the image's."""
    tests = [(F.abs(x + o - F.lit(c)) <= near) & ~(F.abs(x + o - F.lit(e)) <= near) for x, o, c, e in zip(b, (crop[0], crop[1]) * 2, crop, whole, strict=True)]
    return tests[0] | tests[1] | tests[2] | tests[3]


def make_divisible(x: Column, n) -> Column:
    """P27."""
    return F.ceil(x / n) * n


# Overlap.


def intersect(a: Box, b: Box) -> Box:
    return Box(F.greatest(a.a, b.a), F.greatest(a.b, b.b), F.least(a.c, b.c), F.least(a.d, b.d))


def overlaps(a: Box, b: Box) -> Column:
    """Whether two boxes share an area."""
    i = intersect(a, b)
    return (i.a < i.c) & (i.b < i.d)


def inter_area(a: Box, b: Box) -> Column:
    i = intersect(a, b)
    return F.greatest(i.c - i.a, F.lit(0.0)) * F.greatest(i.d - i.b, F.lit(0.0))


def iou(a: Box, b: Box, eps: float = EPS) -> Column:
    """J2, J9, J20 (eps 0): intersection over union."""
    i = inter_area(a, b)
    u = area(a) + area(b) - i + eps
    return i / u if eps else F.when(u > 0, i / u).otherwise(0.0)


def ioa(a: Box, b: Box, eps: float = EPS) -> Column:
    """Intersection over the area of b."""
    return inter_area(a, b) / (area(b) + eps)


def coverage(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return inter_area(a, b) / F.least(area(a), area(b))


def iou_family(a: Box, b: Box, kind: str = "iou", eps: float = EPS) -> Column:
    """IoU, or with the penalties of the enclosing box (giou), the centres (diou) and the aspect ratios (ciou)."""
    i, w1, h1, w2, h2 = inter_area(a, b), a.c - a.a, a.d - a.b + eps, b.c - b.a, b.d - b.b + eps
    u = w1 * h1 + w2 * h2 - i + eps
    base = i / u
    if kind == "iou":
        return base
    cw, ch = F.greatest(a.c, b.c) - F.least(a.a, b.a), F.greatest(a.d, b.d) - F.least(a.b, b.b)
    if kind == "giou":
        c = cw * ch + eps
        return base - (c - u) / c
    rho = ((b.a + b.c - a.a - a.c) ** 2 + (b.b + b.d - a.b - a.d) ** 2) / 4
    diou = rho / (cw * cw + ch * ch + eps)
    if kind == "diou":
        return base - diou
    v = (4 / pi**2) * (F.atan(w2 / h2) - F.atan(w1 / h1)) ** 2
    return base - (diou + v * (v / (v - base + (1 + eps))))


def fuse_score(cost: Column, score: Column) -> Column:
    """J33."""
    return 1 - (1 - cost) * score


# Rotated boxes: centre, size and angle.


class Rotated(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column
    r: Column


def corners(b: Rotated) -> list[Column]:
    """The four corners as x, y in turn."""
    c, s = F.cos(b.r), F.sin(b.r)
    u, v = (b.w / 2 * c, b.w / 2 * s), (-b.h / 2 * s, b.h / 2 * c)
    signs = ((1, 1), (1, -1), (-1, -1), (-1, 1))
    return [p for i, j in signs for p in (b.x + i * u[0] + j * v[0], b.y + i * u[1] + j * v[1])]


def regularize(b: Rotated) -> Rotated:
    """The angle in [0, pi / 2), sides exchanged where it turns by a quarter."""
    turned = F.pmod(b.r, F.lit(pi)) >= pi / 2
    return Rotated(b.x, b.y, F.when(turned, b.h).otherwise(b.w), F.when(turned, b.w).otherwise(b.h), F.pmod(b.r, F.lit(pi / 2)))


def covariance(b: Rotated) -> tuple[Column, Column, Column]:
    """The Gaussian of a rotated box."""
    a, d, c, s = b.w**2 / 12, b.h**2 / 12, F.cos(b.r), F.sin(b.r)
    return a * c**2 + d * s**2, a * s**2 + d * c**2, (a - d) * c * s


def prob_iou(p: Rotated, q: Rotated, eps: float = EPS) -> Column:
    """One less the Hellinger distance of the boxes' Gaussians."""
    (a1, b1, c1), (a2, b2, c2) = covariance(p), covariance(q)
    a, b, c = a1 + a2, b1 + b2, c1 + c2
    det = a * b - c**2
    t1 = (a * (p.y - q.y) ** 2 + b * (p.x - q.x) ** 2) / (det + eps) * 0.25
    t2 = c * (q.x - p.x) * (p.y - q.y) / (det + eps) * 0.5
    inner = F.greatest(a1 * b1 - c1**2, F.lit(0.0)) * F.greatest(a2 * b2 - c2**2, F.lit(0.0))
    t3 = F.log(det / (4 * F.sqrt(inner) + eps) + eps) * 0.5
    bd = clamp(t1 + t2 + t3, eps, 100.0)
    return 1 - F.sqrt(1 - F.exp(-bd) + eps)


# Georeference: ul_x, x_res, x_rot, ul_y, y_rot, y_res.


def pixel_to_geo(x: Column, y: Column, g: tuple[float, ...]) -> tuple[Column, Column]:
    """P55."""
    return g[0] + x * g[1] + y * g[2], g[3] + x * g[4] + y * g[5]


def geo_to_pixel(gx: Column, gy: Column, g: tuple[float, ...]) -> tuple[Column, Column]:
    """The inverse; without rotation where the matrix has none."""
    det = g[1] * g[5] - g[2] * g[4]
    dx, dy = gx - g[0], gy - g[3]
    if abs(det) < 1e-10:
        return dx / g[1] if g[1] else dx * 0, dy / g[5] if g[5] else dy * 0
    return (g[5] * dx - g[2] * dy) / det, (g[1] * dy - g[4] * dx) / det
