"""Boxes, poses, lens models and gauges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def box_volume(lo: Vec, hi: Vec) -> Column:
    s = [h - low for low, h in zip(lo, hi)]
    return s[0] * s[1] * s[2]


def box_area(lo: Vec, hi: Vec) -> Column:
    s = [h - low for low, h in zip(lo, hi)]
    return (s[0] * s[1] + s[1] * s[2] + s[2] * s[0]) * 2.0


def boxes_touch(alo: Vec, ahi: Vec, blo: Vec, bhi: Vec) -> Column:
    test = F.lit(True)
    for i in range(3):
        test = test & (alo[i] <= bhi[i]) & (ahi[i] >= blo[i])
    return test


def box_iou(alo: Vec, ahi: Vec, blo: Vec, bhi: Vec) -> Column:
    lo = tuple(F.greatest(a, b) for a, b in zip(alo, blo))
    hi = tuple(F.least(a, b) for a, b in zip(ahi, bhi))
    inter = box_volume(lo, hi)
    union = box_volume(alo, ahi) + box_volume(blo, bhi) - inter
    return F.when(boxes_touch(alo, ahi, blo, bhi) & (union > 0), inter / union).otherwise(F.lit(0.0))


def rect_intersection(a: tuple, b: tuple) -> dict[str, Column]:
    """Overlap of (x, y, w, h) rectangles; all null when empty."""
    x1, y1 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    x2, y2 = F.least(a[0] + a[2], b[0] + b[2]), F.least(a[1] + a[3], b[1] + b[3])
    hit = (x2 > x1) & (y2 > y1)
    return {n: F.when(hit, v) for n, v in (("x", x1), ("y", y1), ("w", x2 - x1), ("h", y2 - y1))}


def brown_conrady(x: Column, y: Column, k=(0.0,) * 8) -> tuple[Column, Column]:
    """Coefficients in the order k1 k2 p1 p2 k3 k4 k5 k6."""
    k1, k2, p1, p2, k3, k4, k5, k6 = (tuple(k) + (0.0,) * 8)[:8]
    r2 = x * x + y * y
    r4 = r2 * r2
    r6 = r4 * r2
    num = 1.0 + k1 * r2 + k2 * r4 + k3 * r6
    den = 1.0 + k4 * r2 + k5 * r4 + k6 * r6
    radial = F.when(F.abs(den) > 1e-12, num / den).otherwise(num)
    return (x * radial + 2.0 * p1 * x * y + p2 * (r2 + 2.0 * x * x),
            y * radial + p1 * (r2 + 2.0 * y * y) + 2.0 * p2 * x * y)


def fisheye(x: Column, y: Column, k=(0.0,) * 4) -> tuple[Column, Column]:
    k1, k2, k3, k4 = (tuple(k) + (0.0,) * 4)[:4]
    r = F.sqrt(x * x + y * y)
    th = F.atan(r)
    t2 = th * th
    t4 = t2 * t2
    bent = th * (1.0 + k1 * t2 + k2 * t4 + k3 * t4 * t2 + k4 * t4 * t4)
    scale = F.when(r < 1e-12, F.lit(1.0)).otherwise(bent / r)
    return x * scale, y * scale


def undistort(df, x: str, y: str, model, k, steps: int = 8):
    """Fixed-point inverse; each step is a projection, so the plan stays linear."""
    df = df.withColumns({"_ux": F.col(x), "_uy": F.col(y)})
    for _ in range(steps):
        dx, dy = model(F.col("_ux"), F.col("_uy"), k)
        df = df.withColumns({"_dx": dx, "_dy": dy}).withColumns(
            {"_ux": F.col("_ux") + F.col(x) - F.col("_dx"), "_uy": F.col("_uy") + F.col(y) - F.col("_dy")})
    return df.drop("_dx", "_dy")


def rotate(q: tuple, p: Vec) -> Vec:
    """Rotate by a unit quaternion (w, x, y, z)."""
    w, a, b, c = q
    tx, ty, tz = 2 * (b * p[2] - c * p[1]), 2 * (c * p[0] - a * p[2]), 2 * (a * p[1] - b * p[0])
    return (p[0] + w * tx + (b * tz - c * ty),
            p[1] + w * ty + (c * tx - a * tz),
            p[2] + w * tz + (a * ty - b * tx))


def camera_to_world(q: tuple, t: Vec, p: Vec) -> Vec:
    return tuple(a + b for a, b in zip(rotate(q, p), t))


def world_to_camera(q: tuple, t: Vec, p: Vec) -> Vec:
    return rotate((q[0], -q[1], -q[2], -q[3]), tuple(a - b for a, b in zip(p, t)))


def project(p: Vec, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pixel of a camera-space point, null when not in front."""
    front = p[2] > 0
    return F.when(front, fx * p[0] / p[2] + cx), F.when(front, fy * p[1] / p[2] + cy)


def back_project(u, v, depth, fx, fy, cx, cy) -> Vec:
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def shutter_offset(direction: Column, x: Column, y: Column, width: Column, height: Column, readout_ms: Column) -> Column:
    """Seconds from mid-exposure of a pixel under a rolling shutter."""
    readout = F.greatest(readout_ms / 1000.0, F.lit(0.0))
    vertical = direction.isin("top_to_bottom", "bottom_to_top")
    share = F.when(vertical, F.when(height > 1, y / (height - 1.0)).otherwise(F.lit(0.0))).otherwise(
        F.when(width > 1, x / (width - 1.0)).otherwise(F.lit(0.0)))
    sign = F.when(direction.isin("bottom_to_top", "right_to_left"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when((readout <= 0) | (width == 0) | (height == 0), F.lit(0.0)).otherwise(sign * (share - 0.5) * readout)


def pick_lod(scales: Column, minimum: Column) -> Column:
    """First log scale whose size reaches the minimum, else the last."""
    return F.coalesce(F.get(F.filter(scales, lambda s: F.exp(s) >= minimum), F.lit(0)), F.element_at(scales, -1))
