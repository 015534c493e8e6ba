"""Colour space and tone functions as column expressions (standard sRGB / D65)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ matrix and D65 white point.
SRGB_TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (0.95047, 1.0, 1.08883)


def linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def encode(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def xyz(rgb: tuple) -> tuple:
    return tuple(rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2] for m in SRGB_TO_XYZ)


def lab(p: tuple) -> tuple:
    def bend(t):
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16.0 / 116.0)

    fx, fy, fz = (bend(c / w) for c, w in zip(p, WHITE))
    return 116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)


def delta_e(a: tuple, b: tuple) -> Column:
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b)))


def luma(r, g, b) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b
