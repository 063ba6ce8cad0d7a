"""Colour functions over columns, all native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import BANDS

# Linear sRGB to XYZ (D65) and its white, the luminance weights of linear ProPhoto, and ProPhoto to XYZ (D50), D50 to D65, XYZ to sRGB.
SRGB_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
PROPHOTO_Y = (0.2880402, 0.7118741, 0.0000857)
PROPHOTO_XYZ = ((0.7976749, 0.1351917, 0.0313534), (0.2880402, 0.7118741, 0.0000857), (0.0, 0.0, 0.8252100))
BRADFORD = ((0.9555766, -0.0230393, 0.0631636), (-0.0282895, 1.0099416, 0.0210077), (0.0122982, -0.0204830, 1.3299098))
XYZ_SRGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def product(a: tuple, b: tuple) -> tuple:
    """The product of two 3 x 3 matrices."""
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


PROPHOTO_SRGB = product(product(XYZ_SRGB, BRADFORD), PROPHOTO_XYZ)


def weighted(weights: tuple, channels: list[Column]) -> Column:
    """The sum of channels, each times its weight."""
    return reduce(lambda x, y: x + y, [c * F.lit(w) for w, c in zip(weights, channels, strict=True)])


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Y of linear ProPhoto."""
    return weighted(PROPHOTO_Y, [r, g, b])


def srgb_to_linear(level: Column) -> Column:
    """Linear light of an 8-bit sRGB level."""
    x = level / F.lit(255.0)
    return F.when(x <= 0.04045, x / F.lit(12.92)).otherwise(F.pow((x + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def linear_to_srgb(light: Column) -> Column:
    """sRGB value, 0 to 1, of linear light, which is clipped."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), light))
    return F.when(x <= 0.0031308, x * F.lit(12.92)).otherwise(F.pow(x, F.lit(1 / 2.4)) * F.lit(1.055) - F.lit(0.055))


def prophoto_to_srgb(r: Column, g: Column, b: Column, rounded: bool = True) -> list[Column]:
    """8-bit sRGB of linear ProPhoto, rounded half to even or cut off."""
    level = [linear_to_srgb(weighted(row, [r, g, b])) * F.lit(255.0) for row in PROPHOTO_SRGB]
    return [F.least(F.lit(255), F.greatest(F.lit(0), (F.bround(x, 0) if rounded else F.floor(x)).cast("int"))) for x in level]


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L*, a*, b* of 8-bit sRGB."""
    light = [srgb_to_linear(c) for c in (r, g, b)]
    edge = (6 / 29) ** 3

    def f(t: Column) -> Column:
        return F.when(t > edge, F.pow(t, F.lit(1 / 3))).otherwise(t / F.lit(3 * (6 / 29) ** 2) + F.lit(4 / 29))

    x, y, z = (f(weighted(row, light) / F.lit(w)) for row, w in zip(SRGB_XYZ, WHITE, strict=True))
    return [y * F.lit(116.0) - F.lit(16.0), (x - y) * F.lit(500.0), (y - z) * F.lit(200.0)]


def floor_mod(x: Column, n: float) -> Column:
    """``x`` modulo ``n`` with the sign of ``n``."""
    return x - F.lit(n) * F.floor(x / F.lit(n))


def hue_saturation(r: Column, g: Column, b: Column) -> list[Column]:
    """HSV hue in degrees and saturation of 8-bit sRGB; red goes before green before blue where they tie."""
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    top = F.greatest(r, g, b)
    d = top - F.least(r, g, b)
    e = d + F.lit(1e-9)
    sixth = F.when(top == r, floor_mod((g - b) / e, 6.0)).when(top == g, (b - r) / e + 2.0).otherwise((r - g) / e + 4.0)
    hue = F.when(d <= 1e-6, F.lit(0.0)).otherwise(floor_mod(sixth * 60.0, 360.0))
    return [hue, F.when(top > 1e-6, d / (top + F.lit(1e-9))).otherwise(F.lit(0.0))]


def nearest_band(hue: Column) -> Column:
    """Number (from 0) of the band whose centre is nearest on the circle; the lower one where two tie."""
    away = [F.abs(floor_mod(hue - F.lit(c) + 180.0, 360.0) - 180.0) for _, c in BANDS]
    near = F.least(*away)
    return reduce(lambda rest, i: F.when(away[i] == near, F.lit(i)).otherwise(rest), range(len(BANDS) - 2, -1, -1), F.lit(len(BANDS) - 1))


def hue_difference(a: Column, b: Column) -> Column:
    """``a - b`` on the circle, from -180 up to but without 180."""
    return floor_mod(a - b + 180.0, 360.0) - 180.0
