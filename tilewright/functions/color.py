"""Colour expressions: HSV, optical density, stain deconvolution, alpha and hexadecimal colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct h (degrees), s, v; grey has h = s = 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    sector = F.when(r >= top, (g - b) / delta).when(g >= top, 2.0 + (b - r) / delta).otherwise(4.0 + (r - g) / delta) * 60.0
    grey = (delta < 0.00001) | (top <= 0)
    h = F.when(grey, 0.0).otherwise(F.when(sector < 0, sector + 360.0).otherwise(sector))
    return F.struct(h.alias("h"), F.when(grey, 0.0).otherwise(delta / top).alias("s"), top.cast("double").alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Struct r, g, b by the six sectors of the hue circle."""
    hh = F.when(h >= 360.0, 0.0).otherwise(h) / 60.0
    i, f = F.floor(hh), hh - F.floor(hh)
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))

    def pick(*six: Column) -> Column:
        out = F.when(s <= 0, v)
        for k, c in enumerate(six[:5]):
            out = out.when(i == k, c)
        return out.otherwise(six[5])

    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


def optical_density(value: Column) -> Column:
    return -F.log(value / 255.0)


# Default stain vectors (haematoxylin, eosin, the third unspecified).
HE = ((0.644211, 0.716556, 0.266844), (0.092789, 0.954111, 0.283111), (0.0, 0.0, 0.0))


def stain_matrix(stains: tuple[tuple[float, float, float], ...] = HE) -> list[float]:
    """Nine factors, three for each stain: the inverse of the matrix of unit stain vectors.

    A missing second stain is the first one rotated by a channel, a missing third one is the complement of both; zeros become 0.001.
    """
    rows = []
    for v in (*stains, (0.0,) * 3, (0.0,) * 3)[:3]:
        n = math.sqrt(sum(c * c for c in v))
        rows.append([c / n if n else 0.0 for c in v])
    if not any(rows[1]):
        rows[1] = [rows[0][2], rows[0][0], rows[0][1]]
    if not any(rows[2]):
        rows[2] = [math.sqrt(max(0.0, 1.0 - a * a - b * b)) for a, b in zip(rows[0], rows[1], strict=True)]
    n = math.sqrt(sum(c * c for c in rows[2]))
    rows[2] = [c / n for c in rows[2]]
    m = [[c or 0.001 for c in row] for row in rows]
    cof = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * cof(0, j) for j in range(3))
    # densities = amounts x rows, so amounts = densities x inverse; column k of the inverse belongs to stain k
    return [cof(k, c) / det for k in range(3) for c in range(3)]


def color_deconvolution(r: Column, g: Column, b: Column, stain: int = 0, stains: tuple = HE, global_od: float = 0.25, channel_od: tuple[float, float, float] = (0.2, 0.2, 0.2)) -> Column:
    """Amount of one stain; 0 where a channel is 0, the densities do not pass their gates, or it is negative."""
    q = stain_matrix(stains)[3 * stain : 3 * stain + 3]
    od = [optical_density(c) for c in (r, g, b)]
    gate = ((od[0] + od[1] + od[2]) / 3.0 > global_od)
    for d, limit in zip(od, channel_od, strict=True):
        gate = gate & (d > limit)
    some = (r != 0) & (g != 0) & (b != 0)
    return F.when(some & gate, F.greatest(F.lit(0.0), od[0] * q[0] + od[1] * q[1] + od[2] * q[2])).otherwise(0.0)


def flatten_alpha(value: Column, alpha: Column, background: Column) -> Column:
    """255 keeps the value, 0 gives the background, anything else is un-premultiplied."""
    return F.when(alpha == 255, value).when(alpha == 0, background).otherwise(F.least(F.lit(255), F.floor(value * 255 / alpha))).cast("int")


def hex_channels(color: Column) -> Column:
    """Struct r, g, b of a hexadecimal colour with or without #."""
    n = F.conv(F.right(color, F.lit(6)), 16, 10).cast("int")
    return F.struct(F.shiftright(n, 16).alias("r"), F.shiftright(n, 8).bitwiseAND(255).alias("g"), n.bitwiseAND(255).alias("b"))


def int_to_hex(color: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(color)), 6, "0"))
