"""Geometry as column expressions: points, segments, trapezoids, polygons, grids, colours. No Python runs on rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far outside a trapezoid a point may be and still count as on it.
TOL = 0.02


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def lerp(a, b, t) -> Column:
    return a + (b - a) * t


def side(rx, ry, dx, dy, vx, vy) -> Column:
    """Signed distance of v from the line r to d, positive on the left; 0 if r is d."""
    length = distance(rx, ry, dx, dy)
    return F.when(length == 0, F.lit(0.0)).otherwise(cross(dx - rx, dy - ry, vx - rx, vy - ry) / length)


def segment_distance(vx, vy, ax, ay, bx, by) -> Column:
    n = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((vx - ax) * (bx - ax) + (vy - ay) * (by - ay)) / n)))
    return distance(vx, vy, lerp(ax, bx, t), lerp(ay, by, t))


def _trap(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right")}


def side_x(left: bool, y: Column, prefix: str = "") -> Column:
    """The x of a trapezoid's left or right side at y."""
    t = _trap(prefix)
    h = t["y_top"] - t["y_bottom"]
    f = F.when(h > 0, (y - t["y_bottom"]) / h).otherwise(F.lit(0.0))
    lo, hi = ("x_bottom_left", "x_top_left") if left else ("x_bottom_right", "x_top_right")
    return t[lo] + (t[hi] - t[lo]) * f


def in_trapezoid(x: Column, y: Column, tol: float = 0.0, prefix: str = "") -> Column:
    """Inside a trapezoid, or within ``tol`` of it; edges count."""
    t = _trap(prefix)
    at = F.greatest(t["y_bottom"], F.least(t["y_top"], y))
    return (y >= t["y_bottom"] - tol) & (y <= t["y_top"] + tol) & (x >= side_x(True, at, prefix) - tol) & (x <= side_x(False, at, prefix) + tol)


def corners(prefix: str = "") -> Column:
    t = _trap(prefix)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(t["x_bottom_left"], t["y_bottom"]), p(t["x_bottom_right"], t["y_bottom"]), p(t["x_top_right"], t["y_top"]), p(t["x_top_left"], t["y_top"]))


def _edges(v: Column) -> Column:
    """Each vertex with the next, the last with the first."""
    after = F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    return F.zip_with(v, after, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def _sum(xs: Column, of) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, e: s + of(e))


def signed_area(v: Column) -> Column:
    """Positive counter-clockwise."""
    return _sum(_edges(v), lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2


def bounds(v: Column) -> Column:
    of = lambda f, c: f(F.transform(v, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def centroid(v: Column) -> Column:
    """The centre of area, or of the vertices where there is next to no area."""
    area = signed_area(v)
    part = lambda c: _sum(_edges(v), lambda e: (e[f"a{c}"] + e[f"b{c}"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"])) / (6 * area)
    mean = lambda c: F.try_divide(_sum(v, lambda p: p[c]), F.size(v))
    flat = F.abs(area) < 1e-3
    return F.struct(F.when(flat, mean("x")).otherwise(part("x")).alias("x"), F.when(flat, mean("y")).otherwise(part("y")).alias("y"))


def in_polygon(x: Column, y: Column, v: Column) -> Column:
    """Even-odd rule."""
    crossed = F.filter(_edges(v), lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(e["by"] == e["ay"], 1.0).otherwise(e["by"] - e["ay"]) + e["ax"]))
    return F.size(crossed) % 2 == 1


def zone_height(raw: Column) -> Column:
    return raw * 0.76293945 - 25000


def layer_level(spacing: Column) -> Column:
    """How many of the spacings 9.6, 19.2, 38.4 and 76.8 are not above this one: level of detail 0 to 4."""
    return sum((F.when(spacing >= 9.6 * 2**k, 1).otherwise(0) for k in range(1, 4)), F.when(spacing >= 9.6, 1).otherwise(0))


def facing_radians(facing: Column) -> Column:
    return facing * (2 * math.pi / 65536)


def quantized(v: Column, unit: float = 0.01) -> Column:
    """Cut to whole units, toward zero; what no 32-bit number holds stays at its ends."""
    n = v / unit
    return F.greatest(F.lit(-(2.0**31)), F.least(F.lit(2.0**31 - 1), F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("double"))) * unit


def rounded(v: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.when(v < 0, F.ceil(v - 0.5)).otherwise(F.floor(v + 0.5)).cast("int")


def snapped(v: Column, unit: int = 4) -> Column:
    """Rounded, then cut to a multiple of ``unit`` toward zero, as a signed 16-bit number."""
    n = rounded(v)
    m = (n - n % unit).cast("bigint")
    return (F.pmod(m + 32768, F.lit(65536)) - 32768).cast("double")


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def uv_color(n: Column) -> Column:
    """A hue for each number, spread by the golden ratio: a value from 0 to 1."""
    h = n * 0.618033988749895
    return h - F.floor(h)


def rgb8(c: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(c * 255 + 0.5))).cast("int")


def shade(nx: Column, ny: Column, nz: Column, light: tuple[float, float, float] = (-0.5, 0.5, 0.7071), ambient: float = 0.4) -> Column:
    """Lambert shading of a unit normal."""
    return F.lit(ambient) + (1 - ambient) * F.greatest(F.lit(0.0), nx * light[0] + ny * light[1] + nz * light[2])


def to_pixel(x: Column, y: Column, x0: float, y1: float, scale: float) -> Column:
    return F.struct(((x - x0) * scale).alias("px"), ((y1 - y) * scale).alias("py"))


def to_world(px: Column, py: Column, x0: float, y1: float, scale: float) -> Column:
    return F.struct((px / scale + x0).alias("x"), (y1 - py / scale).alias("y"))


def placed(mx, my, mz, x, y, z, angle, scale) -> Column:
    """A model's point where its prop stands: scaled, turned about the upright, moved."""
    return F.struct((x + (mx * F.cos(angle) - my * F.sin(angle)) * scale).alias("x"), (y + (mx * F.sin(angle) + my * F.cos(angle)) * scale).alias("y"), (z + mz * scale).alias("z"))


def park_miller(seed: Column) -> Column:
    """The next of the multiplicative sequence 48271 modulo 2^31 - 1."""
    return (seed.cast("bigint") * 48271) % 2147483647


def file_ref(w0: Column, w1: Column) -> Column:
    """A base id from the two words of a file reference."""
    return (w0.cast("bigint") - 0xFF00FF) + w1.cast("bigint") * 0xFF00


def node_ref(raw: Column) -> Column:
    """Kind (0 none, 1 x node, 2 y node, 3 sink) in the top two bits and index in the rest."""
    raw = raw.cast("bigint")
    return F.struct(F.shiftrightunsigned(raw.bitwiseAND(0xFFFFFFFF), 30).cast("int").alias("kind"), raw.bitwiseAND(0x3FFFFFFF).alias("idx"))
