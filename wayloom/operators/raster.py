"""Raster operators in long form (one row per sample or pixel): compositing, mip levels, normals, slopes, shading, tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geometry as G

#: Slope limits in degrees by map type: under 2 the gentler ones.
GENTLE, STEEP = (35.0, 40.0, 45.0), (45.0, 50.0, 55.0)


def composite(base: DataFrame, sprites: DataFrame, keys: Sequence[str] = ("px", "py")) -> DataFrame:
    """Each pixel's colour: that of the deepest sprite sample, of equals the earliest sprite's; depth 0 isn't drawn."""
    top = sprites.where("depth > 0").groupBy(*keys).agg(F.max_by("rgb", F.struct("depth", -F.col("prop"))).alias("top"))
    return base.join(top, list(keys), "left").withColumn("rgb", F.coalesce("top", "rgb")).drop("top")


def sprite_pixels(sprites: DataFrame) -> DataFrame:
    """Sprites ``prop, x0, y0, wide, rgb array, depth array`` as pixels."""
    rows = sprites.select("prop", "x0", "y0", "wide", F.posexplode(F.arrays_zip("rgb", "depth")).alias("k", "s"))
    return rows.select("prop", (F.col("x0") + F.col("k") % F.col("wide")).alias("px"), (F.col("y0") + F.floor(F.col("k") / F.col("wide"))).alias("py"), "s.rgb", "s.depth")


def ranks(rows: DataFrame, value: str, keys: Sequence[str] = (), levels: int = 65535) -> DataFrame:
    """Values as whole steps between the least and the greatest: 1 to ``levels``; 0 is left for none."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    wide = rows.join(F.broadcast(ends), list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    step = F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (levels - 1)).otherwise(0.0)
    return wide.withColumn("rank", F.round(step).cast("int") + 1).drop("lo", "hi")


def weighted_average(rows: DataFrame, keys: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """Averages weighed by alpha; without any weight they are 0."""
    total = F.sum(weight)
    return rows.groupBy(*keys).agg(*[F.when(total > 0, F.sum(F.col(v) * F.col(weight)) / total).otherwise(F.lit(0.0)).alias(v) for v in values], F.avg(weight).alias(weight))


def halved(rows: DataFrame, keys: Sequence[str], x: str, y: str, values: Sequence[str]) -> DataFrame:
    """The next mip level: 2 x 2 boxes of whole numbers, (a + b + c + d + 2) / 4 rounded down."""
    box = rows.groupBy(*keys, F.floor(F.col(x) / 2).alias(x), F.floor(F.col(y) / 2).alias(y))
    return box.agg(*[F.floor((F.sum(v) + 2) / 4).alias(v) for v in values])


def differences(rows: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Central differences ``dx, dy`` of a grid; at its edges the nearest sample stands in."""
    wx, wy = Window.partitionBy(*keys, y).orderBy(x), Window.partitionBy(*keys, x).orderBy(y)
    d = lambda w: F.coalesce(F.lead(z).over(w), F.col(z)) - F.coalesce(F.lag(z).over(w), F.col(z))
    return rows.withColumn("dx", d(wx)).withColumn("dy", d(wy))


def normals(rows: DataFrame, spacing: float) -> DataFrame:
    """Unit normals ``nx, ny, nz`` from central differences."""
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + (2 * spacing) ** 2)
    return rows.withColumns({"nx": -F.col("dx") / length, "ny": -F.col("dy") / length, "nz": 2 * spacing / length})


def slope_class(nx: Column, ny: Column, nz: Column, z: Column, water: Column, map_type: Column, sea: float = 40.0) -> Column:
    """``water`` (the flag, below ``sea``), else flat, walkable, steep or blocked by the normal's angle to the upright."""
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), nz))))
    limit = lambda k: F.when(map_type < 2, GENTLE[k]).otherwise(STEEP[k])
    return F.when(water & (z > sea), "water").when(angle < limit(0), "flat").when(angle < limit(1), "walkable").when(angle < limit(2), "steep").otherwise("blocked")


def bilinear(points: DataFrame, texels: DataFrame, wide: int, high: int, values: Sequence[str]) -> DataFrame:
    """Samples at ``u, v`` (0 to 1, wrapped) between four texels ``tx, ty``."""
    fx, fy = F.col("u") * wide - 0.5, F.col("v") * high - 0.5
    at = points.withColumns({"x0": F.floor(fx), "y0": F.floor(fy)}).withColumns({"ax": fx - F.col("x0"), "ay": fy - F.col("y0")})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    four = at.withColumn("__corner", corner).withColumns({"tx": F.pmod(F.col("x0") + F.col("__corner.i"), F.lit(wide)), "ty": F.pmod(F.col("y0") + F.col("__corner.j"), F.lit(high))})
    w = F.when(F.col("__corner.i") == 1, F.col("ax")).otherwise(1 - F.col("ax")) * F.when(F.col("__corner.j") == 1, F.col("ay")).otherwise(1 - F.col("ay"))
    return four.join(texels, ["tx", "ty"]).groupBy("point_id").agg(*[F.sum(F.col(v) * w).alias(v) for v in values])


def chunk_major(x: Column, y: Column, wide: int, chunk: int = 32) -> Column:
    """The place of a sample in an array that is stored chunk by chunk."""
    d = lambda a: F.floor(a / chunk)
    return ((d(y) * (wide // chunk) + d(x)) * chunk * chunk + y % chunk * chunk + x % chunk).cast("bigint")


def triangles(tris: DataFrame) -> DataFrame:
    """Pixels ``tri_id, px, py, z`` of triangles by barycentric coordinates: pixel centres inside, edges included."""
    c = F.col
    area = G.cross(c("bx") - c("ax"), c("by") - c("ay"), c("cx") - c("ax"), c("cy") - c("ay"))
    rows = tris.withColumn("area", area).where("area <> 0")
    span = lambda a: F.sequence(F.floor(F.least(*[f"{n}{a}" for n in "abc"])).cast("int"), F.floor(F.greatest(*[f"{n}{a}" for n in "abc"])).cast("int"))
    rows = rows.withColumn("px", F.explode(span("x"))).withColumn("py", F.explode(span("y"))).withColumns({"qx": c("px") + 0.5, "qy": c("py") + 0.5})
    w = lambda p, q: G.cross(c(f"{q}x") - c(f"{p}x"), c(f"{q}y") - c(f"{p}y"), c("qx") - c(f"{p}x"), c("qy") - c(f"{p}y")) / c("area")
    rows = rows.withColumns({"wc": w("a", "b"), "wa": w("b", "c"), "wb": w("c", "a")}).where("wa >= 0 and wb >= 0 and wc >= 0")
    return rows.select("tri_id", "px", "py", (c("wa") * c("az") + c("wb") * c("bz") + c("wc") * c("cz")).alias("z"))


def alpha_mode(blend: Column) -> Column:
    """How a texture's blend operation is drawn: skipped, cut out at half alpha, or opaque."""
    return F.when(blend.isNull(), "opaque").when(blend.isin(1, 2, 3), "skip").when(blend.isin(4, 5), "cutout").otherwise("opaque")


def flood(cells: DataFrame, seeds: DataFrame, delta: float) -> DataFrame:
    """The triangles that walking from the seeds reaches: ``cells`` are ``tri, nb, angle, nb_angle``, an edge a row.

    A steep neighbour is entered only where the angles differ by less than ``delta``; the set doesn't depend on order.
    """
    from wayloom.operators.graph import reachable

    open_ = cells.where((F.col("nb_class").isin("flat", "walkable")) | ((F.col("nb_class") == "steep") & (F.abs(F.col("nb_angle") - F.col("angle")) < delta)))
    return reachable(open_.select(F.col("tri").alias("src"), F.col("nb").alias("dst")), seeds.select(F.col("tri").alias("node")))


def boundary(cells: DataFrame, visited: DataFrame) -> DataFrame:
    """Edges between a visited triangle and one that isn't.

    The visited may be as many as the triangles, which files tell little of: no join is by broadcast.
    """
    inside = cells.hint("merge").join(visited.select(F.col("node").alias("tri")), "tri", "left_semi")
    return inside.hint("merge").join(visited.select(F.col("node").alias("nb")), "nb", "left_anti").select("tri", "nb")


def mark_block(seeds: DataFrame, reach: int = 2) -> DataFrame:
    """The cells of the square block around each seed ``cx, cy``."""
    span = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))
    return seeds.withColumn("x", span("cx")).withColumn("y", span("cy")).select("x", "y").distinct()


def degrees_of(nz: float) -> float:
    return math.degrees(math.acos(nz))
