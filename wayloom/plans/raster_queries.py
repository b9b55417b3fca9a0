"""Raster operators over grids made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import geometry as G
from wayloom.operators import raster as R
from wayloom.registry import query


@query(
    "composite_max",
    """WITH s AS (SELECT event_id AS prop, event_id % 40 AS px, event_id * 7 % (SELECT max(p_partkey) // 40 + 1 FROM part) AS py, event_id % 256 AS rgb, CAST(floor(value) AS BIGINT) % 50 AS depth FROM events), base AS (SELECT p_partkey % 40 AS px, p_partkey // 40 AS py, 40 AS rgb FROM part),
t AS (SELECT px, py, arg_max(rgb, (depth, -prop)) AS top FROM s WHERE depth > 0 GROUP BY px, py) SELECT b.px, b.py, coalesce(t.top, b.rgb) AS rgb FROM base b LEFT JOIN t ON t.px = b.px AND t.py = b.py""",
)
def composite_max(table):
    k = F.col("p_partkey")
    rows = F.broadcast(table("part").agg((F.floor(F.max("p_partkey") / 40) + 1).alias("rows")))
    base = table("part").select((k % 40).alias("px"), F.floor(k / 40).alias("py"), F.lit(40).cast("bigint").alias("rgb"))
    e = F.col("event_id")
    sprites = table("events").crossJoin(rows).select(e.alias("prop"), (e % 40).alias("px"), (e * 7 % F.col("rows")).alias("py"), (e % 256).alias("rgb"), (F.floor("value") % 50).alias("depth"))
    return R.composite(base, sprites)


def grid(table):
    """Heights of a 50-wide grid from parts."""
    k = F.col("p_partkey")
    return table("part").select((k % 50).alias("x"), F.floor(k / 50).alias("y"), F.col("p_size").cast("bigint").alias("z"))


GRID = "g AS (SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, CAST(p_size AS BIGINT) AS z FROM part)"


@query("mip_reduce", f"WITH {GRID} SELECT x // 2 AS x, y // 2 AS y, CAST((sum(z) + 2) // 4 AS BIGINT) AS z FROM g GROUP BY 1, 2")
def mip_reduce(table):
    return R.halved(grid(table), [], "x", "y", ["z"])


D = f"{GRID}, d AS (SELECT *, coalesce(lead(z) OVER (PARTITION BY y ORDER BY x), z) - coalesce(lag(z) OVER (PARTITION BY y ORDER BY x), z) AS dx, coalesce(lead(z) OVER (PARTITION BY x ORDER BY y), z) - coalesce(lag(z) OVER (PARTITION BY x ORDER BY y), z) AS dy FROM g)"


@query("terrain_normals", f"WITH {D} SELECT x, y, dx, dy, round(40.0 / sqrt(dx * dx + dy * dy + 1600.0), 6) AS nz, round(0.4 + 0.6 * greatest(0, (-dx * -0.5 + -dy * 0.5 + 40.0 * 0.7071) / sqrt(dx * dx + dy * dy + 1600.0)), 6) AS shade FROM d")
def terrain_normals(table):
    rows = R.normals(R.differences(grid(table), [], "x", "y", "z"), 20.0)
    return rows.select("x", "y", "dx", "dy", F.round("nz", 6).alias("nz"), F.round(G.shade(F.col("nx"), F.col("ny"), F.col("nz")), 6).alias("shade"))


@query(
    "slope_classes",
    f"""WITH {D}, a AS (SELECT *, degrees(acos(40.0 / sqrt(dx * dx + dy * dy + 1600.0))) AS angle FROM d)
SELECT x, y, CASE WHEN x % 3 = 0 AND z > 40 THEN 'water' WHEN angle < CASE WHEN y % 2 < 1 THEN 35 ELSE 45 END THEN 'flat' WHEN angle < CASE WHEN y % 2 < 1 THEN 40 ELSE 50 END THEN 'walkable' WHEN angle < CASE WHEN y % 2 < 1 THEN 45 ELSE 55 END THEN 'steep' ELSE 'blocked' END AS class FROM a""",
)
def slope_classes(table):
    rows = R.normals(R.differences(grid(table), [], "x", "y", "z"), 20.0)
    c = F.col
    return rows.select("x", "y", R.slope_class(c("nx"), c("ny"), c("nz"), c("z"), c("x") % 3 == 0, c("y") % 2 + 1).alias("class"))


@query("color_average", "SELECT p_brand, CAST(coalesce(sum(p_size * (p_partkey % 4)) / nullif(sum(p_partkey % 4), 0), 0) AS DOUBLE) AS p_size, avg(p_partkey % 4) AS alpha FROM part GROUP BY p_brand")
def color_average(table):
    rows = table("part").select("p_brand", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 4).alias("alpha"))
    return R.weighted_average(rows, ["p_brand"], "alpha", ["p_size"])


@query("elevation_ranks", "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, CAST(round((p_retailprice - lo) / (hi - lo) * 254) AS INT) + 1 AS rank FROM part, e")
def elevation_ranks(table):
    return R.ranks(table("part").select("p_partkey", "p_retailprice"), "p_retailprice", levels=255).select("p_partkey", "rank")


@query(
    "triangle_pixels",
    """WITH t AS (SELECT n_nationkey AS tri_id, CAST(n_nationkey * 7 % 40 AS DOUBLE) AS ax, CAST(n_nationkey * 3 % 30 AS DOUBLE) AS ay, CAST(n_nationkey * 7 % 40 + 8 AS DOUBLE) AS bx, CAST(n_nationkey * 3 % 30 + n_nationkey % 4 AS DOUBLE) AS by_, CAST(n_nationkey * 7 % 40 + n_nationkey % 3 AS DOUBLE) AS cx, CAST(n_nationkey * 3 % 30 + 8 AS DOUBLE) AS cy FROM nation),
p AS (SELECT t.*, px, py, px + 0.5::DOUBLE AS qx, py + 0.5::DOUBLE AS qy FROM t, range(0, 60) x(px), range(0, 50) y(py)), w AS (SELECT *, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS area FROM p)
SELECT tri_id, CAST(px AS INT) AS px, CAST(py AS INT) AS py FROM w WHERE area <> 0 AND ((bx - ax) * (qy - ay) - (by_ - ay) * (qx - ax)) / area >= 0 AND ((cx - bx) * (qy - by_) - (cy - by_) * (qx - bx)) / area >= 0 AND ((ax - cx) * (qy - cy) - (ay - cy) * (qx - cx)) / area >= 0""",
)
def triangle_pixels(table):
    k = F.col("n_nationkey")
    d = lambda c: c.cast("double")
    x, y = (k * 7) % 40, (k * 3) % 30
    tris = table("nation").select(k.alias("tri_id"), d(x).alias("ax"), d(y).alias("ay"), F.lit(0.0).alias("az"), d(x + 8).alias("bx"), d(y + k % 4).alias("by"), F.lit(1.0).alias("bz"), d(x + k % 3).alias("cx"), d(y + 8).alias("cy"), F.lit(2.0).alias("cz"))
    return R.triangles(tris).select("tri_id", "px", "py")
