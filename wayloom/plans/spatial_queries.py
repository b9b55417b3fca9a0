"""Spatial operators over meshes, polygons and points made of the driver's tables; coordinates are exact in binary."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import geometry as G
from wayloom.operators import spatial as S
from wayloom.registry import query


def mesh(table):
    """Four planes of trapezoids, 25 to a row."""
    k, z = F.col("p_partkey"), F.col("p_size")
    col, row = F.floor(k / 4) % 25, F.floor(k / 100)
    d = lambda c: c.cast("double")
    return table("part").select(
        (k % 4).alias("plane"), k.alias("idx"), d(row * 10).alias("y_bottom"), d(row * 10 + 10).alias("y_top"), d(col * 10).alias("x_bottom_left"), d(col * 10 + 9).alias("x_bottom_right"),
        d(col * 10 + z % 3).alias("x_top_left"), d(col * 10 + 9 - z % 2).alias("x_top_right"),
    )


MESH = """mesh AS (SELECT p_partkey % 4 AS plane, p_partkey AS idx, CAST(p_partkey // 100 * 10 AS DOUBLE) AS y_bottom, CAST(p_partkey // 100 * 10 + 10 AS DOUBLE) AS y_top, CAST(p_partkey // 4 % 25 * 10 AS DOUBLE) AS x_bottom_left,
  CAST(p_partkey // 4 % 25 * 10 + 9 AS DOUBLE) AS x_bottom_right, CAST(p_partkey // 4 % 25 * 10 + p_size % 3 AS DOUBLE) AS x_top_left, CAST(p_partkey // 4 % 25 * 10 + 9 - p_size % 2 AS DOUBLE) AS x_top_right FROM part)"""


def points(table):
    k = F.col("c_custkey")
    return table("customer").select(k.alias("point_id"), (F.floor((k * 7919) % 25000 / 25) / 4).alias("x"), (F.floor((k * 104729) % 20000 / 25) / 4).alias("y"), (k % 4).alias("plane"))


POINTS = "points AS (SELECT c_custkey AS point_id, floor((c_custkey * 7919) % 25000 / 25) / 4 AS x, floor((c_custkey * 104729) % 20000 / 25) / 4 AS y, c_custkey % 4 AS plane FROM customer)"
_Y = "greatest(y_bottom, least(y_top, y))"
_L = f"(x_bottom_left + (x_top_left - x_bottom_left) * (({_Y} - y_bottom) / (y_top - y_bottom)))"
_R = f"(x_bottom_right + (x_top_right - x_bottom_right) * (({_Y} - y_bottom) / (y_top - y_bottom)))"


def inside(tol: str) -> str:
    return f"(y >= y_bottom - {tol} AND y <= y_top + {tol} AND x >= {_L} - {tol} AND x <= {_R} + {tol})"


@query(
    "locate_points",
    f"""WITH {MESH}, {POINTS}, hits AS (SELECT p.point_id, m.plane, m.idx, row_number() OVER (PARTITION BY p.point_id ORDER BY m.plane <> p.plane, m.plane DESC, NOT {inside('0')}, m.idx) AS r FROM points p JOIN mesh m ON {inside('0.02')})
SELECT p.point_id, h.plane, h.idx FROM points p LEFT JOIN hits h ON h.point_id = p.point_id AND r = 1""",
)
def locate_points(table):
    return S.locate(points(table), mesh(table), 16.0)


@query(
    "locate_visible",
    f"""WITH {MESH}, {POINTS}, hits AS (SELECT p.point_id, m.plane, m.idx, row_number() OVER (PARTITION BY p.point_id ORDER BY m.plane <> p.plane, m.plane DESC, m.idx) AS r FROM points p JOIN mesh m ON {inside('0')} WHERE m.plane IN (1, 2))
SELECT p.point_id, h.plane, h.idx FROM points p LEFT JOIN hits h ON h.point_id = p.point_id AND r = 1""",
)
def locate_visible(table):
    m = mesh(table)
    return S.locate_visible(points(table), m, m.where("plane in (1, 2)"), 16.0)


def polygons(table):
    k = F.col("n_nationkey")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (k * 37) % 200, (k * 53) % 160, 16 * (1 + k % 5), 8 * (1 + k % 7)
    return table("nation").select(k.alias("ord"), F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x + w / 2, y + h / 4), p(x, y + h)).alias("vertices"))


POLY = """b AS (SELECT n_nationkey AS ord, CAST(n_nationkey * 37 % 200 AS DOUBLE) AS x, CAST(n_nationkey * 53 % 160 AS DOUBLE) AS y, CAST(16 * (1 + n_nationkey % 5) AS DOUBLE) AS w, CAST(8 * (1 + n_nationkey % 7) AS DOUBLE) AS h FROM nation),
v AS (SELECT ord, 1 AS i, x AS vx, y AS vy FROM b UNION ALL SELECT ord, 2, x + w, y FROM b UNION ALL SELECT ord, 3, x + w, y + h FROM b UNION ALL SELECT ord, 4, x + w / 2, y + h / 4 FROM b UNION ALL SELECT ord, 5, x, y + h FROM b),
e AS (SELECT a.ord, a.vx AS ax, a.vy AS ay, n.vx AS bx, n.vy AS by_ FROM v a JOIN v n ON n.ord = a.ord AND n.i = a.i % 5 + 1)"""


@query("zone_geometry", f"WITH {POLY} SELECT ord, sum(ax * by_ - bx * ay) / 2 AS area, min(ax) AS x0, max(ay) AS y1, round(sum((ax + bx) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)), 6) AS cx, round(sum((ay + by_) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)), 6) AS cy, ord * 1000 * 0.76293945::DOUBLE - 25000 AS height, CASE WHEN ord * 4 >= 76.8 THEN 4 WHEN ord * 4 >= 38.4 THEN 3 WHEN ord * 4 >= 19.2 THEN 2 WHEN ord * 4 >= 9.6 THEN 1 ELSE 0 END AS level FROM e GROUP BY ord")
def zone_geometry(table):
    v = F.col("vertices")
    rows = polygons(table).withColumns({"area": G.signed_area(v), "b": G.bounds(v), "c": G.centroid(v), "height": G.zone_height(F.col("ord") * 1000), "level": G.layer_level(F.col("ord") * 4)})
    return rows.select("ord", "area", F.col("b.x0").alias("x0"), F.col("b.y1").alias("y1"), F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), "height", "level")


@query(
    "point_in_zone",
    f"""WITH {POLY}, {POINTS}, a AS (SELECT ord, abs(sum(ax * by_ - bx * ay) / 2) AS area FROM e GROUP BY ord),
hits AS (SELECT p.point_id, e.ord FROM points p, e WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT point_id, arg_min(ord, (area, ord)) AS ord, min(area) AS area FROM hits JOIN a USING (ord) GROUP BY point_id""",
)
def point_in_zone(table):
    return S.in_smallest_polygon(points(table).drop("plane"), polygons(table), 32.0)


PLACES = "places AS (SELECT s_suppkey AS place_id, CAST(s_suppkey * 613 % 250 AS DOUBLE) AS px, CAST(s_suppkey * 271 % 200 AS DOUBLE) AS py FROM supplier)"


def places(table):
    k = F.col("s_suppkey")
    return table("supplier").select(k.alias("place_id"), ((k * 613) % 250).cast("double").alias("px"), ((k * 271) % 200).cast("double").alias("py"))


@query("nearest_poi", f"WITH {POINTS}, {PLACES}, h AS (SELECT point_id, place_id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM points, places WHERE sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 20) SELECT point_id, arg_min(place_id, (d, place_id)) AS place_id, round(min(d), 6) AS d FROM h GROUP BY point_id")
def nearest_poi(table):
    return S.nearest(points(table).drop("plane"), places(table), 20.0).withColumn("d", F.round("d", 6))


@query(
    "obstacle_cells",
    f"""WITH {PLACES}, o AS (SELECT place_id, px, py, CAST(place_id % 5 * 4 AS DOUBLE) + 4 AS reach FROM places WHERE place_id % 5 <> 0),
c AS (SELECT place_id, unnest(range(greatest(0, least(12, CAST(floor((px - reach) / 20) AS INT))), greatest(0, least(12, CAST(floor((px + reach) / 20) AS INT))) + 1)) AS col, py, reach FROM o WHERE px + reach >= 0 AND px - reach <= 250 AND py + reach >= 0 AND py - reach <= 200),
r AS (SELECT place_id, col, unnest(range(greatest(0, least(9, CAST(floor((200 - py - reach) / 20) AS INT))), greatest(0, least(9, CAST(floor((200 - py + reach) / 20) AS INT))) + 1)) AS row FROM c)
SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, count(*) AS n, string_agg(place_id, ',' ORDER BY place_id) AS ids, CAST(sum(count(*)) OVER (ORDER BY row, col) - count(*) AS BIGINT) AS start FROM r GROUP BY row, col""",
)
def obstacle_cells(table):
    from pyspark.sql import Window

    o = places(table).select(F.col("place_id").alias("id"), F.col("px").alias("x"), F.col("py").alias("y"), (F.col("place_id") % 5 * 4).cast("double").alias("radius"))
    cells = S.obstacle_cells(o, (0.0, 0.0, 250.0, 200.0), 20.0, 4.0)
    # offsets by rows of cells: a sum in each grid row, and one over the grid's few rows
    w = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.groupBy("row").agg(F.sum("n").alias("m"))
    before = rows.alias("a").join(rows.alias("b"), F.col("b.row") < F.col("a.row"), "left").groupBy(F.col("a.row").alias("row")).agg(F.coalesce(F.sum("b.m"), F.lit(0)).alias("base"))
    out = cells.withColumn("own", F.coalesce(F.sum("n").over(w), F.lit(0))).join(before, "row")
    return out.select("row", "col", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), (F.col("base") + F.col("own")).alias("start"))


@query("rect_overlap_tiles", f"WITH {PLACES}, t AS (SELECT p_partkey AS id, CAST(p_partkey * 31 % 250 AS DOUBLE) AS x, CAST(p_partkey * 17 % 200 AS DOUBLE) AS y FROM part) SELECT DISTINCT id AS l_id FROM t, places WHERE x < px + 3 AND px < x + 8 AND y < py + 3 AND py < y + 8")
def rect_overlap_tiles(table):
    k = F.col("p_partkey")
    x, y = ((k * 31) % 250).cast("double"), ((k * 17) % 200).cast("double")
    tiles = table("part").select(k.alias("l_id"), x.alias("lx0"), y.alias("ly0"), (x + 8).alias("lx1"), (y + 8).alias("ly1"))
    p = places(table)
    return S.stale_tiles(tiles, p.select(F.col("place_id").alias("r_id"), F.col("px").alias("rx0"), F.col("py").alias("ry0"), (F.col("px") + 3).alias("rx1"), (F.col("py") + 3).alias("ry1")), 16.0)


SEGS = "s AS (SELECT p_partkey AS id, CAST(p_partkey * 31 % 1000 AS DOUBLE) AS ax, CAST(p_partkey * 17 % 800 AS DOUBLE) AS ay, CAST(p_partkey * 31 % 1000 + p_size - 20 AS DOUBLE) AS bx, CAST(p_partkey * 17 % 800 + p_partkey % 23 - 11 AS DOUBLE) AS by_ FROM part)"


@query(
    "segment_crossings",
    f"""WITH {SEGS}, m AS (SELECT a.id AS a_id, b.id AS b_id, a.ax, a.ay, a.bx - a.ax AS rx, a.by_ - a.ay AS ry, b.bx - b.ax AS sx, b.by_ - b.ay AS sy, b.ax - a.ax AS qx, b.ay - a.ay AS qy FROM s a JOIN s b ON a.id < b.id AND abs(a.ax - b.ax) < 80 AND abs(a.ay - b.ay) < 60),
c AS (SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS u FROM m WHERE rx * sy - ry * sx <> 0) SELECT a_id, b_id, round(ax + rx * t, 4) AS x, round(ay + ry * t, 4) AS y FROM c WHERE t > 0 AND t < 1 AND u > 0 AND u < 1""",
)
def segment_crossings(table):
    k, z = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    segs = table("part").select(k.alias("id"), d((k * 31) % 1000).alias("ax"), d((k * 17) % 800).alias("ay"), d((k * 31) % 1000 + z - 20).alias("bx"), d((k * 17) % 800 + k % 23 - 11).alias("by"))
    return S.crossings(segs, 32.0).select("a_id", "b_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
