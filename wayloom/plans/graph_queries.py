"""Graph operators over the mesh made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import graph as G
from wayloom.plans.spatial_queries import MESH, mesh
from wayloom.registry import query


def linked(table):
    """The mesh with neighbours in the rows above and below, the same column and the next."""
    rows = table("part").agg(F.max("p_partkey").alias("last"))
    k = F.col("idx")
    there = lambda n, ok: F.when(ok & (n >= 0) & (n <= F.col("last")), n)
    col = F.floor(k / 4) % 25
    m = mesh(table).crossJoin(F.broadcast(rows)).withColumn("map_id", F.lit(0).cast("bigint"))
    nb = F.array(there(k + 100, F.lit(True)), there(k + 104, col < 24), there(k - 100, F.lit(True)), there(k - 104, col > 0))
    return m.withColumn("nb", nb).drop("last")


GATES = f"""{MESH}, top AS (SELECT max(p_partkey) AS last FROM part), nb AS (SELECT idx, idx + 100 AS o, true AS up FROM mesh UNION ALL SELECT idx, idx + 104, true FROM mesh WHERE idx // 4 % 25 < 24 UNION ALL SELECT idx, idx - 100, false FROM mesh UNION ALL SELECT idx, idx - 104, false FROM mesh WHERE idx // 4 % 25 > 0),
g AS (SELECT h.plane, h.idx AS src, o.idx AS dst, CASE WHEN up THEN 'top' ELSE 'bottom' END AS edge, CASE WHEN up THEN greatest(h.x_top_left, o.x_bottom_left) ELSE greatest(h.x_bottom_left, o.x_top_left) END AS ax, CASE WHEN up THEN h.y_top ELSE h.y_bottom END AS ay,
  CASE WHEN up THEN least(h.x_top_right, o.x_bottom_right) ELSE least(h.x_bottom_right, o.x_top_right) END AS bx FROM nb JOIN mesh h ON h.idx = nb.idx JOIN mesh o ON o.idx = nb.o AND o.plane = h.plane),
gates AS (SELECT * FROM g WHERE bx > ax)"""


@query("neighbour_gates", f"WITH {GATES} SELECT plane, src, dst, edge, ax, ay, bx FROM gates")
def neighbour_gates(table):
    return G.neighbour_gates(linked(table)).select("plane", "src", "dst", "edge", "ax", "ay", "bx")


def portalled(table):
    """The mesh with a portal on each plane's left and right sides, to the next plane and back, by rows."""
    m = linked(table).withColumn("row", F.floor(F.col("idx") / 100))
    first = F.floor(F.col("idx") / 4) % 25 == 0
    last = F.floor(F.col("idx") / 4) % 25 == 24
    m = m.withColumns({"portal_left": F.when(first, F.col("row").cast("int")), "portal_right": F.when(last, F.col("row").cast("int") + 1000)})
    ends = m.where(first | last)
    portals = ends.select("map_id", "plane", F.coalesce("portal_left", "portal_right").cast("bigint").alias("idx"), F.lit(1).cast("bigint").alias("count"), F.col("idx").alias("start"),
                          F.when(first, (F.col("plane") + 3) % 4).otherwise((F.col("plane") + 1) % 4).alias("neighbor_plane"), F.col("row").alias("pair"), F.when(F.col("row") % 6 == 5, 4).otherwise(0).alias("flags"))
    return m, portals, ends.select("map_id", "plane", F.col("idx").alias("pos"), F.col("idx").alias("trap"))


@query(
    "portal_gates",
    f"""WITH {MESH}, e AS (SELECT *, idx // 100 AS row, idx // 4 % 25 = 0 AS first FROM mesh WHERE idx // 4 % 25 IN (0, 24)), p AS (SELECT *, CASE WHEN first THEN (plane + 3) % 4 ELSE (plane + 1) % 4 END AS other FROM e WHERE row % 6 <> 5)
SELECT a.plane, a.idx AS src, b.plane AS to_plane, b.idx AS dst, CASE WHEN a.first THEN 'left' ELSE 'right' END AS edge, CASE WHEN a.first THEN a.x_bottom_left ELSE a.x_bottom_right END AS ax, a.y_bottom AS ay, CASE WHEN a.first THEN a.x_top_left ELSE a.x_top_right END AS bx, a.y_top AS by
FROM p a JOIN p b ON b.plane = a.other AND b.other = a.plane AND b.row = a.row AND b.first <> a.first""",
)
def portal_gates(table):
    return G.portal_gates(*portalled(table)).select("plane", "src", "to_plane", "dst", "edge", "ax", "ay", "bx", "by")


@query(
    "open_angle_corners",
    f"""WITH {GATES}, c AS (SELECT plane, idx, x_bottom_left AS x0, x_bottom_right AS x1, x_top_right AS x2, x_top_left AS x3, y_bottom AS y0, y_top AS y1 FROM mesh),
v AS (SELECT plane, idx, x0 AS x, y0 AS y, x3 - x0 AS ux, y1 - y0 AS uy, x1 - x0 AS vx, 0.0 AS vy FROM c UNION ALL SELECT plane, idx, x1, y0, x0 - x1, 0.0, x2 - x1, y1 - y0 FROM c UNION ALL SELECT plane, idx, x2, y1, x1 - x2, y0 - y1, x3 - x2, 0.0 FROM c UNION ALL SELECT plane, idx, x3, y1, x2 - x3, 0.0, x0 - x3, y0 - y1 FROM c),
a AS (SELECT plane, x, y, atan2(abs(ux * vy - uy * vx), ux * vx + uy * vy) AS angle FROM v UNION ALL SELECT plane, x, y, pi() FROM (SELECT plane, src AS idx, ax AS x, ay AS y FROM gates UNION ALL SELECT plane, src, bx, ay FROM gates) g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.idx = g.idx AND v.x = g.x AND v.y = g.y))
SELECT plane, x, y, round(sum(angle), 6) AS angle FROM a GROUP BY plane, x, y""",
)
def open_angle_corners(table):
    traps = linked(table)
    return G.open_angles(traps, G.neighbour_gates(traps)).select("plane", "x", "y", F.round("angle", 6).alias("angle"))


@query("reachable", f"WITH RECURSIVE {GATES}, r AS (SELECT 0::BIGINT AS node UNION SELECT g.dst FROM r JOIN gates g ON g.src = r.node AND g.bx - g.ax > 2) SELECT node FROM r")
def reachable(table):
    edges = G.neighbour_gates(linked(table)).where("bx - ax > 2").select("src", "dst")
    return G.reachable(edges, table("part").where("p_partkey = 0").select(F.col("p_partkey").alias("node"))).select("node")


@query(
    "gate_dijkstra",
    f"""WITH RECURSIVE {GATES}, e AS (SELECT g.src, g.dst, abs(h.x_bottom_left - o.x_bottom_left) + 10 AS cost FROM gates g JOIN mesh h ON h.idx = g.src JOIN mesh o ON o.idx = g.dst),
r(node, dist) USING KEY (node) AS (SELECT 0::BIGINT, 0::DOUBLE UNION (SELECT e.dst, min(r.dist + e.cost) FROM r JOIN e ON e.src = r.node LEFT JOIN recurring.r q ON q.node = e.dst WHERE q.dist IS NULL OR r.dist + e.cost < q.dist GROUP BY e.dst)) SELECT node, dist FROM r""",
)
def gate_dijkstra(table):
    traps = linked(table)
    gates = G.neighbour_gates(traps)
    at = lambda n: traps.select(F.col("idx").alias(n), F.col("x_bottom_left").alias(f"x_{n}"))
    edges = gates.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (F.abs(F.col("x_src") - F.col("x_dst")) + 10).alias("cost"))
    return G.distances(edges, table("part").where("p_partkey = 0").select(F.col("p_partkey").alias("node")))


@query("shortest_path")
def shortest_path(table):
    """A route for every supplier; each plane of the mesh is a map of its own."""
    traps = linked(table).withColumn("map_id", F.col("plane"))
    gates = G.neighbour_gates(traps)
    k = F.col("s_suppkey")
    asked = table("supplier").select(
        (k % 4).alias("map_id"), k.alias("request_id"), ((k * 7919) % 245 + 2.0).alias("from_x"), ((k * 31) % 190 + 2.0).alias("from_y"), (k % 4).alias("from_plane"),
        ((k * 7919 + k % 9) % 245 + 2.0).alias("to_x"), ((k * 17) % 190 + 2.0).alias("to_y"), (k % 4).alias("to_plane"),
    )
    out = G.shortest_paths(traps, gates, asked)
    return out.select("request_id", "error", F.round("length", 4).alias("length"), F.size("points").alias("n_points"))


@query("mesh_bloat")
def mesh_bloat(table):
    """Meshes of maps whose heights come from a hundred parts each; their sizes, areas and broken rules."""
    from wayloom.operators.meshes import generate, invariants

    k = F.col("p_partkey")
    m, i = F.floor(k / 100), k % 100
    cells = table("part").select(m.alias("map_id"), (i % 10).alias("x"), F.floor(i / 10).alias("y"), (F.col("p_size") * (F.col("p_size") % 3 == 0).cast("int")).cast("double").alias("z"))
    starts = table("part").select(m.alias("map_id")).distinct().crossJoin(F.broadcast(table("region"))).select("map_id", (F.col("r_regionkey") * 2 + 0.25).alias("x"), (F.col("r_regionkey") + 1.25).alias("y"))
    out = invariants(generate(cells, starts, 10.0))
    return out.select("map_id", "n", F.round("area", 4).alias("area"), "bad")
