"""What viewers, lists and static serving ask of the tables: visibility, extents, labels, floods, paths, checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import geometry as G
from wayloom.functions import text as T
from wayloom.operators import catalog as C
from wayloom.operators import meshes as M
from wayloom.operators import raster as R
from wayloom.operators import zones as Z
from wayloom.operators.graph import shortest_paths
from wayloom.plans.raster_queries import GRID, grid
from wayloom.plans.spatial_queries import MESH, mesh
from wayloom.registry import query


@query("static_paths", r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/a/../' || page_id WHEN 1 THEN '/maps/' WHEN 2 THEN '//x/./' || page_id || '.js?v=1' WHEN 3 THEN './x' WHEN 4 THEN '/..x/y#top' ELSE '/' || replace(url, ':', '') END AS url, url AS whole FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'maps/index.html' WHEN 2 THEN 'x/' || page_id || '.js' WHEN 4 THEN '..x/y' WHEN 5 THEN regexp_replace(regexp_replace(replace(whole, ':', ''), '[?#].*$', ''), '/+', '/', 'g') || CASE WHEN regexp_replace(whole, '[?#].*$', '') LIKE '%/' THEN 'index.html' ELSE '' END END AS path FROM u""")
def static_paths(table):
    """Request paths as paths below the served folder; what would leave it has none."""
    k = F.col("page_id")
    odd = F.when(k % 6 == 0, F.concat(F.lit("/a/../"), k.cast("string"))).when(k % 6 == 1, "/maps/").when(k % 6 == 2, F.concat(F.lit("//x/./"), k.cast("string"), F.lit(".js?v=1")))
    url = odd.when(k % 6 == 3, "./x").when(k % 6 == 4, "/..x/y#top").otherwise(F.concat(F.lit("/"), F.regexp_replace("url", ":", "")))
    return table("pages").select("page_id", T.static_path(url).alias("path"))


@query("visible_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def visible_rows(table):
    hidden = table("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return Z.visible(table("lineitem"), hidden, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("zone_definitions", "WITH d AS (SELECT l_partkey AS def_id, min(l_orderkey * 10 + l_linenumber) AS def_ord FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT o_orderkey, def_ord, CASE WHEN def_ord IS NOT NULL THEN 'p' || def_ord END AS ini_path FROM orders LEFT JOIN d ON d.def_id = o_orderkey % 1000")
def zone_definitions(table):
    """Each zone with the first definition of its id."""
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    defs = table("lineitem").where("l_quantity > 45").select(F.lit(0).alias("map_id"), F.col("l_partkey").alias("def_id"), at.alias("ord"), F.concat(F.lit("p"), at.cast("string")).alias("ini_path"))
    zones = table("orders").select("o_orderkey", F.lit(0).alias("map_id"), (F.col("o_orderkey") % 1000).alias("def_id"))
    return Z.definition_of(zones, defs, ["map_id"]).select("o_orderkey", "def_ord", "ini_path")


@query("alpha_modes", "SELECT p_partkey, CASE WHEN p_size % 8 = 7 THEN 'opaque' WHEN p_size % 8 IN (1, 2, 3) THEN 'skip' WHEN p_size % 8 IN (4, 5) THEN 'cutout' ELSE 'opaque' END AS mode FROM part")
def alpha_modes(table):
    blend = F.when(F.col("p_size") % 8 < 7, F.col("p_size") % 8)
    return table("part").select("p_partkey", R.alpha_mode(blend).alias("mode"))


@query("prop_planes", "SELECT l_partkey AS prop, list_aggregate(list(l_linenumber - 1 ORDER BY l_linenumber), 'string_agg', ' ') AS planes FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def prop_planes(table):
    """The planes that each prop stands on, but for the ground."""
    rows = table("lineitem").select(F.lit(0).alias("map_id"), F.col("l_partkey").alias("prop"), (F.col("l_linenumber") - 1).alias("plane"))
    return Z.prop_planes(rows, ["map_id"]).select("prop", F.array_join(F.transform("planes", lambda p: p.cast("string")), " ").alias("planes"))


@query(
    "mesh_extents",
    f"WITH {MESH} SELECT p.plane, count(idx) AS n, coalesce(min(least(x_top_left, x_bottom_left)), -1000.0) AS x0, coalesce(min(y_bottom), -1000.0) AS y0, coalesce(max(greatest(x_top_right, x_bottom_right)), 1000.0) AS x1, coalesce(max(y_top), 1000.0) AS y1 FROM (SELECT DISTINCT n_nationkey AS plane FROM nation) p LEFT JOIN (SELECT * FROM mesh WHERE idx % 5 <> 0) m ON m.plane = p.plane GROUP BY p.plane",
)
def mesh_extents(table):
    """Trapezoids and finite bounds of every map, some of which are empty; corners that aren't finite don't count."""
    odd = F.col("idx") % 5 == 0
    rows = mesh(table).withColumns({"x_top_left": F.when(odd, F.lit(float("nan"))).otherwise(F.col("x_top_left"))}).where(~odd)
    maps = table("nation").select(F.col("n_nationkey").alias("plane"))
    return M.extents(maps, rows, ["plane"])


@query("polygon_bounds", f"WITH {MESH} SELECT idx, least(x_top_left, x_bottom_left) AS x0, y_bottom AS y0, greatest(x_top_right, x_bottom_right) AS x1, y_top AS y1 FROM mesh")
def polygon_bounds(table):
    b = mesh(table).select("idx", G.corners().alias("v"))
    least, most = (lambda c: F.array_min(F.transform("v", lambda p: p[c]))), (lambda c: F.array_max(F.transform("v", lambda p: p[c])))
    return b.select("idx", least("x").alias("x0"), least("y").alias("y0"), most("x").alias("x1"), most("y").alias("y1"))


@query("instance_names", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'outpost' WHEN 1 THEN 'explorable' END AS instance FROM events")
def instance_names(table):
    k = F.col("event_id") % 4
    return table("events").select("event_id", T.instance(F.when(k == 0, " OutPost ").when(k == 1, "EXPLORABLE").when(k == 2, "out post")).alias("instance"))


@query("zone_labels", "SELECT o_orderkey, 'zone ' || o_orderkey || ': ' || CASE WHEN o_orderkey % 3 = 0 THEN 'no definition' ELSE lower(o_orderpriority) END || ' (' || (o_orderkey % 7) || ' layers)' AS label FROM orders")
def zone_labels(table):
    k = F.col("o_orderkey")
    return table("orders").select("o_orderkey", T.zone_label(k, F.when(k % 3 != 0, F.lower("o_orderpriority")), k % 7).alias("label"))


@query("marked_cells", "SELECT DISTINCT s_suppkey * 7 % 60 + i AS x, s_suppkey * 3 % 40 + j AS y FROM supplier, range(-2, 3) a(i), range(-2, 3) b(j)")
def marked_cells(table):
    k = F.col("s_suppkey")
    return R.mark_block(table("supplier").select((k * 7 % 60).alias("cx"), (k * 3 % 40).alias("cy")))


SIDES = f"{GRID}, c AS (SELECT y * 50 + x AS tri, x, y, z, CASE WHEN z < 38 THEN 'walkable' ELSE 'blocked' END AS class FROM g), e AS (SELECT a.tri, b.tri AS nb, b.class AS nb_class FROM c a JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) = 1)"


def _sides(table):
    """Each cell of the grid with its neighbours to the four sides; cells are as many as parts, too many to broadcast."""
    cells = grid(table).select((F.col("y") * 50 + F.col("x")).alias("tri"), "x", "y", F.when(F.col("z") < 38, "walkable").otherwise("blocked").alias("class"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    there = cells.select("tri", "x", "y", step.alias("d")).select("tri", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"))
    return there.hint("merge").join(cells.select(F.col("tri").alias("nb"), "x", "y", F.col("class").alias("nb_class")), ["x", "y"]).select("tri", "nb", "nb_class", F.lit(0.0).alias("angle"), F.lit(0.0).alias("nb_angle"))


REACHED = f"WITH RECURSIVE {SIDES}, r AS (SELECT tri AS node FROM c WHERE tri % 37 = 0 UNION SELECT e.nb FROM r JOIN e ON e.tri = r.node WHERE nb_class = 'walkable')"


@query("flood_fill", f"{REACHED} SELECT node FROM r")
def flood_fill(table):
    return R.flood(_sides(table), table("part").where("p_partkey % 37 = 0").select(F.col("p_partkey").alias("tri")), 10.0).select("node")


@query("flood_edges", f"{REACHED} SELECT tri, nb FROM e WHERE tri IN (SELECT node FROM r) AND nb NOT IN (SELECT node FROM r)")
def flood_edges(table):
    sides = _sides(table)
    return R.boundary(sides, R.flood(sides, table("part").where("p_partkey % 37 = 0").select(F.col("p_partkey").alias("tri")), 10.0))


@query("first_of_each", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1")
def first_of_each(table):
    """Ordered dedup: of rows with one key the first stays."""
    rows = table("lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return C.first_by_key(rows.withColumn("at", F.col("ord")), ["l_partkey"], "at", ["ord"])


#: CRC-32 by its definition, a bit at a time.
CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c_name, ''), x -> ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"


@query("crc32_names", f"SELECT c_custkey, {CRC} AS crc FROM customer".replace("x -> ascii(x)::BIGINT", "lambda x: ascii(x)::BIGINT"))
def crc32_names(table):
    return table("customer").select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("crc"))


@query("room_routes", """SELECT * FROM (SELECT n_nationkey AS map_id FROM nation), (VALUES (1, NULL, round(2 * sqrt(58.0) + 2, 6), '1,1 4,8 6,8 9,1'), (2, NULL, round(sqrt(5.0), 6), '1,1 3,2'), (3, 'Unreachable', NULL, NULL)) v(request_id, error, length, points)""")
def room_routes(table):
    """Routes in a room of three trapezoids, for every nation: around two corners, straight, and to where no gate leads."""
    t = lambda i, y0, y1, x0, x1: (0, i, float(y1), float(y0), float(x0), float(x1), float(x0), float(x1))
    spark = table("nation").sparkSession
    names = "plane bigint, idx bigint, y_top double, y_bottom double, x_top_left double, x_top_right double, x_bottom_left double, x_bottom_right double"
    room = spark.createDataFrame([t(0, 0, 8, 0, 4), t(1, 0, 8, 6, 10), t(2, 8, 10, 0, 10), t(3, 0, 4, 20, 24)], names)
    gates = spark.createDataFrame([(0, a, 0, b, e, x0, 8.0, x1, 8.0) for a, b, e, x0, x1 in ((0, 2, "top", 0.0, 4.0), (2, 0, "bottom", 0.0, 4.0), (1, 2, "top", 6.0, 10.0), (2, 1, "bottom", 6.0, 10.0))], "plane bigint, src bigint, to_plane bigint, dst bigint, edge string, ax double, ay double, bx double, by double")
    asked = spark.createDataFrame([(1, 1.0, 1.0, 9.0, 1.0), (2, 1.0, 1.0, 3.0, 2.0), (3, 1.0, 1.0, 22.0, 2.0)], "request_id bigint, from_x double, from_y double, to_x double, to_y double").withColumns({"from_plane": F.lit(0).cast("bigint"), "to_plane": F.lit(0).cast("bigint")})
    maps = table("nation").select(F.col("n_nationkey").cast("bigint").alias("map_id"))
    on = lambda df: maps.crossJoin(F.broadcast(df))
    out = shortest_paths(on(room), on(gates), on(asked))
    said = F.array_join(F.transform("points", lambda p: F.format_string("%d,%d", p["x"].cast("int"), p["y"].cast("int"))), " ")
    return out.select("map_id", F.col("request_id").cast("int").alias("request_id"), "error", F.round("length", 6).alias("length"), F.when(F.col("error").isNull(), said).alias("points"))
