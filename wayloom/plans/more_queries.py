"""Further operators over the driver's tables: filters, upserts, layers, tags, lookups, texels, node walks, codecs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from wayloom.functions import geometry as G
from wayloom.functions import text as T
from wayloom.operators import catalog as C
from wayloom.operators import raster as R
from wayloom.operators import zones as Z
from wayloom.plans.spatial_queries import MESH, inside, mesh
from wayloom.registry import query


@query("viewer_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(CAST(p_partkey AS VARCHAR), '77') OR contains(lower(p_type), 'ring')")
def viewer_filter(table):
    """The viewer's filter: a substring of a name, number or kind, in any case, not trimmed."""
    q = F.lit("ring")
    return table("part").where(F.contains(F.lower("p_name"), q) | F.contains(F.col("p_partkey").cast("string"), F.lit("77")) | F.contains(F.lower("p_type"), q)).select("p_partkey", "p_name")


@query("upsert_rows", "WITH n AS (SELECT s_suppkey * 2 AS k, s_name AS name FROM supplier) SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT k FROM n) UNION ALL SELECT k, name FROM n")
def upsert_rows(table):
    return C.upsert(table("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), table("supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_name").alias("name")), ["k"])


@query("set_flag", "SELECT p_partkey, CASE WHEN p_partkey = 17 THEN true WHEN p_size % 3 = 0 THEN false END AS is_map FROM part")
def set_flag(table):
    return C.set_flag(table("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, False).alias("is_map")), "p_partkey", 17, "is_map", True)


@query(
    "zone_layers",
    """WITH l AS (SELECT l_orderkey AS def_id, l_linenumber AS layer, count(*) AS model_count FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(model_count) OVER (PARTITION BY def_id ORDER BY layer) - model_count AS start FROM l),
m AS (SELECT l_orderkey AS def_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS cum_p FROM lineitem)
SELECT s.def_id, s.layer, m.pos, cum_p - coalesce(lag(cum_p) OVER (PARTITION BY s.def_id, s.layer ORDER BY m.pos), 0) AS p FROM s JOIN m ON m.def_id = s.def_id AND m.pos >= s.start AND m.pos < s.start + s.model_count""",
)
def zone_layers(table):
    """Each layer's models by slices of a running offset, with their own share of the summed probability."""
    from pyspark.sql import Window

    li = table("lineitem")
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    layers = li.groupBy(F.col("l_orderkey").alias("def_id"), F.col("l_linenumber").alias("layer")).agg(F.count(F.lit(1)).alias("model_count"))
    models = li.select(F.col("l_orderkey").alias("def_id"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_p"))
    return Z.layer_models(layers, models, ["def_id"]).select("def_id", "layer", "pos", "p")


@query("orphan_zones", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def orphan_zones(table):
    zones = table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("def_id"), F.lit(0).alias("map_id"))
    return Z.orphans(zones, table("part").where("p_size > 25").select(F.col("p_partkey").alias("def_id"), F.lit(0).alias("map_id")), ["map_id"]).select("l_orderkey", "l_linenumber")


@query("zones_per_definition", "SELECT p_partkey AS def_id, count(l_orderkey) AS n FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 40) l ON l.l_partkey = p_partkey GROUP BY p_partkey")
def zones_per_definition(table):
    zones = table("lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("def_id"), F.lit(0).alias("map_id"))
    return Z.zones_per_definition(table("part").select(F.col("p_partkey").alias("def_id"), F.lit(0).alias("map_id")), zones, ["map_id"]).select("def_id", "n")


@query("required_models", "SELECT l_suppkey AS model, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem WHERE CAST(l_quantity AS INT) % 2 = 0 GROUP BY 1")
def required_models(table):
    props = table("lineitem").select(F.lit(0).alias("map_id"), F.col("l_suppkey").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").cast("int").alias("flags"))
    return Z.required(props, ["map_id"]).select("model", "first")


@query("mission_tags", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 10000 AS INT) END AS map_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 10000 IN (3, 9, 300) THEN 'own' ELSE 'other map' END WHEN event_id % 3 = 1 THEN 'named' ELSE 'unnamed' END AS class FROM events")
def mission_tags(table):
    """Points by their tags: own spawn, another map's id, a name, none."""
    k = F.col("event_id")
    tag = F.when(k % 3 == 0, F.lpad((k % 10000).cast("string"), 4, "0")).when(k % 3 == 1, F.lit("vale")).otherwise("")
    m = T.map_id(F.col("tag"))
    kind = F.when(m.isin(3, 9, 300), "own").when(m.isNotNull(), "other map").when(F.col("tag") != "", "named").otherwise("unnamed")
    return table("events").select("event_id", tag.alias("tag")).select("event_id", m.alias("map_id"), kind.alias("class"))


@query("path_parts", r"WITH u AS (SELECT page_id, 'Missions\' || replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/', '\') || '\Zones\Rocks.' || CASE WHEN page_id % 3 = 0 THEN 'ini' WHEN page_id % 3 = 1 THEN 'INI' ELSE 'Ini' END AS p FROM pages) SELECT page_id, substr(p, 1, length(p) - 16) AS folder, CASE WHEN page_id % 3 < 2 THEN 'Rocks' ELSE 'Rocks.Ini' END AS stem, substr(p, 10) AS short FROM u")
def path_parts(table):
    k = F.col("page_id")
    path = F.concat(F.lit("Missions\\"), F.translate(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), "/", "\\"), F.lit("\\Zones\\Rocks."), F.when(k % 3 == 0, "ini").when(k % 3 == 1, "INI").otherwise("Ini"))
    return table("pages").select("page_id", path.alias("p")).select("page_id", T.folder(F.col("p")).alias("folder"), T.stem(F.col("p")).alias("stem"), T.short_folder(F.col("p")).alias("short"))


@query("nibbles", "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 256 AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, v & 15 AS low, v >> 4 AS high FROM b")
def nibbles(table):
    rows = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array((F.col("l_partkey") % 256)).alias("b")).withColumn("n", Z.nibbles("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("n")[0].alias("low"), F.col("n")[1].alias("high"))


@query(
    "bilinear_samples",
    """WITH n AS (SELECT max(p_partkey) // 10 + 1 AS high FROM part), p AS (SELECT s_suppkey AS point_id, (s_suppkey % 16) / 16.0::DOUBLE AS u, (s_suppkey % 64) / 64.0::DOUBLE AS v FROM supplier), f AS (SELECT *, u * 10 - 0.5 AS fx, v * high - 0.5 AS fy FROM p, n), t AS (SELECT p_partkey % 10 AS tx, p_partkey // 10 AS ty, CAST(p_size AS DOUBLE) AS c FROM part),
k AS (SELECT point_id, fx - floor(fx) AS ax, fy - floor(fy) AS ay, CAST(floor(fx) + i + 10 AS BIGINT) % 10 AS tx, CAST(floor(fy) + j + high AS BIGINT) % high AS ty, i, j FROM f, range(2) a(i), range(2) b(j))
SELECT point_id, round(sum(c * (CASE WHEN i = 1 THEN ax ELSE 1 - ax END) * (CASE WHEN j = 1 THEN ay ELSE 1 - ay END)), 6) AS c FROM k JOIN t ON t.tx = k.tx AND t.ty = k.ty GROUP BY point_id""",
)
def bilinear_samples(table):
    """Samples of one texture that all parts make up, ten texels wide."""
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    pts = table("supplier").select(k.alias("point_id"), ((k % 16) / 16).alias("u"), ((k % 64) / 64).alias("v"))
    texels = table("part").select((p % 10).alias("tx"), F.floor(p / 10).alias("ty"), F.col("p_size").cast("double").alias("c"))
    high = table("part").agg(F.floor(F.max("p_partkey") / 10) + 1).head()[0] or 1
    return R.bilinear(pts, texels, 10, high, ["c"]).select("point_id", F.round("c", 6).alias("c"))


@query("chunk_major", "SELECT x, y, (y // 32 * 8 + x // 32) * 1024 + y % 32 * 32 + x % 32 AS place FROM (SELECT p_partkey % 256 AS x, p_partkey * 7 % 128 AS y FROM part)")
def chunk_major(table):
    rows = table("part").select((F.col("p_partkey") % 256).alias("x"), (F.col("p_partkey") * 7 % 128).alias("y"))
    return rows.select("x", "y", R.chunk_major(F.col("x"), F.col("y"), 256).alias("place"))


@query("quantized", "SELECT event_id, CAST(trunc((value - 100) / 0.01::DOUBLE) AS DOUBLE) * 0.01::DOUBLE AS q, CASE WHEN value - 100 < 0 THEN CAST(ceil(value - 100 - 0.5) AS INT) ELSE CAST(floor(value - 100 + 0.5) AS INT) END AS r FROM events")
def quantized(table):
    v = F.col("value") - 100
    return table("events").select("event_id", G.quantized(v).alias("q"), G.rounded(v).alias("r"))


@query("plane_codec", f"WITH {MESH} SELECT plane, idx, y_top, y_bottom, x_top_left, x_bottom_right FROM mesh")
def plane_codec(table):
    """Each plane's trapezoids written as a path chunk's section and read back; 32-bit floats hold these values."""
    from wayloom.functions import mapfile as M

    keys = ("y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("idx")
        traps = [{"nb": [None] * 4, "portal_left": None, "portal_right": None, **dict(zip(keys, r, strict=True))} for r in rows[list(keys)].itertuples(index=False, name=None)]
        data = M.write_planes([{"start_points": [], "vectors": [], "trapezoids": traps, "root": ("sink", 0), "x_nodes": [], "y_nodes": [], "sinks": [], "portals": [], "portal_traps": []}])
        back = pd.DataFrame(M.planes(data)[0]["trapezoids"])
        return pd.DataFrame({"plane": rows["plane"].to_numpy(), "idx": rows["idx"].to_numpy(), **{k: back[k].to_numpy() for k in ("y_top", "y_bottom", "x_top_left", "x_bottom_right")}})

    return mesh(table).groupBy("plane").applyInPandas(kernel, "plane bigint, idx bigint, y_top double, y_bottom double, x_top_left double, x_bottom_right double")


def location_nodes(traps):
    """The nodes of each plane's location tree, from ``plane:root`` on; a point on a right side is outside."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        from wayloom.functions import meshgen

        traps, plane = [], pdf["plane"].iloc[0]
        for r in pdf.sort_values("idx").itertuples(index=False):
            t = {k: float(getattr(r, k)) for k in ("y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right")}
            traps.append({**t, "idx": r.idx, "left": ((t["x_bottom_left"], t["y_bottom"]), (t["x_top_left"], t["y_top"])), "right": ((t["x_bottom_right"], t["y_bottom"]), (t["x_top_right"], t["y_top"]))})
        tree = meshgen.location_tree(traps)
        name = lambda ref: None if ref is None else f"{plane}:{ref[0]}{ref[1]}"
        rows = [(name(("x", k)), "x", *tree["vectors"][a], *tree["vectors"][b], None, name(lo), name(hi), None) for k, (a, b, lo, hi) in enumerate(tree["x_nodes"])]
        rows += [(name(("y", k)), "y", None, None, None, None, tree["vectors"][v][1], name(below), name(above), None) for k, (v, above, below) in enumerate(tree["y_nodes"])]
        rows += [(name(("sink", k)), "sink", None, None, None, None, None, None, None, traps[i]["idx"]) for k, i in enumerate(tree["sinks"])]
        low, high = tree["span"]
        rows.append((f"{plane}:root", "y", None, None, None, None, low, None, f"{plane}:top", None))
        rows.append((f"{plane}:top", "y", None, None, None, None, math.nextafter(high, math.inf), name(tree["root"]), None, None))
        return pd.DataFrame(rows, columns=["node", "kind", "ax", "ay", "bx", "by", "y", "low", "high", "trap"])

    return traps.groupBy("plane").applyInPandas(kernel, "node string, kind string, ax double, ay double, bx double, by double, y double, low string, high string, trap bigint")


@query(
    "dag_locate",
    f"""WITH {MESH}, q AS (SELECT c_custkey AS query_id, c_custkey % 4 AS plane, (c_custkey * 7919 % 25000) / 100.0::DOUBLE AS x, (c_custkey * 31 % ((SELECT max(p_partkey) FROM part) // 100 * 1000 + 1000)) / 100.0::DOUBLE + 0.005 AS y FROM customer)
SELECT q.query_id, m.idx AS trap FROM q LEFT JOIN (SELECT *, idx // 100 AS row FROM mesh) m ON m.plane = q.plane AND m.row = CAST(floor(q.y / 10) AS BIGINT) AND {inside('0').replace('(y ', '(q.y ').replace(' x ', ' q.x ').replace('q.x <=', 'q.x <')}""",
)
def dag_locate(table):
    """Every customer's point walked down the location tree of its plane's whole mesh."""
    from wayloom.operators.graph import locate_in_dag

    k = F.col("c_custkey")
    height = table("part").agg((F.floor(F.max("p_partkey") / 100) * 1000 + 1000).alias("height"))
    points = table("customer").crossJoin(F.broadcast(height))
    queries = points.select(k.alias("query_id"), ((k * 7919) % 25000 / 100).alias("x"), ((k * 31) % F.col("height") / 100 + 0.005).alias("y"), F.concat((k % 4).cast("string"), F.lit(":root")).alias("node"))
    return locate_in_dag(queries, location_nodes(mesh(table)))
