"""Mesh graphs: gates between trapezoids, corners, reachability, distances, exact shortest paths.

Gates and angles are joins and sums; walks go through blocks of edges, a kernel call each, and cut their lineage by
checkpoints in the shared folder. The exact path search is a kernel of one map's mesh, run for all its requests by a cogroup.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geometry as G
from wayloom.functions.navmesh import route_requests

TRAP = ["y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right"]


def _side(traps: DataFrame, prefix: str, extra: list[str] = ()) -> DataFrame:
    return traps.select("map_id", "plane", *[F.col(c).alias(f"{prefix}{c}") for c in ("idx", *TRAP, *extra)])


def neighbour_gates(traps: DataFrame) -> DataFrame:
    """``map_id, plane, src, dst, edge, ax, ay, bx, by``: where neighbours above and below share a stretch of side.

    ``nb`` has the neighbours top left, top right, bottom left, bottom right; null is none.
    """
    here = _side(traps, "h_").join(traps.select("map_id", "plane", F.col("idx").alias("h_idx"), F.posexplode("nb").alias("k", "o_idx")), ["map_id", "plane", "h_idx"])
    met = here.where("o_idx is not null").join(_side(traps, "o_"), ["map_id", "plane", "o_idx"])
    top = F.col("k") < 2
    lo = F.when(top, F.greatest("h_x_top_left", "o_x_bottom_left")).otherwise(F.greatest("h_x_bottom_left", "o_x_top_left"))
    hi = F.when(top, F.least("h_x_top_right", "o_x_bottom_right")).otherwise(F.least("h_x_bottom_right", "o_x_top_right"))
    y = F.when(top, F.col("h_y_top")).otherwise(F.col("h_y_bottom"))
    out = met.select("map_id", "plane", F.col("h_idx").alias("src"), F.col("plane").alias("to_plane"), F.col("o_idx").alias("dst"), F.when(top, "top").otherwise("bottom").alias("edge"), lo.alias("ax"), y.alias("ay"), hi.alias("bx"), y.alias("by"))
    return out.where("bx > ax")


def portal_gates(traps: DataFrame, portals: DataFrame, portal_traps: DataFrame) -> DataFrame:
    """Gates through portals: the first portal of the other plane that points back with the same pair number.

    Portals of which either is closed (flag 4) give none. The trapezoids listed for both meet where their heights overlap.
    """
    p = portals.select("map_id", "plane", F.col("idx").alias("portal"), "start", "count", "neighbor_plane", "pair", "flags")
    q = p.select("map_id", F.col("plane").alias("neighbor_plane"), F.col("neighbor_plane").alias("plane"), "pair", F.struct("portal", "start", "count", "flags").alias("q"))
    matched = p.join(q.groupBy("map_id", "plane", "neighbor_plane", "pair").agg(F.min("q").alias("q")), ["map_id", "plane", "neighbor_plane", "pair"])
    matched = matched.where(F.col("flags").bitwiseOR(F.col("q.flags")).bitwiseAND(4) == 0)
    listed = lambda start, count: F.explode(F.when(count > 0, F.sequence(start, start + count - 1)))
    mine = portal_traps.select("map_id", "plane", "pos", F.col("trap").alias("h_idx"))
    theirs = portal_traps.select("map_id", F.col("plane").alias("neighbor_plane"), "pos", F.col("trap").alias("o_idx"))
    rows = matched.withColumn("pos", listed(F.col("start"), F.col("count"))).join(mine, ["map_id", "plane", "pos"]).drop("pos")
    rows = rows.withColumn("pos", listed(F.col("q.start"), F.col("q.count"))).join(theirs, ["map_id", "neighbor_plane", "pos"]).drop("pos")
    rows = rows.join(_side(traps, "h_", ["portal_left", "portal_right"]), ["map_id", "plane", "h_idx"])
    other = _side(traps, "o_", ["portal_left", "portal_right"]).withColumnRenamed("plane", "neighbor_plane")
    rows = rows.join(other, ["map_id", "neighbor_plane", "o_idx"])
    left = F.coalesce(F.col("h_portal_left") == F.col("portal"), F.lit(False))
    rows = rows.withColumn("left", left).where(left | F.coalesce(F.col("h_portal_right") == F.col("portal"), F.lit(False)))
    rows = rows.where(F.coalesce(F.col("o_portal_left") == F.col("q.portal"), F.lit(False)) | F.coalesce(F.col("o_portal_right") == F.col("q.portal"), F.lit(False)))
    rows = rows.withColumns({"y0": F.greatest("h_y_bottom", "o_y_bottom"), "y1": F.least("h_y_top", "o_y_top")}).where("y1 > y0")
    x = lambda y: F.when(F.col("left"), G.side_x(True, F.col(y), "h_")).otherwise(G.side_x(False, F.col(y), "h_"))
    return rows.select("map_id", "plane", F.col("h_idx").alias("src"), F.col("neighbor_plane").alias("to_plane"), F.col("o_idx").alias("dst"), F.when(F.col("left"), "left").otherwise("right").alias("edge"), x("y0").alias("ax"), F.col("y0").alias("ay"), x("y1").alias("bx"), F.col("y1").alias("by"))


def _vertices(traps: DataFrame) -> DataFrame:
    """Each trapezoid's distinct neighbouring vertices in turn, ``v``, and whether it is flat."""
    c = G.corners()
    kept = F.filter(c, lambda p, i: (i == 0) | ~p.eqNullSafe(F.element_at(c, F.greatest(i, F.lit(1)))))
    kept = F.when((F.size(kept) > 1) & F.element_at(kept, 1).eqNullSafe(F.element_at(kept, -1)), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    out = traps.withColumn("v", kept)
    return out.withColumn("flat", (F.col("y_top") <= F.col("y_bottom")) | (F.size("v") < 3))


def open_angles(traps: DataFrame, gates: DataFrame) -> DataFrame:
    """``map_id, plane, x, y, angle``: the walkable angle around every boundary point, summed over its trapezoids.

    A gate's end that is no vertex of its trapezoid adds half a turn, and so does each vertex of a flat one.
    """
    t = _vertices(traps)
    n = F.size("v")
    at = F.transform("v", lambda p, i: F.struct(p.alias("p"), F.element_at(F.col("v"), F.pmod(i + n - 1, n) + 1).alias("a"), F.element_at(F.col("v"), F.pmod(i + 1, n) + 1).alias("b")))
    rows = t.select("map_id", "plane", "flat", F.explode(at).alias("s")).select("map_id", "plane", "flat", F.col("s.p.x").alias("x"), F.col("s.p.y").alias("y"), (F.col("s.a.x") - F.col("s.p.x")).alias("ux"), (F.col("s.a.y") - F.col("s.p.y")).alias("uy"), (F.col("s.b.x") - F.col("s.p.x")).alias("vx"), (F.col("s.b.y") - F.col("s.p.y")).alias("vy"))
    turn = F.atan2(F.abs(F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx")), F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy"))
    own = rows.select("map_id", "plane", "x", "y", F.when(F.col("flat"), F.lit(math.pi)).otherwise(turn).alias("angle"))
    ends = gates.select("map_id", "plane", F.col("src").alias("idx"), F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    inner = ends.join(t.select("map_id", "plane", "idx", "v"), ["map_id", "plane", "idx"]).where(~F.array_contains("v", F.col("p")))
    every = own.unionByName(inner.select("map_id", "plane", "p.x", "p.y", F.lit(math.pi).alias("angle")))
    return every.groupBy("map_id", "plane", "x", "y").agg(F.sum("angle").alias("angle"))


def bends(angles: DataFrame, gates: DataFrame, tol: float = G.TOL) -> DataFrame:
    """The points at which a shortest path may bend: more than half a turn open, or by a portal."""
    from wayloom.operators.spatial import near_segments

    wide = angles.where(F.col("angle") > math.pi + 1e-6).select("map_id", "plane", "x", "y")
    portal = gates.where(F.col("edge").isin("left", "right")).select("map_id", "plane", "ax", "ay", "bx", "by")
    named = angles.select("map_id", "plane", "x", "y", F.struct("map_id", "plane", "x", "y").alias("point_id"))
    near = near_segments(named, portal, tol, 64.0, ["map_id", "plane"]).select("point_id.*")
    return wide.unionByName(near).distinct()


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop's table: a checkpoint in the shared folder where there is one."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayloom-"))
    return df.checkpoint()


#: Edges that one task holds and walks at a time (24 bytes each).
BLOCK_EDGES = 1 << 21


def _relaxed(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """``node, dist, own``: what a block's edges improve, from its fresh nodes until nothing changes.

    Nodes of other blocks (not ``own``) are messages to them.
    """
    names, code = np.unique(np.concatenate([edges["src"].to_numpy(), edges["dst"].to_numpy()]), return_inverse=True)
    src, dst = code[: len(edges)], code[len(edges) :]
    order = np.argsort(src, kind="stable")
    src, dst, cost = src[order], dst[order], edges["cost"].to_numpy()[order]
    first = np.searchsorted(src, np.arange(len(names) + 1))
    own = first[1:] > first[:-1]
    own[code[len(edges) :][edges["inside"].to_numpy(bool)]] = True
    dist = np.full(len(names), np.inf)
    known = known[known["node"].isin(names)]
    at = np.searchsorted(names, known["node"].to_numpy())
    dist[at] = known["dist"].to_numpy()
    before = dist.copy()
    fresh = at[known["fresh"].to_numpy(bool)]
    while len(fresh):
        n = first[fresh + 1] - first[fresh]
        which = np.repeat(first[fresh] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        to, new = dst[which], np.repeat(dist[fresh], n) + cost[which]
        less = new < dist[to]
        to = to[less]
        np.minimum.at(dist, to, new[less])
        fresh = np.unique(to)
    on = np.flatnonzero(dist < before)
    return pd.DataFrame({"node": names[on], "dist": dist[on], "own": own[on]})


def _walked(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, dist``: least sums of ``cost`` from the starts.

    Edges are dealt into blocks by ranges of ``src``. A round walks every block that has fresh nodes to its end and tells
    other blocks what it improved of theirs, so a way takes as many rounds as it changes blocks, not as it has edges.
    """
    real = _kept(edges.where("src is not null and cost is not null").select("src", "dst", F.col("cost").cast("double").alias("cost")))
    kind = real.schema["src"].dataType.simpleString()
    n = 1 + real.count() // BLOCK_EDGES
    lows = []
    if n > 1:
        part = real.select("src").repartitionByRange(n, "src").groupBy(F.spark_partition_id()).agg(F.min("src").alias("low"))
        lows = sorted(r.low for r in part.collect())[1:]
    bounds = F.array(*[F.lit(x).cast(kind) for x in lows])
    block = lambda c: F.size(F.filter(bounds, lambda x: x <= F.col(c))) if lows else F.lit(0)
    inner = _kept(real.where("dst is not null").withColumn("block", block("src")).withColumn("inside", F.col("block") == block("dst")))
    best = starts.select(F.col("node").cast(kind).alias("node")).distinct().select("node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh"))
    best = _kept(best.withColumn("block", block("node")))

    def walk(e: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if e.empty or known.empty:
            return pd.DataFrame({"node": e["src"][:0], "dist": np.zeros(0), "own": np.zeros(0, bool)})
        return _relaxed(e, known)

    while active := [r.block for r in best.where("fresh and node is not null").select("block").distinct().collect()]:
        at = F.col("block").isin(active)
        told = inner.where(at).groupBy("block").cogroup(best.where(at & F.col("node").isNotNull()).groupBy("block")).applyInPandas(walk, f"node {kind}, dist double, own boolean")
        every = best.select("node", "dist", F.lit(True).alias("own")).unionByName(told)
        every = every.groupBy("node").agg(F.min("dist").alias("dist"), F.min(F.when(F.col("own"), F.col("dist"))).alias("old"))
        best = _kept(every.select("node", "dist", (F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("fresh")).withColumn("block", block("node")))
    out = best.select("node", "dist")
    # a null is no node that edges leave, but may be met
    none = out.where("node is not null").hint("merge").join(real.where("dst is null"), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"))
    none = none.unionByName(out.where("node is null")).groupBy("node").agg(F.min("dist").alias("dist"))
    return out.where("node is not null").unionByName(none)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, depth``: all that the starts reach, and by how many edges."""
    return _walked(edges.select("src", "dst", F.lit(1.0).alias("cost")), starts).select("node", F.col("dist").cast("int").alias("depth"))


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, dist``: least sums of ``cost`` from the starts."""
    return _walked(edges, starts)


def locate_in_dag(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Walk point-location nodes set at a time, until no point is at an inner node: ``query_id, trap`` (null where none is met).

    ``nodes``: ``node, kind`` (x, y or sink), line ``ax, ay, bx, by`` or height ``y``, the next nodes ``low`` (left,
    below) and ``high``, and a sink's ``trap``. ``queries``: ``query_id, x, y, node`` (the root).
    """
    # dealt by node once: the joins of all levels find it so; none is by broadcast, as files tell little of the rows in them
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = _kept(nodes.withColumnRenamed("y", "ny").repartition(parts, "node"))
    at, done = queries.select("query_id", "x", "y", "node"), None
    right = F.when(F.col("kind") == "y", F.col("y") >= F.col("ny")).otherwise((F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax")) <= 0)
    for level in range(nodes.count() + 1):
        met = _kept(at.hint("merge").join(nodes, "node").select("query_id", "x", "y", "kind", "trap", F.when(right, F.col("high")).otherwise(F.col("low")).alias("node")))
        sink = met.where("kind = 'sink'").select("query_id", "trap")
        done = sink if done is None else done.unionByName(sink)
        done = _kept(done) if level % 16 == 15 else done
        at = met.where("kind <> 'sink' and node is not null").select("query_id", "x", "y", "node")
        if not at.head(1):
            return queries.select("query_id").hint("merge").join(done, "query_id", "left")
    raise ValueError("the nodes have a cycle")


def shortest_paths(traps: DataFrame, gates: DataFrame, requests: DataFrame, prune: bool = True, shares: int = 8) -> DataFrame:
    """``map_id, request_id, error, length, points``: exact shortest paths.

    A map's requests are dealt into up to ``shares`` kernel calls, each of which gets the map's mesh.
    """
    mesh = traps.select("map_id", "plane", "idx", *TRAP).withColumn("kind", F.lit("trap"))
    doors = gates.select("map_id", "plane", F.col("src").alias("idx"), "to_plane", "dst", "edge", "ax", "ay", "bx", "by").withColumn("kind", F.lit("gate"))
    both = mesh.unionByName(doors, allowMissingColumns=True)
    schema = "map_id bigint, request_id bigint, error string, length double, points array<struct<x:double,y:double,plane:bigint>>"
    asked = requests.withColumn("share", F.pmod(F.xxhash64("request_id"), F.lit(shares)))
    shares_of = asked.select(F.col("map_id").alias("of_map"), F.col("share").alias("of_share")).distinct()
    both = both.join(shares_of, F.col("map_id") == F.col("of_map")).withColumns({"map_id": F.col("of_map") + F.lit(0), "share": F.col("of_share") + F.lit(0)}).drop("of_map", "of_share")
    route = lambda m, r: route_requests(m.drop(columns="share"), r.drop(columns="share"), prune)
    return both.groupBy("map_id", "share").cogroup(asked.groupBy("map_id", "share")).applyInPandas(route, schema)
