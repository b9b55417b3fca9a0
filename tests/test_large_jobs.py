"""Walks, searches and crossings whose work used to grow beyond the table: rounds by depth, pairs by density."""

import math
import random

import pytest

import __spark_entry__
from wayloom.operators import graph, raster, spatial


def least(edges, starts):
    """Least sums by relaxing every edge until nothing changes."""
    dist = dict.fromkeys(starts, 0.0)
    more = True
    while more:
        more = False
        for a, b, c in edges:
            if a is not None and a in dist and dist[a] + c < dist.get(b, math.inf):
                dist[b], more = dist[a] + c, True
    return dist


@pytest.mark.parametrize("block", [1 << 21, 150])
def test_walks_by_blocks(spark, monkeypatch, block):
    """In one block and in several: weighted and plain, with loops, sinks, nulls and starts that no edge leaves."""
    monkeypatch.setattr(graph, "BLOCK_EDGES", block)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(320), float(rng.randint(0, 9))) for _ in range(600)]
    edges += [(k, k + 1, 1.0) for k in range(1000, 1060)] + [(5, 1000, 2.0), (1060, None, 3.0), (None, 2, 1.0)]
    starts = [0, 7, 500, 5]
    table = spark.createDataFrame(edges, "src bigint, dst bigint, cost double")
    nodes = spark.createDataFrame([(s,) for s in starts], "node bigint")
    assert {r.node: r.dist for r in graph.distances(table, nodes).collect()} == least(edges, starts)
    assert {r.node: r.depth for r in graph.reachable(table, nodes).collect()} == least([(a, b, 1) for a, b, _ in edges], starts)
    assert graph.reachable(table, nodes.limit(0)).count() == 0


def test_deep_walks_take_few_rounds(spark, monkeypatch):
    """A way of 3000 edges in four blocks: rounds by blocks, not by edges; a flood by the same walk."""
    rounds, kept = [], graph._kept
    monkeypatch.setattr(graph, "BLOCK_EDGES", 1000)
    monkeypatch.setattr(graph, "_kept", lambda df: rounds.append(1) or kept(df))
    way = spark.range(3000).selectExpr("id as tri", "id + 1 as nb", "'flat' as nb_class", "0.0 as angle", "0.0 as nb_angle")
    got = raster.flood(way, spark.createDataFrame([(0,)], "tri bigint"), 10.0).collect()
    assert {(r.node, r.depth) for r in got} == {(k, k) for k in range(3001)} and len(rounds) < 15


def test_dag_walk_broadcasts_no_table(spark, monkeypatch):
    """Files tell little of the rows in them, so neither the points nor the nodes go to the driver; all levels are walked."""
    plans, kept = [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df))
    nodes = [(f"y{k}", "y", None, None, None, None, float(k), None, f"y{k + 1}", None) for k in range(20)]
    nodes.append(("y20", "sink", None, None, None, None, None, None, None, 5))
    nodes = spark.createDataFrame(nodes, "node string, kind string, ax double, ay double, bx double, by double, y double, low string, high string, trap bigint")
    asked = spark.createDataFrame([(1, 0.0, 19.5, "y0"), (2, 0.0, 3.5, "y0")], "query_id bigint, x double, y double, node string")
    out = graph.locate_in_dag(asked, nodes)
    assert {tuple(r) for r in out.collect()} == {(1, 5), (2, None)}
    assert len(plans) > 20 and not any("Broadcast" in p for p in [*plans, out._jdf.queryExecution().sparkPlan().toString()])


def plans_of(spark, folder, monkeypatch, name):
    """The rows of a query over 400 parts, and the plans of the tables that it keeps and of its result."""
    plans, kept = [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df))
    spark.createDataFrame([(k, k * 7 % 50 + 1) for k in range(400)], "p_partkey bigint, p_size int").write.parquet(f"{folder}/part.parquet")
    out = __spark_entry__.queries()[name](spark, str(folder))
    return {tuple(r) for r in out.collect()}, [*plans, out._jdf.queryExecution().sparkPlan().toString()]


def flooded():
    """The grid's edges, and the cells that walking from the seeds reaches."""
    cells = {k: k * 7 % 50 + 1 < 38 for k in range(400)}
    edges = [(k, n) for k in cells for n in (k - 50, k + 50, k - 1, k + 1) if n in cells and abs(k % 50 - n % 50) <= 1]
    return edges, set(least([(a, b, 1) for a, b in edges if cells[b]], [k for k in cells if k % 37 == 0]))


def test_flood_fill_broadcasts_no_table(spark, tmp_path, monkeypatch):
    """Cells and edges are as many as parts, whatever the size of the files: none goes to the driver."""
    got, plans = plans_of(spark, tmp_path, monkeypatch, "flood_fill")
    assert got == {(k,) for k in flooded()[1]}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_flood_edges_broadcasts_no_table(spark, tmp_path, monkeypatch):
    """Nor do the visited cells, which the edges are held against."""
    got, plans = plans_of(spark, tmp_path, monkeypatch, "flood_edges")
    edges, inside = flooded()
    assert got == {(a, b) for a, b in edges if a in inside and b not in inside}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def sizes(monkeypatch):
    """The sizes of cells that are used from now on."""
    used, cells = [], spatial.grid_cells
    monkeypatch.setattr(spatial, "grid_cells", lambda df, x0, y0, x1, y1, size, *names: used.append(size) or cells(df, x0, y0, x1, y1, size, *names))
    return used


def test_nearest_among_dense_places(spark, monkeypatch):
    """Many places within the radius, some at one spot, some points with none: few are compared, results are brute force's."""
    used = sizes(monkeypatch)
    rng = random.Random(9)
    places = [(k, rng.choice("ab"), rng.randrange(60) / 2, rng.randrange(60) / 2) for k in range(1500)] + [(9000, "a", 75.0, 75.0)]
    points = [(k, rng.choice("ab"), rng.randrange(300) / 4, rng.randrange(300) / 4) for k in range(600)] + [(700, "a", None, 1.0), (701, "a", 55.0, 75.0)]
    got = spatial.nearest(spark.createDataFrame(points, "point_id bigint, g string, x double, y double"), spark.createDataFrame(places, "place_id bigint, g string, px double, py double"), 20.0, ["g"])
    want = {}
    for k, g, x, y in points:
        near = [(math.sqrt((x - px) ** 2 + (y - py) ** 2), i) for i, h, px, py in places if x is not None and g == h]
        if near and min(near)[0] <= 20:
            want[k] = min(near)[::-1]
    assert {r.point_id: (r.place_id, r.d) for r in got.collect()} == want and want[701] == (9000, 20.0)
    assert min(used) <= 2.5 and max(used) == 20


def test_crossings_among_dense_segments(spark, monkeypatch):
    """Short segments in cells of their own size, each pair told once; one long segment crosses many cells."""
    used = sizes(monkeypatch)
    rng = random.Random(10)
    segs = [(k, rng.randrange(100) / 2, rng.randrange(100) / 2) for k in range(400)]
    segs = [(k, x, y, x + rng.randint(-3, 3), y + rng.randint(-3, 3)) for k, x, y in segs] + [(400, -5.0, 1.0, 60.0, 49.5)]
    got = spatial.crossings(spark.createDataFrame(segs, "id bigint, ax double, ay double, bx double, by double"), 32.0).collect()
    want = set()
    for j, ax, ay, bx, by in segs:
        for i, cx, cy, dx, dy in segs[:j]:
            rx, ry, sx, sy = dx - cx, dy - cy, bx - ax, by - ay
            if det := rx * sy - ry * sx:
                t, u = ((ax - cx) * sy - (ay - cy) * sx) / det, ((ax - cx) * ry - (ay - cy) * rx) / det
                if 0 < t < 1 and 0 < u < 1:
                    want.add((i, j, cx + rx * t, cy + ry * t))
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want
    assert max(used) < 32
