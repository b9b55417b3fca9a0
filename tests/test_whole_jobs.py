"""Registered queries take all rows of their tables, at sizes beyond the smallest."""

import __spark_entry__
from wayloom.operators import graph


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return lambda name: __spark_entry__.queries()[name](spark, str(folder)).collect()


PART = "p_partkey bigint, p_size int"


def parts(n):
    return [(k, k * 7 % 50 + 1) for k in range(n)], PART


def test_locate_in_deep_dag(spark):
    """Twenty-one levels, to the deepest sink; whoever falls off has no trapezoid."""
    nodes = [(f"y{k}", "y", None, None, None, None, float(k), None, f"y{k + 1}", None) for k in range(20)]
    nodes.append(("y20", "sink", None, None, None, None, None, None, None, 5))
    nodes = spark.createDataFrame(nodes, "node string, kind string, ax double, ay double, bx double, by double, y double, low string, high string, trap bigint")
    asked = spark.createDataFrame([(1, 0.0, 19.5, "y0"), (2, 0.0, 3.5, "y0"), (3, 0.0, -1.0, "y0")], "query_id bigint, x double, y double, node string")
    assert {tuple(r) for r in graph.locate_in_dag(asked, nodes).collect()} == {(1, 5), (2, None), (3, None)}


def test_dag_locate(spark, tmp_path):
    """Every customer, on the four planes of a mesh of forty rows."""
    made, schema = parts(4000)
    run = tables(spark, tmp_path, part=(made, schema), customer=([(k,) for k in range(1500)], "c_custkey bigint"))
    got = {r.query_id: r.trap for r in run("dag_locate")}
    want = {}
    for k in range(1500):
        x, y = k * 7919 % 25000 / 100, k * 31 % 40000 / 100 + 0.005
        idx = int(y // 10) * 100 + int(x // 10) * 4 + k % 4
        up, z = (y % 10) / 10, made[idx][1]
        want[k] = idx if z % 3 * up <= x % 10 < 9 - z % 2 * up else None
    assert got == want and max(v for v in got.values() if v is not None) > 3900


def test_mesh_bloat_takes_all_parts(spark, tmp_path):
    run = tables(spark, tmp_path, part=([(k, 1) for k in range(2500)], PART), region=([(k,) for k in range(5)], "r_regionkey bigint"))
    got = {r.map_id: r for r in run("mesh_bloat")}
    assert set(got) == set(range(25)) and all(r.n > 0 and r.bad == 0 for r in got.values())
