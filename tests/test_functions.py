"""Sequences, geometry, text and codecs: literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import geometry as G
from wayloom.functions import lz
from wayloom.functions import mapfile as M
from wayloom.functions import text as T
from wayloom.functions.binary import BadData, Bits, Builder, Cursor
from wayloom.operators import raster as R
from wayloom.operators import sequence as S
from wayloom.operators import spatial as P


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()


def test_path_length(spark):
    rows = [(1, 0, 1, 0.0, 0.0), (1, 1, 1, 3.0, 4.0), (1, 2, 2, 100.0, 100.0), (1, 3, 2, 100.0, 101.0), (2, 0, 1, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "list_id int, pos int, mapid int, x double, y double")
    assert {r.list_id: r.length for r in S.path_length(df, ["list_id"], ["pos"], "mapid").collect()} == {1: 6.0, 2: 0.0}
    assert [r.leg for r in S.legs(df, ["list_id"], ["pos"], F.col("mapid") == 1).collect()] == [0]


@pytest.mark.parametrize("covers, want", [([(2.0, 4.0), (6.0, 10.0)], [(0.0, 2.0), (4.0, 6.0)]), ([], [(0.0, 10.0)]), ([(-1.0, 11.0)], [])])
def test_uncovered(spark, covers, want):
    ranges = spark.createDataFrame([(1, 0.0, 10.0)], "k int, lo double, hi double")
    c = spark.createDataFrame([(1, *x) for x in covers], "k int, c0 double, c1 double")
    assert sorted((r.a, r.b) for r in S.uncovered(ranges, c, ["k"]).collect()) == want
    flat = spark.createDataFrame([(1, 5.0, 5.0)], "k int, lo double, hi double")
    assert len(S.uncovered(flat, c, ["k"]).collect()) == (1 if want else 0)


def test_splice_and_straighten(spark):
    pts = spark.createDataFrame([(1, k, float(k)) for k in range(3)], "l int, pos bigint, x double")
    bends = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.7)], "l int, pos bigint, part int, x double")
    assert [r.x for r in S.splice(pts, bends, ["l"], "pos").orderBy("pos").collect()] == [0.0, 0.5, 0.7, 1.0, 2.0]
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0), (1, 2, 2.0, 2.0), (1, 3, 2.0, 5.0)], "l int, pos bigint, x double, y double")
    assert [(r.x, r.y) for r in S.straightened(line, ["l"], "pos").orderBy("pos").collect()] == [(0.0, 0.0), (2.0, 2.0), (2.0, 5.0)]
    r = one(spark, s=S.slices(F.array(*[F.lit(k) for k in range(5)]), F.array(F.lit(2), F.lit(0), F.lit(9)).cast("array<bigint>")))
    assert r.s == [[0, 1], [], [2, 3, 4]]


def test_polygon(spark):
    u = [(0, 0), (0, 3), (1, 3), (1, 1), (2, 1), (2, 3), (3, 3), (3, 0)]
    v = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in u])
    r = one(spark, area=G.signed_area(v), c=G.centroid(v), notch=G.in_polygon(F.lit(1.5), F.lit(2.0), v), arm=G.in_polygon(F.lit(0.5), F.lit(2.0), v), h=G.zone_height(F.lit(0x8000)))
    assert r.area == -7 and r.c.x == pytest.approx(1.5) and r.c.y == pytest.approx(9.5 / 7) and not r.notch and r.arm and abs(r.h) < 0.01
    levels = one(spark, **{f"l{k}": G.layer_level(F.lit(s)) for k, s in enumerate([8.0, 9.6, 19.0, 30.0, 45.0, 80.0])})
    assert list(levels) == [0, 1, 1, 2, 3, 4]


def test_numbers(spark):
    r = one(spark, a=G.park_miller(F.lit(1)), b=G.park_miller(G.park_miller(F.lit(1))), q=G.quantized(F.lit(-1.239)), s=G.snapped(F.lit(-6.0)), n=G.node_ref(F.lit(3 << 30 | 5)), crc=F.crc32(F.lit("123456789").cast("binary")), rd=G.rounded(F.lit(-2.5)))
    assert r.a == 48271 and r.b == 48271 * 48271 % (2**31 - 1) and r.q == pytest.approx(-1.23) and r.s == -4 and r.n.kind == 3 and r.crc == 0xCBF43926 and r.rd == -3
    d = one(spark, d=G.segment_distance(*map(F.lit, (0.0, 2.0, -1.0, 0.0, 1.0, 0.0))), s=G.side(*map(F.lit, (0.0, 0.0, 1.0, 0.0, 0.0, 3.0))))
    assert d.d == 2.0 and d.s == 3.0


def test_text(spark):
    p = "Missions\\Factions\\Badlands\\Zones\\Rocks.INI"
    r = one(spark, f=T.folder(F.lit(p)), s=T.stem(F.lit(p)), h=T.short_folder(F.lit("Data\\Missions\\A\\B")), h2=T.short_folder(F.lit("Missions\\X")), i=T.instance(F.lit(" OutPost ")), m=T.map_id(F.lit("0546")), m2=T.map_id(F.lit("546")))
    assert (r.f, r.s, r.h, r.h2, r.i, r.m, r.m2) == ("Missions\\Factions\\Badlands\\Zones", "Rocks", "A\\B", "X", "outpost", 546, None) or r.f == "Missions\\Factions\\Badlands"
    w = one(spark, w=T.parse_waypoints(F.lit("{ x = 1.5, y = -2 } junk { y = 3, x = inf, mapid = 4 }"), F.lit(7).cast("bigint"))).w
    assert (w[0].x, w[0].y, w[0].plane, w[0].mapid, w[0].error) == (1.5, -2.0, 0, 7, None) and w[1].error == "waypoint 2: bad x"
    q = one(spark, a=T.request(F.lit("/api/render/12?x=1&refresh=true"), "render"), b=T.request(F.lit("/api/render/x"), "render"), u=T.request_url("render", F.lit(3), F.lit(True)))
    assert (q.a.id, q.a.refresh, q.b, q.u) == (12, True, None, "/api/render/3?refresh=1")


def test_grid_join_is_brute_force(spark):
    rng = random.Random(4)
    traps = [(0, k % 3, k, float(rng.randint(5, 15)) + y, float(y), x + 1.0, x + 8.0, float(x), x + 9.0) for k, (x, y) in enumerate((rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(60))]
    names = ["map_id", "plane", "idx", "y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right"]
    t = spark.createDataFrame(traps, ", ".join(f"{n} {'bigint' if k < 3 else 'double'}" for k, n in enumerate(names))).drop("map_id")
    pts = [(k, rng.uniform(-45, 60), rng.uniform(-45, 60), k % 4) for k in range(150)]
    got = {r.point_id: (r.plane, r.idx) for r in P.locate(spark.createDataFrame(pts, "point_id bigint, x double, y double, plane bigint"), t, 7.0).collect()}

    def holds(tr, x, y, tol):
        if not tr[4] - tol <= y <= tr[3] + tol:
            return False
        f = (min(tr[3], max(tr[4], y)) - tr[4]) / (tr[3] - tr[4])
        return tr[7] + (tr[5] - tr[7]) * f - tol <= x <= tr[8] + (tr[6] - tr[8]) * f + tol

    for k, x, y, wish in pts:
        hits = sorted((tr[1] != wish, -tr[1], not holds(tr, x, y, 0), tr[2]) for tr in traps if holds(tr, x, y, 0.02))
        assert got[k] == ((-hits[0][1], hits[0][3]) if hits else (None, None))


def test_obstacle_grid(spark):
    assert M.write_obstacles(4, 2, {}) == bytes([4, 0, 2, 0, 0, 0]) + b"\0" * 24
    o = spark.createDataFrame([(1, 10.0, 10.0, 5.0), (2, 10.0, 10.0, 0.0)], "id bigint, x double, y double, radius double")
    assert [(r.row, r.col, r.ids) for r in P.obstacle_cells(o, (0.0, 0.0, 4000.0, 2000.0)).collect()] == [(1, 0, [1])]
    wide, high, cells = M.obstacles(M.write_obstacles(2, 1, {(0, 1): [(1.0, 2.0, 3.0)]}))
    assert (wide, high, cells) == (2, 1, [[], [(1.0, 2.0, 3.0)]])


def test_composite(spark):
    base = spark.createDataFrame([(x, 0, 40) for x in range(4)], "px int, py int, rgb int")
    sprites = spark.createDataFrame([(0, 1, 0, 200, 5), (0, 2, 0, 200, 5), (1, 2, 0, 120, 5), (1, 3, 0, 120, 9)], "prop int, px int, py int, rgb int, depth int")
    colors = lambda s: [r.rgb for r in R.composite(base, s).orderBy("px").collect()]
    assert colors(sprites) == [40, 200, 200, 120] and colors(sprites.where("prop = 1")) == [40, 40, 120, 120]


def test_containers():
    data = M.container(3, [(0x10000008, b"abc"), (0x20000004, b"")])
    assert [(c["chunk_id"], c["data"]) for c in M.chunks(data)[1]] == [(0x10000008, b"abc"), (0x20000004, b"")]
    for bad in (b"xxxx1", data[:-1], data + b"1"):
        with pytest.raises(BadData):
            M.chunks(bad)
    assert M.chunk_name(0x10000008) == {"stage": "strip", "file_refs": False, "kind": "Path"} and M.chunk_id("bloated", "Props", True) == 0x21000004
    assert M.chunk_name(0x21000016)["kind"] == "PathEngine" and M.chunk_name(0x10000017) is None and M.chunk_name(0x30000008) is None and M.chunk_name(0x10010008) is None


def test_mission_manifest_refs():
    b = Builder().put("I", M.MISSION).raw(b"\0" * 25).put("H", 2).put("iiB4s", 3, -4, 64, b"1po\0").put("iiB4s", 0, 0, 0, b"6450").put("H", 1).put("iiB4s", 1, 1, 1, b"\0\0\0\0")
    assert [(p["list"], p["x"], p["y"], p["tag"]) for p in M.mission(b.bytes())] == [(0, 3.0, -4.0, "op1"), (0, 0.0, 0.0, "0546"), (1, 1.0, 1.0, "")]
    words = lambda *w: Builder().put(f"{len(w)}I", *w).bytes()
    assert M.manifest(words(0, 101, 100, 7, 8, 0, 5, 5, 0)) == [{"base_id": 100, "current_id": 101, "deps": [7, 8]}, {"base_id": 5, "current_id": 5, "deps": []}]
    for bad in (b"abc", words(1), words(0, 5, 0), words(0, 5, 6)):
        with pytest.raises(BadData):
            M.manifest(bad)
    assert M.file_refs(Builder().put("IB", M.FILE_REFS, 1).put("HHH", 0x0101, 0x0102, 0).bytes()) == [(0x0101 - 0xFF00FF + 0x0102 * 0xFF00) & 0xFFFFFFFF]


def test_planes_and_path():
    plane = {
        "start_points": [(1.0, 2.0)], "vectors": [(0.0, 1.0)], "root": ("y", 0), "x_nodes": [(0, 1, ("sink", 0), None)], "y_nodes": [(0, ("x", 0), ("sink", 1))], "sinks": [0, 0], "portal_traps": [0],
        "trapezoids": [{"nb": [None, 1, None, 2], "portal_left": None, "portal_right": 3, "y_top": 1.0, "y_bottom": 0.0, "x_top_left": 0.0, "x_top_right": 1.0, "x_bottom_left": 0.0, "x_bottom_right": 2.0}],
        "portals": [{"count": 1, "start": 0, "neighbor_plane": 1, "pair": 7, "flags": 0}],
    }
    assert M.planes(M.write_planes([plane, plane])) == [plane, plane]
    with pytest.raises(BadData):
        M.planes(M.write_planes([plane]) + b"x")
    body = M.write_path({"sequence": 0x71, "start_points": [(1.0, 2.0)], "checksum": 1}, b"abc", [4, 5], b"xy")
    got = M.path_bloated(body)
    assert got["plane_indices"] == [4, 5] and got["start_points"] == [(1.0, 2.0)] and got["mismatch"]


def test_heights_and_bits():
    rng = random.Random(1)
    blocks = [[rng.randint(-3000, 3000)] + [rng.choice([0, 0, 1, -1, 700, -900]) for _ in range(15)] for _ in range(64)]
    data = M.write_heights(blocks)
    grid, used = M.heights(32, 32, data)
    assert used == len(data) and [grid[(4 + k // 4) * 32 + 4 + k % 4] for k in range(16)] == M._inverse(blocks[9])
    assert Bits(b"\xa5").peek(12) == 0xA50 and Bits(b"").read(5) == 0
    with pytest.raises(BadData):
        Cursor(b"ab").take("I")


@pytest.mark.parametrize("data", [b"hello " * 50, bytes(random.Random(2).choices(b"abcd", k=3000)), b"x" * 500, b"ab", b""])
def test_blocks(data):
    packed = lz.compress(data)
    if len(packed) < len(data):
        assert lz.decompress(packed, len(data)) == data
        old = data[: len(data) // 2] + b"zz" + data[len(data) // 2 :]
        delta = lz.compress(data, old)
        assert lz.decompress(delta, len(data), old) == data
        with pytest.raises(BadData):
            lz.decompress(delta, len(data))
    assert lz.decompress(data, len(data)) == data
    with pytest.raises(BadData):
        lz.decompress(data + b"1", len(data))


def test_fuzz():
    rng = random.Random(3)
    for _ in range(300):
        junk = rng.randbytes(rng.randint(1, 60))
        for f in (lambda b: lz.decompress(b, 200, b"old" * 40), M.planes, M.mission, M.zone_chunk, M.manifest, M.obstacles, M.environment):
            try:
                f(junk)
            except BadData:
                pass


def test_angles(spark):
    assert math.isclose(R.degrees_of(0.5), 60.0)


def test_params_and_terrain():
    b = Builder().put("IBffffI", M.PARAMS, 2, -18432, -30720, 21504, 30720, 4 << 24).raw(b"\0" * 16).bytes()
    p = M.params(b)
    assert (p["min_x"], p["min_y"], p["max_x"], p["max_y"], p["map_type"], p["has_water"]) == (-18432, -30720, 21504, 30720, 4, False)
    with pytest.raises(BadData):
        M.params(b"\0" + b[1:])
    rng = random.Random(4)
    blocks = [[rng.randint(-50, 50)] + [rng.choice([0, 0, 3])] * 15 for _ in range(128)]
    t = M.terrain(M.write_terrain(64, 32, blocks))
    assert (t["wide"], t["high"], len(t["heights"])) == (64, 32, 2048) and [t["heights"][k // 4 * 32 + k % 4] for k in range(16)] == M._inverse(blocks[0])
    strip = Builder().put("IBI", M.PATH, 12, 0x71).put("BHff", 7, 1, 1.0, 2.0).put("BIBB", 14, 9, 0, M.END).bytes()
    assert M.path_strip(strip) == {"sequence": 0x71, "start_points": [(1.0, 2.0)], "checksum": 9}
    outline = Builder().put("II", 2, 1).put("BBBBfff", 1, 2, 0, 0, 1.0, 2.0, 3.0).bytes()
    assert M.model_outline(M.container(2, [(0xBBA, outline)]))[0]["y"] == 2.0 and M.model_outline(b"x") == [] and M.model_outline(M.container(3, [])) == []
