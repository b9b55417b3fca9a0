"""Sources and incremental scans."""

import pytest

from wayloom.functions import mapfile as M
from wayloom.functions.binary import Builder
from wayloom.operators import meshes
from wayloom.plans import jobs
from wayloom.sources import files, sqlite
from wayloom.streaming import incremental


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "zones.db")
    sqlite.write(path, "zone_exit", [("id", "INTEGER"), ("from_map", "INTEGER"), ("x", "REAL"), ("name", "TEXT")], ((k, k % 3, k / 2, None if k % 5 == 0 else f"exit {k}") for k in range(100)))
    assert sqlite.tables(path) == {"zone_exit": ["id", "from_map", "x", "name"]}
    spark.dataSource.register(sqlite.SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("sqlite").options(path=path, table="zone_exit", partitions="3").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 100
    assert sorted(r.id for r in df.where("from_map = 1 and name is not null and id < 20").collect()) == [k for k in range(20) if k % 3 == 1 and k % 5]
    assert df.where("from_map in (0, 2) and name like 'exit 9%'").count() == len([k for k in range(100) if k % 3 != 1 and k % 5 and str(k).startswith("9")])
    with pytest.raises(Exception):
        spark.read.format("sqlite").options(path=path, table="none").load().count()


def test_files(spark, tmp_path):
    zone = Builder().put("IB", M.ZONES, 1)
    body = Builder().put("I", 1).put("I", 7).raw("a\\b.ini".encode("utf-16-le") + b"\0\0").put("II", 1, 2).put("I", 0).put("f", 9.5).put("f", 1.0).put("f", 0.5).put("f", 0.25).put("B", 2).put("I", 2).put("ff", 0.5, 1.0).put("II", 8, 16)
    poly = Builder().put("I", 1).put("IBH", 7, 1, 0x8000).put("I", 3).put("6f", 0, 0, 1, 0, 0, 1)
    zone.section(1, body).section(3, poly).section(9, b"zz").section(M.END, b"")
    for name, data in (("a.bin", M.container(3, [(0x10000003, zone.bytes()), (0x10000008, b"x")])), ("b.bin", b"broken")):
        (tmp_path / name).write_bytes(data)
    rows = files.chunks(files.read_files(spark, str(tmp_path), "*.bin"), ["path"])
    assert sorted((r.path[-5:], r.chunk_id, r.error) for r in rows.collect() if r.chunk_id) == [("a.bin", 0x10000003, None), ("a.bin", 0x10000008, None)]
    assert [r.error for r in rows.collect() if r.path.endswith("b.bin")] == ["not a container"]
    listed = files.chunk_list(rows.where("error is null")).orderBy("ord").collect()
    assert [(r.kind, r.length > 0) for r in listed] == [("Zones", True), ("Path", True)]
    first = files.chunk(rows, ["path"], 0x10000003)
    defs = files.decoded(first, lambda b: [{"def_id": d["def_id"], "ini_path": d["ini_path"], "n": len(d["models"])} for d in M.zone_chunk(b)["defs"]], "def_id bigint, ini_path string, n bigint", ["path"], "data")
    assert [(r.def_id, r.ini_path, r.n) for r in defs.collect()] == [(7, "a\\b.ini", 2)]
    parsed = M.zone_chunk(zone.bytes())
    assert parsed["zones"][0]["vertices"] == [(0, 0), (1, 0), (0, 1)] and parsed["unknown"] == [(9, b"zz")] and parsed["defs"][0]["layers"][0]["spacing"] == 9.5
    back = files.write_containers(rows.where("error is null"), ["path"]).head()
    assert bytes(back.content) == (tmp_path / "a.bin").read_bytes()


def test_incremental(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.bin").write_bytes(b"one")
    work = lambda df: df.selectExpr("regexp_extract(path, '([0-9]+)[.]bin', 1) as id", "length", "cast(content as string) as text")
    incremental.scan(spark, str(source), target, work)
    (source / "2.bin").write_bytes(b"three")
    incremental.scan(spark, str(source), target, work)
    incremental.scan(spark, str(source), target, work)
    rows = spark.read.parquet(target + "/rows")
    assert rows.count() == 2 and sorted((r.id, r.text) for r in incremental.current(spark, target, ["id"]).collect()) == [("1", "one"), ("2", "three")]
    assert incremental.compacted(spark, target, str(tmp_path / "snap"), ["id"]).count() == 2


def test_jobs(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "id bigint")
    cache = spark.createDataFrame([(1, bytearray(b"c"))], "id bigint, content binary")
    got = {r.id: r.status for r in jobs.fetch(ids, cache, lambda i: {2: b"two"}.get(i)).collect()}
    assert got == {1: "cached", 2: "fetched", 3: "not found", 4: "not found"}

    def work(batches):
        for pdf in batches:
            yield pdf.assign(value=pdf["id"] * 10, status=["ok" if i != 3 else "failed" for i in pdf["id"]], notes="")

    done, told = jobs.run_missing(ids.distinct(), spark.createDataFrame([(1, 5)], "id bigint, value bigint"), ["id"], work, "id bigint, value bigint, status string, notes string")
    assert sorted((r.id, r.value) for r in done.collect()) == [(1, 5), (2, 20), (4, 40)] and told.where("status = 'failed'").count() == 1
    files_ = spark.createDataFrame([(1, "2024-01-01", "a"), (1, "2024-01-02", "b"), (1, "2024-01-02", "c")], "mapfile int, modificationTime string, path string")
    assert jobs.newest(files_).head().path == "c"
    listed = jobs.worklist(spark.createDataFrame([(5,), (6,), (7,)], "id bigint"), spark.createDataFrame([(5, 50), (6, 60)], "base_id bigint, current_id bigint"), spark.createDataFrame([(6,)], "id bigint"))
    assert sorted((r.id, r.revision, r.status) for r in listed.collect()) == [(5, 50, "to do"), (6, 60, "imaged"), (7, 7, "not listed")]


def test_meshes(spark):
    flat = spark.createDataFrame([(m, x, y, 0.0 if m == 1 or x < 3 else 90.0 * (x % 2)) for m in (1, 2) for x in range(6) for y in range(5)], "map_id bigint, x bigint, y bigint, z double")
    starts = spark.createDataFrame([(1, 0.5, 0.25), (2, 0.5, 0.25)], "map_id bigint, x double, y double")
    traps = meshes.generate(flat, starts, 10.0)
    got = {r.map_id: (r.n, r.area, r.bad) for r in meshes.invariants(traps).collect()}
    assert got[1] == (1, 20.0, 0) and got[2][1] == 8.0 and got[2][2] == 0
    assert [len(M.planes(bytes(r.content))) for r in meshes.path_chunks(traps).collect()] == [1, 1]
