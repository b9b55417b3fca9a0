"""Literal cases of the catalog."""

from pyspark.sql import functions as F

from wayloom import schemas
from wayloom.operators import catalog as C

ZONES = "mapid bigint, instance string, name string, mapfile bigint, unknown bigint"


def zones(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], ZONES)


def ids(df, c="mapid"):
    return sorted(r[c] for r in df.collect())


def test_search(spark):
    t = zones(spark, (109, "outpost", "The Amnoon Oasis", 290943), (232, "outpost", "Shadow's Passage", 290923), (5, "outpost", None, None))
    for q, want in {"amnoon": [109], "PASSAGE": [232], "109": [109], "290923": [232], "": [109, 232], "%": [], "nothing": [], " 232 ": [232]}.items():
        assert ids(C.search(t, q, "name", ["mapid", "mapfile"])) == want, q
    assert ids(C.search(zones(spark, (1, "outpost", "Ärger", None)), "ärger", "name", ["mapid"])) == []


def test_merge(spark):
    local = zones(spark, (1, "outpost", "A", 10), (232, "outpost", "B", 290923))
    coming = zones(spark, (1, "outpost", "A", 10), (232, "outpost", "B", 111), (232, "explorable", "B", 0), (300, "outpost", "New Map", None))
    report = C.merge_report(local, coming, ["mapid", "instance"], "mapfile")
    assert {(r.mapid, r.instance): r.action for r in report.collect()} == {(1, "outpost"): "unchanged", (232, "outpost"): "updated", (232, "explorable"): "inserted", (300, "outpost"): "inserted"}
    after = C.merge(local, report, ["mapid", "instance"])
    assert after.count() == 4 and after.where("mapid = 232 and instance = 'outpost'").head().mapfile == 111
    skipped = C.merge_report(local, zones(spark, (1, "outpost", "other", 0)), ["mapid", "instance"], "mapfile")
    assert skipped.head().action == "skipped"
    assert schemas.violations(after, ["mapid", "instance"], ["mapid"], {"instance": schemas.INSTANCES}).where("rows > 0").count() == 0


def test_without_instance(spark):
    local = zones(spark, (1, "outpost", "A", None), (2, "outpost", "B", 7))
    coming = spark.createDataFrame([(1, None), (2, 7), (2, None), (3, 7)], "mapid bigint, mapfile bigint")
    assert [r.action for r in C.place_without_instance(local, coming, "mapid", "mapfile").orderBy("mapid", F.col("mapfile").desc()).collect()] == ["unchanged", "unchanged", "unplaced", "unplaced"]


def test_snapshots(spark):
    table = spark.createDataFrame([], schemas.MANIFEST_MAPFILES.replace(" not null", ""))
    named = zones(spark, (109, "outpost", "x", 290943)).select("mapfile")
    c = lambda *r: spark.createDataFrame(r, "mapfile bigint, revision bigint, dependencies bigint")
    one, new = C.record_snapshot(table, named, c((290943, 1, 60), (500, 2, 70), (600, 3, 80)), 10)
    assert new.head().new == 2
    again, none = C.record_snapshot(one, named, c((700, 1, 60)), 10)
    assert none.head().new is None and again.count() == 3
    two, new = C.record_snapshot(C.set_flag(one, "mapfile", 600, "is_map", False), named, c((500, 9, 71), (700, 4, 90)), 11)
    assert new.head().new == 1 and two.where("mapfile = 500").head().revision == 9
    assert ids(C.unlisted(one, named, "mapfile", "is_map"), "mapfile") == [500, 600]
    assert ids(C.unlisted(two, named, "mapfile", "is_map"), "mapfile") == [500, 700]


def test_definitions_and_attributes(spark):
    d = lambda *r: spark.createDataFrame(r, "mapfile bigint, def_id bigint, ini_path string, pos bigint")
    stored = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "mapfile bigint, def_id bigint, ini_path string")
    after, changed = C.replace_definitions(stored, d((1, 5, "a", 0), (1, 5, "z", 1)), "mapfile", "def_id", "pos")
    assert not changed.head().changed and after.count() == 2
    after, changed = C.replace_definitions(stored, d((1, 7, "q", 0), (1, 5, "a", 1)), "mapfile", "def_id", "pos")
    assert changed.head().changed and sorted(tuple(r) for r in after.collect()) == [(1, 5, "a"), (1, 7, "q"), (2, 6, "b")]
    t = zones(spark, (1, "outpost", "Name", 3))
    out = C.set_attribute(t, spark.createDataFrame([(1, "explorable", 9), (1, "outpost", None)], "mapid bigint, instance string, mapfile bigint"), "mapid", "instance", "name", "mapfile")
    assert {(r.instance, r.name, r.mapfile) for r in out.collect()} == {("outpost", "Name", None), ("explorable", "Name", 9)}


def test_candidates(spark):
    rows = [(100, 101, list(range(1000, 1061))), (200, 200, [1, 2]), (300, 300, [100 + k for k in range(1, 60)]), (400, 400, [300] * 50)]
    out = C.root_candidates(spark.createDataFrame(rows, schemas.MANIFEST))
    assert sorted(tuple(r) for r in out.collect()) == [(100, 101, 61), (400, 400, 50)]
    assert [r.resolved for r in C.resolve(spark.createDataFrame([(100,), (7,)], "base_id bigint"), spark.createDataFrame(rows, schemas.MANIFEST)).orderBy("base_id").collect()] == [7, 101]


def test_exits_and_annotations(spark):
    t = spark.createDataFrame([(1, 5, 0.0, 0.0, 0, 6, 1, 1, 0.5, 1.0), (2, 5, 0.0, 0.0, 0, None, 1, 1, 0.5, None)], schemas.ZONE_EXIT)
    assert [r.dir is not None for r in C.exits(t, [5]).orderBy("id").collect()] == [True, False]
    assert C.exits(t, []).count() == 0
    maps = spark.createDataFrame([(1,), (2,)], "map_id bigint")
    v, n = spark.createDataFrame([(1, "x")], "map_id bigint, value string"), spark.createDataFrame([(2, "no file")], "map_id bigint, note string")
    assert [(r.zones, r.notes) for r in C.annotations(maps, zones=(v, n)).orderBy("map_id").collect()] == [("x", []), (None, ["no file"])]


def test_migration(spark):
    old = spark.createDataFrame([(1, "a", 2, None)], "mapid bigint, name string, mapfile bigint, unknown bigint")
    assert schemas.migrate_zones(old).head().instance == "outpost"
    try:
        schemas.checked(spark.createDataFrame([(1, "x"), (1, "y")], "k bigint, v string"), ["k"])
    except ValueError as e:
        assert "duplicate key: 2" in str(e)
    else:
        raise AssertionError
