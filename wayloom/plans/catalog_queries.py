"""Catalog operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import catalog as C
from wayloom.registry import query


def _named(q: str, numbers: str) -> str:
    return f"(contains(translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{q}'){numbers})"


@query("part_search", f"SELECT 'blue' AS q, p_partkey, p_name, p_size FROM part WHERE {_named('blue', '')} UNION ALL SELECT '17', p_partkey, p_name, p_size FROM part WHERE {_named('17', ' OR p_partkey = 17 OR p_size = 17')}")
def part_search(table):
    """Text or number search over all parts, by two queries."""
    part = table("part").select("p_partkey", "p_name", "p_size")
    one = lambda q: C.search(part, q, "p_name", ["p_partkey", "p_size"]).select(F.lit(q.strip().lower()).alias("q"), "*")
    return one(" BLUE ").unionByName(one("17"))


def _zones(table):
    """A catalog made of customers: key and instance, name, file (null, 0 or an id) and one more number."""
    c = table("customer")
    return c.select(
        (F.col("c_custkey") % 1000003).alias("mapid"), F.when(F.col("c_nationkey") % 2 == 0, "outpost").otherwise("explorable").alias("instance"), F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") % 7 == 0, F.lit(None)).when(F.col("c_nationkey") % 7 == 1, 0).otherwise(F.col("c_custkey") * 3).cast("bigint").alias("mapfile"), F.col("c_nationkey").cast("bigint").alias("unknown"),
    )


ZONES = """zones AS (SELECT c_custkey % 1000003 AS mapid, CASE WHEN c_nationkey % 2 = 0 THEN 'outpost' ELSE 'explorable' END AS instance, c_name AS name,
  CASE WHEN c_nationkey % 7 = 0 THEN NULL WHEN c_nationkey % 7 = 1 THEN 0 ELSE c_custkey * 3 END AS mapfile, CAST(c_nationkey AS BIGINT) AS unknown FROM customer)"""


def _incoming(zones):
    changed = F.when(F.col("mapid") % 5 == 0, F.col("mapfile") + 1).otherwise(F.col("mapfile"))
    return zones.where("mapid % 3 <> 0").select("mapid", "instance", F.when(F.col("mapid") % 11 == 0, F.concat("name", F.lit("'"))).otherwise(F.col("name")).alias("name"), changed.alias("mapfile"), "unknown").unionByName(
        zones.where("mapid % 10 = 0").select((-F.col("mapid") - 1).alias("mapid"), "instance", "name", "mapfile", "unknown")
    )


INCOMING = """incoming AS (SELECT mapid, instance, CASE WHEN mapid % 11 = 0 THEN name || '''' ELSE name END AS name, CASE WHEN mapid % 5 = 0 THEN mapfile + 1 ELSE mapfile END AS mapfile, unknown FROM zones WHERE mapid % 3 <> 0
  UNION ALL SELECT -mapid - 1, instance, name, mapfile, unknown FROM zones WHERE mapid % 10 = 0)"""
REPORT = """report AS (SELECT i.*, CASE WHEN l.mapid IS NULL THEN 'inserted'
  WHEN l.name IS NOT DISTINCT FROM i.name AND l.mapfile IS NOT DISTINCT FROM i.mapfile AND l.unknown IS NOT DISTINCT FROM i.unknown THEN 'unchanged'
  WHEN coalesce(i.mapfile, 0) = 0 THEN 'skipped' ELSE 'updated' END AS action, l.mapfile AS old_mapfile FROM incoming i LEFT JOIN zones l ON l.mapid = i.mapid AND l.instance = i.instance)"""
KEYS = ["mapid", "instance"]


@query("catalog_merge", f"WITH {ZONES}, {INCOMING}, {REPORT} SELECT mapid, instance, action, old_mapfile, mapfile AS new_mapfile FROM report")
def catalog_merge(table):
    zones = _zones(table)
    report = C.merge_report(zones, _incoming(zones), KEYS, "mapfile")
    return report.select(*KEYS, "action", F.col("old.mapfile").alias("old_mapfile"), F.col("new.mapfile").alias("new_mapfile"))


@query("catalog_merged", f"WITH {ZONES}, {INCOMING}, {REPORT}, applied AS (SELECT mapid, instance, name, mapfile, unknown FROM report WHERE action IN ('inserted', 'updated')) SELECT * FROM zones z WHERE NOT EXISTS (SELECT 1 FROM applied a WHERE a.mapid = z.mapid AND a.instance = z.instance) UNION ALL SELECT * FROM applied")
def catalog_merged(table):
    zones = _zones(table)
    return C.merge(zones, C.merge_report(zones, _incoming(zones), KEYS, "mapfile"), KEYS)


@query("merge_counts", f"WITH {ZONES}, {INCOMING}, {REPORT} SELECT action, count(*) AS n FROM report GROUP BY action")
def merge_counts(table):
    zones = _zones(table)
    return C.tally(C.merge_report(zones, _incoming(zones), KEYS, "mapfile"), "action")


@query("merge_no_instance", f"WITH {ZONES}, incoming AS (SELECT mapid, CASE WHEN mapid % 4 = 0 THEN NULL ELSE mapfile END AS mapfile FROM zones) SELECT i.*, CASE WHEN EXISTS (SELECT 1 FROM zones z WHERE z.mapid = i.mapid AND z.mapfile IS NOT DISTINCT FROM i.mapfile) THEN 'unchanged' ELSE 'unplaced' END AS action FROM incoming i")
def merge_no_instance(table):
    zones = _zones(table)
    return C.place_without_instance(zones, zones.select("mapid", F.when(F.col("mapid") % 4 == 0, F.lit(None)).otherwise(F.col("mapfile")).alias("mapfile")), "mapid", "mapfile")


def _snapshots(table):
    part = table("part").select(F.col("p_partkey").alias("mapfile"), F.col("p_size").cast("bigint").alias("revision"))
    stored = part.where("mapfile % 3 <> 1").withColumns({"manifest": F.lit(10).cast("bigint"), "dependencies": F.col("mapfile") % 90, "is_map": F.when(F.col("mapfile") % 6 == 0, True).when(F.col("mapfile") % 6 == 2, False)})
    named = table("lineitem").where("l_quantity < 2").select(F.col("l_partkey").alias("mapfile")).distinct()
    coming = part.where("mapfile % 2 = 0").select("mapfile", (F.col("revision") + 1).alias("revision"), (F.col("mapfile") % 100).alias("dependencies"))
    return stored, named, coming


SNAP = """stored AS (SELECT p_partkey AS mapfile, CAST(p_size AS BIGINT) AS revision, CAST(10 AS BIGINT) AS manifest, p_partkey % 90 AS dependencies, CASE WHEN p_partkey % 6 = 0 THEN true WHEN p_partkey % 6 = 2 THEN false END AS is_map FROM part WHERE p_partkey % 3 <> 1),
named AS (SELECT DISTINCT l_partkey AS mapfile FROM lineitem WHERE l_quantity < 2), coming AS (SELECT p_partkey AS mapfile, CAST(p_size + 1 AS BIGINT) AS revision, p_partkey % 100 AS dependencies FROM part WHERE p_partkey % 2 = 0)"""


@query("record_snapshot", f"WITH {SNAP} SELECT c.mapfile, c.revision, CAST(11 AS BIGINT) AS manifest, c.dependencies, s.is_map FROM coming c LEFT JOIN stored s USING (mapfile) UNION ALL SELECT * FROM stored WHERE mapfile NOT IN (SELECT mapfile FROM coming)")
def record_snapshot(table):
    return C.record_snapshot(*_snapshots(table), 11)[0]


@query("snapshot_new", f"WITH {SNAP} SELECT 11 AS manifest, (SELECT count(*) FROM coming WHERE mapfile NOT IN (SELECT mapfile FROM stored) AND mapfile NOT IN (SELECT mapfile FROM named)) AS new UNION ALL SELECT 10, NULL")
def snapshot_new(table):
    """How many files a snapshot adds; one that was recorded before says nothing."""
    new = lambda n: C.record_snapshot(*_snapshots(table), n)[1].select(F.lit(n).alias("manifest"), "new")
    return new(11).unionByName(new(10))


@query(
    "replace_defs",
    """WITH stored AS (SELECT l_orderkey AS mapfile, CAST(l_linenumber AS BIGINT) AS def_id, min(l_partkey) AS v FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2),
coming AS (SELECT l_orderkey AS mapfile, CAST(l_linenumber AS BIGINT) AS def_id, arg_min(l_partkey + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END, l_partkey) AS v FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT mapfile, coalesce(bool_or(s.v IS DISTINCT FROM c.v), false) AS changed FROM coming c FULL JOIN (SELECT * FROM stored WHERE mapfile IN (SELECT mapfile FROM coming)) s USING (mapfile, def_id) GROUP BY mapfile""",
)
def replace_defs(table):
    rows = table("lineitem").select(F.col("l_orderkey").alias("mapfile"), F.col("l_linenumber").cast("bigint").alias("def_id"), F.col("l_partkey").alias("v"))
    stored = rows.where("mapfile % 3 <> 0").groupBy("mapfile", "def_id").agg(F.min("v").alias("v"))
    coming = rows.where("mapfile % 2 = 0").select("mapfile", "def_id", (F.col("v") + F.when(F.col("mapfile") % 4 == 0, 1).otherwise(0)).alias("v"), F.col("v").alias("pos"))
    return C.replace_definitions(stored, coming, "mapfile", "def_id", "pos")[1]


@query(
    "set_attribute",
    f"""WITH {ZONES}, rows AS (SELECT mapid, CASE WHEN mapid % 8 = 0 THEN 'explorable' ELSE instance END AS instance, mapid * 7 AS mapfile FROM zones WHERE mapid % 4 = 0)
SELECT z.mapid, z.instance, z.name, CASE WHEN r.mapid IS NOT NULL THEN r.mapfile ELSE z.mapfile END AS mapfile, z.unknown FROM zones z LEFT JOIN rows r USING (mapid, instance)
UNION ALL SELECT r.mapid, r.instance, (SELECT arg_min(name, z.instance) FROM zones z WHERE z.mapid = r.mapid), r.mapfile, NULL FROM rows r WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.mapid = r.mapid AND z.instance = r.instance)""",
)
def set_attribute(table):
    zones = _zones(table)
    rows = zones.where("mapid % 4 = 0").select("mapid", F.when(F.col("mapid") % 8 == 0, "explorable").otherwise(F.col("instance")).alias("instance"), (F.col("mapid") * 7).alias("mapfile"))
    return C.set_attribute(zones, rows, "mapid", "instance", "name", "mapfile")


@query(
    "catalog_list",
    """WITH paths AS (SELECT s_nationkey AS k, list_sort(list(DISTINCT s_name)) AS ps FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1), named AS (SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 4 <> 0),
every AS (SELECT * FROM named UNION ALL SELECT DISTINCT c_nationkey, NULL FROM customer WHERE c_nationkey NOT IN (SELECT k FROM named))
SELECT e.k, e.name, coalesce(array_to_string(p.ps, '|'), '') AS zone_paths, coalesce(len(p.ps), 0) AS n FROM every e LEFT JOIN paths p USING (k)""",
)
def catalog_list(table):
    paths = C.paths_of(table("supplier").where("s_nationkey % 3 <> 0").select(F.col("s_nationkey").alias("k"), "s_name"), "k", "s_name")
    named = table("nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    extra = C.unlisted(table("customer").select(F.col("c_nationkey").alias("k")).distinct(), named, "k")
    return C.listing(named, extra, paths, "k").select("k", "name", F.array_join("zone_paths", "|").alias("zone_paths"), F.size("zone_paths").cast("bigint").alias("n"))


@query("unlisted_items", "SELECT p_partkey, p_name FROM part WHERE p_size <> 13 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unlisted_items(table):
    files = table("part").select("p_partkey", "p_name", F.when(F.col("p_size") == 13, False).alias("is_map"))
    named = table("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return C.unlisted(files, named, "p_partkey", "is_map").select("p_partkey", "p_name")


@query("known_ids", "SELECT DISTINCT id FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT p_partkey + 1500 FROM part UNION ALL SELECT l_suppkey FROM lineitem) WHERE id <> 0 AND id IS NOT NULL")
def known_ids(table):
    return C.known_ids((table("lineitem").select("l_partkey"), "l_partkey"), (table("part").select((F.col("p_partkey") + 1500).alias("k")), "k"), (table("lineitem").select("l_suppkey"), "l_suppkey"))


@query("first_name_per_key", "SELECT p_size, arg_min(p_name, (p_partkey % 10, p_partkey)) AS name FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_size")
def first_name_per_key(table):
    rows = table("part").select("p_size", "p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"))
    return C.first_names(rows, "p_size", [F.col("p_partkey") % 10, "p_partkey"])


@query(
    "root_candidates",
    """WITH assets AS (SELECT l_orderkey AS base_id, max(l_suppkey) AS current_id, list(l_partkey) AS deps FROM lineitem GROUP BY 1)
SELECT base_id, current_id, CAST(len(deps) AS BIGINT) AS dependencies FROM assets WHERE len(deps) >= 4 AND base_id NOT IN (SELECT unnest(deps) FROM assets)""",
)
def root_candidates(table):
    assets = table("lineitem").groupBy(F.col("l_orderkey").alias("base_id")).agg(F.max("l_suppkey").alias("current_id"), F.collect_list("l_partkey").alias("deps"))
    return C.root_candidates(assets, 4)


@query("resolve_revision", "SELECT l_partkey AS base_id, count(*) AS n, coalesce(max(p.p_size), l_partkey) AS resolved FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) p ON p.p_partkey = l_partkey GROUP BY l_partkey")
def resolve_revision(table):
    ids = table("lineitem").groupBy(F.col("l_partkey").alias("base_id")).agg(F.count(F.lit(1)).alias("n"))
    assets = table("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("base_id"), F.col("p_size").cast("bigint").alias("current_id"))
    return C.resolve(ids, assets)


@query("exits_for_maps", "SELECT event_id, user_id AS from_map, CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN CAST(value AS FLOAT) END AS dir_x, event_type FROM events WHERE user_id IN (1, 5, 77)")
def exits_for_maps(table):
    rows = table("events").select("event_id", F.col("user_id").alias("from_map"), F.when(F.col("event_type") != "error", F.col("value")).alias("dir_x"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("dir_y"), "event_type")
    return C.exits(rows, [1, 5, 77]).select("event_id", "from_map", F.col("dir.x").alias("dir_x"), "event_type")


@query(
    "image_all_worklist",
    """WITH known AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey <> 0), listed AS (SELECT k.id, coalesce(p.p_size, k.id) AS revision, p.p_partkey IS NOT NULL AS listed FROM known k LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) p ON p.p_partkey = k.id),
cached AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity > 25)
SELECT l.id, l.revision, CASE WHEN NOT listed THEN 'not listed' WHEN c.id IS NOT NULL THEN 'imaged' ELSE 'to do' END AS status FROM listed l LEFT JOIN cached c ON c.id = l.id""",
)
def image_all_worklist(table):
    from wayloom.plans.jobs import worklist

    assets = table("part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("base_id"), F.col("p_size").cast("bigint").alias("current_id"))
    return worklist(C.known_ids((table("lineitem").select("l_partkey"), "l_partkey")), assets, table("lineitem").where("l_quantity > 25").select(F.col("l_suppkey").alias("id")))


@query("worklist_summary", "WITH k AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey <> 0) SELECT count(*) AS known, count(*) FILTER (WHERE id % 5 <> 0) AS listed, count(*) FILTER (WHERE id % 5 <> 0 AND id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 25)) AS to_do FROM k")
def worklist_summary(table):
    rows = image_all_worklist(table)
    return rows.agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("status") != "not listed").alias("listed"), F.count_if(F.col("status") == "to do").alias("to_do"))


@query("key_violations", "SELECT 'duplicate key' AS rule, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'l_returnflag not allowed', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem")
def key_violations(table):
    from wayloom.schemas import violations

    return violations(table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], allowed={"l_returnflag": ("A", "N")})
