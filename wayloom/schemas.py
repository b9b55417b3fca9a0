"""Table schemas, the migration of old tables, and the checks a table passes before it is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTANCES = ("outpost", "explorable")
MAP_ZONES = "mapid bigint not null, instance string not null, name string, mapfile bigint, unknown bigint"
MANIFEST_MAPFILES = "mapfile bigint not null, revision bigint, manifest bigint, dependencies bigint, is_map boolean"
ZONE_DEFS = "mapfile bigint, revision bigint, def_id bigint, ini_path string"
ZONE_EXIT = "id bigint, from_map bigint, x double, y double, plane bigint, to_map bigint, trapezoid bigint, hits bigint, dir_x double, dir_y double"
MANIFEST = "base_id bigint, current_id bigint, deps array<bigint>"
TRAPEZOIDS = (
    "map_id bigint, plane bigint, idx bigint, nb array<bigint>, portal_left int, portal_right int, y_top double, y_bottom double, "
    "x_top_left double, x_top_right double, x_bottom_left double, x_bottom_right double"
)
PORTALS = "map_id bigint, plane bigint, idx bigint, count bigint, start bigint, neighbor_plane bigint, pair bigint, flags bigint"
PORTAL_TRAPS = "map_id bigint, plane bigint, pos bigint, trap bigint"
WAYPOINTS = "list_id bigint, pos bigint, mapid bigint, x double, y double, plane bigint"
KEYS = {"map_zones": ["mapid", "instance"], "manifest_mapfiles": ["mapfile"], "zone_defs": ["mapfile", "def_id"], "zone_exit": ["id"]}


def migrate_zones(zones: DataFrame) -> DataFrame:
    """A table from before the ``instance`` column holds outposts only."""
    if "instance" not in zones.columns:
        zones = zones.withColumn("instance", F.lit(INSTANCES[0]))
    return zones.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(MAP_ZONES).fields])


def violations(df: DataFrame, key: list[str], not_null: list[str] = (), allowed: dict[str, tuple] | None = None) -> DataFrame:
    """``rule, rows``: how many rows break each rule. One pass for nulls and values, one sum for keys."""
    rules = [(f"{c} is null", F.col(c).isNull()) for c in not_null] + [(f"{c} not allowed", ~F.coalesce(F.col(c).isin(*v), F.lit(False))) for c, v in (allowed or {}).items()]
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows")).select(F.lit("duplicate key").alias("rule"), "rows")
    if not rules:
        return keys
    counts = df.agg(*[F.count_if(test).alias(f"r{i}") for i, (_, test) in enumerate(rules)])
    told = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("rows")) for i, (name, _) in enumerate(rules)])).alias("x")).select("x.*")
    return keys.unionByName(told)


def checked(df: DataFrame, key: list[str], **rules) -> DataFrame:
    """``df``, or an error that names the broken rules: for use before a commit."""
    broken = violations(df, key, **rules).where("rows > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['rows']} rows" for r in broken))
    return df
