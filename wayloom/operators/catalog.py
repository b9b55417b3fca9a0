"""The map catalog: search, merge with a report, snapshots, replacement of definitions, lists and lookups.

Every operator takes and returns DataFrames; a change is a new table, which the caller commits at once. Keyed changes
are equi-joins on the keys, absence is an anti-join, and first-match rules carry an ordinal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Case folding of ASCII letters only."""
    return F.translate(c, UPPER, LOWER)


def search(df: DataFrame, query: str, name: str, numbers: Sequence[str]) -> DataFrame:
    """Rows whose name holds the trimmed query (ASCII case ignored), or one of whose numbers it is."""
    q = query.strip()
    hit = F.contains(ascii_lower(F.col(name)), ascii_lower(F.lit(q)))
    try:
        n = int(q) if q.removeprefix("-").removeprefix("+").isascii() and q.removeprefix("-").removeprefix("+").isdigit() else None
    except ValueError:
        n = None
    if n is not None and -(2**63) <= n < 2**63:
        for c in numbers:
            hit = hit | (F.col(c) == F.lit(n))
    return df.where(F.coalesce(hit, F.lit(False)))


def has_value(c: str) -> Column:
    """Known and not 0."""
    return F.coalesce(F.col(c), F.lit(0)) != 0


def merge_report(local: DataFrame, incoming: DataFrame, keys: Sequence[str], required: str) -> DataFrame:
    """Each incoming row with its action and the local row it met.

    ``inserted``: no local row has its key; ``unchanged``: the rows are equal, nulls included; ``skipped``: it lacks the
    required value; else ``updated``.
    """
    columns = [c for c in incoming.columns if c not in keys]
    old = local.select(*keys, F.struct(*columns).alias("old"))
    new = incoming.select(*keys, F.struct(*columns).alias("new"))
    met = new.join(old, list(keys), "left")
    lacks = F.coalesce(F.col(f"new.{required}"), F.lit(0)) == 0
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").when(lacks, "skipped").otherwise("updated")
    return met.select(*keys, action.alias("action"), "old", "new")


def merge(local: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The local table after a report's inserted and updated rows are applied."""
    applied = report.where(F.col("action").isin("inserted", "updated")).select(*keys, "new.*")
    return local.join(applied.select(*keys), list(keys), "left_anti").unionByName(applied.select(local.columns))


def upsert(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def place_without_instance(local: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """Incoming rows marked ``unchanged`` if a local row of their key has their value (null meets null), else ``unplaced``."""
    known = local.select(F.col(key).alias("k"), F.col(value).alias("v")).distinct().withColumn("known", F.lit(True))
    met = incoming.join(known, (F.col(key) == F.col("k")) & F.col(value).eqNullSafe(F.col("v")), "left")
    return met.select(*incoming.columns, F.when(F.col("known"), "unchanged").otherwise("unplaced").alias("action"))


def record_snapshot(table: DataFrame, named: DataFrame, candidates: DataFrame, snapshot: int, key: str = "mapfile") -> tuple[DataFrame, DataFrame]:
    """``(table, new)`` after a snapshot's candidates are recorded, keeping each known row's ``is_map``.

    Nothing changes, and ``new`` is null, if a row still carries this snapshot. ``new`` counts the candidates that neither
    table knew.
    """
    seen = table.agg(F.coalesce(F.max((F.col("manifest") == snapshot).cast("int")), F.lit(0)).alias("seen"))
    fresh = candidates.select(F.col(key), "revision", "dependencies").crossJoin(F.broadcast(seen)).where("seen = 0").drop("seen")
    kept = table.select(F.col(key), "is_map")
    rows = fresh.join(kept, key, "left").select(key, "revision", F.lit(snapshot).cast("bigint").alias("manifest"), "dependencies", "is_map")
    after = table.join(fresh.select(key), key, "left_anti").select(rows.columns).unionByName(rows)
    known = table.select(key).unionByName(named.select(key).where(F.col(key).isNotNull())).distinct()
    count = fresh.join(known, key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return after, count.crossJoin(seen).select(F.when(F.col("seen") == 0, F.col("n")).alias("new"))


def set_flag(table: DataFrame, key: str, value: int, flag: str, to: bool) -> DataFrame:
    return table.withColumn(flag, F.when(F.col(key) == value, F.lit(to)).otherwise(F.col(flag)))


def first_by_key(rows: DataFrame, keys: Sequence[str], ordinal: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: that of the smallest ordinal."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(ordinal, *columns)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns])


def replace_definitions(stored: DataFrame, incoming: DataFrame, group: str, key: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """``(table, changed)``: the groups that come in replace what was stored of them.

    Of rows that share a group and key the first counts. ``changed`` has one row per incoming group.
    """
    columns = [c for c in stored.columns if c not in (group, key)]
    rows = first_by_key(incoming, [group, key], ordinal, columns)
    groups = incoming.select(group).distinct()
    after = stored.join(groups, group, "left_anti").unionByName(rows.select(stored.columns))
    mine, theirs = (d.select(group, key, F.struct(*columns).alias(n)) for d, n in ((stored.join(groups, group, "left_semi"), "old"), (rows, "new")))
    differ = mine.join(theirs, [group, key], "full").groupBy(group).agg(F.max((~F.col("old").eqNullSafe(F.col("new"))).cast("int")).alias("d"))
    return after, groups.join(differ, group, "left").select(group, (F.coalesce("d", F.lit(0)) == 1).alias("changed"))


def set_attribute(table: DataFrame, rows: DataFrame, key: str, part: str, name: str, value: str) -> DataFrame:
    """Set ``value`` of the rows ``key, part, value``; a new row borrows its name from the key's first other row."""
    there = table.select(key, part).withColumn("there", F.lit(True))
    set_ = table.join(rows.select(key, part, F.col(value).alias("v"), F.lit(True).alias("given")), [key, part], "left")
    old = set_.select(*[F.when(F.col("given"), F.col("v")).otherwise(F.col(value)).alias(value) if c == value else F.col(c) for c in table.columns])
    names = first_by_key(table, [key], part, [name])
    new = rows.join(there, [key, part], "left_anti").join(names, key, "left")
    return old.unionByName(new.select(key, part, name, value), allowMissingColumns=True)


def paths_of(defs: DataFrame, key: str, path: str, name: str = "zone_paths") -> DataFrame:
    """The distinct paths of each key, sorted."""
    return defs.groupBy(key).agg(F.sort_array(F.collect_set(path)).alias(name))


def listing(rows: DataFrame, extra: DataFrame, paths: DataFrame, key: str, name: str = "zone_paths") -> DataFrame:
    """Rows, then rows of files that no row names, each with its file's paths (none: an empty list)."""
    every = rows.unionByName(extra, allowMissingColumns=True)
    return every.join(paths, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def unlisted(files: DataFrame, named: DataFrame, key: str, flag: str | None = None) -> DataFrame:
    """Files that no row names, less those whose flag says that they are no maps."""
    kept = files.where(F.coalesce(F.col(flag), F.lit(True))) if flag else files
    return kept.join(named.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def known_ids(*tables: tuple[DataFrame, str]) -> DataFrame:
    """The distinct known (not null, not 0) ids of several columns."""
    out = None
    for df, c in tables:
        ids = df.where(has_value(c)).select(F.col(c).cast("bigint").alias("id"))
        out = ids if out is None else out.union(ids)
    return out.distinct()


def first_names(rows: DataFrame, key: str, order: Sequence[str | Column], name: str = "name") -> DataFrame:
    """The first name that isn't null of each key."""
    known = rows.where(F.col(name).isNotNull() & F.col(key).isNotNull())
    return known.groupBy(key).agg(F.min(F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order], F.col(name).alias("first_name"))).alias("b")).select(key, F.col("b.first_name").alias(name))


def root_candidates(assets: DataFrame, least: int = 50) -> DataFrame:
    """Assets of at least ``least`` dependencies that no asset depends on: ``base_id, current_id, dependencies``."""
    used = assets.select(F.explode("deps").alias("base_id")).distinct()
    return assets.where(F.size("deps") >= least).join(used, "base_id", "left_anti").select("base_id", "current_id", F.size("deps").cast("bigint").alias("dependencies"))


def resolve(ids: DataFrame, assets: DataFrame, column: str = "base_id") -> DataFrame:
    """Each id with its current revision; an unknown id is its own."""
    now = assets.select(F.col("base_id").alias(column), F.col("current_id").alias("resolved"))
    return ids.join(now, column, "left").withColumn("resolved", F.coalesce("resolved", column))


def exits(table: DataFrame, maps: Sequence[int], key: str = "from_map") -> DataFrame:
    """Exits of the maps, with a direction only if both parts are known, as 32-bit floats."""
    direction = F.when(F.col("dir_x").isNotNull() & F.col("dir_y").isNotNull(), F.struct(F.col("dir_x").cast("float").alias("x"), F.col("dir_y").cast("float").alias("y")))
    return table.where(F.col(key).isin(*maps) if maps else F.lit(False)).withColumn("dir", direction).drop("dir_x", "dir_y")


def annotations(maps: DataFrame, **parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Per map, each part's value or an empty default, and the notes of the parts that failed.

    A part is ``(values, failures)``: tables of ``map_id, value`` and ``map_id, note``.
    """
    out = maps
    notes = []
    for name, (values, failures) in parts.items():
        out = out.join(values.select("map_id", F.col("value").alias(name)), "map_id", "left").join(failures.select("map_id", F.col("note").alias(f"note_{name}")), "map_id", "left")
        notes.append(f"note_{name}")
    return out.withColumn("notes", F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.col(n)) for n in notes]))).drop(*notes)


def tally(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def loaded_map(rows: DataFrame, column: str = "mapid") -> DataFrame:
    """The one map id that all rows have, else null."""
    return rows.agg(F.when(F.count_distinct(column) == 1, F.max(column)).alias(column))
