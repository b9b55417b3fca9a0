"""Zone-chunk analytics: definitions, layers, models, polygons and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import text as T
from wayloom.operators import sequence as S


def folder_summary(rows: DataFrame, keys: Sequence[str], path: str, pos: str) -> DataFrame:
    """The most common folder of each key (of equals the first seen), and how many others there are."""
    counts = rows.groupBy(*keys, T.short_folder(T.folder(F.col(path))).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    best = counts.groupBy(*keys).agg(F.max_by("folder", F.struct("n", -F.col("first"))).alias("top"), (F.count(F.lit(1)) - 1).alias("others"))
    return best.select(*keys, F.when(F.col("others") > 0, F.concat_ws(" +", "top", F.col("others").cast("string"))).otherwise(F.col("top")).alias("summary"))


def by_folder(defs: DataFrame, keys: Sequence[str], path: str, ordinal: str) -> DataFrame:
    """Definitions grouped by folder, groups in order of first use."""
    grouped = defs.groupBy(*keys, T.folder(F.col(path)).alias("folder")).agg(F.min(ordinal).alias("first"), F.sort_array(F.collect_list(F.struct(ordinal, path))).alias("d"))
    return grouped.select(*keys, "folder", "first", F.transform("d", lambda d: T.stem(d[path])).alias("names"))


def definition_of(zones: DataFrame, defs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each zone with the first definition of its id, if any."""
    first = defs.groupBy(*keys, "def_id").agg(F.min(F.struct("ord", "ini_path")).alias("d"))
    return zones.join(first.select(*keys, "def_id", F.col("d.ord").alias("def_ord"), F.col("d.ini_path").alias("ini_path")), [*keys, "def_id"], "left")


def orphans(zones: DataFrame, defs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return zones.join(defs.select(*keys, "def_id"), [*keys, "def_id"], "left_anti")


def zones_per_definition(defs: DataFrame, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = zones.groupBy(*keys, "def_id").agg(F.count(F.lit(1)).alias("n"))
    return defs.join(n, [*keys, "def_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def layer_models(layers: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each layer's models with their own (not summed) probability."""
    owned = S.positional(layers, models, keys, ["layer"], "model_count", "pos").where("cum_p is not null")
    return S.decumulated(owned, [*keys, "layer"], ["pos"], "cum_p")


def visible(rows: DataFrame, hidden: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't hidden; an unknown key is visible."""
    return rows.join(hidden, list(keys), "left_anti")


def required(props: DataFrame, keys: Sequence[str], ordinal: str = "ord") -> DataFrame:
    """Distinct models of props whose flag 1 is off, in the order of the first reference."""
    return props.where(F.col("flags").bitwiseAND(1) == 0).groupBy(*keys, "model").agg(F.min(ordinal).alias("first"))


def nibbles(data: str):
    """The low, then the high half of each byte of an integer array."""
    return F.flatten(F.transform(F.col(data), lambda b: F.array(b.bitwiseAND(15), F.shiftrightunsigned(b, 4).bitwiseAND(15))))


def soa_to_aos(**fields: str):
    """Arrays of fields, one per column, as one array of structs."""
    return F.transform(F.arrays_zip(*[F.col(c).alias(n) for n, c in fields.items()]), lambda x: F.struct(*[x[str(c)].alias(n) for n, c in fields.items()]))


def prop_planes(plane_props: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The planes of each prop; plane 0 is the ground and belongs to none."""
    rows = plane_props.where("plane <> 0").groupBy(*keys, "prop").agg(F.sort_array(F.collect_list("plane")).alias("planes"))
    return rows
