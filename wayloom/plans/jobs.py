"""Work lists and cached results: only what is missing is computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.catalog import resolve


def worklist(known: DataFrame, assets: DataFrame, cached: DataFrame, limit: int | None = None) -> DataFrame:
    """Each known id, its revision and its status; a limit keeps the first that are to do, by id."""
    listed = assets.select(F.col("base_id").alias("id"), F.lit(True).alias("listed"))
    have = cached.select("id").distinct().withColumn("have", F.lit(True))
    rows = resolve(known.select("id"), assets, "id").withColumnRenamed("resolved", "revision")
    rows = rows.join(listed, "id", "left").join(have, "id", "left")
    status = F.when(F.col("listed").isNull(), "not listed").when(F.col("have"), "imaged").otherwise("to do")
    out = rows.select("id", "revision", status.alias("status"))
    return out.where("status = 'to do'").orderBy("id").limit(limit) if limit is not None else out


def run_missing(jobs: DataFrame, cache: DataFrame, keys: list[str], work: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(cache with what was missing, status of each job done)``.

    ``work`` maps an iterator of pandas batches of jobs to rows of ``schema``, which has the keys, ``status`` and
    ``notes``; it reports failures as rows, so one job's failure is no other's.
    """
    missing = jobs.join(cache.select(*keys), keys, "left_anti")
    done = missing.mapInPandas(work, schema)
    good = done.where("status = 'ok'").drop("status", "notes")
    return cache.unionByName(good), done.select(*keys, "status", "notes")


def newest(files: DataFrame, key: str = "mapfile") -> DataFrame:
    """The last modified file of each key; of equal times the last path."""
    return files.groupBy(key).agg(F.max(F.struct("modificationTime", "path")).alias("m")).select(key, "m.path")


def fetch(ids: DataFrame, cache: DataFrame, provider: Callable[[int], bytes | None], best_effort: bool = False) -> DataFrame:
    """``id, content, status`` of distinct ids, cached ones first; the provider is asked for each other id once."""
    wanted = ids.select("id").distinct()
    have = wanted.join(cache, "id").select("id", "content", F.lit("cached").alias("status"))

    def get(batches):
        for pdf in batches:
            content, status = [], []
            for i in pdf["id"]:
                try:
                    found = provider(int(i))
                    content.append(found)
                    status.append("not found" if found is None else "fetched")
                except Exception as e:
                    if not best_effort:
                        raise
                    content.append(None)
                    status.append(f"failed: {e}")
            yield pdf.assign(content=content, status=status)[["id", "content", "status"]]

    return have.unionByName(wanted.join(cache.select("id"), "id", "left_anti").mapInPandas(get, "id bigint, content binary, status string"))
