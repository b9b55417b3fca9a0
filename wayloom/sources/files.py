"""Map files as tables: containers to chunk rows, and each kind of chunk to its own table, by ``mapInPandas``.

A file that breaks its format gives one row with an ``error`` and no values, so one bad file stops no scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import mapfile as M
from wayloom.functions.binary import BadData

CHUNKS = "ord bigint, chunk_id bigint, data binary"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, content``; names and sizes come from the file listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length", "content")


def decoded(df: DataFrame, decode: Callable[[bytes], Iterable[dict]], schema: str, keys: list[str], content: str = "content") -> DataFrame:
    """Rows of ``keys``, ``schema`` and ``error``: what ``decode`` makes of each row's bytes."""
    fields = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                head = {k: row[k] for k in keys}
                try:
                    out += [{**head, **r, "error": None} for r in decode(bytes(row[content] or b""))]
                except BadData as e:
                    out.append({**head, **dict.fromkeys(fields), "error": str(e)})
            yield pd.DataFrame(out, columns=[*keys, *fields, "error"])

    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return df.select(*keys, content).mapInPandas(run, f"{told}, {schema}, error string")


def chunks(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return decoded(df, lambda b: M.chunks(b)[1], CHUNKS, keys, content)


def chunk(df: DataFrame, keys: list[str], chunk_id: int) -> DataFrame:
    """The first chunk of an id of each file."""
    return df.where(F.col("chunk_id") == chunk_id).groupBy(*keys).agg(F.min_by("data", "ord").alias("data"))


def chunk_list(df: DataFrame) -> DataFrame:
    """Chunks as a listing shows them: id, length, kind and first bytes. Columns only."""
    kinds = F.array(*[F.lit(k) for k in M.KINDS])
    top, low = F.shiftrightunsigned("chunk_id", 24), F.col("chunk_id").bitwiseAND(0xFF)
    ok = top.isin(*M.STAGES) & (F.col("chunk_id").bitwiseAND(0xFFFF00) == 0) & (low < len(M.KINDS))
    kind = F.when(ok, F.concat(F.get(kinds, low.cast("int")), F.when(top.isin(0x11, 0x21), " refs").otherwise("")))
    return df.withColumns({"length": F.octet_length("data"), "kind": kind, "head": F.hex(F.substring("data", 1, 12))})


def manifest(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return decoded(df, M.manifest, "base_id bigint, current_id bigint, deps array<bigint>", keys, content)


def write_containers(chunk_rows: DataFrame, keys: list[str], kind: int = 3) -> DataFrame:
    """Containers from chunk rows, one a group: ``keys, content``."""

    def join(pdf):
        rows = pdf.sort_values("ord")
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "content": M.container(kind, list(zip(rows["chunk_id"].astype(int), rows["data"].map(bytes), strict=True)))}])

    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunk_rows.select(*keys).schema.fields)
    return chunk_rows.groupBy(*keys).applyInPandas(join, f"{told}, content binary")
