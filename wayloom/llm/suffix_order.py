"""Order of byte strings over partitions, and the classes of equal prefixes that follow from neighbours.

Strings are sorted by ranges whose splitters come from a sample; equal ones are told apart by their place, so that many
of them spread over ranges too. Each string is compared with the one before it, byte by byte. At depth x, strings with the
same first x bytes are neighbours, and the class of a string is the first of them: the last one up to it that agrees with
the one before in fewer than x bytes. Classes that began in an earlier range are found from a few values a partition: its
first and last string, and the last string's class at each depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm import hashing
from wayloom.llm.common import small_batches, written


def agreement(strings: pa.Array, before: bytes | None) -> np.ndarray:
    """How many bytes each string has in common with the one before it; -1 for a first one."""
    data, offsets = hashing.utf8_or_bytes(strings)
    size = np.diff(offsets)
    n, wide = len(size), int(max(size.max(initial=0), len(before or b""))) + 1
    rows = np.zeros((n + 1, wide), np.uint8)
    rows[1:][np.arange(wide) < size[:, None]] = data
    rows[0, : len(before or b"")] = np.frombuffer(before or b"", np.uint8)
    differ = rows[1:] != rows[:-1]
    differ[:, -1] = True
    common = differ.argmax(1)
    common = np.minimum(common, np.minimum(size, np.concatenate([[len(before or b"")], size[:-1]])))
    if before is None and n:
        common[0] = -1
    return common


def classes(rows: DataFrame, deepest: int) -> DataFrame:
    """``c, j, classes`` of rows ``c, j, body, lo, hi``: the class of ``body`` at each depth from lo to hi."""
    spark = rows.sparkSession
    small_batches(spark)

    def run(batches):
        part, at, first, last = TaskContext.get().partitionId(), 0, None, None
        lead = np.full(deepest + 1, -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            common = agreement(batch.column(2), last).tolist()
            lo, hi = batch.column(3).to_numpy().tolist(), batch.column(4).to_numpy().tolist()
            found = []
            for i in range(batch.num_rows):
                if common[i] >= 0:
                    lead[common[i] + 1 :] = (part << 40) + at + i
                found.append(lead[lo[i] : hi[i] + 1].copy())
            at += batch.num_rows
            first, last = batch.column(2)[0].as_py() if first is None else first, batch.column(2)[batch.num_rows - 1].as_py()
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32), pa.array(np.concatenate(found)))
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), lists, pa.array(np.full(batch.num_rows, part, np.int32)), none, none], names)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([lead.tolist()], pa.list_(pa.int64())), pa.array([part], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names)

    names = ["c", "j", "lo", "classes", "part", "first", "last"]
    ordered = rows.select("c", "j", "body", "lo", "hi").orderBy("body", "c", "j")
    held = written(ordered.mapInArrow(run, "c bigint, j bigint, lo int, classes array<bigint>, part int, first binary, last binary"), "order")
    ends = sorted(held.where("first is not null").select("part", "first", "last", "classes").collect(), key=lambda r: r["part"])
    base, before, starts = np.zeros(deepest + 1, np.int64), None, []
    for r in ends:
        common = agreement(pa.array([r["first"]], pa.binary()), before)[0]
        base = base.copy()
        base[max(common + 1, 1) :] = r["part"] << 40
        starts.append((r["part"], base.tolist()))
        own = np.array(r["classes"])
        base, before = np.where(own < 0, base, own), bytes(r["last"])
    starts = F.broadcast(spark.createDataFrame(starts, "part int, starts array<bigint>"))
    rows = held.where("first is null").join(starts, "part")
    return rows.select("c", "j", F.transform("classes", lambda v, i: F.when(v >= 0, v).otherwise(F.get("starts", F.col("lo") + i))).alias("classes"))
