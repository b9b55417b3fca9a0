"""Incremental scans: files or rows that are new since the last run are worked on once and merged by key.

A run is a Structured Streaming query that takes what is there and ends (``availableNow``). Each micro-batch is written to
a folder named by its number, overwriting it, so a batch that runs again after a failure leaves one copy. The current
table is the last write of each key: a sum over the batches, with no state to keep between runs but the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, source: str, target: str, work: Callable[[DataFrame], DataFrame], format: str = "binaryFile", schema: StructType | str | None = None, files_a_batch: int = 1000) -> int:
    """Run ``work`` over what is new in ``source`` and write it under ``target``; the number of batches done so far."""
    reader = spark.readStream.format(format).option("maxFilesPerTrigger", files_a_batch)
    if schema is None and format == "binaryFile":
        schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = reader.schema(schema).load(source)

    def put(batch: DataFrame, number: int):
        work(batch).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{target}/checkpoint").foreachBatch(put).start()
    query.awaitTermination()
    last = query.lastProgress
    return last["batchId"] + 1 if last else 0


def current(spark: SparkSession, target: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The last row of each key: by batch, then by ``order``."""
    rows = spark.read.parquet(f"{target}/rows")
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("batch", *order)).alias("r"))
    return best.select(*keys, "r.*")


def compacted(spark: SparkSession, target: str, to: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The current table as one snapshot under ``to``."""
    current(spark, target, keys, order).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)
