"""Exact deduplication by a stateful stream.

Every text becomes a ledger row: digest of its normalised bytes, stable identifier, size and content locator (a file and
the row in it). The ledger is read as a stream; its keyed state, in RocksDB with no expiry, retains for each digest the
number of rows and the identifier and locator of the row that stays. Partial sums go before the shuffle, so a digest
that a third of all rows share is a few rows in the exchange. Rows of a digest that more than one row has are hits: their
texts are fetched by their locators, the retained row's from whatever file holds it, and compared byte for byte (the least
and the greatest text of a digest are the same). A digest that two texts share is split by the texts.

With a ``state_dir`` the ledger and the state stay there, and a later call adds its rows to them: it reads its own texts
and, of earlier files, the retained rows of its hits.

Defined cases: null text is empty; very long texts are read whole; of each group one row stays, told by its locator; null
ids take part and lose every tie but among themselves; repeated rows are copies; an empty table gives an empty result;
other columns are ignored (``deduplicated`` returns them).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import HEAVY, rows_of_files, heavy_join, located, scratch, whole_text, without, written

SPACES = " \t\n\x0b\x0c\r"
#: State in RocksDB, uploaded as changes, without reserving disk ahead: a store is small, and there is one a partition.
#: All stores of an executor share a bounded memory, and are closed soon after their stream ends.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}
#: Locators of hits up to this many rows (48 bytes each) are broadcast; beyond it they are shuffled.
MOST_BROADCAST = 200_000


def normal(text: str = "text") -> Column:
    return F.translate(whole_text(text), SPACES, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


_LEDGER = "doc_id bigint, digest binary, n_chars bigint, file string, row bigint, f bigint, run string"
_BEST = "struct<n_chars:bigint,order:bigint,doc_id:bigint,file:string,row:bigint,f:bigint>"


def _best() -> Column:
    """What decides which row stays: the most code points, the smallest id, then the locator."""
    return F.max(F.struct("n_chars", (-F.col("doc_id")).alias("order"), "doc_id", "file", "row", "f")).alias("best")


def _stream_state(spark: SparkSession, place: str, files_a_batch: int) -> DataFrame:
    """``digest, n, best``: the final state of the stream over the ledger's files."""
    source = spark.readStream.schema(_LEDGER).option("maxFilesPerTrigger", files_a_batch).parquet(f"{place}/ledger")
    state = source.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best())
    keep = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = (
            state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{place}/stream")
            .foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}")).start()
        )
        stream.awaitTermination()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # count and best only grow, so each digest's last state is its greatest
    final = spark.read.schema(f"digest binary, n bigint, best {_BEST}").parquet(f"{place}/out")
    return written(final.groupBy("digest").agg(F.max("n").alias("n"), F.max("best").alias("best")), "state-final")


def _verdict(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column], files_a_batch: int, state_dir: str | None) -> DataFrame:
    """``doc_id, f, row, keep_id, group_size, kept, digest`` of every row."""
    spark = docs.sparkSession
    place, run = state_dir or scratch(spark, "exact"), uuid.uuid4().hex
    texts = located(docs, F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"), place=f"{state_dir}/texts/run={run}" if state_dir else None)
    size = F.char_length("text").cast("bigint").alias("n_chars")
    texts.select("doc_id", digest(normal()).alias("digest"), size, "file", "row", "f", F.lit(run).alias("run")).write.mode("append").parquet(f"{place}/ledger")
    ledger = spark.read.schema(_LEDGER).parquet(f"{place}/ledger").where(F.col("run") == run)
    state = _stream_state(spark, place, files_a_batch)
    own_counts = ledger.groupBy("digest").agg(F.count(F.lit(1)).alias("n")) if state_dir else state
    heavy = own_counts.where(F.col("n") > HEAVY * ledger.count()).select("digest")
    verdict = heavy_join(ledger.drop("n_chars", "file", "run"), state, "digest", heavy)
    own = (F.col("f") == F.col("best.f")) & (F.col("row") == F.col("best.row"))
    verdict = verdict.select("doc_id", "f", "row", "digest", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), "best")
    hits = written(verdict.where("group_size > 1"), "hits")
    clash = _clashes(texts, hits, ledger, text)
    verdict = verdict.drop("best")
    if clash is not None:  # two texts, one digest: groups are by digest and text
        if state_dir:
            raise ValueError("two texts share a digest: a kept state can't tell them apart")
        split = texts.select("doc_id", "file", "row", "f", normal().alias("norm"), size).withColumn("digest", digest(F.col("norm"))).join(clash, "digest", "left_semi")
        groups = split.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), _best())
        again = split.join(groups, ["digest", "norm"]).select("doc_id", "f", "row", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", own.alias("kept"))
        verdict = verdict.join(clash, "digest", "left_anti").unionByName(again)
    return verdict


def _clashes(texts: DataFrame, hits: DataFrame, ledger: DataFrame, text: str) -> DataFrame | None:
    """Digests under which two different texts lie: the whole texts of the hits and of the rows retained for them."""
    count = hits.count()
    if not count:
        return None
    fetched = hits.select("f", "row", "digest")
    fetched = texts.select("f", "row", normal().alias("norm")).join(F.broadcast(fetched) if count <= MOST_BROADCAST else fetched, ["f", "row"])
    bodies = fetched.select("digest", "norm")
    # retained rows of earlier runs lie in other files
    files = ledger.select(F.col("file").alias("own")).distinct()
    before = hits.select("digest", "best.file", F.col("best.row").alias("row")).distinct().join(files, F.col("file") == F.col("own"), "left_anti")
    others = [r["file"] for r in before.select("file").distinct().collect()]
    if others:
        spark = texts.sparkSession
        held = spark.read.parquet(*others)
        body = whole_text(text if text in held.columns else "text")
        old = held.select(body.alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        bodies = bodies.unionByName(old.join(before, ["file", "row"]).select("digest", normal().alias("norm")))
    # sums before the shuffle: a digest that very many rows have is a row a task
    ends = bodies.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    wrong = written(ends.where(F.col("least") != F.col("greatest")).select("digest"), "clashes")
    return wrong if wrong.head(1) else None


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_a_batch: int = 64, state_dir: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``."""
    return _verdict(docs, doc_id, text, digest, files_a_batch, state_dir).drop("f", "row")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    if not rows_of_files(docs):
        docs = written(docs, "source")
    gone = written(_verdict(docs, doc_id, text, sha256, 64, None).where("not kept").select(F.col("f").alias("__f"), F.col("row").alias("__row")), "gone")
    return without(docs, gone)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
