"""What the training-data operators share: the shared folder, written tables and batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ONLY: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may lack it; it then gets a temporary folder of its own. A cluster without the
    setting is an error, because a machine-local folder would lose files between executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ONLY:
        _LOCAL_ONLY[app] = tempfile.mkdtemp(prefix="wayloom-")
    return _LOCAL_ONLY[app]


_SCOPES: list[list[str]] = []
_LEAVES: set[str] = set()


def _path(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the application's are deleted when it ends, those of ``temporary`` before."""
    top = f"{shared_dir(spark).rstrip('/')}/wayloom/{spark.sparkContext.applicationId}"
    if top not in _LEAVES:
        _LEAVES.add(top)
        fs, path = _path(spark, top)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    place = f"{top}/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(place)
    return f"{place}/{label}"


def drop(spark: SparkSession, place: str) -> None:
    """Delete a table or folder."""
    fs, path = _path(spark, place)
    fs.delete(path, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What operators write within this is deleted at its end: nothing that is still read may depend on it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for place in _SCOPES.pop():
            drop(spark, place)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of_files(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is a row of a file: a scan with nothing but projections and filters above it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1:
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()
    try:
        return not plan.children().size() and docs.select("_metadata.file_path", "_metadata.row_index") is not None
    except AnalysisException:
        return False


def located(docs: DataFrame, *columns: Column, place: str | None = None) -> DataFrame:
    """``columns`` of ``docs`` with each row's locator: ``file`` and ``row`` in it, and ``f``, the file as a number.

    Rows that are in no file are written first, to ``place`` or the shared folder.
    """
    if not rows_of_files(docs):
        spark = docs.sparkSession
        place = place or scratch(spark, "source")
        docs.select(*columns).write.mode("append").parquet(place)
        docs = spark.read.parquet(place)
        columns = tuple(F.col(f"`{c}`") for c in docs.columns)
    return docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).withColumn("f", F.xxhash64("file"))


#: Locators up to this many rows (16 bytes each) are broadcast; beyond it they are shuffled.
MOST_LOCATORS = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, which are rows of files, but for those at the locators ``__f, __row``; all their columns."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*names, F.xxhash64("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__row"))
    gone = F.broadcast(gone) if gone.count() <= MOST_LOCATORS else gone
    return rows.join(gone, ["__f", "__row"], "left_anti").select(*names)


#: A key with more than this share of a table's rows is heavy: there are fewer than 1 / HEAVY of them, whatever the table.
HEAVY, SALTS = 1e-3, 32


def heavy_join(many: DataFrame, one: DataFrame, on: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has one row a key; rows of the keys in ``heavy`` are dealt over ``SALTS`` tasks.

    ``heavy`` holds keys of more than the share ``HEAVY`` of ``many``, so it is under 1 / HEAVY rows and is broadcast.
    """
    marked = F.broadcast(heavy.select(F.col(on).alias("__key"), F.lit(SALTS).alias("__salts")))
    own = lambda df: df.join(marked, F.col(on) == F.col("__key"), "left").withColumn("__salts", F.coalesce("__salts", F.lit(1))).drop("__key")
    left = own(many).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.col("__salts")).cast("int")).drop("__salts")
    right = own(one).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return left.join(right, [on, "__salt"], how).drop("__salt")


def small_batches(spark: SparkSession, most: int = 1 << 20) -> None:
    """Bound the bytes of an Arrow batch. Plans read the option when they run, so it stays set; a lower one is kept."""
    option = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(option))
    if not 0 < now <= most:
        spark.conf.set(option, f"{most}b")


_KEPT: dict[str, object] = {}


def keeps(operator: str, clear) -> None:
    """``operator`` keeps something in the worker between tasks, which ``clear`` drops."""
    _KEPT[operator] = clear


def starts(operator: str) -> None:
    """A task of ``operator`` starts in this worker, which other operators have used: drop what they keep."""
    for other, clear in _KEPT.items():
        if other != operator:
            clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def whole_text(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose ``column`` holds about ``most`` bytes each, one row at least."""
    values = batch.column(batch.schema.get_field_index(column))
    lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
