"""A read-only SQLite source: ``spark.read.format("sqlite").options(path=..., table=...)``.

Filters that SQLite has are pushed into its WHERE clause, and only the schema's columns are read. A table is cut into
ranges of its row ids, one a partition. The file must be on a path that every executor can open; ``spread`` puts a copy
into Spark's own file distribution for small files that only the driver has.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith
from pyspark.sql.types import StructType

TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary", "BOOLEAN": "bigint"}
COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    from pyspark import SparkFiles

    where = SparkFiles.get(path.removeprefix("files:")) if path.startswith("files:") else path
    return sqlite3.connect(f"file:{where}?mode=ro", uri=True)


def spread(spark: SparkSession, path: str) -> str:
    """A path for the source's option that executors on other machines can read, for a file of the driver's."""
    spark.sparkContext.addFile(path)
    return "files:" + path.rsplit("/", 1)[-1]


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with connect(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {TYPES.get((c[2] or 'TEXT').upper().split('(')[0], 'string')}" for c in found)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.schema = options, schema
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            told = self._sql(f)
            if told:
                self.where.append(told)
            else:
                yield f

    @staticmethod
    def _sql(f: Filter) -> tuple[str, list] | None:
        if len(getattr(f, "attribute", ())) != 1:
            return None
        c = _name(f.attribute[0])
        if type(f) in COMPARE and isinstance(f.value, int | float | str):
            return f"{c} {COMPARE[type(f)]} ?", [f.value]
        if isinstance(f, EqualNullSafe) and isinstance(f.value, int | float | str | None):
            return f"{c} IS ?", [f.value]
        if isinstance(f, In) and all(isinstance(v, int | float | str) for v in f.value):
            return f"{c} IN ({','.join('?' * len(f.value))})", list(f.value)
        if isinstance(f, IsNull):
            return f"{c} IS NULL", []
        if isinstance(f, IsNotNull):
            return f"{c} IS NOT NULL", []
        if isinstance(f, StringContains):
            return f"instr({c}, ?) > 0", [f.value]
        if isinstance(f, StringStartsWith):
            return f"substr({c}, 1, ?) = ?", [len(f.value), f.value]
        return None

    def partitions(self):
        n = int(self.options.get("partitions", "4"))
        with connect(self.options["path"]) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.options['table'])}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids is one part
                return [Rows(None, None)]
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // n))
        return [Rows(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        tests, values = [w for w, _ in self.where], [v for _, vs in self.where for v in vs]
        if partition.low is not None:
            tests.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        sql = f"SELECT {', '.join(_name(f.name) for f in self.schema.fields)} FROM {_name(self.options['table'])}" + (" WHERE " + " AND ".join(tests) if tests else "")
        with connect(self.options["path"]) as db:
            yield from db.execute(sql, values)


def tables(path: str) -> dict[str, list[str]]:
    """The tables of a database with their columns."""
    with connect(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        return {n: [c[1] for c in db.execute(f"PRAGMA table_info({_name(n)})")] for n in names}


def write(path: str, table: str, columns: list[tuple[str, str]], rows: Iterator[tuple]):
    """A table from the driver's rows, for exchange with other tools; small tables only."""
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {_name(table)} ({', '.join(f'{_name(n)} {t}' for n, t in columns)})")
        db.executemany(f"INSERT INTO {_name(table)} VALUES ({','.join('?' * len(columns))})", rows)
