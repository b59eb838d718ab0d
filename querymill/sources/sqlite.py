"""A Spark data source for SQLite files: ``spark.read.format("sqlite_file").option("path", …).option("table", …)``.

A table is read in row-id ranges, one per partition, so that a large one is spread over tasks. Text that isn't
UTF-8 has its bad bytes replaced. Columns are bigint, double or string by their declared type. A table without row
ids is read in one partition. The path must be one that every worker can open.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_NUMBERS = ("number", "numeric", "real", "float", "double", "decimal")


def connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return con


def list_tables(path: str) -> list[str]:
    with connect(path) as con:
        return [n for (n,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rows(InputPartition):
    def __init__(self, low: int, high: int, whole: bool = False):
        self.low, self.high, self.whole = low, high, whole


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str, parts: int):
        self.schema, self.path, self.table, self.parts = schema, path, table, parts

    def partitions(self) -> list[Rows]:
        with connect(self.path) as con:
            try:
                low, high = con.execute(f"SELECT MIN(rowid), MAX(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Rows(0, 0, whole=True)]
        if low is None:
            return [Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(quoted(f.name) for f in self.schema.fields)
        kinds = [int if isinstance(f.dataType, LongType) else float if isinstance(f.dataType, DoubleType) else None for f in self.schema.fields]

        def value(v, kind):  # noqa: ANN001
            if v is None:
                return None
            if kind is None:
                return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
            try:
                return v if isinstance(v, kind) else kind(v) if kind is float or float(v) == int(v) else None
            except (TypeError, ValueError, OverflowError):
                return None

        where, given = ("", ()) if partition.whole else (" WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
        with connect(self.path) as con:
            for row in con.execute(f"SELECT {names} FROM {quoted(self.table)}{where}", given):
                yield tuple(value(v, k) for v, k in zip(row, kinds))


class SqliteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> StructType:
        with connect(self.options["path"]) as con:
            info = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        def kind(declared: str | None) -> LongType | DoubleType | StringType:
            low = (declared or "").lower()
            return LongType() if "int" in low else DoubleType() if any(n in low for n in _NUMBERS) else StringType()

        return StructType([StructField(name, kind(declared)) for _, name, declared, *_ in info])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options["path"], self.options["table"], int(self.options.get("partitions", "8")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteFile)


def load_database(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """A view for every table of the file; the views' names."""
    register(spark)
    names = []
    for table in list_tables(path):
        spark.read.format("sqlite_file").option("path", path).option("table", table).load().createOrReplaceTempView(f"`{prefix}{table}`")
        names.append(f"{prefix}{table}")
    return names
