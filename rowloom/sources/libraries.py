"""Libraries: folders of tables, SQLite files and JDBC addresses."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowloom.plans.dataset import Dataset
from rowloom.sources import files


class Library:
    def read(self, table: str) -> DataFrame:
        raise NotImplementedError

    def write(self, table: str, ds: Dataset) -> None:
        raise NotImplementedError

    def drop(self, table: str) -> None:
        raise NotImplementedError

    def rename(self, old: str, new: str) -> None:
        raise NotImplementedError

    def names(self) -> list[str]:
        raise NotImplementedError


class Folder(Library):
    """table.parquet, table.csv or table.sas7bdat in a folder; new tables are CSV."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, table: str) -> str | None:
        return next((p for kind in ("parquet", "sas7bdat", "csv") if os.path.exists(p := f"{self.path}/{table}.{kind}")), None)

    def read(self, table: str) -> DataFrame:
        path = self._path(table)
        if path is None:
            raise KeyError(f"no table {table} in {self.path}")
        if path.endswith(".parquet"):
            return self.spark.read.parquet(path)
        if path.endswith(".sas7bdat"):
            self.spark.dataSource.register(BinarySource)
            return self.spark.read.format("rowloom_binary_table").option("path", path).load()
        return self.spark.read.option("header", True).option("inferSchema", True).csv(path)

    def write(self, table: str, ds: Dataset) -> None:
        files.export_table(ds, f"{self.path}/{table}.csv")

    def drop(self, table: str) -> None:
        path = self._path(table)
        if path and os.path.isfile(path):
            os.remove(path)

    def rename(self, old: str, new: str) -> None:
        path = self._path(old)
        if path:
            os.rename(path, f"{self.path}/{new}.{path.rsplit('.', 1)[1]}")

    def names(self) -> list[str]:
        return sorted({f.rsplit(".", 1)[0].lower() for f in os.listdir(self.path) if f.endswith((".csv", ".parquet", ".sas7bdat"))})


class Sqlite(Library):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.dataSource.register(SqliteSource)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.format("rowloom_sqlite").option("path", self.path).option("table", table).load()

    def write(self, table: str, ds: Dataset) -> None:
        """Rows go to the file from the driver, a partition at a time."""
        kinds = ", ".join(f'"{c}" {"TEXT" if ds.kind(c) == "char" else "REAL"}' for c in ds.columns)
        with sqlite3.connect(self.path) as con:
            con.execute(f'DROP TABLE IF EXISTS "{table}"')
            con.execute(f'CREATE TABLE "{table}" ({kinds})')
            con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(ds.columns))})', (tuple(r) for r in ds.ordered().toLocalIterator()))

    def drop(self, table: str) -> None:
        with sqlite3.connect(self.path) as con:
            con.execute(f'DROP TABLE IF EXISTS "{table}"')

    def rename(self, old: str, new: str) -> None:
        with sqlite3.connect(self.path) as con:
            con.execute(f'ALTER TABLE "{old}" RENAME TO "{new}"')

    def names(self) -> list[str]:
        with sqlite3.connect(self.path) as con:
            return [r[0].lower() for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


class Jdbc(Library):
    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.url = spark, url

    def read(self, table: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, table)

    def write(self, table: str, ds: Dataset) -> None:
        ds.visible().write.mode("overwrite").jdbc(self.url, table)

    def drop(self, table: str) -> None:
        raise NotImplementedError("dropping tables over JDBC")


def open_library(spark: SparkSession, path: str) -> Library:
    if path.startswith("sqlite:///"):
        return Sqlite(spark, path[len("sqlite:///") :])
    if "://" in path or path.startswith("jdbc:"):
        return Jdbc(spark, path if path.startswith("jdbc:") else f"jdbc:{path}")
    if os.path.isdir(path):
        return Folder(spark, path)
    if path.endswith((".db", ".sqlite", ".sqlite3")) or os.path.isfile(path):
        return Sqlite(spark, path)
    raise FileNotFoundError(f"no library at {path}")


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """A SQLite table, read by ranges of rowid."""

    @classmethod
    def name(cls) -> str:
        return "rowloom_sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(self.options["path"]) as con:
            info = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        number = ("INT", "REAL", "FLOA", "DOUB", "NUM", "DEC")
        return T.StructType([T.StructField(r[1].lower(), T.DoubleType() if any(n in (r[2] or "").upper() for n in number) else T.StringType()) for r in info])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.names, self.kinds = path, table, schema.names, [f.dataType.simpleString() for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.path) as con:
            low, high = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        size = max(100_000, (high - low + 1) // 64 + 1)
        return [_Rows(k, min(k + size - 1, high)) for k in range(low, high + 1, size)] or [_Rows(0, -1)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        with sqlite3.connect(self.path) as con:
            columns = ", ".join(f'"{n}"' for n in self.names)
            for row in con.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (partition.low, partition.high)):
                yield tuple(None if v is None else float(v) if k == "double" else str(v) for v, k in zip(row, self.kinds, strict=True))


class BinarySource(DataSource):
    """A binary table file of the statistical package that pandas can read, in chunks."""

    @classmethod
    def name(cls) -> str:
        return "rowloom_binary_table"

    def schema(self) -> T.StructType:
        head = next(iter(pd.read_sas(self.options["path"], encoding="utf-8", chunksize=10)))
        return T.StructType([T.StructField(c.lower(), T.StringType() if head[c].dtype == object else T.DoubleType()) for c in head.columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BinaryReader(self.options["path"], schema)


class _BinaryReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for chunk in pd.read_sas(self.path, encoding="utf-8", chunksize=50_000):
            chunk.columns = [c.lower() for c in chunk.columns]
            yield from pa.Table.from_pandas(chunk, preserve_index=False).to_batches()
