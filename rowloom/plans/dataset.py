"""Datasets: data frames of numbers and character values with an explicit row order.

Hidden columns begin with two underscores. The order is a list of hidden columns with their directions; whatever does not
depend on it never reads them, and Catalyst prunes them.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions.values import Val, to_value

DATE_FORMATS = {"date": "date9.", "timestamp": "datetime20.", "timestamp_ntz": "datetime20."}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="rowloom-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: evaluated once, lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_last(col: Column, ascending: bool) -> Column:
    """Missing is least whichever way."""
    return col.asc_nulls_first() if ascending else col.desc_nulls_last()


@dataclass
class Dataset:
    df: DataFrame
    order: list[tuple[str, bool]] = field(default_factory=list)
    formats: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    #: The rows as they are scanned, before they get their order; only as long as nothing else has been done to them.
    scan: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def kind(self, name: str) -> str:
        return "char" if self.df.schema[name].dataType.simpleString() == "string" else "num"

    def val(self, name: str) -> Val:
        return Val(F.col(f"`{name}`"), self.kind(name))

    def sort_columns(self) -> list[Column]:
        return [first_last(F.col(c), up) for c, up in self.order]

    def visible(self) -> DataFrame:
        """The data in no particular order."""
        return self.df.select(*(f"`{c}`" for c in self.columns))

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.sort_columns()).select(*(f"`{c}`" for c in self.columns)) if self.order else self.visible()

    def filtered(self, test: Column) -> Dataset:
        """The rows that pass; below the order of rows that are scanned, so that the test reaches the scan."""
        if self.scan is None:
            return self.with_df(self.df.where(test))
        rows = self.scan.where(test)
        return Dataset(rows.withColumn("__o0", F.monotonically_increasing_id()), list(self.order), dict(self.formats), dict(self.labels), rows)

    def with_df(self, df: DataFrame) -> Dataset:
        return Dataset(df, self.order, dict(self.formats), dict(self.labels))

    def sorted_by(self, names: list[str], descending: list[bool]) -> Dataset:
        """The same rows, ordered by names and then as before: a stable sort that moves nothing yet."""
        n = len(names)
        old = {c: f"__o{n + i}" for i, (c, _) in enumerate(self.order)}
        kept = [F.col(f"`{c}`") for c in self.columns] + [F.col(c).alias(new) for c, new in old.items()]
        df = self.df.select(*kept, *(sort_key(self, name).alias(f"__o{i}") for i, name in enumerate(names)))
        order = [(f"__o{i}", not d) for i, d in enumerate(descending)] + [(old[c], up) for c, up in self.order]
        return Dataset(df, order, dict(self.formats), dict(self.labels))


def sort_key(ds: Dataset, name: str) -> Column:
    v = ds.val(name)
    return F.rtrim(F.coalesce(v.col, F.lit(""))) if v.kind == "char" else v.col


def from_frame(df: DataFrame, lower: bool = True, nan: bool = True) -> Dataset:
    """A data frame as a dataset; its rows are in the order in which Spark scans them. Without nan, NaN is not looked for, so that filters reach the scan."""
    columns, formats = [], {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        name = f.name.lower() if lower else f.name
        columns.append(to_value(df[f"`{f.name}`"], kind, nan).col.alias(name))
        if kind in DATE_FORMATS:
            formats[name] = DATE_FORMATS[kind]
    rows = df.select(*columns)
    return Dataset(rows.withColumn("__o0", F.monotonically_increasing_id()), [("__o0", True)], formats, {}, rows)


def numbered(ds: Dataset) -> Dataset:
    """ds with __n, the number of each row from 1 in order, and __p, which stretch of consecutive rows it is in.

    Rows are sorted by ranges over many tasks and written once; the sizes of the ranges, one number for each task, give each
    range its offset. No task gets all rows.
    """
    if "__n" in ds.df.columns:
        return ds
    rows = ds.df.orderBy(*ds.sort_columns()) if ds.order else ds.df
    rows = stored(rows.withColumns({"__p": F.spark_partition_id(), "__s": F.monotonically_increasing_id()}), "numbered")
    sizes = sorted((r["__p"], r["n"]) for r in rows.groupBy("__p").agg(F.count("*").alias("n")).collect())
    offsets, total = {}, 0
    for p, n in sizes:
        offsets[p] = total
        total += n
    before = rows.sparkSession.createDataFrame(list(offsets.items()), "__p int, __before long")  # one row for each task of the sort
    n = F.col("__s").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    df = rows.join(F.broadcast(before), "__p").withColumn("__n", n.cast("double")).drop("__s", "__before", *(c for c, _ in ds.order))
    return Dataset(df, [("__n", True)], dict(ds.formats), dict(ds.labels))


def running(ds: Dataset, value: Column, how: str, name: str) -> Dataset:
    """ds (numbered) with a running sum, min, max, or last non-null value over all rows up to each.

    Each stretch of rows runs on its own; what the stretches before it come to, one row a stretch, is added.
    """
    f = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    own = ds.df.withColumn("__x", value)
    inside = own.withColumn("__in", f(F.col("__x")).over(Window.partitionBy("__p").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)))
    if how == "last":
        ends = own.groupBy("__p").agg(F.max(F.when(F.col("__x").isNotNull(), F.struct("__n", "__x"))).alias("s")).select("__p", F.col("s.__x").alias("__e"))
    else:
        ends = own.groupBy("__p").agg(f(F.col("__x")).alias("__e"))
    before = ends.select("__p", f(F.col("__e")).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    both = inside.join(F.broadcast(before), "__p", "left")  # one row for each task of the sort
    if how == "sum":
        out = F.coalesce(F.col("__b"), F.lit(0.0)) + F.coalesce(F.col("__in"), F.lit(0.0))
        out = F.when(F.col("__b").isNotNull() | F.col("__in").isNotNull(), out)
    elif how == "last":
        out = F.coalesce("__in", "__b")
    else:
        out = (F.greatest if how == "max" else F.least)("__in", "__b")
    return ds.with_df(both.withColumn(name, out).drop("__x", "__in", "__b"))
