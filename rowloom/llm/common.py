"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MB = 1 << 20
#: Sizes from here on are what the planner says when it does not know.
UNKNOWN = 1 << 50
BATCH_ROWS = 1000
#: Rows of a few numbers or short strings that may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        folder = sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="rowloom-")
            sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: its lineage is cut and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The planner's size estimate of df; it sets numbers of partitions only, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, UNKNOWN)


def parts_for(df: DataFrame, mb_each: float, least: int = 12, most: int = 200_000) -> int:
    """How many parts of about mb_each MB df makes; where its size is unknown, four for each shuffle partition."""
    size = input_bytes(df)
    if size >= UNKNOWN:
        return max(least, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return int(max(least, min(most, size / (mb_each * MB))))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to have at most BROADCAST_ROWS rows; for rows whose width is bounded."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def id_hash_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_bytes(column: Column) -> Column:
    return F.coalesce(column, F.lit("")).cast("binary")


def picked(rows: DataFrame, by: str, order: Column, tie: str, most: int) -> DataFrame:
    """Of rows with each value of `by` the `most` with the least `order`, a hash as a long; ties go by `tie`.

    Hashes are even, so from each value's count it is known below which hash eight times that many lie; only those rows
    move, and no task sees more of them however common a value is.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("__n"))  # few values: classes, languages
    share = F.least(F.lit(1.0), F.lit(8.0 * most) / F.col("__n"))
    within = rows.join(F.broadcast(counts.select(F.col(by).alias("__by"), share.alias("__share"))), F.col(by) == F.col("__by")).withColumn("__h", order)
    within = within.where(F.col("__h") / F.lit(2.0**64) + 0.5 <= F.col("__share"))
    ranked = within.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy("__h", tie)))
    return ranked.where(F.col("__k") <= most).select(*rows.columns)


def map_arrow(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow with batches of BATCH_ROWS rows, so that long texts do not pile up on either side, and free memory given back when a task ends."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        import gc

        # workers hold many small objects and make no cycles: looking for some again and again costs much
        gc.disable()
        try:
            yield from work(batches)
        finally:
            gc.enable()
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library
