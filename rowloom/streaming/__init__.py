"""Data steps on streams.

A step without state across rows is a projection, so it runs on a streaming data frame as it is: stream_step puts it
between a readStream and a writeStream. Sums by time windows with late data are bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.values import to_value
from rowloom.language.parser import Parser
from rowloom.plans.dataset import Dataset
from rowloom.plans.datastep import ColumnStep, Context


def stream_step(df: DataFrame, text: str, name: str = "stream") -> DataFrame:
    """The first output of a data step whose SET reads `name`, over a streaming frame. Steps that need an order are refused."""
    step = Parser(text).program()[0]
    columns = [to_value(df[f"`{f.name}`"], f.dataType.simpleString()).col.alias(f.name.lower()) for f in df.schema.fields]
    ds = Dataset(df.select(*columns), [])

    def dataset(wanted: str):
        if wanted != name:
            raise KeyError(f"a streaming step reads {name} only, not {wanted}")
        return ds

    plan = ColumnStep(step, Context(dataset, {}, {}))
    out = next(iter(plan.run().values()))
    if any("tier 2" in n for n in plan.notes):
        raise ValueError("a step with state across rows has no order on a stream")
    return out.visible()


def windowed_sums(df: DataFrame, time: str, keys: list[str], var: list[str], window: str, late: str) -> DataFrame:
    """Counts and sums by keys and tumbling window; rows later than `late` are left out."""
    rows = df.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return rows.agg(F.count("*").alias("n"), *(F.sum(v).alias(f"{v}_sum") for v in var)).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(f"{v}_sum" for v in var))
