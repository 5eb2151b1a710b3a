"""Text files and inline data as row sources, and files as sinks."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import formats
from rowloom.functions.values import Val
from rowloom.language.ast import DataStep
from rowloom.plans.dataset import Dataset, from_frame, numbered


def numbered_lines(spark: SparkSession, path: str, firstobs: int = 1, obs: int | None = None) -> DataFrame:
    """(value, __n): a text file's lines, numbered in file order without bringing them to one task."""
    lines = spark.read.text(path).withColumn("__o0", F.monotonically_increasing_id())
    out = numbered(Dataset(lines, [("__o0", True)])).df.select(F.regexp_replace("value", "\r$", "").alias("value"), "__n")
    if firstobs > 1:
        out = out.where(F.col("__n") >= firstobs)
    return out if obs is None else out.where(F.col("__n") <= obs)


def inline_or_file(spark: SparkSession, step: DataStep) -> Dataset | None:
    """The rows of a step with INPUT, or None for others."""
    from rowloom.plans.datastep import walk

    inputs = [s for s in walk(step.body) if s.kind == "input"]
    if not inputs or (step.lines is None and not any(s.kind == "infile" for s in walk(step.body))):
        return None
    items = [i for s in inputs for i in [*s["items"], ("line", None)]][:-1]
    options = next((s.args for s in walk(step.body) if s.kind == "infile"), {})
    if step.lines is not None:
        rows = [(x, float(k + 1)) for k, x in enumerate(line for line in step.lines if line.strip())]
        lines = spark.createDataFrame(rows, "value string, __n double")
    else:
        path = str(options["path"])
        lines = numbered_lines(spark, path, int(options.get("firstobs") or 1), int(options["obs"]) if options.get("obs") else None)
        lines = lines.where(F.trim("value") != "")
    return read_fields(lines, items, options)


def read_fields(lines: DataFrame, items: list[tuple], options: dict) -> Dataset:
    """Fields by list, by column or by pointer; /, # take further lines of a record, as many for each."""
    per, at = 1, 1
    for i in items:
        if i[0] == "line":
            at = at + 1 if i[1] is None else i[1]
            per = max(per, at)
    if per > 1:
        dense = numbered(Dataset(lines.withColumn("__o0", F.col("__n")).drop("__n"), [("__o0", True)])).df
        group = F.floor((F.col("__n") - 1) / per)
        records = dense.groupBy(group.alias("__g")).agg(F.array_sort(F.collect_list(F.struct("__n", "value"))).alias("x"))
        rows = records.select(F.transform("x", lambda r: r["value"]).alias("__lines"), (F.col("__g") + 1).cast("double").alias("__o0"))
    else:
        rows = lines.select(F.array("value").alias("__lines"), F.col("__n").alias("__o0"))
    blanks = not options.get("dsd") and not options.get("dlm")
    mark = str(options.get("dlm") or ("," if options.get("dsd") else " "))[:1]
    at, column, field = 1, None, 0
    out: list[Column] = []
    line = lambda: F.coalesce(F.get("__lines", at - 1), F.lit(""))

    def listed(k: int) -> Column:
        text = line()
        if options.get("dsd"):
            # a quoted field may hold the delimiter
            cut = "\\" + mark if not mark.isalnum() and mark != " " else mark
            parts = F.split(text, cut + r"(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
            value = F.coalesce(F.get(parts, k), F.lit(""))
            inner = F.regexp_replace(F.trim(value), '^"|"$', "")
            return F.replace(inner, F.lit('""'), F.lit('"'))
        cut = r"\s+" if blanks or mark == " " else "[" + "\\" + mark + "]+"
        parts = F.filter(F.split(text, cut), lambda x: x != "")
        return F.coalesce(F.get(parts, k), F.lit(""))

    for i in items:
        if i[0] == "line":
            at, column, field = at + 1 if i[1] is None else i[1], None, 0
        elif i[0] == "col":
            column = i[1]
        elif i[0] == "skip":
            column = (column or 1) + i[1]
        else:
            _, name, char, fmt, low, high = i
            width = int("".join(c for c in (fmt or "").split(".")[0] if c.isdigit()) or 0) if fmt else 0
            if low is not None:
                text, column = F.substring(line(), low, high - low + 1), high + 1
            elif fmt and width and (column is not None or blanks and formats.split_format(fmt)[0] not in ("", "$", "$char") or column is not None):
                start = column or 1
                text, column = F.substring(line(), start, width), start + width
            elif fmt and width and blanks and field == 0 and column is None and len(items) > 0 and formats.split_format(fmt)[0] in ("", "$", "$char"):
                text, column = F.substring(line(), 1, width), 1 + width
            elif column is not None and not fmt:
                rest = F.ltrim(line().substr(F.lit(column), F.char_length(line())))
                text = F.coalesce(F.get(F.split(rest, r"\s+"), 0), F.lit(""))
            else:
                text, field = listed(field), field + 1
            value = formats.informat(Val(text, "char"), fmt) if fmt else Val(F.trim(text), "char")
            if char or value.kind == "char" and fmt and fmt.startswith("$"):
                out.append(F.coalesce(F.regexp_replace(text if not fmt else value.col, r"^\s+|\s+$", ""), F.lit("")).alias(name))
            else:
                out.append((value.col if value.kind == "num" else F.trim(text).try_cast("double")).alias(name))
    return Dataset(rows.select(*out, "__o0"), [("__o0", True)])


def import_table(spark: SparkSession, path: str, dbms: str = "csv", header: bool = True) -> Dataset:
    if dbms not in ("csv", "dlm", "tab"):
        raise ValueError(f"DBMS={dbms} is not supported")
    df = spark.read.option("header", header).option("inferSchema", True).option("sep", "\t" if dbms == "tab" else ",").csv(path)
    return from_frame(df.toDF(*(c.strip().lower() for c in df.columns)))


def export_table(ds: Dataset, path: str, dbms: str = "csv") -> None:
    """One file with a header, in order. Spark writes it beside its place and the part file is moved."""
    folder = f"{path}.parts"
    ds.ordered().coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t" if dbms == "tab" else ",").csv(folder)
    part = next(f for f in os.listdir(folder) if f.startswith("part-"))
    shutil.move(f"{folder}/{part}", path)
    shutil.rmtree(folder)


def write_lines(path: str, lines: list[str], add: bool) -> None:
    with open(path, "a" if add else "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines)
