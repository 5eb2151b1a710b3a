"""Procedures that reshape, order and compare tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.formats import apply_format
from rowloom.functions.values import Val, number_text, text
from rowloom.plans.dataset import Dataset, numbered, running, sort_key
from rowloom.plans.sources import concatenate


def group_keys(ds: Dataset, by: list[str]) -> list:
    return [sort_key(ds, k) for k in by]


def plain(df: DataFrame, order: list[str] | None = None) -> Dataset:
    """A result table, ordered by columns of its own."""
    if not order:
        return Dataset(df, [])
    return Dataset(df.withColumns({f"__o{i}": F.col(f"`{c}`") for i, c in enumerate(order)}), [(f"__o{i}", True) for i in range(len(order))])


def sort(ds: Dataset, by: list[str], descending: list[bool] | None = None, unique: str | None = None) -> tuple[Dataset, Dataset | None]:
    """The rows by `by`, otherwise as before. unique: "key" keeps the first row of each key, "row" of each whole row; the others come second."""
    out = ds.sorted_by(by, descending or [False] * len(by))
    if not unique:
        return out, None
    keys = group_keys(out, by) if unique == "key" else [F.col(f"`{c}`") for c in out.columns]
    w = Window.partitionBy(*keys).orderBy(*(out.sort_columns() or [F.lit(0)]))
    marked = out.df.withColumn("__first", F.row_number().over(w) == 1)
    return out.with_df(marked.where("__first").drop("__first")), out.with_df(marked.where("not __first").drop("__first"))


def append(base: Dataset | None, data: Dataset) -> Dataset:
    return data if base is None else concatenate([base, data])


def _ranked(df: DataFrame, v: str, name: str, descending: bool, groups: int | None) -> DataFrame:
    """Average ranks over all rows: from a running sum over values' counts, sorted by ranges, so that no task gets all rows."""
    counts = df.where(F.col(v).isNotNull()).groupBy(F.col(v).alias("__v")).agg(F.count("*").cast("double").alias("__c"))
    own = running(numbered(Dataset(counts.withColumn("__o0", F.col("__v")), [("__o0", not descending)])), F.col("__c"), "sum", "__upto").df
    value = F.col("__upto") - (F.col("__c") - 1) / 2
    if groups:
        n = counts.agg(F.sum("__c")).head()[0] or 1.0
        value = F.least(F.floor((value - 1) * groups / n), F.lit(groups - 1)).cast("double")
    found = own.select(F.col("__v"), value.alias("__rank"))
    return df.join(found, F.col(v) == F.col("__v"), "left").withColumn(name, F.col("__rank")).drop("__v", "__rank")


def rank(ds: Dataset, var: list[str], ranks: list[str] | None = None, by: list[str] = (), descending: bool = False, groups: int | None = None) -> Dataset:
    """Average ranks of each variable within by; missing values have none. groups: numbers from 0 of as many groups of near equal size."""
    df = ds.df
    keys = group_keys(ds, list(by))
    for v, name in zip(var, ranks or var, strict=False):
        if not keys:
            df = _ranked(df, v, name, descending, groups)
            continue
        there = F.col(v).isNotNull()
        inside = Window.partitionBy(*keys, there)
        ordered = inside.orderBy(F.col(v).desc() if descending else F.col(v).asc())
        ties = F.count("*").over(Window.partitionBy(*keys, there, F.col(v)))
        average = F.rank().over(ordered) + (ties - 1) / 2.0
        value = average
        if groups:
            n = F.count("*").over(inside)
            value = F.least(F.floor((average - 1) * groups / n), F.lit(groups - 1))
        df = df.withColumn(name, F.when(there, value.cast("double")))
    return ds.with_df(df)


def standard(ds: Dataset, var: list[str], mean: float | None = None, std: float | None = None, replace: bool = False, by: list[str] = ()) -> Dataset:
    """Variables rescaled to a mean and standard deviation; with replace, missing values become the mean."""
    w = Window.partitionBy(*group_keys(ds, list(by))) if by else None
    df = ds.df
    if w is None:
        sums = df.agg(*(f(v).alias(f"__{n}_{v}") for v in var for n, f in (("m", F.avg), ("s", F.stddev_samp)))).head()
        stat = lambda n, v: F.lit(sums[f"__{n}_{v}"]).cast("double")
    else:
        stat = lambda n, v: (F.avg if n == "m" else F.stddev_samp)(v).over(w)
    out = {}
    for v in var:
        m, s, x = stat("m", v), stat("s", v), F.col(v)
        if mean is not None or std is not None:
            z = F.try_divide(x - m, s) if std is not None else x - m
            scaled = z * (std if std is not None else 1.0) + (mean if mean is not None else m)
        else:
            scaled = x
        fill = F.lit(mean) if mean is not None else m
        out[v] = F.coalesce(scaled, fill) if replace else scaled
    return ds.with_df(df.withColumns(out))


def sample(ds: Dataset, n: int | None = None, rate: float | None = None, seed: int = 0, strata: list[str] = ()) -> Dataset:
    """Simple random sample without replacement, n rows or a share, from each stratum.

    A row's lot is a hash of its values and order, so the sample is the same every time. Without strata the smallest lots
    are taken by a top-n, not by one task's sort of all rows.
    """
    lot = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in ds.df.columns))
    rows = ds.df.withColumn("__lot", lot)
    tie = [F.col("__lot"), *ds.sort_columns()]
    if not strata:
        k = n if n is not None else int(ds.df.count() * rate + 0.5)
        return ds.with_df(rows.orderBy(*tie).limit(k).drop("__lot"))
    keys = group_keys(ds, list(strata))
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*tie)))
    most = F.lit(n) if n is not None else F.floor(F.count("*").over(Window.partitionBy(*keys)) * rate + 0.5)
    return ds.with_df(ranked.where(F.col("__k") <= most).drop("__lot", "__k"))


def transpose(ds: Dataset, var: list[str] | None = None, by: list[str] = (), id_: str | None = None, prefix: str = "", suffix: str = "", name: str = "_name_") -> Dataset:
    """Variables become rows and rows become columns, within by; columns are named by id or by number."""
    by = list(by)
    var = var or [c for c in ds.columns if ds.kind(c) == "num" and c not in by and c != id_]
    chars = any(ds.kind(v) == "char" for v in var)
    value = lambda v: (text(ds.val(v)) if ds.kind(v) == "char" else number_text(F.col(v))) if chars else F.col(v)
    if id_ is None:
        if by:
            ordinal = F.row_number().over(Window.partitionBy(*group_keys(ds, by)).orderBy(*(ds.sort_columns() or [F.lit(0)])))
            rows = ds.df.withColumn("__c", ordinal.cast("string"))
        else:
            rows = numbered(ds).df.withColumn("__c", F.col("__n").cast("long").cast("string"))
        stem = prefix or "col"
    else:
        ds = ds if all(up for _, up in ds.order) else numbered(ds)
        rows = ds.df.withColumn("__c", F.lower(F.trim(text(ds.val(id_)) if ds.kind(id_) == "char" else number_text(F.col(id_)))))
        stem = prefix
    names = [r[0] for r in rows.select("__c").distinct().collect()]  # they become columns, so they are few
    names.sort(key=lambda c: (0, int(c), c) if id_ is None else (1, 0, c))
    last = F.struct(*(F.col(c) for c, _ in ds.order)) if id_ is not None and ds.order else F.lit(0)
    long = rows.select(*by, "__c", last.alias("__at"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("n"), value(v).alias("v")) for i, v in enumerate(var)))).alias("x"))
    wide = long.groupBy(*by, F.col("x.i").alias("__i"), F.col("x.n").alias(name)).pivot("__c", names).agg(F.max_by(F.col("x.v"), F.col("__at")))  # of repeated ids the last row counts
    out = wide.select(*by, name, "__i", *(F.col(f"`{c}`").alias(f"{stem}{c}{suffix}") for c in names))
    if chars:
        out = out.fillna("")
    order = [*by, "__i"]
    return Dataset(out.withColumns({f"__o{i}": F.col(f"`{c}`") for i, c in enumerate(order)}).drop("__i"), [(f"__o{i}", True) for i in range(len(order))])


#: What TRANSFORM may name; null where the function has no value.
TRANSFORMS = {"log": lambda x: F.when(x > 0, F.log(x)), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "exp": F.exp, "abs": F.abs}


def compare(base: Dataset, other: Dataset, id_: list[str] = (), var: list[str] | None = None, criterion: float = 0.0, by: list[str] = (), transforms: dict[str, str] | None = None) -> Dataset:
    """(by columns, id columns or _obs_, _var_, _base_, _compare_): values that differ by more than criterion, rows of a by group matched by id and occurrence, or by position."""
    by, transforms = list(by), transforms or {}
    unknown = set(transforms.values()) - set(TRANSFORMS)
    if unknown:
        raise ValueError(f"TRANSFORM knows {', '.join(TRANSFORMS)}, not {', '.join(sorted(unknown))}")
    positions = not id_
    id_ = [*by, *id_]
    var = var or [c for c in base.columns if c in other.columns and c not in id_]

    def value(v: str) -> Column:
        return TRANSFORMS[transforms[v]](F.col(v)) if v in transforms else F.col(v)

    def side(ds: Dataset, mark: str) -> DataFrame:
        if id_:
            k = F.row_number().over(Window.partitionBy(*group_keys(ds, id_)).orderBy(*(ds.sort_columns() or [F.lit(0)])))
            rows = ds.df.withColumn("__k", k.cast("double"))
        else:
            rows = numbered(ds).df.withColumn("__k", F.col("__n"))
        return rows.select(*(F.col(c).alias(f"{mark}{c}") for c in id_), F.col("__k").alias(f"{mark}k"), *(value(v).alias(f"{mark}_{v}") for v in var))

    a, b = side(base, "__a"), side(other, "__b")
    match = F.col("__ak") == F.col("__bk")
    for c in id_:
        match = match & F.col(f"__a{c}").eqNullSafe(F.col(f"__b{c}"))
    both = a.join(b, match)
    parts = []
    for i, v in enumerate(var):
        x, y = F.col(f"__a_{v}"), F.col(f"__b_{v}")
        if base.kind(v) == "char":
            differs = ~F.rtrim(F.coalesce(x, F.lit(""))).eqNullSafe(F.rtrim(F.coalesce(y, F.lit(""))))
            shown = (F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))
        else:
            differs = F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > criterion)
            shown = (number_text(x), number_text(y))
        parts.append(F.when(differs, F.struct(F.lit(i).alias("i"), F.lit(v).alias("v"), shown[0].alias("a"), shown[1].alias("b"))))
    rows = both.select(*(F.col(f"__a{c}").alias(c) for c in id_), F.col("__ak").alias("__k"), F.explode(F.array_compact(F.array(*parts))).alias("d"))
    keys = [*id_, "_obs_"] if positions else id_
    out = rows.select(*(F.col(c) for c in id_), *([F.col("__k").alias("_obs_")] if positions else []), F.col("d.v").alias("_var_"), F.col("d.a").alias("_base_"), F.col("d.b").alias("_compare_"), F.col("__k").alias("__o_k"), F.col("d.i").alias("__o_i"))
    return Dataset(out.withColumns({f"__o{i}": F.col(c) for i, c in enumerate(keys)}), [*((f"__o{i}", True) for i in range(len(keys))), ("__o_k", True), ("__o_i", True)])


def contents(ds: Dataset, spark) -> Dataset:
    """A row for each variable; nobs is the number of observations."""
    nobs = float(ds.df.count())
    rows = [(float(i + 1), c, ds.kind(c), ds.formats.get(c, ""), ds.labels.get(c, ""), nobs) for i, c in enumerate(ds.columns)]
    return plain(spark.createDataFrame(rows, "num double, name string, type string, format string, label string, nobs double"), ["num"])


def printed(ds: Dataset, var: list[str] | None = None, formats: dict[str, str] | None = None, users: dict | None = None, by: list[str] = (), obs: int | None = None) -> DataFrame:
    """The columns as text, in order, with their formats."""
    own = ds.formats | (formats or {})
    columns = var or ds.columns
    rows = ds.df.orderBy(*ds.sort_columns()) if ds.order else ds.df
    if obs is not None:
        rows = rows.limit(obs)

    def shown(c: str):
        v = ds.val(c)
        if c in own:
            return apply_format(v, own[c], users)
        return text(v) if v.kind == "char" else number_text(F.col(f"`{c}`"))

    return rows.select(*(shown(c).alias(c) for c in [*by, *(c for c in columns if c not in by)]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


__all__ = ["Val", "append", "compare", "contents", "plain", "printed", "rank", "sample", "sort", "standard", "transpose", "union_all"]
