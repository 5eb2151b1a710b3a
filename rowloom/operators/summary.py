"""Summaries: means, frequencies, moments, tabulation and reports."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import dist
from rowloom.functions.values import number_text
from rowloom.operators.tables import plain
from rowloom.plans.dataset import Dataset, sort_key

PERCENTILES = {"median": 0.5, "p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "q1": 0.25, "p50": 0.5, "p75": 0.75, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def statistic(name: str, v: str | Column, alpha: float = 0.05) -> Column:
    x = F.col(v) if isinstance(v, str) else v
    simple = {"n": lambda: F.count(x).cast("double"), "nmiss": lambda: F.count(F.when(x.isNull(), 1)).cast("double"), "mean": lambda: F.avg(x), "std": lambda: F.stddev_samp(x), "stddev": lambda: F.stddev_samp(x), "var": lambda: F.var_samp(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "sum": lambda: F.sum(x), "range": lambda: F.max(x) - F.min(x), "stderr": lambda: F.stddev_samp(x) / F.sqrt(F.count(x)), "cv": lambda: 100 * F.stddev_samp(x) / F.avg(x), "uss": lambda: F.sum(x * x), "css": lambda: F.var_samp(x) * (F.count(x) - 1)}
    if name in simple:
        return simple[name]()
    if name in PERCENTILES or name == "qrange":
        # one aggregate for all of them, as the same expression is worked out once
        all_ = F.percentile(x, sorted(set(PERCENTILES.values())))
        at = {p: all_[i] for i, p in enumerate(sorted(set(PERCENTILES.values())))}
        return at[0.75] - at[0.25] if name == "qrange" else at[PERCENTILES[name]]
    if name == "skew":
        n = F.count(x)
        return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2))
    if name == "kurt":
        n = F.count(x)
        return F.when(n > 3, (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1.0) * F.kurtosis(x) + 6))
    if name == "mode":
        return F.mode(x, True)
    raise ValueError(f"no statistic {name}")


def t_quantile(n: Column, p: float) -> Column:
    """Student's t quantile for n - 1 degrees of freedom, as a column: exact for up to 30, then a series in 1/df whose error is below 1e-6."""
    df = (n - 1).cast("double")
    z = dist.norm_ppf(p)
    series = F.lit(z) + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3) + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * df**4)
    exact = F.array(*(F.lit(dist.t_ppf(p, k)) for k in range(1, 31)))
    return F.when(df < 1, None).when(df <= 30, F.try_element_at(exact, df.cast("int"))).otherwise(series)


def means(ds: Dataset, var: list[str] | None = None, class_: list[str] = (), by: list[str] = (), stats: list[str] = ("n", "mean", "std", "min", "max"), types: list[list[str]] | None = None, ways: list[int] | None = None, alpha: float = 0.05, names: dict[tuple[str, str], str] | None = None) -> Dataset:
    """<var>_<stat> for each group of class within by; a missing class value is a level. types or ways list the groupings, otherwise all class variables together.

    Groupings are grouping sets of one aggregation, partial sums first.
    """
    class_, by = list(class_), list(by)
    var = var or [c for c in ds.columns if ds.kind(c) == "num" and c not in class_ + by]
    if ways is not None:
        types = [list(c) for w in ways for c in combinations(class_, w)]
    keys = [F.col(f"`{c}`") for c in by + class_]
    aggs = []
    for v in var:
        for s in stats:
            name = (names or {}).get((s, v), f"{v}_{s}")
            if s in ("lclm", "uclm"):
                half = t_quantile(F.count(v), 1 - alpha / 2) * F.stddev_samp(v) / F.sqrt(F.count(v))
                aggs.append((F.avg(v) + (half if s == "uclm" else -half)).alias(name))
            else:
                aggs.append(statistic(s, v).alias(name))
    if types is None:
        out = ds.df.groupBy(*keys).agg(*aggs) if keys else ds.df.agg(*aggs)
    else:
        sets = [[F.col(c) for c in by + t] for t in types]
        out = ds.df.groupingSets(sets, *by, *class_).agg(*aggs)
    return plain(out, by + class_)


def frequency(ds: Dataset, tables: list[str], by: list[str] = ()) -> Dataset:
    """Counts and percents. One variable: its levels, missing too, the most frequent first. More: all combinations of levels, with zero cells, of rows that miss none; percents are of all rows."""
    total = F.sum("count").over(Window.partitionBy(*by)) if by else None
    if len(tables) == 1:
        v = tables[0]
        counts = ds.df.groupBy(*by, v).agg(F.count("*").cast("double").alias("count"))
        n = total if by else F.lit(float(ds.df.count()))
        out = counts.withColumn("percent", 100 * F.col("count") / n)
        ordered = out.withColumns({"__o0": -F.col("count"), "__o1": F.col(v)})
        return Dataset(ordered, [("__o0", True), ("__o1", True)])
    n = ds.df.count()
    there = F.lit(True)
    for v in tables:
        there = there & (F.trim(F.col(v)) != "" if ds.kind(v) == "char" else F.col(v).isNotNull())
    rows = ds.df.where(there)
    counts = rows.groupBy(*tables).agg(F.count("*").alias("n"))
    # the grid of levels is the result itself; each variable's levels come from the aggregated counts
    grid = None
    for v in tables:
        levels = counts.select(F.col(v).alias(v)).distinct()
        grid = levels if grid is None else grid.join(levels, F.lit(True))
    out = grid.join(counts, tables, "left").select(*tables, F.coalesce("n", F.lit(0)).cast("double").alias("count"))
    return plain(out.withColumn("percent", 100 * F.col("count") / float(max(n, 1))), tables)


def crosstab(ds: Dataset, a: str, b: str) -> tuple[list, list, np.ndarray]:
    """Levels and counts of two variables: as many numbers as there are cells."""
    rows = [(r[a], r[b], r["count"]) for r in frequency(ds, [a, b]).visible().collect()]
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    table = np.zeros((len(left), len(right)))
    for x, y, n in rows:
        table[left.index(x), right.index(y)] = n
    return left, right, table


def chisq(table: np.ndarray, left: list | None = None, right: list | None = None) -> dict[str, float]:
    n = table.sum()
    e = np.outer(table.sum(axis=1), table.sum(axis=0)) / n
    df = (table.shape[0] - 1) * (table.shape[1] - 1)
    pearson = float(((table - e) ** 2 / np.where(e > 0, e, 1)).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = float(2 * np.where(table > 0, table * np.log(table / e), 0).sum())
    out = {"df": float(df), "chisq": pearson, "p_chisq": dist.chi2_upper(pearson, df), "lr": ratio, "p_lr": dist.chi2_upper(ratio, df), "phi": math.sqrt(pearson / n), "cramer_v": math.sqrt(pearson / n / max(1, min(table.shape) - 1))}
    if left and all(isinstance(x, float) for x in [*left, *right]):
        x, y, w = np.repeat(left, table.shape[1]), np.tile(right, table.shape[0]), table.ravel()
        mx, my = (w * x).sum() / n, (w * y).sum() / n
        r = (w * (x - mx) * (y - my)).sum() / math.sqrt((w * (x - mx) ** 2).sum() * (w * (y - my) ** 2).sum())
        out |= {"mh": (n - 1) * r * r, "p_mh": dist.chi2_upper((n - 1) * r * r, 1)}
    return out


def chisq_equal(counts: list[float]) -> dict[str, float]:
    n, k = sum(counts), len(counts)
    x = sum((c - n / k) ** 2 / (n / k) for c in counts)
    return {"df": float(k - 1), "chisq": x, "p_chisq": dist.chi2_upper(x, k - 1)}


def two_by_two(table: np.ndarray) -> dict[str, float]:
    """Odds ratio, relative risk (column 1) and risk difference with 95 % limits."""
    (a, b), (c, d) = table
    z = dist.norm_ppf(0.975)
    p1, p2 = a / (a + b), c / (c + d)
    odds, so = a * d / (b * c), math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    risk, sr = p1 / p2, math.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    sd = math.sqrt(p1 * (1 - p1) / (a + b) + p2 * (1 - p2) / (c + d))
    return {"odds_ratio": odds, "or_lower": odds * math.exp(-z * so), "or_upper": odds * math.exp(z * so), "relative_risk": risk, "rr_lower": risk * math.exp(-z * sr), "rr_upper": risk * math.exp(z * sr), "risk_difference": p1 - p2, "rd_lower": p1 - p2 - z * sd, "rd_upper": p1 - p2 + z * sd}


def agreement(table: np.ndarray) -> dict[str, float]:
    n = table.sum()
    observed, expected = np.trace(table) / n, float((table.sum(axis=0) * table.sum(axis=1)).sum() / n / n)
    return {"agreement": float(observed), "kappa": float((observed - expected) / (1 - expected)) if expected < 1 else 1.0}


MOMENTS = ("n", "mean", "std", "var", "skew", "kurt", "min", "max", "median", "mode", "sum")
QUANTILES = (1.0, 0.99, 0.95, 0.9, 0.75, 0.5, 0.25, 0.1, 0.05, 0.01, 0.0)


def univariate(ds: Dataset, var: list[str] | None = None) -> dict[str, Dataset]:
    """moments, quantiles and extremes of each variable."""
    var = var or [c for c in ds.columns if ds.kind(c) == "num"]
    one = ds.df.agg(*(F.struct(*(statistic(s, v).alias(s) for s in MOMENTS), F.percentile(v, [float(q) for q in QUANTILES]).alias("q")).alias(v) for v in var))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(v).alias("_varname_"), F.col(v).alias("s")) for v in var))).alias("x")).select("x._varname_", "x.s.*")
    moments = rows.select("_varname_", *(F.col(s).alias(f"_{ {'var': 'variance'}.get(s, s)}_") for s in MOMENTS))
    quantiles = rows.select("_varname_", F.explode(F.arrays_zip(F.array(*map(F.lit, QUANTILES)).alias("p"), F.col("q").alias("v"))).alias("z")).select("_varname_", F.col("z.p").alias("quantile"), F.col("z.v").alias("value"))
    ends = []
    for v in var:
        low = ds.df.where(F.col(v).isNotNull()).select(F.lit(v).alias("_varname_"), F.lit("lowest").alias("end"), F.col(v).alias("value")).orderBy("value").limit(5)
        high = ds.df.where(F.col(v).isNotNull()).select(F.lit(v).alias("_varname_"), F.lit("highest").alias("end"), F.col(v).alias("value")).orderBy(F.desc("value")).limit(5)
        ends += [low, high]
    extremes = ends[0]
    for e in ends[1:]:
        extremes = extremes.unionAll(e)
    return {"moments": plain(moments, ["_varname_"]), "quantiles": plain(quantiles.withColumn("__d", -F.col("quantile")), ["_varname_", "__d"]), "extremes": plain(extremes, ["_varname_", "end", "value"])}


def normality(ds: Dataset, v: str) -> dict[str, float]:
    """Kolmogorov's D against the normal distribution of the sample's mean and deviation."""
    there = ds.df.where(F.col(v).isNotNull())
    head = there.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).head()
    n, m, s = head["n"], head["m"], head["s"]
    counts = there.groupBy(v).agg(F.count("*").cast("double").alias("c"))
    from rowloom.plans.dataset import numbered, running

    ds_ = Dataset(counts.withColumn("__o0", F.col(v)), [("__o0", True)])
    rows = running(numbered(ds_), F.col("c"), "sum", "upto").df
    # Abramowitz and Stegun 7.1.26 keeps the normal distribution a column expression; its error is below 2e-7
    z = (F.col(v) - m) / s / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * F.abs(z))
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    cdf = 0.5 * (1 + F.signum(z) * erf)
    d = rows.agg(F.max(F.greatest(F.col("upto") / n - cdf, cdf - (F.col("upto") - F.col("c")) / n))).head()[0]
    return {"n": float(n), "d": float(d)}


def tabulate(ds: Dataset, rows: list[str], cols: list[str], var: str, stats: list[str]) -> Dataset:
    """A row for each combination of levels of rows and statistic (_stat_), a column for each one of cols, named by its levels joined by _. pctsum is of the grand total."""
    there = ds.df
    text = lambda c: F.trim(F.col(c)) if ds.kind(c) == "char" else number_text(F.col(c))
    for c in [*rows, *cols]:
        there = there.where(F.trim(F.col(c)) != "" if ds.kind(c) == "char" else F.col(c).isNotNull())
    total = there.agg(F.sum(var)).head()[0] if "pctsum" in stats else None
    stat = lambda s: 100 * F.sum(var) / total if s == "pctsum" else statistic(s, var)
    if not cols:
        out = there.groupBy(*rows).agg(*(stat(s).alias(f"{var}_{s}") for s in stats))
        return plain(out, rows)
    there = there.withColumn("__col", F.concat_ws("_", *map(text, cols)))
    levels = list(dict.fromkeys(r[-1] for r in there.select(*cols, "__col").distinct().orderBy(*cols).collect()))  # they become columns
    wide = there.groupBy(*rows).pivot("__col", levels).agg(*(stat(s).alias(s) for s in stats))
    parts = []
    for i, s in enumerate(stats):
        cells = [F.col(f"`{lv}_{s}`" if len(stats) > 1 else f"`{lv}`").alias(lv.lower()) for lv in levels]
        parts.append(wide.select(*rows, F.lit(s).alias("_stat_"), *cells, F.lit(float(i)).alias("__i")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    order = {f"__o{k + 1}": F.col(c) for k, c in enumerate(rows)}
    return Dataset(out.withColumns(order).withColumnRenamed("__i", "__o0"), [("__o0", True), *((c, True) for c in order)])


def report(ds: Dataset, columns: list[str], group: list[str] = (), analysis: dict[str, str] | None = None, breaks: list[str] = (), grand: bool = False) -> Dataset:
    """Groups with analysed variables, and a _break_ column that names the subtotals after each level of breaks and the grand total."""
    group, analysis = list(group), analysis or {}
    if not group and not analysis:
        return ds.with_df(ds.df.select(*columns, *(c for c, _ in ds.order)))
    aggs = [statistic(s, v).alias(v) for v, s in analysis.items()]
    levels: list[tuple[str, list[str]]] = [("", group)]
    levels += [(b, group[: group.index(b) + 1]) for b in breaks if group.index(b) + 1 < len(group) or b in group]
    if grand:
        levels.append(("_rbreak_", []))
    parts = []
    for k, (mark, keys) in enumerate(levels):
        rows = ds.df.groupBy(*keys).agg(*aggs) if keys else ds.df.agg(*aggs)
        blank = [(F.col(g) if g in keys else F.lit("" if ds.kind(g) == "char" else None).cast("string" if ds.kind(g) == "char" else "double")).alias(g) for g in group]
        place = []
        for i, g in enumerate(group):
            # a subtotal comes after the rows that it sums up
            last = F.lit(1.0 if g not in keys else 0.0)
            place += [last.alias(f"__o{2 * i}"), (F.col(g) if g in keys else F.lit(None).cast(ds.df.schema[g].dataType)).alias(f"__o{2 * i + 1}")]
        parts.append(rows.select(*blank, *analysis, F.lit(mark).alias("_break_"), *place, F.lit(float(k)).alias(f"__o{2 * len(group)}")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    shown = [c for c in columns if c in out.columns]
    hidden = [c for c in out.columns if c.startswith("__o")]
    return Dataset(out.select(*shown, "_break_", *hidden), [(f"__o{i}", True) for i in range(2 * len(group) + 1)])


__all__ = ["DataFrame", "agreement", "chisq", "chisq_equal", "crosstab", "frequency", "means", "normality", "report", "sort_key", "tabulate", "two_by_two", "univariate"]
