"""Statistical procedures. Data are summed up by Spark; what is solved on the driver has the size of the model."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import dist
from rowloom.operators.tables import plain
from rowloom.plans.dataset import Dataset, numbered, running, stored

MAX_DRIVER_ROWS = 1_000_000


def complete(ds: Dataset, names: list[str]) -> DataFrame:
    """Rows without missing values in names."""
    test = F.lit(True)
    for n in dict.fromkeys(names):
        test = test & (F.trim(F.coalesce(F.col(n), F.lit(""))) != "" if ds.kind(n) == "char" else F.col(n).isNotNull())
    return ds.df.where(test)


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of weights, weighted sums, weighted cross products), from one aggregation."""
    w = F.lit(1.0) if weight is None else weight
    k = len(columns)
    aggs = [F.sum(w)] + [F.sum(w * c) for c in columns] + [F.sum(w * columns[i] * columns[j]) for i in range(k) for j in range(i, k)]
    row = df.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).head()
    values = [0.0 if v is None else float(v) for v in row]
    cross = np.zeros((k, k))
    cross[np.triu_indices(k)] = values[1 + k :]
    return values[0], np.array(values[1 : 1 + k]), cross + np.triu(cross, 1).T


def covariance(df: DataFrame, names: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, sample covariances). Columns are centred about a first mean so that nothing cancels."""
    base = df.agg(*(F.avg(n).alias(f"m{i}") for i, n in enumerate(names))).head()
    centre = [float(x or 0) for x in base]
    n, s, c = gram(df, [F.col(x) - m for x, m in zip(names, centre, strict=True)])
    return n, np.array(centre) + s / n, (c - np.outer(s, s) / n) / (n - 1)


def design(ds: Dataset, xs: list[str], class_: list[str] = ()) -> list[tuple[str, Column]]:
    """(name, column) of each effect; class variables have an indicator for each level but the first. a*b is a product."""
    out: list[tuple[str, Column]] = []

    def parts(x: str) -> list[tuple[str, Column]]:
        if x not in class_:
            return [(x, F.col(x))]
        levels = [r[0] for r in complete(ds, [x]).select(x).distinct().orderBy(x).collect()]  # as many as the model has parameters
        text = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
        return [(f"{x}_{text(v)}", F.when(F.col(x) == v, 1.0).otherwise(0.0)) for v in levels[1:]]

    for x in xs:
        effect = [("", F.lit(1.0))]
        for f in x.split("*"):
            effect = [(f"{a}*{b}" if a else b, ca * cb) for a, ca in effect for b, cb in parts(f)]
        out += effect
    return out


def table(spark, columns: list[str], rows: list[tuple]) -> Dataset:
    kinds = ["string" if any(isinstance(r[i], str) for r in rows) else "double" for i in range(len(columns))]
    rows = [tuple(None if isinstance(v, float) and not math.isfinite(v) else float(v) if k == "double" and v is not None else v for v, k in zip(r, kinds, strict=True)) for r in rows]
    df = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(rows)], ", ".join([f"`{c}` {k}" for c, k in zip(columns, kinds, strict=True)] + ["__o0 double"]))
    return Dataset(df, [("__o0", True)])


def linear(columns: list[Column], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, b in zip(columns, beta, strict=True):
        out = out + c * F.lit(float(b))
    return out


# correlation and linear models


def corr(ds: Dataset, var: list[str], with_: list[str] | None = None) -> Dataset:
    """(_name_, with, n, r, p) for pairs, each over the rows that have both; one aggregation for all."""
    pairs = [(a, b) for a in with_ for b in var] if with_ else [(a, b) for a in var for b in var]
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    row = ds.df.agg(*(x for i, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"r{i}"), F.count(both(a, b)).alias(f"n{i}")))).head()
    rows = []
    for i, (a, b) in enumerate(pairs):
        r, n = row[f"r{i}"], row[f"n{i}"]
        p = None
        if r is not None and n > 2:
            p = 0.0 if abs(r) >= 1 else dist.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        rows.append((a, b, float(n), r, p if a != b else None))
    return table(ds.df.sparkSession, ["_name_", "with", "n", "r", "p"], rows)


class Fit:
    """A fitted linear predictor: names, columns, estimates, errors and what else there is to say."""

    def __init__(self, names: list[str], columns: list[Column], beta: np.ndarray, cov: np.ndarray, df: float | None, **more):
        self.names, self.columns, self.beta, self.cov, self.df, self.more = names, columns, beta, cov, df, more

    def rows(self) -> list[tuple]:
        out = []
        for n, b, v in zip(self.names, self.beta, np.diag(self.cov), strict=True):
            se = math.sqrt(max(v, 0))
            t = b / se if se else math.inf
            out.append((n, float(b), se, t, dist.t_two_sided(t, self.df) if self.df else dist.norm_two_sided(t)))
        return out

    def estimates(self, spark) -> Dataset:
        return table(spark, ["parameter", "estimate", "stderr", "t", "p"], self.rows())

    def predictor(self) -> Column:
        return linear(self.columns, self.beta)


def regress(ds: Dataset, y: str, xs: list[str], class_: list[str] = (), intercept: bool = True, selection: str | None = None, slstay: float = 0.1, slentry: float = 0.15) -> Fit:
    """Least squares from one matrix of cross products, around the means if there is an intercept; selection solves parts of it without another pass."""
    terms = design(ds, xs, class_)
    df = complete(ds, [y, *(v for x in xs for v in x.split("*"))])
    names = (["intercept"] if intercept else []) + [n for n, _ in terms]
    columns = ([F.lit(1.0)] if intercept else []) + [c for _, c in terms]
    measured = [c for _, c in terms] + [F.col(y)]
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(measured))).head() if intercept else None
    means = np.array([0.0 if row is None or row[f"m{i}"] is None else row[f"m{i}"] for i in range(len(measured))])
    n, sums, cross = gram(df, ([F.lit(1.0)] if intercept else []) + [c - F.lit(float(m)) for c, m in zip(measured, means, strict=True)])
    shift = np.concatenate([[0.0], means[:-1]]) if intercept else means[:-1]
    xtx, xty, yty, ysum = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1], sums[-1]

    def solve(idx: list[int]) -> Fit:
        a = xtx[np.ix_(idx, idx)]
        inv = np.linalg.pinv(a)
        beta = inv @ xty[idx]
        rank = np.linalg.matrix_rank(a)
        sse = float(max(yty - beta @ xty[idx], 0))
        sst = float(yty - (ysum**2 / n if intercept else 0))
        dfe = n - rank
        mse = sse / dfe if dfe > 0 else math.nan
        dfm = rank - (1 if intercept else 0)
        f = (sst - sse) / dfm / mse if dfm and mse else math.nan
        back = np.eye(len(idx))  # from around the means to around zero
        if intercept:
            back[0] -= shift[idx]
            beta = back @ beta
            beta[0] += means[-1]
        return Fit([names[i] for i in idx], [columns[i] for i in idx], beta, back @ inv @ back.T * mse, dfe, n=n, sse=sse, sst=sst, mse=mse, r2=1 - sse / sst if sst else math.nan, f=f, p_f=dist.f_upper(f, dfm, dfe) if dfm and f == f else math.nan, xtx=a)

    fixed = [0] if intercept else []
    rest = [i for i in range(len(names)) if i not in fixed]
    if selection == "backward":
        while rest:
            fit = solve(fixed + rest)
            worst = max(range(len(rest)), key=lambda k: fit.rows()[len(fixed) + k][4])
            if fit.rows()[len(fixed) + worst][4] <= slstay:
                break
            rest.pop(worst)
        return solve(fixed + rest)
    if selection == "forward":
        chosen: list[int] = []
        while len(chosen) < len(rest):
            tries = [(solve([*fixed, *chosen, i]).rows()[-1][4], i) for i in rest if i not in chosen]
            p, i = min(tries)
            if p > slentry:
                break
            chosen.append(i)
        return solve(fixed + chosen)
    return solve(fixed + rest)


def vif(fit: Fit) -> dict[str, float]:
    k = 1 if fit.names[0] == "intercept" else 0
    a, n = fit.more["xtx"], fit.more["n"]
    cov = a[k:, k:] - (np.outer(a[0, k:], a[0, k:]) / n if k else 0)
    d = np.sqrt(np.diag(cov))
    return dict(zip(fit.names[k:], np.diag(np.linalg.pinv(cov / np.outer(d, d))).tolist(), strict=True))


def scored(ds: Dataset, fit: Fit, y: str | None = None, p: str | None = None, r: str | None = None, link: Callable[[Column], Column] = lambda c: c) -> Dataset:
    yhat = link(fit.predictor())
    out = {}
    if p:
        out[p] = yhat
    if r:
        out[r] = F.col(y) - yhat
    return ds.with_df(ds.df.withColumns(out))


LINKS = {
    "identity": (lambda e: e, lambda e, m: F.lit(1.0)),
    "log": (lambda e: F.exp(e), lambda e, m: m),
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e, m: m * (1 - m)),
    "inverse": (lambda e: 1 / e, lambda e, m: -m * m),
    "cloglog": (lambda e: 1 - F.exp(-F.exp(e)), lambda e, m: (1 - m) * F.exp(e)),
}
VARIANCES = {"normal": lambda m: F.lit(1.0), "binomial": lambda m: m * (1 - m), "poisson": lambda m: m, "gamma": lambda m: m * m, "negbin": lambda m: m + m * m}
CANONICAL = {"normal": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse", "negbin": "log"}


def glm(ds: Dataset, y: str, xs: list[str], class_: list[str] = (), family: str = "binomial", link: str | None = None, rounds: int = 50, tolerance: float = 1e-9) -> Fit:
    """Iteratively reweighted least squares; each round is one weighted aggregation over the rows."""
    link = link or CANONICAL[family]
    inverse, slope = LINKS[link]
    terms = design(ds, xs, class_)
    columns, names = [F.lit(1.0), *(c for _, c in terms)], ["intercept", *(n for n, _ in terms)]
    df = complete(ds, [y, *(v for x in xs for v in x.split("*"))])
    mean = float(df.agg(F.avg(y)).head()[0])
    start = {"identity": mean, "log": math.log(max(mean, 1e-6)), "inverse": 1 / (mean or 1e-6), "logit": math.log(max(mean, 1e-6) / max(1 - mean, 1e-6)), "cloglog": math.log(-math.log(max(1 - mean, 1e-6)) or 1e-6)}[link]
    beta = np.zeros(len(columns))
    beta[0] = start
    for _ in range(rounds):
        eta = linear(columns, beta)
        mu = inverse(eta)
        d = slope(eta, mu)
        w = d * d / VARIANCES[family](mu)
        z = eta + (F.col(y) - mu) / d
        n, _, cross = gram(df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)), w.alias("w"), z.alias("z")).where("w > 0 and not isnan(w) and not isnan(z)"), [*(F.col(f"c{i}") for i in range(len(columns))), F.col("z")], F.col("w"))
        new = np.linalg.pinv(cross[:-1, :-1]) @ cross[:-1, -1]
        step = np.abs(new - beta).max()
        beta = new
        if step < tolerance * (1 + np.abs(beta).max()):
            break
    mu = inverse(linear(columns, beta))
    y_ = F.col(y)
    ll = {"binomial": F.sum(y_ * F.log(mu) + (1 - y_) * F.log(1 - mu)), "poisson": F.sum(y_ * F.log(mu) - mu - F.lgamma(y_ + 1) if hasattr(F, "lgamma") else y_ * F.log(mu) - mu)}.get(family, F.sum(-(y_ - mu) * (y_ - mu)))
    row = df.agg(F.count("*").alias("n"), ll.alias("ll"), F.sum((y_ - mu) * (y_ - mu) / VARIANCES[family](mu)).alias("x2")).head()
    scale = 1.0 if family in ("binomial", "poisson", "negbin") else row["x2"] / (row["n"] - len(beta))
    return Fit(names, columns, beta, np.linalg.pinv(cross[:-1, :-1]) * scale, None if scale == 1.0 else row["n"] - len(beta), n=float(row["n"]), loglik=row["ll"], pearson=row["x2"], link=inverse)


def concordance(ds: Dataset, fit: Fit, y: str) -> dict[str, float]:
    """c and Somers' D of a logistic fit, from average ranks of the predicted values."""
    rows = ds.df.where(F.col(y).isNotNull()).select(F.round(fit.more["link"](fit.predictor()), 12).alias("p"), F.col(y).alias("y")).where("p is not null")
    counts = rows.groupBy("p").agg(F.sum(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).alias("a"), F.count("*").cast("double").alias("n"))
    ranked = running(numbered(Dataset(counts.withColumn("__o0", F.col("p")), [("__o0", True)])), F.col("n"), "sum", "upto").df
    row = ranked.agg(F.sum(F.col("a") * (F.col("upto") - (F.col("n") - 1) / 2)).alias("r"), F.sum("a").alias("a"), F.sum("n").alias("n")).head()
    a, b = row["a"], row["n"] - row["a"]
    c = (row["r"] - a * (a + 1) / 2) / (a * b)
    return {"c": c, "somers_d": 2 * c - 1}


def robust(ds: Dataset, y: str, xs: list[str], class_: list[str] = (), k: float = 1.345, rounds: int = 50) -> Fit:
    """Huber M estimation; the scale is the residuals' median absolute deviation."""
    fit = regress(ds, y, xs, class_)
    df = complete(ds, [y, *xs])
    for _ in range(rounds):
        r = F.col(y) - fit.predictor()
        mad = df.select(F.abs(r).alias("r")).agg(F.percentile("r", 0.5)).head()[0] / 0.6744897501960817
        w = F.when(F.abs(r) <= k * mad, 1.0).otherwise(k * mad / F.abs(r)) if mad else F.lit(1.0)
        n, _, cross = gram(df, [*fit.columns, F.col(y)], w)
        beta = np.linalg.pinv(cross[:-1, :-1]) @ cross[:-1, -1]
        step = np.abs(beta - fit.beta).max()
        fit = Fit(fit.names, fit.columns, beta, np.linalg.pinv(cross[:-1, :-1]) * mad * mad, None, n=n, scale=mad)
        if step < 1e-8 * (1 + np.abs(beta).max()):
            break
    return fit


def quantile_regress(ds: Dataset, y: str, xs: list[str], class_: list[str] = (), q: float = 0.5, rounds: int = 200) -> Fit:
    """Quantile regression by reweighting with the inverse absolute residuals."""
    fit = regress(ds, y, xs, class_)
    df = complete(ds, [y, *xs])
    for _ in range(rounds):
        r = F.col(y) - fit.predictor()
        w = F.when(r >= 0, q).otherwise(1 - q) / F.greatest(F.abs(r), F.lit(1e-6))
        n, _, cross = gram(df, [*fit.columns, F.col(y)], w)
        beta = np.linalg.pinv(cross[:-1, :-1]) @ cross[:-1, -1]
        step = np.abs(beta - fit.beta).max()
        fit = Fit(fit.names, fit.columns, beta, np.linalg.pinv(cross[:-1, :-1]), None, n=n)
        if step < 1e-7 * (1 + np.abs(beta).max()):
            break
    return fit


def nonlinear(df: DataFrame, y: Column, f: Callable[[dict[str, float]], Column], start: dict[str, float], rounds: int = 100) -> Fit:
    """Levenberg-Marquardt; each round is one aggregation of the derivatives' cross products."""
    names, theta, damp = list(start), dict(start), 1e-3

    def sums(t: dict[str, float]) -> tuple[float, np.ndarray, np.ndarray]:
        slopes = []
        for p in names:
            h = 1e-6 * max(1.0, abs(t[p]))
            slopes.append((f(t | {p: t[p] + h}) - f(t | {p: t[p] - h})) / (2 * h))
        n, _, c = gram(df, [*slopes, y - f(t)])
        return float(c[-1, -1]), c, n

    sse, c, n = sums(theta)
    for _ in range(rounds):
        a, g = c[:-1, :-1], c[:-1, -1]
        step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g)
        new = {p: theta[p] + s for p, s in zip(names, step, strict=True)}
        got, c2, _ = sums(new)
        if math.isfinite(got) and got <= sse:
            small = abs(sse - got) <= 1e-12 * (1 + sse)
            theta, sse, c, damp = new, got, c2, damp / 10
            if small:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    dfe = n - len(names)
    mse = sse / dfe if dfe > 0 else math.nan
    return Fit(names, [], np.array([theta[p] for p in names]), np.linalg.pinv(c[:-1, :-1]) * mse, dfe, n=n, sse=sse)


def mixed(ds: Dataset, y: str, xs: list[str], subject: str, class_: list[str] = ()) -> Fit:
    """A random intercept for each subject, by restricted maximum likelihood over the ratio of variances.

    Subjects of one size enter through the sum of their totals' cross products, so the driver has one matrix for each size.
    """
    terms = design(ds, xs, class_)
    columns, names = [F.lit(1.0), *(c for _, c in terms)], ["intercept", *(n for n, _ in terms)]
    df = complete(ds, [y, subject, *xs]).select(*(c.alias(f"c{i}") for i, c in enumerate(columns)), F.col(y).alias(f"c{len(columns)}"), F.col(subject).alias("s"))
    k = len(columns) + 1
    n, _, whole = gram(df, [F.col(f"c{i}") for i in range(k)])
    per = df.groupBy("s").agg(F.count("*").alias("m"), *(F.sum(f"c{i}").alias(f"t{i}") for i in range(k)))
    sizes = per.groupBy("m").agg(F.count("*").alias("g"), *(F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k))).collect()
    groups = []
    for r in sizes:
        c = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                c[i, j] = c[j, i] = r[f"p{i}_{j}"]
        groups.append((r["m"], r["g"], c))
    p = k - 1

    def at(theta: float):
        c = whole - sum(theta / (1 + m * theta) * t for m, _, t in groups)
        inv = np.linalg.pinv(c[:p, :p])
        beta = inv @ c[:p, p]
        rss = float(c[p, p] - beta @ c[:p, p])
        s2 = rss / (n - p)
        score = (n - p) * math.log(max(s2, 1e-300)) + sum(g * math.log(1 + m * theta) for m, g, _ in groups) + np.linalg.slogdet(c[:p, :p])[1]
        return score, beta, inv, s2

    low, high = -12.0, 8.0
    for _ in range(100):  # golden section over log theta
        a, b = high - 0.6180339887 * (high - low), low + 0.6180339887 * (high - low)
        low, high = (low, b) if at(math.exp(a))[0] < at(math.exp(b))[0] else (a, high)
    theta = math.exp((low + high) / 2)
    score, beta, inv, s2 = min((at(theta), at(0.0)), key=lambda x: x[0])
    theta = theta if score == at(theta)[0] else 0.0
    return Fit(names, columns, beta, inv * s2, None, n=n, residual=s2, intercept=theta * s2, neg2reml=float(score))


# tests


def ttest(ds: Dataset, var: str, class_: str | None = None, paired: str | None = None, h0: float = 0.0) -> Dataset:
    spark = ds.df.sparkSession
    if class_:
        rows = complete(ds, [var, class_]).groupBy(class_).agg(F.count(var).alias("n"), F.avg(var).alias("m"), F.var_samp(var).alias("v")).orderBy(class_).limit(3).collect()
        if len(rows) != 2:
            raise ValueError("two classes are needed")
        (n1, m1, v1), (n2, m2, v2) = ((r["n"], r["m"], r["v"]) for r in rows)
        df = n1 + n2 - 2
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / df
        t1 = (m1 - m2 - h0) / math.sqrt(pooled * (1 / n1 + 1 / n2))
        a, b = v1 / n1, v2 / n2
        df2 = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
        t2 = (m1 - m2 - h0) / math.sqrt(a + b)
        return table(spark, ["method", "difference", "df", "t", "p"], [("pooled", m1 - m2, df, t1, dist.t_two_sided(t1, df)), ("satterthwaite", m1 - m2, df2, t2, dist.t_two_sided(t2, df2))])
    x = F.col(var) - F.col(paired) if paired else F.col(var)
    r = ds.df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).head()
    t = (r["m"] - h0) / (r["s"] / math.sqrt(r["n"]))
    half = dist.t_ppf(0.975, r["n"] - 1) * r["s"] / math.sqrt(r["n"])
    return table(spark, ["n", "mean", "std", "lclm", "uclm", "df", "t", "p"], [(float(r["n"]), r["m"], r["s"], r["m"] - half, r["m"] + half, float(r["n"] - 1), t, dist.t_two_sided(t, r["n"] - 1))])


def anova(ds: Dataset, y: str, effects: list[str]) -> Dataset:
    """Sums of squares, type II for several effects (a, b, a*b), from the cells' counts, sums and squares."""
    factors = list(dict.fromkeys(f for e in effects for f in e.split("*")))
    mean = complete(ds, [y, *factors]).agg(F.avg(y)).head()[0]
    z = F.col(y) - mean
    cells = complete(ds, [y, *factors]).groupBy(*factors).agg(F.count("*").cast("double").alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q")).collect()
    n = np.array([c["n"] for c in cells])
    s, q = np.array([c["s"] for c in cells]), sum(c["q"] for c in cells)
    levels = {f: sorted({c[f] for c in cells}) for f in factors}

    def dummies(e: str) -> np.ndarray:
        block = np.ones((len(cells), 1))
        for f in e.split("*"):
            own = np.array([[float(c[f] == v) for v in levels[f][1:]] for c in cells]).reshape(len(cells), -1)
            block = np.einsum("ij,ik->ijk", block, own).reshape(len(cells), -1)
        return block

    def rss(es: list[str]) -> tuple[float, int]:
        x = np.hstack([np.ones((len(cells), 1)), *(dummies(e) for e in es)])
        a = x.T @ (x * n[:, None])
        b = x.T @ s
        return q - b @ np.linalg.pinv(a) @ b, np.linalg.matrix_rank(a)

    full, rank = rss(effects)
    dfe = n.sum() - rank
    rows = []
    for e in effects:
        own = set(e.split("*"))
        others = [o for o in effects if o != e and not own < set(o.split("*"))]
        without, r0 = rss(others)
        with_, r1 = rss([*others, e])
        ss, df = without - with_, r1 - r0
        f = ss / df / (full / dfe)
        rows.append((e, float(df), ss, ss / df, f, dist.f_upper(f, df, dfe)))
    rows.append(("error", float(dfe), float(full), float(full / dfe), None, None))
    rows.append(("total", float(n.sum() - 1), float(q), None, None, None))
    return table(ds.df.sparkSession, ["source", "df", "ss", "ms", "f", "p"], rows)


def npar1way(ds: Dataset, var: str, class_: str) -> dict[str, object]:
    """Wilcoxon rank sums by class, the two-sample normal approximation and Kruskal-Wallis, with ties corrected.

    Values are counted before they are ranked, so what is put in order has one row for each distinct value and class.
    """
    counts = complete(ds, [var, class_]).groupBy(var).agg(F.count("*").cast("double").alias("n"))
    ranked = running(numbered(Dataset(counts.withColumn("__o0", F.col(var)), [("__o0", True)])), F.col("n"), "sum", "upto").df
    ranked = ranked.select(F.col(var).alias("__v"), "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    by_class = complete(ds, [var, class_]).groupBy(class_, var).agg(F.count("*").cast("double").alias("c"))
    sums = by_class.join(ranked, by_class[var] == ranked["__v"]).groupBy(class_).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("w")).orderBy(class_).collect()
    ties = float(ranked.agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n"))).head()[0])
    total = sum(r["n"] for r in sums)
    correct = 1 - ties / (total**3 - total) if total > 1 else 1.0
    h = 12 / (total * (total + 1)) * sum(r["w"] ** 2 / r["n"] for r in sums) - 3 * (total + 1)
    h /= correct or 1
    out = {"scores": table(ds.df.sparkSession, [class_, "n", "sum_of_scores", "expected", "mean_score"], [(r[class_], r["n"], r["w"], r["n"] * (total + 1) / 2, r["w"] / r["n"]) for r in sums]), "kruskal_wallis": h, "df": float(len(sums) - 1), "p": dist.chi2_upper(h, len(sums) - 1)}
    if len(sums) == 2:
        a, b = sums
        sd = math.sqrt(a["n"] * b["n"] * (total + 1) / 12 * correct)
        diff = a["w"] - a["n"] * (total + 1) / 2
        z = (diff - math.copysign(0.5, diff)) / sd if diff else 0.0
        out |= {"z": z, "p_wilcoxon": dist.norm_two_sided(z), "u": a["w"] - a["n"] * (a["n"] + 1) / 2}
    return out


# multivariate


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column's largest entry made positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[top, np.arange(vectors.shape[1])] + 1e-300)


def princomp(ds: Dataset, var: list[str], n: int | None = None, cov: bool = False, std: bool = False) -> dict[str, object]:
    rows, mean, c = covariance(complete(ds, var), var)
    sd = np.sqrt(np.diag(c))
    m = c if cov else c / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], _signed(vectors[:, ::-1])
    k = n or len(var)
    z = [(F.col(v) - float(mu)) / float(1.0 if cov else s) for v, mu, s in zip(var, mean, sd, strict=True)]
    scores = {f"prin{i + 1}": linear(z, vectors[:, i] / (math.sqrt(values[i]) if std else 1)) for i in range(k)}
    spark = ds.df.sparkSession
    return {"eigenvalues": table(spark, ["number", "eigenvalue", "proportion"], [(float(i + 1), float(v), float(v / values.sum())) for i, v in enumerate(values)]), "eigenvectors": table(spark, ["_name_", *(f"prin{i + 1}" for i in range(k))], [(v, *map(float, vectors[j, :k])) for j, v in enumerate(var)]), "out": ds.with_df(ds.df.withColumns(scores))}


def factor(ds: Dataset, var: list[str], n: int | None = None, rounds: int = 2000) -> dict[str, object]:
    """Maximum-likelihood factors by expectation-maximisation on the correlations; as many as eigenvalues over 1 unless told."""
    _, mean, c = covariance(complete(ds, var), var)
    sd = np.sqrt(np.diag(c))
    r = c / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(r)
    k = n or max(1, int((values > 1).sum()))
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-6))
    psi = np.maximum(1 - (load**2).sum(axis=1), 0.05)
    for _ in range(rounds):
        b = load.T @ np.linalg.inv(load @ load.T + np.diag(psi))
        ezz = np.eye(k) - b @ load + b @ r @ b.T
        new = r @ b.T @ np.linalg.inv(ezz)
        psi_new = np.maximum(np.diag(r - new @ b @ r), 1e-6)
        change = np.abs(new - load).max()
        load, psi = new, psi_new
        if change < 1e-8:
            break
    order = np.argsort(-(load**2).sum(axis=0))
    load = _signed(load[:, order])
    weights = np.linalg.inv(load @ load.T + np.diag(psi)) @ load
    z = [(F.col(v) - float(m)) / float(s) for v, m, s in zip(var, mean, sd, strict=True)]
    spark = ds.df.sparkSession
    return {"loadings": table(spark, ["_name_", *(f"factor{i + 1}" for i in range(k)), "communality"], [(v, *map(float, load[j]), float((load[j] ** 2).sum())) for j, v in enumerate(var)]), "out": ds.with_df(ds.df.withColumns({f"factor{i + 1}": linear(z, weights[:, i]) for i in range(k)}))}


def cancorr(ds: Dataset, var: list[str], with_: list[str]) -> dict[str, object]:
    n, mean, c = covariance(complete(ds, var + with_), var + with_)
    p = len(var)

    def root(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(m)
        return v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ v.T

    a, b = root(c[:p, :p]), root(c[p:, p:])
    u, s, vt = np.linalg.svd(a @ c[:p, p:] @ b)
    k = min(p, len(with_))
    x, y = _signed(a @ u[:, :k]), b @ vt[:k].T
    y *= np.sign(np.einsum("ik,ij,jk->k", x, c[:p, p:], y))
    rows = []
    for i in range(k):
        wilks = float(np.prod(1 - s[i:k] ** 2))
        df = (p - i) * (len(with_) - i)
        chi = -(n - 1 - (p + len(with_) + 1) / 2) * math.log(max(wilks, 1e-300))
        rows.append((float(i + 1), float(s[i]), float(s[i] ** 2), chi, float(df), dist.chi2_upper(chi, df)))
    cx = [F.col(v) - float(m) for v, m in zip(var, mean[:p], strict=True)]
    cy = [F.col(v) - float(m) for v, m in zip(with_, mean[p:], strict=True)]
    out = ds.df.withColumns({f"v{i + 1}": linear(cx, x[:, i]) for i in range(k)} | {f"w{i + 1}": linear(cy, y[:, i]) for i in range(k)})
    return {"correlations": table(ds.df.sparkSession, ["number", "correlation", "squared", "chisq", "df", "p"], rows), "out": ds.with_df(out)}


def pls(ds: Dataset, y: str, xs: list[str], factors: int = 2) -> dict[str, object]:
    """PLS with one response, from the correlations alone."""
    _, mean, c = covariance(complete(ds, [*xs, y]), [*xs, y])
    sd = np.sqrt(np.diag(c))
    r = c / np.outer(sd, sd)
    xx, xy, p = r[:-1, :-1], r[:-1, -1].copy(), len(xs)
    w_all, p_all, q_all, proj, explained, left = [], [], [], np.eye(p), [], 1.0
    for _ in range(min(factors, p)):
        w = xy / (np.linalg.norm(xy) or 1)
        turn = proj @ w
        tt = turn @ xx @ turn
        load, q = xx @ turn / tt, xy @ w / tt
        w_all.append(turn)
        p_all.append(load)
        q_all.append(q)
        explained.append(float(q * q * tt))
        proj = proj - np.outer(turn, load)
        xy = xy - load * q * tt
    beta = sum(t * q for t, q in zip(w_all, q_all, strict=True))
    z = [(F.col(v) - float(m)) / float(s) for v, m, s in zip(xs, mean, sd, strict=False)]
    out = {f"factor{i + 1}": linear(z, t) for i, t in enumerate(w_all)} | {"predicted": linear(z, beta) * float(sd[-1]) + float(mean[-1])}
    spark = ds.df.sparkSession
    return {"variation": table(spark, ["factor", "r2", "cumulative"], [(float(i + 1), e, float(sum(explained[: i + 1]))) for i, e in enumerate(explained)]), "weights": table(spark, ["_name_", *(f"factor{i + 1}" for i in range(len(w_all)))], [(v, *(float(t[j]) for t in w_all)) for j, v in enumerate(xs)]), "out": ds.with_df(ds.df.withColumns(out))}


def discrim(ds: Dataset, class_: str, var: list[str], priors: str = "proportional") -> dict[str, object]:
    """Linear discriminants from class means and the pooled covariance; _into_ and prob_<level> by the normal model."""
    df = complete(ds, [class_, *var])
    k = len(var)
    centre = [float(x) for x in df.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(var))).head()]
    z = [F.col(v) - m for v, m in zip(var, centre, strict=True)]
    rows = df.groupBy(class_).agg(F.count("*").cast("double").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(z)), *(F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k))).orderBy(class_).collect()
    pooled, means, sizes = np.zeros((k, k)), [], []
    for r in rows:
        s = np.array([r[f"s{i}"] for i in range(k)])
        c = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        pooled += c - np.outer(s, s) / r["n"]
        means.append(s / r["n"])
        sizes.append(r["n"])
    total = sum(sizes)
    inv = np.linalg.pinv(pooled / (total - len(rows)))
    scores = [linear(z, inv @ m) + float(-0.5 * m @ inv @ m + math.log(n / total if priors == "proportional" else 1 / len(rows))) for m, n in zip(means, sizes, strict=True)]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    weights = [F.exp(s - top) for s in scores]
    whole = weights[0]
    for w in weights[1:]:
        whole = whole + w
    text = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    into = None
    for r, s in zip(rows, scores, strict=True):
        into = F.when(s == top, F.lit(r[class_])) if into is None else into.when(s == top, F.lit(r[class_]))
    out = ds.with_df(ds.df.withColumns({"_into_": into} | {f"prob_{text(r[class_]).lower()}": w / whole for r, w in zip(rows, weights, strict=True)}))
    confusion = complete(out, [class_, *var]).groupBy(class_, "_into_").agg(F.count("*").cast("double").alias("count"))
    return {"confusion": plain(confusion, [class_, "_into_"]), "out": out}


def _assembled(df: DataFrame, var: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=var, outputCol="__v").transform(df)


def fastclus(ds: Dataset, var: list[str], k: int, seed: int = 1) -> dict[str, object]:
    """k-means; clusters are numbered from 1 by their centres."""
    from pyspark.ml.clustering import KMeans

    rows = _assembled(complete(ds, var), var)
    models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="__c").fit(rows) for i in range(4)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    mapping = F.create_map(*(F.lit(x) for new, old in enumerate(order) for x in (old, float(new + 1))))
    made = model.transform(rows).withColumn("cluster", mapping[F.col("__c")]).drop("__v", "__c")
    return {"means": table(ds.df.sparkSession, ["cluster", *var], [(float(new + 1), *centres[old]) for new, old in enumerate(order)]), "out": ds.with_df(made)}


def hpsplit(ds: Dataset, class_: str, xs: list[str], depth: int = 10, class_vars: list[str] = ()) -> dict[str, object]:
    from pyspark.ml.classification import DecisionTreeClassifier

    df = complete(ds, [class_, *xs])
    levels = [r[0] for r in df.select(class_).distinct().orderBy(class_).collect()]
    terms = design(ds, xs, class_vars)
    index = F.create_map(*(F.lit(x) for i, v in enumerate(levels) for x in (v, float(i))))
    rows = _assembled(df.withColumns({f"__x{i}": c for i, (_, c) in enumerate(terms)} | {"__y": index[F.col(class_)]}), [f"__x{i}" for i in range(len(terms))])
    model = DecisionTreeClassifier(featuresCol="__v", labelCol="__y", predictionCol="__p", maxDepth=min(depth, 30), seed=1, maxBins=64, probabilityCol="__q", rawPredictionCol="__r").fit(rows)
    back = F.create_map(*(F.lit(x) for i, v in enumerate(levels) for x in (float(i), v)))
    made = model.transform(rows).withColumn("_into_", back[F.col("__p")])
    made = made.drop("__v", "__p", "__q", "__r", "__y", *(f"__x{i}" for i in range(len(terms))))
    importance = model.featureImportances.toArray()
    return {"importance": table(ds.df.sparkSession, ["variable", "importance"], [(n, float(v)) for (n, _), v in zip(terms, importance, strict=True)]), "out": ds.with_df(made), "tree": model.toDebugString}


def cluster(ds: Dataset, var: list[str], method: str = "average", most: int = 5000, label: str | None = None) -> Dataset:
    """The merge history of hierarchical clustering by Lance-Williams updates; it needs all distances, so at most `most` rows. label: a variable that names the rows, else their numbers do."""
    rows = complete(ds, var).orderBy(*(ds.sort_columns() or [F.lit(0)])).select(*var, *([label] if label else [])).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"hierarchical clustering takes at most {most} rows; summarise with FASTCLUS first")
    x = np.array([list(r)[: len(var)] for r in rows], float)
    n = len(x)
    own = [str(int(v) if isinstance(v := r[-1], float) and v == int(v) else v).strip() for r in rows] if label else [f"ob{i + 1}" for i in range(n)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    if method in ("ward", "centroid"):
        d = d**2
    np.fill_diagonal(d, np.inf)
    sizes, labels, alive, out = [1.0] * n, own, list(range(n)), []
    for step in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        a, b = np.unravel_index(sub.argmin(), sub.shape)
        i, j = sorted((alive[a], alive[b]))
        h = d[i, j]
        ni, nj = sizes[i], sizes[j]
        for m in alive:
            if m in (i, j):
                continue
            nm = sizes[m]
            new = {"single": min(d[i, m], d[j, m]), "complete": max(d[i, m], d[j, m]), "average": (ni * d[i, m] + nj * d[j, m]) / (ni + nj), "centroid": (ni * d[i, m] + nj * d[j, m]) / (ni + nj) - ni * nj * h / (ni + nj) ** 2, "ward": ((ni + nm) * d[i, m] + (nj + nm) * d[j, m] - nm * h) / (ni + nj + nm)}[method]
            d[i, m] = d[m, i] = new
        out.append((float(n - step - 1), labels[i], labels[j], ni + nj, math.sqrt(max(h, 0)) if method in ("ward", "centroid") else float(h)))
        sizes[i], labels[i] = ni + nj, f"cl{n - step - 1}"
        alive.remove(j)
    return table(ds.df.sparkSession, ["clusters", "first", "second", "frequency", "distance"], out)


# survival


def lifetest(ds: Dataset, time: str, status: str, censored: list[float], strata: str | None = None) -> dict[str, object]:
    """Kaplan-Meier estimates at each time, from counts by time; log-rank test over strata."""
    df = complete(ds, [time, status, *([strata] if strata else [])])
    event = F.when(F.col(status).isin(censored), 0.0).otherwise(1.0)
    keys = [strata] if strata else []
    counts = df.groupBy(*keys, time).agg(F.sum(event).alias("failed"), F.count("*").cast("double").alias("m"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    later = group.orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = group.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("left", F.sum("m").over(later))
    # a factor of zero ends the curve; logs carry the product
    factor_ = F.when(F.col("failed") < F.col("left"), F.log(1 - F.col("failed") / F.col("left")))
    ended = F.max(F.when(F.col("failed") >= F.col("left"), 1).otherwise(0)).over(upto) == 1
    rows = rows.withColumn("survival", F.when(ended, 0.0).otherwise(F.exp(F.sum(F.coalesce(factor_, F.lit(0.0))).over(upto))))
    spread = F.sum(F.when(F.col("failed") < F.col("left"), F.col("failed") / (F.col("left") * (F.col("left") - F.col("failed"))))).over(upto)
    rows = rows.withColumn("stderr", F.col("survival") * F.sqrt(F.coalesce(spread, F.lit(0.0))))
    out: dict[str, object] = {"curve": plain(rows.select(*keys, time, "left", "failed", "survival", "stderr"), [*keys, time])}
    out["median"] = plain(rows.where(F.col("survival") <= 0.5).groupBy(*keys).agg(F.min(time).alias("median")) if keys else rows.where(F.col("survival") <= 0.5).agg(F.min(time).alias("median")), keys)
    if strata:
        levels = [r[0] for r in df.select(strata).distinct().orderBy(strata).collect()]
        wide = df.groupBy(time).agg(F.sum(event).alias("d"), F.count("*").cast("double").alias("m"), *(x for i, v in enumerate(levels) for x in (F.sum(F.when(F.col(strata) == v, event)).alias(f"d{i}"), F.count(F.when(F.col(strata) == v, 1)).cast("double").alias(f"m{i}"))))
        down = Window.partitionBy(F.lit(1)).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)
        risk = wide.select("d", *(f"d{i}" for i in range(len(levels))), F.sum("m").over(down).alias("n"), *(F.sum(f"m{i}").over(down).alias(f"n{i}") for i in range(len(levels)))).where("d > 0")
        k = len(levels)
        v = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") * F.col("n") * (F.col("n") - 1))).otherwise(0.0)
        row = risk.agg(*(F.sum(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) - F.col("d") * F.col(f"n{i}") / F.col("n")).alias(f"u{i}") for i in range(k)), *(F.sum(v * (F.col(f"n{i}") * ((F.col("n") if i == j else F.lit(0.0)) - F.col(f"n{j}")))).alias(f"v{i}_{j}") for i in range(k) for j in range(k))).head()
        u = np.array([row[f"u{i}"] for i in range(k)])[:-1]
        cov = np.array([[row[f"v{i}_{j}"] for j in range(k)] for i in range(k)])[:-1, :-1]
        x2 = float(u @ np.linalg.pinv(cov) @ u)
        out |= {"logrank": x2, "df": float(k - 1), "p": dist.chi2_upper(x2, k - 1)}
    return out


def phreg(ds: Dataset, time: str, status: str, censored: list[float], xs: list[str], class_: list[str] = (), rounds: int = 50) -> Fit:
    """Cox regression by Newton's method with Breslow ties; risk sets are sums by time, cumulated from the last time back."""
    terms = design(ds, xs, class_)
    k = len(terms)
    centre = complete(ds, [time, status, *xs]).agg(*(F.avg(c).alias(f"m{i}") for i, (_, c) in enumerate(terms))).head()
    event = F.when(F.col(status).isin(censored), 0.0).otherwise(1.0)
    df = stored(complete(ds, [time, status, *xs]).select(F.col(time).alias("t"), event.alias("e"), *((c - F.lit(centre[f"m{i}"])).alias(f"x{i}") for i, (_, c) in enumerate(terms))), "risk")
    x = [F.col(f"x{i}") for i in range(k)]
    beta, info = np.zeros(k), np.eye(k)
    for _ in range(rounds):
        w = F.exp(linear(x, beta))
        sums = [F.sum(w)] + [F.sum(w * c) for c in x] + [F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k)]
        per = df.groupBy("t").agg(F.sum("e").alias("d"), *(F.sum(F.when(F.col("e") > 0, c)).alias(f"z{i}") for i, c in enumerate(x)), *(s.alias(f"s{i}") for i, s in enumerate(sums)))
        rows = per.orderBy(F.col("t").desc()).limit(MAX_DRIVER_ROWS + 1).toPandas()
        if len(rows) > MAX_DRIVER_ROWS:
            raise ValueError(f"over {MAX_DRIVER_ROWS} distinct times; round them")
        s = rows[[f"s{i}" for i in range(len(sums))]].to_numpy(float).cumsum(axis=0)
        at = rows["d"].to_numpy(float) > 0
        d, s0 = rows["d"].to_numpy(float)[at], s[at, 0]
        s1 = s[at, 1 : 1 + k] / s0[:, None]
        s2 = np.zeros((at.sum(), k, k))
        iu = np.triu_indices(k)
        s2[:, iu[0], iu[1]] = s[at, 1 + k :] / s0[:, None]
        s2 = s2 + np.transpose(np.triu(s2, 1), (0, 2, 1))
        grad = rows[[f"z{i}" for i in range(k)]].fillna(0).to_numpy(float)[at].sum(axis=0) - (d[:, None] * s1).sum(axis=0)
        info = (d[:, None, None] * (s2 - s1[:, :, None] * s1[:, None, :])).sum(axis=0)
        step = np.linalg.pinv(info) @ grad
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return Fit([n for n, _ in terms], [c for _, c in terms], beta, np.linalg.pinv(info), None)


# series


def timeseries(ds: Dataset, var: str, period: int, model: str = "additive") -> Dataset:
    """Observed, trend (centred moving average), seasonal and residual of a series in its order."""
    rows = numbered(ds).df.select("__n", F.col(var).alias("observed"))
    half = period // 2
    # the terms of the moving average meet by row number: a join on shifted numbers, no window over all rows
    weights = {k: 1.0 / period for k in range(-half, half + 1)}
    if period % 2 == 0:
        weights[-half] = weights[half] = 0.5 / period
    shifts = F.explode(F.array(*(F.struct(F.lit(float(k)).alias("k"), F.lit(w).alias("w")) for k, w in weights.items())))
    moved = rows.select((F.col("__n")).alias("n0"), "observed", shifts.alias("s")).select((F.col("n0") - F.col("s.k")).alias("__n"), (F.col("observed") * F.col("s.w")).alias("part"))
    trend = moved.groupBy("__n").agg(F.count("part").alias("c"), F.sum("part").alias("trend")).where(F.col("c") == len(weights)).drop("c")
    both = rows.join(trend, "__n", "left")
    detrended = F.col("observed") - F.col("trend") if model == "additive" else F.col("observed") / F.col("trend")
    both = both.withColumns({"detrended": detrended, "season": F.pmod(F.col("__n") - 1, F.lit(float(period)))})
    seasons = both.groupBy("season").agg(F.avg("detrended").alias("m"))
    level = F.avg("m").over(Window.partitionBy(F.lit(1)))  # one row for each season of the period
    seasons = seasons.select("season", (F.col("m") - level if model == "additive" else F.col("m") / level).alias("seasonal"))
    out = both.join(F.broadcast(seasons), "season")
    rest = F.col("observed") - F.col("trend") - F.col("seasonal") if model == "additive" else F.col("observed") / (F.col("trend") * F.col("seasonal"))
    return Dataset(out.select(F.col("__n").alias("period"), "observed", "trend", "seasonal", rest.alias("residual"), F.col("__n").alias("__o0")), [("__o0", True)])


def _css(params: np.ndarray, z: np.ndarray, p: int, q: int) -> tuple[float, np.ndarray]:
    c, phi, theta = params[0], params[1 : 1 + p], params[1 + p :]
    e = np.zeros(len(z))
    for t in range(p, len(z)):
        ar = sum(phi[i] * (z[t - 1 - i] - c) for i in range(p))
        ma = sum(theta[j] * e[t - 1 - j] for j in range(q) if t - 1 - j >= 0)
        e[t] = z[t] - c - ar + ma
    return float((e[p:] ** 2).sum()), e


def _nelder_mead(f, start: np.ndarray, rounds: int = 4000) -> np.ndarray:
    points = [start] + [start + np.eye(len(start))[i] * (0.1 + 0.1 * abs(start[i])) for i in range(len(start))]
    values = [f(x) for x in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-12 * (1 + abs(values[0])):
            break
        mid = np.mean(points[:-1], axis=0)
        for scale in (1.0, 2.0, 0.5, -0.5):
            if scale == 2.0 and not got < values[0]:
                continue
            x = mid + scale * (mid - points[-1])
            new = f(x)
            if scale == 1.0:
                got, kept = new, x
                if values[0] <= new < values[-2]:
                    break
            elif scale == 2.0:
                if new < got:
                    got, kept = new, x
                break
            elif new < values[-1]:
                got, kept = new, x
                break
        if got < values[-1]:
            points[-1], values[-1] = kept, got
        else:
            points = [points[0]] + [points[0] + 0.5 * (x - points[0]) for x in points[1:]]
            values = [values[0]] + [f(x) for x in points[1:]]
    return points[int(np.argmin(values))]


def arima(ds: Dataset, var: str, p: int = 0, d: int = 0, q: int = 0, lead: int = 12, most: int = 100_000) -> dict[str, object]:
    """Conditional least squares of one series, which is sequential by nature and fits on the driver; forecasts with 95 % limits."""
    values = [r[0] for r in ds.df.where(F.col(var).isNotNull()).orderBy(*(ds.sort_columns() or [F.lit(0)])).select(var).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"a series of over {most} values")
    y = np.array(values, float)
    z = np.diff(y, d) if d else y
    start = np.zeros(1 + p + q)
    start[0] = z.mean()
    bound = lambda x: _css(x, z, p, q)[0] if np.abs(x[1:]).sum() < 10 * max(1, p + q) else 1e300
    best = _nelder_mead(bound, start) if p + q else start
    sse, e = _css(best, z, p, q)
    n = len(z) - p
    s2 = sse / max(1, n - len(best))
    c, phi, theta = best[0], best[1 : 1 + p], best[1 + p :]
    ext, err = list(z), list(e)
    for _ in range(lead):
        t = len(ext)
        ext.append(c + sum(phi[i] * (ext[t - 1 - i] - c) for i in range(p)) - sum(theta[j] * (err[t - 1 - j] if t - 1 - j >= 0 else 0) for j in range(q)))
        err.append(0.0)
    future = np.array(ext[len(z) :])
    for k in range(d, 0, -1):
        future = np.cumsum(future) + np.diff(y, k - 1)[-1]
    full = np.array([1.0])  # autoregressive polynomial with its differences
    full = np.convolve(full, np.concatenate([[1.0], -phi]))
    for _ in range(d):
        full = np.convolve(full, [1.0, -1.0])
    psi = np.zeros(lead)
    for t in range(lead):
        psi[t] = (1.0 if t == 0 else 0.0) - (theta[t - 1] if 0 < t <= q else 0.0) - sum(full[i] * psi[t - i] for i in range(1, min(t, len(full) - 1) + 1))
    se = np.sqrt(s2 * np.cumsum(psi**2))
    half = dist.norm_ppf(0.975) * se
    spark = ds.df.sparkSession
    names = ["mu", *(f"ar{i + 1}" for i in range(p)), *(f"ma{i + 1}" for i in range(q))]
    aic = n * math.log(sse / n if sse > 0 else 1e-300) + 2 * len(best)
    return {"estimates": table(spark, ["parameter", "estimate"], [(a, float(b)) for a, b in zip(names, best, strict=True)]), "variance": s2, "aic": aic, "forecast": table(spark, ["period", "forecast", "l95", "u95"], [(float(len(y) + i + 1), float(f), float(f - h), float(f + h)) for i, (f, h) in enumerate(zip(future, half, strict=True))])}


__all__ = [n for n in dir() if not n.startswith("_")] + ["combinations"]
