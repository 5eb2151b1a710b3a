"""Procedures: what their statements say, handed to the operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from rowloom.functions.formats import UserFormat
from rowloom.functions.lower import Lowering
from rowloom.functions.values import Val
from rowloom.language.ast import DataStep, Proc, Ref, Stmt
from rowloom.language.parser import Cursor, name_range
from rowloom.operators import stats, summary, tables
from rowloom.plans import sources
from rowloom.plans.dataset import Dataset
from rowloom.plans.datastep import ColumnStep
from rowloom.report import plots
from rowloom.sources import files

PROCS: dict[str, Callable] = {}


def proc(*names: str):
    def add(f):
        for n in names:
            PROCS[n] = f
        return f

    return add


class Spec:
    """A procedure's options and statements, read by the procedures below."""

    def __init__(self, session, p: Proc):
        self.session, self.p, self.options = session, p, p.options

    def cursor(self, word: str) -> Cursor | None:
        s = next((s for s in self.p.statements if s.kind == word), None)
        return None if s is None else Cursor(list(s["tokens"]))

    def cursors(self, word: str) -> list[Cursor]:
        return [Cursor(list(s["tokens"])) for s in self.p.statements if s.kind == word]

    def flag(self, name: str) -> bool:
        return name in self.options["flags"] or name in self.options

    def data(self, key: str = "data") -> Dataset:
        ref = self.options.get(key) or Ref("_last_")
        ds = sources.with_options(self.session.dataset(ref.name), ref, self.session.formats)
        where = self.cursor("where")
        if where is not None:
            ds = ds.filtered(Lowering(ds.val, self.session.formats).filter(where.expression()))
        return sources.limited(ds, *(int(v) if v else None for v in (self.options.get("firstobs"), self.options.get("obs"))))

    def names(self, word: str, ds: Dataset | None = None) -> list[str]:
        out: list[str] = []
        for c in self.cursors(word):
            got = c.variable_list("/")
            out += sources.resolve(got, ds.columns) if ds is not None else got
        return out

    def by(self) -> tuple[list[str], list[bool]]:
        c = self.cursor("by")
        names, down = [], []
        while c is not None and not c.done():
            down.append(c.take("descending"))
            names.append(c.name())
        return names, down

    def out(self, default: str | None = None) -> Ref | None:
        ref = self.options.get("out")
        return ref or (Ref(default) if default else None)

    def put(self, ref: Ref | None, ds: Dataset) -> None:
        if ref is not None:
            self.session.put(ref.name, sources.output_options(ds, ref))

    def show(self, title: str, ds) -> None:
        self.session.show(title, ds.ordered() if isinstance(ds, Dataset) else ds)

    def numbers(self, title: str, values: dict[str, object]) -> None:
        self.session.values |= {f"{self.p.name}.{k}": v for k, v in values.items()}
        rows = [(k, float(v)) for k, v in values.items() if isinstance(v, int | float)]
        if rows:
            self.show(title, stats.table(self.session.spark, ["statistic", "value"], rows))

    def model(self, ds: Dataset) -> tuple[str, list[str], dict[str, object]]:
        """y = effects / options; y may be time*status(values)."""
        text = next(s["text"] for s in self.p.statements if s.kind == "model")
        left, _, right = text.partition("=")
        body, _, opts = right.partition("/")
        effects = []
        for e in re.sub(r"\s*\*\s*", "*", body.lower()).replace("|", " | ").split():
            effects.append(e)
        if "|" in effects:
            a, b = effects[0], effects[2]
            effects = [a, b, f"{a}*{b}"]
        expanded = []
        for e in effects:
            m = re.fullmatch(r"([a-z_]\w*?\d+)-([a-z_]\w*?\d+)", e)
            expanded += name_range(m[1], m[2]) if m else [e]
        found: dict[str, object] = {"flags": []}
        for k, v in re.findall(r"([a-z_]+)(?:\s*=\s*([\w.+-]+))?", opts.lower()):
            if v:
                found[k] = v
            else:
                found["flags"].append(k)
        y = re.sub(r"\(\s*(event|descending|ref)[^)]*\)", "", left.strip().lower(), flags=re.IGNORECASE).strip()
        return y, expanded, found

    def classes(self, ds: Dataset) -> list[str]:
        return self.names("class", ds)

    def output(self) -> dict[str, object] | None:
        """output out=ds p=name r=name ..."""
        text = next((s["text"] for s in self.p.statements if s.kind == "output"), None)
        if text is None:
            return None
        pairs = dict((k.lower(), v.lower()) for k, v in re.findall(r"(\w+)\s*=\s*([\w.]+)", text))
        return {"out": Ref(sources_name(pairs.pop("out"))), **pairs}


def sources_name(text: str) -> str:
    from rowloom.language.parser import dataset_name

    return dataset_name(text.split("."))


def run(session, p: Proc) -> None:
    if p.name not in PROCS:
        raise NotImplementedError(f"no procedure {p.name}")
    PROCS[p.name](Spec(session, p))


# tables


@proc("sort")
def _sort(s: Spec) -> None:
    ds = s.data()
    by, down = s.by()
    unique = "key" if s.flag("nodupkey") else "row" if s.flag("nodup") or s.flag("noduprecs") or s.flag("noduprec") else None
    kept, others = tables.sort(ds, by, down, unique)
    s.put(s.out() or s.options.get("data") or Ref("_last_"), kept)
    if others is not None and s.options.get("dupout"):
        s.put(s.options["dupout"], others)


@proc("append")
def _append(s: Spec) -> None:
    base = s.options["base"]
    have = base.name in s.session.tables or "." in base.name
    s.session.put(base.name, tables.append(sources.with_options(s.session.dataset(base.name), base, s.session.formats) if have else None, s.data()))


@proc("print")
def _print(s: Spec) -> None:
    ds = s.data()
    var = s.names("var", ds) or None
    by, _ = s.by()
    ident = s.names("id", ds)
    formats = {}
    for st in s.p.statements:
        if st.kind == "format":
            c = Cursor(list(st["tokens"]))
            names: list[str] = []
            while not c.done():
                if c.peek().kind == "name" and c.peek(1).text != ".":
                    names.append(c.name())
                else:
                    text = c.next().text
                    text += c.next().text if text == "$" or not text.endswith(".") and c.at(".") else ""
                    formats |= dict.fromkeys(names, text)
                    names = []
    shown = tables.printed(ds, [*ident, *(v for v in var or ds.columns if v not in ident)], formats, s.session.formats, by, int(s.options["obs"]) if s.options.get("obs") else None)
    s.show("Listing", shown)
    sums = s.names("sum", ds)
    if sums:
        s.show("Totals", ds.df.groupBy(*by).agg(*(F.sum(v).alias(v) for v in sums)) if by else ds.df.agg(*(F.sum(v).alias(v) for v in sums)))


@proc("contents")
def _contents(s: Spec) -> None:
    out = tables.contents(s.data(), s.session.spark)
    s.put(s.out(), out)
    s.show("Contents", out)


@proc("transpose")
def _transpose(s: Spec) -> None:
    ds = s.data()
    by, _ = s.by()
    ident = s.names("id", ds)
    out = tables.transpose(ds, s.names("var", ds) or None, by, ident[0] if ident else None, str(s.options.get("prefix") or ""), str(s.options.get("suffix") or ""), str(s.options.get("name") or "_name_"))
    s.put(s.out("data1"), out)


@proc("rank")
def _rank(s: Spec) -> None:
    ds = s.data()
    out = tables.rank(ds, s.names("var", ds), s.names("ranks") or None, s.by()[0], s.flag("descending"), int(s.options["groups"]) if s.options.get("groups") else None)
    s.put(s.out("data1"), out)


@proc("standard")
def _standard(s: Spec) -> None:
    ds = s.data()
    out = tables.standard(ds, s.names("var", ds) or [c for c in ds.columns if ds.kind(c) == "num"], *(float(s.options[k]) if s.options.get(k) is not None else None for k in ("mean", "std")), s.flag("replace"), s.by()[0])
    s.put(s.out("data1"), out)


@proc("surveyselect")
def _surveyselect(s: Spec) -> None:
    ds = s.data()
    n = s.options.get("n") or s.options.get("sampsize")
    rate = s.options.get("samprate") or s.options.get("rate")
    if (n is None) == (rate is None):
        raise ValueError("SURVEYSELECT needs either N= or SAMPRATE=")
    if str(s.options.get("method") or "srs") != "srs":
        raise ValueError("METHOD=SRS is what there is")
    s.put(s.out("sample"), tables.sample(ds, int(n) if n else None, float(rate) if rate else None, int(s.options.get("seed") or 0), s.names("strata", ds)))


@proc("compare")
def _compare(s: Spec) -> None:
    base, other = s.data("base"), s.data("compare")
    by, down = s.by()
    transforms: dict[str, str] = {}
    for c in s.cursors("transform"):
        names: list[str] = []
        while not c.done():
            if c.take("="):
                function = c.name()
                transforms |= {n: function for n in sources.resolve(names, base.columns)}
                names = []
            else:
                names.append(c.name())
        if names:
            raise ValueError("TRANSFORM needs variables = function")
    out = tables.compare(base, other, s.names("id", base), s.names("var", base) or None, float(s.options.get("criterion") or 0), by, transforms)
    s.put(s.out(), out)
    s.show("Differences", out)


@proc("import")
def _import(s: Spec) -> None:
    s.put(s.out("data1"), files.import_table(s.session.spark, str(s.options["datafile"]), str(s.options.get("dbms") or "csv")))


@proc("export")
def _export(s: Spec) -> None:
    files.export_table(s.data(), str(s.options["outfile"]), str(s.options.get("dbms") or "csv"))


@proc("datasets")
def _datasets(s: Spec) -> None:
    lib = str(s.options.get("lib") or s.options.get("library") or "work")
    full = lambda n: n if lib == "work" else f"{lib}.{n}"
    for st in s.p.statements:
        c = Cursor(list(st["tokens"]))
        if st.kind == "delete":
            for n in c.variable_list("/"):
                s.session.tables.pop(full(n), None)
                if lib != "work":
                    s.session.libraries[lib].drop(n)
        elif st.kind == "change":
            while not c.done():
                old = c.name()
                c.expect("=")
                new = c.name()
                if full(old) in s.session.tables:
                    s.session.tables[full(new)] = s.session.tables.pop(full(old))
                if lib != "work":
                    s.session.libraries[lib].rename(old, new)


@proc("format")
def _format(s: Spec) -> None:
    for c in s.cursors("value"):
        char = c.take("$") or c.peek().text.startswith("$")
        name = c.next().text.lower().lstrip("$").rstrip(".")
        user = UserFormat(char)
        while not c.done():
            keys: list[tuple] = []
            while not c.at("="):
                if c.at("other"):
                    c.next()
                    keys.append(("other",))
                else:
                    keys.append(_range(c, char))
                c.take(",")
            c.expect("=")
            label = str(c.next().value)
            for k in keys:
                if k == ("other",):
                    user.other = label
                else:
                    user.ranges.append((*k, label))
        s.session.formats[("$" if char else "") + name] = user


def _range(c: Cursor, char: bool) -> tuple:
    """(low, high, low open, high open) up to the next comma or equals sign."""

    def end():
        sign = -1 if c.take("-") else 1
        token = c.next()
        if token.text.lower() in ("low", "high"):
            return None
        if token.kind == "str":
            return token.value
        return sign * float(token.text if token.value is None else token.value)

    low = end()
    if char or not c.at("-", "<"):
        return (low, low, False, False)
    low_open = c.take("<")
    c.expect("-")
    high_open = c.take("<")
    return (low, end(), low_open, high_open)


@proc("fcmp")
def _fcmp(s: Spec) -> None:
    from rowloom.plans.routines import Routine

    for st in s.p.statements:
        if st.kind in ("function", "subroutine"):
            s.session.functions[st["name"]] = Routine(st["name"], st["params"], st["char"], st["body"], st["outargs"])


@proc("sql")
def _sql(s: Spec) -> None:
    from rowloom.sql import run_sql

    run_sql(s.session, s.p.text)


# summaries


@proc("means", "summary")
def _means(s: Spec) -> None:
    ds = s.data()
    class_, (by, _) = s.classes(ds), s.by()
    known = {"n", "nmiss", "mean", "std", "stddev", "min", "max", "sum", "median", "var", "range", "lclm", "uclm", "stderr", "cv", "uss", "css", "skew", "kurt", "mode", "q1", "q3", "qrange", *summary.PERCENTILES}
    listed = [f for f in s.options["flags"] if f in known]
    var = s.names("var", ds) or None
    names: dict[tuple[str, str], str] = {}
    out, wanted = None, []
    c = s.cursor("output")
    variables = var or [x for x in ds.columns if ds.kind(x) == "num" and x not in class_ + by]
    while c is not None and not c.done():
        word = c.name()
        if word == "out":
            c.expect("=")
            out = c.ref()
        elif c.at("("):
            c.next()
            v = c.name()
            c.expect(")")
            c.expect("=")
            names[(word, v)] = c.name()
            wanted.append(word)
        elif c.take("="):
            wanted.append(word)
            for v in variables:
                if c.done() or c.peek(1).text in ("=", "("):
                    break
                names[(word, v)] = c.name()
    stats_ = list(dict.fromkeys([*listed, *wanted])) or ["n", "mean", "std", "min", "max"]
    types = ways = None
    t = s.cursor("types")
    if t is not None:
        text = next(st["text"] for st in s.p.statements if st.kind == "types").lower()
        types = [[] if x.strip() == "()" else x.split("*") for x in re.sub(r"\s*\*\s*", "*", text).split()]
    w = s.cursor("ways")
    if w is not None:
        ways = [int(x) for x in next(st["text"] for st in s.p.statements if st.kind == "ways").split()]
    made = summary.means(ds, var, class_, by, stats_, types, ways, float(s.options.get("alpha") or 0.05), names)
    s.put(out or s.out(), made)
    if not s.flag("noprint"):
        s.show("Means", made)


@proc("freq")
def _freq(s: Spec) -> None:
    ds = s.data()
    for st in s.p.statements:
        if st.kind not in ("tables", "table"):
            continue
        body, _, opts = st["text"].lower().partition("/")
        flags = set(re.findall(r"[a-z]+", opts))
        out = re.search(r"out\s*=\s*([\w.]+)", opts)
        for request in re.sub(r"\s*\*\s*", "*", body).split():
            var = request.split("*")
            made = summary.frequency(ds, var)
            s.show(f"Frequencies of {request}", made)
            if out:
                s.put(Ref(sources_name(out[1])), made)
            if len(var) == 2 and flags & {"chisq", "measures", "relrisk", "riskdiff", "agree"}:
                left, right, cells = summary.crosstab(ds, *var)
                if "chisq" in flags:
                    s.numbers("Chi-square tests", summary.chisq(cells, left, right))
                if flags & {"measures", "relrisk", "riskdiff"} and cells.shape == (2, 2):
                    s.numbers("Measures", summary.two_by_two(cells))
                if "agree" in flags and cells.shape[0] == cells.shape[1]:
                    s.numbers("Agreement", summary.agreement(cells))
            elif len(var) == 1 and "chisq" in flags:
                s.numbers("Chi-square test", summary.chisq_equal([r["count"] for r in made.visible().collect()]))


@proc("univariate")
def _univariate(s: Spec) -> None:
    ds = s.data()
    made = summary.univariate(ds, s.names("var", ds) or None)
    for title, d in made.items():
        s.show(title.capitalize(), d)
    out = s.output()
    if out:
        s.put(out["out"], made["moments"])
    if s.flag("normal"):
        for v in s.names("var", ds):
            s.numbers(f"Normality of {v}", summary.normality(ds, v))


@proc("tabulate")
def _tabulate(s: Spec) -> None:
    ds = s.data()
    text = next(st["text"] for st in s.p.statements if st.kind == "table").lower()
    class_, var = s.classes(ds), s.names("var", ds)
    row, _, rest = text.partition(",")
    words = re.findall(r"[a-z_]\w*", rest or row)
    first = re.findall(r"[a-z_]\w*", row)
    measured = list(dict.fromkeys(w for w in [*first, *words] if w in var)) or var[:1]
    stats_ = list(dict.fromkeys(w for w in [*first, *words] if w not in class_ and w not in var)) or ["sum"]
    if not measured:
        raise ValueError("TABULATE needs an analysis variable: add VAR, or var*statistic on one axis")
    if len(measured) > 1:
        raise ValueError(f"TABULATE takes one analysis variable in a TABLE statement, not {' '.join(measured)}: write one TABULATE for each")
    rows = [w for w in first if w in class_]
    cols = [w for w in words if w in class_] if rest else []
    made = summary.tabulate(ds, rows or class_[:1], cols, measured[0], stats_)
    s.put(s.out(), made)
    s.show("Table", made)


@proc("report")
def _report(s: Spec) -> None:
    ds = s.data()
    columns = s.names("column") or s.names("columns") or ds.columns
    group, analysis, computed = [], {}, []
    for c in s.cursors("define"):
        name = c.name()
        c.take("/")
        words = []
        while not c.done():
            words.append(c.next().text.lower())
        if "group" in words or "order" in words:
            group.append(name)
        elif "computed" in words:
            computed.append(name)
        elif "analysis" in words or any(w in ("sum", "mean", "n", "min", "max", "std", "median") for w in words):
            analysis[name] = next((w for w in words if w in ("sum", "mean", "n", "min", "max", "std", "median")), "sum")
    if group and not analysis:
        analysis = {c: "sum" for c in columns if c in ds.columns and ds.kind(c) == "num" and c not in group}
    breaks = [c.name() for c in (Cursor([t for t in st["tokens"] if t.text.lower() not in ("after", "before")]) for st in s.p.statements if st.kind == "break")]
    made = summary.report(ds, [c for c in columns if c not in computed], group, analysis, breaks, any(st.kind == "rbreak" for st in s.p.statements))
    for st in s.p.statements:
        if st.kind == "compute":
            step = DataStep([Ref("report")], st["body"])
            made = ColumnStep(DataStep([Ref("report")], [Stmt("set", {"refs": [Ref("report")]}), *step.body]), s.session.context().__class__(lambda n, m=made: m, s.session.formats, s.session.functions)).run()["report"]
    s.put(s.out(), made)
    s.show("Report", made)


# statistics


@proc("corr")
def _corr(s: Spec) -> None:
    ds = s.data()
    made = stats.corr(ds, s.names("var", ds) or [c for c in ds.columns if ds.kind(c) == "num"], s.names("with", ds) or None)
    s.show("Correlations", made)
    ref = s.options.get("outp") or s.out()
    if ref:
        wide = made.df.groupBy("_name_").pivot("with").agg(F.first("r"))
        s.put(ref, tables.plain(wide, ["_name_"]))


def _fitted(s: Spec, fit: stats.Fit, ds: Dataset, y: str | None, link=lambda c: c) -> None:
    s.show("Estimates", fit.estimates(s.session.spark))
    s.numbers("Fit", {k: v for k, v in fit.more.items() if isinstance(v, int | float)})
    s.session.values[f"{s.p.name}.fit"] = fit
    out = s.output()
    if out:
        p = out.get("p") or out.get("predicted") or out.get("pred")
        s.put(out["out"], stats.scored(ds, fit, y, p, out.get("r") or out.get("residual"), link))


@proc("reg", "glm")
def _reg(s: Spec) -> None:
    ds = s.data()
    y, xs, opts = s.model(ds)
    fit = stats.regress(ds, y, xs, s.classes(ds), "noint" not in opts["flags"], opts.get("selection"), float(opts.get("slstay") or 0.1), float(opts.get("slentry") or 0.15))
    if "vif" in opts["flags"]:
        s.numbers("Variance inflation", stats.vif(fit))
    _fitted(s, fit, ds, y)


@proc("logistic")
def _logistic(s: Spec) -> None:
    ds = s.data()
    y, xs, _ = s.model(ds)
    fit = stats.glm(ds, y, xs, s.classes(ds), "binomial")
    import math

    s.numbers("Odds ratios", {n: math.exp(b) for n, b in zip(fit.names, fit.beta, strict=True) if n != "intercept"} | stats.concordance(ds, fit, y))
    _fitted(s, fit, ds, y, fit.more["link"])


@proc("genmod")
def _genmod(s: Spec) -> None:
    ds = s.data()
    y, xs, opts = s.model(ds)
    fit = stats.glm(ds, y, xs, s.classes(ds), {"bin": "binomial", "nor": "normal", "poi": "poisson", "gam": "gamma", "neg": "negbin"}[str(opts.get("dist") or "normal")[:3]], opts.get("link"))
    _fitted(s, fit, ds, y, fit.more["link"])


@proc("robustreg")
def _robustreg(s: Spec) -> None:
    ds = s.data()
    y, xs, _ = s.model(ds)
    _fitted(s, stats.robust(ds, y, xs, s.classes(ds)), ds, y)


@proc("quantreg")
def _quantreg(s: Spec) -> None:
    ds = s.data()
    y, xs, opts = s.model(ds)
    _fitted(s, stats.quantile_regress(ds, y, xs, s.classes(ds), float(opts.get("quantile") or 0.5)), ds, y)


@proc("mixed")
def _mixed(s: Spec) -> None:
    ds = s.data()
    y, xs, _ = s.model(ds)
    text = next(st["text"] for st in s.p.statements if st.kind == "random").lower()
    subject = re.search(r"subject\s*=\s*(\w+)", text)[1]
    _fitted(s, stats.mixed(ds, y, xs, subject, [c for c in s.classes(ds) if c != subject]), ds, y)


@proc("nlin")
def _nlin(s: Spec) -> None:
    ds = s.data()
    start = {k.lower(): float(v) for k, v in re.findall(r"(\w+)\s*=\s*([-+]?[\d.]+(?:e[-+]?\d+)?)", next(st["text"] for st in s.p.statements if st.kind in ("parms", "parameters")), re.IGNORECASE)}
    c = s.cursor("model")
    y = c.name()
    c.expect("=")
    e = c.expression()
    from rowloom.functions.values import as_num, num
    from rowloom.plans.datastep import expressions

    used = [x[1] for x in expressions([e]) if x[0] == "var" and x[1] not in start]
    rows = stats.complete(ds, [y, *used])
    fit = stats.nonlinear(rows, F.col(y), lambda t: as_num(Lowering(lambda n: num(t[n]) if n in t else ds.val(n)).value(e)).col, start)
    s.show("Estimates", fit.estimates(s.session.spark))
    s.session.values["nlin.fit"] = fit


@proc("ttest")
def _ttest(s: Spec) -> None:
    ds = s.data()
    paired = s.cursor("paired")
    h0 = float(s.options.get("h0") or 0)
    if paired is not None:
        a = paired.name()
        paired.expect("*")
        made = stats.ttest(ds, a, paired=paired.name(), h0=h0)
    else:
        class_ = s.classes(ds)
        made = stats.ttest(ds, s.names("var", ds)[0], class_[0] if class_ else None, h0=h0)
    s.put(s.out(), made)
    s.show("t tests", made)


@proc("anova")
def _anova(s: Spec) -> None:
    ds = s.data()
    y, effects, _ = s.model(ds)
    made = stats.anova(ds, y, effects)
    s.put(s.out(), made)
    s.show("Analysis of variance", made)


@proc("npar1way")
def _npar1way(s: Spec) -> None:
    ds = s.data()
    for v in s.names("var", ds):
        made = stats.npar1way(ds, v, s.classes(ds)[0])
        s.show(f"Scores of {v}", made["scores"])
        s.numbers("Tests", {k: v for k, v in made.items() if isinstance(v, int | float)})


def _named(s: Spec, made: dict) -> None:
    for k, v in made.items():
        if isinstance(v, Dataset) and k != "out":
            s.show(k.capitalize(), v)
    s.put(s.out(), made["out"])
    s.session.values |= {f"{s.p.name}.{k}": v for k, v in made.items()}


@proc("princomp")
def _princomp(s: Spec) -> None:
    ds = s.data()
    _named(s, stats.princomp(ds, s.names("var", ds), int(s.options["n"]) if s.options.get("n") else None, s.flag("cov"), s.flag("std")))


@proc("factor")
def _factor(s: Spec) -> None:
    ds = s.data()
    n = s.options.get("n") or s.options.get("nfactors")
    _named(s, stats.factor(ds, s.names("var", ds), int(n) if n else None))


@proc("cancorr")
def _cancorr(s: Spec) -> None:
    ds = s.data()
    _named(s, stats.cancorr(ds, s.names("var", ds), s.names("with", ds)))


@proc("pls")
def _pls(s: Spec) -> None:
    ds = s.data()
    y, xs, _ = s.model(ds)
    made = stats.pls(ds, y, xs, int(s.options.get("nfac") or 2))
    out = s.output()
    if out:
        s.put(out["out"], made["out"])
    _named(s, made)


@proc("discrim")
def _discrim(s: Spec) -> None:
    ds = s.data()
    _named(s, stats.discrim(ds, s.classes(ds)[0], s.names("var", ds)))


@proc("hpsplit")
def _hpsplit(s: Spec) -> None:
    ds = s.data()
    y, xs, _ = s.model(ds)
    _named(s, stats.hpsplit(ds, y, xs, int(s.options.get("maxdepth") or 10), [c for c in s.classes(ds) if c != y]))


@proc("fastclus")
def _fastclus(s: Spec) -> None:
    ds = s.data()
    _named(s, stats.fastclus(ds, s.names("var", ds), int(s.options.get("maxclusters") or s.options.get("maxc") or 2)))


@proc("cluster")
def _cluster(s: Spec) -> None:
    ds = s.data()
    made = stats.cluster(ds, s.names("var", ds), str(s.options.get("method") or "average"), label=next(iter(s.names("id", ds)), None))
    s.put(s.options.get("outtree") or s.out(), made)
    s.show("Merges", made)


def _time_status(text: str) -> tuple[str, str, list[float]]:
    m = re.match(r"\s*(\w+)\s*\*\s*(\w+)\s*\(([^)]*)\)", text.lower())
    return m[1], m[2], [float(x) for x in re.split(r"[\s,]+", m[3].strip())]


@proc("lifetest")
def _lifetest(s: Spec) -> None:
    ds = s.data()
    text = next(st["text"] for st in s.p.statements if st.kind == "time")
    strata = s.names("strata", ds)
    made = stats.lifetest(ds, *_time_status(text), strata[0] if strata else None)
    s.put(s.options.get("outsurv") or s.out(), made["curve"])
    s.show("Survival", made["curve"])
    s.show("Medians", made["median"])
    s.numbers("Log-rank test", {k: v for k, v in made.items() if isinstance(v, float)})


@proc("phreg")
def _phreg(s: Spec) -> None:
    import math

    ds = s.data()
    y, xs, _ = s.model(ds)
    fit = stats.phreg(ds, *_time_status(y), xs, s.classes(ds))
    s.numbers("Hazard ratios", {n: math.exp(b) for n, b in zip(fit.names, fit.beta, strict=True)})
    _fitted(s, fit, ds, None)


@proc("arima")
def _arima(s: Spec) -> None:
    ds = s.data()
    get = lambda word: next((st["text"].lower() for st in s.p.statements if st.kind == word), "")
    number = lambda text, key, default: int((re.search(rf"\b{key}\s*=\s*(\d+)", text) or [0, default])[1])
    m = re.search(r"var\s*=\s*(\w+)\s*(?:\(\s*(\d+)\s*\))?", get("identify"))
    made = stats.arima(ds, m[1], number(get("estimate"), "p", 0), int(m[2] or 0), number(get("estimate"), "q", 0), number(get("forecast"), "lead", 12))
    s.show("Estimates", made["estimates"])
    s.numbers("Fit", {"variance": made["variance"], "aic": made["aic"]})
    out = re.search(r"out\s*=\s*([\w.]+)", get("forecast"))
    if out:
        s.put(Ref(sources_name(out[1])), made["forecast"])
    s.show("Forecasts", made["forecast"])


@proc("timeseries")
def _timeseries(s: Spec) -> None:
    ds = s.data()
    text = " ".join(st["text"].lower() for st in s.p.statements) + " " + s.p.text.lower()
    period = int((re.search(r"(?:period|seasonality)\s*=\s*(\d+)", text) or [0, 12])[1])
    kind = "multiplicative" if re.search(r"(?:model|mode)\s*=\s*mult", text) else "additive"
    made = stats.timeseries(ds, s.names("var", ds)[0], period, kind)
    s.put(s.out(), made)
    s.show("Decomposition", made)


@proc("sgplot")
def _sgplot(s: Spec) -> None:
    ds = s.data()
    canvas = plots.Canvas(str(s.options.get("title") or " ".join(s.session.titles.values())))
    for st in s.p.statements:
        opts = dict(re.findall(r"(\w+)\s*=\s*([\w.]+)", st["text"].lower()))
        word = re.match(r"\s*(\w+)", st["text"].lower())
        first = word[1] if word else None
        if st.kind in ("scatter", "series"):
            made = plots.points(ds, opts["x"], opts["y"])
            rows = made.ordered().collect()
            if st.kind == "series":
                canvas.line([r["x"] for r in rows], [r["y"] for r in rows])
            for r in rows if st.kind == "scatter" else []:
                canvas.dot(r["x"], r["y"])
        elif st.kind in ("vbar", "hbar"):
            made = plots.bars(ds, first, opts.get("response"), opts.get("stat", "sum"))
            for k, r in enumerate(made.ordered().collect()):
                canvas.rect(k, 0, k + 0.8, r["value"]) if st.kind == "vbar" else canvas.rect(0, k, r["value"], k + 0.8)
        elif st.kind == "histogram":
            made = plots.histogram(ds, first)
            for r in made.ordered().collect():
                canvas.rect(r["low"], 0, r["high"], r["count"])
        elif st.kind == "density":
            made = plots.density(ds, first)
            rows = made.ordered().collect()
            canvas.line([r["x"] for r in rows], [r["density"] for r in rows])
        elif st.kind in ("vbox", "hbox"):
            made = plots.boxes(ds, first, opts.get("category"))
            for k, r in enumerate(made.ordered().collect()):
                canvas.rect(k + 0.2, r["q1"], k + 0.8, r["q3"])
                canvas.line([k + 0.5, k + 0.5], [r["low"], r["high"]])
        elif st.kind == "refline":
            canvas.rule(float(re.match(r"\s*([-\d.]+)", st["text"])[1]))
            continue
        else:
            continue
        s.show(f"Plot data: {st.kind}", made)
    out = s.options.get("out")
    n = s.session.values["sgplot.count"] = s.session.values.get("sgplot.count", 0) + 1
    canvas.save(out.name if isinstance(out, Ref) else str(out) if out else f"sgplot_{n}.svg")


__all__ = ["PROCS", "Val", "run"]
