"""Embedded SQL: Spark SQL with what other dialects say put in its words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from rowloom.language.dates import date_literal
from rowloom.plans.dataset import Dataset, from_frame

_PIECES = re.compile(r"('(?:[^']|'')*'(?:dt|d|t)?(?!\w))|(\"(?:[^\"]|\"\")*\")|(--[^\n]*|/\*.*?\*/)", re.IGNORECASE | re.DOTALL)


def statements(text: str) -> list[str]:
    out, start, at = [], 0, 0
    while at < len(text):
        found = _PIECES.match(text, at)
        if found:
            at = found.end()
            continue
        if text[at] == ";":
            out.append(text[start:at])
            start = at + 1
        at += 1
    return [s.strip() for s in [*out, text[start:]] if s.strip()]


def outside_quotes(text: str, change) -> str:
    """change(text) wherever text is not quoted."""
    out, at = [], 0
    for found in _PIECES.finditer(text):
        out += [change(text[at : found.start()]), found.group()]
        at = found.end()
    return "".join([*out, change(text[at:])])


def top_level(text: str, word: str) -> int:
    """Where a word stands outside brackets and quotes, or -1."""
    depth, at, want = 0, 0, re.compile(rf"\b{word}\b", re.IGNORECASE)
    while at < len(text):
        found = _PIECES.match(text, at)
        if found:
            at = found.end()
            continue
        depth += (text[at] == "(") - (text[at] == ")")
        if not depth and want.match(text, at) and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")):
            return at
        at += 1
    return -1


def _qualify(text: str) -> str:
    """A QUALIFY clause as a filter over a subquery."""
    at = top_level(text, "qualify")
    if at < 0:
        return text
    ends = [k for w in (r"order\s+by", "limit", "union", "intersect", "except") if (k := top_level(text[at:], w)) > 0]
    end = at + min(ends) if ends else len(text)
    test, head, tail = text[at + 7 : end].strip(), text[:at], text[end:]
    low = top_level(head, "from")
    return f"SELECT * EXCEPT (__q) FROM ({head[:low]}, ({test}) AS __q {head[low:]}) WHERE __q {tail}"


_ASOF = re.compile(r"(\w+)(?:\s+(?:as\s+)?(\w+))?\s+asof\s+(left\s+)?join\s+(\w+)(?:\s+(?:as\s+)?(\w+))?\s+on\s+(.*?)(?=\bwhere\b|\bgroup\s+by\b|\border\s+by\b|\bqualify\b|\blimit\b|$)", re.IGNORECASE | re.DOTALL)


def _asof(session, text: str) -> str:
    """ASOF JOIN: each left row with the last right row at or before it, by one union and window over the equal keys."""
    found = _ASOF.search(text)
    if not found:
        return text
    left, a, outer, right, b, on = found.groups()
    a, b = a or left, b or right
    equal, bound = [], None
    for part in re.split(r"\band\b", on, flags=re.IGNORECASE):
        m = re.match(r"\s*(\w+)\.(\w+)\s*(>=|>|<=|<|=)\s*(\w+)\.(\w+)\s*$", part.strip())
        x, op, y = (m[2], m[3], m[5]) if m[1].lower() == a.lower() else (m[5], {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}[m[3]], m[2])
        if op == "=":
            equal.append((x, y))
        else:
            bound = (x, op, y)
    spark = session.spark
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    lf, rf = spark.table(left), spark.table(right)
    one = lf.select(*(F.col(x).alias(f"__k{i}") for i, (x, _) in enumerate(equal)), F.col(bound[0]).alias("__t"), F.lit(1 if bound[1] == ">=" else 0).alias("__side"), F.struct(*lf.columns).alias("__l"), F.lit(None).cast(rf.select(F.struct(*rf.columns).alias("s")).schema["s"].dataType).alias("__r"))
    two = rf.select(*(F.col(y).alias(f"__k{i}") for i, (_, y) in enumerate(equal)), F.col(bound[2]).alias("__t"), F.lit(0 if bound[1] == ">=" else 1).alias("__side"), F.lit(None).cast(one.schema["__l"].dataType).alias("__l"), F.struct(*rf.columns).alias("__r"))
    w = Window.partitionBy(*(f"__k{i}" for i in range(len(equal)))).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = one.unionByName(two).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__l is not null")
    if not outer:
        rows = rows.where("__r is not null")
    name = f"__asof{len(session.notes)}_{abs(hash(text)) % 10_000}"
    rows.select(F.col("__l").alias(a), F.col("__r").alias(b)).createOrReplaceTempView(name)
    return text[: found.start()] + name + " " + text[found.end() :]


#: Codes of strftime and what date_format calls them.
CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD"}


def _strftime(text: str) -> str:
    """strftime(value, 'codes') as date_format."""
    while found := re.search(r"\bstrftime\s*\(", text, re.IGNORECASE):
        k, depth, comma = found.end(), 1, -1
        while depth and k < len(text):
            quoted = _PIECES.match(text, k)
            if quoted:
                k = quoted.end()
                continue
            depth += (text[k] == "(") - (text[k] == ")")
            if depth == 1 and text[k] == ",":
                comma = k
            k += 1
        value, codes = text[found.end() : comma], text[comma + 1 : k - 1].strip()
        if comma < 0 or codes[:1] != "'":
            raise ValueError("strftime needs a value and quoted codes")
        plain = re.split(r"%(.)", codes[1:-1])
        unknown = [c for c in plain[1::2] if c not in CODES and c != "%"]
        if unknown:
            raise ValueError(f"strftime has no code %{unknown[0]} here")
        pieces = [CODES.get(x, "%") if k % 2 else re.sub(r"[A-Za-z]+", lambda m: f"''{m[0]}''", x) for k, x in enumerate(plain)]
        text = f"{text[: found.start()]}date_format({value}, '{''.join(pieces)}'){text[k:]}"
    return text


def _nulls_last(text: str) -> str:
    """ORDER BY with nulls last wherever it does not say."""
    out, at = [], 0
    for found in re.finditer(r"\border\s+by\b", text, re.IGNORECASE):
        if any(q.start() <= found.start() < q.end() for q in _PIECES.finditer(text)):
            continue
        k, depth, begin = found.end(), 0, found.end()
        out.append(text[at : found.end()])
        while k < len(text):
            quoted = _PIECES.match(text, k)
            if quoted:
                k = quoted.end()
                continue
            depth += (text[k] == "(") - (text[k] == ")")
            stop = depth < 0 or text[k] == ";" or not depth and text[k - 1].isspace() and re.match(r"(?:limit|offset|rows|range|groups|qualify|union|intersect|except)\b", text[k:], re.IGNORECASE)
            if stop or not depth and text[k] == ",":
                out.append(_nulls_item(text[begin:k]))
                begin = k
            if stop:
                break
            k += 1
        else:
            out.append(_nulls_item(text[begin:]))
            begin = len(text)
        at = begin
    return "".join([*out, text[at:]])


def _nulls_item(item: str) -> str:
    bare = item.rstrip()
    return item if re.search(r"\bnulls\s+(first|last)$", bare, re.IGNORECASE) or bare.lstrip(", ").lower() == "all" else bare + " NULLS LAST" + item[len(bare) :]


def translated(session, text: str, known: list[str]) -> str:
    def date(m: re.Match) -> str:
        return repr(date_literal(m[1], m[2].lower()))

    text = re.sub(r"'([^']*)'(dt|d|t)(?!\w)", date, text, flags=re.IGNORECASE)
    text = re.sub(r"\"((?:[^\"])*)\"", lambda m: f"`{m[1]}`", text)

    def words(s: str) -> str:
        s = re.sub(r"\bexclude\s*\(", "EXCEPT (", s, flags=re.IGNORECASE)
        s = re.sub(r"\bquantile_cont\s*\(", "percentile(", s, flags=re.IGNORECASE)
        s = re.sub(r"\bcalculated\s+", "", s, flags=re.IGNORECASE)
        s = re.sub(r"\b(\w+)\(([^()]*)\)\s*filter\s*\(\s*where\s+([^()]*)\)(?=\s*over\b)", lambda m: f"{m[1]}(CASE WHEN {m[3]} THEN {'1' if m[2].strip() == '*' else m[2]} END)", s, flags=re.IGNORECASE)
        s = re.sub(r"\bwork\.(\w+)", r"\1", s, flags=re.IGNORECASE)
        s = re.sub(r"([\w.)]+)\s*//\s*([\w.(]+)", r"floor(\1 / \2)", s)
        for n in known:
            if "." in n:
                s = re.sub(rf"\b{re.escape(n)}\b", n.replace(".", "__"), s, flags=re.IGNORECASE)
        return s

    text = outside_quotes(_strftime(text), words)
    return _nulls_last(_qualify(_asof(session, text)))


def run_sql(session, text: str) -> None:
    """Each statement in turn; what CREATE, INSERT, UPDATE, DELETE and DROP do stays."""
    for statement in statements(text):
        low = re.sub(r"\s+", " ", statement.lower())
        names = list(session.tables)
        for lib, library in session.libraries.items():
            names += [f"{lib}.{t}" for t in library.names() if f"{lib}.{t}" in low or f"{lib}.{t}" in names]
        for n in dict.fromkeys(names):
            if re.search(rf"\b{re.escape(n)}\b", low):
                session.dataset(n).visible().createOrReplaceTempView(n.replace(".", "__"))
        found = re.match(r"create (?:or replace )?(table|view) ([\w.]+) as ", low)
        if found:
            body = statement[re.search(r"\bas\b", statement, re.IGNORECASE).end() :]
            session.put(_name(found[2]), result(session, body, names))
            continue
        found = re.match(r"insert into ([\w.]+) ?(\([\w, ]+\))? ?(select|values|with)", low)
        if found:
            from rowloom.operators.tables import append
            from rowloom.plans.sources import with_options

            base = session.dataset(_name(found[1]))
            columns = [c.strip() for c in found[2].strip("()").split(",")] if found[2] else base.columns
            start = re.search(r"\b(select|values|with)\b", statement, re.IGNORECASE).start()
            new = result(session, statement[start:], names)
            session.put(_name(found[1]), append(base, new.with_df(new.df.withColumnsRenamed(dict(zip(new.columns, columns, strict=True))))))
            _ = with_options
            continue
        found = re.match(r"delete from ([\w.]+)(?: where (.*))?$", statement.strip(), re.IGNORECASE | re.DOTALL)
        if found:
            ds = session.dataset(_name(found[1]))
            test = translated(session, found[2], names) if found[2] else "true"
            session.put(_name(found[1]), ds.with_df(ds.df.where(f"not coalesce(({test}), false)")))
            continue
        found = re.match(r"update ([\w.]+) set (.*?)(?: where (.*))?$", statement.strip(), re.IGNORECASE | re.DOTALL)
        if found:
            from pyspark.sql import functions as F

            ds = session.dataset(_name(found[1]))
            test = F.coalesce(F.expr(translated(session, found[3], names)), F.lit(False)) if found[3] else F.lit(True)
            pairs = re.findall(r"(\w+)\s*=\s*((?:[^,(]|\([^)]*\))+)", found[2])
            session.put(_name(found[1]), ds.with_df(ds.df.withColumns({c.lower(): F.when(test, F.expr(translated(session, e, names))).otherwise(F.col(c)) for c, e in pairs})))
            continue
        found = re.match(r"drop (?:table|view) (?:if exists )?([\w., ]+)$", low)
        if found:
            for n in found[1].split(","):
                session.tables.pop(_name(n.strip()), None)
            continue
        found = re.search(r"\binto\s*:\s*(\w+)((?:\s*,\s*:\s*\w+)*)(?:\s+separated\s+by\s+(['\"])(.*?)\3)?", statement, re.IGNORECASE)
        if found:
            rows = query(session, statement[: found.start()] + statement[found.end() :], names).collect()
            targets = [found[1], *re.findall(r":\s*(\w+)", found[2])]
            for k, t in enumerate(targets):
                cells = ["" if r[k] is None else _digits(r[k]) if isinstance(r[k], float) else str(r[k]) for r in rows]
                session.macro.set(t, (found[4].join(cells) if found[3] else cells[0]) if cells else "", glob=True)
            continue
        session.show("Query", query(session, statement, names))


def _name(text: str) -> str:
    from rowloom.language.parser import dataset_name

    return dataset_name(text.split("."))


def _digits(x: float) -> str:
    """All digits of a number, for it may be a key that is looked up."""
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def query(session, text: str, names: list[str]) -> DataFrame:
    found = re.match(r"(.*?)\bouter\s+union\s+corr(?:responding)?\b(.*)$", text, re.IGNORECASE | re.DOTALL) or re.match(r"(.*?)\bunion\s+all\s+by\s+name\b(.*)$", text, re.IGNORECASE | re.DOTALL)
    if found:
        return query(session, found[1], names).unionByName(query(session, found[2], names), allowMissingColumns=True)
    conf = session.spark.conf
    before = conf.get("spark.sql.ansi.enabled")
    # what a division or cast cannot give is missing; an expression keeps the mode that it was analysed in
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        return session.spark.sql(translated(session, text, names))
    finally:
        conf.set("spark.sql.ansi.enabled", before)


def result(session, text: str, names: list[str]) -> Dataset:
    return from_frame(query(session, text, names))
