"""Typed columns and the rules of missing values.

Numbers are nullable doubles, null being missing. Character values are strings, blank being missing; null strings count as
blank. Missing is the least value and equals itself. Conditions are never null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Val:
    col: Column
    kind: str  # num, char, bool
    lit: object = None
    known: bool = False  # whether lit is the value
    loose: Column | None = None  # for a condition, one that may be null where it does not hold


def num(value: float | None) -> Val:
    return Val(F.lit(None if value is None else float(value)).cast("double"), "num", value, True)


def char(value: str) -> Val:
    return Val(F.lit(value), "char", value, True)


def as_num(v: Val) -> Val:
    if v.kind == "num":
        return v
    if v.kind == "bool":
        return Val(F.when(v.col, F.lit(1.0)).otherwise(F.lit(0.0)), "num")
    return Val(F.trim(v.col).try_cast("double"), "num")


def as_char(v: Val) -> Val:
    if v.kind == "char":
        return v
    return Val(number_text(as_num(v).col), "char")


def number_text(x: Column) -> Column:
    """A number as text: whole numbers without a point, missing as a period."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), F.lit(".")).when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def text(v: Val) -> Column:
    """A character value that is never null."""
    c = as_char(v).col
    return c if v.known else F.coalesce(c, F.lit(""))


def truth(v: Val) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind == "char":
        return F.trim(text(v)) != ""
    return F.coalesce(v.col, F.lit(0.0)) != 0


def keeps(v: Val) -> Column:
    """A condition for a filter, which drops a row where it is null; written so that Spark can push it to the scan."""
    return v.loose if v.loose is not None else truth(v)


def missing(v: Val) -> Column:
    if v.kind == "char":
        return F.trim(text(v)) == ""
    return as_num(v).col.isNull()


def compare(op: str, a: Val, b: Val) -> Val:
    if a.kind == "char" and b.kind == "char":
        x, y = F.rtrim(text(a)), F.rtrim(text(b))
        if op == "=:":
            return Val(x.startswith(y) | y.startswith(x), "bool")
        return Val({"=": x == y, "^=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
    a, b = as_num(a), as_num(b)
    x, y = a.col, b.col
    if op in (">", ">="):
        return compare({">": "<", ">=": "<="}[op], b, a)
    if op in ("=", "^="):
        same = x.eqNullSafe(y)
        one = next((v for v in (a, b) if v.known and v.lit is not None), None)
        return Val(same if op == "=" else ~same, "bool", loose=(x == y) if op == "=" and one is not None else None)
    # written so that a comparison with a literal can be pushed to the scan
    if b.known and b.lit is not None:
        return Val(x.isNull() | (x < y if op == "<" else x <= y), "bool")
    if a.known and a.lit is not None:
        plain = x < y if op == "<" else x <= y
        if a.known:
            plain = y > F.lit(a.lit) if op == "<" else y >= F.lit(a.lit)
        return Val(F.coalesce(plain, F.lit(False)), "bool", loose=plain)
    if op == "<":
        return Val(y.isNotNull() & (x.isNull() | (x < y)), "bool")
    return Val(x.isNull() | (y.isNotNull() & (x <= y)), "bool")


def arithmetic(op: str, a: Val, b: Val) -> Val:
    x, y = as_num(a).col, as_num(b).col
    if op == "/":
        out = F.try_divide(x, y)
    elif op == "**":
        raised = F.pow(x, y)
        out = F.when(F.isnan(raised) | (F.abs(raised) == float("inf")), F.lit(None).cast("double")).otherwise(raised)
    else:
        out = {"+": x + y, "-": x - y, "*": x * y}[op]
    return Val(out, "num")


def choose(test: Column, a: Val, b: Val) -> Val:
    """a where test holds, else b; the kinds are made alike."""
    if a.kind != b.kind:
        a, b = (as_char(a), as_char(b)) if "char" in (a.kind, b.kind) else (as_num(a), as_num(b))
    return Val(F.when(test, a.col).otherwise(b.col), a.kind)


def to_value(column: Column, kind: str, nan: bool = True) -> Val:
    """A source column of a Spark type as a number or character value; nan: whether NaN may occur, which then is missing."""
    if kind in ("string",) or kind.startswith(("char", "varchar")):
        return Val(column, "char")
    if kind == "boolean":
        return Val(F.when(column, 1.0).when(~column, 0.0), "num")
    if kind == "date":
        return Val(F.datediff(column, F.lit("1960-01-01").cast("date")).cast("double"), "num")
    if kind.startswith("timestamp"):
        return Val(F.unix_micros(column.cast("timestamp")).cast("double") / 1e6 + 315619200.0, "num")
    if kind in ("double", "float"):
        return Val(F.nanvl(column.cast("double"), F.lit(None).cast("double")) if nan else column.cast("double"), "num")
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return Val(column.cast("double"), "num")
    return Val(column, "other")
