"""Formats as columns, for display and PUT()."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.values import Val, as_num, compare, number_text, text


@dataclass
class UserFormat:
    """Ranges (low, high, low open, high open, label) or values to labels; None stands for an open end."""

    char: bool
    ranges: list[tuple] = field(default_factory=list)
    other: str | None = None


def split_format(name: str) -> tuple[str, int | None, int | None]:
    found = re.fullmatch(r"(\$?[A-Za-z_]*[A-Za-z_]|\$)?(\d+)?\.?(\d+)?", name.strip())
    if not found:
        return name.strip(". ").lower(), None, None
    return (found[1] or "").lower(), int(found[2]) if found[2] else None, int(found[3]) if found[3] else None


def day(x: Column) -> Column:
    return F.date_add(F.lit("1960-01-01").cast("date"), F.floor(x).cast("int"))


def clock(x: Column) -> Column:
    """Seconds as h:mm:ss."""
    s = F.floor(F.abs(x)).cast("bigint")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def fixed(x: Column, decimals: int) -> Column:
    """x with so many decimals and no grouping."""
    return F.regexp_replace(F.format_number(x, decimals), ",", "")


def apply_format(v: Val, name: str, users: dict[str, UserFormat] | None = None) -> Column:
    base, width, decimals = split_format(name)
    users = users or {}
    if base in users or f"${base}" in users and v.kind == "char":
        return apply_user(v, users.get(base) or users[f"${base}"])
    if base.startswith("$"):
        return F.substring(text(v), 1, width) if width else text(v)
    if v.kind == "char" and base in ("", "char"):
        return F.substring(text(v), 1, width) if width else text(v)
    x = as_num(v).col
    d = decimals or 0
    size = width or 9
    if base == "comma":
        out = F.format_number(x, d)
    elif base == "commax":
        out = F.translate(F.format_number(x, d), ",.", ".,")
    elif base == "dollar":
        out = F.concat(F.when(x < 0, "-$").otherwise("$"), F.format_number(F.abs(x), d))
    elif base == "percent":
        out = F.concat(fixed(x * 100, d), F.lit("%"))
    elif base == "z":
        out = F.concat(F.when(x < 0, "-").otherwise(""), F.lpad(fixed(F.abs(x), d), (width or 1), "0")) if width else fixed(x, d)
        out = F.when(x < 0, F.concat(F.lit("-"), F.lpad(fixed(F.abs(x), d), max(1, (width or 1) - 1), "0"))).otherwise(F.lpad(fixed(x, d), width or 1, "0"))
    elif base in ("best", ""):
        out = number_text(x) if base == "best" or width is None else fixed(x, d)
    elif base == "f":
        out = fixed(x, d)
    elif base == "date":
        out = F.upper(F.date_format(day(x), "ddMMMyy" if size == 7 else "ddMMMyyyy"))
    elif base in ("mmddyy", "ddmmyy", "yymmdd"):
        year = "yyyy" if size >= 10 else "yy"
        out = F.date_format(day(x), {"mmddyy": f"MM/dd/{year}", "ddmmyy": f"dd/MM/{year}", "yymmdd": f"{year}-MM-dd"}[base])
    elif base == "worddate":
        out = F.date_format(day(x), "MMMM d, yyyy")
    elif base == "monyy":
        out = F.upper(F.date_format(day(x), "MMMyy" if size == 5 else "MMMyyyy"))
    elif base == "year":
        out = F.date_format(day(x), "yyyy")
    elif base == "time":
        out = clock(x)
    elif base == "datetime":
        out = F.concat(F.upper(F.date_format(day(F.floor(x / 86400)), "ddMMMyyyy")), F.lit(":"), F.lpad(clock(F.pmod(x, F.lit(86400.0))), 8, "0"))
    else:
        out = number_text(x)
    return F.when(x.isNull(), F.lit(".")).otherwise(out)


def apply_user(v: Val, user: UserFormat) -> Column:
    plain = text(v) if user.char else number_text(as_num(v).col)
    other = F.lit(user.other) if user.other is not None else plain
    out = None
    value = Val(text(v), "char") if user.char else as_num(v)
    for low, high, low_open, high_open, label in user.ranges:
        if user.char:
            test = F.rtrim(value.col) == (low or "")
        else:
            test = value.col.isNotNull()
            if low is not None:
                test = test & ((value.col > low) if low_open else (value.col >= low))
            if high is not None:
                test = test & ((value.col < high) if high_open else (value.col <= high))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return other if out is None else out.otherwise(other)


def informat(v: Val, name: str) -> Val:
    """INPUT(): text to a value."""
    base, width, decimals = split_format(name)
    s = F.trim(text(v))
    if base.startswith("$"):
        return Val(s, "char")
    if base in ("date", "mmddyy", "ddmmyy", "yymmdd", "anydtdte"):
        return Val(parse_day(s, base), "num")
    if base == "time":
        parts = F.split(s, ":")
        total = F.get(parts, F.lit(0)).try_cast("double") * 3600 + F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)) * 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0))
        return Val(total, "num")
    if base in ("comma", "dollar", "percent", "commax"):
        plain = F.regexp_replace(s, r"[$,%\s]", "") if base != "commax" else F.translate(F.regexp_replace(s, r"[$.%\s]", ""), ",", ".")
        out = plain.try_cast("double")
        return Val(out / 100 if base == "percent" else out, "num")
    out = s.try_cast("double")
    if decimals:
        out = F.when(s.contains("."), out).otherwise(out / 10**decimals)
    return Val(F.nanvl(out, F.lit(None).cast("double")), "num")


def parse_day(s: Column, base: str) -> Column:
    """Days of a date text; two-digit years are 1926 to 2025."""
    if base in ("date", "anydtdte"):
        found = lambda k: F.regexp_extract(s, r"^(\d{1,2})[- ]?([A-Za-z]{3})[- ]?(\d{2,4})", k)
        d, y = found(1), found(3)
        months = F.array(*(F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")))
        m = F.array_position(months, F.lower(found(2))).cast("string")
    else:
        order = {"mmddyy": "mdy", "ddmmyy": "dmy", "yymmdd": "ymd"}[base]
        wide = r"^(\d{4}|\d{2})[-/. ]?(\d{1,2})[-/. ]?(\d{1,2})$" if order == "ymd" else r"^(\d{1,2})[-/. ]?(\d{1,2})[-/. ]?(\d{4}|\d{2})$"
        got = {c: F.regexp_extract(s, wide, k + 1) for k, c in enumerate(order)}
        d, m, y = got["d"], got["m"], got["y"]
    year = y.try_cast("int")
    year = F.when(year > 99, year).when(year < 26, year + 2000).otherwise(year + 1900)
    return days_of(year, m.try_cast("int"), d.try_cast("int"))


def days_of(year: Column, month: Column, dom: Column) -> Column:
    """Days since 1960-01-01; null where there is no such date."""
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), dom.cast("int")), "yyyy-MM-dd")
    return F.when(year.isNull() | month.isNull() | dom.isNull(), F.lit(None).cast("double")).otherwise(F.datediff(made, F.lit("1960-01-01").cast("date")).cast("double"))


__all__ = ["UserFormat", "apply_format", "apply_user", "compare", "day", "days_of", "informat", "split_format"]
