"""The scalar function library, each function as a composition of built-in column functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions import formats
from rowloom.functions.formats import day, days_of
from rowloom.functions.values import Val, as_char, as_num, missing, text, truth

FUNCTIONS: dict[str, Callable[..., Val]] = {}
WORD_ENDS = " ,;.-/"


def register(*names: str):
    def add(f):
        for n in names:
            FUNCTIONS[n] = f
        return f

    return add


def _none() -> Column:
    return F.lit(None).cast("double")


def _n(v: Val) -> Column:
    return as_num(v).col


def _c(c: Column) -> Val:
    return Val(c, "char")


def _d(c: Column) -> Val:
    return Val(c.cast("double"), "num")


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in chars) + "]"


def _literal(v: Val, what: str) -> str:
    if not v.known:
        raise ValueError(f"{what} must be a literal")
    return str(v.lit)


for _name, _f in {"upcase": F.upper, "lowcase": F.lower, "reverse": F.reverse}.items():
    FUNCTIONS[_name] = lambda s, f=_f: _c(f(text(s)))
FUNCTIONS["trim"] = lambda s: _c(F.regexp_replace(text(s), r"\s+$", ""))
FUNCTIONS["strip"] = lambda s: _c(F.regexp_replace(text(s), r"^\s+|\s+$", ""))
FUNCTIONS["left"] = lambda s: _c(F.regexp_replace(text(s), r"^\s+", ""))
FUNCTIONS["compbl"] = lambda s: _c(F.regexp_replace(text(s), " {2,}", " "))
FUNCTIONS["index"] = lambda s, w: _d(F.position(text(w), text(s)))
FUNCTIONS["tranwrd"] = lambda s, a, b: _c(F.replace(text(s), text(a), text(b)))
FUNCTIONS["quote"] = lambda s: _c(F.concat(F.lit('"'), F.replace(text(s), F.lit('"'), F.lit('""')), F.lit('"')))
FUNCTIONS["repeat"] = lambda s, n: _c(F.repeat(text(s), (F.greatest(_n(n), F.lit(0.0)) + 1).cast("int")))


@register("propcase")
def _propcase(s: Val) -> Val:
    """A capital after every non-letter."""
    words = F.regexp_extract_all(F.lower(text(s)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return _c(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.char_length(w)))), ""))


@register("substr")
def _substr(s: Val, p: Val, n: Val | None = None) -> Val:
    start = F.greatest(_n(p), F.lit(1.0)).cast("int")
    t = text(s)
    return _c(F.coalesce(t.substr(start, F.char_length(t) if n is None else F.greatest(_n(n), F.lit(0.0)).cast("int")), F.lit("")))


@register("compress")
def _compress(s: Val, chars: Val | None = None, mods: Val | None = None) -> Val:
    if chars is None:
        return _c(F.regexp_replace(text(s), r"\s+", ""))
    own = _literal(chars, "compress() characters")
    m = (_literal(mods, "compress() modifiers") if mods else "").lower()
    inside = "".join("\\" + c if not c.isalnum() else c for c in own) + ("a-zA-Z" if "a" in m else "") + ("0-9" if "d" in m else "") + (r"\s" if "s" in m else "")
    if not inside:
        return _c(F.regexp_replace(text(s), r"\s+", ""))
    return _c(F.regexp_replace(text(s), f"[^{inside}]" if "k" in m else f"[{inside}]", ""))


@register("length", "lengthn")
def _length(s: Val) -> Val:
    return _d(F.when(missing(s) if s.kind == "char" else F.lit(False), 0).otherwise(F.char_length(text(s))))


@register("indexc")
def _indexc(s: Val, *chars: Val) -> Val:
    return _d(F.regexp_instr(text(s), F.lit(_class("".join(_literal(c, "indexc() characters") for c in chars)))))


@register("findc")
def _findc(s: Val, chars: Val, mods: Val | None = None, start: Val | None = None) -> Val:
    if mods is not None and mods.kind == "num":
        mods, start = None, mods
    pattern = _class(_literal(chars, "findc() characters"))
    if mods is not None and "i" in str(mods.lit).lower():
        pattern = "(?i)" + pattern
    t = text(s)
    if start is None:
        return _d(F.regexp_instr(t, F.lit(pattern)))
    at = int(start.lit)
    if at > 0:
        found = F.regexp_instr(t.substr(F.lit(at), F.char_length(t)), F.lit(pattern))
        return _d(F.when(found > 0, found + at - 1).otherwise(0))
    head = F.reverse(t.substr(F.lit(1), F.lit(-at)))
    found = F.regexp_instr(head, F.lit(pattern))
    return _d(F.when(found > 0, -(F.char_length(head) - found + 1)).otherwise(0))


@register("findw")
def _findw(s: Val, w: Val, delims: Val | None = None, mods: Val | None = None) -> Val:
    ends = _class(_literal(delims, "findw() delimiters") if delims is not None else WORD_ENDS)
    flag = "(?i)" if mods is not None and "i" in str(mods.lit).lower() else ""
    return _d(F.regexp_instr(text(s), F.lit(f"{flag}(?<![^{ends[1:-1]}]){re.escape(_literal(w, 'findw() word'))}(?![^{ends[1:-1]}])")))


def _words(s: Val, delims: Val | None) -> Column:
    ends = _class(_literal(delims, "delimiters") if delims is not None else WORD_ENDS)
    return F.filter(F.split(text(s), f"{ends}+"), lambda x: x != "")


@register("scan")
def _scan(s: Val, n: Val, delims: Val | None = None) -> Val:
    k = _n(n).cast("int")
    return _c(F.when(k == 0, F.lit("")).otherwise(F.coalesce(F.try_element_at(_words(s, delims), F.nullif(k, F.lit(0))), F.lit(""))))


@register("countw")
def _countw(s: Val, delims: Val | None = None) -> Val:
    return _d(F.size(_words(s, delims)))


@register("cat")
def _cat(*args: Val) -> Val:
    return _c(F.concat(*map(text, args)))


@register("cats")
def _cats(*args: Val) -> Val:
    return _c(F.concat(*(F.when(missing(a), F.lit("")).otherwise(F.trim(text(a))) for a in args)))


@register("catx")
def _catx(sep: Val, *args: Val) -> Val:
    return _c(F.concat_ws(_literal(sep, "catx() separator"), *(F.when(missing(a), None).otherwise(text(a)) for a in args)))


@register("translate")
def _translate(s: Val, to: Val, frm: Val) -> Val:
    return _c(F.translate(text(s), _literal(frm, "translate() characters"), _literal(to, "translate() characters")))


@register("verify")
def _verify(s: Val, chars: Val) -> Val:
    own = _class(_literal(chars, "verify() characters"))
    return _d(F.regexp_instr(text(s), F.lit("[^" + own[1:])))


@register("dequote")
def _dequote(s: Val) -> Val:
    t = F.trim(text(s))
    inner = F.replace(t.substr(F.lit(2), F.char_length(t) - 2), F.lit('""'), F.lit('"'))
    single = t.substr(F.lit(2), F.char_length(t) - 2)
    return _c(F.when(t.rlike(r'^".*"$') & (F.char_length(t) > 1), inner).when(t.rlike(r"^'.*'$") & (F.char_length(t) > 1), single).otherwise(text(s)))


@register("prxmatch")
def _prxmatch(pattern: Val, s: Val) -> Val:
    found = re.fullmatch(r"/(.*)/(i?)\w*", _literal(pattern, "prxmatch() pattern"), re.DOTALL)
    body = (("(?i)" if found[2] else "") + found[1]) if found else _literal(pattern, "prxmatch() pattern")
    return _d(F.regexp_instr(text(s), F.lit(body)))


@register("round")
def _round(x: Val, unit: Val | None = None) -> Val:
    u = F.lit(1.0) if unit is None else _n(unit)
    ratio = _n(x) / F.nullif(u, F.lit(0.0))
    # half away from zero; the small addition undoes what division loses
    up = F.floor(F.abs(ratio) + 0.5 + 1e-9) * u
    return _d(F.signum(_n(x)) * F.abs(up))


FUNCTIONS["int"] = lambda x: _d(F.when(_n(x) < 0, F.ceil(_n(x))).otherwise(F.floor(_n(x))))
FUNCTIONS["floor"] = lambda x: _d(F.floor(_n(x)))
FUNCTIONS["ceil"] = lambda x: _d(F.ceil(_n(x)))
FUNCTIONS["mod"] = lambda x, y: _d(F.try_mod(_n(x), _n(y)))
FUNCTIONS["abs"] = lambda x: _d(F.abs(_n(x)))
FUNCTIONS["sign"] = lambda x: _d(F.signum(_n(x)))
FUNCTIONS["exp"] = lambda x: _d(F.when(_n(x) < 709.78, F.exp(_n(x))))
FUNCTIONS["sqrt"] = lambda x: _d(F.when(_n(x) >= 0, F.sqrt(_n(x))))
FUNCTIONS["log"] = lambda x: _d(F.when(_n(x) > 0, F.log(_n(x))))
FUNCTIONS["log10"] = lambda x: _d(F.when(_n(x) > 0, F.log10(_n(x))))
FUNCTIONS["log2"] = lambda x: _d(F.when(_n(x) > 0, F.log2(_n(x))))
for _name, _f in {"sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan}.items():
    FUNCTIONS[_name] = lambda x, f=_f: _d(f(_n(x)))


@register("n")
def _count(*args: Val) -> Val:
    there = [_n(a).isNotNull().cast("int") for a in args]
    total = there[0]
    for t in there[1:]:
        total = total + t
    return _d(total)


@register("nmiss")
def _nmiss(*args: Val) -> Val:
    return _d(F.lit(len(args)) - _count(*args).col)


@register("sum")
def _sum(*args: Val) -> Val:
    columns = [_n(a) for a in args]
    total = F.coalesce(columns[0], F.lit(0.0))
    for c in columns[1:]:
        total = total + F.coalesce(c, F.lit(0.0))
    return _d(F.when(F.coalesce(*columns).isNotNull(), total))


@register("mean")
def _mean(*args: Val) -> Val:
    return _d(F.try_divide(_sum(*args).col, _count(*args).col))


@register("min")
def _min(*args: Val) -> Val:
    return _d(F.least(*map(_n, args)) if len(args) > 1 else _n(args[0]))


@register("max")
def _max(*args: Val) -> Val:
    return _d(F.greatest(*map(_n, args)) if len(args) > 1 else _n(args[0]))


@register("var")
def _var(*args: Val) -> Val:
    """Around the first value that is there, so that large values do not cancel; the expression stays small."""
    columns = [_n(a) for a in args]
    first, n = F.coalesce(*columns), _count(*args).col
    away = [F.coalesce(c - first, F.lit(0.0)) for c in columns]
    total, squares = away[0], away[0] * away[0]
    for x in away[1:]:
        total, squares = total + x, squares + x * x
    return _d(F.when(n > 1, F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))


FUNCTIONS["std"] = lambda *args: _d(F.sqrt(_var(*args).col))
FUNCTIONS["range"] = lambda *args: _d(_max(*args).col - _min(*args).col)


@register("missing")
def _missing(x: Val) -> Val:
    return _d(F.when(missing(x), 1.0).otherwise(0.0))


def _if(test: Val, a: Val, b: Val, none: Val | None) -> Column:
    out = F.when(truth(test), a.col).otherwise(b.col)
    return out if none is None else F.when(missing(test), none.col).otherwise(out)


FUNCTIONS["ifn"] = lambda t, a, b, m=None: _d(_if(t, as_num(a), as_num(b), None if m is None else as_num(m)))
FUNCTIONS["ifc"] = lambda t, a, b, m=None: _c(_if(t, as_char(a), as_char(b), None if m is None else as_char(m)))
FUNCTIONS["coalesce"] = lambda *args: _d(F.coalesce(*map(_n, args)))
FUNCTIONS["coalescec"] = lambda *args: _c(F.coalesce(*(F.when(~missing(a), text(a)) for a in args), F.lit("")))

FUNCTIONS["today"] = lambda: _d(F.datediff(F.current_date(), F.lit("1960-01-01").cast("date")))
FUNCTIONS["date"] = FUNCTIONS["today"]
FUNCTIONS["datetime"] = lambda: _d(F.unix_micros(F.current_timestamp()) / 1e6 + 315619200)
FUNCTIONS["time"] = lambda: _d(F.pmod(F.unix_micros(F.current_timestamp()) / 1e6, F.lit(86400.0)))
FUNCTIONS["mdy"] = lambda m, d, y: _d(days_of(_n(y), _n(m), _n(d)))
FUNCTIONS["sas_date"] = lambda y, m, d: _d(days_of(_n(y), _n(m), _n(d)))
FUNCTIONS["hms"] = lambda h, m, s: _d(_n(h) * 3600 + _n(m) * 60 + _n(s))
FUNCTIONS["sas_time"] = FUNCTIONS["hms"]
FUNCTIONS["dhms"] = lambda d, h, m, s: _d(_n(d) * 86400 + _n(h) * 3600 + _n(m) * 60 + _n(s))
FUNCTIONS["sas_datetime"] = lambda y, mo, d, h, mi, s: _d(days_of(_n(y), _n(mo), _n(d)) * 86400 + _n(h) * 3600 + _n(mi) * 60 + _n(s))
FUNCTIONS["datepart"] = lambda x: _d(F.floor(_n(x) / 86400))
FUNCTIONS["timepart"] = lambda x: _d(F.pmod(_n(x), F.lit(86400.0)))
FUNCTIONS["year"] = lambda x: _d(F.year(day(_n(x))))
FUNCTIONS["month"] = lambda x: _d(F.month(day(_n(x))))
FUNCTIONS["day"] = lambda x: _d(F.dayofmonth(day(_n(x))))
FUNCTIONS["qtr"] = lambda x: _d(F.quarter(day(_n(x))))
FUNCTIONS["weekday"] = lambda x: _d(F.dayofweek(day(_n(x))))
FUNCTIONS["hour"] = lambda x: _d(F.floor(F.pmod(_n(x), F.lit(86400.0)) / 3600))
FUNCTIONS["minute"] = lambda x: _d(F.floor(F.pmod(_n(x), F.lit(3600.0)) / 60))
FUNCTIONS["second"] = lambda x: _d(F.pmod(_n(x), F.lit(60.0)))

#: Months in a unit.
UNITS = {"month": 1, "qtr": 3, "quarter": 3, "semiyear": 6, "year": 12}


@register("intck")
def _intck(unit: Val, a: Val, b: Val) -> Val:
    u = _literal(unit, "intck() unit").lower()
    x, y = F.floor(_n(a)), F.floor(_n(b))
    if u == "day":
        return _d(y - x)
    if u == "week":
        return _d(F.floor((y - x) / 7))
    if u not in UNITS:
        return _d(_none())
    months = lambda v: F.year(day(v)) * 12 + F.month(day(v)) - 1
    return _d(F.floor(months(y) / UNITS[u]) - F.floor(months(x) / UNITS[u]))


@register("intnx")
def _intnx(unit: Val, a: Val, n: Val, align: Val | None = None) -> Val:
    u = _literal(unit, "intnx() unit").lower()
    how = (_literal(align, "intnx() alignment") if align is not None else "b").lower()[:1]
    x, k = F.floor(_n(a)), _n(n)
    if u == "day":
        return _d(x + k)
    if u == "week":
        return _d(x + 7 * k)
    if u not in UNITS:
        return _d(_none())
    per = UNITS[u]
    since = lambda d: F.datediff(d, F.lit("1960-01-01").cast("date")).cast("double")
    start = lambda shift: F.add_months(F.trunc(day(x), "MM"), (F.lit(shift) * per + k * per - F.pmod(F.month(day(x)) - 1, F.lit(per))).cast("int"))
    first = since(start(0))
    if how == "e":
        return _d(since(start(1)) - 1)
    if how == "m":
        return _d(F.floor((first + since(start(1)) - 1) / 2))
    if how == "s":
        return _d(since(F.add_months(day(x), (k * per).cast("int"))))
    return _d(first)


def put(x: Val, fmt: str, users: dict) -> Val:
    return _c(formats.apply_format(x, fmt, users))
