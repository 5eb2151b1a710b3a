"""Expressions to columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from rowloom.functions import formats
from rowloom.functions.library import FUNCTIONS, put
from rowloom.functions.values import Val, arithmetic, as_num, char, choose, compare, keeps, missing, num, text, truth


class Unsupported(ValueError):
    """An expression or statement that a tier cannot express."""


class Lowering:
    """lookup gives a variable's value; hooks take calls by name before the library does."""

    def __init__(self, lookup: Callable[[str], Val], formats_: dict | None = None, hooks: dict[str, Callable] | None = None, array: Callable | None = None, flag: Callable | None = None):
        self.lookup, self.formats, self.hooks, self.array, self.flag = lookup, formats_ or {}, hooks or {}, array, flag

    def value(self, e: tuple) -> Val:
        return getattr(self, f"_{e[0]}")(*e[1:])

    def test(self, e: tuple):
        return truth(self.value(e))

    def filter(self, e: tuple):
        """The condition for a filter: as test, but it may be null where it does not hold."""
        return keeps(self.value(e))

    def _num(self, v: float | None) -> Val:
        return num(v)

    def _str(self, v: str) -> Val:
        return char(v)

    def _fmt(self, v: str) -> Val:
        return char(v)

    def _var(self, name: str) -> Val:
        return self.lookup(name)

    def _un(self, op: str, x: tuple) -> Val:
        v = self.value(x)
        if op == "not":
            return Val(~truth(v), "bool")
        if v.known and isinstance(v.lit, float):
            return num(-v.lit)
        return Val(-as_num(v).col, "num")

    def _bin(self, op: str, a: tuple, b: tuple) -> Val:
        x, y = self.value(a), self.value(b)
        if op == "and":
            return Val(truth(x) & truth(y), "bool", loose=keeps(x) & keeps(y))
        if op == "or":
            return Val(truth(x) | truth(y), "bool", loose=keeps(x) | keeps(y))
        if op == "||":
            return Val(F.concat(text(x), text(y)), "char")
        if op == "contains":
            return Val(text(x).contains(text(y)), "bool")
        if op == "like":
            return Val(F.lower(text(x)).like(str(y.lit).lower()), "bool")
        if op in ("+", "-", "*", "/", "**"):
            return arithmetic(op, x, y)
        return compare(op, x, y)

    def _in(self, x: tuple, items: list[tuple], negated: bool) -> Val:
        v = self.value(x)
        values = [self.value(i) for i in items]
        loose = None
        if all(i.known for i in values) and v.kind == "char":
            out = F.rtrim(text(v)).isin([str(i.lit).rstrip() for i in values])
        elif all(i.known and i.lit is not None and i.kind == "num" for i in values) and v.kind == "num":
            loose = v.col.isin([i.lit for i in values])
            out = F.coalesce(loose, F.lit(False))
        else:
            out = F.lit(False)
            for i in values:
                out = out | compare("=", v, i).col
        return Val(~out if negated else out, "bool", loose=None if negated else loose)

    def _between(self, x: tuple, low: tuple, high: tuple) -> Val:
        v = self.value(x)
        a, b = compare(">=", v, self.value(low)), compare("<=", v, self.value(high))
        return Val(a.col & b.col, "bool", loose=keeps(a) & keeps(b))

    def _missing(self, x: tuple, negated: bool) -> Val:
        out = missing(self.value(x))
        return Val(~out if negated else out, "bool")

    def _flag(self, which: str, name: str) -> Val:
        if self.flag is None:
            raise Unsupported("first. and last. need a BY statement")
        return self.flag(which, name)

    def _at(self, name: str, subs: list[tuple]) -> Val:
        if self.array is None:
            raise Unsupported(f"no array {name}")
        return self.array(name, subs)

    def _method(self, *parts) -> Val:
        raise Unsupported("hash methods")

    def _call(self, name: str, args: list[tuple]) -> Val:
        if name in self.hooks:
            return self.hooks[name](args)
        if name in ("put", "putn", "putc"):
            fmt = args[1][1] if args[1][0] in ("fmt", "str", "var") else str(args[1][1])
            if args[1][0] == "num":
                fmt = f"{args[1][1]:g}." if float(args[1][1]).is_integer() else str(args[1][1])
            return put(self.value(args[0]), fmt, self.formats)
        if name in ("input", "inputn", "inputc"):
            fmt = args[1][1] if args[1][0] != "num" else f"{args[1][1]:g}."
            return formats.informat(self.value(args[0]), str(fmt))
        if name not in FUNCTIONS:
            if self.array is not None:
                return self.array(name, args)
            raise Unsupported(f"no function {name}")
        values: list[Val] = []
        for a in args:
            values += [self.lookup(n) for n in a[1]] if a[0] == "of" else [self.value(a)]
        return FUNCTIONS[name](*values)


__all__ = ["Lowering", "Unsupported", "choose"]
