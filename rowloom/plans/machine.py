"""Data steps as ordered state machines (tier 3): what has no column form.

The step is compiled once into Python closures over a dict of variables and run over rows in order, in Arrow batches: BY
groups apart where all state is reset at FIRST., else one ordered stream, which is what the program asks for.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.language.ast import DataStep, Stmt
from rowloom.plans import sources
from rowloom.plans.dataset import Dataset, numbered
from rowloom.plans.datastep import Array, ColumnStep, Context, arrays_of, expressions, place, walk

EPOCH = dt.date(1960, 1, 1)
#: Rows of a lookup that may be sent to the machine.
LOOKUP_ROWS = 1_000_000


class _Delete(Exception):
    pass


class _Return(Exception):
    pass


class _Stop(Exception):
    pass


class _Leave(Exception):
    pass


class _Continue(Exception):
    pass


def blank(v) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v)) or (isinstance(v, str) and not v.strip())


def number(v) -> float | None:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, str):
        try:
            return float(v)
        except ValueError:
            return None
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)


def string(v) -> str:
    if isinstance(v, str):
        return v
    v = number(v)
    if v is None:
        return "."
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def truthy(v) -> bool:
    return bool(v.strip()) if isinstance(v, str) else bool(number(v) or 0)


def order(a, b) -> int:
    if isinstance(a, str) and isinstance(b, str):
        a, b = a.rstrip(), b.rstrip()
    else:
        a, b = number(a), number(b)
        a, b = (-math.inf if a is None else a), (-math.inf if b is None else b)
    return (a > b) - (a < b)


def _date(x) -> dt.date:
    return EPOCH + dt.timedelta(days=math.floor(x))


def _days(y, m, d) -> float | None:
    try:
        return float((dt.date(int(y), int(m), int(d)) - EPOCH).days)
    except (TypeError, ValueError):
        return None


def _words(s: str, ends: str = " ,;.-/") -> list[str]:
    return [w for w in re.split("[" + re.escape(ends) + "]+", s) if w]


def _guarded(f: Callable) -> Callable:
    """Missing in, missing out; so are domain errors."""

    def g(*args):
        values = [number(a) for a in args]
        if any(v is None for v in values):
            return None
        try:
            return float(f(*values))
        except (ValueError, OverflowError, ZeroDivisionError):
            return None

    return g


def _present(args) -> list[float]:
    return [x for x in map(number, args) if x is not None]


def _std(args) -> float | None:
    x = _present(args)
    m = sum(x) / len(x) if x else 0
    return math.sqrt(sum((v - m) ** 2 for v in x) / (len(x) - 1)) if len(x) > 1 else None


def _scan(s, n, ends=" ,;.-/") -> str:
    w, n = _words(string(s), ends), int(number(n) or 0)
    return w[n - 1] if 0 < n <= len(w) else w[n] if n < 0 and -n <= len(w) else ""


PYTHON: dict[str, Callable] = {
    "upcase": lambda s: string(s).upper(),
    "lowcase": lambda s: string(s).lower(),
    "propcase": lambda s: string(s).title(),
    "trim": lambda s: string(s).rstrip(),
    "strip": lambda s: string(s).strip(),
    "left": lambda s: string(s).lstrip(),
    "reverse": lambda s: string(s)[::-1],
    "compress": lambda s, c=None: re.sub(r"\s+", "", string(s)) if c is None else "".join(x for x in string(s) if x not in c),
    "compbl": lambda s: re.sub(" {2,}", " ", string(s)),
    "substr": lambda s, p, n=None: string(s)[max(0, int(number(p) or 1) - 1) :][: None if n is None else int(number(n) or 0)],
    "length": lambda s: 0.0 if blank(s) else float(len(string(s))),
    "lengthn": lambda s: 0.0 if blank(s) else float(len(string(s))),
    "index": lambda s, w: float(string(s).find(string(w)) + 1),
    "scan": _scan,
    "countw": lambda s, e=" ,;.-/": float(len(_words(string(s), e))),
    "cat": lambda *a: "".join(map(string, a)),
    "cats": lambda *a: "".join(string(x).strip() for x in a if not blank(x)),
    "catx": lambda sep, *a: sep.join(string(x) for x in a if not blank(x)),
    "tranwrd": lambda s, a, b: string(s).replace(string(a), string(b)),
    "translate": lambda s, to, frm: string(s).translate({ord(f): (to[i] if i < len(to) else None) for i, f in enumerate(frm)}),
    "repeat": lambda s, n: string(s) * (int(number(n) or 0) + 1),
    "quote": lambda s: '"' + string(s).replace('"', '""') + '"',
    "round": _guarded(lambda x, u=1.0: math.copysign(math.floor(abs(x / u) + 0.5 + 1e-9) * abs(u), x)),
    "int": _guarded(math.trunc),
    "floor": _guarded(math.floor),
    "ceil": _guarded(math.ceil),
    "abs": _guarded(abs),
    "sqrt": _guarded(math.sqrt),
    "exp": _guarded(math.exp),
    "log": _guarded(math.log),
    "log10": _guarded(math.log10),
    "mod": _guarded(math.fmod),
    "sign": _guarded(lambda x: (x > 0) - (x < 0)),
    "sin": _guarded(math.sin),
    "cos": _guarded(math.cos),
    "sum": lambda *a: sum(_present(a)) if _present(a) else None,
    "mean": lambda *a: sum(_present(a)) / len(_present(a)) if _present(a) else None,
    "min": lambda *a: min(_present(a), default=None),
    "max": lambda *a: max(_present(a), default=None),
    "n": lambda *a: float(len(_present(a))),
    "nmiss": lambda *a: float(len(a) - len(_present(a))),
    "std": lambda *a: _std(a),
    "range": lambda *a: max(_present(a)) - min(_present(a)) if _present(a) else None,
    "missing": lambda x: float(blank(x)),
    "ifn": lambda t, a, b, m=None: number(m) if m is not None and blank(t) else number(a) if truthy(t) else number(b),
    "ifc": lambda t, a, b, m=None: string(m) if m is not None and blank(t) else string(a) if truthy(t) else string(b),
    "coalesce": lambda *a: next((number(x) for x in a if not blank(x)), None),
    "coalescec": lambda *a: next((string(x) for x in a if not blank(x)), ""),
    "input": lambda s, f="": string(s).strip() if str(f).startswith("$") else number(re.sub(r"[$,%]", "", string(s)) if re.match("comma|dollar", str(f), re.IGNORECASE) else s),
    "put": lambda x, f="": string(x),
    "mdy": lambda m, d, y: _days(number(y), number(m), number(d)),
    "today": lambda: float((dt.date.today() - EPOCH).days),
    "year": _guarded(lambda x: _date(x).year),
    "month": _guarded(lambda x: _date(x).month),
    "day": _guarded(lambda x: _date(x).day),
    "weekday": _guarded(lambda x: _date(x).isoweekday() % 7 + 1),
    "hms": _guarded(lambda h, m, s: h * 3600 + m * 60 + s),
    "dhms": _guarded(lambda d, h, m, s: d * 86400 + h * 3600 + m * 60 + s),
    "datepart": _guarded(lambda x: math.floor(x / 86400)),
    "timepart": _guarded(lambda x: x % 86400),
    "hour": _guarded(lambda x: x % 86400 // 3600),
    "minute": _guarded(lambda x: x % 3600 // 60),
    "second": _guarded(lambda x: x % 60),
}


class Table:
    """A hash object: rows by key, in the order in which they came; the first row of a key counts."""

    def __init__(self, keys: list[str], data: list[str], rows: list[dict], multi: bool, last: bool = False):
        self.keys, self.data, self.multi = keys, data or keys, multi
        self.rows: dict[tuple, list[dict]] = {}
        for r in rows:
            held = self.rows.setdefault(self.key([r.get(k) for k in keys]), [])
            if multi or not held:
                held.append(r)
            elif last:
                held[:] = [r]

    @staticmethod
    def key(values: list) -> tuple:
        return tuple(v.rstrip() if isinstance(v, str) else number(v) for v in values)

    def all(self) -> list[dict]:
        return [r for rows in self.rows.values() for r in rows]


class Machine:
    """The compiled step: closures over self.v, the variables."""

    def __init__(self, step: DataStep, kinds: dict[str, str], arrays: dict[str, Array], lookups: dict[str, list[dict]], by: list[str], default: list[str], functions: dict):
        self.kinds, self.arrays, self.lookups, self.by, self.default, self.functions = kinds, arrays, lookups, by, default, functions
        self.v: dict = {}
        self.tables: dict[str, Table] = {}
        self.walks: dict[str, tuple] = {}
        self.queues: dict[int, list] = {}
        self.cursors: dict[int, int] = {}
        self.out: list[tuple[str, dict]] = []
        self.path = "log"
        self.line = ""
        self.explicit = any(s.kind == "output" for s in walk(step.body))
        self.retained: dict[str, object] = {}
        for s in walk(step.body):
            if s.kind == "retain":
                self.retained |= {n: (v[1] if isinstance(v, tuple) and len(v) == 2 else self._negative(v)) for n, v in s["items"]}
            elif s.kind == "add" and s["target"][0] == "var":
                self.retained.setdefault(s["target"][1], 0.0)
            elif s.kind == "array":
                for k, n in enumerate(arrays[s["name"]].names):
                    initial = s["initial"][k] if k < len(s["initial"]) else None
                    if arrays[s["name"]].temporary or initial is not None:
                        self.retained[n] = self._negative(initial)
        # what a SET inside the step has read stays until it reads again
        read = {c for s in walk(step.body) if s.kind == "set" for r in s["refs"] for row in lookups.get(r.name, [])[:1] for c in row}
        self.computed = [n for n in kinds if n not in self.retained and n not in read]
        self.source_columns: list[str] = []
        top = next((s for s in step.body if s.kind in ("set", "merge", "update")), None)
        self.body = self._block([s for s in step.body if s is not top])

    @staticmethod
    def _negative(v):
        if not isinstance(v, tuple):
            return None
        return -v[2][1] if v[0] == "un" else v[1]

    def start(self) -> None:
        self.v = {n: "" if k == "char" else None for n, k in self.kinds.items()}
        for n, x in self.retained.items():
            self.v[n] = x if x is not None else ("" if self.kinds.get(n) == "char" else None)

    def row(self, values: dict) -> list[tuple[str, dict]]:
        """What one row puts out."""
        for n in self.computed:
            if n not in self.source_columns:
                self.v[n] = "" if self.kinds[n] == "char" else None
        self.v.update(values)
        self.out = []
        try:
            self.body()
        except _Delete:
            return self._flush()
        except _Return:
            pass
        if not self.explicit:
            self._emit(self.default)
        return self._flush()

    def _flush(self) -> list[tuple[str, dict]]:
        out, self.out = self.out, []
        return out

    def _emit(self, names: list[str]) -> None:
        self.out += [(n, dict(self.v)) for n in names]

    # expressions

    def expr(self, e: tuple) -> Callable:
        return getattr(self, f"_e_{e[0]}")(*e[1:])

    def _e_num(self, v):
        return lambda: v

    _e_str = _e_num
    _e_fmt = _e_num

    def _e_var(self, n):
        if n.endswith(".num_items"):
            table = n.removesuffix(".num_items")
            return lambda: float(len(self.tables[table].all()))
        return lambda: self.v.get(n)

    def _e_flag(self, which, n):
        return lambda: self.v.get(f"__{which}_{n}", 0.0)

    def _e_missing(self, x, negated):
        f = self.expr(x)
        return lambda: float(blank(f()) != negated)

    def _e_between(self, x, low, high):
        f, a, b = map(self.expr, (x, low, high))
        return lambda: float(order(f(), a()) >= 0 and order(f(), b()) <= 0)

    def _e_in(self, x, items, negated):
        f, fs = self.expr(x), [self.expr(i) for i in items]
        return lambda: float(any(order(f(), g()) == 0 for g in fs) != negated)

    def _e_un(self, op, x):
        f = self.expr(x)
        if op == "not":
            return lambda: float(not truthy(f()))
        return lambda: None if number(f()) is None else -number(f())

    def _e_bin(self, op, a, b):
        f, g = self.expr(a), self.expr(b)
        if op == "and":
            return lambda: float(truthy(f()) and truthy(g()))
        if op == "or":
            return lambda: float(truthy(f()) or truthy(g()))
        if op == "||":
            return lambda: ("" if f() is None else string(f())) + ("" if g() is None else string(g()))
        if op == "contains":
            return lambda: float(string(g()) in string(f()))
        if op == "like":
            return lambda: float(bool(re.fullmatch(re.escape(string(g())).replace("%", ".*").replace("_", "."), string(f()), re.IGNORECASE | re.DOTALL)))
        if op == "=:":
            return lambda: float(string(f()).startswith(string(g())) or string(g()).startswith(string(f())))
        tests = {"=": lambda c: c == 0, "^=": lambda c: c != 0, "<": lambda c: c < 0, "<=": lambda c: c <= 0, ">": lambda c: c > 0, ">=": lambda c: c >= 0}
        if op in tests:
            t = tests[op]
            return lambda: float(t(order(f(), g())))
        work = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y, "**": lambda x, y: x**y}[op]

        def h():
            x, y = number(f()), number(g())
            if x is None or y is None:
                return None
            try:
                out = work(x, y)
            except (ZeroDivisionError, OverflowError):
                return None
            return out if isinstance(out, float) and math.isfinite(out) else None

        return h

    def _slot(self, name, subs) -> Callable[[], str]:
        a, fs = self.arrays[name], [self.expr(s) for s in subs]
        return lambda: a.names[place(a, [int(number(f())) for f in fs])]

    def _e_at(self, name, subs):
        slot = self._slot(name, subs)
        return lambda: self.v.get(slot())

    def _e_call(self, name, args):
        if name in self.arrays:
            return self._e_at(name, args)
        found = re.fullmatch(r"(lag|dif)(\d*)", name)
        if found:
            key, k, f = len(self.queues), int(found[2] or 1), self.expr(args[0])
            self.queues[key] = []

            def lag():
                x, q = f(), self.queues[key]
                old = q[-k] if len(q) >= k else ("" if isinstance(x, str) else None)
                q.append(x)
                del q[:-k]
                if found[1] == "lag":
                    return old
                return None if number(x) is None or number(old) is None else number(x) - number(old)

            return lag
        if name in ("dim", "hbound", "lbound"):
            low, high = self.arrays[args[0][1]].bounds[int(args[1][1]) - 1 if len(args) > 1 else 0]
            return lambda: float(low if name == "lbound" else high)
        fs = []
        for a in args:
            if a[0] == "of":
                for n in a[1]:
                    names = self.arrays[n[:-3]].names if n.endswith("[*]") else sources.resolve([n], list(self.kinds)) or [n]
                    fs += [self.expr(("var", x)) for x in names]
            elif a[0] == "at" and a[2] == [("all",)]:
                fs += [self.expr(("var", x)) for x in self.arrays[a[1]].names]
            else:
                fs.append(self.expr(a))
        if name in self.functions:
            from rowloom.plans.routines import interpret

            return lambda: interpret(self.functions[name], [f() for f in fs], self.functions)
        if name not in PYTHON:
            raise ValueError(f"no function {name}")
        g = PYTHON[name]
        return lambda: g(*(f() for f in fs))

    def _e_method(self, name, method, args):
        pick = {k: [self.expr(x) for x in v] if isinstance(v, list) else self.expr(v) for k, v in args.items()}

        def keys(t: Table) -> tuple:
            return Table.key([f() for f in pick["key"]] if "key" in pick else [self.v.get(k) for k in t.keys])

        def load(t: Table, r: dict) -> None:
            self.v.update({d: r.get(d) for d in t.data})

        def run():
            if name in self.walks:
                table, rows, at = self.walks[name]
                if method in ("first", "last"):
                    rows = self.tables[table].all()
                at = {"first": 0, "last": len(rows) - 1, "next": at + 1, "prev": at - 1}[method]
                self.walks[name] = (table, rows, at)
                if not 0 <= at < len(rows):
                    return 1.0
                load(self.tables[table], rows[at])
                return 0.0
            t = self.tables[name]
            if method in ("definekey", "definedata"):
                names = [v().lower() for v in pick.values() if not isinstance(v, list)]
                if method == "definekey":
                    t.keys = t.keys + names
                else:
                    t.data = (t.data if t.data is not t.keys else []) + names
                return 0.0
            if method == "definedone":
                rows = t.all()
                self.tables[name] = Table(t.keys, t.data, self.lookups.get(getattr(t, "source", ""), rows), t.multi)
                return 0.0
            if method in ("find", "check"):
                rows = t.rows.get(keys(t))
                if not rows:
                    return 1.0
                if method == "find":
                    load(t, rows[0])
                    t.current = (rows, 0)
                return 0.0
            if method == "find_next":
                rows, at = getattr(t, "current", ([], 0))
                if at + 1 >= len(rows):
                    return 1.0
                t.current = (rows, at + 1)
                load(t, rows[at + 1])
                return 0.0
            if method in ("add", "replace", "ref"):
                k = keys(t)
                given = [f() for f in pick.get("data", [])]
                r = dict(zip(t.keys, k, strict=True)) | {d: (given[i] if i < len(given) else self.v.get(d)) for i, d in enumerate(t.data) if given or d not in t.keys or "key" not in pick}
                if method == "replace" or (k not in t.rows):
                    t.rows[k] = [r]
                elif t.multi and method == "add":
                    t.rows[k].append(r)
                else:
                    return 1.0 if method == "add" else 0.0
                return 0.0
            if method == "remove":
                return 0.0 if t.rows.pop(keys(t), None) is not None else 1.0
            if method == "clear":
                t.rows.clear()
                return 0.0
            if method == "num_items":
                return float(len(t.all()))
            if method == "output":
                target = pick["dataset"]().lower()
                self.out += [(target, {d: r.get(d) for d in dict.fromkeys([*t.keys, *t.data])}) for r in t.all()]
                return 0.0
            raise ValueError(f"no hash method {method}")

        return run

    # statements

    def _block(self, body: list[Stmt]) -> Callable[[], None]:
        steps = [f for f in (getattr(self, f"_s_{s.kind}", lambda s: None)(s) for s in body) if f]

        def run():
            for f in steps:
                f()

        return run

    def _set_value(self, target: tuple) -> Callable:
        if target[0] == "var":
            n = target[1]
            kind = self.kinds.get(n)

            def put(x):
                self.v[n] = (string(x) if x is not None else "") if kind == "char" else x if kind != "num" else number(x)

            return put
        slot = self._slot(target[1], target[2])

        def put_at(x):
            self.v[slot()] = x if isinstance(x, str) else number(x)

        return put_at

    def _s_assign(self, s):
        put, f = self._set_value(s["target"]), self.expr(s["value"])
        return lambda: put(f())

    def _s_add(self, s):
        n, f = s["target"][1], self.expr(s["value"])

        def run():
            self.v[n] = (number(self.v.get(n)) or 0.0) + (number(f()) or 0.0)

        return run

    def _s_if(self, s):
        t, a, b = self.expr(s["test"]), self._block(s["then"]), self._block(s["other"])
        return lambda: a() if truthy(t()) else b()

    def _s_subset(self, s):
        t = self.expr(s["test"])

        def run():
            if not truthy(t()):
                raise _Delete

        return run

    def _raise(self, e):
        def run():
            raise e

        return run

    def _s_delete(self, s):
        return self._raise(_Delete())

    def _s_return(self, s):
        return self._raise(_Return())

    def _s_stop(self, s):
        return self._raise(_Stop())

    def _s_abort(self, s):
        return self._raise(RuntimeError("ABORT"))

    def _s_leave(self, s):
        return self._raise(_Leave())

    def _s_continue(self, s):
        return self._raise(_Continue())

    def _s_output(self, s):
        names = s["names"] or self.default
        return lambda: self._emit(names)

    def _s_select(self, s):
        cases = [([self.expr(("bin", "=", s["value"], t) if s["value"] is not None else t) for t in tests], self._block(body)) for tests, body in s["cases"]]
        other = self._block(s["other"])

        def run():
            for tests, body in cases:
                if any(truthy(t()) for t in tests):
                    return body()
            return other()

        return run

    def _s_do(self, s):
        if s["over"]:
            from rowloom.plans.datastep import _replace

            return self._block([x for n in self.arrays[s["over"]].names for x in _replace(s["body"], s["over"], n)])
        body = self._block(s["body"])
        if not s["items"] and not s["while"] and not s["until"]:
            return body
        before = self.expr(s["while"]) if s["while"] else None
        after = self.expr(s["until"]) if s["until"] else None
        items = [tuple(None if x is None else self.expr(x) for x in i) for i in s["items"] or []]
        var = s["var"]

        def turn() -> bool:
            """One pass; whether the loop goes on."""
            if before and not truthy(before()):
                return False
            try:
                body()
            except _Continue:
                pass
            return not (after and truthy(after()))

        def run():
            try:
                if not items:
                    while turn():
                        pass
                    return
                for low, high, step in items:
                    self.v[var] = low()
                    if high is None:
                        if not turn():
                            return
                        continue
                    top, by = number(high()), 1.0 if step is None else number(step())
                    while top is not None and by and (number(self.v[var]) <= top + 1e-9 if by > 0 else number(self.v[var]) >= top - 1e-9):
                        if not turn():
                            return
                        self.v[var] = number(self.v[var]) + by
            except _Leave:
                pass

        return run

    def _s_declare(self, s):
        name, options = s["name"], s["options"]
        if s["type"] == "hiter":
            table = next(v[1] for v in options.values() if isinstance(v, tuple)).lower()

            def walk_():
                self.walks.setdefault(name, (table, [], -1))

            return walk_

        def make():
            if name not in self.tables:
                t = Table([], [], [], "multidata" in options)
                t.source = options["dataset"][1].lower() if "dataset" in options else ""
                self.tables[name] = t

        return make

    def _s_do_method(self, s):
        return self.expr(s["value"])

    def _s_call(self, s):
        if s["name"] == "missing":
            names = [a[1] for a in s["args"]]
            return lambda: self.v.update({n: "" if self.kinds.get(n) == "char" else None for n in names})
        fs = [self.expr(a) for a in s["args"]]
        if s["name"] in ("symput", "symputx"):
            return lambda: self.out.append(("__symput", {"__text": f"{string(fs[0]()).strip()}={string(fs[1]()).strip()}"}))
        if s["name"] == "execute":
            return lambda: self.out.append(("__execute", {"__text": string(fs[0]())}))
        if s["name"] in self.functions:
            from rowloom.plans.routines import interpret

            f, names = self.functions[s["name"]], [a[1] if a[0] == "var" else None for a in s["args"]]

            def run():
                got = interpret(f, [g() for g in fs], self.functions, True)
                self.v.update({n: got[p[0]] for n, p in zip(names, f.params, strict=False) if n and p[0] in f.outargs})

            return run
        return None

    def _s_file(self, s):
        def run():
            self.path = str(s["path"])

        return run

    def _s_put(self, s):
        items = []
        for i in s["items"]:
            if i[0] == "text":
                items.append(lambda x=i[1]: x)
            elif i[0] == "line":
                items.append(lambda: "\n")
            elif i[0] == "all":
                items.append(lambda: " ".join(f"{n}={string(x)}" for n, x in self.v.items() if not n.startswith("__")))
            elif i[0] == "named":
                f = self.expr(i[1])
                items.append(lambda f=f, n=i[1][1]: f"{n}={string(f())}")
            else:
                f = self.expr(i[1])
                items.append(lambda f=f: string(f()))
        return lambda: self.out.append((f"__put:{self.path}", {"__text": " ".join(g() for g in items).replace(" \n ", "\n")}))

    def _s_set(self, s):
        """A SET inside the step: the next row, the row at a number, or the first row of a key."""
        ref = s["refs"][0]
        rows, key = self.lookups[ref.name], len(self.cursors)
        self.cursors[key] = -1
        index: dict[tuple, dict] = {}
        shared: list[str] = []
        if s["key"] and rows:
            shared = [c for c in rows[0] if c in self.kinds and c in self.source_names]
            for r in rows:
                index.setdefault(Table.key([r[c] for c in shared]), r)

        def run():
            if s["nobs"]:
                self.v[s["nobs"]] = float(len(rows))
            if s["key"]:
                hit = index.get(Table.key([self.v.get(c) for c in shared]))
                self.v["_iorc_"] = 0.0 if hit else 1.0
                if hit:
                    self.v.update(hit)
                return
            at = int(number(self.v.get(s["point"])) or 0) - 1 if s["point"] else self.cursors[key] + 1
            if not 0 <= at < len(rows):
                raise _Stop
            self.cursors[key] = at
            self.v.update(rows[at])
            if s["end"]:
                self.v[s["end"]] = float(at == len(rows) - 1)

        return run


def _kinds(step: DataStep, plan: ColumnStep, context: Context) -> dict[str, str]:
    """Every variable's kind: declared, read, or by what is assigned first."""
    kinds = {n: v.kind for n, v in plan.env.items() if not n.startswith("__")}
    strings = {"upcase", "lowcase", "propcase", "trim", "strip", "left", "reverse", "compress", "compbl", "substr", "scan", "cat", "cats", "catx", "tranwrd", "translate", "repeat", "quote", "ifc", "coalescec", "put"}

    def kind(e) -> str:
        if e[0] == "str" or (e[0] == "bin" and e[1] == "||") or (e[0] == "call" and (e[1] in strings or (e[1] in context.functions and context.functions[e[1]].char))):
            return "char"
        if e[0] == "var":
            return kinds.get(e[1], "num")
        if e[0] == "at" and e[1] in plan.arrays:
            return "char" if plan.arrays[e[1]].char else "num"
        if e[0] == "call" and e[1].startswith("lag") and e[2]:
            return kind(e[2][0])
        return "num"

    for s in walk(step.body):
        if s.kind == "set":
            for r in s["refs"]:
                t = sources.with_options(context.dataset(r.name), r)
                for c in t.columns:
                    kinds.setdefault(c, t.kind(c))
        elif s.kind == "declare" and s["options"].get("dataset"):
            t = context.dataset(s["options"]["dataset"][1].lower())
            for c in t.columns:
                pass
        elif s.kind == "assign" and s["target"][0] == "var":
            kinds.setdefault(s["target"][1], kind(s["value"]))
        elif s.kind == "do" and s["var"]:
            kinds.setdefault(s["var"], "num")
        elif s.kind == "add":
            kinds.setdefault(s["target"][1], "num")
        for key in ("nobs", "end", "point"):
            if s.kind in ("set", "merge", "update") and s[key]:
                kinds.setdefault(s[key], "num")
    for a in plan.arrays.values():
        for n in a.names:
            kinds.setdefault(n, "char" if a.char else "num")
    hashes = [s["options"]["dataset"][1].lower() for s in walk(step.body) if s.kind == "declare" and s["options"].get("dataset")]
    for e in expressions([s.args for s in walk(step.body)]):
        if e[0] == "method" and e[2] in ("definedata", "definekey"):
            for v in e[3].values():
                if isinstance(v, tuple) and v[0] == "str":
                    name = v[1].lower()
                    for h in hashes:
                        if name in context.dataset(h).columns:
                            kinds.setdefault(name, context.dataset(h).kind(name))
        elif e[0] == "var" and "." not in e[1]:  # else it is an attribute of a hash object
            kinds.setdefault(e[1], "num")
    return kinds


#: Statements that look at no other row.
ALONE = {"set", "merge", "update", "by", "where", "subset", "assign", "if", "do", "select", "output", "delete", "return", "leave", "continue", "array", "keep", "drop", "rename", "length", "format", "informat", "label", "attrib", "skip"}


def independent(step: DataStep, top: Stmt | None) -> bool:
    """Whether no row of the step bears on another, so that rows can be worked on wherever they are."""
    for s in walk(step.body):
        if s.kind not in ALONE or (s.kind in ("set", "merge", "update") and s is not top) or (s.kind == "array" and (s["initial"] or s["temporary"])):
            return False
    return not any(e[0] == "method" or (e[0] == "call" and re.match(r"(?:lag|dif)\d*$|ran|rand", e[1])) for e in expressions([s.args for s in walk(step.body)]))


def run(step: DataStep, context: Context, given: Dataset | None = None) -> tuple[dict[str, Dataset], list[tuple[str, str]]]:
    """The outputs, and (kind, text) of lines, macro variables and program text that the step produced, in order."""
    plan = ColumnStep(step, context, given)
    plan._declare()
    top = next((s for s in step.body if s.kind in ("set", "merge", "update")), None)
    direct = top is not None and (top["point"] or top["key"])
    nested_only = given is None and (top is None or direct)
    if top is not None and not nested_only:
        # the first one is the source; what stands in the body besides is run row by row
        seen = [s for s in step.body if s.kind in ("set", "merge", "update")]
        plan.body = [s for s in step.body if s not in seen[1:]]
    if nested_only:
        plan.given = Dataset(context.dataset("__spark").range(1).select(F.lit(1.0).alias("__o0")), [("__o0", True)])
    plan._source()
    plan._initial()
    ds = numbered(plan.ds) if "__n" not in plan.ds.df.columns else plan.ds
    kinds = _kinds(step, plan, context)
    lookups: dict[str, list[dict]] = {}

    def fetch(name: str, ref=None) -> None:
        table = sources.with_options(context.dataset(name), ref) if ref is not None else context.dataset(name)
        if table.df.count() > LOOKUP_ROWS:
            raise ValueError(f"{name} has over {LOOKUP_ROWS} rows, too many for a lookup of a step with state; use MERGE")
        lookups[name] = [r.asDict() for r in table.ordered().collect()]

    for s in walk(step.body):
        if s.kind == "set" and (s is not top or nested_only):
            for r in s["refs"]:
                fetch(r.name, r)
        elif s.kind == "declare" and s["options"].get("dataset"):
            fetch(s["options"]["dataset"][1].lower())
    targets = [r.name for r in step.outputs]
    extra = sorted({e[3]["dataset"][1].lower() for e in expressions([s.args for s in walk(step.body)]) if e[0] == "method" and e[2] == "output"})
    columns = [c for c in dict.fromkeys([*plan.names, *kinds]) if not c.startswith("__")]
    flags = [c for c in ds.df.columns if c.startswith(("__first_", "__last_"))]
    source = [c for c in ds.df.columns if not c.startswith("__")]
    body = step if not nested_only else DataStep(step.outputs, [Stmt("skip")] + step.body, step.lines)
    end, nobs = (top["end"], top["nobs"]) if top and not nested_only else (None, None)
    total = ds.df.count() if end or nobs else 0
    schema = T.StructType([T.StructField("__t", T.StringType()), T.StructField("__o0", T.DoubleType()), T.StructField("__o1", T.DoubleType()), *(T.StructField(c, T.StringType() if kinds.get(c) == "char" else T.DoubleType()) for c in columns), T.StructField("__text", T.StringType())])
    arrays, by, functions, tops = plan.arrays, plan.by, context.functions, [s for s in body.body if not (s is top and nested_only)] if not nested_only else body.body

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = DataStep(body.outputs, [Stmt("skip"), *tops] if nested_only else tops, None)
        machine = Machine.__new__(Machine)
        machine.source_names = set(source)
        if nested_only:
            # no row source of its own: the SET inside is run like any statement
            Machine.__init__(machine, DataStep(steps.outputs, [Stmt("do", {"body": steps.body})], None), kinds, arrays, lookups, by, targets, functions)
        else:
            Machine.__init__(machine, steps, kinds, arrays, lookups, by, targets, functions)
        machine.source_columns = source
        machine.start()
        done, at = False, 0
        for frame in frames:
            rows: list[dict] = []
            for record in frame.to_dict("records") if not done else []:
                values = {c: ("" if record[c] is None else record[c]) if kinds.get(c) == "char" else number(record[c]) for c in [*source, *flags]}
                values["_n_"] = record["__n"]
                if end:
                    values[end] = float(record["__n"] == total)
                if nobs:
                    values[nobs] = float(total)
                try:
                    made = machine.row(values)
                except _Stop:
                    made, done = machine._flush(), True
                for target, out in made:
                    rows.append({"__t": target, "__o0": record["__n"], "__o1": float(at), **{c: out.get(c) for c in columns}, "__text": out.get("__text")})
                    at += 1
                if done:
                    break
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    ordered = ds.df.select(*source, *flags, "__n")
    if nested_only or not independent(step, top):
        # one ordered stream, as what a row leaves behind is for the next
        ordered = ordered.repartition(1).sortWithinPartitions("__n")
    made = ordered.mapInPandas(work, schema)
    from rowloom.plans.dataset import stored

    made = stored(made, "machine")
    out = {}
    keep = [n for s in walk(step.body) if s.kind == "keep" for n in s["names"]]
    drop = [n for s in walk(step.body) if s.kind == "drop" for n in s["names"]]
    renames = {a: b for s in walk(step.body) if s.kind == "rename" for a, b in s["pairs"].items()}
    special = {"_n_", "_iorc_", "_error_", *(s[k] for s in walk(step.body) if s.kind == "set" for k in ("end", "nobs", "point") if s[k]), *plan.flags}
    temporary = {n for a in arrays.values() if a.temporary for n in a.names}
    shown = [c for c in columns if c not in special and c not in temporary]
    if keep:
        shown = [c for c in shown if c in sources.resolve(keep, shown)]
    shown = [c for c in shown if c not in sources.resolve(drop, shown)]
    for ref in [*step.outputs, *(type(step.outputs[0])(x) for x in extra)]:
        own = shown
        if ref.name in extra:
            names = [v[1].lower() for e in expressions([s.args for s in walk(step.body)]) if e[0] == "method" and e[2] in ("definekey", "definedata") for v in e[3].values() if isinstance(v, tuple) and v[0] == "str"]
            own = [c for c in dict.fromkeys(names) if c in columns]
        rows = made.where(F.col("__t") == ref.name).select(*(F.col(c).alias(renames.get(c, c)) for c in own), "__o0", "__o1")
        new = Dataset(rows, [("__o0", True), ("__o1", True)], {k: v for k, v in (plan.ds.formats | plan.formats).items() if k in own}, dict(plan.labels))
        out[ref.name] = sources.output_options(new, ref)
    lines = [(r["__t"], r["__text"]) for r in made.where("substring(__t, 1, 2) = '__'").orderBy("__o0", "__o1").select("__t", "__text").collect()] if any(s.kind in ("put", "call") for s in walk(step.body)) else []
    return out, lines


__all__ = ["Machine", "arrays_of", "run"]
