"""Data steps as column expressions (tiers 1 and 2).

Statements are worked through once, symbolically: each variable is a column, a condition guards what an IF encloses, and
branches meet as CASE WHEN. State across rows is recognised where it has a window form: FIRST./LAST., LAG and DIF, sum
statements, running minima and maxima, and last values carried forward, with or without a reset at FIRST. What has none
raises Unsupported, and the step runs as an ordered state machine (see machine).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rowloom.functions.lower import Lowering, Unsupported
from rowloom.functions.values import Val, as_char, as_num, char, choose, num, text, truth
from rowloom.language.ast import DataStep, Ref, Stmt
from rowloom.plans import sources
from rowloom.plans.dataset import Dataset, numbered, running

UNROLL, FLUSH = 64, 24
DECLARED = ("set", "merge", "update", "by", "where", "array", "retain", "keep", "drop", "rename", "length", "format", "informat", "label", "attrib", "skip", "infile", "input")


@dataclass
class Array:
    names: list[str]
    bounds: list[tuple[int, int]]
    char: bool
    temporary: bool


@dataclass
class Context:
    """What a step may use of its session."""

    dataset: Callable[[str], Dataset]
    formats: dict
    functions: dict


def walk(body: list[Stmt]):
    for s in body:
        yield s
        for key in ("then", "other", "body"):
            yield from walk(s[key] or [] if isinstance(s[key], list) else [])
        for _, inner in s["cases"] or []:
            yield from walk(inner)


def expressions(value) -> list:
    """All expression nodes in a statement or expression."""
    out = []
    if isinstance(value, tuple) and value and isinstance(value[0], str):
        out.append(value)
    if isinstance(value, tuple | list):
        for v in value:
            out += expressions(v)
    elif isinstance(value, dict):
        for v in value.values():
            out += expressions(v)
    elif isinstance(value, Stmt):
        out += expressions(value.args)
    return out


def mentions(value, name: str) -> bool:
    return any(e[0] == "var" and e[1] == name for e in expressions(value) if len(e) > 1)


def arrays_of(body: list[Stmt]) -> dict[str, Array]:
    out = {}
    for s in walk(body):
        if s.kind != "array":
            continue
        names, bounds = list(s["names"]), s["sizes"]
        if bounds is None:
            bounds = [(1, len(names) or len(s["initial"]))]
        size = 1
        for low, high in bounds:
            size *= high - low + 1
        if not names:
            names = [f"__t_{s['name']}{k}" if s["temporary"] else f"{s['name']}{k}" for k in range(1, size + 1)]
        out[s["name"]] = Array(names, bounds, s["char"] or any(v[0] == "str" for v in s["initial"]), s["temporary"])
    return out


def place(array: Array, subs: list[int]) -> int:
    at = 0
    for (low, high), k in zip(array.bounds, subs, strict=True):
        if not low <= k <= high:
            raise Unsupported("subscript out of range")
        at = at * (high - low + 1) + k - low
    return at


class ColumnStep:
    def __init__(self, step: DataStep, context: Context, source: Dataset | None = None):
        self.step, self.context, self.given = step, context, source
        self.body = step.body
        self.arrays = arrays_of(self.body)
        self.env: dict[str, Val] = {}
        self.names: list[str] = []
        self.alive: Column | None = None
        self.outputs: list[tuple[list[str], Column | None, dict[str, Val]]] = []
        self.hashes: dict[str, dict] = {}
        self.weight = 0
        self.explicit = any(s.kind == "output" for s in walk(self.body))
        self.formats: dict[str, str] = {}
        self.labels: dict[str, str] = {}
        self.retained: dict[str, object] = {}
        self.notes: list[str] = ["tier 1: columns"]

    # the step as a whole

    def run(self) -> dict[str, Dataset]:
        self._declare()
        self._source()
        self._initial()
        top = [s for s in self.body if s.kind not in DECLARED or s.kind in ("where",)]
        for k, s in enumerate(top):
            if s.kind == "where":
                continue
            self._top(s, top[k + 1 :], top[:k])
        if not self.explicit:
            self._output([r.name for r in self.step.outputs], None)
        return self._finish()

    def _declare(self) -> None:
        by = next((s for s in self.body if s.kind == "by"), None)
        self.by, self.descending = (by["names"], by["descending"]) if by else ([], [])
        self.kinds: dict[str, str] = {}
        self.lengths: dict[str, int] = {}
        for s in walk(self.body):
            if s.kind == "length":
                self.kinds |= {n: "char" if c else "num" for n, (c, _) in s["items"].items()}
                self.lengths |= {n: size for n, (c, size) in s["items"].items() if c}
            elif s.kind == "retain":
                self.retained |= {n: v for n, v in s["items"]}
            elif s.kind == "format":
                self.formats |= s["items"]
            elif s.kind == "label":
                self.labels |= s["items"]
            elif s.kind == "attrib":
                for n, o in s["items"].items():
                    if "format" in o:
                        self.formats[n] = o["format"]
                    if "label" in o:
                        self.labels[n] = o["label"]
                    if "length" in o:
                        self.kinds[n] = "char" if str(o["length"]).startswith("$") else "num"
        for a in self.arrays.values():
            self.kinds |= {n: "char" if a.char else "num" for n in a.names if n not in self.kinds and a.char}

    def _source(self) -> None:
        reads = [s for s in walk(self.body) if s.kind in ("set", "merge", "update")]
        top = [s for s in self.body if s.kind in ("set", "merge", "update")]
        self.flags: list[str] = []
        self.one_row = False
        if self.given is not None:
            ds = self.given
        elif not top:
            if reads:
                raise Unsupported("a SET inside a block only")
            spark = self.context.dataset("__spark")
            ds = Dataset(spark.range(1).select(F.lit(1.0).alias("__o0")), [("__o0", True)])
            self.one_row = True
        else:
            s = top[0]
            if len(top) > 1:
                raise Unsupported("a second SET")
            if s["point"] or s["key"]:
                raise Unsupported("direct access")
            parts = [sources.with_options(self.context.dataset(r.name), r, self.context.formats) for r in s["refs"]]
            where = next((x["test"] for x in self.body if x.kind == "where"), None)
            if where is not None:
                parts = [p.with_df(p.df.where(Lowering(p.val, self.context.formats).filter(where))) for p in parts]
            flags = [r.flag for r in s["refs"]]
            self.flags = [f for f in flags if f]
            if s.kind == "set":
                if len(parts) == 1 and not self.flags:
                    ds = parts[0].sorted_by(self.by, self.descending) if self.by else parts[0]
                else:
                    ds = sources.concatenate(parts, self.by or None, self.descending, flags)
            elif s.kind == "merge":
                ds = sources.merge_by(parts, self.by, self.descending, flags) if self.by else sources.merge_rows(parts, flags)
            else:
                if not self.by or len(parts) != 2:
                    raise Unsupported("UPDATE without BY")
                ds = sources.update_by(parts[0], parts[1], self.by, flags)
            self.end, self.nobs = s["end"], s["nobs"]
        self.ds = ds
        self.extra_sets = [s for s in reads if not top or s is not top[0]]
        for c in ds.columns:
            if c in self.flags:
                self.env[c] = Val(F.col(f"`{c}`"), "num")
            else:
                self._new(c, ds.val(c))
        uses = expressions([s.args for s in walk(self.body)])
        self._window_flags([e for e in uses if e[0] == "flag"])
        if any(e[:2] == ("var", "_n_") for e in uses):
            self._number()
            self.env["_n_"] = Val(F.col("__n"), "num")
        if top and (top[0]["end"] or top[0]["nobs"]):
            self._number()
            total = self.ds.df.agg(F.count("*")).head()[0]  # one number
            if top[0]["end"]:
                self.env[top[0]["end"]] = Val(F.when(F.col("__n") == total, 1.0).otherwise(0.0), "num")
            if top[0]["nobs"]:
                self.env[top[0]["nobs"]] = num(float(total))

    def _number(self) -> None:
        if "__n" not in self.ds.df.columns:
            self.flush()
            self.ds = numbered(self.ds)

    def _window_flags(self, used: list[tuple]) -> None:
        columns = {}
        for which, name in {(e[1], e[2]) for e in used}:
            if name not in self.by:
                raise Unsupported(f"{which}.{name} without BY")
            prefix = [F.col(c) for c, _ in self.ds.order[: self.by.index(name) + 1]]
            rest = self.ds.sort_columns()[self.by.index(name) + 1 :] or [F.lit(0)]
            w = Window.partitionBy(*prefix).orderBy(*rest)
            test = F.row_number().over(w) == 1 if which == "first" else F.lead(F.lit(1)).over(w).isNull()
            columns[f"__{which}_{name}"] = F.when(test, 1.0).otherwise(0.0)
        if columns:
            self.ds = self.ds.with_df(self.ds.df.withColumns(columns))

    def _initial(self) -> None:
        for s in self.body:
            if s.kind == "array":
                a = self.arrays[s["name"]]
                a.names = sources.resolve(a.names, self.names) if any("--" in n for n in a.names) else a.names
                for k, n in enumerate(a.names):
                    if n not in self.env:
                        value = s["initial"][k] if k < len(s["initial"]) else None
                        self._new(n, self._literal(value, "char" if a.char else "num"))
        for n, v in self.retained.items():
            if n not in self.env:
                self._new(n, self._literal(v if isinstance(v, tuple) else None, self.kinds.get(n) or ("char" if isinstance(v, tuple) and v[0] == "str" else "num")))
        for n, k in self.kinds.items():
            if n not in self.env:
                self._new(n, char("") if k == "char" else num(None))

    def _literal(self, value: tuple | None, kind: str) -> Val:
        if value is None:
            return char("") if kind == "char" else num(None)
        return self.lowering().value(value)

    def _new(self, name: str, value: Val) -> None:
        self.env[name] = value
        if not name.startswith("__") and name not in self.flags:
            self.names.append(name)

    # values

    def lowering(self, condition: Column | None = None) -> Lowering:
        self._condition = condition
        hooks: dict[str, Callable] = {"lag": self._bad_lag, "dif": self._bad_lag, "dim": self._dim, "hbound": self._dim, "lbound": lambda a: self._dim(a, 0)}
        hooks |= {f"lag{k}": self._bad_lag for k in range(1, 101)} | {f"dif{k}": self._bad_lag for k in range(1, 101)}
        hooks |= {n: (lambda args, f=f: self._inline(f, args)) for n, f in self.context.functions.items()}
        low = Lowering(self._lookup, self.context.formats, hooks, self._element, self._flag)
        low._method = self._method
        low._call = (lambda call: lambda name, args: call(name, self._spread(args)))(low._call)
        return low

    def _spread(self, args: list[tuple]) -> list[tuple]:
        out = []
        for a in args:
            if a[0] == "of":
                names = []
                for n in a[1]:
                    names += self.arrays[n[:-3]].names if n.endswith("[*]") else sources.resolve([n], self.names) or [n]
                out += [("var", n) for n in names]
            elif a[0] == "at" and a[2] == [("all",)]:
                out += [("var", n) for n in self.arrays[a[1]].names]
            else:
                out.append(a)
        return out

    def _lookup(self, name: str) -> Val:
        if name not in self.env:
            if name in ("_error_", "_iorc_"):
                return num(0.0)
            self._new(name, char("") if self.kinds.get(name) == "char" else num(None))
        return self.env[name]

    def _flag(self, which: str, name: str) -> Val:
        return Val(F.col(f"__{which}_{name}"), "num")

    def _bad_lag(self, args: list[tuple]) -> Val:
        raise Unsupported("LAG or DIF inside a condition or expression")

    def _dim(self, args: list[tuple], which: int = 1) -> Val:
        a = self.arrays.get(args[0][1])
        if a is None:
            raise Unsupported(f"no array {args[0][1]}")
        if len(args) == 1 and len(a.bounds) > 1:
            raise ValueError("the bounds of an array of several dimensions need the dimension")
        low, high = a.bounds[int(args[1][1]) - 1 if len(args) > 1 else 0]
        return num(float(low if which == 0 else high))

    def _element(self, name: str, subs: list[tuple]) -> Val:
        if name not in self.arrays:
            raise Unsupported(f"no function or array {name}")
        a = self.arrays[name]
        values = [self.lowering(self._condition).value(s) for s in subs]
        if all(v.known for v in values):
            return self._lookup(a.names[place(a, [int(v.lit) for v in values])])
        at = self._position(a, values)
        items = [self._lookup(n) for n in a.names]
        kind = "char" if any(i.kind == "char" for i in items) else "num"
        return Val(F.get(F.array(*((as_char(i) if kind == "char" else as_num(i)).col for i in items)), at), kind)

    def _position(self, a: Array, values: list[Val]) -> Column:
        at = F.lit(0)
        for (low, high), v in zip(a.bounds, values, strict=True):
            at = at * (high - low + 1) + as_num(v).col.cast("int") - low
        return at

    def _inline(self, f, args: list[tuple]) -> Val:
        from rowloom.plans.routines import inline

        return inline(f, [self.lowering(self._condition).value(a) if not (a[0] == "var" and a[1] in self.arrays) else [self._lookup(n) for n in self.arrays[a[1]].names] for a in self._spread(args)], self.context)

    # statements

    def _top(self, s: Stmt, later: list[Stmt], earlier: list[Stmt]) -> None:
        if s.kind == "assign" and s["target"][0] == "var" and s["value"][0] == "call" and (s["value"][1].startswith(("lag", "dif"))) and s["value"][1][3:].isdigit() | (len(s["value"][1]) == 3):
            return self._lag(s, later)
        if s.kind == "add" and s["target"][0] == "var":
            return self._sum(s["target"][1], s["value"], None, earlier)
        if s.kind == "if" and not s["other"] and len(s["then"]) == 1 and s["then"][0].kind == "add" and s["then"][0]["target"][0] == "var":
            return self._sum(s["then"][0]["target"][1], s["then"][0]["value"], s["test"], earlier)
        if self._carried(s, earlier):
            return None
        if s.kind == "if" and s["test"] == ("bin", "=", ("var", "_n_"), ("num", 1.0)) and self._set_up(s):
            return None
        if s.kind == "if" and self._is_reset(s):
            return None  # the running statement takes it in
        if s.kind == "do" and s["items"] and self._explode(s, later):
            return None
        self._do([s], None)
        if self.weight > FLUSH:
            self.flush()
        return None

    def _do(self, body: list[Stmt], cond: Column | None) -> None:
        for s in body:
            getattr(self, f"_x_{s.kind}", self._unknown)(s, cond)

    def _unknown(self, s: Stmt, cond: Column | None) -> None:
        if s.kind not in DECLARED:
            raise Unsupported(s.kind)
        if s.kind in ("set", "merge", "update"):
            raise Unsupported("a second SET")

    def _guard(self, cond: Column | None, test: Column) -> Column:
        return test if cond is None else cond & test

    def _put(self, name: str, value: Val, cond: Column | None) -> None:
        if name in self.retained and not getattr(self, "_window", False):
            raise Unsupported(f"retained {name} without a window form")
        kind = self.kinds.get(name) or (self.env[name].kind if name in self.env else None)
        if kind is None:
            kind = "num" if value.kind == "bool" else value.kind
        value = as_char(value) if kind == "char" else as_num(value)
        if kind == "char" and name in self.lengths:
            value = Val(F.substring(text(value), 1, self.lengths[name]), "char")
        if name not in self.env:
            self._new(name, char("") if kind == "char" else num(None))
        self.env[name] = value if cond is None else choose(cond, value, self.env[name])
        self.weight += 1

    def _x_assign(self, s: Stmt, cond: Column | None) -> None:
        value = self.lowering(cond).value(s["value"])
        target = s["target"]
        if target[0] == "var":
            return self._put(target[1], value, cond)
        a = self.arrays.get(target[1])
        if a is None:
            raise Unsupported(f"assignment to {target[1]}")
        if a.temporary:
            raise Unsupported("a temporary array that changes")
        subs = [self.lowering(cond).value(x) for x in target[2]]
        if all(v.known for v in subs):
            return self._put(a.names[place(a, [int(v.lit) for v in subs])], value, cond)
        at = self._position(a, subs)
        for k, n in enumerate(a.names):
            self._put(n, value, self._guard(cond, at == k))
        return None

    def _x_add(self, s: Stmt, cond: Column | None) -> None:
        raise Unsupported("a sum statement inside a block")

    def _x_if(self, s: Stmt, cond: Column | None) -> None:
        test = self.lowering(cond).test(s["test"])
        if s["test"][0] == "num":
            return self._do(s["then"] if s["test"][1] else s["other"], cond)
        test = self._fixed(test)
        self._do(s["then"], self._guard(cond, test))
        if s["other"]:
            self._do(s["other"], self._guard(cond, ~test))
        return None

    def _fixed(self, test: Column) -> Column:
        """test, as a column of its own, so that what branches assign does not change it."""
        name = f"__c{len([c for c in self.ds.df.columns if c.startswith('__c')])}"
        self.flush({name: test})
        return F.col(name)

    def _x_do(self, s: Stmt, cond: Column | None) -> None:
        if s["while"] or s["until"]:
            raise Unsupported("DO WHILE or UNTIL")
        if s["over"]:
            array = self.arrays[s["over"]]
            for n in array.names:
                self._do(_replace(s["body"], s["over"], n), cond)
            return
        if not s["items"]:
            return self._do(s["body"], cond)
        if any(x.kind in ("leave", "continue") for x in walk(s["body"])):
            raise Unsupported("LEAVE or CONTINUE")
        turns: list[float] = []
        for low, high, step in s["items"]:
            values = [None if x is None else self.lowering(cond).value(x) for x in (low, high, step)]
            if any(v is not None and not v.known for v in values):
                raise Unsupported("a loop with bounds that rows decide")
            low_, high_, step_ = (None if v is None else v.lit for v in values)
            if high_ is None:
                turns.append(low_)
                continue
            step_ = step_ or 1.0
            k = low_
            while (k <= high_ + 1e-9 if step_ > 0 else k >= high_ - 1e-9) and len(turns) <= UNROLL:
                turns.append(k)
                k += step_
            if len(turns) > UNROLL:
                raise Unsupported("a long loop")
        for k in turns:
            self.env[s["var"]] = num(k) if not isinstance(k, str) else char(k)
            if s["var"] not in self.names:
                self.names.append(s["var"])
            self._do(s["body"], cond)
            if self.weight > FLUSH:
                self.flush(keep=s["var"])
        low, high, step = s["items"][-1]
        if high is not None and turns:
            self.env[s["var"]] = num(turns[-1] + (self.lowering(cond).value(step).lit if step else 1.0))
        return None

    def _explode(self, s: Stmt, later: list[Stmt]) -> bool:
        """A last loop that only outputs rows, its bounds decided by rows or long: one row for each turn."""
        if later or self.outputs or len(s["items"]) != 1 or s["while"] or s["until"] or not any(x.kind == "output" for x in walk(s["body"])):
            return False
        if any(x.kind in ("leave", "continue", "stop", "do") for x in walk(s["body"])):
            return False
        # what a turn assigns may not be read by the next one
        assigned = {x["target"][1] for x in walk(s["body"]) if x.kind in ("assign", "add")}
        if any(x.kind == "add" for x in walk(s["body"])) or any(mentions(x, n) for n in assigned for x in s["body"] if x.kind == "assign" and mentions(x["value"], n)):
            return False
        low, high, step = s["items"][0]
        if high is None:
            return False
        values = [as_num(self.lowering().value(x if x is not None else ("num", 1.0))) for x in (low, high, step)]
        self.flush()
        a, b, c = (v.col for v in values)
        turns = F.floor((b - a) / c + 1e-9).cast("int")
        ok = turns.isNotNull() & (turns >= 0)
        df = self.ds.df.withColumn("__i", F.explode(F.when(ok, F.sequence(F.lit(0), F.greatest(turns, F.lit(0)))).otherwise(F.array().cast("array<int>"))))
        df = df.withColumn("__loop", a + F.col("__i") * c).drop("__n", "__p") if "__n" not in [x for x, _ in self.ds.order] else df.withColumn("__loop", a + F.col("__i") * c)
        hidden = f"__o{len(self.ds.order)}x"
        self.ds = Dataset(df.withColumn(hidden, F.col("__i").cast("double")), [*self.ds.order, (hidden, True)], self.ds.formats, self.ds.labels)
        self.env[s["var"]] = Val(F.col("__loop"), "num")
        if s["var"] not in self.names:
            self.names.append(s["var"])
        self._do(s["body"], None)
        return True

    def _x_select(self, s: Stmt, cond: Column | None) -> None:
        left: Column | None = None
        for tests, body in s["cases"]:
            exprs = [("bin", "=", s["value"], t) if s["value"] is not None else t for t in tests]
            test = self.lowering(cond).test(exprs[0])
            for e in exprs[1:]:
                test = test | self.lowering(cond).test(e)
            test = self._fixed(test)
            self._do(body, self._guard(cond, test if left is None else left & test))
            left = ~test if left is None else left & ~test
        if s["other"]:
            self._do(s["other"], cond if left is None else self._guard(cond, left))

    def _x_subset(self, s: Stmt, cond: Column | None) -> None:
        self._kill(self._guard(cond, ~self.lowering(cond).test(s["test"])))

    def _x_delete(self, s: Stmt, cond: Column | None) -> None:
        self._kill(F.lit(True) if cond is None else cond)

    def _x_return(self, s: Stmt, cond: Column | None) -> None:
        test = F.lit(True) if cond is None else cond
        if not self.explicit:
            self._output([r.name for r in self.step.outputs], test)
        self._kill(test)

    def _kill(self, test: Column) -> None:
        test = self._fixed(test)
        self.alive = ~test if self.alive is None else self.alive & ~test

    def _x_stop(self, s: Stmt, cond: Column | None) -> None:
        if self.one_row and cond is None:
            return
        raise Unsupported("STOP")

    def _x_abort(self, s: Stmt, cond: Column | None) -> None:
        raise Unsupported("ABORT")

    def _x_output(self, s: Stmt, cond: Column | None) -> None:
        self._output(s["names"] or [r.name for r in self.step.outputs], cond)

    def _output(self, names: list[str], cond: Column | None) -> None:
        test = cond if self.alive is None else self.alive if cond is None else self.alive & cond
        self.outputs.append((names, test, dict(self.env)))

    def _x_call(self, s: Stmt, cond: Column | None) -> None:
        if s["name"] == "missing":
            for a in s["args"]:
                v = self._lookup(a[1])
                self._put(a[1], char("") if v.kind == "char" else num(None), cond)
        elif s["name"] in self.context.functions:
            from rowloom.plans.routines import call

            for name, value in call(self.context.functions[s["name"]], s["args"], self.lowering(cond).value, self.context).items():
                self._put(name, value, cond)
        elif s["name"] in ("symput", "symputx", "execute"):
            raise Unsupported(s["name"])

    def _x_put(self, s: Stmt, cond: Column | None) -> None:
        raise Unsupported("PUT")

    def _x_file(self, s: Stmt, cond: Column | None) -> None:
        raise Unsupported("FILE")

    # state across rows

    def _partition(self, name: str) -> list[Column]:
        return [F.col(c) for c, _ in self.ds.order[: self.by.index(name) + 1]]

    def _reset(self, name: str, body: list[Stmt]) -> tuple[str, tuple] | None:
        """(by variable, value) if some statement of body sets name at FIRST. of it."""
        for s in body:
            if s.kind == "if" and s["test"][0] == "flag" and s["test"][1] == "first":
                for inner in walk(s["then"]):
                    if inner.kind == "assign" and inner["target"] == ("var", name):
                        return s["test"][2], inner["value"]
        return None

    def _is_reset(self, s: Stmt) -> bool:
        """An IF FIRST. that only sets variables which later statements run."""
        if s["test"][:2] != ("flag", "first") or s["other"]:
            return False
        inner = [x for x in walk(s["then"]) if x.kind != "do"]
        return bool(inner) and all(x.kind == "assign" and x["target"][0] == "var" and x["target"][1] in self._running_names() for x in inner)

    def _running_names(self) -> set[str]:
        out = set(self.retained)
        for s in walk(self.body):
            if s.kind == "add" and s["target"][0] == "var":
                out.add(s["target"][1])
        return out

    def _run_window(self, name: str, value: Column, how: str, earlier: list[Stmt]) -> None:
        """name becomes the running value of a column, from its reset or the beginning on."""
        if self.alive is not None:
            raise Unsupported("state after rows are deleted")
        reset = self._reset(name, earlier)
        self._window = True
        initial = self.retained.get(name)
        start = self.lowering().value(initial) if isinstance(initial, tuple) else (num(0.0) if how == "sum" else num(None))
        self.flush({"__v": value})
        if reset:
            start = self.lowering().value(reset[1])
            w = Window.partitionBy(*self._partition(reset[0])).orderBy(*self.ds.sort_columns()).rowsBetween(Window.unboundedPreceding, 0)
            f = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[how]
            self.ds = self.ds.with_df(self.ds.df.withColumn("__r", f(F.col("__v")).over(w)))
        else:
            self._number()
            self.ds = running(self.ds, F.col("__v"), how, "__r")
        out = F.col("__r")
        if how == "sum":
            out = F.coalesce(out, F.lit(0.0)) + F.coalesce(start.col, F.lit(0.0))
        elif how in ("max", "min") and not (start.known and start.lit is None):
            out = (F.greatest if how == "max" else F.least)(out, start.col)
        else:
            out = F.coalesce(out, start.col)
        kind = "char" if dict(self.ds.df.dtypes)["__v"] == "string" else "num"
        if name not in self.env:
            self._new(name, num(None))
        self.env[name] = Val(out, kind)
        self.flush()
        self.ds = self.ds.with_df(self.ds.df.drop("__v", "__r"))
        self._window = False
        self.notes.append(f"tier 2: {name} is a running {how}")

    def _sum(self, name: str, value: tuple, test: tuple | None, earlier: list[Stmt]) -> None:
        reads = [s for s in earlier if mentions(s.args, name) and not (s.kind == "if" and self._is_reset(s))]
        writes = [s for s in walk(self.body) if (s.kind == "assign" and s["target"] == ("var", name))]
        adds = [s for s in walk(self.body) if s.kind == "add" and s["target"] == ("var", name)]
        reset = self._reset(name, earlier)
        if reads or len(adds) > 1 or len(writes) > (1 if reset else 0):
            raise Unsupported(f"{name} is used before its sum statement")
        x = as_num(self.lowering().value(value)).col
        if test is not None:
            x = F.when(self.lowering().test(test), x)
        self._run_window(name, x, "sum", earlier)

    def _carried(self, s: Stmt, earlier: list[Stmt]) -> bool:
        """r = max(r, x); r = min(r, x); r = r + x; if <x is there> then r = x; for a retained r."""
        test, inner = None, s
        if s.kind == "if" and not s["other"] and len(s["then"]) == 1:
            test, inner = s["test"], s["then"][0]
        if inner.kind != "assign" or inner["target"][0] != "var" or inner["target"][1] not in self.retained:
            return False
        name, value = inner["target"][1], inner["value"]
        if test is not None and test[0] == "flag":
            return False
        if sum(1 for x in walk(self.body) if x.kind == "assign" and x["target"] == ("var", name)) > (2 if self._reset(name, earlier) else 1):
            return False
        if test is not None and mentions(test, name) or any(mentions(e.args, name) for e in earlier if not (e.kind == "if" and self._is_reset(e))):
            return False
        if value[0] == "call" and value[1] in ("max", "min") and ("var", name) in value[2] and len(value[2]) == 2 and test is None:
            other = next(a for a in value[2] if a != ("var", name))
            if not mentions(other, name):
                self._run_window(name, as_num(self.lowering().value(other)).col, value[1], earlier)
                return True
        if mentions(value, name):
            return False
        v = self.lowering().value(value)
        v = Val(text(v), "char") if v.kind == "char" else as_num(v)
        if test is None:
            return False
        self._run_window(name, F.when(self.lowering().test(test), v.col), "last", earlier)
        return True

    def _lag(self, s: Stmt, later: list[Stmt]) -> None:
        call = s["value"]
        k = int(call[1][3:] or 1)
        target = s["target"][1]
        if self.alive is not None:
            raise Unsupported("LAG after rows are deleted")
        v = self.lowering().value(call[2][0])
        v = Val(text(v), "char") if v.kind == "char" else as_num(v)
        by = next((x["test"][2] for x in later if x.kind == "if" and x["test"][:2] == ("flag", "first") and any(i.kind == "assign" and i["target"] == ("var", target) for i in walk(x["then"]))), None) if k == 1 else None
        self.flush({"__v": v.col})
        if by is not None:
            # whatever LAG brings into a group's first row is overwritten, so groups can run apart
            w = Window.partitionBy(*self._partition(by)).orderBy(*self.ds.sort_columns())
            self.ds = self.ds.with_df(self.ds.df.withColumn("__r", F.lag("__v", k).over(w)))
        else:
            self._number()
            before = self.ds.df.select((F.col("__n") + k).alias("__n"), F.col("__v").alias("__r"))
            self.ds = self.ds.with_df(self.ds.df.join(before, "__n", "left"))
        lagged = Val(F.coalesce(F.col("__r"), F.lit("")) if v.kind == "char" else F.col("__r"), v.kind)
        self._put(target, lagged if call[1].startswith("lag") else Val(F.col("__v") - F.col("__r"), "num"), None)
        self.flush()
        self.ds = self.ds.with_df(self.ds.df.drop("__v", "__r"))
        self.notes.append(f"tier 2: {call[1]} is a window")

    # lookups

    def _set_up(self, s: Stmt) -> bool:
        body = [x for x in walk(s["then"]) if x.kind != "do"]
        if body and all(x.kind in ("declare", "do_method") for x in body):
            for x in body:
                self._x_declare(x, None) if x.kind == "declare" else self._x_do_method(x, None)
            return True
        if len(body) == 1 and body[0].kind == "set":
            # SET once: its one row stands beside all rows
            ref: Ref = body[0]["refs"][0]
            one = sources.limited(sources.with_options(self.context.dataset(ref.name), ref), None, 1)
            self.flush()
            row = one.ordered().limit(1).withColumnsRenamed({c: f"__u_{c}" for c in one.columns})
            self.ds = self.ds.with_df(self.ds.df.join(F.broadcast(row), F.lit(True), "left"))  # one row
            for c in one.columns:
                self._new(c, Val(F.col(f"__u_{c}"), one.kind(c))) if c not in self.env else self.env.__setitem__(c, Val(F.col(f"__u_{c}"), one.kind(c)))
            return True
        return False

    def _x_declare(self, s: Stmt, cond: Column | None) -> None:
        source = s["options"].get("dataset")
        if s["type"] != "hash" or source is None or source[0] != "str":
            raise Unsupported("a hash object that rows fill")
        self.hashes[s["name"]] = {"name": source[1].lower(), "keys": [], "data": [], "multi": "multidata" in s["options"]}

    def _x_do_method(self, s: Stmt, cond: Column | None) -> None:
        value = s["value"]
        if value[0] != "method" or value[1] not in self.hashes:
            raise Unsupported("a method")
        if value[2] in ("definekey", "definedata"):
            names = [v[1].lower() for v in value[3].values() if isinstance(v, tuple) and v[0] == "str"]
            self.hashes[value[1]]["keys" if value[2] == "definekey" else "data"] += names
        elif value[2] == "find":
            self._condition = cond
            self._method(*value[1:])
        elif value[2] != "definedone":
            raise Unsupported(f"hash method {value[2]}")

    def _method(self, name: str, method: str, args: dict) -> Val:
        if name not in self.hashes or method not in ("find", "check"):
            raise Unsupported(f"hash method {method}")
        cond = self._condition
        h = self.hashes[name]
        table = self.context.dataset(h["name"])
        keys = [self.lowering(cond).value(k) for k in args.get("key", [("var", k) for k in h["keys"]])]
        data = (h["data"] or h["keys"]) if method == "find" else []
        n = sum(1 for c in self.ds.df.columns if c.startswith("__h"))
        first = F.row_number().over(Window.partitionBy(*(sources.sort_key(table, k) for k in h["keys"])).orderBy(*(table.sort_columns() or [F.lit(0)])))
        side = table.df.withColumn("__f", first).where("__f = 1")
        side = side.select(*(sources.sort_key(table, k).alias(f"__hk{n}_{i}") for i, k in enumerate(h["keys"])), *(F.col(f"`{c}`").alias(f"__hd{n}_{c}") for c in data), F.lit(1.0).alias(f"__hm{n}"))
        for i, k in enumerate(keys):
            k = Val(F.rtrim(text(k)), "char") if table.kind(h["keys"][i]) == "char" else as_num(k)
            self.flush({f"__hq{n}_{i}": k.col})
        match = F.lit(True)
        for i in range(len(keys)):
            match = match & F.col(f"__hq{n}_{i}").eqNullSafe(F.col(f"__hk{n}_{i}"))
        # the plan decides between broadcast and shuffle by the table's size
        self.ds = self.ds.with_df(self.ds.df.join(side, match, "left"))
        found = F.col(f"__hm{n}").isNotNull()
        for c in data:
            value = Val(F.col(f"__hd{n}_{c}"), table.kind(c))
            self._put(c, value, found if cond is None else cond & found)
        return Val(F.when(found, 0.0).otherwise(1.0), "num")

    # columns

    def flush(self, more: dict[str, Column] | None = None, keep: str | None = None) -> None:
        """All variables become columns of the frame."""
        hidden = [c for c in self.ds.df.columns if c.startswith("__") and not c.startswith("__e_")]
        values = {n: v for n, v in self.env.items() if not v.known}
        pending = {}
        for k, (_, test, env) in enumerate(self.outputs):
            pending |= {f"__e_{k}_{n}": v for n, v in env.items() if not v.known}
            if test is not None:
                pending[f"__e_{k}"] = Val(test, "bool")
        alive = {"__alive": self.alive} if self.alive is not None else {}
        columns = [F.col(c) for c in hidden if c != "__alive"] + [v.col.alias(f"__e_{n}" if n.startswith("__") else n) for n, v in values.items()]
        columns += [v.col.alias(n) for n, v in pending.items()] + [c.alias(n) for n, c in (alive | (more or {})).items()]
        taken = {f"__e_{n}" if n.startswith("__") else n for n in values} | set(pending) | set(alive) | set(more or {})
        columns = [c for c, name in zip(columns, [*(h for h in hidden if h != "__alive"), *(f"__e_{n}" if n.startswith("__") else n for n in values), *pending, *alive, *(more or {})], strict=True) if not (name in taken and name in hidden and name not in pending and name not in (more or {}) and name not in alive) or name in (more or {})]
        self.ds = self.ds.with_df(self.ds.df.select(*columns))
        self.env |= {n: Val(F.col(f"`{'__e_' + n if n.startswith('__') else n}`"), v.kind) for n, v in values.items()}
        if self.alive is not None:
            self.alive = F.col("__alive")
        self.outputs = [(names, None if test is None else F.col(f"__e_{k}"), {n: v if v.known else Val(F.col(f"`__e_{k}_{n}`"), v.kind) for n, v in env.items()}) for k, (names, test, env) in enumerate(self.outputs)]
        self.weight = 0

    def _finish(self) -> dict[str, Dataset]:
        out: dict[str, Dataset] = {}
        renames: dict[str, str] = {}
        keep = drop = None
        for s in walk(self.body):
            if s.kind == "keep":
                keep = (keep or []) + s["names"]
            elif s.kind == "drop":
                drop = (drop or []) + s["names"]
            elif s.kind == "rename":
                renames |= s["pairs"]
        names = [n for n in dict.fromkeys(self.names) if not n.startswith("__") and n not in ("_n_", "_iorc_", "_error_")]
        special = {s[k] for s in walk(self.body) if s.kind == "set" for k in ("end", "nobs", "point") if s[k]}
        names = [n for n in names if n not in special]
        if keep is not None:
            own = sources.resolve(keep, names)
            names = [n for n in names if n in own]
        if drop is not None:
            gone = sources.resolve(drop, names)
            names = [n for n in names if n not in gone]
        kinds = {n: next((env[n].kind for _, _, env in reversed(self.outputs) if n in env), self.env[n].kind) for n in names}
        for ref in self.step.outputs:
            frames = []
            for k, (targets, test, env) in enumerate(self.outputs):
                if ref.name not in targets:
                    continue
                df = self.ds.df if test is None else self.ds.df.where(test)
                own = [(env[n] if n in env else (char("") if kinds[n] == "char" else num(None))) for n in names]
                own = [as_char(v) if kinds[n] == "char" else as_num(v) for n, v in zip(names, own, strict=True)]
                frames.append(df.select(*(v.col.alias(renames.get(n, n)) for n, v in zip(names, own, strict=True)), *(F.col(c) for c, _ in self.ds.order), F.lit(float(k)).alias("__k")))
            if not frames:
                frames = [self.ds.df.where("false").select(*((self.env[n] if n in self.env else num(None)).col.alias(renames.get(n, n)) for n in names), *(F.col(c) for c, _ in self.ds.order), F.lit(0.0).alias("__k"))]
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f)
            order = {c: f"__o{i}" for i, (c, _) in enumerate(self.ds.order)}
            df = df.withColumnsRenamed({c: f"{new}_" for c, new in order.items()}).withColumnsRenamed({f"{new}_": new for new in order.values()})
            last = f"__o{len(order)}"
            ds = Dataset(df.withColumnRenamed("__k", last), [(order[c], up) for c, up in self.ds.order] + ([(last, True)] if len(frames) > 1 else []))
            if len(frames) == 1:
                ds = ds.with_df(ds.df.drop(last))
            ds.formats = {renames.get(n, n): f for n, f in (self.ds.formats | self.formats).items() if n in names}
            ds.labels = {renames.get(n, n): f for n, f in (self.ds.labels | self.labels).items() if n in names}
            out[ref.name] = sources.output_options(ds, ref)
        return out


def _replace(body: list[Stmt], name: str, by: str) -> list[Stmt]:
    """body with the array name as a plain variable put in an element's place."""

    def swap(value):
        if value == ("var", name):
            return ("var", by)
        if isinstance(value, tuple):
            return tuple(swap(v) for v in value)
        if isinstance(value, list):
            return [swap(v) for v in value]
        if isinstance(value, dict):
            return {k: swap(v) for k, v in value.items()}
        if isinstance(value, Stmt):
            return Stmt(value.kind, swap(value.args))
        return value

    return [swap(s) for s in body]


__all__ = ["Array", "ColumnStep", "Context", "arrays_of", "expressions", "mentions", "truth", "walk"]
