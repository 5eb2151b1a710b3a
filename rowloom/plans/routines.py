"""User-defined functions and subroutines: put in place as columns, or interpreted by the state machine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.lower import Unsupported
from rowloom.functions.values import Val, as_char, as_num, char, choose, num
from rowloom.language.ast import DataStep, Ref, Stmt
from rowloom.plans.datastep import Array, ColumnStep, Context


@dataclass
class Routine:
    name: str
    params: list[tuple[str, bool, bool]]
    char: bool
    body: list[Stmt]
    outargs: list[str] = field(default_factory=list)


class _Inline(ColumnStep):
    """A routine's body over columns of the calling row; nothing is written to a frame."""

    def __init__(self, routine: Routine, values: list, context: Context):
        super().__init__(DataStep([Ref("result")], routine.body), context)
        self.by, self.descending, self.flags, self.kinds, self.lengths = [], [], [], {}, {}
        self.result: Val | None = None
        self.returns_char = routine.char
        for (name, is_char, is_array), value in zip(routine.params, values, strict=True):
            if is_array:
                names = [f"__a_{name}{k}" for k in range(1, len(value) + 1)]
                self.arrays[name] = Array(names, [(1, len(value))], is_char, False)
                self.env |= dict(zip(names, value, strict=True))
            else:
                self.env[name] = as_char(value) if is_char else as_num(value)

    def flush(self, more=None, keep=None) -> None:
        self.weight = 0

    def _fixed(self, test: Column) -> Column:
        return test

    def _x_return(self, s: Stmt, cond: Column | None) -> None:
        here = cond if self.alive is None else self.alive if cond is None else self.alive & cond
        if s["value"] is not None:
            value = self.lowering(cond).value(s["value"])
            value = as_char(value) if self.returns_char else as_num(value)
            old = self.result or (char("") if self.returns_char else num(None))
            self.result = value if here is None else choose(here, value, old)
        test = F.lit(True) if cond is None else cond
        self.alive = ~test if self.alive is None else self.alive & ~test

    def _put(self, name: str, value: Val, cond: Column | None) -> None:
        live = cond if self.alive is None else self.alive if cond is None else self.alive & cond
        kind = self.env[name].kind if name in self.env else ("num" if value.kind == "bool" else value.kind)
        value = as_char(value) if kind == "char" else as_num(value)
        if name not in self.env:
            self.env[name] = char("") if kind == "char" else num(None)
        self.env[name] = value if live is None else choose(live, value, self.env[name])

    def go(self) -> _Inline:
        self._do([s for s in self.step.body if s.kind not in ("array", "length")], None)
        return self


def inline(routine: Routine, values: list, context: Context) -> Val:
    if len(values) != len(routine.params):
        raise ValueError(f"{routine.name} takes {len(routine.params)} arguments")
    return _Inline(routine, values, context).go().result or (char("") if routine.char else num(None))


def call(routine: Routine, args: list[tuple], value, context: Context) -> dict[str, Val]:
    """What a subroutine leaves in its OUTARGS, by the caller's names."""
    done = _Inline(routine, [value(a) for a in args], context).go()
    return {a[1]: done.env[p[0]] for a, p in zip(args, routine.params, strict=True) if p[0] in routine.outargs and a[0] == "var"}


def interpret(routine: Routine, values: list, functions: dict, want_env: bool = False):
    """Run a routine on plain values."""
    from rowloom.plans import machine as m

    kinds = {p[0]: "char" if p[1] else "num" for p in routine.params}
    arrays, env = {}, {}
    for (name, is_char, is_array), value in zip(routine.params, values, strict=True):
        if is_array:
            names = [f"__a_{name}{k}" for k in range(1, len(value) + 1)]
            arrays[name] = Array(names, [(1, len(value))], is_char, False)
            env |= dict(zip(names, value, strict=True))
        else:
            env[name] = value

    class Body(m.Machine):
        def _s_return(self, s):
            f = self.expr(s["value"]) if s["value"] is not None else lambda: None

            def run():
                self.result = f()
                raise m._Return

            return run

    box = Body(DataStep([Ref("r")], routine.body), kinds, arrays, {}, [], [], functions)
    box.v, box.result = env, None
    try:
        box.body()
    except m._Return:
        pass
    return box.v if want_env else box.result


__all__ = ["Routine", "Unsupported", "call", "inline", "interpret"]
