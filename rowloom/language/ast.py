"""Syntax trees. Expressions are nested tuples: ("num", 1.0), ("str", "x"), ("var", "a"), ("un", op, x), ("bin", op, a, b),
("in", x, [items], negated), ("call", name, [args]), ("at", array, [subscripts]), ("flag", "first", "k"), ("between", x, low, high),
("missing", x, negated), ("of", [names])."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Ref:
    """A dataset with its options."""

    name: str
    keep: list[str] | None = None
    drop: list[str] | None = None
    rename: dict[str, str] = field(default_factory=dict)
    where: tuple | None = None
    firstobs: int | None = None
    obs: int | None = None
    flag: str | None = None
    other: dict[str, object] = field(default_factory=dict)


@dataclass
class Stmt:
    """kind and its parts; see Parser."""

    kind: str
    args: dict[str, object] = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.args.get(key)


@dataclass
class DataStep:
    outputs: list[Ref]
    body: list[Stmt]
    lines: list[str] | None = None


@dataclass
class Proc:
    name: str
    options: dict[str, object]
    statements: list[Stmt]
    text: str = ""


@dataclass
class Global:
    kind: str
    text: str
