"""The macro stage: text to text.

Variables live in scopes, the innermost first. A definition is kept as text and expanded when it is called. Calls, %IF and
%DO are expanded where they stand; what they leave is program text.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from rowloom.language.dates import EPOCH, MONTHS

MOST_TURNS = 100_000


class MacroError(ValueError):
    pass


@dataclass
class Macro:
    params: list[tuple[str, str | None]]
    body: str


def skip_quoted(text: str, at: int) -> int:
    end = text.find(text[at], at + 1)
    return len(text) if end < 0 else end + 1


def closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c in "'\"":
            at = skip_quoted(text, at)
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return at
        at += 1
    raise MacroError("a bracket is not closed")


def split_args(text: str) -> list[str]:
    out, depth, start, at = [], 0, 0, 0
    while at < len(text):
        c = text[at]
        if c in "'\"":
            at = skip_quoted(text, at)
            continue
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:at])
            start = at + 1
        at += 1
    return [*out, text[start:]]


class MacroStage:
    def __init__(self, include: Callable[[str], str] | None = None, log: Callable[[str], None] = print):
        now = dt.datetime.now()
        self.scopes: list[dict[str, str]] = [{"sysdate9": now.strftime("%d%b%Y").upper(), "sysdate": now.strftime("%d%b%y").upper(), "systime": now.strftime("%H:%M")}]
        self.macros: dict[str, Macro] = {}
        self.include = include or (lambda path: open(path, encoding="utf-8").read())
        self.log = log

    # variables

    def get(self, name: str) -> str | None:
        return next((s[name.lower()] for s in reversed(self.scopes) if name.lower() in s), None)

    def set(self, name: str, value: str, glob: bool = False) -> None:
        name = name.lower()
        home = next((s for s in reversed(self.scopes) if name in s), self.scopes[0] if glob else self.scopes[-1])
        home[name] = value

    def resolve(self, text: str) -> str:
        """&name and &&name, scanned again until nothing is left to resolve."""
        for _ in range(50):
            if "&" not in text:
                return text
            out, at, again = [], 0, False
            for found in re.finditer(r"(&+)([A-Za-z_]\w*)(\.?)", text):
                out.append(text[at : found.start()])
                at = found.end()
                marks, name, dot = found.groups()
                if len(marks) > 1:
                    # pairs halve now and resolve in the next scan
                    out.append("&" * (len(marks) // 2) + ("" if len(marks) % 2 == 0 else (self.get(name) or "")) + (name + dot if len(marks) % 2 == 0 else ""))
                    again = True
                    continue
                value = self.get(name)
                out.append("" if value is None else value)
                again = again or "&" in (value or "")
            text_new = "".join(out) + text[at:]
            if not again and text_new == text:
                return text
            text = text_new
        return text

    # expansion

    def expand(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            piece, at = self._next(text, at)
            out.append(piece)
        return "".join(out)

    def _next(self, text: str, at: int) -> tuple[str, int]:
        c = text[at]
        if text.startswith("/*", at):
            end = text.find("*/", at)
            return " ", len(text) if end < 0 else end + 2
        if c == "'":
            end = skip_quoted(text, at)
            return text[at:end], end
        if c == '"':
            end = skip_quoted(text, at)
            return '"' + self.expand(text[at + 1 : end - 1]) + '"', end
        if c == "&":
            found = re.compile(r"(&+[A-Za-z_]\w*\.?)+").match(text, at)
            return (self.resolve(found.group()), found.end()) if found else (c, at + 1)
        if c == "%":
            if text.startswith("%*", at):
                return "", self._semicolon(text, at) + 1
            found = re.compile(r"%([A-Za-z_]\w*)").match(text, at)
            if found:
                return self._word(found[1].lower(), text, at, found.end())
        nxt = re.compile(r"[%&'\"/]").search(text, at + 1)
        end = nxt.start() if nxt else len(text)
        return text[at:end], end

    @staticmethod
    def _semicolon(text: str, at: int) -> int:
        while at < len(text) and text[at] != ";":
            at = skip_quoted(text, at) if text[at] in "'\"" else at + 1
        return at

    def _word(self, word: str, text: str, start: int, at: int) -> tuple[str, int]:
        if word == "macro":
            return "", self._define(text, at)
        if word == "let":
            end = self._semicolon(text, at)
            name, _, value = text[at:end].partition("=")
            self.set(self.expand(name).strip(), self.expand(value).strip())
            return "", end + 1
        if word in ("global", "local"):
            end = self._semicolon(text, at)
            for name in self.expand(text[at:end]).split():
                (self.scopes[0] if word == "global" else self.scopes[-1]).setdefault(name.lower(), "")
            return "", end + 1
        if word == "put":
            end = self._semicolon(text, at)
            self.log(self.expand(text[at:end]).strip())
            return "", end + 1
        if word == "include":
            end = self._semicolon(text, at)
            return self.expand(self.include(self.expand(text[at:end]).strip().strip("'\""))), end + 1
        if word == "if":
            return self._if(text, at)
        if word == "do":
            return self._do(text, at)
        if word in ("end", "mend", "then", "else", "to", "by", "return"):
            end = self._semicolon(text, at)
            return "", end + 1
        if word in ("str", "nrstr", "quote", "bquote", "nrquote", "nrbquote", "superq", "unquote"):
            inside, end = self._bracket(text, at)
            return (inside if word in ("nrstr",) else self.get(inside.strip()) or "" if word == "superq" else self.expand(inside)), end
        if word in FUNCTIONS or word in ("eval", "sysevalf", "sysfunc", "qsysfunc"):
            inside, end = self._bracket(text, at)
            return self._function(word, inside), end
        if word in self.macros:
            return self._call(word, text, at)
        return text[start:at], at

    @staticmethod
    def _bracket(text: str, at: int) -> tuple[str, int]:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text) or text[at] != "(":
            raise MacroError("a bracket is missing")
        end = closing(text, at)
        return text[at + 1 : end], end + 1

    def _define(self, text: str, at: int) -> int:
        found = re.compile(r"\s*([A-Za-z_]\w*)\s*").match(text, at)
        name, at = found[1].lower(), found.end()
        params: list[tuple[str, str | None]] = []
        if at < len(text) and text[at] == "(":
            end = closing(text, at)
            for p in split_args(text[at + 1 : end]):
                key, eq, value = p.partition("=")
                if key.strip():
                    params.append((key.strip().lower(), value.strip() if eq else None))
            at = end + 1
        at = self._semicolon(text, at) + 1
        depth, mark = 1, at
        for f in re.compile(r"%(macro|mend)\b", re.IGNORECASE).finditer(text, at):
            depth += 1 if f[1].lower() == "macro" else -1
            if not depth:
                self.macros[name] = Macro(params, text[mark : f.start()])
                return self._semicolon(text, f.end()) + 1
        raise MacroError(f"%mend is missing for {name}")

    def _call(self, name: str, text: str, at: int) -> tuple[str, int]:
        macro, given, named = self.macros[name], [], {}
        k = at
        while k < len(text) and text[k].isspace():
            k += 1
        if macro.params and k < len(text) and text[k] == "(" or (k == at and k < len(text) and text[k] == "("):
            inside, at = self._bracket(text, k)
            for a in split_args(inside):
                found = re.match(r"\s*([A-Za-z_]\w*)\s*=(?!=)", a)
                if found and any(found[1].lower() == p for p, _ in macro.params):
                    named[found[1].lower()] = self.expand(a[found.end() :]).strip()
                elif a.strip() or given:
                    given.append(self.expand(a).strip())
        scope: dict[str, str] = {}
        positional = [p for p, v in macro.params if v is None]
        if len(given) > len(macro.params):
            raise MacroError(f"{name} takes {len(macro.params)} arguments")
        for p, v in macro.params:
            scope[p] = self.expand(v) if v else ""
        scope |= dict(zip(positional or [p for p, _ in macro.params], given, strict=False)) | named
        self.scopes.append(scope)
        if len(self.scopes) > 200:
            raise MacroError(f"{name} calls itself too often")
        try:
            out = self.expand(macro.body)
        finally:
            self.scopes.pop()
        if at < len(text) and text[at : at + 1] == ";" and not out.strip():
            at += 1
        return out, at

    def _clause(self, text: str, at: int) -> tuple[str, int]:
        """The text of one %THEN or %ELSE branch, and where it ends."""
        while at < len(text) and text[at].isspace():
            at += 1
        found = re.compile(r"%do\s*;", re.IGNORECASE).match(text, at)
        if found:
            body, end = self._block(text, found.end())
            return body, end
        found = re.compile(r"%(?:do|if)\b", re.IGNORECASE).match(text, at)
        if found:
            end = self._skip(text, at)
            return text[at:end], end
        end = self._semicolon(text, at) + 1
        return text[at:end] if re.match(r"%(?:let|put|global|local|include)\b", text[at:], re.IGNORECASE) else text[at : end - 1], end

    def _skip(self, text: str, at: int) -> int:
        """Past a %DO block or an %IF with its branches, without running them."""
        if re.match(r"%do\b", text[at:], re.IGNORECASE):
            return self._block(text, self._semicolon(text, at) + 1)[1]
        then = re.compile(r"%then\b", re.IGNORECASE).search(text, at)
        _, end = self._clause(text, then.end())
        other = re.compile(r"\s*%else\b", re.IGNORECASE).match(text, end)
        return self._clause(text, other.end())[1] if other else end

    def _block(self, text: str, at: int) -> tuple[str, int]:
        """What is between a %DO's semicolon and its %END."""
        depth = 1
        for f in re.compile(r"%(do|end)\b", re.IGNORECASE).finditer(text, at):
            depth += 1 if f[1].lower() == "do" else -1
            if not depth:
                end = self._semicolon(text, f.end())
                return text[at : f.start()], min(end + 1, len(text))
        raise MacroError("%end is missing")

    def _if(self, text: str, at: int) -> tuple[str, int]:
        then = re.compile(r"%then\b", re.IGNORECASE).search(text, at)
        if not then:
            raise MacroError("%then is missing")
        test = self.truth(text[at : then.start()])
        body, end = self._clause(text, then.end())
        other = re.compile(r"\s*%else\b", re.IGNORECASE).match(text, end)
        if other:
            second, end = self._clause(text, other.end())
            body = body if test else second
        elif not test:
            body = ""
        return self.expand(body), end

    def _do(self, text: str, at: int) -> tuple[str, int]:
        end = self._semicolon(text, at)
        head = text[at:end]
        body, after = self._block(text, end + 1)
        out: list[str] = []
        loop = re.match(r"\s*%(while|until)\s*\(", head, re.IGNORECASE)
        if loop:
            test = head[head.index("(") + 1 : closing(head, head.index("("))]
            for turn in range(MOST_TURNS + 1):
                if turn == MOST_TURNS:
                    raise MacroError("a %do loop does not end")
                if loop[1].lower() == "while" and not self.truth(test):
                    break
                out.append(self.expand(body))
                if loop[1].lower() == "until" and self.truth(test):
                    break
            return "".join(out), after
        found = re.match(r"\s*(\S+?)\s*=(.*?)%to\b(.*?)(?:%by\b(.*))?$", head, re.IGNORECASE | re.DOTALL)
        if not found:
            return self.expand(body), after
        name = self.expand(found[1]).strip()
        low, high, step = (int(self.eval(x)) for x in (found[2], found[3], found[4] or "1"))
        for k in range(low, high + (1 if step > 0 else -1), step):
            self.set(name, str(k))
            out.append(self.expand(body))
        self.set(name, str(low + max(0, (high - low) // step + 1) * step))
        return "".join(out), after

    # values

    def truth(self, text: str) -> bool:
        value = self.eval(text)
        return bool(value) if isinstance(value, int | float) else bool(str(value).strip())

    def eval(self, text: str, real: bool = False):
        return Evaluator(self.expand(text), real).value()

    def _function(self, word: str, inside: str) -> str:
        if word == "eval":
            return _plain(self.eval(inside))
        if word == "sysevalf":
            args = split_args(inside)
            value = Evaluator(self.expand(args[0]), True).value()
            kind = self.expand(args[1]).strip().lower() if len(args) > 1 else ""
            if kind and isinstance(value, int | float):
                value = {"ceil": lambda v: -int(-v // 1), "floor": lambda v: int(v // 1), "integer": int, "boolean": lambda v: int(bool(v))}[kind](value)
            return _plain(value)
        if word in ("sysfunc", "qsysfunc"):
            inside = self.expand(inside)
            found = re.match(r"\s*([A-Za-z_]\w*)\s*\(", inside)
            if not found:
                raise MacroError(f"%sysfunc: {inside}")
            end = closing(inside, found.end() - 1)
            rest = inside[end + 1 :].strip().lstrip(",").strip()
            return sysfunc(found[1].lower(), [a.strip() for a in split_args(inside[found.end() : end])] if inside[found.end() : end].strip() else [], rest)
        args = [self.expand(a) for a in split_args(inside)]
        return FUNCTIONS[word](self, args)


def _plain(v) -> str:
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(v)
    return str(v)


def _substr(m: MacroStage, a: list[str]) -> str:
    start = int(m.eval(a[1])) - 1
    return a[0].strip()[start : start + int(m.eval(a[2])) if len(a) > 2 else None]


def _mscan(m: MacroStage, a: list[str]) -> str:
    ends = a[2] if len(a) > 2 else " ,;.-/|*+&!()<>%$^"
    words, n = [w for w in re.split("[" + re.escape(ends) + "]+", a[0].strip()) if w], int(m.eval(a[1]))
    return words[n - 1] if 0 < n <= len(words) else words[n] if n < 0 and -n <= len(words) else ""


FUNCTIONS: dict[str, Callable[[MacroStage, list[str]], str]] = {
    "upcase": lambda m, a: ",".join(a).upper(),
    "qupcase": lambda m, a: ",".join(a).upper(),
    "lowcase": lambda m, a: ",".join(a).lower(),
    "qlowcase": lambda m, a: ",".join(a).lower(),
    "trim": lambda m, a: ",".join(a).rstrip(),
    "qtrim": lambda m, a: ",".join(a).rstrip(),
    "left": lambda m, a: ",".join(a).lstrip(),
    "cmpres": lambda m, a: re.sub(r"\s+", " ", ",".join(a)).strip(),
    "length": lambda m, a: str(len(",".join(a).strip())),
    "substr": _substr,
    "qsubstr": _substr,
    "scan": _mscan,
    "qscan": _mscan,
    "index": lambda m, a: str(a[0].find(a[1].strip()) + 1),
    "symexist": lambda m, a: str(int(m.get(a[0].strip()) is not None)),
}


def _number(text: str) -> float:
    return float(text.strip())


def sysfunc(name: str, args: list[str], fmt: str = "") -> str:
    """The functions that %SYSFUNC knows; others stay as text."""
    day = lambda x: (EPOCH + dt.timedelta(days=int(_number(x)))).date()
    since = lambda d: (d - EPOCH.date()).days
    unit = lambda s: s.strip("'\" ").lower()

    def shifted(u: str, x: str, n: int) -> int:
        if u in ("day", "week"):
            return int(_number(x)) + n * (7 if u == "week" else 1)
        d, per = day(x), {"month": 1, "qtr": 3, "semiyear": 6, "year": 12}[u]
        months = (d.year * 12 + d.month - 1) // per * per + n * per
        return since(dt.date(months // 12, months % 12 + 1, 1))

    def between(u: str, x: str, y: str) -> int:
        a, b = int(_number(x)), int(_number(y))
        if u in ("day", "week"):
            return (b - a) // (7 if u == "week" else 1)
        per = {"month": 1, "qtr": 3, "semiyear": 6, "year": 12}[u]
        months = lambda d: (d.year * 12 + d.month - 1) // per
        return months(day(y)) - months(day(x))

    known = {
        "today": lambda: since(dt.date.today()),
        "date": lambda: since(dt.date.today()),
        "upcase": lambda s: s.upper(),
        "lowcase": lambda s: s.lower(),
        "trim": lambda s: s.rstrip(),
        "strip": lambda s: s.strip(),
        "compress": lambda s, c=None: re.sub(r"\s+", "", s) if c is None else "".join(x for x in s if x not in c),
        "mdy": lambda m, d, y: since(dt.date(int(_number(y)), int(_number(m)), int(_number(d)))),
        "year": lambda x: day(x).year,
        "month": lambda x: day(x).month,
        "day": lambda x: day(x).day,
        "intck": lambda u, x, y: between(unit(u), x, y),
        "intnx": lambda u, x, n, a=None: shifted(unit(u), x, int(_number(n))),
        "putn": lambda x, f: formatted(_number(x), f),
        "inputn": lambda x, f: _read(x, f),
        "abs": lambda x: abs(_number(x)),
        "ceil": lambda x: -int(-_number(x) // 1),
        "floor": lambda x: int(_number(x) // 1),
        "length": lambda s: len(s.rstrip()),
        "countw": lambda s: len(s.split()),
        "scan": lambda s, n: s.split()[int(n) - 1],
        "index": lambda s, w: s.find(w) + 1,
        "reverse": lambda s: s[::-1],
        "tranwrd": lambda s, a, b: s.replace(a, b),
    }
    if name not in known:
        return f"{name}({','.join(args)})"
    value = known[name](*args)
    return formatted(float(value), fmt) if fmt and isinstance(value, int | float) else _plain(value)


def formatted(x: float, fmt: str) -> str:
    base = re.sub(r"[\d.]", "", fmt).lower()
    width = int(re.sub(r"\D", "", fmt.split(".")[0]) or 0)
    decimals = int(fmt.split(".")[1] or 0) if "." in fmt and fmt.split(".")[1].isdigit() else 0
    if base in ("date", "mmddyy", "yymmdd", "ddmmyy", "monyy", "worddate", "year"):
        d = EPOCH + dt.timedelta(days=int(x))
        if base == "date":
            return f"{d.day:02d}{MONTHS[d.month - 1].upper()}{d.year if width != 7 else d.year % 100:02d}"
        wide = "%Y" if width >= 10 else "%y"
        return {"mmddyy": d.strftime(f"%m/%d/{wide}"), "ddmmyy": d.strftime(f"%d/%m/{wide}"), "yymmdd": d.strftime(f"{wide}-%m-%d"), "monyy": f"{MONTHS[d.month - 1].upper()}{d.year}", "worddate": f"{d.strftime('%B')} {d.day}, {d.year}", "year": str(d.year)}[base]
    if base == "comma":
        return f"{x:,.{decimals}f}"
    if base == "dollar":
        return f"${x:,.{decimals}f}"
    if base == "percent":
        return f"{100 * x:.{decimals}f}%"
    if base == "z":
        return f"{x:0{width}.{decimals}f}"
    return f"{x:.{decimals}f}" if decimals or width else _plain(x)


def _read(text: str, fmt: str):
    base = re.sub(r"[\d.]", "", fmt).lower()
    text = text.strip().strip("'\"")
    if base == "date":
        from rowloom.language.dates import date_literal

        return date_literal(text, "d")
    order = {"mmddyy": "mdy", "ddmmyy": "dmy", "yymmdd": "ymd"}.get(base)
    if order:
        got = dict(zip(order, map(int, re.findall(r"\d+", text)), strict=True))
        from rowloom.language.dates import full_year

        return (dt.date(full_year(got["y"]), got["m"], got["d"]) - EPOCH.date()).days
    return float(re.sub(r"[$,%]", "", text))


class Evaluator:
    """Integer or real arithmetic and comparisons on macro text; other text compares as text."""

    WORDS = {"eq": "=", "ne": "^=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "and": "&", "or": "|", "not": "^", "in": "in"}

    def __init__(self, text: str, real: bool = False):
        self.tokens = re.findall(r"\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|'[^']*'|\"[^\"]*\"|\*\*|\^=|~=|<=|>=|[-+*/()<>=&|^~#]|[^\s\-+*/()<>=&|^~]+", text.strip())
        self.k, self.real = 0, real

    def peek(self) -> str:
        return self.WORDS.get(self.tokens[self.k].lower(), self.tokens[self.k]) if self.k < len(self.tokens) else ""

    def take(self, *ops: str) -> str:
        if self.peek() in ops:
            self.k += 1
            return self.WORDS.get(self.tokens[self.k - 1].lower(), self.tokens[self.k - 1])
        return ""

    def value(self):
        out = self.either()
        if self.k < len(self.tokens):
            out = " ".join([_plain(out), *self.tokens[self.k :]])
        return out

    def either(self):
        left = self.both()
        while self.take("|"):
            right = self.both()
            left = int(_true(left) or _true(right))
        return left

    def both(self):
        left = self.negated()
        while self.take("&"):
            right = self.negated()
            left = int(_true(left) and _true(right))
        return left

    def negated(self):
        return int(not _true(self.negated())) if self.take("^", "~") else self.compared()

    def compared(self):
        left = self.sum()
        while op := self.take("=", "^=", "~=", "<", "<=", ">", ">="):
            right = self.sum() if self.peek() not in ("", "&", "|", ")") else ""
            a, b = (left, right) if isinstance(left, int | float) and isinstance(right, int | float) else (str(_plain(left)), str(_plain(right)))
            left = int({"=": a == b, "^=": a != b, "~=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
        return left

    def sum(self):
        left = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            left = self.number(left) + self.number(right) if op == "+" else self.number(left) - self.number(right)
        return left

    def product(self):
        left = self.power()
        while op := self.take("*", "/"):
            right = self.number(self.power())
            left = self.number(left)
            if op == "*":
                left = left * right
            elif not right:
                raise MacroError("division by zero")
            else:
                left = left / right if self.real else int(left / right)
        return left

    def power(self):
        if self.take("-"):
            return -self.number(self.power())
        if self.take("+"):
            return self.power()
        base = self.atom()
        return self.number(base) ** self.number(self.power()) if self.take("**") else base

    def atom(self):
        if self.take("("):
            out = self.either()
            self.take(")")
            return out
        if self.k >= len(self.tokens) or self.peek() in ("=", "^=", "<", ">", "<=", ">=", "&", "|", ")"):
            return ""
        word = self.tokens[self.k]
        self.k += 1
        if re.fullmatch(r"\d+", word):
            return float(word) if self.real else int(word)
        if re.fullmatch(r"\d*\.?\d+(?:[eE][+-]?\d+)?|\d+\.", word):
            return float(word) if self.real else word
        return word

    def number(self, v):
        if isinstance(v, int | float):
            return v
        raise MacroError(f"a number is needed, not {v!r}")


def _true(v) -> bool:
    return bool(v) if isinstance(v, int | float) else bool(str(v).strip())
