"""Program text to steps."""

from __future__ import annotations

import re

from rowloom.language.ast import DataStep, Global, Proc, Ref, Stmt
from rowloom.language.tokens import ParseError, Token, tokenize

COMPARE = {"=": "=", "eq": "=", "^=": "^=", "~=": "^=", "ne": "^=", "<": "<", "lt": "<", "<=": "<=", "le": "<=", ">": ">", "gt": ">", ">=": ">=", "ge": ">=", "=:": "=:", "?": "contains", "contains": "contains", "like": "like"}


def dataset_name(parts: list[str]) -> str:
    """work.x is x, lib.x is lib.x; names are lower-cased."""
    parts = [p.lower() for p in parts]
    return parts[-1] if len(parts) == 1 or parts[0] == "work" else ".".join(parts)


class Cursor:
    """Tokens of one statement or step, with expression parsing."""

    def __init__(self, tokens: list[Token], source: str = ""):
        self.tokens, self.k, self.source = tokens, 0, source

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.k + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.peek()
        self.k += 1
        return token

    def at(self, *words: str) -> bool:
        return self.peek().kind in ("name", "op") and self.peek().text.lower() in words

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.k += 1
            return True
        return False

    def expect(self, *words: str) -> Token:
        if not self.at(*words):
            line = self.source.count("\n", 0, self.peek().at) + 1
            raise ParseError(f"line {line}: expected {' or '.join(words)}, found {self.peek().text!r}")
        return self.next()

    def name(self) -> str:
        token = self.next()
        if token.kind == "fmt" and token.text.endswith("."):
            self.k -= 1
            self.tokens[self.k] = Token("op", ".", None, token.at)
            return token.text[:-1].lower()
        if token.kind != "name":
            line = self.source.count("\n", 0, token.at) + 1
            raise ParseError(f"line {line}: expected a name, found {token.text!r}")
        return token.text.lower()

    def done(self) -> bool:
        return self.peek().kind == "end" or self.at(";")

    # expressions, loosest first

    def expression(self) -> tuple:
        left = self._and()
        while self.take("or", "|", "!"):
            left = ("bin", "or", left, self._and())
        return left

    def _and(self) -> tuple:
        left = self._not()
        while self.take("and", "&"):
            left = ("bin", "and", left, self._not())
        return left

    def _not(self) -> tuple:
        if self.take("not", "^", "~"):
            return ("un", "not", self._not())
        return self._compare()

    def _compare(self) -> tuple:
        left = self._concat()
        parts = []
        while True:
            negated = self.at("not") and self.peek(1).text.lower() in ("in", "between", "like", "contains")
            if negated:
                self.k += 1
            word = self.peek().text.lower() if self.peek().kind in ("name", "op") else ""
            if word in COMPARE:
                self.k += 1
                if self.take(":"):
                    word = "=:"
                right = self._concat()
                test = ("bin", COMPARE[word], left, right)
                left_next = right
            elif word == "in":
                self.k += 1
                test, left_next = ("in", left, self._list(), False), left
            elif word == "between":
                self.k += 1
                low = self._concat()
                self.expect("and")
                test, left_next = ("between", left, low, self._concat()), left
            elif word == "is":
                self.k += 1
                no = self.take("not")
                self.expect("missing", "null")
                test, left_next = ("missing", left, no), left
            else:
                break
            parts.append(("un", "not", test) if negated else test)
            left = left_next
        if not parts:
            return left
        out = parts[0]
        for p in parts[1:]:  # a < b < c
            out = ("bin", "and", out, p)
        return out

    def _list(self) -> list[tuple]:
        self.expect("(")
        items = []
        while not self.take(")"):
            item = self._concat()
            if self.take(":") and item[0] == "num":
                high = self._concat()
                items += [("num", float(v)) for v in range(int(item[1]), int(high[1]) + 1)]
            else:
                items.append(item)
            self.take(",")
        return items

    def _concat(self) -> tuple:
        left = self._sum()
        while self.take("||", "!!"):
            left = ("bin", "||", left, self._sum())
        return left

    def _sum(self) -> tuple:
        left = self._product()
        while self.at("+", "-"):
            left = ("bin", self.next().text, left, self._product())
        return left

    def _product(self) -> tuple:
        left = self._unary()
        while self.at("*", "/"):
            left = ("bin", self.next().text, left, self._unary())
        return left

    def _unary(self) -> tuple:
        if self.take("-"):
            return ("un", "-", self._unary())
        if self.take("+"):
            return self._unary()
        base = self._extreme()
        if self.take("**"):
            return ("bin", "**", base, self._unary())
        return base

    def _extreme(self) -> tuple:
        left = self._primary()
        while self.at("<>", "><") or (self.at("min", "max") and self.peek(1).text != "("):
            word = self.next().text.lower()
            left = ("call", "max" if word in ("<>", "max") else "min", [left, self._primary()])
        return left

    def _primary(self) -> tuple:
        token = self.next()
        if token.kind == "num":
            return ("num", token.value)
        if token.kind == "str":
            return ("str", token.value)
        if token.kind == "fmt" and token.text.replace(".", "").isdigit():
            return ("num", float(token.text))
        if token.text == "(":
            inside = self.expression()
            self.expect(")")
            return inside
        if token.text == ".":
            return ("num", None)
        if token.kind == "fmt":
            return ("fmt", token.text)
        if token.text == "$" and self.peek().kind in ("fmt", "name"):
            return ("fmt", "$" + self.next().text)
        if token.kind != "name":
            line = self.source.count("\n", 0, token.at) + 1
            raise ParseError(f"line {line}: unexpected {token.text!r}")
        name = token.text.lower()
        if self.at("."):
            self.k += 1
            if name in ("first", "last"):
                return ("flag", name, self.name())
            member = self.name()
            if self.at("("):
                return ("method", name, member, self._method_args())
            return ("var", f"{name}.{member}")
        if self.at("("):
            self.k += 1
            return ("call", name, self._args())
        if self.at("[", "{"):
            close = {"[": "]", "{": "}"}[self.next().text]
            subs = [self.expression()] if not self.take("*") else [("all",)]
            while self.take(","):
                subs.append(self.expression())
            self.expect(close)
            return ("at", name, subs)
        return ("var", name)

    def _args(self) -> list[tuple]:
        args = []
        while not self.take(")"):
            if self.at("of") and self.peek(1).kind == "name":
                self.k += 1
                args.append(("of", self.variable_list(")", ",")))
            elif self.at(","):
                args.append(("num", None))
            elif self.at("*"):
                self.k += 1
                args.append(("all",))
            else:
                args.append(self.expression())
            self.take(",")
        return args

    def _method_args(self) -> dict[str, object]:
        self.expect("(")
        out: dict[str, object] = {}
        plain = 0
        while not self.take(")"):
            if self.peek().kind == "name" and self.peek(1).text == ":":
                key = self.name()
                self.k += 1
            else:
                key, plain = str(plain), plain + 1
            value = self.expression()
            out.setdefault(key, []).append(value) if key in ("key", "data") else out.__setitem__(key, value)
            self.take(",")
        return out

    def variable_list(self, *stops: str) -> list[str]:
        """Names and ranges: a b x1-x5 arr[*]; a--c and prefix: stay as they are, to be resolved with the columns."""
        out: list[str] = []
        while not self.done() and not self.at(*stops):
            if self.peek().kind != "name" and self.peek().kind != "fmt":
                break
            name = self.name()
            if self.at("-") and self.peek(1).text == "-":
                self.k += 2
                out.append(f"{name}--{self.name()}")
            elif self.at("-"):
                self.k += 1
                out += name_range(name, self.name())
            elif self.take(":"):
                out.append(f"{name}:")
            elif self.at("[", "{") and self.peek(1).text == "*":
                self.k += 3
                out.append(f"{name}[*]")
            else:
                out.append(name)
        return out

    def ref(self) -> Ref:
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        ref = Ref(dataset_name(parts))
        if self.at("(") :
            self.k += 1
            while not self.take(")"):
                self._option(ref)
        return ref

    def _option(self, ref: Ref) -> None:
        key = self.name()
        self.expect("=")
        if key in ("keep", "drop"):
            setattr(ref, key, self.variable_list(")", *_OPTIONS) if not self._next_is_option() else [])
        elif key == "rename":
            self.expect("(")
            while not self.take(")"):
                old = self.name()
                self.expect("=")
                ref.rename[old] = self.name()
        elif key == "where":
            self.expect("(")
            ref.where = self.expression()
            self.expect(")")
        elif key in ("firstobs", "obs"):
            token = self.next()
            setattr(ref, key, None if token.text.lower() == "max" else int(token.value))
        elif key == "in":
            ref.flag = self.name()
        else:
            token = self.next()
            ref.other[key] = token.value if token.kind in ("num", "str") else token.text.lower()

    def _next_is_option(self) -> bool:
        return self.peek(1).text == "=" and self.peek().text.lower() in _OPTIONS


_OPTIONS = ("keep", "drop", "rename", "where", "firstobs", "obs", "in", "label", "compress")


def name_range(low: str, high: str) -> list[str]:
    """x1, x3 make x1 x2 x3; a, c make a b c."""
    a, b = re.fullmatch(r"(.*?)(\d+)", low), re.fullmatch(r"(.*?)(\d+)", high)
    if a and b and a[1] == b[1]:
        width = len(a[2]) if a[2].startswith("0") else 0
        return [f"{a[1]}{str(n).zfill(width)}" for n in range(int(a[2]), int(b[2]) + 1)]
    if len(low) == len(high) == 1 and low <= high:
        return [chr(c) for c in range(ord(low), ord(high) + 1)]
    raise ParseError(f"not a range of names: {low}-{high}")


class Parser:
    """Statements of a step. Each has a kind and parts:

    set/merge/update refs, key, point, nobs, end; by names, descending; where/subset test; assign target, value;
    add target, value; if test, then, other; do body, var, items, while, until; select value, cases, other; output names;
    array names, sizes, char, temporary, initial; retain names, initial; call name, args; hash name, options; ...
    """

    def __init__(self, source: str):
        self.source = source

    def program(self) -> list:
        steps, at = [], 0
        for begin, end in step_spans(self.source):
            at = end
            piece = self.source[begin:end]
            word = piece.split(None, 1)[0].lower().rstrip(";") if piece.strip() else ""
            if word == "data":
                steps.append(self.data_step(piece))
            elif word == "proc":
                steps.append(self.proc(piece))
            elif word:
                steps.append(Global(word, piece.strip().rstrip(";").strip()))
        return steps

    def data_step(self, text: str) -> DataStep:
        found = re.search(r"(?:^|;)\s*(datalines|cards|lines)\s*;[^\n]*\n", text, re.IGNORECASE)
        lines = None
        if found:
            lines = text[found.end() :].split("\n")
            lines = lines[: next((k for k, x in enumerate(lines) if x.strip().startswith(";")), len(lines))]
            text = text[: found.start()] + ";"
        c = Cursor(tokenize(text), text)
        c.expect("data")
        outputs = []
        while not c.take(";"):
            outputs.append(c.ref())
        body = []
        while c.peek().kind != "end":
            if c.take(";"):
                continue
            if c.at("run") and c.peek(1).text == ";":
                break
            body.append(self.statement(c))
        return DataStep(outputs or [Ref("data1")], body, lines)

    def block(self, c: Cursor, *ends: str) -> list[Stmt]:
        body = []
        while not c.at(*ends):
            if c.peek().kind == "end":
                raise ParseError(f"{' or '.join(ends)} is missing")
            if not c.take(";"):
                body.append(self.statement(c))
        return body

    def statement(self, c: Cursor) -> Stmt:
        word = c.peek().text.lower()
        follow = c.peek(1).text
        method = getattr(self, f"_s_{word}", None) if c.peek().kind == "name" and follow != "=" and not (follow in ("+", "[", "{") and word not in ("do", "put", "input", "by")) else None
        if method:
            c.k += 1
            return method(c)
        return self._other(c)

    def end(self, c: Cursor) -> None:
        if c.peek().kind != "end":
            c.expect(";")

    def _other(self, c: Cursor) -> Stmt:
        if c.peek().kind == "name" and c.peek(1).text in (".",) or c.peek().kind == "fmt":
            value = c.expression()
            self.end(c)
            return Stmt("do_method", {"value": value})
        name = c.name()
        target: tuple = ("var", name)
        if c.at("[", "{", "("):
            c.k -= 1
            target = c._primary()
            if target[0] == "call":
                target = ("at", target[1], target[2])
        if c.take("="):
            value = c.expression()
            self.end(c)
            return Stmt("assign", {"target": target, "value": value})
        if c.take("+"):
            value = c.expression()
            self.end(c)
            return Stmt("add", {"target": target, "value": value})
        # statements without effect here are skipped to their end
        while not c.done():
            c.next()
        self.end(c)
        return Stmt("skip", {"word": name})

    def _refs(self, c: Cursor, kind: str) -> Stmt:
        refs, extra = [], {}
        while not c.done():
            if c.peek().text.lower() in ("key", "point", "nobs", "end", "curobs") and c.peek(1).text == "=":
                key = c.name()
                c.k += 1
                extra[key] = c.name()
                c.take("/") and c.name()
            else:
                refs.append(c.ref())
        self.end(c)
        return Stmt(kind, {"refs": refs, **extra})

    def _s_set(self, c: Cursor) -> Stmt:
        return self._refs(c, "set")

    def _s_merge(self, c: Cursor) -> Stmt:
        return self._refs(c, "merge")

    def _s_update(self, c: Cursor) -> Stmt:
        return self._refs(c, "update")

    def _s_by(self, c: Cursor) -> Stmt:
        names, down = [], []
        while not c.done():
            down.append(c.take("descending"))
            names.append(c.name())
            if c.take("-"):
                more = name_range(names.pop(), c.name())
                down = down[:-1] + [down[-1]] * len(more)
                names += more
        names_, down_ = [n for n in names if n != "notsorted"], [d for n, d in zip(names, down, strict=True) if n != "notsorted"]
        self.end(c)
        return Stmt("by", {"names": names_, "descending": down_})

    def _s_where(self, c: Cursor) -> Stmt:
        test = c.expression()
        self.end(c)
        return Stmt("where", {"test": test})

    def _s_if(self, c: Cursor) -> Stmt:
        test = c.expression()
        if not c.take("then"):
            self.end(c)
            return Stmt("subset", {"test": test})
        then = [] if c.take(";") else [self.statement(c)]
        other = None
        while c.at(";"):
            c.k += 1
        if c.take("else"):
            other = [] if c.take(";") else [self.statement(c)]
        return Stmt("if", {"test": test, "then": then, "other": other or []})

    def _s_do(self, c: Cursor) -> Stmt:
        if c.take(";"):
            body = self.block(c, "end")
            c.expect("end")
            self.end(c)
            return Stmt("do", {"body": body})
        if c.at("over"):
            c.k += 1
            over = c.name()
            self.end(c)
            body = self.block(c, "end")
            c.expect("end")
            self.end(c)
            return Stmt("do", {"body": body, "over": over})
        args: dict[str, object] = {}
        if c.at("while", "until") and c.peek(1).text == "(":
            word = c.name()
            args[word] = c._primary()
        else:
            args["var"] = c.name()
            c.expect("=")
            items = []
            while True:
                low = c.expression()
                item = [low, None, None]
                while c.at("to", "by"):
                    word = c.name()
                    item[1 if word == "to" else 2] = c.expression()
                items.append(tuple(item))
                if not c.take(","):
                    break
            args["items"] = items
            while c.at("while", "until"):
                word = c.name()
                args[word] = c._primary()
        self.end(c)
        args["body"] = self.block(c, "end")
        c.expect("end")
        self.end(c)
        return Stmt("do", args)

    def _s_select(self, c: Cursor) -> Stmt:
        value = c._primary() if c.at("(") else None
        self.end(c)
        cases, other = [], None
        while not c.take("end"):
            if c.take(";"):
                continue
            if c.take("otherwise"):
                other = [] if c.take(";") else [self.statement(c)]
                continue
            c.expect("when")
            c.expect("(")
            tests = [c.expression()]
            while c.take(","):
                tests.append(c.expression())
            c.expect(")")
            cases.append((tests, [] if c.take(";") else [self.statement(c)]))
        self.end(c)
        return Stmt("select", {"value": value, "cases": cases, "other": other or []})

    def _s_output(self, c: Cursor) -> Stmt:
        names = []
        while not c.done():
            names.append(c.ref().name)
        self.end(c)
        return Stmt("output", {"names": names})

    def _plain(self, c: Cursor, kind: str) -> Stmt:
        while not c.done():
            c.next()
        self.end(c)
        return Stmt(kind)

    def _s_delete(self, c: Cursor) -> Stmt:
        return self._plain(c, "delete")

    def _s_return(self, c: Cursor) -> Stmt:
        value = None if c.done() else c.expression()
        self.end(c)
        return Stmt("return", {"value": value})

    def _s_stop(self, c: Cursor) -> Stmt:
        return self._plain(c, "stop")

    def _s_abort(self, c: Cursor) -> Stmt:
        return self._plain(c, "abort")

    def _s_leave(self, c: Cursor) -> Stmt:
        return self._plain(c, "leave")

    def _s_continue(self, c: Cursor) -> Stmt:
        return self._plain(c, "continue")

    def _s_keep(self, c: Cursor) -> Stmt:
        names = c.variable_list()
        self.end(c)
        return Stmt("keep", {"names": names})

    def _s_drop(self, c: Cursor) -> Stmt:
        names = c.variable_list()
        self.end(c)
        return Stmt("drop", {"names": names})

    def _s_rename(self, c: Cursor) -> Stmt:
        pairs = {}
        while not c.done():
            old = c.name()
            c.expect("=")
            pairs[old] = c.name()
        self.end(c)
        return Stmt("rename", {"pairs": pairs})

    def _s_retain(self, c: Cursor) -> Stmt:
        items: list[tuple[str, object]] = []
        while not c.done():
            names = []
            while c.peek().kind == "name":
                names += self._one_range(c)
            value = None
            if not c.done():
                if c.take("("):
                    values = []
                    while not c.take(")"):
                        values.append(c._unary())
                        c.take(",")
                    items += list(zip(names, values, strict=False))
                    continue
                value = c._unary()
            items += [(n, value) for n in names]
        self.end(c)
        return Stmt("retain", {"items": items})

    @staticmethod
    def _one_range(c: Cursor) -> list[str]:
        name = c.name()
        if c.at("-") and c.peek(1).kind == "name":
            c.k += 1
            return name_range(name, c.name())
        return [name]

    def _s_array(self, c: Cursor) -> Stmt:
        name, sizes = c.name(), None
        if c.at("[", "{", "("):
            close = {"[": "]", "{": "}", "(": ")"}[c.next().text]
            sizes = []
            while not c.take(close):
                if c.take("*"):
                    sizes = None
                    c.expect(close)
                    break
                low = c._unary()
                if c.take(":"):
                    sizes.append((int(_constant(low)), int(_constant(c._unary()))))
                else:
                    sizes.append((1, int(_constant(low))))
                c.take(",")
        char = c.take("$")
        if char and c.peek().kind in ("num", "fmt"):
            c.next()
        temporary, names = False, []
        while c.peek().kind == "name":
            if c.at("_temporary_"):
                temporary = bool(c.next())
            else:
                names += self._one_range(c)
                if c.at("-") and c.peek(1).text == "-":
                    c.k += 2
                    names[-1] = f"{names[-1]}--{c.name()}"
        initial: list[tuple] = []
        if c.take("("):
            depth = 1
            while depth:
                if c.take("("):
                    depth += 1
                elif c.take(")"):
                    depth -= 1
                elif not c.take(","):
                    value = c._unary()
                    if value[0] == "num" and c.take("*"):
                        initial += [c._unary()] * int(value[1])
                    else:
                        initial.append(value)
        self.end(c)
        return Stmt("array", {"name": name, "sizes": sizes, "char": char, "temporary": temporary, "names": names, "initial": initial})

    def _s_length(self, c: Cursor) -> Stmt:
        items, names = {}, []
        while not c.done():
            if c.peek().kind == "name":
                names += self._one_range(c)
                continue
            char = c.take("$") or c.peek().text.startswith("$")
            token = c.next() if c.peek().kind in ("num", "fmt") else None
            size = int(re.sub(r"\D", "", token.text) or 8) if token else 8
            items |= {n: (char, size) for n in names}
            names = []
        self.end(c)
        return Stmt("length", {"items": items})

    def _s_format(self, c: Cursor) -> Stmt:
        items, names = {}, []
        while not c.done():
            if c.peek().kind == "name" and c.peek(1).text != ".":
                names += self._one_range(c)
                continue
            text = c.next().text
            if text == "$":
                text += c.next().text
            if not text.endswith(".") and c.at("."):
                text += c.next().text
            items |= {n: text for n in names}
            names = []
        self.end(c)
        return Stmt("format", {"items": items})

    def _s_informat(self, c: Cursor) -> Stmt:
        return Stmt("informat", self._s_format(c).args)

    def _s_label(self, c: Cursor) -> Stmt:
        items = {}
        while not c.done():
            name = c.name()
            c.expect("=")
            items[name] = c.next().value
        self.end(c)
        return Stmt("label", {"items": items})

    def _s_attrib(self, c: Cursor) -> Stmt:
        items: dict[str, dict] = {}
        while not c.done():
            name = c.name()
            own = items.setdefault(name, {})
            while c.at("label", "format", "length", "informat") and c.peek(1).text == "=":
                key = c.name()
                c.k += 1
                token = c.next()
                text = token.value if token.kind == "str" else token.text
                if text == "$":
                    text += c.next().text
                own[key] = text
        self.end(c)
        return Stmt("attrib", {"items": items})

    def _s_infile(self, c: Cursor) -> Stmt:
        token = c.next()
        args: dict[str, object] = {"path": token.value if token.kind == "str" else token.text.lower()}
        while not c.done():
            key = c.name()
            args[key] = True
            if c.take("="):
                value = c.next()
                args[key] = value.value if value.kind in ("num", "str") else value.text
        self.end(c)
        return Stmt("infile", args)

    def _s_file(self, c: Cursor) -> Stmt:
        token = c.next()
        args: dict[str, object] = {"path": token.value if token.kind == "str" else token.text.lower()}
        while not c.done():
            key = c.name()
            args[key] = True
            if c.take("="):
                args[key] = c.next().value
        self.end(c)
        return Stmt("file", args)

    def _s_input(self, c: Cursor) -> Stmt:
        """items: ("var", name, char, format, low, high), ("col", n), ("skip", n), ("line", n or None)."""
        items: list[tuple] = []
        while not c.done():
            if c.take("@"):
                if c.take("@") or c.done():
                    continue
                items.append(("col", int(c.next().value)))
            elif c.take("+"):
                items.append(("skip", int(c.next().value)))
            elif c.take("/"):
                items.append(("line", None))
            elif c.take("#"):
                items.append(("line", int(c.next().value)))
            else:
                for name in self._one_range(c):
                    c.take(":")
                    char, fmt, low, high = False, None, None, None
                    if c.take("$"):
                        char = True
                        if c.peek().kind == "fmt":
                            fmt = "$" + c.next().text
                        elif c.peek().kind == "name" and c.peek(1).kind == "fmt":
                            fmt = "$" + c.next().text
                    if c.peek().kind == "fmt":
                        fmt = c.next().text
                        char = char or fmt.startswith("$")
                    elif c.peek().kind == "num" and float(c.peek().value).is_integer() and "." not in c.peek().text:
                        low = high = int(c.next().value)
                        if c.take("-"):
                            high = int(c.next().value)
                    elif c.peek().kind == "num":
                        fmt = c.next().text
                    items.append(("var", name, char, fmt, low, high))
        self.end(c)
        return Stmt("input", {"items": items})

    def _s_put(self, c: Cursor) -> Stmt:
        items: list[tuple] = []
        while not c.done():
            if c.peek().kind == "str":
                items.append(("text", c.next().value))
            elif c.at("@", "/", "+"):
                if c.next().text == "/":
                    items.append(("line",))
                elif c.peek().kind == "num":
                    c.next()
            elif c.at("_all_"):
                c.next()
                items.append(("all",))
            else:
                value = c._primary()
                if c.take("="):
                    items.append(("named", value))
                else:
                    fmt = None
                    if not c.take("$") and c.peek().kind == "fmt":
                        fmt = c.next().text
                    items.append(("value", value, fmt))
        self.end(c)
        return Stmt("put", {"items": items})

    def _s_call(self, c: Cursor) -> Stmt:
        name = c.name()
        args: list[tuple] = []
        if c.take("("):
            args = c._args()
        self.end(c)
        return Stmt("call", {"name": name, "args": args})

    def _s_declare(self, c: Cursor) -> Stmt:
        kind, name = c.name(), c.name()
        options = c._method_args() if c.at("(") else {}
        self.end(c)
        return Stmt("declare", {"type": kind, "name": name, "options": options})

    _s_dcl = _s_declare

    def _s_run(self, c: Cursor) -> Stmt:
        return self._plain(c, "skip")

    # procedures: options, then statements as words and tokens

    def proc(self, text: str) -> Proc:
        c = Cursor(tokenize(_before_sql(text)), text)
        c.expect("proc")
        name = c.name()
        if name == "sql":
            body = text[text.index(";") + 1 :]
            return Proc("sql", {}, [], re.sub(r"(?is)(^|;)\s*(?:quit|run)\s*;?\s*$", r"\1", body))
        options: dict[str, object] = {"flags": []}
        while not c.done():
            if c.peek().kind in ("name",) and c.peek(1).text == "=":
                key = c.name()
                c.k += 1
                if c.peek().kind == "name" and key in ("data", "out", "base", "compare", "dupout", "lookup", "outp", "cntlin", "outtree", "outsurv", "outest", "outstat"):
                    options[key] = c.ref()
                elif c.peek().kind in ("num", "str"):
                    options[key] = c.next().value
                elif c.at("("):
                    c.k += 1
                    values = []
                    while not c.take(")"):
                        token = c.next()
                        values.append(token.value if token.kind in ("num", "str") else token.text.lower())
                    options[key] = values
                else:
                    sign = -1 if c.take("-") else 1
                    token = c.next()
                    options[key] = sign * token.value if token.kind == "num" else token.text.lower().rstrip(".")
            elif c.take("("):
                while not c.take(")"):
                    key = c.name()
                    if c.take("="):
                        options[key] = c.next().value
            else:
                token = c.next()
                options["flags"].append(token.text.lower())
        self.end(c)
        statements = []
        while c.peek().kind != "end":
            if c.take(";") or (c.at("run", "quit") and c.peek(1).text in (";", "") and (c.next(), True)[1]):
                continue
            word = c.name()
            if name == "report" and word == "compute" or name == "fcmp" and word in ("function", "subroutine"):
                statements.append(self._routine(c, word))
                continue
            begin = c.peek().at
            tokens = []
            while not c.done():
                tokens.append(c.next())
            statements.append(Stmt(word, {"tokens": [*tokens, Token("end", "")], "text": text[begin : c.peek().at].strip()}))
            self.end(c)
        return Proc(name, options, statements, text)

    def _routine(self, c: Cursor, word: str) -> Stmt:
        name = c.name() if not c.done() else ""
        params: list[tuple[str, bool, bool]] = []
        if c.take("("):
            while not c.take(")"):
                param = c.name()
                array = bool(c.take("[") and c.take("*") and c.take("]"))
                params.append((param, c.take("$"), array))
                c.take(",")
        char = c.take("$") or c.peek().text.startswith("$")
        while not c.done():
            c.next()
        self.end(c)
        outargs: list[str] = []
        if c.at("outargs"):
            c.k += 1
            while not c.done():
                outargs.append(c.name())
                c.take(",")
            self.end(c)
        stop = "endcomp" if word == "compute" else "endsub"
        body = self.block(c, stop)
        c.expect(stop)
        self.end(c)
        return Stmt(word, {"name": name, "params": params, "char": char, "outargs": outargs, "body": body})


def _constant(value: tuple) -> float:
    return -_constant(value[2]) if value[0] == "un" else value[1]


def _before_sql(text: str) -> str:
    return text[: text.index(";") + 1] if re.match(r"\s*proc\s+sql\b", text, re.IGNORECASE) else text


_STEP = re.compile(r"(data|proc)\b(?!\s*=)", re.IGNORECASE)


def step_spans(text: str) -> list[tuple[int, int]]:
    """Where steps and global statements begin and end: a step ends after run; or quit;, or where the next begins."""
    out, at, begin, sql = [], 0, None, False
    while at < len(text):
        start = at
        while start < len(text) and text[start].isspace():
            start += 1
        if text.startswith("/*", start):
            at = text.find("*/", start) + 2
            if at < 2:
                break
            continue
        if start >= len(text):
            break
        if text[start] == "*":  # a comment statement
            at = (text.find(";", start) + 1) or len(text)
            continue
        end = statement_end(text, start)
        word = re.match(r"[A-Za-z_]*", text[start:])[0].lower()
        if _STEP.match(text, start) and not sql:
            if begin is not None:
                out.append((begin, start))
            begin = start
            sql = bool(re.match(r"proc\s+sql\b", text[start:], re.IGNORECASE))
        elif word in ("datalines", "cards", "lines") and begin is not None:
            line = text.find("\n", end)
            close = re.compile(r"^\s*;", re.MULTILINE).search(text, line if line >= 0 else end)
            end = close.end() if close else len(text)
            out.append((begin, end))
            begin = None
        elif word in ("run", "quit") and re.match(r"(run|quit)\s*;", text[start:], re.IGNORECASE):
            if begin is not None and not (sql and word == "run"):
                out.append((begin, end))
                begin, sql = None, False
        elif begin is None:
            out.append((start, end))
        at = end
    if begin is not None:
        out.append((begin, len(text)))
    return out


def statement_end(text: str, at: int) -> int:
    """Past the next semicolon outside quotes and comments."""
    while at < len(text):
        c = text[at]
        if c in "'\"":
            at = text.find(c, at + 1)
            if at < 0:
                return len(text)
        elif text.startswith("/*", at):
            at = text.find("*/", at) + 1
            if at < 1:
                return len(text)
        elif c == ";":
            return at + 1
        at += 1
    return len(text)
