"""Tokens of program text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from rowloom.language.dates import date_literal


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str  # name, num, str, op, end
    text: str
    value: object = None
    at: int = 0


_WHERE = re.compile(
    r"""(?P<space>\s+|/\*.*?\*/)
    |(?P<str>'(?:[^']|'')*'(?:dt|d|t|n|x)?(?![A-Za-z0-9_])|"(?:[^"]|"")*"(?:dt|d|t|n|x)?(?![A-Za-z0-9_]))
    |(?P<num>0x[0-9a-f]+|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?(?![A-Za-z_]))
    |(?P<fmt>\$?[A-Za-z_][A-Za-z0-9_]*\.(?:\d+)?(?![A-Za-z_])|\d+\.\d*(?=[\s;)])|\$\d*\.(?:\d*)?)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>\*\*|\|\||!!|\^=|~=|<=|>=|=:|<>|><|[-+*/=<>()\[\]{},;.:&|^~$@#?!%])""",
    re.VERBOSE | re.IGNORECASE | re.DOTALL,
)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        found = _WHERE.match(text, at)
        if not found:
            line = text.count("\n", 0, at) + 1
            raise ParseError(f"line {line}: cannot read {text[at : at + 20]!r}")
        kind, word = found.lastgroup, found.group()
        if kind == "str":
            body = word.rstrip("dDtTnNxX") if word[-1] not in "'\"" else word
            suffix, quote = word[len(body) :].lower(), body[0]
            body = body[1:-1].replace(quote * 2, quote)
            if suffix in ("d", "t", "dt"):
                out.append(Token("num", word, date_literal(body, suffix), at))
            elif suffix == "n":
                out.append(Token("name", body, None, at))
            else:
                out.append(Token("str", word, bytes.fromhex(body).decode("latin-1") if suffix == "x" else body, at))
        elif kind == "num":
            out.append(Token("num", word, float(int(word, 16)) if word.lower().startswith("0x") else float(word), at))
        elif kind == "fmt":
            # first. and last. flags and two-part names are told from formats by what follows
            name = word.rstrip("0123456789")
            if word[0] not in "$0123456789" and found.end() < len(text) and re.match(r"[A-Za-z_]", text[found.end()]):
                out.append(Token("name", name[:-1], None, at))
                out.append(Token("op", ".", None, at))
            else:
                out.append(Token("fmt", word, None, at))
        elif kind != "space":
            out.append(Token(kind, word, None, at))
        at = found.end()
    out.append(Token("end", "", None, at))
    return out
