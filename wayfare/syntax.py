"""Query texts: tokens, a precedence parser, and the tree of queries.

A tree has literals, calls (a bare name is a call without arguments), compositions ``a.b`` and names ``n => q``.  A
pipeline ``q:f(x)`` is the call ``f(q, x)``."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any


class QueryError(Exception):
    """A query that has no meaning: its text, its names or its types."""


@dataclass(frozen=True, eq=False)
class Lit:
    value: Any

    def __eq__(self, other: object) -> bool:  # 1, 1.0 and true are different
        return isinstance(other, Lit) and type(self.value) is type(other.value) and self.value == other.value

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))

    def __str__(self) -> str:
        return "null" if self.value is None else str(self.value).lower() if isinstance(self.value, bool) else f'"{self.value}"' if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class Regex:
    pattern: str

    def __str__(self) -> str:
        return f'r"{self.pattern}"'


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()

    def __str__(self) -> str:
        return self.name + (f"({','.join(map(str, self.args))})" if self.args else "")


@dataclass(frozen=True)
class Compose:
    first: Any
    then: Any

    def __str__(self) -> str:
        return f"{self.first}.{self.then}"


@dataclass(frozen=True)
class Named:
    name: str
    query: Any

    def __str__(self) -> str:
        return f"{self.name}=>{self.query}"


TOKEN = re.compile(r"""\s*(?:(?P<regex>r"(?:[^"\\]|\\.)*")|(?P<str>"(?:[^"\\]|\\.)*")|(?P<float>\d+\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+)|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>=>|<=|>=|==|!=|&&|\|\||[-+*/÷<>&|!.:,()\[\]]))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
#: Binding powers, from loose to tight.
POWERS = {"=>": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "in": 4, ":": 5, "+": 6, "-": 6, "|": 6, "*": 7, "/": 7, "÷": 7, "&": 7, ".": 10, "[": 10}
COMPARE = ("==", "!=", "<", "<=", ">", ">=")
ALIASES = {"||": "|", "&&": "&"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read the query at {text[at : at + 20]!r}")
        kind = m.lastgroup
        if kind == "name" and m.group(kind) == "in":
            kind = "op"
        out.append((kind, m.group(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.ts, self.at = tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.ts[self.at]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.ts[self.at - 1]

    def take(self, op: str) -> None:
        kind, x = self.next()
        if kind != "op" or x != op:
            raise QueryError(f"{op!r} expected before {x or 'the end'!r}")

    def items(self, close: str) -> tuple:
        out = []
        while self.peek() != ("op", close):
            out.append(self.expr(0))
            if self.peek() != ("op", close):
                self.take(",")
        self.take(close)
        return tuple(out)

    def call(self) -> Call:
        kind, name = self.next()
        if kind != "name":
            raise QueryError(f"a name expected before {name or 'the end'!r}")
        if self.peek() == ("op", "("):
            self.next()
            return Call(name, self.items(")"))
        return Call(name)

    def prefix(self) -> Any:
        kind, x = self.peek()
        if kind == "name":
            return {"null": Lit(None), "true": Lit(True), "false": Lit(False)}[self.next()[1]] if x in ("null", "true", "false") else self.call()
        self.next()
        if kind in ("int", "float"):
            value = Lit(int(x) if kind == "int" else float(x))
            follows = self.peek()
            if follows[0] == "name" and follows[1].startswith("_"):  # 3_months
                return Call("*", (value, self.call()))
            return value
        if kind == "str":
            return Lit(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), x[1:-1]))
        if kind == "regex":
            return Regex(x[2:-1].replace('\\"', '"'))
        if x == "(":
            out = self.expr(0)
            self.take(")")
            return out
        if x == "[":
            return Call("array", self.items("]"))
        if x in ("-", "+", "!"):
            return Call(x, (self.expr(8),))
        raise QueryError(f"unexpected {x or 'end'!r}")

    def expr(self, power: int) -> Any:
        left = self.prefix()
        while True:
            kind, op = self.peek()
            p = POWERS.get(op) if kind == "op" else None
            if p is None or p <= power:
                return left
            self.next()
            if op == "=>":
                if not isinstance(left, Call) or left.args:
                    raise QueryError(f"{left} can't be a name")
                left = Named(left.name, self.expr(0))
            elif op == ".":
                if self.peek() == ("op", "("):
                    self.next()
                    left = Compose(left, self.expr(0))
                    self.take(")")
                else:
                    left = Compose(left, self.call())
            elif op == "[":
                left = Call("get", (left, *self.items("]")))
            elif op == ":":
                c = self.call()
                left = Call(c.name, (left, *c.args))
            elif op in COMPARE:
                right = self.expr(p)
                out = Call(op, (left, right))
                while self.peek()[0] == "op" and self.peek()[1] in COMPARE:  # a <= b < c
                    op = self.next()[1]
                    third = self.expr(p)
                    out, right = Call("&", (out, Call(op, (right, third)))), third
                left = out
            else:
                left = Call(ALIASES.get(op, op), (left, self.expr(p)))


def parse(text: str) -> Any:
    p = _Parser(text)
    out = p.expr(0)
    if p.peek()[0] != "end":
        raise QueryError(f"unexpected {p.peek()[1]!r}")
    return out
