"""The filter language: text to tokens to a tree.

    expression := term (("AND" | "OR") term)*      one precedence, to the left
    term       := "(" expression ")" | factor
    factor     := "NOT" factor | name comparator literal

An operator at the end of the text has an empty right side, which matches nothing. ``strict`` accepts only words parted by
white space, each with one parenthesis on either side at most and literals without a sign; otherwise free spacing, nested
parentheses, ``NOT (...)``, negative numbers and strings with spaces or parentheses are understood too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

COMPARATORS = ("=", "!=", ">", "<", ">=", "<=")
_KINDS = [("(", r"\("), (")", r"\)"), ("cmp", r"!=|>=|<=|=|>|<"), ("bool", r"(?:AND|OR|NOT)(?!\w)"), ("double", r"\d+\.\d+(?!\w)"), ("long", r"\d+(?!\w)"), ("string", r'"[^"]*"'), ("name", r"\w+")]
_FREE = re.compile(r"\s*(?:" + "|".join(f"(?P<k{i}>{('-?' if k in ('long', 'double') else '') + p})" for i, (k, p) in enumerate(_KINDS)) + r"|(?P<end>\Z))")
_STRICT = [(k, re.compile(p)) for k, p in _KINDS]


class FilterSyntaxError(ValueError):
    """The filter text is not in the language."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    value: int | float | str

    def __str__(self) -> str:
        return f'{self.field} {self.op} {f"{chr(34)}{self.value}{chr(34)}" if isinstance(self.value, str) else self.value}'


@dataclass(frozen=True)
class BooleanOp:
    op: str
    left: Node | None
    right: Node | None

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Not:
    child: Node | None

    def __str__(self) -> str:
        return f"(NOT {self.child})"


Node = Comparison | BooleanOp | Not


def _strict_tokens(text: str) -> list[Token]:
    out = []
    for word in text.split():
        core = word.removeprefix("(").removesuffix(")")
        kind = next((k for k, p in _STRICT if k not in "()" and p.fullmatch(core)), None)
        if word == "()":
            raise FilterSyntaxError("nothing between parentheses")
        if kind is None or "(" in core or ")" in core:
            raise FilterSyntaxError(f"invalid token {word!r}")
        out += [Token("(", "(")] if word[0] == "(" else []
        out.append(Token(kind, core))
        out += [Token(")", ")")] if word[-1] == ")" else []
    return out


def tokenize(text: str, strict: bool = False) -> list[Token]:
    if strict:
        return _strict_tokens(text)
    out, at = [], 0
    while at < len(text):
        m = _FREE.match(text, at)
        if m is None:
            raise FilterSyntaxError(f"invalid token at {text[at:at + 20]!r}")
        if m.lastgroup != "end":
            kind = _KINDS[int(m.lastgroup[1:])][0]
            out.append(Token(kind, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens: list[Token], strict: bool):
        self.tokens, self.at, self.strict = tokens, 0, strict

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, kind: str) -> Token:
        token = self.peek()
        if token is None or token.kind != kind:
            raise FilterSyntaxError(f"{kind} expected, found {token.text if token else 'the end'}")
        self.at += 1
        return token

    def expression(self) -> Node | None:
        left = self.term()
        while (token := self.peek()) and token.kind == "bool" and token.text != "NOT":
            self.at += 1
            left = BooleanOp(token.text, left, self.term())
        return left

    def term(self) -> Node | None:
        token = self.peek()
        if token and token.kind == "(":
            self.at += 1
            if self.peek() is None or self.peek().kind == ")":
                raise FilterSyntaxError("nothing between parentheses")
            inner = self.expression()
            self.take(")")
            return inner
        return self.factor()

    def factor(self) -> Node | None:
        token = self.peek()
        if token is None:
            return None
        if token.kind == "bool" and token.text == "NOT":
            self.at += 1
            following = self.peek()
            if following and following.kind == "(" and not self.strict:
                return Not(self.term())
            return Not(self.factor())
        name = self.take("name").text
        op = self.take("cmp").text
        value = self.peek()
        if value is None or value.kind not in ("long", "double", "string"):
            raise FilterSyntaxError(f"a literal is expected after {name} {op}")
        self.at += 1
        return Comparison(name, op, literal(value))


def literal(token: Token) -> int | float | str:
    if token.kind == "string":
        return token.text[1:-1]
    if token.kind == "double":
        return float(token.text)
    number = int(token.text)
    if not -(1 << 63) <= number < 1 << 63:
        raise FilterSyntaxError(f"{token.text} does not fit 64 bits")
    return number


def parse(text: str, strict: bool = False) -> Node | None:
    """The tree of a filter; None for a text without tokens, which matches nothing."""
    parser = _Parser(tokenize(text, strict), strict)
    if not parser.tokens:
        return None
    tree = parser.expression()
    if parser.peek() is not None:
        raise FilterSyntaxError(f"unexpected {parser.peek().text!r}")
    return tree
