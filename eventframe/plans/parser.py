"""Text to syntax tree, for both expression languages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from eventframe.types import CAST_NAMES, ExpressionError, UnsupportedFeature


@dataclass(frozen=True)
class Number:
    text: str


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Index:
    of: object
    at: object  # None for ``[]``


@dataclass(frozen=True)
class Member:
    of: object
    name: str


@dataclass(frozen=True)
class Method:
    of: object
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    x: object


@dataclass(frozen=True)
class Binary:
    op: str
    a: object
    b: object


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Cast:
    kind: str
    x: object


#: Binary operators from the loosest to the tightest, left to right.
LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<number>0[xX][0-9a-fA-F]+[uUlL]*|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?[fFlLuU]*)
  | (?P<name>@?[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*\$?)
  | (?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<op>\|\||&&|==|!=|<=|>=|<<|>>|[-+*/%<>!~&|^?:()\[\],.{};=]))""",
    re.X,
)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ExpressionError(f"can't read {text[at:]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    """Recursive descent. ``formula``: ``^`` is power and names may end in ``$``."""

    def __init__(self, text: str, formula: bool = False):
        self.text, self.formula = text, formula
        self.tokens, self.at = tokens(text), 0

    def fail(self, why: str):
        raise ExpressionError(f"{why} in {self.text!r}")

    def peek(self, ahead: int = 0) -> str | None:
        k = self.at + ahead
        return self.tokens[k][1] if k < len(self.tokens) and self.tokens[k][0] == "op" else None

    def take(self, op: str) -> bool:
        if self.peek() == op:
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            self.fail(f"{op!r} expected")

    def parse(self):
        if not self.tokens:
            self.fail("nothing to evaluate")
        if any(k == "op" and t in ("{", "}", ";", "=") for k, t in self.tokens):
            raise UnsupportedFeature(f"statements and lambdas can't be used: {self.text!r}")
        out = self.choice()
        if self.at < len(self.tokens):
            self.fail(f"{self.tokens[self.at][1]!r} not expected")
        return out

    def choice(self):
        test = self.level(0)
        if not self.take("?"):
            return test
        yes = self.choice()
        self.need(":")
        return Choice(test, yes, self.choice())

    def level(self, k: int):
        if k == len(LEVELS):
            return self.power() if self.formula else self.unary()
        ops = LEVELS[k]
        if self.formula and ops == ("^",):
            return self.level(k + 1)
        out = self.level(k + 1)
        while self.peek() in ops:
            op = self.peek()
            self.at += 1
            out = Binary(op, out, self.level(k + 1))
        return out

    def power(self):
        base = self.unary()
        if self.take("^"):
            return Binary("**", base, self.power())
        return base

    def unary(self):
        for op in ("-", "+", "!", "~"):
            if self.take(op):
                return Unary(op, self.power() if self.formula and op == "-" else self.unary())
        if self.peek() == "(" and self.at + 2 < len(self.tokens) and self.tokens[self.at + 1][0] == "name" and self.peek(2) == ")":
            kind = self._cast_name(self.tokens[self.at + 1][1])
            if kind:
                self.at += 3
                return Cast(kind, self.unary())
        return self.postfix(self.primary())

    @staticmethod
    def _cast_name(name: str) -> str | None:
        return CAST_NAMES.get(name.removeprefix("std::"))

    def primary(self):
        if self.at >= len(self.tokens):
            self.fail("an operand is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Number(text)
        if kind == "text":
            return Text(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if text == "(" and kind == "op":
            out = self.choice()
            self.need(")")
            return out
        if kind != "name":
            self.fail(f"{text!r} not expected")
        if text == "static_cast":
            self.need("<")
            to = self._cast_name(self.tokens[self.at][1])
            self.at += 1
            self.need(">")
            if not to:
                self.fail("unknown type of a cast")
            self.need("(")
            out = Cast(to, self.choice())
            self.need(")")
            return out
        if self.peek() == "(":
            args = self.arguments()
            to = self._cast_name(text)
            if to and len(args) == 1:
                return Cast(to, args[0])
            return Call(text, args)
        return Name(text)

    def arguments(self) -> tuple:
        self.need("(")
        args = []
        if not self.take(")"):
            while True:
                args.append(self.choice())
                if self.take(")"):
                    break
                self.need(",")
        return tuple(args)

    def postfix(self, out):
        while True:
            if self.take("["):
                if self.take("]"):
                    out = Index(out, None)
                    continue
                out = Index(out, self.choice())
                self.need("]")
            elif self.peek() == ".":
                self.at += 1
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                    self.fail("a member's name expected")
                name = self.tokens[self.at][1]
                self.at += 1
                out = Method(out, name, self.arguments()) if self.peek() == "(" else Member(out, name)
            else:
                return out


def parse(text: str, formula: bool = False):
    return Parser(text, formula).parse()
