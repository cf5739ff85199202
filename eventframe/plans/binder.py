"""Syntax trees of frame expressions to typed columns: C++ rules over numbers and collections."""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventframe.functions import ieee, scalar, textual, vecops
from eventframe.plans import parser as P
from eventframe.types import ExpressionError, Value, array_of, common, floating, integral, kind_of, promoted, spark_type

CONSTANTS = {"true": (True, "bool"), "false": (False, "bool"), "kTRUE": (True, "bool"), "kFALSE": (False, "bool"), "M_PI": (math.pi, "f64"), "M_E": (math.e, "f64")}


def literal(text: str) -> Value:
    """A C++ number: the smallest of int, long (unsigned for hexadecimals) that holds it."""
    low = text.lower()
    if low.startswith("0x"):
        body, suffix = low.rstrip("ul"), low[len(low.rstrip("ul")) :]
        n = int(body, 16)
    elif any(c in low for c in ".e") or low.endswith("f"):
        kind = "f32" if low.endswith("f") else "f64"
        return Value(F.lit(float(low.rstrip("fl"))).cast(spark_type(kind)), kind)
    else:
        body, suffix = low.rstrip("ul"), low[len(low.rstrip("ul")) :]
        n = int(body, 8) if len(body) > 1 and body[0] == "0" else int(body)
    unsigned, long = "u" in suffix, "l" in suffix
    if not long and n < 1 << (32 if unsigned else 31):
        kind = "u32" if unsigned else "i32"
    else:
        kind = "u64" if unsigned else "i64"
    if n >= 1 << 63:
        raise ExpressionError(f"{text} is too large")
    return Value(F.lit(n).cast(spark_type(kind)), kind)


class Binder:
    """Binds names to columns of one node and gives each expression its type.

    ``names``: bound columns; ``entry``: the entry number for messages, or None.
    """

    def __init__(self, names: Mapping[str, Value], entry: Column | None = None, functions: Mapping[str, Callable] | None = None):
        self.names, self.entry, self.functions = names, entry, functions or {}

    def expression(self, text: str) -> Value:
        return self.bind(P.parse(text))

    def unknown(self, name: str, among) -> ExpressionError:
        near = difflib.get_close_matches(name, list(among), 3)
        return ExpressionError(f"unknown name {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))

    # names ------------------------------------------------------------------------------------------

    def dotted(self, node) -> str | None:
        if isinstance(node, P.Name):
            return node.name
        if isinstance(node, P.Member):
            head = self.dotted(node.of)
            return f"{head}.{node.name}" if head else None
        return None

    def bind(self, node) -> Value:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def _number(self, n: P.Number) -> Value:
        return literal(n.text)

    def _text(self, n: P.Text) -> Value:
        return Value(F.lit(n.value), "str")

    def _name(self, n: P.Name) -> Value:
        if n.name in self.names:
            return self.names[n.name]
        if n.name in CONSTANTS:
            v, kind = CONSTANTS[n.name]
            return Value(F.lit(v), kind)
        raise self.unknown(n.name, self.names)

    def _member(self, n: P.Member) -> Value:
        full = self.dotted(n)
        if full in self.names:
            return self.names[full]
        of = self.bind(n.of)
        for name, kind, depth, *_ in of.fields:
            if name == n.name:
                if of.kind == "tuple" or not of.depth:
                    return Value(of.column.getField(name), kind, depth)
                return Value(F.transform(of.column, lambda x: x.getField(name)), kind, of.depth + depth)
        raise self.unknown(n.name, [f[0] for f in of.fields])

    # operators ----------------------------------------------------------------------------------------

    def _unary(self, n: P.Unary) -> Value:
        x = self.bind(n.x)
        if n.op == "!":
            out = vecops.broadcast(lambda c: ~ieee.truth(c, x.kind), [x], "bool")
            return self.as_ints(out) if out.depth else out
        kind = promoted(x.kind)
        if n.op == "~":
            if not integral(x.kind):
                raise ExpressionError("~ takes whole numbers")
            return vecops.broadcast(lambda c: F.bitwise_not(c.cast(spark_type(kind))), [x], kind)
        if n.op == "-":
            if floating(kind):
                return vecops.broadcast(lambda c: -c.cast(spark_type(kind)), [x], kind)
            return vecops.broadcast(lambda c: ieee.arithmetic("-", F.lit(0), kind, c, x.kind)[0], [x], kind)
        return vecops.broadcast(lambda c: c.cast(spark_type(kind)), [x], kind)

    @staticmethod
    def as_ints(v: Value) -> Value:
        return Value(F.transform(v.column, lambda x: x.cast("int")), "i32", 1)

    def _binary(self, n: P.Binary) -> Value:
        if n.op in ("&&", "||"):
            return self._logical(n)
        a, b = self.bind(n.a), self.bind(n.b)
        return self.operate(n.op, a, b)

    def operate(self, op: str, a: Value, b: Value) -> Value:
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if (a.kind == "str") != (b.kind == "str") or a.kind == "str" and op not in ("==", "!="):
                raise ExpressionError(f"{op} can't compare these")
            real = a.kind != "str" and (floating(a.kind) or floating(b.kind))
            num = lambda c, k: c.cast("int") if k == "bool" else c
            out = vecops.broadcast2(lambda x, y: ieee.compared(op, num(x, a.kind), num(y, b.kind), real), a, b, "bool", self.entry)
            return self.as_ints(out) if out.depth else out
        num = lambda c, k: c.cast("int") if k == "bool" else c
        if op in ("+", "-", "*"):
            return vecops.broadcast2(lambda x, y: ieee.arithmetic(op, num(x, a.kind), a.kind, num(y, b.kind), b.kind)[0], a, b, common(a.kind, b.kind), self.entry)
        if op == "/":
            return vecops.broadcast2(lambda x, y: ieee.quotient(num(x, a.kind), a.kind, num(y, b.kind), b.kind, self.entry)[0], a, b, common(a.kind, b.kind), self.entry)
        if not (integral(a.kind) and integral(b.kind)):
            raise ExpressionError(f"{op} takes whole numbers")
        if op == "%":
            return vecops.broadcast2(lambda x, y: ieee.modulo(num(x, a.kind), a.kind, num(y, b.kind), b.kind, self.entry)[0], a, b, common(a.kind, b.kind), self.entry)
        if op in ("<<", ">>"):
            return vecops.broadcast2(lambda x, y: ieee.shifted(op, num(x, a.kind), a.kind, num(y, b.kind))[0], a, b, promoted(a.kind), self.entry)
        kind = common(a.kind, b.kind)
        to = spark_type(kind)
        f = {"&": lambda x, y: x.bitwiseAND(y), "|": lambda x, y: x.bitwiseOR(y), "^": lambda x, y: x.bitwiseXOR(y)}[op]
        return vecops.broadcast2(lambda x, y: f(num(x, a.kind).cast(to), num(y, b.kind).cast(to)), a, b, kind, self.entry)

    def _logical(self, n: P.Binary) -> Value:
        a, b = self.bind(n.a), self.bind(n.b)
        if a.depth or b.depth:
            join = (lambda x, y: x & y) if n.op == "&&" else (lambda x, y: x | y)
            return self.as_ints(vecops.broadcast2(lambda x, y: join(ieee.truth(x, a.kind), ieee.truth(y, b.kind)), a, b, "bool", self.entry))
        left, right = ieee.truth(a.column, a.kind), ieee.truth(b.column, b.kind)
        # the right side is evaluated where the left one leaves it open, and nowhere else
        if n.op == "&&":
            return Value(F.when(left, right).otherwise(False), "bool")
        return Value(F.when(left, True).otherwise(right), "bool")

    def _choice(self, n: P.Choice) -> Value:
        test, a, b = self.bind(n.test), self.bind(n.yes), self.bind(n.no)
        if test.depth:
            raise ExpressionError("the condition of ?: can't be a collection; use Where")
        if a.depth != b.depth:
            raise ExpressionError("both sides of ?: must be numbers, or both collections")
        kind = a.kind if a.kind == b.kind else common(a.kind, b.kind)
        to = array_of(kind, a.depth)
        return Value(F.when(ieee.truth(test.column, test.kind), a.column.cast(to)).otherwise(b.column.cast(to)), kind, a.depth)

    def _cast(self, n: P.Cast) -> Value:
        x = self.bind(n.x)
        if x.kind == "str":
            raise ExpressionError("a string can't be cast")
        return vecops.broadcast(lambda c: ieee.converted(c, x.kind, n.kind, self.entry), [x], n.kind, self.entry)

    # collections ----------------------------------------------------------------------------------------

    def _index(self, n: P.Index) -> Value:
        of = self.bind(n.of)
        if of.kind == "tuple":
            if not isinstance(n.at, P.Number):
                raise ExpressionError("a member of Combinations is chosen by a literal")
            name, kind, depth = of.fields[int(n.at.text)]
            return Value(of.column.getField(name), kind, depth)
        if not of.depth:
            raise ExpressionError("only collections can be indexed")
        at = self.bind(n.at)
        if at.depth:
            return vecops.masked(of, at, self.entry)
        return self.element(of, at.column)

    def element(self, of: Value, at: Column) -> Value:
        inside = (at >= 0) & (at < F.size(of.column))
        bad = F.raise_error(ieee.where("index past the end", self.entry)).cast(array_of(of.kind, of.depth - 1))
        return Value(F.when(inside, F.get(of.column, at.cast("int"))).otherwise(bad), of.kind, of.depth - 1)

    def _method(self, n: P.Method) -> Value:
        of, args = self.bind(n.of), [self.bind(a) for a in n.args]
        if of.kind == "str" and not of.depth:
            if n.name in ("size", "length"):
                return Value(F.length(of.column).cast("long"), "i64")
            if n.name == "empty":
                return Value(F.length(of.column) == 0, "bool")
        elif of.depth:
            size = F.size(of.column)
            if n.name == "size":
                return Value(size.cast("long"), "i64")
            if n.name == "empty":
                return Value(size == 0, "bool")
            if n.name == "front":
                return self.element(of, F.lit(0))
            if n.name == "back":
                return self.element(of, size - 1)
            if n.name == "at" and len(args) == 1:
                return self.element(of, args[0].column)
        raise ExpressionError(f"no method {n.name}() here")

    def _call(self, n: P.Call) -> Value:
        plain = n.name.removeprefix("ROOT::VecOps::").removeprefix("VecOps::")
        if n.name in self.functions:
            return self.functions[n.name](*[self.bind(a) for a in n.args])
        if plain == "Combinations" and len(n.args) == 2 and isinstance(n.args[1], P.Number):
            k = int(n.args[1].text)
            return Value(vecops.combinations(self.bind(n.args[0]).column, k), "tuple", 0, tuple((f"_{i}", "u64", 1) for i in range(k)))
        args = [self.bind(a) for a in n.args]
        if n.name in ("abs", "fabs", "std::abs", "std::fabs", "TMath::Abs"):
            kind = "f64" if "fabs" in n.name and not floating(args[0].kind) else promoted(args[0].kind)
            return vecops.broadcast(lambda c: F.abs(c.cast(spark_type(kind))), args, kind, self.entry)
        if n.name in vecops.REGISTRY and (n.name not in ("Max", "Min", "Sum") or any(a.depth for a in args)):
            least, most, f = vecops.REGISTRY[n.name]
            if not least <= len(args) <= most:
                raise ExpressionError(f"{n.name} takes {least} to {most} arguments, not {len(args)}")
            return f(*args, entry=self.entry)
        if n.name in scalar.REGISTRY:
            return vecops.mapped(n.name, args, self.entry)
        if n.name in textual.REGISTRY:
            return textual.call(n.name, args)
        raise self.unknown(n.name, [*vecops.REGISTRY, *scalar.REGISTRY, *textual.REGISTRY, *self.functions])


def bound_columns(df) -> dict[str, Value]:
    """The columns of a DataFrame as bound values."""
    out = {}
    for f in df.schema.fields:
        kind, depth, fields = kind_of(f.dataType)
        out[f.name] = Value(F.col(f"`{f.name}`"), kind, depth, fields)
    return out
