"""The second expression language: all numbers are doubles, and unindexed collections are looped over.

An expression over collections has one value per element, up to the shortest
of them; ``Sum$`` and its like fold the loop; ``Alt$`` gives what a missing
element is worth. ``Draw``, ``Scan`` and ``arrays`` stand on it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.functions import ieee, scalar
from eventframe.hist import Axis, Histogram, Profile, good_limits
from eventframe.plans import parser as P
from eventframe.plans.binder import CONSTANTS, bound_columns
from eventframe.sources.tables import ENTRY
from eventframe.types import ExpressionError, Value, integral

_FOLDS = ("Sum$", "Min$", "Max$", "Length$", "MinIf$", "MaxIf$")


@dataclass(frozen=True)
class Term:
    """One expression: how many elements an entry has (None: it doesn't loop), and its value at an index."""

    size: Column | None
    at: object  # index column -> value
    text: bool = False
    weak: bool = False  # reads missing elements as something, and so doesn't shorten a loop


def _shortest(terms: list[Term]) -> Column | None:
    sizes = [t.size for t in terms if t.size is not None and not t.weak] or [t.size for t in terms if t.size is not None]
    if not sizes:
        return None
    return sizes[0] if len(sizes) == 1 else F.least(*sizes)


class Formula:
    def __init__(self, names: Mapping[str, Value], aliases: Mapping[str, str] | None = None, entry: Column | None = None, entries: int | None = None):
        self.names, self.aliases, self.entry, self.entries = names, aliases or {}, entry, entries

    def term(self, text: str) -> Term:
        return self.build(P.parse(text, formula=True))

    def constant(self, x: Column, text: bool = False) -> Term:
        return Term(None, lambda i: x, text)

    def lifted(self, f, *terms: Term, text: bool = False) -> Term:
        return Term(_shortest(list(terms)), lambda i: f(*[t.at(i) for t in terms]), text, bool(terms) and all(t.weak or t.size is None for t in terms))

    def build(self, n) -> Term:
        if isinstance(n, P.Number):
            low = n.text.lower()
            return self.constant(F.lit(float(int(low.rstrip("ul"), 16)) if low.startswith("0x") else float(low.rstrip("ful"))))
        if isinstance(n, P.Text):
            return self.constant(F.lit(n.value), True)
        if isinstance(n, P.Name):
            return self.name(n.name)
        if isinstance(n, P.Member):
            full = _dotted(n)
            if full and full in self.names:
                return self.name(full)
            raise ExpressionError(f"unknown name {full}")
        if isinstance(n, P.Index):
            return self.index(n)
        if isinstance(n, P.Unary):
            x = self.build(n.x)
            return self.lifted({"-": lambda a: -a, "+": lambda a: a, "!": lambda a: (a == 0).cast("double"), "~": lambda a: F.bitwise_not(a.cast("long")).cast("double")}[n.op], x)
        if isinstance(n, P.Binary):
            return self.lifted(lambda a, b: self.operate(n.op, a, b, x.text), x := self.build(n.a), self.build(n.b))
        if isinstance(n, P.Choice):
            return self.lifted(lambda t, a, b: F.when(t != 0, a).otherwise(b), *map(self.build, (n.test, n.yes, n.no)))
        if isinstance(n, P.Cast):
            if n.kind in ("f64", "f32"):
                return self.lifted(lambda a: a.cast("float" if n.kind == "f32" else "double").cast("double"), self.build(n.x))
            odd = lambda a: F.isnan(a) | (F.abs(a) == ieee.INF)
            return self.lifted(lambda a: F.when(~odd(a), ieee.converted(F.when(odd(a), 0.0).otherwise(a), "f64", n.kind).cast("int" if n.kind == "bool" else "double").cast("double")), self.build(n.x))
        if isinstance(n, P.Method) and n.name == "size":
            v = self.value(n.of)
            return self.constant(F.size(v.column).cast("double"))
        if isinstance(n, P.Call):
            return self.call(n)
        raise ExpressionError(f"can't use {type(n).__name__} in a formula")

    def value(self, n) -> Value:
        name = (_dotted(n) or "").removeprefix("@")
        if name not in self.names:
            raise ExpressionError(f"unknown name {name!r}")
        return self.names[name]

    def name(self, name: str) -> Term:
        if name in self.aliases:
            return self.term(self.aliases[name])
        if name in ("Entry$", "LocalEntry$") and self.entry is not None:
            return self.constant(self.entry.cast("double"))
        if name == "Entries$" and self.entries is not None:
            return self.constant(F.lit(float(self.entries)))
        if name in ("Iteration$", "Iteration"):
            return Term(None, lambda i: i.cast("double"))
        if name in CONSTANTS or name == "pi":
            return self.constant(F.lit(float(CONSTANTS.get(name, (3.141592653589793,))[0])))
        v = self.value(P.Name(name))
        if v.kind == "str":
            return self.constant(v.column, True) if not v.depth else Term(F.size(v.column), lambda i: F.get(v.column, i), True)
        number = lambda c: c.cast("int").cast("double") if v.kind == "bool" else c.cast("double")
        if not v.depth:
            return self.constant(number(v.column))
        flat = v.column
        for _ in range(v.depth - 1):
            flat = F.flatten(flat)
        return Term(F.size(flat), lambda i: number(F.get(flat, i)))

    def index(self, n: P.Index) -> Term:
        chain, at = n, []
        while isinstance(chain, P.Index):
            at.insert(0, chain.at)
            chain = chain.of
        v = self.value(chain)
        column, depth = v.column, v.depth
        number = lambda c: c.cast("int").cast("double") if v.kind == "bool" else c.cast("double")
        fixed = []
        while at and at[0] is not None:
            fixed.append(self.build(at.pop(0)))
        if any(t.size is not None for t in fixed):
            if len(fixed) != 1 or depth != 1:
                raise ExpressionError("only one index may be a collection")
            inner = fixed[0]
            return Term(inner.size, lambda i: number(F.get(column, F.floor(inner.at(i)).cast("int"))))
        for t in fixed:
            column, depth = F.get(column, F.floor(t.at(F.lit(0))).cast("int")), depth - 1
        if depth < 0:
            raise ExpressionError("too many indices")
        if depth == 0:
            return self.constant(column if v.kind == "str" else number(column), v.kind == "str")
        for _ in range(depth - 1):
            column = F.flatten(column)
        return Term(F.coalesce(F.size(column), F.lit(0)), lambda i: number(F.get(column, i)))

    def operate(self, op: str, a: Column, b: Column, text: bool) -> Column:
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return ieee.compared(op, a, b, not text).cast("double")
        if op == "&&":
            return F.when(a == 0, 0.0).otherwise((b != 0).cast("double"))
        if op == "||":
            return F.when(a != 0, 1.0).otherwise((b != 0).cast("double"))
        if op == "**":
            return F.pow(a, b)
        if op == "/":
            return ieee.divided(a, b)
        if op in ("+", "-", "*"):
            return a + b if op == "+" else a - b if op == "-" else a * b
        x, y = a.cast("long"), b.cast("long")
        if op == "%":
            return F.when(y != 0, (x % F.when(y != 0, y).otherwise(1)).cast("double"))
        if op in ("&", "|"):
            return (x.bitwiseAND(y) if op == "&" else x.bitwiseOR(y)).cast("double")
        return ieee.shifted(op, x, "i64", y)[0].cast("double")

    def elements(self, t: Term) -> Column:
        """All values of a loop as an array, invalid ones left out."""
        if t.size is None:
            return F.filter(F.array(t.at(F.lit(0))), lambda x: x.isNotNull())
        return F.filter(loop(t.size, t.at), lambda x: x.isNotNull())

    def call(self, n: P.Call) -> Term:
        if n.name == "Alt$":
            x, other = map(self.build, n.args)
            return Term(x.size, lambda i: F.coalesce(x.at(i), other.at(i)), x.text, True)
        if n.name in _FOLDS:
            x = self.build(n.args[0])
            if n.name == "Length$":
                return self.constant((x.size if x.size is not None else F.lit(1)).cast("double"))
            if n.name.endswith("If$"):
                test = self.build(n.args[1])
                both = Term(_shortest([x, test]), lambda i: F.when(test.at(i) != 0, x.at(i)))
                values = self.elements(both)
            else:
                values = self.elements(x)
            fold = F.aggregate(values, F.lit(0.0), lambda a, e: a + e) if n.name == "Sum$" else F.array_min(values) if n.name.startswith("Min") else F.array_max(values)
            return self.constant(F.coalesce(fold, F.lit(0.0)))
        if n.name == "strstr":
            return self.lifted(lambda a, b: a.contains(b).cast("double"), *map(self.build, n.args))
        args = [self.build(a) for a in n.args]
        if n.name in ("abs", "fabs", "TMath::Abs"):
            return self.lifted(F.abs, *args)
        if n.name == "int":
            return self.lifted(lambda a: a.cast("long").cast("double"), *args)
        f, _ = scalar.function(n.name, len(args))
        return self.lifted(lambda *c: f(*c).cast("double"), *args)


def _dotted(n) -> str | None:
    if isinstance(n, P.Name):
        return n.name
    if isinstance(n, P.Member):
        head = _dotted(n.of)
        return f"{head}.{n.name}" if head else None
    return None


def loop(size: Column, f) -> Column:
    """``f`` of each index below ``size``, as an array."""
    rows = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), f)
    return F.when(size > 0, rows).otherwise(F.slice(rows, 1, 0))


def compiler(df: DataFrame, aliases: Mapping[str, str] | None = None) -> Formula:
    return Formula({k: v for k, v in bound_columns(df).items() if k != ENTRY}, aliases, F.col(ENTRY) if ENTRY in df.columns else None)


def evaluate_together(df: DataFrame, texts: Mapping[str, str], cut: str = "", aliases: Mapping[str, str] | None = None) -> DataFrame:
    """One row per element of the loop that all expressions share, with the cut's value as ``__cut``; invalid rows are gone."""
    f = compiler(df, aliases)
    terms = {k: f.term(t) for k, t in texts.items()}
    if cut:
        terms["__cut"] = f.term(cut)
    size = _shortest(list(terms.values()))
    fields = lambda i: F.struct(*[t.at(i).alias(k) for k, t in terms.items()])
    keep = [F.col(ENTRY)] if ENTRY in df.columns else []
    if size is None:
        out = df.select(*keep, *[t.at(F.lit(0)).alias(k) for k, t in terms.items()])
    else:
        out = df.select(*keep, F.posexplode(loop(size, fields)).alias("__i", "__r")).select(*[c for c in ([ENTRY] if keep else [])], "__i", "__r.*")
    valid = F.lit(True)
    for k in terms:
        valid = valid & F.col(k).isNotNull()
    out = out.where(valid)
    return out if cut else out.withColumn("__cut", F.lit(1.0))


def selected(df: DataFrame, cut: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Entries where a cut is nonzero; where it loops, those where any element passes."""
    f = compiler(df, aliases)
    return df.where(F.exists(f.elements(f.term(cut)), lambda x: x != 0))


def arrays(df: DataFrame, expressions: Mapping[str, str] | list[str], cut: str = "", aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Expressions of the entries that pass a cut: numbers, or arrays where they loop."""
    named = expressions if isinstance(expressions, Mapping) else {e: e for e in expressions}
    f = compiler(df, aliases)
    out = selected(df, cut, aliases) if cut else df
    keep = [F.col(ENTRY)] if ENTRY in df.columns else []
    terms = {k: f.term(t) for k, t in named.items()}
    return out.select(*keep, *[(t.at(F.lit(0)) if t.size is None else f.elements(t)).alias(k) for k, t in terms.items()])


def _axes_of(spec: str) -> tuple[list[str], str, list]:
    """``y:x>>name(n,low,high,...)``: expressions from x on, the name, and axis numbers."""
    text, _, target = spec.partition(">>")
    parts, level, now = [], 0, ""
    for k, c in enumerate(text):
        level += (c in "([") - (c in ")]")
        if c == ":" and not level and text[k - 1 : k] != ":" and text[k + 1 : k + 2] != ":" and "?" not in now:
            parts.append(now)
            now = ""
        else:
            now += c
    name, _, numbers = target.partition("(")
    return [p.strip() for p in [*parts, now]][::-1], name.strip("+ ") or "htemp", [float(x) for x in numbers.rstrip(") ").split(",") if x.strip()]


def draw_bins(df: DataFrame, spec: str, selection: str = "", option: str = "", aliases: Mapping[str, str] | None = None) -> tuple[object, DataFrame]:
    """The empty result of a drawing, and its filled bins as a table."""
    texts, name, numbers = _axes_of(spec)
    names = [f"v{k}" for k in range(len(texts))]
    rows = evaluate_together(df, dict(zip(names, texts)), selection, aliases).where("__cut <> 0")
    dim = len(texts) - 1 if "prof" in option else len(texts)
    counts = [int(numbers[3 * k]) if len(numbers) > 3 * k else ((100, 40, 20)[dim - 1] if "prof" not in option else (100, 20)[dim - 1]) for k in range(dim)]
    axes = []
    for k in range(dim):
        if len(numbers) >= 3 * k + 3 and numbers[3 * k + 1] < numbers[3 * k + 2]:
            axes.append(Axis(counts[k], numbers[3 * k + 1], numbers[3 * k + 2]))
        else:
            low, high = rows.where(~F.isnan(names[k])).agg(F.min(names[k]), F.max(names[k])).first()
            v = bound_columns(df).get(texts[k])
            axes.append(Axis(*good_limits(counts[k], low, high, v is not None and integral(v.kind))) if low is not None else Axis(counts[k], 0.0, 1.0))
    title = ":".join(texts[::-1]) + (f" {{{selection}}}" if len(selection) > 1 else "")
    h = Profile(axes, None, "", name, title) if "prof" in option else Histogram(axes, name, title)
    return h, h.fill_frame(rows, *names, weight="__cut")


def draw(df: DataFrame, spec: str, selection: str = "", option: str = "", aliases: Mapping[str, str] | None = None):
    """A histogram (``prof``: a profile) of expressions; the selection's value is each fill's weight, none where it is zero."""
    h, bins = draw_bins(df, spec, selection, option, aliases)
    return h.add_bins(bins.collect())


def scan(df: DataFrame, expressions: str, cut: str = "", rows: int = 25, aliases: Mapping[str, str] | None = None) -> str:
    """The first rows of expressions (separated by ``:``) as text; a row per element where they loop."""
    texts = _axes_of(expressions)[0][::-1]
    names = [f"v{k}" for k in range(len(texts))]
    table = evaluate_together(df, dict(zip(names, texts)), cut, aliases).where("__cut <> 0")
    order = [c for c in (ENTRY, "__i") if c in table.columns]
    got = table.orderBy(*order).limit(rows).collect() if order else table.limit(rows).collect()
    line = "*" * (11 + 12 * len(texts))
    head = "*    Row   *" + "".join(f" {t[:9]:>9} *" for t in texts)
    body = [f"* {r[ENTRY] if ENTRY in table.columns else k:>8} *" + "".join(f" {r[n]:>9.7g} *" if isinstance(r[n], float) else f" {str(r[n])[:9]:>9} *" for n in names) for k, r in enumerate(got)]
    return "\n".join([line, head, line, *body, line])
