"""The frame: derived columns, selections and booked results over one table.

Nothing runs when it is booked. The first result that is asked for runs all
that are pending on the same table: scalars of every branch in one aggregate,
binned results of every branch in one grouped aggregate. A branch is a gate: a
column that says which entries reach it, so branches share a scan. Where all
pending results hang on one node, its selections become plain filters, which
Spark pushes into the scan.
"""

from __future__ import annotations

import contextlib
import inspect
import itertools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventframe.functions import ieee
from eventframe.hist import Axis, Graph, Histogram, Profile, good_limits
from eventframe.hist.histogram import moment_names
from eventframe.plans.binder import Binder, bound_columns
from eventframe.types import KINDS, CAST_NAMES, ExpressionError, UnsupportedFeature, Value, array_of, floating, spark_type

ENTRY = "__entry"
#: Entries numbered together when a Range follows a selection.
RANGE_BUCKET = 1 << 16
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*$")
_KEYWORDS = {"int", "float", "double", "bool", "char", "long", "short", "unsigned", "return", "if", "else", "for", "while", "class", "struct", "auto", "const", "true", "false", "new", "delete", "this", "template", "typename", "namespace", "using"}
_XYZ = "xyz"


@dataclass(frozen=True, eq=False)
class Step:
    """What a node adds to its parent: a column, or a gate."""

    number: int
    kind: str  # "define", "filter" or "range"
    column: str
    value: Column | None = None
    gate: str | None = None  # of the parent
    label: str = ""
    span: tuple = ()


@dataclass
class Booked:
    """A result that is pending or done."""

    node: Frame
    kind: str  # "scalar", "binned", "rows" or "report"
    finish: Callable
    columns: list = field(default_factory=list)  # aggregates or bin structs, given the gate
    done: bool = False
    value: object = None


class Result:
    """A promise of a value; reading it runs what is pending."""

    def __init__(self, booked: Booked):
        self._booked = booked

    def GetValue(self):
        if not self._booked.done:
            self._booked.node._graph.run()
        return self._booked.value

    get_value = GetValue

    def GetPtr(self):
        return self.GetValue()

    def IsReady(self) -> bool:
        return self._booked.done

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.GetValue(), name)

    def __iter__(self):
        return iter(self.GetValue())

    def __len__(self):
        return len(self.GetValue())

    def __getitem__(self, k):
        return self.GetValue()[k]

    def __float__(self):
        return float(self.GetValue())

    def __int__(self):
        return int(self.GetValue())

    def __eq__(self, other):
        return self.GetValue() == other

    __hash__ = None


class GraphState:
    """What all nodes of a table share."""

    def __init__(self, base: DataFrame, entry: str | None):
        self.base, self.entry = base, entry
        self.steps: list[Step] = []
        self.pending: list[Booked] = []
        self.numbers = itertools.count()
        self.runs = 0

    # plans --------------------------------------------------------------------------------------------

    def gated(self, steps: list[Step]) -> DataFrame:
        """All steps of all branches as columns over one scan."""
        df = self.base
        for s in steps:
            gate = F.col(s.gate) if s.gate else F.lit(True)
            if s.kind == "define":
                df = df.withColumn(s.column, F.when(gate, s.value) if s.gate else s.value)
            elif s.kind == "filter":
                df = df.withColumn(s.column, F.when(gate, F.coalesce(s.value, F.lit(False))).otherwise(False))
            else:
                df = self.ranged(df, s, gate)
        return df

    def filtered(self, steps: list[Step]) -> DataFrame:
        """The steps of one branch, selections as filters."""
        df = self.base
        for s in steps:
            if s.kind == "define":
                df = df.withColumn(s.column, s.value)
            elif s.kind == "filter":
                df = df.where(s.value)
            else:
                df = self.ranged(df, s, F.lit(True)).where(s.column)
        return df

    def ranged(self, df: DataFrame, s: Step, gate: Column) -> DataFrame:
        """A gate for every ``stride``-th of the entries that reach a node, from ``begin`` up to ``end``."""
        begin, end, stride = s.span
        if self.entry is None:
            raise UnsupportedFeature("Range needs an entry number: give Frame(df, entry=...)")
        entry = F.col(self.entry)
        if s.gate is None and not any(t.kind != "define" and t.number < s.number for t in self._path(s)):
            rank = entry
        else:
            bucket = F.floor(entry / RANGE_BUCKET)
            df = df.withColumn("__bucket", bucket)
            counts = df.groupBy("__bucket").agg(F.count_if(gate).alias("__n"))
            ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.select(F.col("__bucket").alias("__of"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
            inside = Window.partitionBy("__bucket").orderBy(entry).rowsBetween(Window.unboundedPreceding, -1)
            df = df.withColumn("__before", F.coalesce(F.sum(F.when(gate, 1).otherwise(0)).over(inside), F.lit(0)))
            df = df.join(counts, F.col("__bucket") == F.col("__of")).withColumn("__rank", F.col("__ahead") + F.col("__before")).drop("__bucket", "__of", "__ahead", "__before")
            rank = F.col("__rank")
        kept = gate & (rank >= begin) & ((rank - begin) % stride == 0)
        if end:
            kept = kept & (rank < end)
        return df.withColumn(s.column, kept).drop("__rank")

    def _path(self, s: Step) -> list[Step]:
        return [t for t in self.steps if t.column == s.gate]

    # running --------------------------------------------------------------------------------------------

    def run(self) -> None:
        booked, self.pending = self.pending, []
        if not booked:
            return
        self.runs += 1
        kinds = {"scalar" if b.kind == "report" else b.kind for b in booked}
        with self.held(len(kinds) > 1):
            for kind in ("scalar", "binned", "rows"):
                some = [b for b in booked if b.kind == kind or kind == "scalar" and b.kind == "report"]
                if some:
                    getattr(self, f"run_{kind}")(some)
        for b in booked:
            b.done = True

    @contextlib.contextmanager
    def held(self, several: bool):
        """While several jobs read a table that is more than a scan, it is kept, in memory or on disk, and computed once."""
        plan = self.base._jdf.queryExecution().optimizedPlan().toString() if several else ""
        keep = any(x in plan for x in ("Aggregate", "Join", "Window", "Sort")) and not self.base.is_cached
        if keep:
            self.base.persist()
        try:
            yield
        finally:
            if keep:
                self.base.unpersist()

    def plan(self, booked: list[Booked]) -> tuple[DataFrame, Callable[[Booked], Column]]:
        nodes = {b.node._steps for b in booked}
        if len(nodes) == 1 and all(b.kind != "report" for b in booked):
            return self.filtered(list(next(iter(nodes)))), lambda b: F.lit(True)
        steps = sorted({s for b in booked for s in b.node._steps}, key=lambda s: s.number)
        return self.gated(steps), lambda b: F.col(b.node._gate) if b.node._gate else F.lit(True)

    def run_scalar(self, booked: list[Booked]) -> None:
        df, gate = self.plan(booked)
        columns, spans = [], []
        for b in booked:
            own = b.columns(gate(b))
            spans.append((len(columns), len(columns) + len(own)))
            columns += own
        row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        for b, (i, j) in zip(booked, spans):
            b.value = b.finish(*row[i:j])

    def run_binned(self, booked: list[Booked]) -> None:
        df, gate = self.plan(booked)
        dim, parts = max(b.columns.dim for b in booked), []
        for k, b in enumerate(booked):
            one, deep = b.columns(k)
            parts.append((gate(b), one, deep))
        if len(parts) == 1 and not parts[0][2]:  # nothing to unfold: bins come straight from the rows
            fills = df.where(parts[0][0]).select(parts[0][1].alias("f")).select("f.*")
        else:
            rows = [(g, one if deep else F.array(one)) for g, one, deep in parts]
            rows = [F.when(g, r).otherwise(F.slice(r, 1, 0)) for g, r in rows]
            fills = df.select(F.explode(F.concat(*rows) if len(rows) > 1 else rows[0]).alias("f")).select("f.*")
        keys = ["hid", *[f"b{c}" for c in _XYZ[:dim]]]
        w, d = F.col("w"), [F.col(c) for c in _XYZ[:dim]]
        sums = [w * x for x in d] + [w * a * b for i, a in enumerate(d) for b in d[i:]]
        aggregates = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("w2"), F.max(w != 1.0).alias("weighted")]
        aggregates += [F.sum(s).alias(f"m_{n}") for n, s in zip(moment_names(dim), sums)]
        found: dict[int, list[dict]] = {}
        for r in fills.groupBy(*keys).agg(*aggregates).toArrow().to_pylist():
            found.setdefault(r["hid"], []).append(r | {"w": r["sw"]})
        for k, b in enumerate(booked):
            b.value = b.finish(sorted(found.get(k, []), key=lambda r: tuple(r.get(f"b{c}") or 0 for c in _XYZ)))

    def run_rows(self, booked: list[Booked]) -> None:
        for b in booked:
            df = self.filtered(list(b.node._steps))
            if self.entry is not None:
                df = df.orderBy(self.entry)
            b.value = b.finish(df)


@dataclass(frozen=True)
class CutInfo:
    name: str
    passed: int
    all: int

    def efficiency(self) -> float:
        return 100 * self.passed / self.all if self.all else math.nan


class Report(list):
    """Cut flow: one ``CutInfo`` per named selection."""

    def text(self, width: int = 10) -> str:
        first = self[0].all if self else 0
        lines = []
        for c in self:
            total = 100 * c.passed / first if first else math.nan
            lines.append(f"{c.name:<{width}}: pass={c.passed:<10} all={c.all:<10} -- eff={c.efficiency():3.2f} % cumulative eff={total:3.2f} %")
        return "\n".join(lines)

    def Print(self) -> None:
        print(self.text())

    def AsString(self) -> str:
        return self.text(20)

    def At(self, name: str) -> CutInfo:
        return next(c for c in self if c.name == name)


@dataclass(frozen=True)
class Statistic:
    """Count, weights, mean, spread, errors and extremes."""

    n: int
    w: float
    w2: float
    mean: float
    var: float
    min: float
    max: float

    @property
    def rms(self) -> float:
        return math.sqrt(self.var)

    @property
    def neff(self) -> int:
        return int(self.w * self.w / self.w2) if self.w2 else 0

    @property
    def mean_error(self) -> float:
        return math.sqrt(self.var / self.neff) if self.neff else 0.0


def _flat(v: Value, gate: Column, f: Callable[[Column], Column], whole: Callable[[Column], Column]) -> Column:
    """An aggregate of numbers, or of all elements of collections by way of each entry's own."""
    x = F.when(gate, v.column)
    return whole(f(x)) if v.depth else whole(x)


class Frame:
    """A node: all that leads from the table to here."""

    def __init__(self, source, *args, entry: str | None = None, spark: SparkSession | None = None, default_columns: list[str] | None = None):
        from eventframe.sources import tables

        base, entry = tables.open_source(source, *args, entry=entry, spark=spark)
        self._graph = GraphState(base, entry)
        self._names = {k: v for k, v in bound_columns(base).items() if k != ENTRY}
        self._defined: list[str] = []
        self._steps: tuple[Step, ...] = ()
        self._gate: str | None = None
        self._labels: tuple[str, ...] = ()
        self._missing: frozenset[str] = frozenset()
        self._default = default_columns or []

    def _child(self, **change) -> Frame:
        out = object.__new__(Frame)
        out.__dict__.update(self.__dict__ | change)
        return out

    # expressions ------------------------------------------------------------------------------------------

    @property
    def _entry(self) -> Column | None:
        return F.col(self._graph.entry) if self._graph.entry else None

    def _binder(self) -> Binder:
        names = dict(self._names)
        if self._entry is not None:
            names["rdfentry_"] = Value(self._entry.cast("long"), "u64")
        names["rdfslot_"] = Value(F.spark_partition_id(), "u32")
        return Binder(names, self._entry, {n: _declared(*d) for n, d in DECLARED.items()})

    def bound(self, what, columns: list[str] | None = None, returns: str | None = None) -> Value:
        """A string expression, a Column with its type declared, or a batch callable."""
        if isinstance(what, str):
            return self._names[what] if what in self._names else self._binder().expression(what)
        if isinstance(what, Column):
            return Value(what, returns or "f64")
        if callable(what):
            return self._called(what, columns, returns)
        raise TypeError(f"can't evaluate {what!r}")

    def _called(self, f: Callable, columns: list[str] | None, returns: str | None) -> Value:
        """A Python function of batches: arrays in, an array of the same length out."""
        names = list(columns or inspect.signature(f).parameters)
        values = [self.bound(n) for n in names]
        kind = CAST_NAMES.get(returns or "double", returns or "f64")
        depth = 1 if (returns or "").startswith("RVec<") else 0
        if depth:
            kind = CAST_NAMES[returns[5:-1]]

        def batches(*series: pd.Series) -> pd.Series:
            out = f(*[s.to_numpy() for s in series])
            if len(out) != len(series[0]):
                raise ValueError(f"{getattr(f, '__name__', 'the function')} gave {len(out)} values for {len(series[0])} entries")
            return pd.Series(list(out) if depth else out)

        batches.__signature__ = inspect.Signature([inspect.Parameter(f"a{i}", inspect.Parameter.POSITIONAL_OR_KEYWORD, annotation=pd.Series) for i in range(max(1, len(names)))], return_annotation=pd.Series)
        batches.__annotations__ = {f"a{i}": pd.Series for i in range(max(1, len(names)))} | {"return": pd.Series}
        udf = F.pandas_udf(batches, array_of(kind, depth))
        return Value(udf(*[v.column for v in values]), kind, depth)

    def _new_name(self, name: str, exists: bool) -> None:
        if not _IDENTIFIER.match(name) or name in _KEYWORDS or name.startswith("rdf"):
            raise ExpressionError(f"{name!r} can't name a column")
        if (name in self._names) != exists:
            raise ExpressionError(f"there is {'no' if exists else 'already a'} column {name!r}")

    def _step(self, kind: str, value: Column | None = None, label: str = "", span: tuple = ()) -> Step:
        number = next(self._graph.numbers)
        step = Step(number, kind, f"__{kind[0]}{number}", value, self._gate, label, span)
        self._graph.steps.append(step)
        return step

    # columns ----------------------------------------------------------------------------------------------------

    def _define(self, name: str, v: Value) -> Frame:
        step = self._step("define", v.column)
        own = Value(F.col(step.column), v.kind, v.depth, v.fields)
        defined = [*self._defined, *([name] if name not in self._defined else [])]
        return self._child(_names=self._names | {name: own}, _defined=defined, _steps=(*self._steps, step))

    def Define(self, name: str, expression, columns: list[str] | None = None, returns: str | None = None) -> Frame:
        self._new_name(name, False)
        return self._define(name, self.bound(expression, columns, returns))

    def Redefine(self, name: str, expression, columns: list[str] | None = None, returns: str | None = None) -> Frame:
        self._new_name(name, True)
        return self._define(name, self.bound(expression, columns, returns))

    def DefineRandom(self, name: str, kind: str, *parameters: float, seed: int = 0) -> Frame:
        """A random column by entry number: uniform, gaussian, exponential, integer, breit_wigner, poisson, binomial."""
        from eventframe.functions import random

        self._new_name(name, False)
        if self._entry is None:
            raise UnsupportedFeature("random columns need an entry number: give Frame(df, entry=...)")
        whole = kind in ("integer", "poisson", "binomial")
        v = random.KINDS[kind](self._entry, *parameters, seed=seed)
        return self._define(name, Value(v.cast("long") if whole else v, "i64" if whole else "f64"))

    def DefinePerSample(self, name: str, values: dict[str, float] | Callable[[str], float], default: float = 0.0) -> Frame:
        """One value per source file: those whose path contains a key, or a function of the path."""
        self._new_name(name, False)
        if "__file" not in self._graph.base.columns:
            raise UnsupportedFeature("DefinePerSample needs a frame over files")
        path = F.col("__file")
        if callable(values):
            paths = [r[0] for r in self._graph.base.select("__file").distinct().collect()]
            values = {p: values(p) for p in paths}
        out = F.lit(default)
        for text, v in values.items():
            out = F.when(path.contains(text), F.lit(v)).otherwise(out)
        return self._define(name, Value(out.cast("double"), "f64"))

    def Alias(self, name: str, of: str) -> Frame:
        self._new_name(name, False)
        if of not in self._names:
            raise ExpressionError(f"there is no column {of!r}")
        return self._child(_names=self._names | {name: self._names[of]})

    def DefaultValueFor(self, name: str, value) -> Frame:
        v = self._names[name]
        if v.depth:
            raise ExpressionError("only numbers have default values")
        return self._define(name, Value(F.coalesce(v.column, F.lit(value).cast(spark_type(v.kind))), v.kind))

    # selections ----------------------------------------------------------------------------------------------------

    def Filter(self, condition, *rest, name: str = "", columns: list[str] | None = None) -> Frame:
        for r in rest:
            name, columns = (r, columns) if isinstance(r, str) else (name, r)
        v = self.bound(condition, columns, None if isinstance(condition, str) else "bool")
        if v.depth or v.kind in ("str", "struct", "tuple", "opaque"):
            raise ExpressionError("the condition of a Filter must be a number")
        step = self._step("filter", ieee.truth(v.column, v.kind), name)
        return self._child(_steps=(*self._steps, step), _gate=step.column, _labels=(*self._labels, name))

    def FilterAvailable(self, name: str) -> Frame:
        step = self._step("filter", self._names[name].column.isNotNull())
        return self._child(_steps=(*self._steps, step), _gate=step.column, _labels=(*self._labels, ""))

    def FilterMissing(self, name: str) -> Frame:
        step = self._step("filter", self._names[name].column.isNull())
        return self._child(_steps=(*self._steps, step), _gate=step.column, _labels=(*self._labels, ""))

    def Range(self, begin: int, end: int | None = None, stride: int = 1) -> Frame:
        """``Range(end)`` or ``Range(begin, end, stride)``; end 0 is the table's end."""
        if end is None:
            begin, end = 0, begin
        if stride < 1 or begin < 0 or end and end < begin:
            raise ExpressionError("a Range rises, from 0 on")
        step = self._step("range", span=(begin, end, stride))
        return self._child(_steps=(*self._steps, step), _gate=step.column, _labels=(*self._labels, ""))

    # scalars ----------------------------------------------------------------------------------------------------------

    def _book(self, kind: str, finish: Callable, columns=None) -> Result:
        b = Booked(self, kind, finish, columns)
        self._graph.pending.append(b)
        return Result(b)

    def _numbers(self, what) -> Value:
        v = self.bound(what if what is not None else self._default[0])
        if v.kind not in KINDS or v.kind == "str":
            raise ExpressionError("this result takes numbers")
        return Value(v.column.cast(array_of("i32", v.depth)), "i32", v.depth) if v.kind == "bool" else v

    def Count(self) -> Result:
        return self._book("scalar", int, lambda g: [F.count_if(g)])

    def Sum(self, what=None) -> Result:
        v = self._numbers(what)
        work = "double" if floating(v.kind) else "long"
        each = lambda x: F.aggregate(x, F.lit(0).cast(work), lambda a, e: a + e.cast(work))
        return self._book("scalar", lambda s: s if s is not None else 0, lambda g: [_flat(v, g, each, lambda x: F.sum(x.cast(work)))])

    def _counted(self, v: Value, g: Column) -> Column:
        return F.coalesce(F.sum(F.when(g, F.size(v.column))), F.lit(0)) if v.depth else F.count(F.when(g, v.column))

    def Mean(self, what=None) -> Result:
        v = self._numbers(what)
        each = lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + e.cast("double"))
        return self._book("scalar", lambda s, n: s / n if n else 0.0, lambda g: [_flat(v, g, each, lambda x: F.sum(x.cast("double"))), self._counted(v, g)])

    def _extreme(self, what, largest: bool) -> Result:
        v = self._numbers(what)
        _, bits, signed, real, *_ = KINDS[v.kind]
        top = {32: 3.4028234663852886e38, 64: 1.7976931348623157e308}[bits] if real else (1 << bits - signed) - 1
        none = (-top if real or signed else 0) - (signed and not real) if largest else top
        each = F.array_max if largest else F.array_min
        odd = lambda g: F.max(F.when(g, F.exists(v.column, lambda e: F.isnan(e)) if v.depth else F.isnan(v.column))) if real else F.lit(False)
        return self._book("scalar", lambda m, nan: none if m is None else math.nan if nan else m, lambda g: [_flat(v, g, each, F.max if largest else F.min), odd(g)])

    def Min(self, what=None) -> Result:
        return self._extreme(what, False)

    def Max(self, what=None) -> Result:
        return self._extreme(what, True)

    def StdDev(self, what=None) -> Result:
        v = self._numbers(what)
        if not v.depth:
            return self._book("scalar", lambda s, n: s if n > 1 else 0.0, lambda g: [F.stddev_samp(F.when(g, v.column.cast("double"))), self._counted(v, g)])
        each = lambda power: (lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + F.pow(e.cast("double"), F.lit(power))))
        return self._book(
            "scalar", lambda s, q, n: math.sqrt(max(0.0, (q - s * s / n) / (n - 1))) if n > 1 else 0.0,
            lambda g: [_flat(v, g, each(1.0), F.sum), _flat(v, g, each(2.0), F.sum), self._counted(v, g)],
        )

    def Stats(self, what=None, weight=None) -> Result:
        v = self._numbers(what)
        w = self._numbers(weight) if weight is not None else None
        if v.depth:
            raise UnsupportedFeature("Stats of collections")
        x, wt = v.column.cast("double"), w.column.cast("double") if w else F.lit(1.0)

        def finish(n, sw, sw2, swx, swxx, low, high):
            if not n:
                return Statistic(0, 0.0, 0.0, 0.0, 0.0, math.inf, -math.inf)
            m2 = swxx - swx * swx / sw if sw else 0.0
            return Statistic(n, sw, sw2, swx / sw if sw else 0.0, max(0.0, m2 / sw * n / (n - 1)) if n > 1 and sw else 0.0, low, high)

        return self._book("scalar", finish, lambda g: [F.count(F.when(g, x)), *[F.sum(F.when(g, e)) for e in (wt, wt * wt, wt * x, wt * x * x)], F.min(F.when(g, x)), F.max(F.when(g, x))])

    def Aggregate(self, function: Callable[..., Column], *columns) -> Result:
        """A Spark aggregate of columns that reach this node: ``function(column, ...)``."""
        values = [self.bound(c) for c in columns]
        return self._book("scalar", lambda x: x, lambda g: [function(*[F.when(g, v.column) for v in values])])

    def Reduce(self, fold: Callable, what=None, init=None) -> Result:
        """Fold of a column by a commutative function: ``sum``, ``min``, ``max``, ``numpy.multiply`` by Spark, others over ordered values."""
        known = {sum: F.sum, np.add: F.sum, min: F.min, np.minimum: F.min, max: F.max, np.maximum: F.max, np.multiply: F.product}
        v = self._numbers(what)
        if fold in known and not v.depth:
            return self._book("scalar", lambda x: x if init is None else init if x is None else fold([init, x]) if fold in (sum, min, max) else fold(init, x), lambda g: [known[fold](F.when(g, v.column))])
        step = self._define("__reduced", v)

        def finish(df):
            out = init
            for (x,) in df.select(step._names["__reduced"].column).toLocalIterator():
                for e in x if v.depth else [x]:
                    out = e if out is None else fold(out, e)
            return out

        return step._book("rows", finish)

    def AggregateBatches(self, start: Callable, update: Callable, merge: Callable, columns: list[str]) -> Result:
        """A user's aggregate: ``update(state, batch)`` on the executors, ``merge(a, b)`` of small states in order on the driver."""
        from eventframe.operators.readers import fold_batches

        for c in columns:
            self.bound(c)
        return self._book("rows", lambda df: fold_batches(df.select(*[self._names[c].column.alias(c) for c in columns]), start, update, merge))

    def Book(self, helper, columns: list[str]) -> Result:
        """A helper with ``start() update(state, batch) merge(a, b) finish(state)``."""
        whole = self.AggregateBatches(helper.start, helper.update, helper.merge, columns)
        inner = whole._booked.finish
        whole._booked.finish = lambda df: helper.finish(inner(df))
        return whole

    def FillObject(self, thing, *columns: str) -> Result:
        """``thing.Fill(*row)`` in entry order on the driver, a partition at a time."""
        names = [self._names[c].column for c in columns]

        def finish(df):
            for row in df.select(*names).toLocalIterator():
                thing.Fill(*row)
            return thing

        return self._book("rows", finish)

    # binned results ---------------------------------------------------------------------------------------------------------

    def _bins(self, axes: list[Axis], values: list[Value], weight: Value | None, accept: Callable[[Column], Column] | None = None):
        """For the planner: one struct per fill, or an array of them where collections are filled."""
        deep = [v for v in [*values, *([weight] if weight else [])] if v.depth]

        def struct(hid: int, xs: list[Column], w: Column) -> Column:
            xs = [x.cast("double") for x in xs]
            bins = [a.bin(x) for a, x in zip(axes, xs)]
            nothing = F.lit(None)
            fields = [F.lit(hid).alias("hid")]
            fields += [(bins[k] if k < len(bins) else nothing).cast("int").alias(f"b{c}") for k, c in enumerate(_XYZ)]
            fields += [w.cast("double").alias("w")]
            fields += [(xs[k] if k < len(xs) else nothing).cast("double").alias(c) for k, c in enumerate(_XYZ)]
            return F.struct(*fields)

        def build(hid: int) -> tuple[Column, bool]:
            w = weight.column if weight else F.lit(1.0)
            if not deep and not accept:
                return struct(hid, [v.column for v in values], w), False
            if not deep:
                one = F.array(struct(hid, [v.column for v in values], w))
                return F.when(accept(values[-1].column), one).otherwise(F.slice(one, 1, 0)), True
            first = deep[0].column
            agree = [F.size(v.column) == F.size(first) for v in deep[1:]]
            pick = lambda v, i: F.get(v.column, i) if v.depth else v.column
            rows = F.transform(first, lambda _, i: struct(hid, [pick(v, i) for v in values], pick(weight, i) if weight else F.lit(1.0)))
            if accept:
                rows = F.filter(rows, lambda r: accept(r[_XYZ[len(values) - 1]]))
            for ok in agree:
                rows = F.when(ok, rows).otherwise(F.raise_error(ieee.where("collections of different sizes", self._entry)).cast("array<struct<hid:int,bx:int,by:int,bz:int,w:double,x:double,y:double,z:double>>"))
            return rows, True

        build.dim = len(values)
        return build

    def _histogram(self, dim: int, args: tuple) -> Result:
        model, columns = (args[0], args[1:]) if args and isinstance(args[0], (tuple, list, Histogram)) else (None, args)
        columns = list(columns) or list(self._default)
        values = [self._numbers(c) for c in columns[: dim + 1]]
        weight = values.pop() if len(values) > dim else None
        if len(values) != dim:
            raise ExpressionError(f"a histogram of {dim} axes takes {dim} columns")
        if model is None:
            if dim != 1:
                raise ExpressionError("a histogram of more axes needs a model")
            return self._auto(str(columns[0]), values[0], weight)
        h = model.copy().reset() if isinstance(model, Histogram) else histogram_model(model, dim)
        return self._book("binned", lambda rows: h.copy().add_bins(rows), self._bins(h.axes, values, weight))

    def _auto(self, name: str, v: Value, weight: Value | None) -> Result:
        """128 bins: limits from the first 1000 values, doubled until all fit."""
        node = self._define("__auto", v)
        df = self._graph.filtered(list(node._steps))
        x = F.explode(node._names["__auto"].column) if v.depth else node._names["__auto"].column
        ordered = df.orderBy(self._graph.entry) if self._graph.entry else df
        first = [r[0] for r in ordered.select(x.alias("x")).where("x is not null and not isnan(double(x))").limit(1000).collect()]
        low, high = df.select(x.alias("x")).where("not isnan(double(x)) and abs(double(x)) < double('inf')").agg(F.min("x"), F.max("x")).first()
        if not first:
            axis = Axis(128, 0.0, 1.0)
        else:
            bins, a, b = good_limits(128, float(min(first)), float(max(first)), not floating(v.kind))
            while low < a:
                a -= b - a
            while high >= b:
                b += b - a
            axis = Axis(bins, a, b)
        h = Histogram([axis], name, name)
        return self._book("binned", lambda rows: h.copy().add_bins(rows), self._bins(h.axes, [v], weight))

    def Histo1D(self, *args) -> Result:
        return self._histogram(1, args)

    def Histo2D(self, *args) -> Result:
        return self._histogram(2, args)

    def Histo3D(self, *args) -> Result:
        return self._histogram(3, args)

    def Fill(self, model: Histogram, *columns) -> Result:
        return self._histogram(model.dim, (model, *columns))

    def _profile(self, dim: int, args: tuple) -> Result:
        model, *columns = args
        values = [self._numbers(c) for c in columns]
        weight = values.pop() if len(values) > dim + 1 else None
        p = profile_model(model, dim) if not isinstance(model, Profile) else model
        accept = p.accepts if p.y_range else None

        def finish(rows):
            value = _XYZ[dim]
            out = Profile(p.axes, p.y_range, p.option, p.name, p.title)
            return out.add_bins({**r, "wy": r[f"m_w{value}"], "wyy": r[f"m_w{value}{value}"]} for r in rows)

        return self._book("binned", finish, self._bins(p.axes, values, weight, accept))

    def Profile1D(self, *args) -> Result:
        return self._profile(1, args)

    def Profile2D(self, *args) -> Result:
        return self._profile(2, args)

    # ordered results ------------------------------------------------------------------------------------------------------------

    def Take(self, what) -> Result:
        v = self.bound(what)
        return self._define("__taken", v)._rows(["__taken"], lambda t: t["__taken"].to_pylist())

    def _rows(self, names: list[str], finish: Callable) -> Result:
        return self._book("rows", lambda df: finish(df.select(*[self._names[n].column.alias(n) for n in names]).toArrow()))

    def Graph(self, x, y) -> Result:
        a, b = self._numbers(x), self._numbers(y)
        node = self._define("__x", a)._define("__y", b)

        def finish(table):
            px, py = table["__x"].to_pylist(), table["__y"].to_pylist()
            if a.depth or b.depth:
                pairs = [(u, w) for p, q in zip(px, py) for u, w in (zip(p if a.depth else [p] * len(q), q if b.depth else [q] * len(p)))]
                px, py = zip(*pairs) if pairs else ((), ())
            return Graph(np.array(px, float), np.array(py, float), f"{y}_vs_{x}", f"{y} vs {x}")

        return node._rows(["__x", "__y"], finish)

    def _chosen(self, columns=None, exclude=None) -> list[str]:
        names = sorted(n for n in self._names if not n.startswith("__"))
        if isinstance(columns, str):
            names = [n for n in names if not columns or re.search(columns, n)]
        elif columns:
            names = list(columns)
        return [n for n in names if n not in (exclude or ())]

    def AsNumpy(self, columns=None, exclude=None) -> dict[str, np.ndarray]:
        names = self._chosen(columns, exclude)

        def arrays(t):
            return {n: np.array(t[n].to_pylist(), object) if self._names[n].depth or self._names[n].kind in ("str", "struct", "opaque") else t[n].to_numpy() for n in names}

        return self._rows(names, arrays).GetValue()

    def Display(self, columns=None, rows: int = 5, elements: int = 10) -> Result:
        names = self._chosen(columns)

        def box(df) -> str:
            table = df.select(*[self._names[n].column.alias(n) for n in names]).limit(rows).collect()
            cells = [["Row", *names]]
            for k, r in enumerate(table):
                cells.append([str(k), *["[" + ", ".join(map(str, x[:elements])) + (", ..." if len(x) > elements else "") + "]" if isinstance(x, list) else str(x) for x in r]])
            widths = [max(len(c[i]) for c in cells) for i in range(len(cells[0]))]
            bar = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
            lines = ["| " + " | ".join(f"{x:<{w}}" for x, w in zip(c, widths)) + " |" for c in cells]
            return "\n".join([bar, lines[0], bar, *lines[1:], bar])

        return self._book("rows", box)

    def Report(self) -> Result:
        """Of the named selections that lead here; at the root, of all there are."""
        steps = [s for s in (self._steps or self._graph.steps) if s.kind == "filter" and s.label]
        every = self._steps or tuple(self._graph.steps)

        def columns(_gate):
            return [c for s in steps for c in (F.count_if(F.col(s.gate) if s.gate else F.lit(True)), F.count_if(F.col(s.column)))]

        def finish(*counts):
            return Report(CutInfo(s.label, int(counts[2 * k + 1]), int(counts[2 * k])) for k, s in enumerate(steps))

        return self._child(_steps=every, _gate=None)._book("report", finish, columns)

    # side effects and outputs ------------------------------------------------------------------------------------------------------

    def dataframe(self, columns=None, exclude=None) -> DataFrame:
        """This node as a plain DataFrame: defined columns first, then the source's."""
        chosen = set(self._chosen(columns, exclude))
        order = [*self._defined, *[n for n in self._names if n not in self._defined]]
        df = self._graph.filtered(list(self._steps))
        keep = [F.col(self._graph.entry).alias(ENTRY)] if self._graph.entry else []
        return df.select(*keep, *[self._names[n].column.alias(n) for n in order if n in chosen])

    def Snapshot(self, path: str, columns=None, mode: str = "overwrite", **options) -> Frame:
        """Write this node as Parquet and return a frame over it."""
        df = self.dataframe(columns)
        if self._graph.entry:
            df = df.orderBy(ENTRY).drop(ENTRY)
        df.write.options(**options).mode({"RECREATE": "overwrite", "UPDATE": "append"}.get(mode, mode)).parquet(path)
        return Frame(path, spark=df.sparkSession)

    def Cache(self, columns=None) -> Frame:
        df = self.dataframe(columns).persist()
        return Frame(df, entry=ENTRY if ENTRY in df.columns else None)

    def Foreach(self, f: Callable, columns: list[str]) -> None:
        """``f`` of each batch of entries, on the executors."""
        df = self.dataframe(columns).select(*columns)

        def each(batches):
            for b in batches:
                f(*[b[c].to_numpy() for c in columns])
            yield from ()

        df.mapInPandas(each, "done int").count()

    # what there is ---------------------------------------------------------------------------------------------------------------------

    def GetColumnNames(self) -> list[str]:
        return sorted(n for n in self._names if not n.startswith("__"))

    def GetDefinedColumnNames(self) -> list[str]:
        return sorted(self._defined)

    def HasColumn(self, name: str) -> bool:
        return name in self._names

    def GetColumnType(self, name: str) -> str:
        return self._names[name].cpp()

    def GetFilterNames(self) -> list[str]:
        return [x or "Unnamed Filter" for x in self._labels]

    def GetNRuns(self) -> int:
        return self._graph.runs

    def Describe(self) -> str:
        return "\n".join(f"{n:<24} {self.GetColumnType(n):<40} {'Define' if n in self._defined else 'Dataset'}" for n in self.GetColumnNames())


def histogram_model(model, dim: int) -> Histogram:
    """``[name[, title]]`` and per axis ``n, low, high``, ``n, edges`` or ``edges``."""
    parts, name, title = list(model), "", ""
    if parts and isinstance(parts[0], str):
        name = title = parts.pop(0)
        if parts and isinstance(parts[0], str):
            title = parts.pop(0)
    axes = []
    for _ in range(dim):
        if hasattr(parts[0], "__len__"):
            axes.append(Axis.of(parts.pop(0)))
        elif hasattr(parts[1], "__len__"):
            axes.append(Axis.of([parts.pop(0), parts.pop(0)]))
        else:
            axes.append(Axis.of([parts.pop(0) for _ in range(3)]))
    h = Histogram(axes, name, title)
    h.rest = parts
    return h


def profile_model(model, dim: int) -> Profile:
    h = histogram_model(model, dim)
    rest, option = list(h.rest), ""
    if rest and isinstance(rest[-1], str):
        option = rest.pop()
    return Profile(h.axes, tuple(rest[:2]) if len(rest) >= 2 else None, option, h.name, h.title)


#: Functions of batches that expressions may call by name: function and C++ type of the result.
DECLARED: dict[str, tuple[Callable, str]] = {}


def declare(name: str, f: Callable, returns: str = "double") -> None:
    """Let expressions call a Python function of arrays by name; it runs on whole Arrow batches."""
    if not _IDENTIFIER.match(name):
        raise ExpressionError(f"{name!r} can't name a function")
    DECLARED[name] = (f, returns)


def _declared(f: Callable, returns: str) -> Callable[..., Value]:
    kind = CAST_NAMES[returns]

    def call(*args: Value) -> Value:
        @F.arrow_udf(spark_type(kind))
        def batch(rows: pa.Array) -> pa.Array:
            return pa.array(np.asarray(f(*[c.to_numpy(zero_copy_only=False) for c in rows.flatten()])))

        return Value(batch(F.struct(*[a.column.alias(f"x{i}") for i, a in enumerate(args)])), kind)

    return call


def run_graphs(*results: Result) -> int:
    """Run everything pending on the frames of these results; the number of runs."""
    graphs = {id(r._booked.node._graph): r._booked.node._graph for r in results if not r._booked.done}
    for g in graphs.values():
        g.run()
    return len(graphs)


def default_parallelism(spark: SparkSession) -> int:
    """Tasks that run side by side; what a pool's size stands for here."""
    return spark.sparkContext.defaultParallelism


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


for _n in [n for n in vars(Frame) if n[0].isupper()]:
    setattr(Frame, _snake(_n), getattr(Frame, _n))
