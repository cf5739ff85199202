"""Functions of collections, as Spark higher-order functions. All take and give bound values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventframe.functions import ieee, scalar
from eventframe.types import ExpressionError, Value, array_of, common, floating, promoted, spark_type

_LONG = "i64"


def _must(v: Value, name: str) -> None:
    if v.depth != 1:
        raise ExpressionError(f"{name} takes a collection")


def _same_size(a: Value, b: Value, out: Column, kind: str, entry: Column | None) -> Column:
    unequal = F.raise_error(ieee.where("collections of different sizes", entry)).cast(array_of(kind))
    return F.when(F.size(a.column) == F.size(b.column), out).otherwise(unequal)


def broadcast2(f: Callable[[Column, Column], Column], a: Value, b: Value, kind: str, entry: Column | None = None) -> Value:
    """A function of two numbers, on scalars and collections alike."""
    if not a.depth and not b.depth:
        return Value(f(a.column, b.column), kind)
    if a.depth and b.depth:
        return Value(_same_size(a, b, F.zip_with(a.column, b.column, f), kind, entry), kind, 1)
    if a.depth:
        return Value(F.transform(a.column, lambda x: f(x, b.column)), kind, 1)
    return Value(F.transform(b.column, lambda y: f(a.column, y)), kind, 1)


def broadcast(f: Callable[..., Column], args: list[Value], kind: str, entry: Column | None = None) -> Value:
    """A function of any number of scalars or collections."""
    deep = [i for i, a in enumerate(args) if a.depth]
    if not deep:
        return Value(f(*[a.column for a in args]), kind)
    if len(deep) == 1:
        k = deep[0]
        return Value(F.transform(args[k].column, lambda x: f(*[x if i == k else a.column for i, a in enumerate(args)])), kind, 1)
    # wrapped, so that fields are named by their places, and each collection is made once for all elements
    rows = F.arrays_zip(*[F.transform(args[i].column, lambda x: x) for i in deep])
    one = lambda r: f(*[r.getField(str(deep.index(i))) if i in deep else a.column for i, a in enumerate(args)])
    out = F.transform(rows, one)
    for k in deep[1:]:
        out = _same_size(args[deep[0]], args[k], out, kind, entry)
    return Value(out, kind, 1)


def total(v: Value, start: Column | None = None, kind: str | None = None) -> Value:
    """Sum in the element type; of truth values, their number."""
    kind = kind or (_LONG if v.kind == "bool" else v.kind)
    work = "double" if floating(kind) else "long"
    zero = (start if start is not None else F.lit(0)).cast(work)
    out = F.aggregate(v.column, zero, lambda acc, x: acc + (x.cast("int") if v.kind == "bool" else x).cast(work))
    return Value(out.cast(spark_type(kind)), kind)


def _double(v: Value) -> Column:
    return F.transform(v.column, lambda x: x.cast("double"))


def mean(v: Value) -> Value:
    s = F.aggregate(_double(v), F.lit(0.0), lambda a, x: a + x)
    return Value(F.when(F.size(v.column) > 0, s / F.when(F.size(v.column) > 0, F.size(v.column)).otherwise(1)).otherwise(0.0), "f64")


def variance(v: Value) -> Value:
    n = F.size(v.column).cast("double")
    s = F.aggregate(_double(v), F.lit(0.0), lambda a, x: a + x)
    q = F.aggregate(_double(v), F.lit(0.0), lambda a, x: a + x * x)
    safe = F.when(n > 1, n).otherwise(2.0)
    return Value(F.when(n > 1, (q - s * s / safe) / (safe - 1)).otherwise(0.0), "f64")


def _extreme(f, name: str):
    def run(v: Value, entry=None) -> Value:
        _must(v, name)
        empty = F.raise_error(ieee.where(f"{name} of an empty collection", entry)).cast(spark_type(v.kind))
        return Value(F.when(_odd(v), F.lit(math.nan).cast(spark_type(v.kind))).when(F.size(v.column) > 0, f(v.column)).otherwise(empty), v.kind)

    return run


def _odd(v: Value) -> Column:
    """Whether any element is not a number: then so are the extremes, and no element equals them."""
    return F.exists(v.column, lambda x: F.isnan(x)) if floating(v.kind) else F.lit(False)


def _arg_extreme(f):
    """The first of the extreme elements; 0 where there is none."""
    return lambda v, entry=None: Value(F.when((F.size(v.column) > 0) & ~_odd(v), F.array_position(v.column, f(v.column)) - 1).otherwise(0).cast("long"), "u64")


def taken(v: Value, which: Value, default: Value | None = None, entry: Column | None = None) -> Value:
    """By positions, or the first n (last -n)."""
    _must(v, "Take")
    if which.depth:
        bad = F.exists(which.column, lambda i: (i < 0) | (i >= F.size(v.column)))
        got = F.transform(which.column, lambda i: F.get(v.column, i.cast("int")))
        return Value(F.when(~bad, got).otherwise(F.raise_error(ieee.where("Take past the end", entry)).cast(array_of(v.kind))), v.kind, 1)
    n, size = which.column.cast("int"), F.size(v.column)
    some = F.when(n >= 0, F.slice(v.column, F.lit(1), F.least(n, size).cast("int"))).otherwise(F.slice(v.column, F.greatest(size + n, F.lit(0)) + 1, F.least(-n, size).cast("int")))
    if default is None:
        return Value(F.when(F.abs(n) <= size, some).otherwise(F.raise_error(ieee.where("Take past the end", entry)).cast(array_of(v.kind))), v.kind, 1)
    pad = F.array_repeat(default.column.cast(spark_type(v.kind)), F.greatest(F.abs(n) - size, F.lit(0)).cast("int"))
    return Value(F.when(n >= 0, F.concat(some, pad)).otherwise(F.concat(pad, some)), v.kind, 1)


def positions(v: Value) -> Column:
    return F.transform(v.column, lambda x, i: i.cast("long"))


def sorted_positions(v: Value) -> Value:
    pairs = F.array_sort(F.transform(v.column, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))
    return Value(F.transform(pairs, lambda p: p["i"]), "u64", 1)


def masked(v: Value, mask: Value, entry: Column | None = None) -> Value:
    kept = F.filter(v.column, lambda x, i: ieee.truth(F.get(mask.column, i), mask.kind))
    return Value(_same_size(v, mask, kept, v.kind, entry), v.kind, 1)


def whole_range(low: Column, high: Column, step: Column) -> Column:
    """Half-open; empty where there is nothing between."""
    low, high, step = (c.cast("long") for c in (low, high, step))
    safe = F.when(step == 0, F.raise_error(F.lit("Range with a stride of zero")).cast("long")).otherwise(step)
    count = F.greatest(F.lit(0), F.ceil((high - low) / safe)).cast("long")
    seq = F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long")))
    return F.when(count > 0, F.transform(seq, lambda i: low + i * safe)).otherwise(F.slice(F.array(F.lit(0).cast("long")), 1, 0))


def _extended(tuples: Column, following: Callable[[Column], Column]) -> Column:
    """Each tuple with each of the positions that may follow it."""
    return F.flatten(F.transform(tuples, lambda t: F.transform(following(t), lambda j: F.concat(t, F.array(j)))))


def _members(tuples: Column, k: int) -> Column:
    def member(i: int) -> Column:
        return F.transform(tuples, lambda t: F.get(t, F.lit(i)))

    return F.struct(*[member(i).alias(f"_{i}") for i in range(k)])


def combinations(v: Column, k: int) -> Column:
    """Positions of all k-subsets of a collection of n, as k arrays in lexicographic order."""
    n, one = F.size(v).cast("long"), F.lit(1).cast("long")
    tuples = F.transform(whole_range(F.lit(0), n, one), lambda i: F.array(i))
    for _ in range(k - 1):
        tuples = _extended(tuples, lambda t: whole_range(F.element_at(t, -1) + 1, n, one))
    return _members(tuples, k)


def products(sizes: list[Column]) -> Column:
    """Positions of all pairs (or more) across collections, the last running fastest."""
    tuples = F.transform(whole_range(F.lit(0), sizes[0], F.lit(1)), lambda i: F.array(i))
    for n in sizes[1:]:
        every = whole_range(F.lit(0), n, F.lit(1))
        tuples = _extended(tuples, lambda t, every=every: every)
    return _members(tuples, len(sizes))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def delta_phi(a: Column, b: Column, c: Column | float = math.pi) -> Column:
    c = c if isinstance(c, Column) else F.lit(c)
    turned = lambda r: F.when(r < -c, r + c * 2).when(r > c, r - c * 2).otherwise(r)
    return let(b.cast("double") - a.cast("double"), lambda d: let(ieee.remainder(d, c.cast("double") * 2), turned))


def momentum(pt: Column, eta: Column, phi: Column, m: Column) -> list[Column]:
    pt, eta, phi, m = (c.cast("double") for c in (pt, eta, phi, m))
    x, y, z = pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta)
    return [x, y, z, F.hypot(F.hypot(x, y), F.hypot(z, m))]


def mass_of(sums: list[Column]) -> Column:
    """Of momentum and energy."""
    names = "xyze"
    return let(F.struct(*[s.alias(n) for n, s in zip(names, sums)]), lambda p: F.sqrt(p["e"] * p["e"] - p["x"] * p["x"] - p["y"] * p["y"] - p["z"] * p["z"]))


def invariant_mass(args: list[Value], entry: Column | None = None) -> Value:
    kind = "f64" if any(a.kind != "f32" for a in args) else "f32"
    parts = [broadcast(lambda *c, k=k: momentum(*c)[k], args, "f64", entry).column for k in range(4)]
    sums = [F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) for p in parts]
    return Value(mass_of(sums).cast(spark_type(kind)), kind)


def invariant_masses(args: list[Value], entry: Column | None = None) -> Value:
    kind = "f64" if any(a.kind != "f32" for a in args) else "f32"

    def mass(*c: Column) -> Column:
        return mass_of([x + y for x, y in zip(momentum(*c[:4]), momentum(*c[4:]))]).cast(spark_type(kind))

    return broadcast(mass, args, kind, entry)


def _fold(kind: str) -> str:
    return "f32" if kind == "f32" else "f64"


def _angles(f, n: int):
    def run(*args: Value, entry=None) -> Value:
        kind = "f32" if all(a.kind == "f32" for a in args[:n]) else "f64"
        return broadcast(lambda *c: f(*c).cast(spark_type(kind)), list(args), kind, entry)

    return run


def _delta_r2(e1, e2, p1, p2, c=math.pi):
    apart = F.struct((e1.cast("double") - e2.cast("double")).alias("d"), delta_phi(p1, p2, c).alias("p"))
    return let(apart, lambda s: s["d"] * s["d"] + s["p"] * s["p"])


def _combinations(*args: Value, entry=None) -> Value:
    if len(args) == 2 and not args[1].depth:
        raise ExpressionError("the size of Combinations must be a literal")
    struct = products([F.size(a.column) for a in args])
    return Value(struct, "tuple", 0, tuple((f"_{i}", "u64", 1) for i in range(len(args))))


def _range(*args: Value, entry=None) -> Value:
    cols = [a.column for a in args]
    low, high, step = (F.lit(0), cols[0], F.lit(1)) if len(cols) == 1 else (*cols, F.lit(1)) if len(cols) == 2 else cols
    return Value(whole_range(low, high, step), "i64", 1)


def _where(c: Value, a: Value, b: Value, entry=None) -> Value:
    kind = a.kind if a.kind == b.kind else common(a.kind, b.kind)
    to = spark_type(kind)
    return broadcast(lambda t, x, y: F.when(ieee.truth(t, c.kind), x.cast(to)).otherwise(y.cast(to)), [c, a, b], kind, entry)


def _plain(f):
    """Without an entry to name."""
    return lambda *a, entry=None: f(*a)


#: Name: (least arguments, most, function of values with ``entry``).
REGISTRY: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "Sum": (1, 2, _plain(lambda v, z=None: total(v, z.column if z else None, z.kind if z else None))),
    "Product": (1, 1, _plain(lambda v: Value(F.aggregate(_double(v), F.lit(1.0), lambda a, x: a * x).cast(spark_type(promoted(v.kind))), promoted(v.kind)))),
    "Mean": (1, 1, _plain(mean)),
    "Var": (1, 1, _plain(variance)),
    "StdDev": (1, 1, _plain(lambda v: Value(F.sqrt(variance(v).column), "f64"))),
    "Max": (1, 1, _extreme(F.array_max, "Max")),
    "Min": (1, 1, _extreme(F.array_min, "Min")),
    "ArgMax": (1, 1, _arg_extreme(F.array_max)),
    "ArgMin": (1, 1, _arg_extreme(F.array_min)),
    "Any": (1, 1, _plain(lambda v: Value(F.exists(v.column, lambda x: ieee.truth(x, v.kind)), "bool"))),
    "All": (1, 1, _plain(lambda v: Value(F.forall(v.column, lambda x: ieee.truth(x, v.kind)), "bool"))),
    "Dot": (2, 2, lambda a, b, entry=None: total(broadcast2(lambda x, y: x.cast("double") * y.cast("double"), a, b, "f64", entry), kind=common(a.kind, b.kind))),
    "Take": (2, 3, lambda v, w, d=None, entry=None: taken(v, w, d, entry)),
    "Nonzero": (1, 1, _plain(lambda v: Value(F.filter(positions(v), lambda i: ieee.truth(F.get(v.column, i.cast("int")), v.kind)), "u64", 1))),
    "Where": (3, 3, _where),
    "Argsort": (1, 1, _plain(sorted_positions)),
    "StableArgsort": (1, 1, _plain(sorted_positions)),
    "Sort": (1, 1, _plain(lambda v: Value(F.array_sort(v.column), v.kind, 1))),
    "Reverse": (1, 1, _plain(lambda v: Value(F.reverse(v.column), v.kind, 1))),
    "Concatenate": (2, 2, _plain(lambda a, b: (lambda k: Value(F.concat(a.column.cast(array_of(k)), b.column.cast(array_of(k))), k, 1))(a.kind if a.kind == b.kind else common(a.kind, b.kind)))),
    "Drop": (2, 2, _plain(lambda v, i: Value(F.filter(v.column, lambda x, k: ~F.array_contains(F.transform(i.column, lambda j: j.cast("long")), k.cast("long"))), v.kind, 1))),
    "Intersect": (2, 2, _plain(lambda a, b: Value(F.filter(a.column, lambda x: F.array_contains(b.column.cast(array_of(a.kind)), x)), a.kind, 1))),
    "Enumerate": (1, 1, _plain(lambda v: Value(positions(v), "u64", 1))),
    "Range": (1, 3, _range),
    "Combinations": (2, 4, _combinations),
    "DeltaPhi": (2, 3, _angles(delta_phi, 2)),
    "DeltaR2": (4, 5, _angles(_delta_r2, 4)),
    "DeltaR": (4, 5, _angles(lambda *c: F.sqrt(_delta_r2(*c)), 4)),
    "InvariantMass": (4, 4, lambda *a, entry=None: invariant_mass(list(a), entry)),
    "InvariantMasses": (8, 8, lambda *a, entry=None: invariant_masses(list(a), entry)),
    "Size": (1, 1, _plain(lambda v: Value(F.size(v.column).cast("long"), "u64"))),
}
for _name in list(REGISTRY):
    REGISTRY[f"VecOps::{_name}"] = REGISTRY[f"ROOT::VecOps::{_name}"] = REGISTRY[_name]


def mapped(name: str, args: list[Value], entry: Column | None = None) -> Value:
    """A function of numbers from the scalar registry, element by element where it meets collections."""
    f, kind = scalar.function(name, len(args))
    if any(a.kind in ("str", "struct", "tuple", "opaque") for a in args):
        raise ExpressionError(f"{name} takes numbers")
    narrow = kind == "f64" and args and all(a.kind == "f32" for a in args) and not name.startswith(("TMath::", "ROOT::"))
    out = "f32" if narrow else kind
    return broadcast(lambda *c: f(*c).cast(spark_type(out)), args, out, entry)


