"""Number operations with C++ results, the same whether Spark's ANSI mode is on or off.

Spark's own differ: division by zero raises or gives NULL, integers raise or
wrap, NaN equals itself and is larger than all, logarithms of nothing are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventframe.types import KINDS, common, floating, promoted, spark_type

INF, NAN = float("inf"), float("nan")


def cast(x: Column, kind: str) -> Column:
    return x.cast(spark_type(kind))


def wrapped(x: Column, kind: str) -> Column:
    """A whole number in long range, brought into a kind's range modulo its size."""
    _, bits, signed, _, to, _ = KINDS[kind]
    if bits == 64:
        return x.cast("long")
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    inside = x.between(F.lit(low), F.lit(high))
    return F.when(inside, x).otherwise(F.pmod(x - F.lit(low), F.lit(1 << bits)) + F.lit(low)).cast(to)


def _wide(op: str, a: Column, b: Column) -> Column:
    """64-bit arithmetic that wraps: the plain operation, and decimals only where it overflows."""
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    x, y = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
    exact = {"+": x + y, "-": x - y, "*": x * y}[op].cast("decimal(38,0)")
    size, half = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (64, 63))
    rest = F.pmod(exact, size)
    return F.coalesce(plain, F.when(rest >= half, rest - size).otherwise(rest).cast("long"))


def arithmetic(op: str, a: Column, ka: str, b: Column, kb: str) -> tuple[Column, str]:
    """``+ - *`` with the usual conversions."""
    kind = common(ka, kb)
    if floating(kind):
        x, y = a.cast("double"), b.cast("double")
        out = x + y if op == "+" else x - y if op == "-" else x * y
        return cast(out, kind), kind
    x, y = a.cast("long"), b.cast("long")
    if KINDS[kind][1] == 64:
        return _wide(op, x, y), kind
    out = x + y if op == "+" else x - y if op == "-" else x * y
    return wrapped(out, kind), kind


def divided(a: Column, b: Column) -> Column:
    """IEEE division of doubles."""
    x, y = a.cast("double"), b.cast("double")
    negative_zero = y.cast("string") == "-0.0"
    limit = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when((x > 0) != negative_zero, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(y == 0, limit).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def where(text: str, entry: Column | None) -> Column:
    return F.concat(F.lit(f"{text} in entry "), entry.cast("string")) if entry is not None else F.lit(text)


def quotient(a: Column, ka: str, b: Column, kb: str, entry: Column | None = None) -> tuple[Column, str]:
    """``/``: truncates whole numbers, an error at zero; IEEE for others."""
    kind = common(ka, kb)
    if floating(kind):
        return cast(divided(a, b), kind), kind
    x, y = a.cast("long"), b.cast("long")
    minus = wrapped(_wide("-", F.lit(0).cast("long"), x), kind)
    safe = F.when((y == 0) | (y == -1), F.lit(1).cast("long")).otherwise(y)
    out = F.when(y == 0, F.raise_error(where("division by zero", entry)).cast("long")).when(y == -1, minus.cast("long")).otherwise(F.call_function("div", x, safe))
    return wrapped(out, kind), kind


def modulo(a: Column, ka: str, b: Column, kb: str, entry: Column | None = None) -> tuple[Column, str]:
    """``%`` of whole numbers; the sign is the dividend's."""
    kind = common(ka, kb)
    x, y = a.cast("long"), b.cast("long")
    safe = F.when((y == 0) | (y == -1), F.lit(1).cast("long")).otherwise(y)
    out = F.when(y == 0, F.raise_error(where("division by zero", entry)).cast("long")).otherwise(x % safe)
    return wrapped(out, kind), kind


def compared(op: str, a: Column, b: Column, real: bool) -> Column:
    """A comparison as IEEE has it: nothing but ``!=`` holds of NaN."""
    out = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if not real:
        return out
    odd = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return odd | out if op == "!=" else ~odd & out


def shifted(op: str, a: Column, ka: str, b: Column) -> tuple[Column, str]:
    """``<< >>`` in the promoted left type; a count out of range gives 0."""
    kind = promoted(ka)
    bits, n = KINDS[kind][1], b.cast("long")
    step = F.pow(F.lit(2.0), F.when(n.between(0, 62), n).otherwise(0)).cast("long")
    x = a.cast("long")
    moved = _wide("*", x, step) if op == "<<" else F.floor(x.cast("decimal(38,0)") / step.cast("decimal(19,0)")).cast("long")
    if op == "<<" and bits == 64:
        moved = F.when(n == 63, F.when(x % 2 == 0, F.lit(0).cast("long")).otherwise(F.lit(-(1 << 63)).cast("long"))).otherwise(moved)
    return F.when((n < 0) | (n >= bits), F.lit(0)).otherwise(wrapped(moved, kind)).cast(spark_type(kind)), kind


def converted(x: Column, source: str, target: str, entry: Column | None = None) -> Column:
    """A C++ cast: truncates and wraps; NaN and infinities have no whole number."""
    if source == target:
        return x
    if target == "bool":
        return (x != 0) if source != "bool" else x
    if floating(target) or source == "bool":
        return cast(x.cast("double") if source != "bool" else x.cast("int"), target)
    if floating(source):
        d = x.cast("double")
        bad = F.isnan(d) | (F.abs(d) == INF)
        whole = F.when(d < 0, F.ceil(F.when(bad, 0.0).otherwise(d))).otherwise(F.floor(F.when(bad, 0.0).otherwise(d)))
        fits = F.abs(d) < F.lit(9.2e18)
        return F.when(bad, F.raise_error(where("no whole number", entry)).cast(spark_type(target))).otherwise(wrapped(F.when(fits, whole).otherwise(0).cast("long"), target))
    return wrapped(x.cast("long"), target)


def truth(x: Column, kind: str) -> Column:
    """Nonzero, NaN too."""
    return x if kind == "bool" else (x != 0)


def logarithm(f, x: Column) -> Column:
    """ln, log2 or log10 with -inf at 0 and NaN below."""
    d = x.cast("double")
    return F.when(d > 0, f(F.when(d > 0, d).otherwise(1.0))).when(d == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def least(a: Column, b: Column) -> Column:
    """The smaller; NaN if either is."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).otherwise(F.least(x, y))


def greatest(a: Column, b: Column) -> Column:
    return F.greatest(a.cast("double"), b.cast("double"))


def remainder(a: Column, b: Column) -> Column:
    """fmod."""
    x, y = a.cast("double"), b.cast("double")
    odd = (y == 0) | F.isnan(x) | F.isnan(y) | (F.abs(x) == INF)
    return F.when(odd, F.lit(NAN)).when(F.abs(y) == INF, x).otherwise(x % F.when(y == 0, 1.0).otherwise(y))


