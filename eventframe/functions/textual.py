"""Functions of text, time, JSON and maps in frame expressions, and moments in time as numbers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventframe.types import ExpressionError, Value

#: Name: (number of arguments, function of columns, kind of the result).
REGISTRY: dict[str, tuple[int, Callable[..., Column], str]] = {
    "Year": (1, F.year, "i32"), "Month": (1, F.month, "i32"), "Day": (1, F.dayofmonth, "i32"), "Hour": (1, F.hour, "i32"), "Minute": (1, F.minute, "i32"), "Weekday": (1, F.weekday, "i32"), "DayOfYear": (1, F.dayofyear, "i32"),
    "UnixSeconds": (1, lambda t: F.unix_seconds(t.cast("timestamp")), "i64"), "strstr": (2, lambda s, x: F.contains(s, x), "bool"), "strlen": (1, lambda s: F.length(s).cast("long"), "i64"), "Upper": (1, F.upper, "str"), "Lower": (1, F.lower, "str"),
    "JsonText": (2, lambda s, path: F.call_function("get_json_object", s, path), "str"), "JsonNumber": (2, lambda s, path: F.call_function("get_json_object", s, path).try_cast("double"), "f64"), "MapText": (2, lambda m, k: F.try_element_at(m, k).cast("string"), "str"), "MapNumber": (2, lambda m, k: F.try_element_at(m, k).cast("double"), "f64"),
}


def call(name: str, args: list[Value]) -> Value:
    n, f, kind = REGISTRY[name]
    if len(args) != n:
        raise ExpressionError(f"{name} takes {n} arguments, not {len(args)}")
    if any(a.depth for a in args):
        raise ExpressionError(f"{name} takes single values")
    return Value(f(*[a.column for a in args]), kind)


def packed_time(t: datetime) -> tuple[int, int]:
    """A moment as a date and a time of digits: 20240131, 235959."""
    return t.year * 10000 + t.month * 100 + t.day, t.hour * 10000 + t.minute * 100 + t.second


def unpacked_time(date: int, time: int) -> datetime:
    return datetime(date // 10000, date // 100 % 100, date % 100, time // 10000, time // 100 % 100, time % 100, tzinfo=timezone.utc)
