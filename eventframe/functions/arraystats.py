"""Statistics of arrays: on the driver's arrays, and as columns over array columns or rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventframe.functions.special import kolmogorov_probability

# ---- arrays on the driver ------------------------------------------------------------------------------


def min_element(a: Sequence[float]) -> float:
    return float(np.min(a))


def max_element(a: Sequence[float]) -> float:
    return float(np.max(a))


def loc_min(a: Sequence[float]) -> int:
    return int(np.argmin(a)) if len(a) else -1


def loc_max(a: Sequence[float]) -> int:
    return int(np.argmax(a)) if len(a) else -1


def mean(a: Sequence[float], w: Sequence[float] | None = None) -> float:
    a = np.asarray(a, float)
    if not len(a):
        return 0.0
    return float(a.mean()) if w is None else float(np.dot(a, w) / np.sum(w))


def geometric_mean(a: Sequence[float]) -> float:
    return float(np.exp(np.log(np.abs(np.asarray(a, float))).mean())) if len(a) else 0.0


def rms(a: Sequence[float], w: Sequence[float] | None = None) -> float:
    """Standard deviation with n - 1; 0 for fewer than two."""
    a = np.asarray(a, float)
    if len(a) < 2:
        return 0.0
    if w is None:
        return float(a.std(ddof=1))
    w = np.asarray(w, float)
    s = float((w * (a - mean(a, w)) ** 2).sum())
    return math.sqrt(s * w.sum() / (w.sum() ** 2 - (w * w).sum()))


def median(a: Sequence[float], w: Sequence[float] | None = None) -> float:
    """The middle value; with weights, where half of them are at either side."""
    a = np.asarray(a, float)
    if not len(a):
        return 0.0
    if w is None:
        return float(np.median(a))
    order = np.argsort(a, kind="stable")
    run = np.cumsum(np.asarray(w, float)[order])
    k = int(np.searchsorted(run, run[-1] / 2))
    return float(0.5 * (a[order[k]] + a[order[k + 1]])) if run[k] == run[-1] / 2 else float(a[order[k]])


def order_statistic(a: Sequence[float], k: int) -> float:
    return float(np.partition(np.asarray(a, float), k)[k])


def sort_index(a: Sequence[float], down: bool = True) -> np.ndarray:
    return np.argsort(-np.asarray(a, float) if down else a, kind="stable")


def binary_search(a: Sequence[float], value: float) -> int:
    """The last element of a sorted array that is at most ``value``, -1 if none."""
    return int(np.searchsorted(a, value, "right")) - 1


def quantiles(a: Sequence[float], p: Sequence[float], kind: int = 7) -> np.ndarray:
    """By one of the nine usual definitions."""
    names = ["inverted_cdf", "averaged_inverted_cdf", "closest_observation", "interpolated_inverted_cdf", "hazen", "weibull", "linear", "median_unbiased", "normal_unbiased"]
    return np.quantile(np.asarray(a, float), p, method=names[kind - 1])


def kolmogorov_test(a: Sequence[float], b: Sequence[float], option: str = "") -> float:
    """Probability that two sorted samples come from one distribution; ``M``: their distance."""
    every = np.concatenate([a, b])
    d = float(np.abs(np.searchsorted(a, every, "right") / len(a) - np.searchsorted(b, every, "right") / len(b)).max())
    return d if "M" in option else kolmogorov_probability(d * math.sqrt(len(a) * len(b) / (len(a) + len(b))))


def next_permutation(a: list) -> bool:
    """In lexicographic order, in place; false after the last, which stays."""
    k = next((i for i in range(len(a) - 2, -1, -1) if a[i] < a[i + 1]), -1)
    if k < 0:
        return False
    j = max(i for i in range(k + 1, len(a)) if a[i] > a[k])
    a[k], a[j] = a[j], a[k]
    a[k + 1 :] = a[: k : -1]
    return True


def gradient(f: Sequence[float], h: float = 1.0) -> np.ndarray:
    return np.gradient(np.asarray(f, float), h)


def laplacian(f: Sequence[float], h: float = 1.0) -> np.ndarray:
    f = np.asarray(f, float)
    out = np.empty_like(f)
    out[1:-1] = (f[2:] - 2 * f[1:-1] + f[:-2]) / (h * h)
    out[0], out[-1] = (f[2] - 2 * f[1] + f[0]) / (h * h), (f[-1] - 2 * f[-2] + f[-3]) / (h * h)
    return out


def normalize(v: Sequence[float]) -> tuple[np.ndarray, float]:
    v = np.asarray(v, float)
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v), n


def cross(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    return np.cross(a, b)


# ---- columns ---------------------------------------------------------------------------------------------


def column_median(v: Column) -> Column:
    """Of each array."""
    s, n = F.array_sort(v), F.size(v)
    low, high = F.get(s, ((n - 1) / 2).cast("int")), F.get(s, (n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0).otherwise(0.0)


def column_order_statistic(v: Column, k: int) -> Column:
    return F.get(F.array_sort(v), F.lit(k))


def column_binary_search(v: Column, value: Column) -> Column:
    return F.size(F.filter(v, lambda x: x <= value)) - 1


def column_gradient(v: Column, h: float = 1.0) -> Column:
    n = F.size(v)

    def at(_, i: Column) -> Column:
        low, high = F.greatest(i - 1, F.lit(0)), F.least(i + 1, n - 1)
        return F.when(high > low, (F.get(v, high) - F.get(v, low)) / F.greatest((high - low) * h, F.lit(h)))

    return F.transform(v, at)


def row_quantiles(df: DataFrame, column: str, p: Sequence[float]) -> list[float]:
    """Exact quantiles of rows, linear between order statistics."""
    return list(df.agg(F.percentile(column, F.array(*map(F.lit, p)))).first()[0])


def row_geometric_mean(column: str) -> Column:
    return F.exp(F.avg(F.ln(F.abs(F.col(column).cast("double")))))


def weighted_rms(x: Column, w: Column) -> Column:
    """Of rows, from four sums."""
    sw, sww, swx, swxx = F.sum(w), F.sum(w * w), F.sum(w * x), F.sum(w * x * x)
    return F.sqrt((swxx - swx * swx / sw) * sw / (sw * sw - sww))


def kolmogorov_distance(a: DataFrame, b: DataFrame, column: str, cells: int = 4096) -> float:
    """Largest gap of the running shares of two tables, whole but for ties, without a global sort.

    Values are counted in cells between the extremes first; inside a cell a
    window adds up. No task sees more than a cell.
    """
    rows = a.select(F.col(column).alias("x"), F.lit(1).alias("first")).union(b.select(F.col(column), F.lit(0))).where("x is not null")
    low, high, n, m = rows.agg(F.min("x"), F.max("x"), F.sum("first"), F.count("*") - F.sum("first")).first()
    if not n or not m:
        return 0.0
    span = float(high - low) or 1.0
    rows = rows.withColumn("cell", F.least(F.floor((F.col("x") - low) / span * cells), F.lit(cells - 1)))
    at = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("first") / float(n) - (1 - F.col("first")) / float(m)
    ahead = rows.groupBy("cell").agg(F.sum(gap).alias("g")).select(F.col("cell").alias("of"), F.coalesce(F.sum("g").over(at), F.lit(0.0)).alias("ahead"))
    inside = Window.partitionBy("cell").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("g", F.sum(gap).over(inside)).join(ahead, F.col("cell") == F.col("of"))
    return float(found.agg(F.max(F.abs(F.col("g") + F.col("ahead")))).first()[0])
