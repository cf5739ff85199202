"""Profiles (mean of a value per bin), efficiencies and sparse histograms."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.functions import special
from eventframe.hist.axis import Axis

_XYZ = "xyz"


class Profile:
    """Per bin of one or two axes: sums of w, w y, w y^2 and w^2."""

    def __init__(self, axes: Iterable, y_range: tuple[float, float] | None = None, option: str = "", name: str = "", title: str = ""):
        self.axes = [Axis.of(a) for a in axes]
        self.y_range = y_range if y_range and tuple(y_range) != (0, 0) else None
        self.option, self.name, self.title, self.entries = option, name, title, 0.0
        shape = tuple(a.n + 2 for a in self.axes)
        self.w, self.wy, self.wyy, self.w2 = (np.zeros(shape) for _ in range(4))

    @property
    def dim(self) -> int:
        return len(self.axes)

    def accepts(self, y: Column) -> Column:
        """What a value range lets in; the rest isn't counted at all."""
        if not self.y_range:
            return F.lit(True)
        d = y.cast("double")
        return ~F.isnan(d) & (d >= self.y_range[0]) & (d <= self.y_range[1])

    def fill(self, *values, weight: float = 1.0) -> Profile:
        *x, y = values
        if self.y_range and not self.y_range[0] <= y <= self.y_range[1]:
            return self
        at = tuple(a.find(v) for a, v in zip(self.axes, x))
        for name, v in (("w", weight), ("wy", weight * y), ("wyy", weight * y * y), ("w2", weight * weight)):
            getattr(self, name)[at] += v
        self.entries += 1
        return self

    def fill_frame(self, df: DataFrame, *columns: Column | str, weight: Column | str | None = None) -> DataFrame:
        cols = [F.col(c) if isinstance(c, str) else c for c in columns]
        w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
        named = df.select(*[c.cast("double").alias(f"v{k}") for k, c in enumerate(cols)], w.alias("wt")).where(self.accepts(F.col(f"v{self.dim}")))
        y, wt = F.col(f"v{self.dim}"), F.col("wt")
        binned = named.select("*", *[a.bin(F.col(f"v{k}")).alias(f"b{_XYZ[k]}") for k, a in enumerate(self.axes)])
        return binned.groupBy(*[f"b{_XYZ[k]}" for k in range(self.dim)]).agg(F.count(F.lit(1)).alias("n"), F.sum(wt).alias("w"), F.sum(wt * y).alias("wy"), F.sum(wt * y * y).alias("wyy"), F.sum(wt * wt).alias("w2"))

    def add_bins(self, rows: Iterable) -> Profile:
        for r in rows:
            at = tuple(r[f"b{_XYZ[k]}"] for k in range(self.dim))
            for name in ("w", "wy", "wyy", "w2"):
                getattr(self, name)[at] += r[name]
            self.entries += r["n"]
        return self

    def _inner(self, a: np.ndarray, flow: bool) -> np.ndarray:
        return a if flow else a[tuple(slice(1, -1) for _ in self.axes)]

    def values(self, flow: bool = False) -> np.ndarray:
        w = np.where(self.w == 0, 1.0, self.w)
        return self._inner(np.where(self.w == 0, 0.0, self.wy / w), flow)

    def spreads(self, flow: bool = False) -> np.ndarray:
        w = np.where(self.w == 0, 1.0, self.w)
        return self._inner(np.where(self.w == 0, 0.0, np.sqrt(np.abs(self.wyy / w - (self.wy / w) ** 2))), flow)

    def errors(self, flow: bool = False, option: str | None = None) -> np.ndarray:
        """``""``: spread over root of effective entries; ``s``: spread; ``i``: as the first with 1/sqrt(12) for no spread; ``g``: 1/sqrt(sum w)."""
        option = self.option if option is None else option
        spread, w, w2 = self.spreads(True), self.w, self.w2
        if option == "s":
            return self._inner(spread, flow)
        safe = np.where(w > 0, w, 1.0)
        if option == "g":
            return self._inner(np.where(w > 0, 1 / np.sqrt(safe), 0.0), flow)
        n = np.where(w2 > 0, w * w / np.where(w2 > 0, w2, 1.0), 0.0)
        if option == "i":
            spread = np.where(spread == 0, 1 / math.sqrt(12), spread)
        return self._inner(np.where(n > 0, spread / np.sqrt(np.where(n > 0, n, 1.0)), 0.0), flow)

    def add(self, other: Profile) -> Profile:
        for name in ("w", "wy", "wyy", "w2"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.entries += other.entries
        return self

    def reset(self) -> Profile:
        self.__init__(self.axes, self.y_range, self.option, self.name, self.title)
        return self


LEVEL = 0.682689492137


class Efficiency:
    """Passed over total per bin, with intervals."""

    def __init__(self, passed: np.ndarray, total: np.ndarray, level: float = LEVEL, method: str = "clopper-pearson", prior: tuple[float, float] = (1.0, 1.0)):
        self.passed, self.total = np.asarray(passed, float), np.asarray(total, float)
        if (self.passed > self.total).any():
            raise ValueError("more passed than there are")
        self.level, self.method, self.prior = level, method, prior

    @staticmethod
    def counts(df: DataFrame, axis, value: Column | str, passes: Column) -> DataFrame:
        """bx, total and passed of each bin, in one aggregate."""
        axis = Axis.of(axis)
        value = F.col(value) if isinstance(value, str) else value
        return df.groupBy(axis.bin(value).alias("bx")).agg(F.count(F.lit(1)).alias("total"), F.count_if(passes).alias("passed"))

    @classmethod
    def of(cls, df: DataFrame, axis, value: Column | str, passes: Column, **how) -> Efficiency:
        axis = Axis.of(axis)
        passed, total = np.zeros(axis.n), np.zeros(axis.n)
        for r in cls.counts(df, axis, value, passes).collect():
            if 1 <= r["bx"] <= axis.n:
                passed[r["bx"] - 1], total[r["bx"] - 1] = r["passed"], r["total"]
        return cls(passed, total, **how)

    def merge(self, other: Efficiency) -> Efficiency:
        self.passed, self.total = self.passed + other.passed, self.total + other.total
        return self

    def values(self) -> np.ndarray:
        safe = np.where(self.total > 0, self.total, 1.0)
        if self.method == "bayesian":
            a, b = self.prior
            return (self.passed + a) / (self.total + a + b)
        return np.where(self.total > 0, self.passed / safe, 0.0)

    def intervals(self) -> list[tuple[float, float]]:
        return [self.interval(p, t) for p, t in zip(self.passed.ravel(), self.total.ravel())]

    def interval(self, p: float, t: float) -> tuple[float, float]:
        tail = (1 - self.level) / 2
        if self.method in ("clopper-pearson", "jeffreys", "uniform", "bayesian"):
            if self.method == "clopper-pearson":
                low = special.beta_quantile(tail, p, t - p + 1) if p > 0 else 0.0
                return low, special.beta_quantile(1 - tail, p + 1, t - p) if p < t else 1.0
            a, b = {"jeffreys": (0.5, 0.5), "uniform": (1.0, 1.0)}.get(self.method, self.prior)
            return special.beta_quantile(tail, p + a, t - p + b), special.beta_quantile(1 - tail, p + a, t - p + b)
        z = special.normal_quantile(1 - tail)
        if t <= 0:
            return 0.0, 1.0
        e = p / t
        if self.method == "normal":
            middle, half = e, z * math.sqrt(e * (1 - e) / t)
        elif self.method == "wilson":
            middle = (e + z * z / (2 * t)) / (1 + z * z / t)
            half = z / (1 + z * z / t) * math.sqrt(e * (1 - e) / t + z * z / (4 * t * t))
        elif self.method == "agresti-coull":
            n = t + z * z
            middle = (p + z * z / 2) / n
            half = z * math.sqrt(middle * (1 - middle) / n)
        else:
            raise NotImplementedError(f"no intervals of kind {self.method}")
        return max(0.0, middle - half), min(1.0, middle + half)


def sparse_bins(df: DataFrame, axes: Iterable, columns: list[Column | str], weight: Column | str | None = None) -> DataFrame:
    """Filled bins only, any number of axes: b0, b1, ..., n, content, sumw2."""
    axes = [Axis.of(a) for a in axes]
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    binned = df.select(*[a.bin(c).alias(f"b{k}") for k, (a, c) in enumerate(zip(axes, cols))], w.alias("wt"))
    return binned.groupBy(*[f"b{k}" for k in range(len(axes))]).agg(F.count(F.lit(1)).alias("n"), F.sum("wt").alias("content"), F.sum(F.col("wt") * F.col("wt")).alias("sumw2"))
