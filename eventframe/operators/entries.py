"""Selections of entries as tables, text of cuts, and operations on weighted datasets."""

from __future__ import annotations

import fnmatch
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.sources.tables import ENTRY, FILE


class EntryList:
    """A set of entries: (entry) or (file, entry) rows; set operations stay distributed."""

    def __init__(self, rows: DataFrame, name: str = ""):
        self.rows, self.name = rows.distinct(), name

    @property
    def keys(self) -> list[str]:
        return self.rows.columns

    @classmethod
    def of(cls, df: DataFrame, condition: Column, name: str = "") -> EntryList:
        return cls(df.where(condition).select(ENTRY), name)

    @classmethod
    def numbers(cls, spark: SparkSession, entries: Sequence[int], name: str = "") -> EntryList:
        return cls(spark.createDataFrame([(int(e),) for e in entries], f"{ENTRY} long"), name)

    def enter(self, entries: Sequence[int]) -> EntryList:
        return self.add(EntryList.numbers(self.rows.sparkSession, entries))

    def enter_range(self, start: int, end: int, step: int = 1) -> EntryList:
        return EntryList(self.rows.union(self.rows.sparkSession.range(start, end, step).select(F.col("id").alias(ENTRY))), self.name)

    def remove(self, entries: Sequence[int]) -> EntryList:
        return self.subtract(EntryList.numbers(self.rows.sparkSession, entries))

    def add(self, other: EntryList) -> EntryList:
        return EntryList(self.rows.unionByName(other.rows), self.name)

    def subtract(self, other: EntryList) -> EntryList:
        return EntryList(self.rows.join(other.rows, self.keys, "left_anti"), self.name)

    def intersect(self, other: EntryList) -> EntryList:
        return EntryList(self.rows.join(other.rows, self.keys, "left_semi"), self.name)

    def contains(self, entry: int) -> bool:
        return not self.rows.where(F.col(ENTRY) == entry).isEmpty()

    def __len__(self) -> int:
        return self.rows.count()

    def select(self, df: DataFrame) -> DataFrame:
        """Rows of a table whose entries are in the list."""
        return df.join(self.rows, self.keys, "left_semi")

    def for_file(self, file: str) -> EntryList:
        return EntryList(self.rows.where(F.col(FILE).contains(file)), self.name)


class Cut:
    """Text of a selection; combines with others, and nothing gives way."""

    def __init__(self, text: str = ""):
        self.text = str(text)

    def _with(self, other, op: str) -> Cut:
        other = other if isinstance(other, Cut) else Cut(other)
        if not self.text or not other.text:
            return Cut(self.text or other.text)
        return Cut(f"({self.text}){op}({other.text})")

    def __and__(self, other):
        return self._with(other, "&&")

    __add__ = __and__

    def __or__(self, other):
        return self._with(other, "||")

    def __mul__(self, other):
        return self._with(other, "*")

    def __invert__(self):
        return Cut(f"!({self.text})") if self.text else Cut()

    def __str__(self) -> str:
        return self.text


def negated(f: Callable) -> Callable:
    """The opposite of a batch condition."""
    def run(*arrays):
        return ~f(*arrays).astype(bool)

    import inspect

    run.__signature__ = inspect.signature(f)
    return run


def enabled(df: DataFrame, *patterns: str) -> DataFrame:
    """Columns whose names match a wildcard."""
    return df.select([c for c in df.columns if any(fnmatch.fnmatch(c, p) for p in patterns)])


# ---- weighted datasets ---------------------------------------------------------------------------------


class Dataset:
    """Rows of named variables, with a weight column or without."""

    def __init__(self, df: DataFrame, weight: str | None = None):
        self.df, self.weight = df, weight

    @property
    def w(self) -> Column:
        return F.col(self.weight).cast("double") if self.weight else F.lit(1.0)

    def reduce(self, variables: Sequence[str] | None = None, cut: Column | str | None = None, ranges: Mapping[str, tuple[float, float]] | None = None, entries: tuple[int, int] | None = None) -> Dataset:
        out = self.df
        if cut is not None:
            out = out.where(cut)
        for name, (low, high) in (ranges or {}).items():
            out = out.where(F.col(name).between(low, high))
        if entries:
            out = out.where((F.col(ENTRY) >= entries[0]) & (F.col(ENTRY) < entries[1]))
        if variables:
            out = out.select(*variables, *([self.weight] if self.weight and self.weight not in variables else []))
        return Dataset(out, self.weight)

    def sum_entries(self, cut: Column | str | None = None) -> float:
        return self.reduce(cut=cut).df.agg(F.coalesce(F.sum(self.w), F.lit(0.0))).first()[0]

    def moment(self, name: str, order: int, central: bool = False, cut: Column | str | None = None) -> float:
        x = F.col(name).cast("double") - (F.lit(self.mean(name, cut)) if central else F.lit(0.0))
        top, w = self.reduce(cut=cut).df.agg(F.sum(self.w * F.pow(x, F.lit(order))), F.sum(self.w)).first()
        return top / w if w else 0.0

    def mean(self, name: str, cut: Column | str | None = None) -> float:
        return self.moment(name, 1, cut=cut)

    def sigma(self, name: str, cut: Column | str | None = None) -> float:
        return math.sqrt(self.moment(name, 2, True, cut))

    def table(self, *categories: str) -> DataFrame:
        """Weighted count of each state, or each combination of states."""
        return self.df.groupBy(*categories).agg(F.sum(self.w).alias("content"))

    def append(self, other: Dataset) -> Dataset:
        return Dataset(self.df.unionByName(other.df), self.weight)

    def merge(self, other: DataFrame) -> Dataset:
        """Other columns beside these, by entry number."""
        return Dataset(self.df.join(other, ENTRY), self.weight)

    @staticmethod
    def of_slices(category: str, slices: Mapping[str, DataFrame]) -> DataFrame:
        """One table of several, told apart by a category."""
        out = None
        for name, df in slices.items():
            part = df.withColumn(category, F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    def negative_log_likelihood(self, density: Column) -> float:
        """Sum of -w ln p, in one aggregate."""
        return self.df.agg(F.sum(-self.w * F.ln(density))).first()[0]


# ---- learning and parallel calls ---------------------------------------------------------------------------


def roc(df: DataFrame, score: str, label: str, cells: int = 10_000) -> tuple[list[tuple[float, float]], float]:
    """Background rejection and signal efficiency at thresholds, and the area, from counts in cells of the score."""
    low, high = df.agg(F.min(score), F.max(score)).first()
    span = float(high - low) or 1.0
    cell = F.least(F.floor((F.col(score) - low) / span * cells), F.lit(cells - 1)).cast("int")
    counts = df.groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 1).alias("s"), F.count_if(F.col(label) != 1).alias("b")).orderBy(F.desc("cell")).collect()
    all_s, all_b = sum(r["s"] for r in counts), sum(r["b"] for r in counts)
    points, s, b, area = [(1.0, 0.0)], 0, 0, 0.0
    for r in counts:
        area += r["b"] * (s + 0.5 * r["s"])
        s, b = s + r["s"], b + r["b"]
        points.append((1 - b / all_b if all_b else 0.0, s / all_s if all_s else 0.0))
    return points, area / (all_s * all_b) if all_s and all_b else 0.0


def least_squares(df: DataFrame, y: str, terms: Sequence[Column], weight: Column | None = None) -> list[float]:
    """Coefficients of a linear model: the normal equations in one aggregate, solved on the driver."""
    import numpy as np

    w = weight if weight is not None else F.lit(1.0)
    n = len(terms)
    sums = [F.sum(w * terms[i] * terms[j]) for i in range(n) for j in range(i, n)] + [F.sum(w * t * F.col(y)) for t in terms]
    row = list(df.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first())
    a, k = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = row[k]
            k += 1
    return np.linalg.lstsq(a, np.array(row[k:]), rcond=None)[0].tolist()


def train_test_split(df: DataFrame, fraction: float, key: Column, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """By a hash of a key: the same row always falls on the same side."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(u < fraction), df.where(u >= fraction)


def padded(df: DataFrame, column: str, length: int) -> DataFrame:
    """A vector column spread to ``name_0 ...``, padded with zeros."""
    return df.select("*", *[F.coalesce(F.get(column, F.lit(k)), F.lit(0.0)).alias(f"{column}_{k}") for k in range(length)]).drop(column)


def batches(df: DataFrame, size: int, drop_remainder: bool = False) -> Iterator[pd.DataFrame]:
    """Rows in batches, a partition at a time on the driver."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held and not drop_remainder:
        yield pd.DataFrame(held, columns=df.columns)


def parallel_map(spark: SparkSession, f: Callable[[int], float], n: int) -> list[float]:
    """``f`` of 0 ... n - 1 on the executors, in order."""
    def run(parts):
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "value": [float(f(int(i))) for i in p["id"]]})

    rows = spark.range(n).mapInPandas(run, "id long, value double").orderBy("id").collect()
    return [r["value"] for r in rows]


def parallel_map_reduce(spark: SparkSession, f: Callable[[int], float], n: int, fold: Callable[[list[float]], float]) -> float:
    return fold(parallel_map(spark, f, n))
