"""Relational operations that the event model lacks, with the plans that hold at scale."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join; Spark broadcasts a side whose size it knows to be small, and splits skewed partitions."""
    return left.join(right, list(keys), how)


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str], prefix: str = "last_") -> DataFrame:
    """Each left row with the right row of its key that is the latest at or before its time.

    Both sides in one sort per key, the last seen value carried forward: one
    shuffle, no pairs.
    """
    keys = list(by)
    a = left.select(*keys, F.col(time), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    b = right.select(*keys, F.col(time), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.struct(*values).alias("__right"))
    order = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    held = a.unionByName(b).withColumn("__held", F.last("__right", ignorenulls=True).over(order)).where("__left is not null")
    return held.select("__left.*", *[F.col(f"__held.{v}").alias(f"{prefix}{v}") for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges ``[low, high)`` that hold them: equal keys are cells of ``width``, so no side meets all of the other."""
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = ranges.withColumn("__cell", F.explode(cells))
    return points.withColumn("__cell", F.floor(F.col(point) / width)).join(spread, "__cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__cell")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts groups down before the shuffle (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, into: str = "running") -> DataFrame:
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.sum(value).over(frame))


def sessions(df: DataFrame, by: str, time: str, gap_seconds: int) -> DataFrame:
    """Session numbers of each key's rows: a new one after a longer gap."""
    order = Window.partitionBy(by).orderBy(time)
    fresh = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(order).cast("timestamp"))) > gap_seconds * 1_000_000
    return df.withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def category_table(df: DataFrame, category: str, weight: str | None = None) -> DataFrame:
    """Weighted count of each state."""
    return df.groupBy(category).agg((F.sum(weight) if weight else F.count("*")).alias("content"))


def difference(a: DataFrame, b: DataFrame, key: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Rows that one table lacks, or whose numbers differ by more than a tolerance."""
    values = [c for c in a.columns if c not in key]
    both = a.alias("a").join(b.alias("b"), list(key), "full_outer")
    unequal = F.lit(False)
    numeric = {n for n, t in a.dtypes if t in ("double", "float")}
    for v in values:
        x, y = F.col(f"a.{v}"), F.col(f"b.{v}")
        unequal = unequal | (F.abs(x - y) > tolerance if v in numeric else ~x.eqNullSafe(y)) | (x.isNull() != y.isNull())
    return both.where(unequal).select(*key, *[F.col(f"a.{v}").alias(f"a_{v}") for v in values], *[F.col(f"b.{v}").alias(f"b_{v}") for v in values])


def table_function(df: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str, columns: Sequence[str]) -> DataFrame:
    """Rows that a Python function makes of each row, beside that row: batches on the executors, nothing gathered."""
    made = T._parse_datatype_string(schema)
    whole = T.StructType([*df.schema.fields, *made.fields])

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, values in enumerate(zip(*[b.column(c).to_pylist() for c in columns])):
                found = list(f(dict(zip(columns, values))))
                at += [i] * len(found)
                rows += found
            own = pa.Table.from_batches([b]).take(pa.array(at, pa.int64()))
            for k, field in enumerate(made.fields):
                own = own.append_column(field.name, pa.array([r[k] for r in rows], to_arrow_type(field.dataType)))
            yield from own.combine_chunks().to_batches()

    return df.mapInArrow(run, whole)


def approximate_distinct(df: DataFrame, by: Sequence[str], column: str, error: float = 0.02) -> DataFrame:
    """Distinct values by a sketch that merges across partitions."""
    return df.groupBy(*by).agg(F.approx_count_distinct(column, error).alias("about"))
