import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventframe import Frame, Histogram
from eventframe.functions.function import Function
from eventframe.hist import more
from eventframe.operators import readers
from eventframe.sources import sinks


def test_functions():
    f = Function("[0]*sin([1]*x)", 0, math.pi, [2.0, 1.0])
    assert f(math.pi / 2) == pytest.approx(2) and f.integral() == pytest.approx(4) and f.derivative(0.0) == pytest.approx(2, rel=1e-6)
    assert f.root(1.0) == pytest.approx(math.pi / 6) and f.maximum()[0] == pytest.approx(math.pi / 2, abs=1e-5)
    g = Function("gaus + pol1", -5, 5, [1.0, 0.0, 1.0, 0.5, 0.1])
    assert g(0) == 1.5 and g(1) == pytest.approx(math.exp(-0.5) + 0.6)
    assert Function("x>1 ? x^2 : 3/2")(3) == 9 and Function("TMath::Prob(x, 2)")(0.0) == 1
    assert Function("exp(-x)", 0, 5).random(20_000).mean() == pytest.approx(1 - 5 * math.exp(-5) / (1 - math.exp(-5)), abs=0.03)


def test_function_columns(spark):
    f = Function("[0]*exp(-x*x) + x^3", 0, 1, [2.0])
    got = spark.createDataFrame([(0.5,)], "v double").select(f.column(F.col("v"))).first()[0]
    assert got == pytest.approx(f(0.5))


def test_random_columns_ignore_partitions(spark):
    def values(n):
        f = Frame(spark.range(2000).repartition(n).withColumnRenamed("id", "e"), entry="e")
        f = f.DefineRandom("g", "gaussian", 1.0, 2.0).DefineRandom("p", "poisson", 3.0, seed=4).DefineRandom("b", "binomial", 10, 0.3).DefineRandom("u", "uniform")
        return [r.GetValue() for r in (f.Mean("g"), f.StdDev("g"), f.Mean("p"), f.Mean("b"), f.Mean("u"))]

    a, b = values(1), values(7)
    assert a == pytest.approx(b) and a == pytest.approx([1, 2, 3, 3, 0.5], rel=0.1)


def test_user_aggregates(spark):
    f = Frame(100, spark=spark).Define("x", "double(rdfentry_)")
    total = f.Filter("x > 10").AggregateBatches(lambda: 0.0, lambda s, b: s + b["x"].sum(), lambda a, b: a + b, ["x"])
    assert total.GetValue() == sum(range(11, 100))

    class Longest:
        start = staticmethod(lambda: 0.0)
        update = staticmethod(lambda s, b: max(s, b["x"].max()))
        merge = staticmethod(max)
        finish = staticmethod(lambda s: s + 1)

    assert f.Book(Longest(), ["x"]).GetValue() == 100

    class Seen(list):
        def Fill(self, *row):
            self.append(row)

    assert f.Range(3).FillObject(Seen(), "x").GetValue() == [(0,), (1,), (2,)]


def test_readers_and_selectors(spark):
    df = spark.range(10).select(F.col("id").alias("__entry"), (F.col("id") * 2).alias("v")).repartition(3)
    r = readers.Reader(df)
    assert [x["v"] for x in r] == list(range(0, 20, 2)) and r.entry(4)["v"] == 8
    assert [x["__entry"] for x in r.set_range(2, 5)] == [2, 3, 4]
    assert readers.count_entries(df, "v>4") == 7

    class Total(readers.Selector):
        def start(self):
            return 0

        def process(self, state, batch):
            return state + int(batch["v"].sum())

        def merge(self, a, b):
            return a + b

    assert readers.process(df, Total()) == 90


def test_sinks(spark, tmp_path):
    df = spark.range(6).select(F.col("id").alias("__entry"), F.col("id").cast("double").alias("x"))
    out = sinks.write(df, f"file://{tmp_path}/a", ordered=True)
    assert sinks.write(df, f"file://{tmp_path}/a", "UPDATE").count() == 12 and out.columns[0] == "x"
    assert sinks.copy_where(df, f"file://{tmp_path}/b", "x>1", 0, 4).count() == 2
    assert sinks.copy_where(df, f"file://{tmp_path}/c", start=9).columns[0] == "x"
    sinks.write_ascii(df, f"file://{tmp_path}/d", ["x"])
    assert spark.read.text(f"file://{tmp_path}/d").count() == 6
    assert "x" in sinks.scan_to_file(df, "x", f"{tmp_path}/s.txt")
    sinks.partitioned(df.withColumn("k", F.col("x") % 2), f"file://{tmp_path}/e", ["k"])
    assert spark.read.parquet(f"file://{tmp_path}/e").where("k = 1").count() == 3


def test_histogram_indexing_and_stacks():
    h = Histogram([(10, 0.0, 10.0)]).fill_n(np.arange(0.5, 10), weights=np.arange(10))
    assert more.at(h, more.loc(3.5)) == 3 and more.at(h, more.loc(3.5) + 1) == 4
    assert list(more.at(h, slice(more.loc(2), None, more.rebin(2))).counts()) == [5, 9, 13, 17]
    assert more.Stack([h, h]).maximum() == 18 and more.Stack().add(h).sums()[0].entries == 10
    assert more.saturated(h.copy().scale(1000), "C").maximum() == 127
    assert more.filled_at_random(h.copy().reset(), lambda x: x, 1000).mean() == pytest.approx(6.67, abs=0.3)
    two = Histogram([(2, 0, 2), (2, 0, 2)]).fill(0.5, 0.5, weight=1).fill(1.5, 0.5, weight=3)
    assert more.interpolated(two, 1.0, 0.5) == 2


def test_triangles():
    points = [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.4)]
    z = [2 * x + 3 * y for x, y in points]
    assert more.interpolated_plane(points, z, 0.3, 0.6) == pytest.approx(2.4)
    assert more.interpolated_plane(points, z, 3, 3) == 0
    assert len(more.delaunay(points)) == 4
