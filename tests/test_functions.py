"""Functions over arrays against the standard library, identities and edge values."""

import math
import os
import sqlite3
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventframe import Frame
from eventframe.frame import declare
from eventframe.functions import special, textual
from eventframe.hist import Histogram
from eventframe.hist.axis import good_limits
from eventframe.operators import relational
from eventframe.sources import sinks, tables, text
from eventframe.streaming import events as streams


@pytest.mark.parametrize(("f", "g", "low", "high"), [(special.erf, math.erf, -8, 8), (special.erfc, math.erfc, -8, 20), (special.gamma, math.gamma, 0.01, 160), (special.gamma, math.gamma, -20.3, -0.1), (special.log_gamma, math.lgamma, 0.01, 1e6), (special.log_gamma, math.lgamma, -30.7, -0.2)])
def test_against_the_standard_library(f, g, low, high):
    x = np.random.default_rng(1).uniform(low, high, 2000)
    want = np.array([g(v) for v in x])
    assert np.allclose(f(x), want, rtol=1e-11, atol=1e-290 if f is not special.log_gamma else 1e-11)
    assert f(float(x[0])) == pytest.approx(want[0], rel=1e-11)


@given(st.floats(1e-12, 1 - 1e-12))
@settings(max_examples=60, deadline=None)
def test_quantiles_invert(p):
    assert special.normal_quantile(p) == pytest.approx(NormalDist().inv_cdf(p), rel=1e-9, abs=1e-9)
    for cdf, quantile, args in ((special.chi2_cdf, special.chi2_quantile, (3.5,)), (special.student_cdf, special.student_quantile, (4.0,)), (special.f_cdf, special.f_quantile, (3.0, 6.0)), (special.beta_cdf, special.beta_quantile, (0.7, 2.0)), (special.gamma_cdf, special.gamma_quantile, (0.4, 2.0))):
        assert cdf(quantile(p, *args), *args) == pytest.approx(p, rel=1e-7, abs=1e-12)


def test_edges_of_distributions():
    assert special.normal_quantile([0.0, 1.0]).tolist() == [-math.inf, math.inf]
    assert special.beta_pdf([0, 0, 0, 1.5], [0.5, 1, 2, 2], [2, 3, 2, 2]).tolist() == pytest.approx([math.inf, 3.0, 0.0, 0.0])
    assert special.poisson_pdf([0, -1], [0.0, 2.0]).tolist() == pytest.approx([1.0, 0.0]) and special.binomial_pdf([0, 10, 11], [0, 1, 0.5], 10).tolist() == pytest.approx([1.0, 1.0, 0.0])
    assert special.poisson_cdf(2.5, 1) == pytest.approx(5 / 2 * math.exp(-1))
    assert special.binomial_cdf(2.5, 0.3, 10) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3)))
    assert math.isnan(special.chi2_cdf(math.nan, 2)) and special.incomplete_gamma(2, math.inf) == 1 and special.gamma(171) == pytest.approx(float(math.factorial(170)), rel=1e-14)
    assert special.erf([]).shape == (0,) and special.f_cdf(-1, 2, 3) == 0 and special.landau_pdf(0.0) == pytest.approx(0.178854, abs=1e-6)
    assert special.landau_pdf(1.0, -1.0) == 0 and special.cyl_bessel_k(1, 0.0) == math.inf and special.sph_bessel(0, 0.0) == pytest.approx(1)


def test_nulls_stay_null(spark):
    f = Frame(spark.createDataFrame([(1.0,), (None,), (math.nan,)], "x double")).Define("y", "TMath::Erf(x)").dataframe(["y"])
    got = [r[0] for r in f.collect()]
    assert got[0] == pytest.approx(math.erf(1)) and got[1] is None and math.isnan(got[2])


def test_extremes_of_collections_with_nan(spark):
    df = spark.createDataFrame([([1.0, math.nan, 3.0],), ([4.0, 2.0],), ([],)], "v array<double>")
    got = Frame(df).Define("top", "ArgMax(v)").Define("low", "ArgMin(v)").dataframe(["top", "low"]).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 1), (0, 0)]
    alone = spark.createDataFrame([([1.0, math.nan, 3.0],)], "v array<double>")
    assert math.isnan(Frame(alone).Define("m", "Max(v)").Define("n", "Min(v)").dataframe(["m", "n"]).first()[1])


def test_whole_limits():
    for low, high in ((0, 99), (3, 7), (-5, 5), (0, 1000), (2, 2)):
        n, a, b = good_limits(128, float(low), float(high), True)
        assert a == int(a) and b == int(b) and (b - a) / n == int((b - a) / n) >= 1 and a <= low and b > high
    assert good_limits(100, 0.0, 99.0) == (100, -0.99, 108.0)


def test_files_of_a_chain_come_in_the_order_of_the_arguments(spark, tmp_path):
    for i in range(12):
        spark.range(2).select(F.lit(i).alias("part")).coalesce(1).write.parquet(f"{tmp_path}/part-{i}")
    order = [1, 2, 10, 0, 11]
    got = tables.parquet(spark, *[f"{tmp_path}/part-{i}" for i in order]).orderBy("__entry").collect()
    assert [r["part"] for r in got] == [i for i in order for _ in range(2)] and [r["__entry"] for r in got] == list(range(10))
    globs = tables.parquet(spark, f"{tmp_path}/part-1[01]", f"{tmp_path}/part-{{2,3}}")
    assert [r["part"] for r in globs.orderBy("__entry").collect()] == [10, 10, 11, 11, 2, 2, 3, 3]


def test_matches_are_carried_over_parts(spark, monkeypatch):
    monkeypatch.setattr(tables, "CARRIED", 3)
    a = spark.createDataFrame([(i, i) for i in range(20)], "__entry long, k int")
    b = spark.createDataFrame([(0, 1, 1.5), (1, 9, 2.5)], "__entry long, k int, v double")
    assert [r["f_v"] for r in tables.keyed_join(a, b, "f", ["k"]).orderBy("__entry").collect()] == [None] + [1.5] * 8 + [2.5] * 11


def test_declared_and_textual_functions(spark):
    declare("scaled", lambda x, n: x * n)
    df = spark.sql("select 2.0 x, timestamp'2024-03-05 06:07:08' t, '{\"a\": {\"b\": 7}}' j, map('k', 4.0) m")
    f = Frame(df).Define("y", "scaled(x, 3) + 1").Define("d", "Year(t) * 100 + Month(t)").Define("b", 'JsonNumber(j, "$.a.b")').Define("k", 'MapNumber(m, "k")').Define("n", 'strstr(j, "zz") ? 1 : 0')
    assert tuple(f.dataframe(["y", "d", "b", "k", "n"]).select("y", "d", "b", "k", "n").first()) == (7.0, 202403, 7.0, 4.0, 0)
    moment = textual.unpacked_time(20240305, 60708)
    assert textual.packed_time(moment) == (20240305, 60708)


def test_single_bins_and_poisson_limits():
    h = Histogram([(4, 0.0, 4.0)])
    for x in (0.5, 1.5, 1.6, 2.5):
        h.fill(x)
    assert h.bin_content(2) == 2 and h.bin_error(2) == pytest.approx(math.sqrt(2))
    down, up = h.bin_error_limits(1)
    assert down == pytest.approx(0.8272, abs=1e-3) and up == pytest.approx(2.2995, abs=1e-3) and h.bin_error_limits(4)[0] == 0
    h.set_bin_content(1, 9.0)
    assert h.interpolated(1.0) == pytest.approx(5.5) and h.interpolated(0.5, 2) == pytest.approx(9.0)


def test_sqlite_and_table_functions(spark, tmp_path):
    file = os.path.join(tmp_path, "t.db")
    with sqlite3.connect(file) as con:
        con.execute("create table t (a integer, b real, c text)")
        con.executemany("insert into t values (?, ?, ?)", [(i, i / 2, f"n{i}") for i in range(5)])
    t = text.sqlite(spark, file, "select * from t where a > 1")
    assert [(f.name, f.dataType.simpleString()) for f in t.schema][:3] == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert [r["c"] for r in t.orderBy("__entry").collect()] == ["n2", "n3", "n4"]
    made = relational.table_function(t, lambda r: [(k,) for k in range(r["a"] - 2)], "k int", ["a"])
    assert sorted((r["a"], r["k"]) for r in made.collect()) == [(3, 0), (4, 0), (4, 1)]


def test_drained_streams_are_stored(spark, tmp_path):
    spark.range(10).select(F.col("id"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, ts timestamp").parquet(f"{tmp_path}/in")
    assert streams.drained(streams.deduplicated(stream, "ts", ["id"]), sinks.new_folder(spark), "append").count() == 10
    empty = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").where("id < 0").groupBy("id").count()
    assert streams.drained(empty, sinks.new_folder(spark)).count() == 0
