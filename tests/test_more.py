import numpy as np
import pytest
from pyspark.sql import functions as F

from eventframe.functions import arraystats as s
from eventframe.hist import Graph, Histogram
from eventframe.hist import more
from eventframe.operators import entries as e


def test_array_statistics():
    a = [3.0, 1.0, 2.0, 10.0]
    assert (s.loc_min(a), s.loc_max(a), s.loc_min([]), s.median(a), s.order_statistic(a, 1)) == (1, 3, -1, 2.5, 2.0)
    assert s.median([1, 2, 3], [1, 1, 5]) == 3 and s.rms([1]) == 0 and s.rms([1, 2], [1, 1]) == pytest.approx(np.std([1, 2], ddof=1))
    assert s.binary_search([1, 3, 5], 4) == 1 and s.binary_search([1], 0) == -1
    p = [1, 2, 3]
    assert s.next_permutation(p) and p == [1, 3, 2] and not s.next_permutation([3, 2, 1])
    assert list(s.quantiles(range(5), [0.5])) == [2] and s.kolmogorov_test([1, 2, 3], [1, 2, 3], "M") == 0
    assert list(s.laplacian([0, 1, 4, 9])) == [2, 2, 2, 2]


def test_column_statistics(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],)], "v array<double>")
    assert [r[0] for r in df.select(s.column_median(F.col("v"))).collect()] == [2.0, 2.5]
    assert [r[0] for r in df.select(s.column_gradient(F.col("v"))).collect()] == [[-2.0, -0.5, 1.0], [-3.0, -3.0]]
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=300), rng.normal(0.3, size=200)
    a, b = (spark.createDataFrame([(float(v),) for v in z], "x double") for z in (x, y))
    assert s.kolmogorov_distance(a, b, "x", 16) == pytest.approx(s.kolmogorov_test(np.sort(x), np.sort(y), "M"))
    assert s.row_quantiles(a, "x", [0.1, 0.9]) == pytest.approx(np.quantile(x, [0.1, 0.9]).tolist())


def test_entry_lists(spark):
    a = e.EntryList.numbers(spark, [1, 2, 3, 3])
    assert len(a) == 3 and len(a.enter([9]).remove([1])) == 3 and len(a.enter_range(0, 10, 5)) == 5
    b = e.EntryList.numbers(spark, [3, 4])
    assert len(a.add(b)) == 4 and len(a.subtract(b)) == 2 and a.intersect(b).contains(3) and not a.contains(7)
    table = spark.range(5).withColumnRenamed("id", "__entry")
    assert sorted(r[0] for r in a.select(table).collect()) == [1, 2, 3]


def test_cuts():
    assert str(e.Cut("a>1") & "b<2") == "(a>1)&&(b<2)" and str(e.Cut() + "b") == "b" and str(~e.Cut("a")) == "!(a)"


def test_datasets(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, "a"), (1, 3.0, 1.0, "b"), (2, 5.0, 1.0, "a")], "__entry long, x double, w double, c string")
    d = e.Dataset(df, "w")
    assert d.sum_entries() == 4 and d.sum_entries("x > 2") == 2 and d.mean("x") == 2.5
    assert d.sigma("x") == pytest.approx(np.sqrt(np.average((np.array([1, 3, 5]) - 2.5) ** 2, weights=[2, 1, 1])))
    assert {r["c"]: r["content"] for r in d.table("c").collect()} == {"a": 3, "b": 1}
    assert d.reduce(["x"], ranges={"x": (2, 6)}, entries=(0, 2)).df.count() == 1
    assert e.Dataset.of_slices("part", {"u": df, "v": df}).count() == 6


def test_learning_helpers(spark):
    df = spark.createDataFrame([(i / 10, 2 + 3 * i / 10, float(i), int(i > 5)) for i in range(11)], "x double, y double, s double, l int")
    assert e.least_squares(df, "y", [F.lit(1.0), F.col("x")]) == pytest.approx([2, 3])
    assert e.roc(df, "s", "l")[1] == 1.0
    a, b = e.train_test_split(df, 0.5, F.col("s"))
    assert a.count() + b.count() == 11
    assert [len(x) for x in e.batches(df, 4)] == [4, 4, 3] and [len(x) for x in e.batches(df, 4, True)] == [4, 4]
    assert e.parallel_map_reduce(spark, lambda i: i * i, 5, sum) == 30
    v = spark.createDataFrame([([1.0],)], "v array<double>")
    assert tuple(e.padded(v, "v", 3).first()) == (1.0, 0.0, 0.0)


def test_histogram_extras(spark):
    h = Histogram([(40, -4.0, 4.0)]).fill_n(np.random.default_rng(2).normal(0.5, 0.8, 20_000))
    height, mean, width = more.fit_gaussian(h)
    assert mean == pytest.approx(0.5, abs=0.03) and width == pytest.approx(0.8, abs=0.03)
    assert more.random_values(h, 5000).mean() == pytest.approx(0.5, abs=0.05)
    u = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("u"))
    assert u.select(F.avg(more.random_column(h, F.col("u")))).first()[0] == pytest.approx(0.5, abs=0.03)
    square = {"in": [(0, 0), (2, 0), (2, 2), (0, 2)]}
    pts = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (0.5, 1.5)], "x double, y double")
    assert {r["bin"]: r["content"] for r in more.polygon_counts(pts, "x", "y", square).collect()} == {"in": 2, None: 1}
    two = Histogram([(2, 0, 2), (4, 0, 4)]).fill(0.5, 1.5).fill(0.5, 3.5)
    assert more.profile_of(two).values()[0] == 2.5
    out = more.merged([{"h": h, "g": Graph(np.array([1.0]), np.array([2.0])), "x": h}, {"h": h, "g": Graph(np.array([3.0]), np.array([4.0]))}], skip=["x"])
    assert out["h"].entries == 40_000 and len(out["g"].x) == 2 and "x" not in out


def test_spectra():
    x = np.arange(200)
    peaks = 100 * np.exp(-0.5 * ((x - 60) / 3) ** 2) + 80 * np.exp(-0.5 * ((x - 140) / 3) ** 2) + 20
    assert more.search_peaks(peaks, 3) == [60, 140]
    assert np.allclose(more.walsh(more.walsh(np.arange(8.0))), np.arange(8))
    assert more.markov_smooth(peaks).sum() == pytest.approx(peaks.sum())
    source = np.zeros(60)
    source[20] = 100
    blurred = np.convolve(source, [0.25, 0.5, 0.25])[:60]
    assert np.argmax(more.deconvolved(blurred, [0.25, 0.5, 0.25])) == 20
    line = np.linspace(0, 1, 30)
    assert np.allclose(more.lowess(line, 2 * line), 2 * line) and np.allclose(more.kernel_smooth(line, np.ones(30), 0.2), 1)
