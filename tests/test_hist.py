import numpy as np
import pytest

from eventframe.functions import special
from eventframe.hist import Axis, Efficiency, Graph, Histogram, Profile, chi2, good_limits, kolmogorov, smooth


@pytest.fixture
def filled():
    rng = np.random.default_rng(3)
    h = Histogram([(20, -4.0, 4.0)])
    return h.fill_n(rng.normal(size=2000), weights=rng.uniform(0.5, 2, 2000))


def test_bins_and_limits():
    a = Axis.of((10, 0.0, 10.0))
    assert [a.find(x) for x in (-1, 0, 9.99, 10, float("nan"))] == [0, 1, 10, 11, 11]
    assert Axis.of([0, 1, 5, 7]).find(5) == 3
    assert good_limits(100, -1.467, 2.344) == (100, pytest.approx(-1.8), pytest.approx(2.7))


def test_frame_and_driver_fill_alike(spark):
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=500), rng.normal(size=500), rng.uniform(size=500)
    df = spark.createDataFrame(list(map(tuple, np.stack([x, y, w], 1).tolist())), "x double, y double, w double")
    for h, cols in ((Histogram([(12, -2.0, 2.0)]), (x,)), (Histogram([(5, -2.0, 2.0), [-1, 0, 0.5, 3]]), (x, y))):
        a = h.copy().fill_n(*cols, weights=w)
        b = h.copy().add_bins(h.fill_frame(df, *"xy"[: len(cols)], weight="w").collect())
        assert np.allclose(a.content, b.content) and np.allclose(a.sumw2, b.sumw2) and a.entries == b.entries
        assert all(a.moments[k] == pytest.approx(b.moments[k]) for k in a.moments)


def test_algebra(filled):
    two = filled.copy().add(filled)
    assert np.allclose(two.content, 2 * filled.content) and two.entries == 2 * filled.entries
    assert np.allclose(filled.copy().scale(3).errors(), 3 * filled.errors())
    assert np.allclose(two.copy().divide(filled).counts()[5:15], 2)
    assert two.copy().add(filled, -2).counts().sum() == pytest.approx(0)
    one = filled.copy().multiply(filled)
    assert np.allclose(one.content, filled.content**2)


def test_reshaping(filled):
    assert filled.rebin(4).counts().sum() == pytest.approx(filled.counts().sum())
    assert filled.rebin([-4, 0, 4]).axes[0].n == 2
    left_over = filled.rebin(7)
    assert left_over.axes[0].n == 2 and left_over.content.sum() == pytest.approx(filled.content.sum())
    assert filled.cumulative().counts()[-1] == pytest.approx(filled.counts().sum())
    assert filled.quantiles([0.5])[0] == pytest.approx(0, abs=0.15)
    h = Histogram([(4, 0, 4), (3, 0, 3)]).fill(1.5, 2.5).fill(0.5, 0.5, weight=2)
    assert list(h.project(1).counts()) == [2, 0, 1] and list(h[0:2, ::sum].counts()) == [2, 1]
    assert h.project(0).mean() == pytest.approx(h.mean(0))


def test_statistics(filled):
    assert filled.mean() == pytest.approx(0, abs=0.1) and filled.std() == pytest.approx(1, abs=0.1)
    assert filled.kurtosis() == pytest.approx(0, abs=0.5) and 0 < filled.mean_error() < 0.1


def test_comparisons():
    # 200 against 500 weighted by half: a known shape
    a, b = Histogram([(3, 0, 3)]), Histogram([(3, 0, 3)])
    for x, n, m in ((0.5, 10, 12), (1.5, 20, 18), (2.5, 5, 7)):
        a.fill_n([x] * n)
        b.fill_n([x] * m)
    assert chi2(a, a).chi2 == 0 and kolmogorov(a, a) == 1
    got = chi2(a, b)
    assert got.ndf == 2 and got.chi2 == pytest.approx(sum((37 * p - 35 * q) ** 2 / (p + q) for p, q in ((10, 12), (20, 18), (5, 7))) / (35 * 37))
    assert kolmogorov(a, b, "M") == pytest.approx(abs(10 / 35 - 12 / 37), abs=0.03)


def test_special_functions():
    assert special.chi2_probability(21.09, 19) == pytest.approx(0.33, abs=0.005)
    assert special.incomplete_beta(0.3, 2, 5) == pytest.approx(0.579825)
    assert special.student_quantile(0.975, 10) == pytest.approx(2.2281388, rel=1e-6)
    assert special.chi2_quantile(0.95, 3) == pytest.approx(7.8147279, rel=1e-6)
    assert special.f_cdf(3.0, 4, 7) == pytest.approx(1 - 0.0973, abs=1e-3)
    assert special.cyl_bessel_j(0, 2.0) == pytest.approx(0.2238907791)
    assert special.cyl_bessel_k(1, 2.0) == pytest.approx(0.1398658818, rel=1e-6)
    assert special.kolmogorov_probability(1.0) == pytest.approx(0.26999967, rel=1e-6)


def test_efficiency():
    e = Efficiency([8, 0, 5], [10, 4, 5])
    low, high = e.intervals()[0]
    assert low < 0.8 < high and e.intervals()[1][0] == 0 and e.intervals()[2][1] == 1
    assert special.beta_cdf(low, 8, 3) == pytest.approx((1 - e.level) / 2)
    for m in ("normal", "wilson", "agresti-coull", "jeffreys", "uniform"):
        a, b = Efficiency([8], [10], method=m).intervals()[0]
        assert 0 < a < 0.8 < b < 1


def test_profile_errors():
    p = Profile([(1, 0.0, 1.0)])
    for y in (1, 2, 3, 4):
        p.fill(0.5, y)
    spread = np.std([1, 2, 3, 4])
    assert p.values()[0] == 2.5 and p.errors()[0] == pytest.approx(spread / 2) and p.errors(option="s")[0] == pytest.approx(spread)
    assert p.errors(option="g")[0] == 0.5


def test_smooth_and_graph():
    flat = np.ones(20)
    assert np.allclose(smooth(flat), 1)
    g = Graph(np.array([0.0, 2.0, 1.0]), np.array([0.0, 4.0, 1.0]))
    assert g.eval(0.5) == 0.5 and g.eval(3) == 7
