import math

import numpy as np
import pytest

from eventframe import Frame, run_graphs
from eventframe.types import ExpressionError


@pytest.fixture
def xyn(spark):
    return Frame(100, spark=spark).Define("x", "double(rdfentry_)").Define("y", "-x").Define("n", "int(rdfentry_)")


def test_branches_share_one_run(xyn):
    high, low = xyn.Filter("x >= 50", "high"), xyn.Filter("n % 2 == 0", "even").Filter("x < 20", "low")
    results = [high.Count(), low.Count(), high.Sum("x"), low.Mean("y"), xyn.StdDev("x"), low.Max("n"), xyn.Min("y")]
    h = high.Histo1D(("h", "", 10, 0.0, 100.0), "x")
    assert [r.GetValue() for r in results] == pytest.approx([50, 10, 3725.0, -9.0, np.std(np.arange(100), ddof=1), 18, -99.0])
    assert list(h.counts()) == [0] * 5 + [10] * 5 and xyn.GetNRuns() == 1


def test_report(xyn):
    a = xyn.Filter("x >= 50", "high")
    b = a.Filter("n % 2 == 0", "even")
    cuts = b.Report().GetValue()
    assert [(c.name, c.passed, c.all) for c in cuts] == [("high", 50, 100), ("even", 25, 50)]
    assert cuts.text().splitlines()[1] == "even      : pass=25         all=50         -- eff=50.00 % cumulative eff=25.00 %"


def test_range(xyn):
    assert xyn.Range(10, 20, 3).Take("n").GetValue() == [10, 13, 16, 19]
    assert xyn.Filter("n >= 50").Range(2, 9, 2).Take("n").GetValue() == [52, 54, 56, 58]
    assert xyn.Range(5).Filter("n > 2").Take("n").GetValue() == [3, 4]


def test_empty_results(xyn):
    none = xyn.Filter("x > 1e9")
    values = [none.Sum("n"), none.Mean("x"), none.Min("x"), none.Max("n"), none.StdDev("x"), none.Count()]
    assert [v.GetValue() for v in values] == [0, 0.0, 1.7976931348623157e308, -(2**31), 0.0, 0]


def test_collections(xyn):
    v = xyn.Define("v", "Range(n % 4)").Define("w", "v * x")
    assert v.Sum("w").GetValue() == sum(i * n for n in range(100) for i in range(n % 4))
    assert list(v.Histo1D(("h", 4, 0.0, 4.0), "v").counts()) == [75, 50, 25, 0]
    assert v.Histo2D(("h", 4, 0.0, 4.0, 2, 0.0, 300.0), "v", "w").GetValue().entries == 150


def test_redefine_and_alias(xyn):
    changed = xyn.Redefine("x", "x * 2").Alias("z", "x")
    assert changed.Sum("z").GetValue() == 9900 and xyn.Sum("x").GetValue() == 4950


def test_names_are_checked(xyn):
    for call in (lambda: xyn.Define("x", "1"), lambda: xyn.Define("rdfx", "1"), lambda: xyn.Define("int", "1"), lambda: xyn.Redefine("q", "1"), lambda: xyn.Filter("Range(3)")):
        with pytest.raises(ExpressionError):
            call()


def test_python_callables(xyn):
    assert xyn.Define("z", lambda x, n: x + n).Max("z").GetValue() == 198
    assert xyn.Filter(lambda x: x > 89.0, ["x"]).Count().GetValue() == 10


def test_profiles_and_graphs(xyn):
    p = xyn.Profile1D(("p", "", 5, 0.0, 100.0), "x", "y").GetValue()
    assert list(p.values()) == pytest.approx([-9.5, -29.5, -49.5, -69.5, -89.5])
    ranged = xyn.Profile1D(("p", "", 5, 0.0, 100.0, -50.0, 0.0), "x", "y").GetValue()
    assert ranged.entries == 51
    g = xyn.Range(3).Graph("x", "y").GetValue()
    assert list(g.y) == [0, -1, -2] and g.title == "y vs x"


def test_automatic_axis_holds_all(xyn):
    h = xyn.Histo1D("x").GetValue()
    assert h.axes[0].n == 128 and h.counts().sum() == 100


def test_snapshot_and_cache(xyn, tmp_path):
    out = xyn.Filter("n < 10").Snapshot(f"file://{tmp_path}/s", ["x", "n"])
    assert out.GetColumnNames() == ["n", "x"] and out.Sum("n").GetValue() == 45
    assert xyn.Cache(["x"]).Sum("x").GetValue() == 4950


def test_missing_values(spark):
    f = Frame(spark.createDataFrame([(1.0,), (None,)], "a double"))
    assert f.FilterMissing("a").Count().GetValue() == 1 and f.FilterAvailable("a").Count().GetValue() == 1
    assert f.DefaultValueFor("a", 5.0).Sum("a").GetValue() == 6.0


def test_stats_and_reduce(xyn):
    s = xyn.Stats("x", "n").GetValue()
    w, x = np.arange(100.0), np.arange(100.0)
    assert (s.n, s.w, s.mean) == (100, w.sum(), pytest.approx((w * x).sum() / w.sum()))
    assert xyn.Reduce(max, "x").GetValue() == 99 and xyn.Reduce(lambda a, b: a + b, "x", 0.0).GetValue() == 4950


def test_several_frames(spark):
    a, b = Frame(10, spark=spark).Count(), Frame(20, spark=spark).Count()
    assert run_graphs(a, b) == 2 and (a.GetValue(), b.GetValue()) == (10, 20)


def test_numpy_and_display(xyn):
    assert list(xyn.Range(3).AsNumpy(["y"])["y"]) == [0, -1, -2]
    assert "| 1   | 1.0 |" in xyn.Display(["x"], rows=2).GetValue()


def test_nan_goes_to_overflow(spark):
    f = Frame({"a": [math.nan, 0.0, 1.0, 2.0]}, spark=spark)
    assert list(f.Histo1D(("h", "", 2, 0.0, 2.0), "a").GetValue().counts(True)) == [0, 1, 1, 2]
