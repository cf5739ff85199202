import math

import pytest

from eventframe.plans.binder import Binder, bound_columns
from eventframe.types import ExpressionError, UnsupportedFeature

CASES = {
    "i + 1": 2, "7 / 2": 3, "-7 / 2": -3, "-7 % 3": -1, "7.0 / 0": math.inf, "-7.0 / 0": -math.inf, "2147483647 + i": -2147483648,
    "9223372036854775807 + l": -(2**63) + 6, "l * 9223372036854775807": ((7 * (2**63 - 1) + 2**63) % 2**64) - 2**63, "5 ^ 3": 6, "~i": -2, "6 & 3": 2, "6 | 1": 7,
    "1 << 31": -2147483648, "1 << 33": 0, "-8 >> 1": -4, "(int)3.9": 3, "(int)-3.9": -3, "(unsigned)-1": 2**32 - 1, "static_cast<bool>(x)": True,
    "i ? x : 3": 2.5, "i && x > 2": True, "0 && 1 / 0": False, "1 || 1 / 0": True, 's == "ab"': True, "s.size()": 2, "0x1F": 31, "017": 15,
    "v[0]": 1.0, "v[v > 1]": [2.0, 5.0], "v * w": [3.0, 2.0, 10.0], "v.size()": 3, "v.back()": 5.0, "Sum(v)": 8.0, "Mean(w)": 2.0, "Var(v)": 13 / 3,
    "Sum(v > 1)": 2, "Max(v)": 5.0, "ArgMax(v)": 2, "ArgMin(w)": 1, "Sort(w)": [1, 2, 3], "Argsort(w)": [1, 2, 0], "Reverse(w)": [2, 1, 3],
    "Take(v, 2)": [1.0, 2.0], "Take(v, -2)": [2.0, 5.0], "Take(v, 5, 0.0)": [1.0, 2.0, 5.0, 0.0, 0.0], "Take(v, w - 1)": [5.0, 1.0, 2.0], "Drop(v, w)": [1.0],
    "Combinations(v, 2)[0]": [0, 0, 1], "Combinations(v, 2)[1]": [1, 2, 2], "Combinations(v, w)[1]": [0, 1, 2] * 3, "Nonzero(v > 1)": [1, 2],
    "Where(v > 1, v, -v)": [-1.0, 2.0, 5.0], "Any(v > 4)": True, "All(v > 4)": False, "Dot(v, w)": 15.0, "Intersect(w, w)": [3, 1, 2], "Concatenate(w, w)": [3, 1, 2] * 2,
    "Range(3)": [0, 1, 2], "Range(5, 2, -1)": [5, 4, 3], "Range(2, 2)": [], "Enumerate(v)": [0, 1, 2], "!v": [0, 0, 0], "log(0 * x)": -math.inf, "round(-2.5)": -3.0,
    "TMath::Pi()": math.pi, "fmod(7, -3)": 1.0, "DeltaPhi(3.0, -3.0)": 2 * math.pi - 6, "abs(-i)": 1, "erf(0.5)": math.erf(0.5), "min(x, 1)": 1.0,
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, 2.5, [1.0, 2.0, 5.0], [3, 1, 2], "ab", 7)], "i int, x double, v array<double>, w array<int>, s string, l long")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_values(spark, table, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        b = Binder(bound_columns(table))
        got = table.select(*[b.expression(e).column.alias(f"c{k}") for k, e in enumerate(CASES)]).first()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    for e, g, want in zip(CASES, got, CASES.values()):
        assert g == pytest.approx(want), e


def test_nan_compares_as_ieee(table):
    b = Binder(bound_columns(table))
    texts = ["0.0 / 0 == 0.0 / 0", "0.0 / 0 != 1", "0.0 / 0 > 1", "1 < 0.0 / 0", "0.0 / 0 >= 0.0 / 0"]
    assert list(table.select(*[b.expression(t).column.alias(f"c{i}") for i, t in enumerate(texts)]).first()) == [False, True, False, False, False]


@pytest.mark.parametrize("text", ["nope + 1", "v ? 1 : 2", 'x + "a"', "1.5 % 2", "i[0]", "Foo(x)", "x +", "Combinations(v, i)"])
def test_refused_when_bound(table, text):
    with pytest.raises(ExpressionError):
        Binder(bound_columns(table)).expression(text)


def test_lambdas_are_refused(table):
    with pytest.raises(UnsupportedFeature):
        Binder(bound_columns(table)).expression("[](int x) { return x; }(i)")


@pytest.mark.parametrize("text", ["1 / (i - 1)", "v[3]", "v * Take(w, 2)", "Take(v, 7)", "Max(Take(v, 0))", "(int)(0.0 / 0)"])
def test_bad_data_raise(table, text):
    with pytest.raises(Exception):
        table.select(Binder(bound_columns(table)).expression(text).column).collect()
