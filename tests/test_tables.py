import pytest
from pyspark.sql import functions as F

from eventframe import Frame
from eventframe.operators import relational
from eventframe.plans import formula
from eventframe.sources import tables, text

ROWS = [(0, 1.0, [1.0, 2.0, 3.0], [1, 2]), (1, 2.0, [5.0], [1, 2, 3]), (2, 3.0, [], [])]


@pytest.fixture(scope="module")
def jagged(spark):
    return spark.createDataFrame(ROWS, "__entry long, x double, v array<double>, w array<int>")


def test_formula_loops_to_the_shortest(jagged):
    got = formula.evaluate_together(jagged, {"a": "v*x", "b": "w^2"}, "v>1").orderBy("__entry", "__i").collect()
    assert [(r["a"], r["b"], r["__cut"]) for r in got] == [(1.0, 1.0, 0.0), (2.0, 4.0, 1.0), (10.0, 1.0, 1.0)]


def test_formula_arithmetic_and_folds(jagged):
    f = formula.compiler(jagged)
    texts = {"3/2": 1.5, "2^3": 8.0, "7%4": 3.0, "Sum$(v)": 6.0, "Length$(v)": 3.0, "Min$(v)": 1.0, "MaxIf$(v,v<3)": 2.0, "Alt$(v[7],-1)": -1.0, "v[1]": 2.0, "Entry$": 0.0, "x>0&&x<2": 1.0, "-2^2": -4.0}
    got = jagged.where("__entry = 0").select(*[f.term(t).at(F.lit(0)).alias(f"c{k}") for k, t in enumerate(texts)]).first()
    assert list(got) == list(texts.values())
    assert [r[1] for r in formula.arrays(jagged, {"s": "v+Alt$(w,0)"}, "x<3").orderBy("__entry").collect()] == [[2.0, 4.0, 3.0], [6.0]]


def test_draw_and_scan(jagged):
    h = formula.draw(jagged, "v>>h(4,0,8)", "x<3")
    assert list(h.counts()) == [1, 2, 1, 0] and h.title == "v {x<3}"
    assert formula.scan(jagged, "x:v").count("\n") == 7


def test_friends_and_chains(spark):
    a = spark.createDataFrame([(i, i % 3, float(i)) for i in range(6)], "__entry long, k int, a double")
    b = spark.createDataFrame([(i, i % 2, float(10 * i)) for i in range(4)], "__entry long, k int, b double")
    assert [r["f_b"] for r in tables.positional_friend(a, b, "f").orderBy("__entry").collect()] == [0, 10, 20, 30, None, None]
    assert [r["f_b"] for r in tables.indexed_friend(a, b, "f", "k").orderBy("__entry").collect()] == [0, 10, None, 0, 10, None]
    assert [r["f_b"] for r in tables.keyed_join(a, b, "f", ["k"]).orderBy("__entry").collect()] == [20, 30, 30, 20, 30, 30]
    with pytest.raises(ValueError):
        tables.positional_friend(a, b, "f", strict=True)
    with pytest.raises(ValueError):
        tables.chain(spark, [a, b])
    both = tables.patched(spark, [a, b])
    assert both.count() == 10 and sorted(r[0] for r in both.select("__entry").collect()) == list(range(10))
    assert [r["a"] for r in tables.select_entries(a, [4, 1]).collect()] == [4, 1]
    with pytest.raises(IndexError):
        tables.select_entries(a, [9])


def test_entries_count_over_files(spark, tmp_path):
    for name, rows in (("a", range(5)), ("b", range(5, 12))):
        spark.createDataFrame([(i,) for i in rows], "v long").coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    f = Frame([f"file://{tmp_path}/a", f"file://{tmp_path}/b"], spark=spark)
    assert f.Filter("rdfentry_ != v").Count().GetValue() == 0
    tagged = f.DefinePerSample("s", {"/a/": 1.0, "/b/": 2.0})
    assert tagged.Sum("s").GetValue() == 5 + 14


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('i,x,ok,name\n1,1.5,true,"a,""b"""\n2,nan,false,c\n,3,nan,\n')
    df = text.csv(spark, f"file://{tmp_path}/t.csv").orderBy("__entry")
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "double", "boolean", "string"]
    rows = [tuple(r)[1:] for r in df.collect()]
    assert rows[0] == (1, 1.5, True, 'a,"b"') and rows[1][0] == 2 and rows[1][1] != rows[1][1] and rows[2][0] == 0 and rows[2][2:] == (False, "nan")
    assert text.split_line('a,"b,c",,') == ["a", "b,c", "nan", "nan"]


def test_relational(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 5, "y"), (2, 3, "z")], "k int, t int, v string")
    b = spark.createDataFrame([(1, 0, 10), (1, 4, 20), (1, 5, 30)], "k int, t int, w int")
    got = {r["v"]: r["last_w"] for r in relational.as_of_join(a, b, ["k"], "t", ["w"]).collect()}
    assert got == {"x": 10, "y": 30, "z": None}
    ranges = spark.createDataFrame([(0.0, 2.5, "lo"), (2.5, 9.0, "hi")], "a double, b double, name string")
    pairs = {(r["t"], r["name"]) for r in relational.range_join(a, ranges, "t", "a", "b", 2.0).collect()}
    assert pairs == {(1, "lo"), (5, "hi"), (3, "hi")}
    assert relational.difference(a, a, ["k", "t"]).count() == 0
