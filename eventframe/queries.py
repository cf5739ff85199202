"""The registered queries of the event engine, each with its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventframe.frame import ENTRY, Frame
from eventframe.hist import Efficiency, Profile, sparse_bins
from eventframe.operators import relational
from eventframe.plans import formula
from eventframe.plans.binder import Binder, bound_columns
from eventframe.sources import sinks, tables
from eventframe.streaming import events as streams

_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_path(sf_dir, name))


def _frame(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame(_path(sf_dir, name), spark=spark)


def _plain(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    """Without entry numbers: what needs no order."""
    return Frame(_table(spark, sf_dir, name))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are orders, collections their line items in a total order."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity")))
    grouped = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("it"))
    return grouped.select("l_orderkey", F.col("it.l_extendedprice").alias("price"), F.col("it.l_discount").alias("disc"), F.col("it.l_quantity").alias("qty"), F.col("it.l_linenumber").alias("line"))


_ORDERS_SQL = """
orders_ as (
  select l_orderkey, list(l_extendedprice order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_quantity) price,
    list(l_discount order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_quantity) disc,
    list(l_quantity order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_quantity) qty,
    list(l_linenumber order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_quantity) line
  from lineitem group by l_orderkey)
"""


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


# ---- selections and scalars ------------------------------------------------------------------------------


@query("select cast(count(*) filter (l_quantity > 25) as bigint) big, cast(count(*) filter (l_quantity > 25 and l_discount < 0.05) as bigint) cheap from lineitem")
def filter_count(spark, sf_dir):
    big = _plain(spark, sf_dir, "lineitem").Filter("l_quantity > 25")
    a, b = big.Count(), big.Filter("l_discount < 0.05").Count()
    return _rows(spark, "big bigint, cheap bigint", [(a.GetValue(), b.GetValue())])


@query("""
select * from (values
  ('many', (select count(*) from lineitem where l_quantity > 10), (select count(*) from lineitem)),
  ('dear', (select count(*) from lineitem where l_quantity > 10 and l_extendedprice > 20000), (select count(*) from lineitem where l_quantity > 10)),
  ('returned', (select count(*) from lineitem where l_quantity > 10 and l_returnflag = 'R'), (select count(*) from lineitem where l_quantity > 10))) t(name, passed, total)
""")
def cutflow_report(spark, sf_dir):
    f = _plain(spark, sf_dir, "lineitem")
    many = f.Filter("l_quantity > 10", "many")
    many.Filter("l_extendedprice > 20000", "dear")
    many.Filter('l_returnflag == "R"', "returned")
    return _rows(spark, "name string, passed bigint, total bigint", [(c.name, c.passed, c.all) for c in f.Report().GetValue()])


@query("""
select round(sum(v), 2) total, round(avg(v), 6) mean, round(min(v), 6) low, round(max(v), 6) high, round(stddev_samp(v), 4) spread
from (select l_extendedprice * (1 - l_discount) v from lineitem where l_returnflag <> 'N')
""")
def define_sum_mean_minmax_stddev(spark, sf_dir):
    f = _plain(spark, sf_dir, "lineitem").Define("v", "l_extendedprice * (1 - l_discount)").Filter('l_returnflag != "N"')
    r = [f.Sum("v"), f.Mean("v"), f.Min("v"), f.Max("v"), f.StdDev("v")]
    total, mean, low, high, spread = (x.GetValue() for x in r)
    return _rows(spark, "total double, mean double, low double, high double, spread double", [(round(total, 2), round(mean, 6), round(low, 6), round(high, 6), round(spread, 4))])


@query("""
select count(*) n, round(sum(w), 2) w, round(sum(w * x) / sum(w), 6) mean, min(x) low, max(x) high,
  round(sqrt((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) / sum(w) * count(*) / (count(*) - 1)), 4) rms
from (select l_extendedprice x, l_discount w from lineitem)
""")
def stats_weighted(spark, sf_dir):
    s = _plain(spark, sf_dir, "lineitem").Stats("l_extendedprice", "l_discount").GetValue()
    return _rows(spark, "n bigint, w double, mean double, low double, high double, rms double", [(s.n, round(s.w, 2), round(s.mean, 6), s.min, s.max, round(s.rms, 4))])


@query("select * from (select row_number() over () - 1 entry, l_orderkey, l_partkey from (select * from lineitem)) where entry >= 100 and entry < 1000 and (entry - 100) % 7 = 0")
def range_entries(spark, sf_dir):
    f = _frame(spark, sf_dir, "lineitem").Range(100, 1000, 7)
    return f.dataframe(["l_orderkey", "l_partkey"]).withColumnRenamed(ENTRY, "entry")


@query("""
select * exclude (n) from (
  select *, row_number() over (order by entry) - 1 n from (select row_number() over () - 1 entry, l_orderkey, l_quantity from (select * from lineitem)) where l_quantity > 40)
where n >= 10 and n < 5000 and (n - 10) % 11 = 0
""")
def range_after_filter(spark, sf_dir):
    f = _frame(spark, sf_dir, "lineitem").Filter("l_quantity > 40").Range(10, 5000, 11)
    return f.dataframe(["l_orderkey", "l_quantity"]).withColumnRenamed(ENTRY, "entry")


@query("select o_orderkey, o_totalprice from (select row_number() over () - 1 entry, * from (select * from orders)) where entry in (3, 14, 15, 92, 653)")
def entrylist_select(spark, sf_dir):
    return tables.select_entries(tables.parquet(spark, _path(sf_dir, "orders")), [653, 3, 92, 14, 15]).select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber, cast(l_partkey // 7 as bigint) q, cast(l_partkey % 7 as bigint) r, cast(xor(l_partkey, l_suppkey) as bigint) x, case when l_quantity > 25 and l_discount > 0.05 then 1 else 0 end sel, cast(trunc(l_extendedprice) as int) whole from lineitem")
def cxx_arithmetic(spark, sf_dir):
    f = _plain(spark, sf_dir, "lineitem")
    for name, e in (("q", "l_partkey / 7"), ("r", "l_partkey % 7"), ("x", "l_partkey ^ l_suppkey"), ("sel", "l_quantity > 25 && l_discount > 0.05 ? 1 : 0"), ("whole", "(int)l_extendedprice")):
        f = f.Define(name, e)
    return f.dataframe(["l_orderkey", "l_linenumber", "q", "r", "x", "sel", "whole"])


@query("select l_orderkey, l_linenumber, round(sqrt(l_quantity) + sin(l_discount) * exp(-l_tax), 9) a, round(ln(l_extendedprice) / log10(l_quantity + 1), 9) b, round(pow(l_discount, 2) + atan2(l_tax, l_quantity), 9) c from lineitem")
def math_functions(spark, sf_dir):
    f = _plain(spark, sf_dir, "lineitem").Define("a", "sqrt(l_quantity) + TMath::Sin(l_discount) * exp(-l_tax)").Define("b", "log(l_extendedprice) / TMath::Log10(l_quantity + 1)").Define("c", "pow(l_discount, 2) + std::atan2(l_tax, l_quantity)")
    return f.dataframe(["l_orderkey", "l_linenumber", "a", "b", "c"]).withColumns({c: F.round(c, 9) for c in "abc"})


# ---- collections ---------------------------------------------------------------------------------------------


def _vec(name: str, sql: str, digits: int = 6, **columns: str):
    """A query over orders: one expression per column."""

    def run(spark, sf_dir):
        f = Frame(_orders(spark, sf_dir))
        for c, e in columns.items():
            f = f.Define(c, e)
        out = f.dataframe(["l_orderkey", *columns])
        rounded = {c: F.round(c, digits) for c, t in out.dtypes if t in ("double", "float")}
        rounded |= {c: F.transform(c, lambda x: F.round(x, 6)) for c, t in out.dtypes if t in ("array<double>", "array<float>")}
        return out.withColumns(rounded)

    run.__name__ = name
    query(f"with {_ORDERS_SQL} {sql}")(run)


_vec("vec_sum_mean_var", "select l_orderkey, round(list_sum(price), 5) s, round(list_avg(price), 5) m, round(coalesce(list_var_samp(price), 0) / 1e6, 5) v, cast(len(price) as bigint) n from orders_", 5, s="Sum(price)", m="Mean(price)", v="Var(price) / 1e6", n="price.size()")
_vec("vec_argmax", "select l_orderkey, cast(list_position(price, list_max(price)) - 1 as bigint) i, round(list_max(price) / list_min(price), 6) r from orders_", i="ArgMax(price)", r="Max(price) / Min(price)")
_vec("vec_sort", "select l_orderkey, list_transform(list_sort(price), lambda x: round(x, 6)) up, list_transform(list_reverse(qty), lambda x: round(x, 6)) back from orders_", up="Sort(price)", back="Reverse(qty)")
_vec("vec_mask", "select l_orderkey, list_transform(list_filter(price, lambda x, i: qty[i] > 25), lambda x: round(x, 6)) big, coalesce(list_bool_or(list_transform(qty, lambda x: x > 49)), false) any49 from orders_", big="price[qty > 25]", any49="Any(qty > 49)")
_vec("vec_take", "select l_orderkey, list_transform(price[1:1], lambda x: round(x, 6)) lead, list_transform(price[len(price):len(price)], lambda x: round(x, 6)) tail from orders_", lead="Take(price, 1)", tail="Take(price, -1)")
_vec("vec_where", "select l_orderkey, list_transform(range(1, len(price) + 1), lambda i: round(case when qty[i] > 25 then price[i] else -qty[i] end, 6)) w, round(list_sum(list_transform(range(1, len(price) + 1), lambda i: price[i] * (1 - disc[i]))), 6) net from orders_", w="Where(qty > 25, price, -qty)", net="Dot(price, 1 - disc)")
_vec("vec_combinations", "select l_orderkey, flatten(list_transform(range(0, len(price)), lambda i: list_transform(range(i + 1, len(price)), lambda j: i))) a, flatten(list_transform(range(0, len(price)), lambda i: range(i + 1, len(price)))) b from orders_", a="Combinations(price, 2)[0]", b="Combinations(price, 2)[1]")
_vec(
    "delta_phi_mass",
    """, p as (select l_orderkey, unnest(price) pt, unnest(disc) eta, unnest(qty) phi from orders_),
    m as (select l_orderkey, sum(pt * cos(phi)) x, sum(pt * sin(phi)) y, sum(pt * sinh(eta)) z, sum(sqrt(pt * pt * (cos(phi) * cos(phi) + sin(phi) * sin(phi) + sinh(eta) * sinh(eta)) + 1)) e from p group by 1)
    select m.l_orderkey, round(sqrt(abs(e * e - x * x - y * y - z * z)), 2) mass, round(r, 6) dphi from m join (
      select l_orderkey, case when d < -pi() then d + 2 * pi() when d > pi() then d - 2 * pi() else d end r from (select l_orderkey, fmod(qty[len(qty)] - qty[1], 2 * pi()) d from orders_)) using (l_orderkey)""",
    mass="round(sqrt(abs(pow(InvariantMass(price, disc, qty, 0 * qty + 1), 2))) * 100) / 100", dphi="DeltaPhi(qty.front(), qty.back())",
)


@query("select a.vec_id a, b.vec_id b, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_dot(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("u")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").cast("array<double>").alias("v")), "a")
    dot = Binder(bound_columns(pairs)).expression("Dot(u, v)").column
    return pairs.select("a", "b", F.round(dot, 9).alias("dot"))


# ---- binned results ---------------------------------------------------------------------------------------------------


def _bin_sql(n: int, low: float, high: float, x: str) -> str:
    return f"case when {x} < {low} then 0 when {x} < {high} then 1 + cast(floor({n}::double * ({x} - {low}::double) / ({high}::double - {low}::double)) as int) else {n + 1} end"


def _content(spark, rows, schema="bx int, content double"):
    return _rows(spark, schema, rows)


@query(f"select {_bin_sql(50, 0, 100000, 'l_extendedprice')} bx, count(*)::double content from lineitem group by 1")
def histo1d_flow(spark, sf_dir):
    h = _plain(spark, sf_dir, "lineitem").Histo1D(("h", "", 50, 0.0, 100000.0), "l_extendedprice").GetValue()
    return _content(spark, [(i, float(c)) for i, c in enumerate(h.counts(True)) if c])


@query(f"select {_bin_sql(25, 5, 45, 'l_quantity')} bx, round(sum(l_discount), 6) content, round(sum(l_discount * l_discount), 6) sumw2 from lineitem group by 1")
def histo1d_weighted(spark, sf_dir):
    h = _plain(spark, sf_dir, "lineitem").Histo1D(("h", "", 25, 5.0, 45.0), "l_quantity", "l_discount").GetValue()
    return _content(spark, [(i, round(float(c), 6), round(float(v), 6)) for i, (c, v) in enumerate(zip(h.counts(True), h.variances(True))) if c], "bx int, content double, sumw2 double")


@query(f"select {_bin_sql(10, 0, 50, 'l_quantity')} bx, {_bin_sql(8, 0, 0.1, 'l_discount')} byy, count(*)::double content from lineitem group by 1, 2")
def histo2d(spark, sf_dir):
    h = _plain(spark, sf_dir, "lineitem").Histo2D(("h", "", 10, 0.0, 50.0, 8, 0.0, 0.1), "l_quantity", "l_discount").GetValue().counts(True)
    return _content(spark, [(i, j, float(h[i, j])) for i in range(h.shape[0]) for j in range(h.shape[1]) if h[i, j]], "bx int, byy int, content double")


@query(f"select {_bin_sql(5, 0, 50, 'l_quantity')} bx, {_bin_sql(4, 0, 0.1, 'l_discount')} byy, {_bin_sql(4, 0, 0.08, 'l_tax')} bz, count(*)::double content from lineitem group by 1, 2, 3")
def histo3d(spark, sf_dir):
    h = _plain(spark, sf_dir, "lineitem").Histo3D(("h", "", 5, 0.0, 50.0, 4, 0.0, 0.1, 4, 0.0, 0.08), "l_quantity", "l_discount", "l_tax").GetValue().counts(True)
    return _content(spark, [(i, j, k, float(h[i, j, k])) for i in range(h.shape[0]) for j in range(h.shape[1]) for k in range(h.shape[2]) if h[i, j, k]], "bx int, byy int, bz int, content double")


@query("select case when l_quantity < 1 then 0 when l_quantity < 5 then 1 when l_quantity < 20 then 2 when l_quantity < 45 then 3 else 4 end bx, count(*)::double content from lineitem group by 1")
def histo_edges(spark, sf_dir):
    h = _plain(spark, sf_dir, "lineitem").Histo1D(("h", "", [1.0, 5.0, 20.0, 45.0]), "l_quantity").GetValue()
    return _content(spark, [(i, float(c)) for i, c in enumerate(h.counts(True)) if c])


@query(f"with {_ORDERS_SQL}, x as (select unnest(price) p, len(price) n from orders_) select {_bin_sql(40, 0, 110000, 'p')} bx, count(*)::double content from x where n >= 2 group by 1")
def histo_collections(spark, sf_dir):
    f = Frame(_orders(spark, sf_dir)).Filter("price.size() >= 2", "two items")
    h, _ = f.Histo1D(("h", "", 40, 0.0, 110000.0), "price"), f.Count()
    return _content(spark, [(i, float(c)) for i, c in enumerate(h.GetValue().counts(True)) if c])


@query(f"select {_bin_sql(10, 0, 50, 'l_quantity')} bx, count(*)::double w, round(sum(l_extendedprice), 2) wy, round(avg(l_extendedprice), 4) mean from lineitem group by 1")
def profile1d(spark, sf_dir):
    p = _plain(spark, sf_dir, "lineitem").Profile1D(("p", "", 10, 0.0, 50.0), "l_quantity", "l_extendedprice").GetValue()
    return _content(spark, [(i, float(w), round(float(wy), 2), round(float(m), 4)) for i, (w, wy, m) in enumerate(zip(p.w, p.wy, p.values(True))) if w], "bx int, w double, wy double, mean double")


@query(f"select {_bin_sql(5, 0, 50, 'l_quantity')} bx, {_bin_sql(4, 0, 0.1, 'l_discount')} byy, round(sum(l_tax), 6) w, round(sum(l_tax * l_extendedprice), 2) wy from lineitem group by 1, 2")
def profile2d(spark, sf_dir):
    p = Profile([(5, 0.0, 50.0), (4, 0.0, 0.1)])
    rows = p.fill_frame(_table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", weight="l_tax")
    return rows.select("bx", F.col("by").alias("byy"), F.round("w", 6).alias("w"), F.round("wy", 2).alias("wy"))


@query(f"select {_bin_sql(20, 0, 500, 'value')} bx, count(*) total, count(*) filter (event_type = 'purchase') passed, round(count(*) filter (event_type = 'purchase') / count(*), 9) eff from events where value >= 0 and value < 500 group by 1")
def efficiency_per_bin(spark, sf_dir):
    e = Efficiency.counts(_table(spark, sf_dir, "events"), (20, 0.0, 500.0), "value", F.col("event_type") == "purchase")
    return e.where("bx between 1 and 20").select("bx", "total", "passed", F.round(F.col("passed") / F.col("total"), 9).alias("eff"))


@query(f"select {_bin_sql(5, 0, 50, 'l_quantity')} b0, {_bin_sql(4, 0, 0.1, 'l_discount')} b1, {_bin_sql(4, 0, 0.08, 'l_tax')} b2, count(*) n, round(sum(l_extendedprice), 2) content from lineitem group by 1, 2, 3")
def sparse_3d(spark, sf_dir):
    s = sparse_bins(_table(spark, sf_dir, "lineitem"), [(5, 0.0, 50.0), (4, 0.0, 0.1), (4, 0.0, 0.08)], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return s.select("b0", "b1", "b2", "n", F.round("content", 2).alias("content"))


@query(f"select bx, sum(n) over (order by bx)::double content from (select {_bin_sql(20, 0, 50, 'l_quantity')} bx, count(*) n from lineitem group by 1) where bx between 1 and 20")
def cumulative_bins(spark, sf_dir):
    h = _plain(spark, sf_dir, "lineitem").Histo1D(("h", "", 20, 0.0, 50.0), "l_quantity").GetValue()
    return _content(spark, [(i + 1, float(c)) for i, c in enumerate(h.cumulative().counts()) if h.counts()[: i + 1].any() and h.counts()[i]])


@query(f"""
with b as (select {_bin_sql(50, 0, 100000, 'l_extendedprice')} bx, count(*) n from lineitem group by 1),
g as (select i bx, coalesce(n, 0) n from range(1, 51) t(i) left join b on b.bx = i),
c as (select bx, sum(n) over (order by bx) / (select sum(n) from g) hi, n / (select sum(n) from g) step from g),
q as (select unnest([0.1, 0.25, 0.5, 0.75, 0.9])::double p)
select p, round(x, 6) x from (select p, min_by(2000 * (bx - 1 + (p - (hi - step)) / step), bx) x from c, q where hi > p group by p)
""")
def quantile_bins(spark, sf_dir):
    h = _plain(spark, sf_dir, "lineitem").Histo1D(("h", "", 50, 0.0, 100000.0), "l_extendedprice").GetValue()
    ps = [0.1, 0.25, 0.5, 0.75, 0.9]
    return _rows(spark, "p double, x double", [(p, round(x, 6)) for p, x in zip(ps, h.quantiles(ps))])


@query(f"""
with b as (select {_bin_sql(50, 0, 50, 'l_quantity')} bx, l_returnflag f, count(*)::double n from lineitem group by 1, 2)
select bx, sum(n) filter (f = 'R') - 0.5 * coalesce(sum(n) filter (f = 'A'), 0) content from b where bx between 1 and 50 group by 1
""")
def histogram_algebra(spark, sf_dir):
    f = _plain(spark, sf_dir, "lineitem")
    model = ("h", "", 50, 0.0, 50.0)
    r, a = (f.Filter(f'l_returnflag == "{x}"').Histo1D(model, "l_quantity") for x in "RA")
    h = r.GetValue().copy().add(a.GetValue(), -0.5)
    return _content(spark, [(i + 1, float(c)) for i, c in enumerate(h.counts()) if r.GetValue().counts()[i] or a.GetValue().counts()[i]])


# ---- the formula language ----------------------------------------------------------------------------------------------


@query(f"select {_bin_sql(20, 0, 50, 'l_quantity')} bx, round(sum(l_discount), 6) content from lineitem where l_discount * (l_tax > 0.02)::int <> 0 group by 1")
def draw_selection_weight(spark, sf_dir):
    _, bins = formula.draw_bins(_table(spark, sf_dir, "lineitem"), "l_quantity>>h(20,0,50)", "l_discount*(l_tax>0.02)")
    return bins.select("bx", F.round("w", 6).alias("content"))


@query(f"with {_ORDERS_SQL} select l_orderkey, round(coalesce(list_sum(list_filter(price, lambda x, i: qty[i] > 25)), 0), 6) s, round(coalesce(list_max(list_filter(price, lambda x, i: qty[i] < 10)), 0), 6) m, len(price)::double n, coalesce(round(price[2], 6), -1) other from orders_")
def ttf_sum_if(spark, sf_dir):
    texts = {"s": "Sum$(price*(qty>25))", "m": "MaxIf$(price,qty<10)", "n": "Length$(price)", "other": "Alt$(price[1],-1)"}
    orders = _orders(spark, sf_dir)
    f = formula.compiler(orders)
    return orders.select("l_orderkey", *[F.round(f.term(t).at(F.lit(0)), 6).alias(k) for k, t in texts.items()])


@query(f"with {_ORDERS_SQL}, x as (select l_orderkey, unnest(range(0, len(price))) i, price, qty from orders_) select i::int i, count(*) n, round(sum(price[i + 1] / qty[i + 1]), 4) s from x where qty[i + 1] > 30 group by 1")
def ttf_loop(spark, sf_dir):
    rows = formula.evaluate_together(_orders(spark, sf_dir), {"r": "price/qty"}, "qty>30")
    return rows.where("__cut <> 0").groupBy(F.col("__i").alias("i")).agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("s"))


# ---- several tables --------------------------------------------------------------------------------------------------------------


@query("""
with o as (select row_number() over () - 1 e, * from (select * from orders)), c as (select row_number() over () - 1 e, * from (select * from customer))
select o_orderkey, c_name from o left join c using (e)
""")
def friend_positional(spark, sf_dir):
    main, friend = (tables.parquet(spark, _path(sf_dir, t)) for t in ("orders", "customer"))
    return tables.positional_friend(main, friend, "c").select("o_orderkey", F.col("c_c_name").alias("c_name"))


@query("""
with l as (select row_number() over () - 1 e, * from (select * from lineitem)), f as (select l_orderkey, arg_min(l_partkey, e) part, arg_min(l_quantity, e) qty from l group by 1)
select o_orderkey, coalesce(part, -1) part, coalesce(qty, -1) qty from orders left join f on o_orderkey = l_orderkey
""")
def friend_indexed(spark, sf_dir):
    main = tables.parquet(spark, _path(sf_dir, "orders")).withColumn("l_orderkey", F.col("o_orderkey"))
    joined = tables.indexed_friend(main, tables.parquet(spark, _path(sf_dir, "lineitem")), "f", "l_orderkey")
    return joined.select("o_orderkey", F.coalesce("f_l_partkey", F.lit(-1)).alias("part"), F.coalesce("f_l_quantity", F.lit(-1.0)).alias("qty"))


@query("select l_returnflag, count(*) n, round(sum(l_quantity), 2) q from (select * from lineitem union all select * from lineitem where l_returnflag = 'R') group by 1")
def chain_union(spark, sf_dir):
    a = _table(spark, sf_dir, "lineitem")
    both = Frame(tables.chain(spark, [a, a.where("l_returnflag = 'R'")]))
    return both.dataframe(["l_returnflag", "l_quantity"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("select count(*) n, count(*) filter (l_returnflag = 'R') missing, round(sum(case when l_returnflag = 'R' then -1 else l_tax end), 4) tax from lineitem where l_returnflag in ('R', 'A')")
def patched_union_default(spark, sf_dir):
    a = _table(spark, sf_dir, "lineitem")
    parts = Frame(tables.patched(spark, [a.where("l_returnflag = 'A'"), a.where("l_returnflag = 'R'").drop("l_tax")]))
    n, missing, tax = parts.Count(), parts.FilterMissing("l_tax").Count(), parts.DefaultValueFor("l_tax", -1.0).Sum("l_tax")
    return _rows(spark, "n bigint, missing bigint, tax double", [(n.GetValue(), missing.GetValue(), round(tax.GetValue(), 4))])


@query("select o_orderpriority, count(*) content from orders group by 1")
def category_table(spark, sf_dir):
    return relational.category_table(_table(spark, sf_dir, "orders"), "o_orderpriority")


@query("select n_name, count(*) orders_n, round(sum(o_totalprice), 2) total from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1")
def join_inner(spark, sf_dir):
    c, n, o = (_table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders_n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 350000)")
def semi_anti(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").where("o_totalprice > 350000")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
select e.event_id, max(p.ts) last_ts from (select * from events where event_type = 'click') e
left join (select * from events where event_type = 'purchase') p on p.user_id = e.user_id and p.ts <= e.ts group by 1
""")
def asof_join(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    clicks, purchases = e.where("event_type = 'click'"), e.where("event_type = 'purchase'")
    return relational.as_of_join(clicks, purchases, ["user_id"], "ts", ["ts"]).select("event_id", "last_ts")


@query("select p_size band, count(*) n from lineitem join (select distinct p_size, p_size * 1000.0::double lo, p_size * 1000.0::double + 1500 hi from part) on l_extendedprice >= lo and l_extendedprice < hi group by 1")
def range_join(spark, sf_dir):
    ranges = _table(spark, sf_dir, "part").select(F.col("p_size").alias("band"), (F.col("p_size") * 1000.0).alias("lo"), (F.col("p_size") * 1000.0 + 1500).alias("hi")).distinct()
    return relational.range_join(_table(spark, sf_dir, "lineitem").select("l_extendedprice"), ranges, "l_extendedprice", "lo", "hi", 1000.0).groupBy("band").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) q, cast(grouping(l_returnflag, l_linestatus) as bigint) g from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.grouping_id().alias("g"))


@query("select l_suppkey, l_orderkey, l_extendedprice, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) rank from lineitem) where rank <= 3")
def window_topk(spark, sf_dir):
    top = relational.top_per_group(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3)
    return top.select("l_suppkey", "l_orderkey", "l_extendedprice", "rank")


@query("select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) running from events")
def window_running(spark, sf_dir):
    return relational.running(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("running", 4).alias("running"))


@query("select l_suppkey from lineitem where l_returnflag = 'R' intersect select l_suppkey from lineitem where l_returnflag = 'A' except select s_suppkey from supplier where s_acctbal < 0")
def intersect_except(spark, sf_dir):
    a = _table(spark, sf_dir, "lineitem")
    keys = [a.where(f"l_returnflag = '{f}'").select("l_suppkey") for f in "RA"]
    return keys[0].intersect(keys[1]).exceptAll(_table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey")).distinct())


@query("select user_id, session, count(*) n from (select user_id, sum(fresh) over (partition by user_id order by ts, event_id) session from (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 1800 second then 0 else 1 end fresh from events)) group by 1, 2")
def sessions(spark, sf_dir):
    return relational.sessions(_table(spark, sf_dir, "events"), "user_id", "ts", 1800).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("select epoch(time_bucket(interval '1 hour', ts))::bigint start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def tumbling(spark, sf_dir):
    w = streams.tumbling(streams.timed(_table(spark, sf_dir, "events")), "ts", "1 hour", ["event_type"], value="value")
    return w.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"select {_bin_sql(20, 0, 500, 'value')} bx, count(*) n from events group by 1")
def stream_histogram(spark, sf_dir):
    schema = _table(spark, sf_dir, "events").schema
    path = _path(sf_dir, "events")
    folder = path if os.path.isdir(path) else f"{sf_dir}/events*.parquet"
    stream = streams.growing_histogram(streams.read_events(spark, folder, schema), (20, 0.0, 500.0), F.col("value"))
    return streams.drained(stream, sinks.new_folder(spark)).select("bx", "n")


@query("""
with q as (select l_orderkey, list(l_extendedprice) p from lineitem group by 1),
t as (select * from q where len(p) >= 2), h as (select * from t where list_sum(list_filter(p, lambda x: x > 30000)) > 60000)
select * from (values ('all', (select count(*) from q)), ('two items', (select count(*) from t)), ('expensive', (select count(*) from h))) v(name, n)
""")
def flagship(spark, sf_dir):
    two, hot, f = _flagship(spark, sf_dir)
    counts = [f.Count(), two.Count(), hot.Count()]
    hot.Define("lead", "Max(price)").Histo1D(("h", "", 50, 0.0, 110000.0), "lead")
    return _rows(spark, "name string, n bigint", list(zip(("all", "two items", "expensive"), (c.GetValue() for c in counts))))


def _flagship(spark, sf_dir):
    f = Frame(_orders(spark, sf_dir))
    two = f.Filter("price.size() >= 2", "two items")
    return two, two.Filter("Sum(price[price > 30000]) > 60000", "expensive"), f


@query(f"""
with q as (select l_orderkey, list(l_extendedprice) p from lineitem group by 1)
select {_bin_sql(50, 0, 110000, 'list_max(p)')} bx, count(*)::double content from q where len(p) >= 2 and list_sum(list_filter(p, lambda x: x > 30000)) > 60000 group by 1
""")
def flagship_spectrum(spark, sf_dir):
    _, hot, _ = _flagship(spark, sf_dir)
    h = hot.Define("lead", "Max(price)").Histo1D(("h", "", 50, 0.0, 110000.0), "lead").GetValue()
    return _content(spark, [(i, float(c)) for i, c in enumerate(h.counts(True)) if c])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from eventframe import query_functions, query_operations  # noqa: F401  they register their own

    return {k: f for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in _REGISTRY.items() if s}
