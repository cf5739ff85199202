"""Registered queries of collections, expressions, results, datasets, sources and sinks, each with its SQL."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from eventframe.frame import ENTRY, Frame
from eventframe.functions import arraystats
from eventframe.hist import Histogram
from eventframe.operators import entries, readers, relational
from eventframe.plans import formula
from eventframe.queries import _ORDERS_SQL, _bin_sql, _content, _frame, _orders, _path, _plain, _rows, _table, _vec, query
from eventframe.sources import sinks, tables, text


# ---- collections ---------------------------------------------------------------------------------------------

_vec(
    "vec_statistics",
    """select l_orderkey, round(list_product(list_transform(disc, lambda x: x + 1)), 6) product, round(coalesce(list_stddev_samp(qty), 0), 6) spread, list_bool_and(list_transform(qty, lambda x: x > 5)) every,
      cast(list_position(qty, list_min(qty)) - 1 as bigint) low, round(list_min(price), 6) least, cast(len(list_filter(qty, lambda x: x > 25)) as int) many from orders_""",
    6, product="Product(disc + 1)", spread="StdDev(qty)", every="All(qty > 5)", low="ArgMin(qty)", least="Min(price)", many="Sum(qty > 25)",
)
_vec(
    "vec_selection",
    """select l_orderkey, list_filter(range(0, len(qty)), lambda i: qty[i + 1] > 25) big, list_transform(list_concat(qty, disc), lambda x: round(x, 6)) both_, list_filter(qty, lambda x, i: i <> 1) rest,
      list_filter(qty, lambda x: list_contains([1.0, 2.0, 3.0, 4.0, 5.0], x)) few, range(0, len(qty)) place, range(2, 2 + len(qty)) shifted, list_transform(qty[len(qty):len(qty)], lambda x: round(x, 6)) last_, qty[1] first_, qty[len(qty)] back_ from orders_""",
    big="Nonzero(qty > 25)", both_="Concatenate(qty, disc)", rest="Drop(qty, Range(1))", few="Intersect(qty, Range(1, 6) * 1.0)", place="Enumerate(qty)", shifted="Range(2, 2 + (long)qty.size())", last_="Take(qty, -1)", first_="qty[0]", back_="qty.at(qty.size() - 1)",
)
_vec(
    "vec_order",
    f"""select l_orderkey, list_transform(list_sort(list_transform(range(0, len(qty)), lambda i: {{'v': qty[i + 1], 'i': i}})), lambda s: s.i) up,
      list_transform(list_sort(list_transform(range(0, len(qty)), lambda i: {{'v': -price[i + 1], 'i': i}}))[1:2], lambda s: round(price[s.i + 1], 6)) top2, list_transform(qty, lambda x: round(x * 2, 6)) twice_ from orders_""",
    up="Argsort(qty)", top2="Reverse(Sort(price))[Enumerate(price) < 2]", twice_="qty * 2",
)
_vec(
    "vec_pairs",
    """select l_orderkey, flatten(list_transform(range(0, len(qty)), lambda i: list_transform(range(0, len(disc)), lambda j: i))) a, flatten(list_transform(range(0, len(qty)), lambda i: range(0, len(disc)))) b from orders_""",
    a="Combinations(qty, disc)[0]", b="Combinations(qty, disc)[1]",
)
_vec(
    "vec_distances",
    """, p as (select l_orderkey, disc[1] e1, disc[len(disc)] e2, qty[1] f1, qty[len(qty)] f2, qty[1] / 10 p1, qty[len(qty)] / 10 p2 from orders_),
    q as (select *, e1 - e2 de, (f1 - f2) - 2 * pi() * round((f1 - f2) / (2 * pi())) dp, (exp(e1) - exp(-e1)) / 2 s1, (exp(e2) - exp(-e2)) / 2 s2 from p),
    m as (select *, sqrt(p1 * p1 * (1 + s1 * s1) + 1) a, sqrt(p2 * p2 * (1 + s2 * s2) + 1) b from q)
    select l_orderkey, round(de * de + dp * dp, 5) r2, round(sqrt(de * de + dp * dp), 5) r,
      round(sqrt(pow(a + b, 2) - pow(p1 * cos(f1) + p2 * cos(f2), 2) - pow(p1 * sin(f1) + p2 * sin(f2), 2) - pow(p1 * s1 + p2 * s2, 2)), 5) mass from m""",
    5, r2="DeltaR2(disc[0], disc.back(), qty[0], qty.back())", r="DeltaR(disc[0], disc.back(), qty[0], qty.back())",
    mass="InvariantMasses(Take(qty / 10, 1), Take(disc, 1), Take(qty, 1), 0 * Take(qty, 1) + 1, Take(qty / 10, -1), Take(disc, -1), Take(qty, -1), 0 * Take(qty, -1) + 1)[0]",
)


@query(f"""
with {_ORDERS_SQL}, s as (select l_orderkey, price, qty, list_sort(price) srt from orders_)
select l_orderkey, round(list_median(price), 5) middle, round(srt[1], 5) lowest, cast(len(list_filter(list_sort(qty), lambda x: x <= 25)) - 1 as bigint) found, list_transform(list_reverse_sort(price), lambda x: round(x, 5)) down,
  list_transform(range(1, len(price) + 1), lambda i: case when len(price) = 1 then null else round((price[least(i + 1, len(price))] - price[greatest(i - 1, 1)]) / (least(i + 1, len(price)) - greatest(i - 1, 1)), 5) end) slope
from s
""")
def array_columns(spark, sf_dir):
    """Median, order statistic, binary search, order and gradient of array columns."""
    price = F.col("price")
    down = F.transform(F.sort_array(price, False), lambda x: F.round(x, 5))
    slope = F.transform(arraystats.column_gradient(price), lambda x: F.round(x, 5))
    return _orders(spark, sf_dir).select("l_orderkey", F.round(arraystats.column_median(price), 5).alias("middle"), F.round(arraystats.column_order_statistic(price, 0), 5).alias("lowest"), arraystats.column_binary_search(F.array_sort("qty"), F.lit(25.0)).cast("long").alias("found"), down.alias("down"), slope.alias("slope"))


@query("""
with a as (select list(n_nationkey::double order by n_nationkey) v, list((n_regionkey + 1)::double order by n_nationkey) w from nation),
i as (select v, w, range(1, len(v) + 1) p from a)
select * from (
  select 'loc_min' what, list_position(w, list_min(w)) - 1.0 value from i union all select 'loc_max', list_position(w, list_max(w)) - 1.0 from i union all select 'min', list_min(w) from i union all select 'max', list_max(w) from i
  union all select 'mean', round(list_avg(v), 8) from i union all select 'mean_w', round(list_sum(list_transform(p, lambda k: v[k] * w[k])) / list_sum(w), 8) from i
  union all select 'geometric', round(exp(list_avg(list_transform(w, lambda x: ln(x)))), 8) from i union all select 'rms', round(list_stddev_samp(v), 8) from i union all select 'median', list_median(v) from i
  union all select 'third', list_sort(w)[4] from i union all select 'search', len(list_filter(v, lambda x: x <= 7.5)) - 1.0 from i union all select 'quantile', round(quantile_cont(x, 0.3), 8) from (select unnest(v) x from i)
  union all select 'norm', round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 8) from i union all select 'cross', v[2] * w[3] - v[3] * w[2] from i union all select 'sorted', list_reverse_sort(w)[1] from i
  union all select 'gradient', (w[3] - w[1]) / 2 from i union all select 'laplacian', w[3] - 2 * w[2] + w[1] from i
  union all select 'distance', max(abs(cdf)) from (select x, sum(s) over (order by x) cdf from (select x, sum(s) s from (select unnest(v) x, 1.0 / 25 s from i union all select unnest(w), -1.0 / 25 from i) group by x))
  union all select 'permutation', 20.0 from i)
""")
def statistics_of_arrays(spark, sf_dir):
    """What stands for whole arrays on the driver: of the 25 nations."""
    rows = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    v, w = np.array([float(r["n_nationkey"]) for r in rows]), np.array([r["n_regionkey"] + 1.0 for r in rows])
    order, steps = [0, 1, 2, 3], 0
    while arraystats.next_permutation(order) and steps < 20:
        steps += 1
    found = {
        "loc_min": arraystats.loc_min(w), "loc_max": arraystats.loc_max(w), "min": arraystats.min_element(w), "max": arraystats.max_element(w), "mean": arraystats.mean(v), "mean_w": arraystats.mean(v, w), "geometric": arraystats.geometric_mean(w), "rms": arraystats.rms(v), "median": arraystats.median(v),
        "third": arraystats.order_statistic(w, 3), "search": arraystats.binary_search(v, 7.5), "quantile": float(arraystats.quantiles(v, [0.3])[0]), "norm": arraystats.normalize(v)[1], "cross": float(arraystats.cross(v[:3], w[:3])[0]), "sorted": float(w[arraystats.sort_index(w)[0]]),
        "gradient": float(arraystats.gradient(w)[1]), "laplacian": float(arraystats.laplacian(w)[1]), "distance": arraystats.kolmogorov_test(np.sort(v), np.sort(w), "M"), "permutation": steps,
    }
    return _rows(spark, "what string, value double", [(k, round(float(x), 8)) for k, x in found.items()])


# ---- expressions ------------------------------------------------------------------------------------------------


@query("""
select l_orderkey, l_linenumber, cast(l_partkey * 8 as bigint) up, cast(l_partkey // 4 as bigint) down, cast(~l_linenumber as int) inverse, round(pi() * l_quantity, 6) circle, cast(length(l_returnflag || l_linestatus) - 1 as bigint) size, false none, case when l_returnflag <> 'N' then 1 else 0 end back,
  cast(l_linenumber as double) / 4 fourth, cast(l_partkey & 12 as bigint) masked, cast(l_partkey | 3 as bigint) joined
from lineitem
""")
def cxx_more(spark, sf_dir):
    """Shifts, bits, constants, text methods and casts."""
    f = _plain(spark, sf_dir, "lineitem")
    for name, e in (("up", "l_partkey << 3"), ("down", "l_partkey >> 2"), ("inverse", "~l_linenumber"), ("circle", "M_PI * l_quantity"), ("size", "(long)l_returnflag.size()"), ("none", "l_linestatus.empty()"), ("back", 'l_returnflag != "N" ? 1 : 0'), ("fourth", "(double)l_linenumber / 4"), ("masked", "l_partkey & 12"), ("joined", "l_partkey | 3")):
        f = f.Define(name, e)
    return f.dataframe(["l_orderkey", "l_linenumber", "up", "down", "inverse", "circle", "size", "none", "back", "fourth", "masked", "joined"]).withColumn("circle", F.round("circle", 6))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * 2, 4) price, round(l_extendedprice * 2 + 1, 4) again, l_discount rebate from lineitem where l_linenumber > 5")
def redefine_alias(spark, sf_dir):
    f = _plain(spark, sf_dir, "lineitem").Define("price", "l_extendedprice").Redefine("price", "price * 2").Alias("rebate", "l_discount").Define("again", "price + 1").Filter("l_linenumber > 5")
    return f.dataframe(["l_orderkey", "l_linenumber", "price", "again", "rebate"]).withColumns({c: F.round(c, 4) for c in ("price", "again")})


@query("select o_orderkey, round(o_totalprice / 1000, 6) thousands, o_totalprice > 100000 dear from orders where o_totalprice > 50000")
def batch_callables(spark, sf_dir):
    """Python functions of whole batches in Define and Filter."""
    f = _plain(spark, sf_dir, "orders").Define("thousands", lambda p: p / 1000.0, ["o_totalprice"]).Filter(lambda p: p > 50000, ["o_totalprice"]).Define("dear", lambda p: p > 100000, ["o_totalprice"], "bool")
    return f.dataframe(["o_orderkey", "thousands", "dear"]).withColumn("thousands", F.round("thousands", 6))


@query("select count(*) n, count(distinct o_orderkey) keys, round(sum(o_totalprice), 2) total, 3.5::double weight from orders")
def per_sample_columns(spark, sf_dir):
    """Columns by source file, entry and slot."""
    f = _frame(spark, sf_dir, "orders").DefinePerSample("weight", {"orders": 3.5}).Define("e", "rdfentry_").Define("s", "rdfslot_")
    n, top, total, weight, slots = f.Count(), f.Max("e"), f.Sum("o_totalprice"), f.Mean("weight"), f.Min("s")
    return _rows(spark, "n bigint, keys bigint, total double, weight double", [(n.GetValue(), int(top.GetValue()) + 1, round(total.GetValue(), 2), weight.GetValue() if slots.GetValue() >= 0 else -1.0)])


@query("select name from (values ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment'), ('double')) t(name)")
def column_names(spark, sf_dir):
    f = _plain(spark, sf_dir, "customer").Define("twice", "c_acctbal * 2")
    names = [n for n in f.GetColumnNames() if n not in f.GetDefinedColumnNames() and f.HasColumn(n)] + [f.GetColumnType("twice")]
    return _rows(spark, "name string", [(n,) for n in names])


# ---- results of frames ---------------------------------------------------------------------------------------------


@query("select 'take' what, round(sum(c_acctbal), 2) value from customer union all select 'reduce', max(c_acctbal) from customer union all select 'product', 1.0 union all select 'aggregate', count(distinct c_mktsegment) from customer union all select 'batches', round(sum(c_acctbal), 2) from customer union all select 'graph', count(*) from customer union all select 'numpy', count(*) from customer union all select 'filled', count(*) from customer union all select 'display', 1 union all select 'names', 2 union all select 'helper', count(*) + 1 from customer")
def results_of_frames(spark, sf_dir):
    """Take, Reduce, Aggregate, batch folds, Graph, AsNumpy, FillObject, Book and Display."""

    class Helper:
        start, update, merge, finish = (lambda self: 0), (lambda self, state, batch: state + len(batch)), (lambda self, a, b: a + b), (lambda self, state: state + 1)

    class Filled:
        n = 0

        def Fill(self, x):
            self.n += x is not None

    f = _frame(spark, sf_dir, "customer")
    thing = Filled()
    taken, top, kinds = f.Take("c_acctbal"), f.Reduce(max, "c_acctbal"), f.Aggregate(F.count_distinct, "c_mktsegment")
    product = f.Define("one", "1.0").Reduce(np.multiply, "one")
    total = f.AggregateBatches(lambda: 0.0, lambda s, b: s + float(b["c_acctbal"].sum()), lambda a, b: a + b, ["c_acctbal"])
    graph, counted, shown = f.Graph("c_custkey", "c_acctbal"), f.Book(Helper(), ["c_custkey"]), f.Display(["c_custkey", "c_name"], 3)
    f.FillObject(thing, "c_custkey").GetValue()
    arrays = f.AsNumpy(["c_custkey"])
    rows = [
        ("take", round(sum(taken.GetValue()), 2)), ("reduce", top.GetValue()), ("product", float(product.GetValue())), ("aggregate", float(kinds.GetValue())), ("batches", round(total.GetValue(), 2)), ("graph", float(len(graph.GetValue().x))), ("numpy", float(len(arrays["c_custkey"]))), ("filled", float(thing.n)),
        ("display", float("c_name" in shown.GetValue())), ("names", float(len(f.Filter("c_custkey > 3", "late").Filter("c_custkey > 4").GetFilterNames()))), ("helper", float(counted.GetValue())),
    ]
    return _rows(spark, "what string, value double", rows)


@query("select count(*) n, round(sum(c_acctbal), 2) total, round(sum(c_acctbal * 2), 2) twice from customer where c_acctbal > 0")
def snapshot_cache(spark, sf_dir):
    """Written, read again, cached, visited in batches."""
    f = _frame(spark, sf_dir, "customer").Filter("c_acctbal > 0").Define("twice", "c_acctbal * 2").Snapshot(sinks.new_folder(spark), ["c_custkey", "c_acctbal", "twice"])
    seen = f.Cache()
    seen.Foreach(lambda k: None, ["c_custkey"])
    n, total, twice = seen.Count(), seen.Sum("c_acctbal"), seen.Sum("twice")
    return _rows(spark, "n bigint, total double, twice double", [(n.GetValue(), round(total.GetValue(), 2), round(twice.GetValue(), 2))])


@query("select count(*)::double entries, round(avg(l_quantity), 6) mean, 1 inside from lineitem")
def automatic_limits(spark, sf_dir):
    h = _frame(spark, sf_dir, "lineitem").Histo1D("l_quantity").GetValue()
    return _rows(spark, "entries double, mean double, inside int", [(float(h.counts().sum()), round(h.mean(), 6), int(h.counts(True)[0] == 0 and h.counts(True)[-1] == 0))])


@query("select 2::bigint runs, (select count(*) from orders) a, (select count(*) from customer) b")
def run_graphs(spark, sf_dir):
    from eventframe.frame import run_graphs as together

    a, b = _plain(spark, sf_dir, "orders").Count(), _plain(spark, sf_dir, "customer").Count()
    runs = together(a, b)
    return _rows(spark, "runs bigint, a bigint, b bigint", [(runs, a.GetValue(), b.GetValue())])


# ---- histograms ------------------------------------------------------------------------------------------------------

_Q50 = f"(select {_bin_sql(50, 0.5, 50.5, 'l_quantity')} bx, l_quantity x, l_discount w, l_tax y from lineitem)"


def _quantity(spark, sf_dir, *columns) -> Histogram:
    return _plain(spark, sf_dir, "lineitem").Histo1D(("h", "", 50, 0.5, 50.5), *(columns or ("l_quantity",))).GetValue()


@query(f"""
with q as {_Q50}, m as (select avg(x) a, var_pop(x) v, count(*)::double n from q), c as (select avg(pow(x - a, 3)) m3, avg(pow(x - a, 4)) m4 from q, m), b as (select bx, count(*)::double n from q group by 1)
select * from (select 'mean' what, round(a, 8) value from m union all select 'std', round(sqrt(v), 8) from m union all select 'mean_error', round(sqrt(v / n), 10) from m union all select 'std_error', round(sqrt(v / (2 * n)), 10) from m union all select 'skewness', round(m3 / pow(v, 1.5), 6) from c, m
  union all select 'kurtosis', round(m4 / (v * v) - 3, 6) from c, m union all select 'integral', n from m union all select 'part', sum(n) from b where bx between 5 and 20 union all select 'maximum', max(n) from b union all select 'minimum', min(n) from b union all select 'entries', n from m
  union all select 'between', (select n from b where bx = 10) * 0.75 + (select n from b where bx = 11) * 0.25 union all select 'at', n from b where bx = 7 union all select 'effective', n from m)
""")
def histogram_numbers(spark, sf_dir):
    h = _quantity(spark, sf_dir)
    found = {
        "mean": round(h.mean(), 8), "std": round(h.std(), 8), "mean_error": round(h.mean_error(), 10), "std_error": round(h.std_error(), 10), "skewness": round(h.skewness(), 6), "kurtosis": round(h.kurtosis(), 6), "integral": h.integral(), "part": h.integral((5, 20)), "maximum": h.maximum(), "minimum": h.minimum(),
        "entries": h.sums()["w"] if "w" in h.sums() else float(h.counts().sum()), "between": h.interpolate(10.25), "at": float(h.counts(True)[h.axes[0].find(7.0)]), "effective": h.effective_entries(),
    }
    return _rows(spark, "what string, value double", [(k, float(v)) for k, v in found.items()])


@query(f"""
with q as {_Q50}, b as (select bx, count(*)::double n, sum(w) s from q group by 1), t as (select sum(n) total from b)
select bx, round(n * 0.5, 6) scaled, round(n * s, 4) product, round(s / n, 8) ratio, round(n / total, 10) share, round(n + s, 6) added from b, t where bx between 1 and 50
""")
def histogram_arithmetic(spark, sf_dir):
    n, s = _quantity(spark, sf_dir), _quantity(spark, sf_dir, "l_quantity", "l_discount")
    parts = [n.copy().scale(0.5), n.copy().multiply(s), s.copy().divide(n), n.copy().normalized(), n.copy().merge([s])]
    assert n.copy().reset().counts().sum() == 0
    rows = [(i + 1, *[round(float(p.counts()[i]), d) for p, d in zip(parts, (6, 4, 8, 10, 6))]) for i in range(50) if n.counts()[i]]
    return _rows(spark, "bx int, scaled double, product double, ratio double, share double, added double", rows)


@query(f"with q as {_Q50} select 1 + (bx - 1) // 5 bx, count(*)::double content from q where bx between 1 and 50 group by 1")
def histogram_rebinned(spark, sf_dir):
    return _content(spark, [(i + 1, float(c)) for i, c in enumerate(_quantity(spark, sf_dir).rebin(5).counts())])


@query(f"""
with q as (select {_bin_sql(10, 0, 50, 'l_quantity')} bx, {_bin_sql(8, 0, 0.1, 'l_discount')} byy, l_discount y from lineitem)
select 'x' axis, bx bin, count(*)::double content, null::double mean from q where bx between 1 and 10 group by 2 union all select 'y', byy, count(*)::double, null from q where byy between 1 and 8 group by 2
""")
def histogram_projections(spark, sf_dir):
    h = _plain(spark, sf_dir, "lineitem").Histo2D(("h", "", 10, 0.0, 50.0, 8, 0.0, 0.1), "l_quantity", "l_discount").GetValue()
    full = h.copy()
    rows = [(axis, i + 1, float(c), None) for axis, k in (("x", 0), ("y", 1)) for i, c in enumerate(full.project(k).counts()) if c]
    return _rows(spark, "axis string, bin int, content double, mean double", rows)


# ---- several tables, rows and sets ------------------------------------------------------------------------------------


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 350000)")
def semi_join(spark, sf_dir):
    dear = _table(spark, sf_dir, "orders").where("o_totalprice > 350000")
    return relational.join(_table(spark, sf_dir, "customer"), dear.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "left_semi").select("c_custkey", "c_name")


@query("select n_name, s_suppkey, coalesce(n_name, 'none') shown from (select * from nation where n_nationkey > 5) full outer join (select * from supplier where s_nationkey < 20) on s_nationkey = n_nationkey")
def full_outer_join(spark, sf_dir):
    n, s = _table(spark, sf_dir, "nation").where("n_nationkey > 5"), _table(spark, sf_dir, "supplier").where("s_nationkey < 20")
    return n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "full_outer").select("n_name", "s_suppkey", F.coalesce("n_name", F.lit("none")).alias("shown"))


@query("select l_returnflag, l_linestatus, count(*) n, cast(grouping(l_returnflag, l_linestatus) as bigint) g from lineitem group by cube (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("select l_returnflag, l_linestatus, l_linenumber, count(*) n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linenumber))")
def grouping_sets(spark, sf_dir):
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linenumber")]]
    return _table(spark, sf_dir, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("select l_linenumber, count(*) filter (l_returnflag = 'A') a, count(*) filter (l_returnflag = 'N') n, count(*) filter (l_returnflag = 'R') r, count(distinct l_suppkey) suppliers, 1 near from lineitem group by 1")
def pivoted(spark, sf_dir):
    """Pivot, exact distinct counts, and approximate ones within five standard errors."""
    t = _table(spark, sf_dir, "lineitem")
    counts = t.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).count().select("l_linenumber", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "ANR"])
    distinct = t.groupBy("l_linenumber").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.approx_count_distinct("l_suppkey", 0.02).alias("about"))
    return counts.join(distinct, "l_linenumber").select("l_linenumber", "a", "n", "r", "suppliers", (F.abs(F.col("about") - F.col("suppliers")) <= 0.1 * F.col("suppliers") + 1).cast("int").alias("near"))


@query("""
with e as (select event_id, user_id from events), c as (select c_custkey user_id, c_acctbal v from customer where c_custkey % 3 = 0),
j as (select e.event_id, c.v from e left join c using (user_id)), g as (select *, count(v) over (order by event_id) grp from j)
select event_id, round(first_value(v) over (partition by grp order by event_id), 4) held from g
""")
def keyed_join(spark, sf_dir):
    """An entry without a match shows what the last one before it that matched showed."""
    e = _table(spark, sf_dir, "events").withColumn(ENTRY, F.col("event_id"))
    c = _table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), "c_acctbal").withColumn(ENTRY, F.col("user_id"))
    return tables.keyed_join(e, c, "c", ["user_id"]).select("event_id", F.round("c_c_acctbal", 4).alias("held"))


@query("with o as (select row_number() over () - 1 e, * from (select * from orders)) select o_custkey::bigint major, min(e) entry from o group by 1")
def built_index(spark, sf_dir):
    return tables.build_index(tables.parquet(spark, _path(sf_dir, "orders")), "o_custkey").select("major", "entry")


@query("select s_suppkey, round(a_bal, 2) a_bal, round(b_bal, 2) b_bal from (select s_suppkey, s_acctbal a_bal, case when s_suppkey % 10 = 3 then s_acctbal + 1 else s_acctbal end b_bal from supplier) where abs(a_bal - b_bal) > 0.5")
def table_difference(spark, sf_dir):
    a = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"))
    b = a.withColumn("bal", F.when(F.col("s_suppkey") % 10 == 3, F.col("bal") + 1).otherwise(F.col("bal")))
    return relational.difference(a, b, ["s_suppkey"], 0.5).select("s_suppkey", F.round("a_bal", 2).alias("a_bal"), F.round("b_bal", 2).alias("b_bal"))


# ---- entry lists, datasets, learning ------------------------------------------------------------------------------------


@query("select cast(n_nationkey as bigint) entry from nation where (n_nationkey in (1, 2, 3) or n_nationkey between 10 and 18 and n_nationkey % 2 = 0) and n_nationkey not in (2, 12) or n_nationkey = 24")
def entry_list_sets(spark, sf_dir):
    a = entries.EntryList.numbers(spark, [1, 2, 3, 3]).enter_range(10, 20, 2).remove([2, 12]).add(entries.EntryList.numbers(spark, [24]))
    a = a.intersect(entries.EntryList.numbers(spark, list(range(25)))).subtract(entries.EntryList.numbers(spark, [99]))
    assert a.contains(14) and not a.contains(12)
    return a.select(tables.parquet(spark, _path(sf_dir, "nation"))).select(F.col(ENTRY).alias("entry"))


@query("select c_custkey from customer where (c_acctbal > 0 and c_nationkey < 10) and not (c_custkey > 1000)")
def cut_algebra(spark, sf_dir):
    cut = (entries.Cut("c_acctbal>0") & "c_nationkey<10") + ~entries.Cut("c_custkey>1000")
    return formula.selected(_table(spark, sf_dir, "customer"), str(cut)).select("c_custkey")


@query("""
select * from (select 'sum' what, round(sum(l_discount), 6) value from lineitem union all select 'cut', round(sum(l_discount), 6) from lineitem where l_quantity > 25 union all select 'mean', round(sum(l_discount * l_quantity) / sum(l_discount), 8) from lineitem
  union all select 'sigma', round(sqrt(sum(l_discount * pow(l_quantity - (select sum(l_discount * l_quantity) / sum(l_discount) from lineitem), 2)) / sum(l_discount)), 6) from lineitem union all select 'range', round(sum(l_discount), 6) from lineitem where l_quantity between 5 and 10
  union all select 'appended', round(2 * sum(l_discount), 6) from lineitem union all select 'likelihood', round(sum(l_discount * l_quantity / 10) , 4) from lineitem union all select 'slices', 2.0 * count(*) from nation)
""")
def weighted_datasets(spark, sf_dir):
    d = entries.Dataset(_table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), "l_discount")
    nation = _table(spark, sf_dir, "nation")
    found = {
        "sum": (d.sum_entries(), 6), "cut": (d.sum_entries("l_quantity > 25"), 6), "mean": (d.mean("l_quantity"), 8), "sigma": (d.sigma("l_quantity"), 6), "range": (d.reduce(ranges={"l_quantity": (5, 10)}).sum_entries(), 6), "appended": (d.append(d).sum_entries(), 6),
        "likelihood": (d.negative_log_likelihood(F.exp(-F.col("l_quantity") / 10)), 4), "slices": (float(entries.Dataset.of_slices("part", {"a": nation, "b": nation}).count()), 1),
    }
    return _rows(spark, "what string, value double", [(k, round(float(v), n)) for k, (v, n) in found.items()])


@query("select 'slope' what, round(regr_slope(l_extendedprice, l_quantity), 5) value from lineitem union all select 'offset', round(regr_intercept(l_extendedprice, l_quantity), 3) from lineitem union all select 'split', count(*)::double from lineitem union all select 'squares', 285.0")
def learning_helpers(spark, sf_dir):
    """Least squares, a split that loses no row, and a parallel map with its fold."""
    t = _table(spark, sf_dir, "lineitem")
    offset, slope = entries.least_squares(t, "l_extendedprice", [F.lit(1.0), F.col("l_quantity")])
    a, b = entries.train_test_split(t, 0.7, F.col("l_orderkey"))
    squares = entries.parallel_map_reduce(spark, lambda i: i * i, 10, sum)
    return _rows(spark, "what string, value double", [("slope", round(slope, 5)), ("offset", round(offset, 3)), ("split", float(a.count() + b.count())), ("squares", squares)])


@query("""
with s as (select l_quantity q, case when l_returnflag = 'R' then 1 else 0 end y from lineitem), c as (select q, sum(y) p, sum(1 - y) n from s group by 1),
r as (select *, sum(p) over (order by q desc) - p before from c)
select round(sum(n * (before + 0.5 * p)) / ((select sum(p) from c) * (select sum(n) from c)), 8) area from r
""")
def roc_area(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return _rows(spark, "area double", [(round(entries.roc(t, "l_quantity", "y")[1], 8),)])


@query("select 'next' what, 100.0 value union all select 'entry', o_totalprice from (select row_number() over () - 1 e, * from (select * from orders)) where e = 42 union all select 'count', count(*) from orders where o_totalprice > 100000 union all select 'selector', round(sum(o_totalprice), 2) from orders union all select 'tail', 10.0 union all select 'batches', count(*) from orders")
def tree_readers(spark, sf_dir):
    """A cursor, an entry by number, a counted selection, a selector over batches, the last entries, batches in order."""

    class Total(readers.Selector):
        def start(self):
            return 0.0

        def process(self, state, batch):
            return state + float(batch["o_totalprice"].sum())

        def merge(self, a, b):
            return a + b

    t = tables.parquet(spark, _path(sf_dir, "orders"))
    r = readers.Reader(t).set_range(0, 100)
    seen = sum(1 for _ in r)
    rows = [("next", float(seen)), ("entry", readers.Reader(t).entry(42)["o_totalprice"]), ("count", float(readers.count_entries(t, "o_totalprice>100000"))), ("selector", round(readers.process(t, Total()), 2)), ("tail", float(tables.tail(t, 10).count())), ("batches", float(sum(len(b) for b in entries.batches(t.select("o_orderkey"), 4096))))]
    return _rows(spark, "what string, value double", rows)


# ---- sources and sinks ---------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark, sf_dir):
    """Written as text with a header and quotes, read again with types inferred."""
    path = sinks.new_folder(spark)
    t = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").orderBy("c_custkey").coalesce(1)
    t.write.option("header", True).option("quoteAll", True).csv(path)
    return text.csv(spark, path).drop(ENTRY)


@query("select s_suppkey k, s_acctbal v, s_name name from supplier")
def leaf_list_file(spark, sf_dir):
    """Rows as plain text, read by a leaf list."""
    path = sinks.new_folder(spark)
    sinks.write_ascii(_table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_acctbal", "s_name"])
    return text.read_file(spark, path, "k/L:v/D:name/C")


@query("select o_orderkey, o_totalprice from (select row_number() over () - 1 e, * from (select * from orders)) where e >= 100 and e < 5000 and o_totalprice > 100000 union all select o_orderkey, o_totalprice from orders where o_orderkey < 10")
def tables_written(spark, sf_dir):
    """A part of a table copied by a formula, with more rows appended."""
    path, t = sinks.new_folder(spark), tables.parquet(spark, _path(sf_dir, "orders"))
    sinks.copy_where(t, path, "o_totalprice>100000", 100, 5000)
    return sinks.write(t.where("o_orderkey < 10"), path, "UPDATE").select("o_orderkey", "o_totalprice")


@query("select c_mktsegment, count(*) n from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1")
def partitioned_sink(spark, sf_dir):
    path = sinks.new_folder(spark)
    sinks.partitioned(_table(spark, sf_dir, "customer"), path, ["c_mktsegment"])
    return spark.read.parquet(path).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("select i::bigint col0, (i * 2)::double twice from range(0, 1000) t(i) where i % 2 = 1 union all select 100000 + n_nationkey, n_nationkey * 2.0 from nation")
def frames_in_memory(spark, sf_dir):
    """A counted frame, the odd rows of a trivial one, and named arrays."""
    odd = Frame(tables.trivial(spark, 1000, odd=True)).Define("twice", "col0 * 2.0").dataframe(["col0", "twice"])
    keys = np.array([r[0] for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()], np.int64)
    arrays = Frame({"col0": 100000 + keys, "twice": keys * 2.0}, spark=spark).dataframe(["col0", "twice"]).drop(ENTRY)
    assert Frame(25, spark=spark).Count().GetValue() == 25
    return odd.unionByName(arrays)


@query("select sample, count(*) n, round(sum(x * scale), 4) total from (select 'sig' sample, c_acctbal x, 2.0 scale from customer union all select 'bkg', s_acctbal, 0.5 from supplier) group by 1")
def samples_with_metadata(spark, sf_dir):
    """Samples of files with metadata; a frame over them."""
    one = lambda name, column: sinks.write(_table(spark, sf_dir, name).select(F.col(column).alias("x")), sinks.new_folder(spark))
    paths = {"sig": (one("customer", "c_acctbal"), 2.0), "bkg": (one("supplier", "s_acctbal"), 0.5)}
    files = {k: (df.select("__file").first()[0], v) for k, (df, v) in paths.items()}
    samples = tables.with_samples(spark, {k: ([os.path.dirname(f)], {"scale": v}) for k, (f, v) in files.items()})
    f = Frame(samples).Define("y", "x * scale")
    return f.dataframe(["sample", "y"]).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query("select i part, count(*) n, min(e) lowest from (select e, e // 100 i from (select row_number() over () - 1 e from (select * from orders limit 1200))) group by 1")
def chain_order(spark, sf_dir):
    """Twelve files in the order they are named in: entries go on from file to file."""
    t, path = tables.parquet(spark, _path(sf_dir, "orders")), sinks.new_folder(spark)
    names = [f"{path}/part-{i}" for i in range(12)]
    for i, name in enumerate(names):
        t.where((F.col(ENTRY) >= 100 * i) & (F.col(ENTRY) < 100 * i + 100)).select(F.lit(i).cast("long").alias("part"), "o_orderkey").write.parquet(name)
    return tables.parquet(spark, *names).groupBy("part").agg(F.count("*").alias("n"), F.min(ENTRY).alias("lowest"))


@query("select n_name, n_regionkey + 1 r from nation where n_regionkey > 1")
def sql_source(spark, sf_dir):
    return text.from_sql(spark, "select n_name, n_regionkey + 1 r from {n} where n_regionkey > 1", n=_table(spark, sf_dir, "nation"))


@query("select i, round(4 * u * (1 - u) + 0 * k, 9) y from (select s_suppkey i, (s_acctbal + 1000) / 11000 u, 0 k from supplier)")
def formula_arrays(spark, sf_dir):
    """Several expressions of the formula language at once, with an alias and a cut that all rows pass."""
    t = _table(spark, sf_dir, "supplier")
    out = formula.arrays(t, {"i": "s_suppkey", "y": "4*u*(1-u)"}, "s_acctbal>-5000", {"u": "(s_acctbal+1000)/11000"})
    return out.select(F.col("i").cast("bigint").alias("i"), F.round("y", 9).alias("y"))


@query("select event_id, cast(year(ts) as int) y, cast(month(ts) as int) m, cast(hour(ts) as int) h, cast(json_extract_string(props, '$.k') as double) k, contains(event_type, 'c') c, upper(event_type) up from events")
def text_time_json(spark, sf_dir):
    """Functions of time, JSON and text in expressions."""
    f = _plain(spark, sf_dir, "events")
    for name, e in (("y", "Year(ts)"), ("m", "Month(ts)"), ("h", "Hour(ts)"), ("k", 'JsonNumber(props, "$.k")'), ("c", 'strstr(event_type, "c")'), ("up", "Upper(event_type)")):
        f = f.Define(name, e)
    return f.dataframe(["event_id", "y", "m", "h", "k", "c", "up"])


@query("select event_id, value * 2 twice, cast(json_extract_string(props, '$.k') as double) k from events")
def map_columns(spark, sf_dir):
    """Members of a map column by key; null where it has none."""
    t = _table(spark, sf_dir, "events").withColumn("held", F.from_json("props", "map<string,double>")).withColumn("named", F.create_map(F.lit("twice"), F.col("value") * 2))
    f = Frame(t).Define("twice", 'MapNumber(named, "twice")').Define("k", 'MapNumber(held, "k")')
    return f.dataframe(["event_id", "twice", "k"])


@query("select l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_quantity + 1, 6) grown from lineitem where l_quantity * l_quantity + 1 > 100")
def declared_functions(spark, sf_dir):
    """A Python function of batches, declared by name and called in expressions."""
    from eventframe.frame import declare

    declare("grow", lambda x, y: x * y + 1.0)
    f = _plain(spark, sf_dir, "lineitem").Define("grown", "grow(l_quantity, l_quantity)").Filter("grow(l_quantity, l_quantity) > 100")
    return f.dataframe(["l_orderkey", "l_linenumber", "l_partkey", "grown"]).withColumn("grown", F.round("grown", 6))


@query(f"""
with {_ORDERS_SQL}, p as (select l_orderkey, unnest(qty) / 10 pt, unnest(disc) eta, unnest(qty) phi from orders_), c as (select *, (exp(eta) - exp(-eta)) / 2 sh from p),
t as (select l_orderkey, sum(pt * cos(phi)) x, sum(pt * sin(phi)) y, sum(pt * sh) z, sum(sqrt(pt * pt * (1 + sh * sh) + 1)) e from c group by 1)
select l_orderkey, round(sqrt(e * e - x * x - y * y - z * z), 5) mass, round(sqrt(x * x + y * y), 5) pt from t
""")
def four_vectors(spark, sf_dir):
    from eventframe.operators import fourvectors as v

    orders = _orders(spark, sf_dir)
    tenth, one = F.transform("qty", lambda x: x / 10), F.transform("qty", lambda x: F.lit(1.0))
    summed = orders.select("l_orderkey", v.total(v.zipped(tenth, F.col("disc"), F.col("qty"), one)).alias("p"))
    return summed.select("l_orderkey", F.round(v.mass(F.col("p")), 5).alias("mass"), F.round(v.transverse(F.col("p")), 5).alias("pt"))


@query("with o as (select row_number() over () - 1 e, * from (select * from orders)), c as (select row_number() over () - 1 e, * from (select * from customer)) select o_orderkey, round(o_totalprice * 1.5, 4) scaled, c_custkey friend_key from o left join c using (e) where e >= 100 and e < 2000")
def dataset_spec(spark, sf_dir):
    """Samples with metadata, a friend and a range of entries, described as plain data."""
    spec = tables.DatasetSpec.of({"samples": {"all": {"files": [_path(sf_dir, "orders")], "metadata": {"scale": 1.5}}}, "friends": {"c": [_path(sf_dir, "customer")]}, "range": (100, 2000)})
    t = Frame(spec.table(spark)).Define("scaled", f"o_totalprice * scale + {spec.metadata('all', 'none', 0.0)}")
    return t.dataframe(["o_orderkey", "scaled", "c_c_custkey"]).select("o_orderkey", F.round("scaled", 4).alias("scaled"), F.col("c_c_custkey").alias("friend_key"))


@query("select 0::bigint first, count(*) last, 1 files from orders")
def sample_info(spark, sf_dir):
    return tables.sample_info(tables.parquet(spark, _path(sf_dir, "orders"))).agg(F.min("begin").alias("first"), F.max("end").alias("last"), F.count("*").cast("int").alias("files"))


@query("select c_custkey k, round(c_acctbal, 2) b from customer where c_acctbal > 0")
def lazy_table(spark, sf_dir):
    """A table of columns that were booked as results of a frame."""
    f = _frame(spark, sf_dir, "customer").Filter("c_acctbal > 0")
    return tables.lazy(spark, {"k": f.Take("c_custkey"), "b": f.Take("c_acctbal")}).select("k", F.round("b", 2).alias("b"))


@query("select n_nationkey::bigint key, n_name as name, n_nationkey * 0.5::double half from nation where n_regionkey = 1")
def sqlite_source(spark, sf_dir):
    """A query that SQLite runs, over a file written from a table."""
    import sqlite3

    rows = [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in _table(spark, sf_dir, "nation").collect()]
    folder = sinks.new_folder(spark).removeprefix("file://")  # SQLite opens files of a file system that all workers mount
    os.makedirs(folder)
    file = os.path.join(folder, "nations.db")
    with sqlite3.connect(file) as con:
        con.execute("create table nation (n_nationkey integer, n_name text, n_regionkey integer)")
        con.executemany("insert into nation values (?, ?, ?)", rows)
    return text.sqlite(spark, file, "select n_nationkey key, n_name name, n_nationkey * 0.5 half from nation where n_regionkey = 1").drop(ENTRY)


@query("select n_nationkey, i::bigint i, chr((ascii(n_name) + i)::int) letter from nation, range(0, 3) t(i) where n_nationkey % 2 = 0")
def table_functions(spark, sf_dir):
    """Rows that a Python function makes of each row."""

    def letters(row):
        for i in range(3 if row["n_nationkey"] % 2 == 0 else 0):
            yield i, chr(ord(row["n_name"][0]) + i)

    made = relational.table_function(_table(spark, sf_dir, "nation"), letters, "i bigint, letter string", ["n_nationkey", "n_name"])
    return made.select("n_nationkey", "i", "letter")


@query(f"""
with b as (select {_bin_sql(20, 0, 50, 'l_quantity')} bx, count(*) filter (l_returnflag = 'R')::double r, count(*) filter (l_returnflag = 'A')::double a from lineitem group by 1), i as (select * from b where bx between 1 and 20),
s as (select sum(r) sr, sum(a) sa from i), c as (select sum(r) over (order by bx) / sr cr, sum(a) over (order by bx) / sa ca from i, s)
select * from (select 'distance' what, round(max(abs(cr - ca)), 9) value from c union all select 'chi2', round(sum(pow(sa * r - sr * a, 2) / (r + a)) / max(sr * sa), 6) from i, s where r + a > 0 union all select 'ndf', sum((r + a > 0)::int) - 1.0 from i
  union all select 'down', round(sqrt(a), 0) * 0 from b where bx = 3 union all select 'set', 7.0 union all select 'added', 9.5 union all select 'error', round(sqrt(r), 9) from b where bx = 4 union all select 'line', round((select r from b where bx = 4) * 0.4 + (select r from b where bx = 5) * 0.6, 6))
""")
def histogram_comparisons(spark, sf_dir):
    """Kolmogorov distance, chi-square, single bins and values between bins."""
    from eventframe.hist.compare import chi2, kolmogorov

    f, model = _plain(spark, sf_dir, "lineitem"), ("h", "", 20, 0.0, 50.0)
    r, a = (f.Filter(f'l_returnflag == "{x}"').Histo1D(model, "l_quantity") for x in "RA")
    r, a = r.GetValue(), a.GetValue()
    test, changed = chi2(r, a), r.copy()
    changed.set_bin_content(2, 7.0)
    found = {"distance": round(kolmogorov(r, a, "M"), 9), "chi2": round(test.chi2, 6), "ndf": test.ndf, "down": 0.0 if a.bin_error_limits(3)[0] < a.bin_error_limits(3)[1] else -1.0, "set": changed.bin_content(2), "error": round(r.bin_error(4), 9), "line": round(r.interpolated(r.axes[0].centers()[3] + 0.6 * 2.5), 6)}
    changed.add_bin_content(2, weight=2.5)
    return _rows(spark, "what string, value double", [(k, float(v)) for k, v in (found | {"added": changed.bin_content(2)}).items()])


@query("select event_id, user_id from events")
def stream_deduplicated(spark, sf_dir):
    """Events of a stream without repeats of their ids."""
    from eventframe.streaming import events as streams

    schema, path = _table(spark, sf_dir, "events").schema, _path(sf_dir, "events")
    stream = streams.read_events(spark, path if os.path.isdir(path) else f"{sf_dir}/events*.parquet", schema)
    return streams.drained(streams.deduplicated(streams.timed(stream), "ts", ["event_id"]).select("event_id", "user_id"), sinks.new_folder(spark), "append")

