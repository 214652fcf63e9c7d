"""KPIs, profile, time series, windows and product analytics on hand-made
rows, plus properties that tie the operators together."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import sales_df
from tillroll.operators import kpi, prefix, products, profile, trend

WEEK_ROWS = [("2024-01-01 09:00", "a", 1, 1, "o1"), ("2024-01-07 10:00", "a", 1, 2, "o2"),
             ("2024-01-08", "a", 1, 4, "o3"), ("2024-02-20", "a", 1, 8, "o4")]


def test_week_labels(spark):
    s = trend.revenue(sales_df(spark, WEEK_ROWS), "week").orderBy("period").collect()
    got = [(r["period"].isoformat(), r["total_value"]) for r in s]
    assert got[0] == ("2024-01-07", 3.0) and got[1] == ("2024-01-14", 4.0)
    assert [v for _, v in got[2:7]] == [0.0] * 5 and got[-1] == ("2024-02-25", 8.0)


def test_month_labels(spark):
    s = trend.revenue(sales_df(spark, WEEK_ROWS), "month").orderBy("period").collect()
    assert [(r["period"], r["total_value"]) for r in s] == [(dt.date(2024, 1, 31), 7.0), (dt.date(2024, 2, 29), 8.0)]


def test_daily_gap_fill_and_totals(spark):
    df = sales_df(spark, WEEK_ROWS)
    totals = [trend.revenue(df, g).agg(F.sum("total_value")).first()[0] for g in trend.GRAINS]
    assert totals == [15.0, 15.0, 15.0]
    d = trend.daily(df)
    assert d.count() == (dt.date(2024, 2, 20) - dt.date(2024, 1, 1)).days + 1


def test_describe(spark):
    df = sales_df(spark, [("2024-01-0%d" % (i + 1), "a", v, 1) for i, v in enumerate([1, 2, 4, 8])])
    t = {(r["column"], r["statistic"]): r for r in profile.describe(df.select("quantity", "order_date")).collect()}
    q = {k[1]: r["value"] for k, r in t.items() if k[0] == "quantity"}
    assert q["mean"] == 3.75 and q["std"] == 3.1 and (q["25%"], q["50%"], q["75%"]) == (1.75, 3.0, 5.0)
    assert t[("order_date", "std")]["value_time"] is None
    assert t[("order_date", "50%")]["value_time"] == dt.datetime(2024, 1, 2, 12, 0)


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    vals = [float(rnd.choice([1, 2, 3, 5, 8, 13])) for _ in range(5000)] + [rnd.random() * 1e6 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = profile.exact_quantiles(df, probs, grid=7)
    want = np.quantile(np.array(vals), probs)
    for g, w in zip(got, want):
        assert g == w or abs(g - w) <= 1e-9 * max(1.0, abs(w))
    inf = vals + [float("inf"), float("-inf"), float("nan")]
    dfi = spark.createDataFrame([(v,) for v in inf], "v double")
    lo, mid, hi = profile.exact_quantiles(dfi, [0.0, 0.5, 1.0], grid=7)
    assert lo == float("-inf") and hi == float("inf")
    assert mid == np.quantile(np.array(vals + [float("inf"), float("-inf")]), 0.5)


def test_moving_average_full_frames(spark):
    df = sales_df(spark, [(f"2024-01-0{i}", "a", i, 1) for i in range(1, 9)])
    ma = trend.moving_average(trend.daily(df)).orderBy("period").collect()
    assert [r["ma7"] for r in ma[:6]] == [None] * 6
    assert ma[6]["ma7"] == pytest.approx(4.0) and ma[7]["ma7"] == pytest.approx(5.0)


def test_moving_average_short_series_is_null(spark):
    df = sales_df(spark, [(f"2024-01-0{i}", "a", i, 1) for i in range(1, 8)])
    assert all(r["ma7"] is None for r in trend.moving_average(trend.daily(df)).collect())


def test_day_difference_floor(spark):
    df = sales_df(spark, [("2024-01-01 23:00", "a", 1, 1, "o", "c"), ("2024-01-03 01:00", "b", 1, 1, "o", "c")])
    m = kpi.metrics(df).first()
    assert m["date_range_days"] == 1 and m["unique_transactions"] == 1 and m["unique_customers"] == 1


def test_absent_weekday(spark):
    # 2024-01-01 is a Monday; no Sunday sales
    df = sales_df(spark, [(f"2024-01-0{i}", "a", 1, i) for i in range(1, 7)])
    wk = {r["day"]: r["total_value"] for r in trend.by_weekday(df).collect()}
    assert wk["Sunday"] == 0.0 and len(wk) == 7
    bw = trend.weekday_best_worst(df).first()
    assert bw["best_day"] == "Saturday" and bw["worst_day"] == "Monday"


def test_headline_counts_null_product(spark):
    df = sales_df(spark, [("2024-01-01", "a", 1, 2), ("2024-01-01", None, 1, 3)])
    h = kpi.headline(df).first()
    assert (h["revenue"], h["orders"], h["products"]) == (5.0, 2, 1)
    assert products.rollup(df).count() == 1


def test_summary_table(spark):
    df = sales_df(spark, [("2024-01-01", "a", 1000, 2.5), ("2024-01-01", "b", 1, 3)])
    t = {r["metric"]: r["display"] for r in kpi.summary_table(df).collect()}
    assert t["Total Revenue"] == "£2,503.00" and t["Total Orders"] == "2"


def test_dominant_product_is_class_b(spark):
    df = sales_df(spark, [("2024-01-01", "big", 81, 1), ("2024-01-01", "x", 10, 1),
                          ("2024-01-01", "y", 5, 1), ("2024-01-01", "z", 4, 1)])
    a = {r["product"]: r["category"] for r in products.abc(products.rollup(df)).collect()}
    assert a["big"].startswith("B") and not any(v.startswith("A") for v in a.values())
    s = {r["category"][0]: r["items"] for r in products.abc_summary(products.abc(products.rollup(df))).collect()}
    assert s == {"A": 0, "B": 2, "C": 2}


def test_top_ties_by_name(spark):
    df = sales_df(spark, [("2024-01-01", p, 5, 1) for p in "dcb"] + [("2024-01-01", "a", 1, 1)])
    top = products.top_n(products.rollup(df), 2).orderBy("rank").collect()
    assert [r["product"] for r in top] == ["b", "c"]
    low = products.top_by(df, "total_value", 1, ascending=True).collect()
    assert low[0]["product"] == "a"


def test_search_regex_and_literal(spark):
    df = sales_df(spark, [("2024-01-01", "Red Mug", 1, 1), ("2024-01-01", "blue cup", 1, 1),
                          ("2024-01-01", "a+b", 1, 1)])
    r = products.rollup(df)
    assert {x["product"] for x in products.search(r, "red|CUP").collect()} == {"Red Mug", "blue cup"}
    assert [x["product"] for x in products.search(r, "A+B", literal=True).collect()] == ["a+b"]


def test_report_top_cut(spark):
    long = "x" * 45
    df = sales_df(spark, [("2024-01-01", long, 2, 1)] + [("2024-01-01", f"p{i}", 1, 1) for i in range(5)])
    t = products.report_top(df, 5).orderBy("rank").collect()
    assert t[0]["product"] == "x" * 40 + "..."
    hl = products.headline(products.rollup(df)).first()
    assert hl["top_product"] == "x" * 25 + "..."


def test_pareto(spark):
    df = sales_df(spark, [("2024-01-01", p, v, 1) for p, v in [("a", 50), ("b", 30), ("c", 15), ("d", 5)]])
    p = products.pareto(products.rollup(df)).first()
    assert (p["n_80"], p["n_products"], p["pct_products"]) == (2, 4, 50.0)
    c = products.pareto_curve(products.rollup(df), 3).orderBy("position").collect()
    assert [r["cum_pct"] for r in c] == [50.0, 80.0, 95.0]


def test_bucketed_prefix_sum_equals_window(spark):
    rnd = random.Random(3)
    data = [(f"p{i:05d}", float(rnd.choice([1, 2, 3, 10, 50]) if i % 3 else rnd.random() * 100))
            for i in range(3000)]
    df = spark.createDataFrame(data, "product string, revenue double")
    ours = prefix.descending_running_sum(df, "revenue", "product", buckets=13)
    w = Window.orderBy(F.col("revenue").desc(), F.col("product").asc())
    ref = df.select("product", F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                    F.row_number().over(w).alias("p"))
    j = ours.join(ref, "product").select("cum_value", "c", "position", "p").collect()
    assert len(j) == 3000
    assert all(r["position"] == r["p"] for r in j)
    assert max(abs(r["cum_value"] - r["c"]) / r["c"] for r in j) < 1e-12
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_revenue_shares_sum(spark):
    df = sales_df(spark, [("2024-01-01", p, q, 1.5) for p, q in [("a", 3), ("b", 7), (None, 5)]])
    r = products.rollup(df)
    assert r.agg(F.sum("revenue_pct")).first()[0] == pytest.approx(100.0)
    assert r.agg(F.sum("revenue")).first()[0] == pytest.approx(15.0)


def test_prefix_sum_splits_hot_tie(spark):
    import random as _r
    rnd = _r.Random(9)
    names = [f"{rnd.choice(['ab', 'b', 'abc', 'zz', 'é'])}{i:05d}" for i in range(4000)]
    data = [(n, 5.0 if i % 3 else float(rnd.randint(1, 100))) for i, n in enumerate(names)]
    df = spark.createDataFrame(data, "product string, revenue double")
    ours = prefix.descending_running_sum(df, "revenue", "product", buckets=8)
    w = Window.orderBy(F.col("revenue").desc(), F.col("product").asc())
    ref = df.select("product", F.row_number().over(w).alias("p"),
                    F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    j = ours.join(ref, "product").collect()
    assert all(r["position"] == r["p"] for r in j)
    assert max(abs(r["cum_value"] - r["c"]) / r["c"] for r in j) < 1e-12


def test_prefix_sum_splits_ties_with_a_long_common_prefix(spark):
    names = [f"Product 00000 {i:05d}" for i in range(20_000)]
    df = spark.createDataFrame([(n, 5.0) for n in names], "product string, revenue double")
    ranges = {r["_range"]: r["count"] for r in
              prefix.ordered_ranges(df, "revenue", "product", 8).groupBy("_range").count().collect()}
    assert len(ranges) >= 7 and max(ranges.values()) < 6_000
    ours = {r["product"]: (r["position"], r["cum_value"]) for r in
            prefix.descending_running_sum(df, "revenue", "product", buckets=8).collect()}
    assert ours == {n: (i + 1, 5.0 * (i + 1)) for i, n in enumerate(names)}
