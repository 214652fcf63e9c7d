"""Randomised properties (few examples each: every example runs Spark jobs)."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import sales_df
from tillroll.operators import prefix, profile, trend

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.one_of(st.integers(-50, 50).map(float),
                          st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                min_size=1, max_size=400))
def test_quantiles_equal_numpy(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = profile.exact_quantiles(df, probs, grid=2)
    want = np.quantile(np.array(vals), probs)
    for g, w in zip(got, want):
        assert abs(g - w) <= 1e-9 * max(1.0, abs(w))


@SETTINGS
@given(st.lists(st.tuples(st.text("abcé", min_size=1, max_size=9), st.sampled_from([1.0, 2.0, 5.0, 7.5])),
                min_size=1, max_size=300, unique_by=lambda t: t[0]))
def test_running_sum_equals_window(spark, rows):
    df = spark.createDataFrame(rows, "product string, revenue double")
    ours = prefix.descending_running_sum(df, "revenue", "product", buckets=5)
    w = Window.orderBy(F.col("revenue").desc(), F.col("product").asc())
    ref = df.select("product", F.row_number().over(w).alias("p"),
                    F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    got = {r["product"]: (r["position"], r["cum_value"]) for r in ours.collect()}
    for r in ref.collect():
        pos, cum = got[r["product"]]
        assert pos == r["p"] and abs(cum - r["c"]) <= 1e-9 * r["c"]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 90), st.sampled_from(["a", "b", "c"]), st.integers(1, 9)),
                min_size=1, max_size=60))
def test_grains_keep_totals_and_fill_per_series(spark, rows):
    lines = [((dt.date(2024, 1, 1) + dt.timedelta(days=d)).isoformat(), p, q, 1.5) for d, p, q in rows]
    df = sales_df(spark, lines)
    total = sum(q * 1.5 for _, _, q in rows)
    for g in trend.GRAINS:
        assert abs(trend.revenue(df, g).agg(F.sum("total_value")).first()[0] - total) < 1e-6
    per = trend.revenue(df, "day", series="product_name").collect()
    for p in {r[1] for r in rows}:
        days = sorted(d for d, pp, _ in rows if pp == p)
        got = sorted(r["period"] for r in per if r["product_name"] == p)
        assert len(got) == days[-1] - days[0] + 1 and len(set(got)) == len(got)
