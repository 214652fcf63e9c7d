"""

``entry(spark)`` runs the flagship query (ABC classes of products) on
sf0.001.  ``queries()`` maps every operator of the inventory to a callable
``(spark, sf_dir) -> DataFrame`` over the driver's tables; ``oracle_sql()``
gives the equivalent DuckDB SQL for the ones that SQL can express.

Output conventions shared by both sides so that values hash equally:
money sums rounded to 2 places, ratios to 6 (moving means to 4), dates and
timestamps as ISO text, item sets as sorted items joined by ", ".
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

# importable however the driver loads this file (the package sits beside it)
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

try:
    from tillroll.llm import queries as llm_queries
except ImportError:          # the training-data subpackage is optional
    llm_queries = None
from tillroll.operators import basket, clean as cleaning, forecast, kpi, products, profile, trend
from tillroll.plans import brief, fixtures, report
from tillroll.sources import dates, reader

SMOKE_DIR = "/root/testdata/sf0.001"

# Query parameters (fixed for the checks).
BASKET_ITEM = "p_brand"
BASKET_SUPPORT = 0.003
BASKET_LIFT = 1.2
MAX_RULES = 15
TOP_N = 10
REPORT_N = 10
SEARCH = "RED |gizmo"
TAIL_DAYS = 60
# Forecast models as specified: 100 trees of depth 10, 100 rounds of depth 5.
MODEL_ARGS = {"rf_trees": 100, "rf_depth": 10, "gbt_rounds": 100, "gbt_depth": 5}


def _sales(spark, d):
    return fixtures.sales(spark, d)


def _clean(spark, d):
    return fixtures.clean_raw_sales(spark, d)


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _r(c, n):
    return F.round(F.col(c), n).alias(c)


# ---------------------------------------------------------------- Spark side
def q_source_shape(spark, d):
    return reader.source_shape(fixtures.raw_sales(spark, d))


def q_preview_raw(spark, d):
    return cleaning.preview(fixtures.raw_sales(spark, d), 10)


def q_clean_sales(spark, d):
    c = _clean(spark, d)
    return c.select(_ts("order_date").alias("order_date"), "product_name", "quantity", "unit_price",
                    "transaction_id", "customer_id", "total_value")


def q_date_layouts(spark, d):
    return dates.count_layouts(fixtures.day_first_sales(spark, d), "InvoiceDate")


def q_clean_day_first(spark, d):
    c = cleaning.clean(fixtures.day_first_sales(spark, d))
    return c.select(_ts("order_date").alias("order_date"), "product_name", "quantity", "unit_price",
                    "transaction_id", "customer_id", "total_value")


def q_preview_clean(spark, d):
    p = cleaning.preview(_clean(spark, d), 20)
    return p.select(_ts("order_date").alias("order_date"), "product_name", "quantity", "unit_price",
                    "transaction_id", "customer_id", "total_value")


def q_kpi_headline(spark, d):
    h = kpi.headline(_sales(spark, d))
    return h.select(_r("revenue", 2), "orders", "products", _r("avg_order", 4))


def q_kpi_metrics(spark, d):
    m = kpi.metrics(_sales(spark, d))
    return m.select("total_rows", "date_range_days", "unique_products", _r("total_revenue", 2),
                    _r("avg_order_value", 4), _ts("min_date").alias("min_date"),
                    _ts("max_date").alias("max_date"), "unique_transactions", "unique_customers")


def q_load_status(spark, d):
    s = kpi.load_status(_clean(spark, d))
    return s.select("records", _ts("first_date").alias("first_date"), _ts("last_date").alias("last_date"))


def q_report_summary(spark, d):
    return kpi.summary_table(_sales(spark, d)).select("pos", "metric", _r("value", 2), "display")


def q_profile_columns(spark, d):
    return profile.columns_profile(_clean(spark, d))


def q_profile_describe(spark, d):
    t = profile.describe(_clean(spark, d))
    return t.select("position", "column", "stat_pos", "statistic", "value",
                    _ts("value_time").alias("value_time"))


def _series(df):
    return df.select(_day("period").alias("period"), _r("total_value", 2))


def q_revenue_daily(spark, d):
    return _series(trend.revenue(_sales(spark, d), "day"))


def q_revenue_weekly(spark, d):
    return _series(trend.revenue(_sales(spark, d), "week"))


def q_revenue_monthly(spark, d):
    return _series(trend.revenue(_sales(spark, d), "month"))


def q_revenue_by_date(spark, d):
    t = trend.by_date(_sales(spark, d))
    return t.select(_day("order_day").alias("order_day"), _r("total_value", 2))


def q_revenue_by_weekday(spark, d):
    return trend.by_weekday(_sales(spark, d)).select("weekday", "day", _r("total_value", 2))


def q_revenue_by_month(spark, d):
    return trend.by_month_label(_sales(spark, d)).select("month", _r("total_value", 2))


def q_weekday_best_worst(spark, d):
    return trend.weekday_best_worst(_sales(spark, d)).select(
        "best_day", _r("best_revenue", 2), "worst_day", _r("worst_revenue", 2))


def q_revenue_last_n(spark, d):
    return _series(trend.last_n(trend.daily(_sales(spark, d)), TAIL_DAYS))


def q_revenue_last30_sum(spark, d):
    return trend.tail_sum(trend.daily(_sales(spark, d)), 30).select(_r("last30_sum", 2))


def q_revenue_ma7(spark, d):
    t = trend.moving_average(trend.daily(_sales(spark, d)), 7)
    return t.select(_day("period").alias("period"), _r("total_value", 2), _r("ma7", 4))


def _rollup(spark, d):
    return products.rollup(_sales(spark, d))


def q_product_rollup(spark, d):
    return _rollup(spark, d).select("product", _r("revenue", 2), _r("quantity", 2), _r("avg_price", 6),
                                    _r("revenue_pct", 6))


def q_product_headline(spark, d):
    return products.headline(_rollup(spark, d)).select("top_product", _r("top_revenue", 2), _r("top_share", 6),
                                                       "revenue_text", "share_text")


def q_product_top_n(spark, d):
    t = products.top_n(_rollup(spark, d), TOP_N)
    return t.select("rank", "product", _r("revenue", 2), _r("quantity", 2), _r("avg_price", 6),
                    _r("revenue_pct", 6), "revenue_text", "quantity_text", "avg_price_text", "revenue_pct_text")


def q_product_top10(spark, d):
    return products.top_ascending(_rollup(spark, d), 10).select("position", "product", _r("revenue", 2))


def _topby(measure, n, asc=False):
    def q(spark, d):
        t = products.top_by(_sales(spark, d), measure, n, ascending=asc)
        return t.select("rank", "product", _r("value", 2))
    return q


def q_report_top_products(spark, d):
    t = products.report_top(_sales(spark, d), REPORT_N)
    return t.select("rank", "product", _r("revenue", 2), "revenue_text")


def _abc(spark, d):
    return products.abc(_rollup(spark, d))


def q_product_abc(spark, d):
    return _abc(spark, d).select("position", "product", _r("revenue", 2), _r("cum_revenue", 2),
                                 _r("cum_pct", 6), "category", "revenue_text")


def q_product_abc_summary(spark, d):
    return products.abc_summary(_abc(spark, d)).select("class_pos", "category", "items", _r("revenue", 2))


def q_product_pareto(spark, d):
    return products.pareto(_rollup(spark, d)).select("n_80", "n_products", _r("pct_products", 4))


def q_product_pareto_curve(spark, d):
    t = products.pareto_curve(_rollup(spark, d), 100)
    return t.select("position", "product", _r("revenue", 2), _r("cum_pct", 4))


def q_product_search(spark, d):
    t = products.search(_rollup(spark, d), SEARCH)
    return t.select("product", _r("revenue", 2), _r("quantity", 2), _r("avg_price", 6), _r("revenue_pct", 6))


def q_basket_items(spark, d):
    return basket.presence(_sales(spark, d), "transaction_id", "product_name")


def _mine(spark, d, item=BASKET_ITEM, support=BASKET_SUPPORT, lift=BASKET_LIFT):
    return basket.mine(_sales(spark, d), "transaction_id", item, support, lift)


def q_basket_frequent_items(spark, d):
    m = _mine(spark, d)
    return m.items.select("item", "cnt", _r("support", 6), "kept", "frequent")


def q_basket_itemsets(spark, d):
    s = _mine(spark, d).itemsets
    return s.select(F.array_join("items", ", ").alias("items"), "n_items", "cnt", _r("support", 6))


_RULE_NUMS = ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage",
              "conviction"]


def q_basket_rules(spark, d):
    r = _mine(spark, d).rules
    return r.select(F.array_join("antecedents", ", ").alias("antecedents"),
                    F.array_join("consequents", ", ").alias("consequents"), *[_r(c, 6) for c in _RULE_NUMS])


def q_basket_summary(spark, d):
    return basket.summary(_mine(spark, d).rules).select("n_rules", _r("max_lift", 6), _r("max_confidence", 6))


def q_basket_summary_default(spark, d):
    r = basket.mine(_sales(spark, d), "transaction_id", "product_name").rules
    return basket.summary(r).select("n_rules", _r("max_lift", 6), _r("max_confidence", 6))


def q_basket_cross_sell(spark, d):
    t = basket.cross_sell(_mine(spark, d).rules, 5)
    return t.select("rank", "antecedents", "consequents", _r("lift", 6), _r("confidence", 6), "lift_text",
                    "confidence_text")


def q_basket_rule_table(spark, d):
    t = basket.rule_table(_mine(spark, d).rules, MAX_RULES)
    return t.select("rank", "antecedent", "consequent", _r("support", 6), _r("confidence", 6), _r("lift", 6),
                    "support_text", "confidence_text", "lift_text")


def q_basket_graph_edges(spark, d):
    e, _ = basket.graph(_mine(spark, d).rules, MAX_RULES)
    return e.select("src", "dst", _r("weight", 6))


def q_basket_graph_nodes(spark, d):
    _, n = basket.graph(_mine(spark, d).rules, MAX_RULES)
    return n.select("node", "full_name", "degree")


def q_report_basket(spark, d):
    t = basket.report_rules(_mine(spark, d).rules, 10)
    return t.select("rank", "antecedent", "consequent", _r("lift", 6), "lift_text")


def q_forecast_features(spark, d):
    f = forecast.features(trend.daily(_sales(spark, d)))
    return f.select(_day("period").alias("period"), _r("y", 2), "day_index", "dow", "month", "weekend",
                    _r("roll7", 6), _r("roll30", 6), _r("lag1", 6), _r("lag7", 6))


def q_forecast_split(spark, d):
    daily = trend.daily(_sales(spark, d))
    f = forecast.features(daily)
    n = f.count()
    k = forecast.split_point(n)
    part = F.when(F.col("day_index") < k, F.lit("train")).otherwise(F.lit("test"))
    return (f.groupBy(part.alias("split"))
            .agg(F.count(F.lit(1)).alias("n_rows"), _day(F.min("period")).alias("first_day"),
                 _day(F.max("period")).alias("last_day")))


_MODELS: dict = {}


def _models(spark, d, sales=None):
    # fitted once per session and table folder (the fits are the slow part); ``sales`` may be sums by day
    key = (spark.sparkContext.applicationId, d, tuple(sorted(MODEL_ARGS.items())))
    if key not in _MODELS:
        _MODELS[key] = forecast.train(trend.daily(_sales(spark, d) if sales is None else sales), **MODEL_ARGS)
    return _MODELS[key]


def q_forecast_scores(spark, d):
    fm = _models(spark, d)
    return fm.scores.select("model_pos", "model", _r("r2", 6), _r("mae", 2), _r("rmse", 2), "mape",
                            (F.col("model") == F.lit(fm.champion)).alias("champion"))


def q_forecast_30d(spark, d):
    fm = _models(spark, d)
    return forecast.recursive_forecast(fm).select("step", _day("date").alias("date"), _r("value", 2),
                                                  _r("lower", 2), _r("upper", 2))


def q_forecast_kpis(spark, d):
    fm = _models(spark, d)
    fc = forecast.recursive_forecast(fm)
    return forecast.forecast_kpis(fc, fm.daily)


def q_forecast_backtest(spark, d):
    return forecast.backtest(_models(spark, d))


def q_report_models(spark, d):
    return forecast.model_table(_models(spark, d).scores).drop("time_text")


def q_forecast_band(spark, d):
    """Half width of the band and the days that a forecast covers."""
    daily = trend.daily(_sales(spark, d))
    return daily.agg((F.stddev_samp("total_value") * forecast.BAND_STD_SHARE).alias("band"), F.max("period").alias("last")).select(
        _r("band", 2), _day(F.date_add("last", 1)).alias("first_day"), _day(F.date_add("last", forecast.HORIZON)).alias("last_day"))


def q_forecast_lag7_scores(spark, d):
    """Score formulas on a model without training: last week's value."""
    test = forecast.features(trend.daily(_sales(spark, d)))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    test = (test.withColumn("n", n).filter(F.col("day_index") >= F.floor(F.col("n") * forecast.TRAIN_SHARE))
            .withColumn("pred", F.greatest(F.col("lag7"), F.lit(0.0))))
    return test.agg(*forecast.score_expr()).select(_r("sse", 0), _r("ybar", 2), _r("mae", 2), _r("rmse", 2))


def q_forecast_actuals(spark, d):
    """The days that models are scored on, with their actual values."""
    f = forecast.features(trend.daily(_sales(spark, d)))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return (f.withColumn("n", n).filter(F.col("day_index") >= F.floor(F.col("n") * forecast.TRAIN_SHARE))
            .select("day_index", _day("period").alias("period"), _r("y", 2)))


SERIES = "p_brand"


def _series_daily(spark, d):
    return trend.daily(_sales(spark, d), series=SERIES)


def q_forecast_series_models(spark, d):
    """A linear model of each brand: coefficients and scores."""
    m, _ = forecast.series_linear(_series_daily(spark, d), SERIES)
    weights = [F.round(F.get("coefficients", F.lit(i)), 4).alias(f"w_{c}") for i, c in enumerate(forecast.FEATURES)]
    return m.select(SERIES, "n_days", "n_train", _r("intercept", 2), *weights, _r("r2", 6), _r("mae", 2), _r("rmse", 2))


def q_forecast_series_backtest(spark, d):
    daily = _series_daily(spark, d)
    m, _ = forecast.series_linear(daily, SERIES)
    b = forecast.series_backtest(daily, m, SERIES)
    return b.select(SERIES, "day_index", _day("period").alias("period"), _r("actual", 2), _r("pred", 2))


def q_forecast_series_30d(spark, d):
    daily = _series_daily(spark, d)
    m, _ = forecast.series_linear(daily, SERIES)
    return forecast.series_forecast(daily, m, SERIES).select(
        SERIES, "step", _day("date").alias("date"), _r("value", 2), _r("lower", 2), _r("upper", 2))


def q_forecast_short_series(spark, d):
    """Customers whose orders span too few days for a forecast."""
    t = trend.history_lengths(_sales(spark, d), "customer_id", period="order_date")
    return t.filter(F.col("n_days") < forecast.MIN_DAYS).select(
        "customer_id", "n_days", _day("first_day").alias("first_day"), _day("last_day").alias("last_day"))


def q_report_contents(spark, d):
    """All cells of the report tables that need no model, in long form."""
    tables = report.report_tables(_sales(spark, d), REPORT_N, basket_item=BASKET_ITEM, min_support=BASKET_SUPPORT,
                                  min_lift=BASKET_LIFT, include_forecast=False)
    return report.contents(tables)


def q_clean_product_rollup(spark, d):
    return products.rollup(_clean(spark, d)).select("product", _r("revenue", 2), _r("quantity", 2), _r("avg_price", 6),
                                                    _r("revenue_pct", 6))


def q_clean_product_abc(spark, d):
    return products.abc(products.rollup(_clean(spark, d))).select(
        "position", "product", _r("revenue", 2), _r("cum_revenue", 2), _r("cum_pct", 6), "category", "revenue_text")


def q_clean_revenue_daily(spark, d):
    return _series(trend.revenue(_clean(spark, d), "day"))


def q_clean_basket_itemsets(spark, d):
    """Itemsets of the product's first word; products without name count nowhere."""
    df = _clean(spark, d).withColumn("word", F.element_at(F.split("product_name", " "), 1))
    s = basket.mine(df, "transaction_id", "word", BASKET_SUPPORT, BASKET_LIFT).itemsets
    return s.select(F.array_join("items", ", ").alias("items"), "n_items", "cnt", _r("support", 6))


def q_business_brief(spark, d):
    b = brief.business_brief(_sales(spark, d))
    return b.select("section", "rank", "label", _r("value", 2), "text")


def q_report_all(spark, d):
    s = _sales(spark, d)
    sums = report.totals(s)
    tables = report.report_tables(s, REPORT_N, basket_item=BASKET_ITEM, min_support=BASKET_SUPPORT,
                                  min_lift=BASKET_LIFT, models=_models(spark, d, sums[0]), sums=sums)
    return report.report_index(tables)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: ABC classes of all products on sf0.001."""
    return q_product_abc(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "source_shape": q_source_shape,
        "preview_raw": q_preview_raw,
        "clean_sales": q_clean_sales,
        "date_layouts": q_date_layouts,
        "clean_day_first": q_clean_day_first,
        "preview_clean": q_preview_clean,
        "kpi_headline": q_kpi_headline,
        "kpi_metrics": q_kpi_metrics,
        "load_status": q_load_status,
        "report_summary": q_report_summary,
        "profile_columns": q_profile_columns,
        "profile_describe": q_profile_describe,
        "revenue_daily": q_revenue_daily,
        "revenue_weekly": q_revenue_weekly,
        "revenue_monthly": q_revenue_monthly,
        "revenue_by_date": q_revenue_by_date,
        "revenue_by_weekday": q_revenue_by_weekday,
        "revenue_by_month": q_revenue_by_month,
        "weekday_best_worst": q_weekday_best_worst,
        "revenue_last_n": q_revenue_last_n,
        "revenue_last30_sum": q_revenue_last30_sum,
        "revenue_ma7": q_revenue_ma7,
        "product_rollup": q_product_rollup,
        "product_headline": q_product_headline,
        "product_top_n": q_product_top_n,
        "product_top10": q_product_top10,
        "product_top5_revenue": _topby("total_value", 5),
        "product_top5_volume": _topby("quantity", 5),
        "product_bottom3": _topby("total_value", 3, asc=True),
        "report_top_products": q_report_top_products,
        "product_abc": q_product_abc,
        "product_abc_summary": q_product_abc_summary,
        "product_pareto": q_product_pareto,
        "product_pareto_curve": q_product_pareto_curve,
        "product_search": q_product_search,
        "basket_items": q_basket_items,
        "basket_frequent_items": q_basket_frequent_items,
        "basket_itemsets": q_basket_itemsets,
        "basket_rules": q_basket_rules,
        "basket_summary": q_basket_summary,
        "basket_summary_default": q_basket_summary_default,
        "basket_cross_sell": q_basket_cross_sell,
        "basket_rule_table": q_basket_rule_table,
        "basket_graph_edges": q_basket_graph_edges,
        "basket_graph_nodes": q_basket_graph_nodes,
        "report_basket": q_report_basket,
        "forecast_features": q_forecast_features,
        "forecast_split": q_forecast_split,
        "forecast_scores": q_forecast_scores,
        "forecast_30d": q_forecast_30d,
        "forecast_kpis": q_forecast_kpis,
        "forecast_backtest": q_forecast_backtest,
        "report_models": q_report_models,
        "forecast_band": q_forecast_band,
        "forecast_lag7_scores": q_forecast_lag7_scores,
        "forecast_actuals": q_forecast_actuals,
        "forecast_series_models": q_forecast_series_models,
        "forecast_series_backtest": q_forecast_series_backtest,
        "forecast_series_30d": q_forecast_series_30d,
        "forecast_short_series": q_forecast_short_series,
        "report_contents": q_report_contents,
        "clean_product_rollup": q_clean_product_rollup,
        "clean_product_abc": q_clean_product_abc,
        "clean_revenue_daily": q_clean_revenue_daily,
        "clean_basket_itemsets": q_clean_basket_itemsets,
        "business_brief": q_business_brief,
        "report_all": q_report_all,
        **(llm_queries.queries() if llm_queries else {}),
    }


def oracle_sql() -> dict[str, str]:
    from oracle_queries import build
    return build() | (llm_queries.oracle_sql() if llm_queries else {})
