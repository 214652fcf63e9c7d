"""Report tables: executive summary, daily revenue, top products, basket
rules and model scores, each optional.  Sections that need more data than
there is (basket without an order key, forecast under 14 days) are left
out instead of failing the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import money
from ..operators import basket, forecast, kpi, products, trend
from ..session import ensure_checkpoint_dir
from ..sources.schema import MissingOrderKeyError
from ..sources.writer import write_table


def totals(sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of ``total_value`` by day (``order_date``) and by ``product_name``,
    the latter with the number of ``lines`` and of those ``valued``.

    Both come from one pass over the sales: the report's tables and the daily
    series of its models read them.  They are a row per day and per product, cut
    from the sales by a checkpoint; the plan of a table kept in memory would not
    be known again in the report's union, and each part would read the sales."""
    ensure_checkpoint_dir(sales.sparkSession)
    t = sales.select(F.to_date("order_date").alias("order_date"), "product_name", "total_value")
    computed = (t.groupingSets([["order_date"], ["product_name"]], "order_date", "product_name")
                .agg(F.grouping("order_date").alias("_product"), F.sum("total_value").alias("total_value"),
                     F.count(F.lit(1)).alias("lines"), F.count("total_value").alias("valued"))).persist()
    both = computed.checkpoint(eager=True)           # computed once, then written
    computed.unpersist()
    return (both.where("_product = 0").select("order_date", "total_value"),
            both.where("_product = 1").select("product_name", "total_value", "lines", "valued"))


def report_tables(sales: DataFrame, n_products: int = 10, include_products: bool = True,
                  include_basket: bool = True, include_forecast: bool = True,
                  basket_item: str = "product_name", min_support: float = basket.DEFAULT_MIN_SUPPORT,
                  min_lift: float = basket.DEFAULT_MIN_LIFT, rules: DataFrame | None = None,
                  models: "forecast.ForecastModels | None" = None,
                  sums: tuple[DataFrame, DataFrame] | None = None, **model_args) -> dict[str, DataFrame]:
    """``sums``: :func:`totals` of ``sales`` where the caller has them already."""
    days, items = sums or totals(sales)
    out = {"summary": kpi.summary_table(items, "lines", "valued"),
           "daily": trend.by_date(days),
           "top5": products.top_by(items, "total_value", 5)}
    if include_products:
        out["top_products"] = products.report_top(items, n_products)
    if include_basket:
        try:
            r = rules if rules is not None else basket.mine(
                sales, item=basket_item, min_support=min_support, min_lift=min_lift).rules
            out["basket"] = basket.report_rules(r, 10)
        except MissingOrderKeyError:
            pass                                            # no order key: section skipped
    if include_forecast:
        try:
            fm = models or forecast.train(trend.daily(days), **model_args)
            out["models"] = forecast.model_table(fm.scores).select(
                "model_pos", "model", "r2", "mae", "r2_text", money("mae").alias("mae_text"),
                F.lit(fm.champion).alias("champion"))
        except trend.ShortHistoryError:
            pass                                            # under 14 days: section skipped
    return out


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> list[str]:
    """Write each (small) report table under ``path/<name>``."""
    written = []
    for name, df in tables.items():
        write_table(df, f"{path.rstrip('/')}/{name}", fmt=fmt, single_file=True)
        written.append(name)
    return written


#: Text columns of the report tables, as they are printed.
_PRINTED = {"summary": ("pos", ["metric", "display"]), "daily": ("order_day", ["order_day", "total_value"]),
            "top5": ("rank", ["product", "value"]), "top_products": ("rank", ["product", "revenue_text"]),
            "basket": ("rank", ["antecedent", "consequent", "lift_text"]),
            "models": ("model_pos", ["model", "r2_text", "mae_text"])}


def contents(tables: dict[str, DataFrame]) -> DataFrame:
    """The report as rows ``table``, ``row`` (its sort key), ``column``, ``text``."""
    parts = []
    for name, df in tables.items():
        key, cols = _PRINTED[name]
        kinds = dict(df.dtypes)
        text = {c: F.format_number(c, 2) if kinds[c] == "double" else F.col(c).cast("string") for c in cols}
        cells = F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("text")) for c in cols])
        parts.append(df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("row"), F.inline(cells)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_index(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per report table with its row count."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
