"""Business brief: the aggregate facts handed to an assistant, as one long
table ``(section, rank, label, value, text)``.

One pass over the sales table: a plain aggregate per ``(weekday,
product)`` (partial aggregation before its shuffle; at most seven rows per
product) is persisted, and the totals, the weekday sums and the product
sums are small re-aggregations of it.  Every section is a projection or a
top-k of those, so the fact table is scanned once.

A ``GROUPING SETS ((), (weekday), (product))`` aggregate would give the
same three levels, but its Expand feeds three copies of every fact row
into the hash aggregate, and inside the self-union below only one branch
matched the cached grouping-sets plan: the other branches scanned the
facts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import weekday_label
from ..session import kept

_COLS = ["section", "rank", "label", "value", "text"]


def _row(df: DataFrame, section: str, rank, label, value, text=None) -> DataFrame:
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    return df.select(F.lit(section).alias("section"), c(rank).cast("int").alias("rank"),
                     c(label).cast("string").alias("label"), c(value).cast("double").alias("value"),
                     (c(text) if text is not None else F.lit(None)).cast("string").alias("text"))


def _rows(df: DataFrame, specs) -> DataFrame:
    """Several brief lines per input row, in one projection.  Each spec is
    ``(section, rank, label, value, text[, condition])``; a line whose
    condition is false is left out."""
    lines = []
    for spec in specs:
        section, rank, label, value, text = spec[:5]
        st = F.struct(F.lit(section).alias("section"), rank.cast("int").alias("rank"),
                      label.cast("string").alias("label"), value.cast("double").alias("value"),
                      (text if text is not None else F.lit(None)).cast("string").alias("text"))
        lines.append(F.when(spec[5], st) if len(spec) > 5 else st)
    return df.select(F.inline(F.filter(F.array(*lines), lambda x: x.isNotNull())))


def _ranked(df: DataFrame, value: str, key: str, n: int | None, ascending: bool = False) -> DataFrame:
    order = [F.col(value).asc() if ascending else F.col(value).desc(), F.col(key).asc()]
    top = df.orderBy(*order).limit(n) if n else df
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))   # <= n (or 7) rows


def brief_aggregate(sales: DataFrame) -> DataFrame:
    """Sums per (weekday, product) in one pass over the facts."""
    return (sales.groupBy(F.weekday("order_date").alias("_wd"), F.col("product_name").alias("product"))
            .agg(F.sum("total_value").alias("v"), F.sum("quantity").alias("q"),
                 F.count(F.lit(1)).alias("n"), F.min("order_date").alias("d0"),
                 F.max("order_date").alias("d1"))
            .select(weekday_label("_wd").alias("day"), "product", "v", "q", "n", "d0", "d1"))


def business_brief(sales: DataFrame, aggregate: DataFrame | None = None) -> DataFrame:
    """The brief.  ``aggregate`` (from :func:`brief_aggregate`) may be given
    by a caller that manages its caching; otherwise it is built and
    persisted here, until ``session.release_kept``."""
    g = aggregate if aggregate is not None else kept(brief_aggregate(sales))
    k = g.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"),              # one row
              F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    days = g.groupBy("day").agg(F.sum("v").alias("v"))                     # <= 7 rows
    prods = (g.filter(F.col("product").isNotNull())
             .groupBy("product").agg(F.sum("v").alias("v"), F.sum("q").alias("q")))
    aov = F.coalesce(F.try_divide(F.col("v"), F.col("n")), F.lit(0.0))
    wk = _ranked(days, "v", "day", None).withColumn("m", F.max("rank").over(Window.partitionBy()))  # <= 7 rows
    parts = [
        # the one totals row gives the KPI and date lines
        _rows(k, [("kpi", F.lit(1), F.lit("Total Revenue"), F.col("v"), None),
                  ("kpi", F.lit(2), F.lit("Total Orders"), F.col("n"), None),
                  ("kpi", F.lit(3), F.lit("Average Order Value"), aov, None),
                  ("dates", F.lit(1), F.lit("first"), F.lit(None), F.date_format("d0", "yyyy-MM-dd")),
                  ("dates", F.lit(2), F.lit("last"), F.lit(None), F.date_format("d1", "yyyy-MM-dd"))]),
        # each weekday row gives its ranking line, and the best / worst line
        _rows(wk, [("weekday", F.col("rank"), F.col("day"), F.col("v"), None),
                   ("best_day", F.lit(1), F.col("day"), F.col("v"), None, F.col("rank") == 1),
                   ("worst_day", F.lit(1), F.col("day"), F.col("v"), None, F.col("rank") == F.col("m"))]),
        _row(_ranked(prods, "v", "product", 5), "top_revenue", "rank", "product", "v"),
        _row(_ranked(prods, "q", "product", 5), "top_volume", "rank", "product", "q"),
        _row(_ranked(prods, "v", "product", 3, ascending=True), "bottom_revenue", "rank", "product", "v"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*_COLS)
