"""Product rollup, rankings, ABC classes, Pareto and search.

The rollup is one shuffle on the product key (partial aggregation first).
Top / bottom lists are top-k plans (``TakeOrderedAndProject``: each task
keeps k rows).  Cumulative shares use the bucketed running sum of
:mod:`tillroll.operators.prefix`, never an unpartitioned window over all
products.  Every ordering is total (revenue, then name), so ties are
deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cut, money, plain_money
from ..session import kept
from .prefix import descending_running_sum

# fixed values: ABC cut points and class labels
ABC_A_MAX = 0.80
ABC_B_MAX = 0.95
ABC_LABELS = ["A-Grade (Top 80% of Revenue)", "B-Grade (Next 15% of Revenue)",
              "C-Grade (Bottom 5% of Revenue)"]


def rollup(df: DataFrame, item: str = "product_name", persist: bool = True) -> DataFrame:
    """Per product: revenue, quantity, unweighted mean unit price, and share
    of the revenue of all named products in percent.

    The per-product aggregate (one row per product) is persisted by
    default (until ``session.release_kept``): the share's total, the
    cumulative sums and the rankings all read it, and without the cache each
    of them would re-read the facts.
    """
    per = (df.filter(F.col(item).isNotNull())
           .groupBy(F.col(item).alias("product"))
           .agg(F.sum("total_value").alias("revenue"), F.sum("quantity").alias("quantity"),
                F.avg("unit_price").alias("avg_price")))
    if persist:
        per = kept(per)
    total = per.agg(F.sum("revenue")).scalar()          # scalar subquery, run once
    return per.withColumn("revenue_pct", F.col("revenue") / total * 100)


def _top(df: DataFrame, by: str, n: int, ascending: bool = False, key: str = "product") -> DataFrame:
    order = [F.col(by).asc() if ascending else F.col(by).desc(), F.col(key).asc()]
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))   # n rows


def top_n(products: DataFrame, n: int = 10, by: str = "revenue") -> DataFrame:
    """The ``n`` best products by ``by`` with rank and display columns."""
    if not 1 <= n:
        raise ValueError("n must be positive")
    t = _top(products, by, n)
    return t.select("rank", "product", "revenue", "quantity", "avg_price", "revenue_pct",
                    money("revenue").alias("revenue_text"),
                    F.format_number("quantity", 0).alias("quantity_text"),
                    plain_money("avg_price").alias("avg_price_text"),
                    F.concat(F.format_number("revenue_pct", 1), F.lit("%")).alias("revenue_pct_text"))


def top_ascending(products: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best by revenue, numbered in ascending order for a bar chart."""
    t = _top(products, "revenue", n)
    return t.select((F.max("rank").over(Window.partitionBy()) - F.col("rank") + 1).alias("position"),
                    "product", "revenue")


def top_by(df: DataFrame, measure: str = "total_value", n: int = 5, ascending: bool = False,
           item: str = "product_name") -> DataFrame:
    """Largest (or smallest) ``n`` products by the sum of ``measure``."""
    sums = (df.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("product"))
            .agg(F.sum(measure).alias("value")))
    return _top(sums, "value", n, ascending).select("rank", "product", "value")


def headline(products: DataFrame) -> DataFrame:
    """Top product (name cut to 25 characters plus '...'), revenue, share,
    with display text."""
    t = _top(products, "revenue", 1)
    return t.select(cut("product", 25, always=True).alias("top_product"),
                    F.col("revenue").alias("top_revenue"), F.col("revenue_pct").alias("top_share"),
                    money("revenue", 0).alias("revenue_text"),
                    F.concat(F.format_number("revenue_pct", 1), F.lit("%")).alias("share_text"))


def report_top(df: DataFrame, n: int = 10, item: str = "product_name") -> DataFrame:
    """Report table: rank, name cut at 40 characters, revenue."""
    if n < 1:
        raise ValueError("n must be positive")
    t = top_by(df, "total_value", n, item=item)
    return t.select("rank", cut(F.col("product").cast("string"), 40).alias("product"),
                    F.col("value").alias("revenue"), money("value").alias("revenue_text"))


def cumulative(products: DataFrame, buckets: int | None = None) -> DataFrame:
    """Products with running revenue (descending order) and cumulative share."""
    total = products.agg(F.sum("revenue")).scalar()
    ranked = descending_running_sum(products.select("product", "revenue"), "revenue", "product",
                                    buckets=buckets, cum_col="cum_revenue", pos_col="position")
    return ranked.withColumn("cum_pct", F.col("cum_revenue") / total)


def abc(products: DataFrame, buckets: int | None = None) -> DataFrame:
    """ABC class per product from its cumulative share (share including the
    product itself: a product holding 81 % alone is class B)."""
    c = cumulative(products, buckets)
    cat = (F.when(F.col("cum_pct") <= ABC_A_MAX, F.lit(ABC_LABELS[0]))
           .when(F.col("cum_pct") <= ABC_B_MAX, F.lit(ABC_LABELS[1]))
           .otherwise(F.lit(ABC_LABELS[2])))
    return c.select("position", "product", "revenue", "cum_revenue", "cum_pct", cat.alias("category"),
                    money("revenue").alias("revenue_text"))


def abc_summary(abc_df: DataFrame) -> DataFrame:
    """Items and revenue per class; classes without items show 0."""
    spark = abc_df.sparkSession
    classes = spark.createDataFrame(list(enumerate(ABC_LABELS)), "class_pos int, category string")
    per = abc_df.groupBy("category").agg(F.count(F.lit(1)).alias("items"),
                                         F.sum("revenue").alias("revenue"))
    return (F.broadcast(classes).join(per, "category", "left")           # 3 rows
            .select("class_pos", "category", F.coalesce("items", F.lit(0)).alias("items"),
                    F.coalesce("revenue", F.lit(0.0)).alias("revenue")))


def pareto(products: DataFrame, buckets: int | None = None) -> DataFrame:
    """How many products make up 80 % of revenue, and their share of products."""
    c = cumulative(products, buckets)
    return (c.agg(F.count_if(F.col("cum_pct") * 100 <= 80).alias("n_80"),
                  F.count(F.lit(1)).alias("n_products"))
            .withColumn("pct_products", F.col("n_80") / F.col("n_products") * 100))


def pareto_curve(products: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` products: 0-based position, revenue, cumulative percent.

    Exact without the global running sum: the prefix of the top ``n`` needs
    only those rows and the grand total.
    """
    total = products.agg(F.sum("revenue")).scalar()
    order = [F.col("revenue").desc(), F.col("product").asc()]
    top = products.orderBy(*order).limit(n)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)   # n rows
    return top.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("position"), "product",
                      "revenue", (F.sum("revenue").over(w) / total * 100).alias("cum_pct"))


def search(products: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Products whose name contains ``pattern`` ignoring case (a regular
    expression unless ``literal``); null names never match."""
    name = F.col("product")
    if literal:
        cond = F.lower(name).contains(pattern.lower())
    else:
        cond = name.rlike("(?i)" + pattern)
    return products.filter(name.isNotNull() & cond)
