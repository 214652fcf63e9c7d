"""Scalar KPIs: one global aggregate each (partial aggregates per task, one
tiny final merge; nothing row-sized reaches a single task)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import money, plain_money, whole_days_between


def _distinct(col: str, approx: bool):
    return F.approx_count_distinct(col) if approx else F.count_distinct(col)


def headline(df: DataFrame, approx: bool = False) -> DataFrame:
    """revenue, orders (= line count, not distinct orders), distinct
    products, average value per line (null on an empty table)."""
    return (df.agg(F.coalesce(F.sum("total_value"), F.lit(0.0)).alias("revenue"),
                   F.count(F.lit(1)).alias("orders"),
                   _distinct("product_name", approx).alias("products"))
            .withColumn("avg_order", F.try_divide(F.col("revenue"), F.col("orders"))))


def metrics(df: DataFrame, approx: bool = False) -> DataFrame:
    """Headline KPIs plus date span and distinct orders / customers.

    Distinct counts of absent optional columns are null.  Several exact
    distinct counts plan as one Expand + two-level aggregate; each task
    de-duplicates before the shuffle.  ``approx=True`` uses HyperLogLog++
    sketches instead (no Expand, constant-size partial state).
    """
    cols = set(df.columns)
    aggs = [
        F.count(F.lit(1)).alias("total_rows"),
        F.min("order_date").alias("min_date"),
        F.max("order_date").alias("max_date"),
        _distinct("product_name", approx).alias("unique_products"),
        F.coalesce(F.sum("total_value"), F.lit(0.0)).alias("total_revenue"),
        F.avg("total_value").alias("avg_order_value"),
    ]
    for c, name in (("transaction_id", "unique_transactions"), ("customer_id", "unique_customers")):
        aggs.append((_distinct(c, approx) if c in cols else F.lit(None).cast("bigint")).alias(name))
    return (df.agg(*aggs)
            .withColumn("date_range_days", whole_days_between("min_date", "max_date"))
            .select("total_rows", "date_range_days", "unique_products", "total_revenue",
                    "avg_order_value", "min_date", "max_date", "unique_transactions",
                    "unique_customers"))


def load_status(df: DataFrame) -> DataFrame:
    """Row count and first / last order date."""
    return df.agg(F.count(F.lit(1)).alias("records"),
                  F.min("order_date").alias("first_date"),
                  F.max("order_date").alias("last_date"))


def summary_table(df: DataFrame, lines: str | None = None, valued: str | None = None) -> DataFrame:
    """Executive summary as metric / value / display rows.

    Rows that are sums already name the columns that count their lines
    (``lines``) and those of them with a value (``valued``)."""
    n = F.coalesce(F.sum(lines), F.lit(0)) if lines else F.count(F.lit(1))
    mean = F.try_divide(F.sum("total_value"), F.sum(valued)) if valued else F.avg("total_value")
    k = df.agg(F.coalesce(F.sum("total_value"), F.lit(0.0)).alias("rev"),
               n.alias("n"), mean.alias("mean"),
               F.count_distinct("product_name").alias("prods"))
    rows = F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("Total Revenue").alias("metric"),
                 F.col("rev").alias("value"), money("rev").alias("display")),
        F.struct(F.lit(2).alias("pos"), F.lit("Total Orders").alias("metric"),
                 F.col("n").cast("double").alias("value"), F.format_number(F.col("n"), 0).alias("display")),
        F.struct(F.lit(3).alias("pos"), F.lit("Average Order Value").alias("metric"),
                 F.col("mean").alias("value"), plain_money("mean").alias("display")),
        F.struct(F.lit(4).alias("pos"), F.lit("Unique Products Sold").alias("metric"),
                 F.col("prods").cast("double").alias("value"),
                 F.format_number(F.col("prods"), 0).alias("display")),
    )
    return k.select(F.inline(rows)).select("pos", "metric", "value", "display")
