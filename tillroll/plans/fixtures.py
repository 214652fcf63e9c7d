"""The ``sales`` and ``raw_sales`` tables over the order-line parquet files.

``sales`` is a clean sales table (one row per order line); ``raw_sales`` is
the same data as dirty strings under typical export headers, for the
cleaning path.  Both are plain joins: lineitem with orders on the order
key (a shuffle join of two large tables, sort-merge by default, split by
AQE when a key is skewed) and with part on the part key (AQE converts it
to a broadcast join only when the part side turns out small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean
from ..sources.dates import ISO


def _tables(spark: SparkSession, sf_dir: str):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return li, o, p


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p = _tables(spark, sf_dir)
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return j.select(
        F.col("o_orderdate").alias("order_date"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand"),
        F.col("l_quantity").alias("quantity"),
        unit.alias("unit_price"),
        (F.col("l_quantity") * unit).alias("total_value"),
        F.col("l_orderkey").cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(_lines(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str, of_order: DataFrame | None = None) -> DataFrame:
    """Order lines with their order and part; ``of_order`` (keyed ``_order``)
    joins on the order key as well, while the lines still lie by it."""
    li, o, p = _tables(spark, sf_dir)
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    if of_order is not None:
        j = j.join(of_order, li.l_orderkey == of_order["_order"])
    return j.join(p, li.l_partkey == p.p_partkey)


def _raw(j: DataFrame, *more: str) -> DataFrame:
    c = F.col
    invoice_date = (F.when(c("l_orderkey") % 97 == 3, F.lit("not a date"))
                    .when(c("l_orderkey") % 89 == 5, F.lit(None).cast("string"))
                    .otherwise(c("o_orderdate").cast("date").cast("string")))
    description = F.when(c("p_partkey") % 53 == 7, F.lit(None).cast("string")).otherwise(c("p_name"))
    quantity = (F.when(c("l_linenumber") == 7, F.lit("n/a"))
                .when((c("l_linenumber") == 6) & (c("l_suppkey") % 5 == 0), (-c("l_quantity")).cast("string"))
                .when((c("l_linenumber") == 5) & (c("l_suppkey") % 7 == 0), F.lit("0"))
                .otherwise(c("l_quantity").cast("string")))
    unit_price = (F.when(c("l_suppkey") % 41 == 1, F.lit(""))
                  .when(c("l_suppkey") % 43 == 2, F.lit("1,234"))
                  .otherwise(c("p_retailprice").cast("string")))
    return j.select(
        invoice_date.alias("InvoiceDate"),
        description.alias("Description"),
        quantity.alias("Quantity"),
        unit_price.alias("UnitPrice"),
        c("l_orderkey").cast("string").alias("InvoiceNo"),
        c("o_custkey").cast("string").alias("CustomerID"),
        c("l_returnflag").alias("ExtraCol"),
        *more,
    )


# The same two tables as DuckDB SQL, for the oracle queries.
SALES_SQL = """
sales AS (
  SELECT o_orderdate AS order_date, p_name AS product_name, p_brand,
         l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
         l_quantity * (l_extendedprice / l_quantity) AS total_value,
         CAST(l_orderkey AS VARCHAR) AS transaction_id,
         CAST(o_custkey AS VARCHAR) AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

RAW_SALES_SQL = """
raw_sales AS (
  SELECT CASE WHEN l_orderkey % 97 = 3 THEN 'not a date' WHEN l_orderkey % 89 = 5 THEN NULL
              ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS InvoiceDate,
         CASE WHEN p_partkey % 53 = 7 THEN NULL ELSE p_name END AS Description,
         CASE WHEN l_linenumber = 7 THEN 'n/a'
              WHEN l_linenumber = 6 AND l_suppkey % 5 = 0 THEN CAST(-l_quantity AS VARCHAR)
              WHEN l_linenumber = 5 AND l_suppkey % 7 = 0 THEN '0'
              ELSE CAST(l_quantity AS VARCHAR) END AS Quantity,
         CASE WHEN l_suppkey % 41 = 1 THEN '' WHEN l_suppkey % 43 = 2 THEN '1,234'
              ELSE CAST(p_retailprice AS VARCHAR) END AS UnitPrice,
         CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(o_custkey AS VARCHAR) AS CustomerID, l_returnflag AS ExtraCol
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

# raw_sales after cleaning, in DuckDB: numeric text by the same pattern,
# ISO dates by TRY_CAST.
CLEAN_RAW_SQL = """
clean_raw AS (
  SELECT order_date, product_name, quantity, unit_price, transaction_id, customer_id,
         quantity * unit_price AS total_value
  FROM (SELECT TRY_CAST(trim(InvoiceDate) AS TIMESTAMP) AS order_date,
               CAST(Description AS VARCHAR) AS product_name,
               CASE WHEN regexp_full_match(trim(Quantity), '[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)')
                    THEN TRY_CAST(trim(Quantity) AS DOUBLE) END AS quantity,
               CASE WHEN regexp_full_match(trim(UnitPrice), '[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)')
                    THEN TRY_CAST(trim(UnitPrice) AS DOUBLE) END AS unit_price,
               InvoiceNo AS transaction_id, CustomerID AS customer_id
        FROM raw_sales) t
  WHERE quantity > 0 AND unit_price > 0 AND NOT isnan(quantity) AND NOT isnan(unit_price)
    AND order_date IS NOT NULL)"""


def clean_raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_sales`` cleaned; its dates are known to be ISO text."""
    return clean(raw_sales(spark, sf_dir), formats=ISO)


def day_first_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_sales`` with day-first dates, some with a time of day; a few stay
    ISO text, and a few have the month first, which the column excludes."""
    c = F.col
    _, o, _ = _tables(spark, sf_dir)
    when = o.select(c("o_orderkey").alias("_order"), (F.when(c("o_orderkey") % 101 == 7, F.date_format("o_orderdate", "yyyy-MM-dd"))
                                                       .when(c("o_orderkey") % 103 == 9, F.date_format("o_orderdate", "MM/dd/yyyy"))
                                                       .when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy H:mm"))
                                                       .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("_when"))
    raw = _raw(_lines(spark, sf_dir, when), "_when")
    bad = c("InvoiceDate").isNull() | (c("InvoiceDate") == "not a date")
    return raw.select(F.when(bad, c("InvoiceDate")).otherwise(c("_when")).alias("InvoiceDate"), *raw.columns[1:-1])


# day_first_sales and its cleaning, in DuckDB
DAY_FIRST_SQL = f"""
{RAW_SALES_SQL.replace("raw_sales AS", "iso_sales AS")},
raw_sales AS (
  SELECT i.* REPLACE (CASE WHEN InvoiceDate IS NULL OR InvoiceDate = 'not a date' THEN InvoiceDate
    WHEN o_orderkey % 101 = 7 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN o_orderkey % 103 = 9 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN o_orderkey % 3 = 0 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) || ' '
      || hour(o_orderdate) || ':' || strftime(o_orderdate, '%M')
    ELSE strftime(o_orderdate, '%d/%m/%Y') END AS InvoiceDate)
  FROM iso_sales AS i JOIN orders ON o_orderkey = CAST(InvoiceNo AS BIGINT)),
{CLEAN_RAW_SQL.replace("TRY_CAST(trim(InvoiceDate) AS TIMESTAMP)", "try_strptime(trim(InvoiceDate), ['%d/%m/%Y', '%d/%m/%Y %H:%M', '%Y-%m-%d'])")}"""
