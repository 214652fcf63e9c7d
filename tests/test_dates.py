"""Date layouts: election over a column, reading by one layout."""

import datetime as dt
import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillroll.operators.clean import clean
from tillroll.plans import fixtures
from tillroll.sources import dates
from tillroll.sources.dates import Layout


def column(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string")


def elected(spark, *texts):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return dates.elect(column(spark, texts), "t").column


def read(spark, layout, *texts):
    return [r["d"] for r in column(spark, texts).select(dates.read(F.col("t"), layout).alias("d")).collect()]


def test_day_first_columns(spark):
    assert elected(spark, "02/03/2024", "13/02/2024", None, "") == Layout("dmy", "/")
    assert elected(spark, "13-02-2024", "02-03-2024", "x") == Layout("dmy", "-")
    assert elected(spark, "02/13/2024", "02/03/2024 8:26") == Layout("mdy", "/")
    assert elected(spark, "2024/02/13", "13/02/2024", "2024/02/14") == Layout("ymd", "/")
    assert elected(spark, "2024-02-13", "2024-02-13T08:26:00.5", "1/1/2024") == dates.ISO
    assert elected(spark, "13 Feb 2024", "1 March 2024") == Layout("dmy", " ", named=True)
    assert elected(spark, "Feb 13, 2024", "March 1, 2024 3:05 pm") == Layout("mdy", " ", named=True)
    assert elected(spark, "13/02/24", "02/03/69") == Layout("dmy", "/", short=True)
    assert elected(spark, "20240213", "20241301") == Layout("ymd", "")
    assert elected(spark, None, "", "nothing") == dates.ISO


def test_strays_are_read_by_their_own_family(spark):
    df = column(spark, ["13/02/2024", "14/02/2024", "02/13/2024", "2024-05-01", "02-03-2024", "1 Mar 2024"])
    every = dates.elect(df, "t")
    assert every.order == (Layout("dmy", "/"), dates.ISO, Layout("dmy", "-"), Layout("dmy", " ", named=True))
    got = [r["d"] and (r["d"].month, r["d"].day) for r in df.select(dates.read("t", every).alias("d")).collect()]
    assert got == [(2, 13), (2, 14), None, (5, 1), (3, 2), (3, 1)]


def test_ties_are_reported(spark):
    with pytest.warns(UserWarning, match="MM/dd/yyyy, but another order"):
        assert dates.elect(column(spark, ["02/03/2024", "12/12/2024"]), "t").column == Layout("mdy", "/")
    assert elected(spark, "02.03.2024") == Layout("dmy", ".")
    rows = {r["layout"]: r for r in dates.count_layouts(column(spark, ["02/03/2024", "13/02/2024", " ", None]), "t").collect()}
    assert len(rows) == len(dates.candidates())
    assert (rows["dd/MM/yyyy"]["parsed"], rows["MM/dd/yyyy"]["parsed"], rows["dd/MM/yyyy"]["filled"]) == (2, 1, 2)
    assert {k: r["use"] for k, r in rows.items() if r["use"]} == {"dd/MM/yyyy": 1} and not any(r["tied"] for r in rows.values())


def test_reading(spark):
    d = dt.datetime
    assert read(spark, Layout("dmy", "/"), "13/02/2024", " 2/3/2024 ", "02/03/2024 8:26", "2/3/2024 23:59:07.25", "2/3/2024T00:00",
                "2/3/2024 12:05 AM", "2/3/2024 12:05:09pm", "1/1/2024, 1:00") == [
        d(2024, 2, 13), d(2024, 3, 2), d(2024, 3, 2, 8, 26), d(2024, 3, 2, 23, 59, 7, 250000), d(2024, 3, 2),
        d(2024, 3, 2, 0, 5), d(2024, 3, 2, 12, 5, 9), d(2024, 1, 1, 1, 0)]
    assert read(spark, Layout("dmy", "/"), "31/02/2024", "29/02/2023", "2/13/2024", "13-02-2024", "13/02-2024", "13/02/24", "1/1/2024 24:00",
                "1/1/2024 8:60", "1/1/2024 8:00:60", "1/1/2024 13:00 PM", "1/1/2024 0:10 am", "13/02/2024 x", "", None, "\x01|1") == [None] * 15
    assert read(spark, Layout("dmy", "/", short=True), "13/02/24", "1/1/68", "1/1/69", "1/1/2024") == [
        d(2024, 2, 13), d(2068, 1, 1), d(1969, 1, 1), None]
    assert read(spark, Layout("mdy", " ", named=True), "Feb 13, 2024", "SEPTEMBER 1 2024", "Sept 1 2024", "Febr 1 2024", "13 Feb 2024") == [
        d(2024, 2, 13), d(2024, 9, 1), d(2024, 9, 1), None, None]
    assert read(spark, Layout("dmy", " ", named=True), "13-Feb-2024", "1 mar 2024 8:00") == [d(2024, 2, 13), d(2024, 3, 1, 8)]
    assert read(spark, Layout("ymd", "."), "2024.2.3") == [d(2024, 2, 3)]
    assert read(spark, Layout("ymd", ""), "20240229", "20230229", "2024022") == [d(2024, 2, 29), None, None]


def test_clean_reads_a_column_by_its_layout(spark):
    cols = "InvoiceDate string, Description string, Quantity string, UnitPrice string"
    raw = spark.createDataFrame([("13/02/2024", "a", "1", "1"), ("02/03/2024", "b", "1", "1"), ("2024-05-01", "c", "1", "1")], cols)
    got = {r["product_name"]: r["order_date"] for r in clean(raw).collect()}
    assert got == {"a": dt.datetime(2024, 2, 13), "b": dt.datetime(2024, 3, 2), "c": dt.datetime(2024, 5, 1)}
    pinned = {r["product_name"]: r["order_date"] for r in clean(raw, formats=Layout("mdy", "/")).collect()}
    assert pinned == {"b": dt.datetime(2024, 2, 3)}
    listed = {r["product_name"]: r["order_date"] for r in clean(raw, formats=["M/d/yyyy"]).collect()}
    assert listed == {"b": dt.datetime(2024, 2, 3), "c": dt.datetime(2024, 5, 1)}


def test_names_are_distinct():
    names = [a.name for a in dates.candidates()]
    assert len(set(names)) == len(names)


def test_day_first_sales_join_by_order_once(spark, tmp_path):
    """Layouts of an order join while its lines lie by order: no shuffle of the
    finished rows; orders, parts and lines that come twice multiply as joins do."""
    at = dt.datetime(2024, 2, 13, 8, 5)
    lines = [(k, 1, 2, n, 3.0, "N") for k in (6, 7, 8) for n in (1, 2)] + [(6, 1, 2, 1, 3.0, "N"), (None, 1, 2, 1, 3.0, "N")]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"),
        "orders": ([(6, 1, at), (7, 2, at), (7, 2, at), (None, 3, at), (8, 3, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "part": ([(1, "RED gizmo", 9.5), (1, "RED gizmo", 9.5)], "p_partkey long, p_name string, p_retailprice double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fixtures.day_first_sales(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = Counter((r.InvoiceNo, r.InvoiceDate) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert got == {("6", "13/2/2024 8:05"): 6, ("7", "2024-02-13"): 16, ("8", None): 4}
    assert df.columns == fixtures.raw_sales(spark, str(tmp_path)).columns
    assert plan.count("Exchange hashpartitioning") == 5
