"""Report tables, writers and the approximate options."""

import os

from pyspark.sql import functions as F

from helpers import sales_df
from tillroll.operators import kpi, products, profile, trend
from tillroll.plans import brief, report
from tillroll.sources.writer import export_products


def _sales(spark):
    rows = []
    for day in range(1, 29):
        for j, p in enumerate(["apple pie", "bread", "cheese board", "dates"]):
            if (day + j) % 3:
                rows.append((f"2024-02-{day:02d}", p, 1 + j, 2.5 + j, f"o{day}-{j % 2}", f"c{j}"))
    return sales_df(spark, rows)


def test_report_tables_and_writer(spark, tmp_path):
    s = _sales(spark)
    tables = report.report_tables(s, 5, min_support=0.1, min_lift=1.0,
                                  rf_trees=3, rf_depth=2, gbt_rounds=2, gbt_depth=2)
    assert set(tables) == {"summary", "daily", "top5", "top_products", "basket", "models"}
    idx = {r["table"]: r["rows"] for r in report.report_index(tables).collect()}
    assert idx["summary"] == 4 and idx["models"] == 3 and idx["daily"] == 28
    out = str(tmp_path / "report")
    written = report.write_report(tables, out)
    assert sorted(written) == sorted(tables)
    assert any(f.endswith(".csv") for f in os.listdir(os.path.join(out, "summary")))


def test_report_skips_short_history_and_missing_key(spark):
    s = sales_df(spark, [("2024-01-01", "a", 1, 1), ("2024-01-02", "b", 1, 1)]).drop("transaction_id")
    tables = report.report_tables(s, 5)
    assert "basket" not in tables and "models" not in tables and "summary" in tables


def test_export_products_roundtrip(spark, tmp_path):
    r = products.rollup(_sales(spark))
    out = str(tmp_path / "products")
    export_products(r, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 4 and "revenue_pct" in back.columns


def test_approx_options_close(spark):
    s = _sales(spark)
    exact, approx = kpi.metrics(s).first(), kpi.metrics(s, approx=True).first()
    assert exact["unique_products"] == approx["unique_products"] == 4
    d_exact = {(r["column"], r["statistic"]): r["value"] for r in profile.describe(s.select("quantity")).collect()}
    d_apx = {(r["column"], r["statistic"]): r["value"] for r in
             profile.describe(s.select("quantity"), approx=True).collect()}
    assert d_exact[("quantity", "mean")] == d_apx[("quantity", "mean")]
    assert abs(d_exact[("quantity", "50%")] - d_apx[("quantity", "50%")]) <= 1


def test_brief_sections(spark):
    b = brief.business_brief(_sales(spark))
    secs = {}
    for r in b.collect():
        secs.setdefault(r["section"], []).append(r)
    assert len(secs["kpi"]) == 3 and len(secs["top_revenue"]) == 4 and len(secs["bottom_revenue"]) == 3
    assert secs["best_day"][0]["label"] == min(secs["weekday"], key=lambda r: r["rank"])["label"]
    total = b.filter((F.col("section") == "kpi") & (F.col("rank") == 1)).first()["value"]
    assert abs(total - _sales(spark).agg(F.sum("total_value")).first()[0]) < 1e-9


def test_brief_reads_the_facts_once(spark):
    # every union branch must read the persisted (weekday, product) aggregate;
    # a branch that misses the cache would scan and join the facts again
    from tillroll.plans import fixtures
    s = fixtures.sales(spark, "/root/testdata/sf0.001")
    plan = brief.business_brief(s)._jdf.queryExecution().optimizedPlan()
    top = [ln for ln in plan.treeString().splitlines()]
    assert sum("InMemoryRelation" in ln for ln in top) == 5
    assert not any("Relation [" in ln and "parquet" in ln for ln in top)
    assert not any("Expand" in ln for ln in top)
    spark.catalog.clearCache()


def test_weekday_label_equals_formatted_name(spark):
    from tillroll.functions.exprs import weekday_label, weekday_name
    df = spark.createDataFrame([(f"2024-01-0{i}",) for i in range(1, 8)], "d string").select(
        F.to_date("d").alias("d"))
    rows = df.select(weekday_name("d").alias("a"), weekday_label(F.weekday("d")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and len({r["a"] for r in rows}) == 7


def test_kept_tables_can_be_released(spark):
    from helpers import sales_df
    from tillroll import session
    from tillroll.operators import products
    from tillroll.plans import brief
    session.release_kept()
    sales = sales_df(spark, [("2024-01-01", "a", 1, 2, "o"), ("2024-01-02", "b", 1, 1, "p")])
    assert products.rollup(sales).count() == 2 and brief.business_brief(sales).count() > 0
    held = list(session._KEPT)
    assert len(held) == 2 and all(df.storageLevel.useMemory for df in held)
    session.release_kept()
    assert not session._KEPT and not any(df.storageLevel.useMemory for df in held)


def test_report_reads_the_sales_once(spark, tmp_path):
    """All tables but the basket's come from one pass, nulls included."""
    rows = [(None if i % 11 == 3 else f"2024-02-{1 + i % 28:02d}", None if i % 7 == 2 else f"p{i % 9}", 1,
             None if i % 5 == 4 else float(i), f"o{i % 40}", "c") for i in range(200)]
    path = str(tmp_path / "sales")
    spark.createDataFrame(rows, "d string, product_name string, quantity int, total_value double, transaction_id string, customer_id string") \
        .withColumn("order_date", F.col("d").cast("timestamp")).drop("d").write.parquet(path)
    s = spark.read.parquet(path)
    for part in (s, s.where("false")):
        tables = report.report_tables(part, 4, include_basket=False, include_forecast=False)
        plan = report.contents(tables)._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" not in plan.lower() and "Join" not in plan
        want = {"summary": kpi.summary_table(part), "daily": trend.by_date(part), "top5": products.top_by(part, "total_value", 5),
                "top_products": products.report_top(part, 4)}
        assert set(want) == set(tables)
        for name, w in want.items():
            assert tables[name].columns == w.columns
            assert sorted(map(str, tables[name].collect())) == sorted(map(str, w.collect())), name
