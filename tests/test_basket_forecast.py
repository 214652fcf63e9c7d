"""Basket mining, forecasting and streaming ingestion."""

import datetime as dt
import os
import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from helpers import sales_df
from tillroll.operators import basket, forecast, trend
from tillroll.streaming import ingest


def _orders(spark, baskets):
    lines = []
    for i, items in enumerate(baskets):
        for it in items:
            lines.append(("2024-01-01", it, 1, 1, f"o{i}"))
    return sales_df(spark, lines)


def test_repeated_lines_counted_once(spark):
    df = _orders(spark, [["a", "a", "b"], ["a"]])
    pres = basket.presence(df, "transaction_id")
    assert pres.count() == 3
    m = basket.mine(df, "transaction_id", min_support=0.5, min_lift=0.0)
    cnt = {tuple(r["items"]): r["cnt"] for r in m.itemsets.collect()}
    assert cnt[("a",)] == 2 and cnt[("a", "b")] == 1


def test_support_boundary_kept(spark):
    bs = [["x", "y"]] * 2 + [["x"]] * 3 + [["y"]] * 3 + [[f"z{i}"] for i in range(92)]
    m = basket.mine(_orders(spark, bs), "transaction_id", min_support=0.02, min_lift=0.0)
    sets = {tuple(r["items"]) for r in m.itemsets.collect()}
    assert ("x", "y") in sets and m.n_orders == 100


def test_rare_floor(spark):
    bs = [["a", "b"]] * 200 + [["a"]] * 199 + [["rare", "a"]]
    m = basket.mine(_orders(spark, bs), "transaction_id", min_support=0.0001, min_lift=0.0)
    ic = {r["item"]: r["kept"] for r in m.items.collect()}
    assert ic["rare"] is False and ic["a"] is True
    assert all("rare" not in r["items"] for r in m.itemsets.collect())


def test_three_item_rules(spark):
    bs = [["a", "b", "c"]] * 3 + [["d"]] * 7
    m = basket.mine(_orders(spark, bs), "transaction_id", min_support=0.1, min_lift=1.0)
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in m.rules.collect()}
    r = rules[(("a",), ("b", "c"))]
    assert r["lift"] == pytest.approx(10 / 3) and r["confidence"] == 1.0 and r["conviction"] is None
    # every split of the 3-set plus both directions of the 3 pairs
    assert len(rules) == 6 + 6


def test_empty_paths(spark):
    one = _orders(spark, [["a"], ["a"]])
    m = basket.mine(one, "transaction_id")
    assert m.itemsets.count() == 0 and m.rules.count() == 0
    with pytest.raises(ValueError):
        basket.mine(sales_df(spark, [("2024-01-01", "a", 1, 1)]).drop("transaction_id"))


def test_lift_symmetric_and_antimonotone(spark):
    import random
    rnd = random.Random(5)
    bs = [rnd.sample("abcdefg", rnd.randint(1, 4)) for _ in range(300)]
    m = basket.mine(_orders(spark, bs), "transaction_id", min_support=0.02, min_lift=0.0)
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["lift"] for r in m.rules.collect()}
    for (a, c), lift in rules.items():
        assert rules[(c, a)] == pytest.approx(lift)
    sup = {tuple(r["items"]): r["support"] for r in m.itemsets.collect()}
    for items, s in sup.items():
        for i in range(len(items)):
            sub = items[:i] + items[i + 1:]
            if sub:
                assert sup[sub] >= s


def test_large_order(spark):
    names = [f"item {i:04d}" for i in range(1000)]
    rare = [names[i:i + 2] for i in range(0, 1000, 2)]
    df = _orders(spark, [names] + rare + rare)
    pairs = basket.presence(df, "transaction_id")
    sets = basket.frequent_itemsets(pairs, 400, 2 / 400)
    got = {r["n_items"]: r["count"] for r in sets.groupBy("n_items").count().collect()}
    assert got == {1: 1000, 2: 500}             # only pairs that occur again; no triple of the large order is
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (((x" not in plan


def test_triples_of_frequent_pairs(spark):
    import random
    from itertools import combinations
    rnd = random.Random(11)
    bs = [rnd.sample("abcdefghij", rnd.randint(1, 9)) for _ in range(200)]
    pairs = basket.presence(_orders(spark, bs), "transaction_id")
    want = {}
    for b in bs:
        for k in (1, 2, 3):
            for c in combinations(sorted(set(b)), k):
                want[c] = want.get(c, 0) + 1
    got = {tuple(r["items"]): r["cnt"] for r in basket.frequent_itemsets(pairs, 200, 0.1).collect()}
    assert got == {c: n for c, n in want.items() if n >= 20}


def test_itemsets_match_fpgrowth(spark):
    from pyspark.ml.fpm import FPGrowth
    import random
    rnd = random.Random(2)
    bs = [rnd.sample("abcdefgh", rnd.randint(1, 5)) for _ in range(400)]
    df = _orders(spark, bs)
    m = basket.mine(df, "transaction_id", min_support=0.03, min_lift=0.0)
    ours = {tuple(r["items"]): r["cnt"] for r in m.itemsets.collect()}
    tx = basket.presence(df, "transaction_id").groupBy("order_id").agg(F.collect_set("item").alias("items"))
    fp = FPGrowth(itemsCol="items", minSupport=0.03).fit(tx)
    theirs = {tuple(sorted(r["items"])): r["freq"] for r in fp.freqItemsets.collect() if len(r["items"]) <= 3}
    assert ours == theirs


def test_graph_tables(spark):
    bs = [["alpha one two three", "beta x"]] * 5 + [["alpha one two three"]] * 2 + [["beta x"]] * 2 + [["c"]] * 5
    m = basket.mine(_orders(spark, bs), "transaction_id", min_support=0.1, min_lift=1.0)
    e, n = basket.graph(m.rules, 5)
    assert [(r["src"], r["dst"]) for r in e.collect()] == [("alpha one two", "beta x")]
    nodes = {r["node"]: (r["full_name"], r["degree"]) for r in n.collect()}
    assert nodes["alpha one two"] == ("alpha one two three", 1)


def _daily(spark, values, start=dt.date(2024, 1, 1)):
    rows = [(start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "period date, total_value double")


def test_short_history(spark):
    with pytest.raises(trend.ShortHistoryError):
        forecast.train(_daily(spark, range(1, 14)))


def test_features_and_linear_model(spark):
    vals = [100 + 3 * i + (7 if i % 7 == 5 else 0) for i in range(60)]
    daily = _daily(spark, vals)
    f = forecast.features(daily).orderBy("period").collect()
    mean = sum(vals) / len(vals)
    assert f[0]["lag1"] == pytest.approx(mean) and f[7]["lag7"] == vals[0]
    assert f[3]["roll7"] == pytest.approx(sum(vals[:4]) / 4)
    assert f[0]["dow"] == 0 and f[5]["weekend"] == 1
    fm = forecast.train(daily, rf_trees=5, rf_depth=3, gbt_rounds=3, gbt_depth=2)
    lin = fm.models["Linear Regression"]
    k = forecast.split_point(60)
    X = np.array([[r[c] for c in forecast.FEATURES] for r in f[:k]])
    y = np.array(vals[:k], dtype=float)
    coef, *_ = np.linalg.lstsq(np.c_[X, np.ones(len(X))], y, rcond=None)
    pred_ours = np.array([lin.predict(Vectors.dense(x)) for x in X])
    assert np.allclose(pred_ours, np.c_[X, np.ones(len(X))] @ coef, rtol=1e-6, atol=1e-6)
    sc = {r["model"]: r for r in fm.scores.collect()}
    assert set(sc) == set(forecast.MODEL_NAMES) and fm.champion in sc


def test_recursive_forecast_linear_matches_manual(spark):
    vals = [50 + (i % 7) * 10 + i for i in range(40)]
    fm = forecast.train(_daily(spark, vals), rf_trees=3, rf_depth=2, gbt_rounds=2, gbt_depth=2)
    fc = forecast.recursive_forecast(fm, 5, model_name="Linear Regression").orderBy("step").collect()
    lin = fm.models["Linear Regression"]
    coef, icpt = np.array(lin.coefficients.toArray()), lin.intercept
    recent, last = [float(v) for v in vals[-30:]], dt.date(2024, 1, 1) + dt.timedelta(days=39)
    for i in range(1, 6):
        d = last + dt.timedelta(days=i)
        x = [39 + i, d.weekday(), d.month, 1 if d.weekday() >= 5 else 0, np.mean(recent[-7:]),
             np.mean(recent), recent[-1], recent[-7]]
        p = max(0.0, float(np.dot(coef, x) + icpt))
        assert fc[i - 1]["value"] == pytest.approx(p, rel=1e-9, abs=1e-6)
        recent = (recent + [p])[-30:]
    assert all(r["lower"] >= 0 and r["upper"] >= r["value"] for r in fc)


def test_stepwise_path_equals_predictions(spark):
    vals = [50 + (i % 7) * 10 + i for i in range(40)]
    fm = forecast.train(_daily(spark, vals), rf_trees=3, rf_depth=2, gbt_rounds=2, gbt_depth=2)
    name = "Random Forest"
    fc = [r["value"] for r in forecast.recursive_forecast(fm, 8, model_name=name).orderBy("step").collect()]
    recent = [float(v) for v in vals][-30:]
    day = dt.date(2024, 1, 1) + dt.timedelta(days=39)
    for i, got in enumerate(fc, 1):
        d = day + dt.timedelta(days=i)
        x = [39.0 + i, d.weekday(), d.month, float(d.weekday() > 4), np.mean(recent[-7:]), np.mean(recent), recent[-1], recent[-7]]
        want = max(0.0, fm.models[name].predict(Vectors.dense(x)))
        assert got == pytest.approx(want)
        recent = (recent + [want])[-30:]
    fm.release()


def test_two_series(spark):
    a = [100.0 + 2 * i for i in range(40)]
    b = [500.0 + 5 * (i % 7) for i in range(33)]
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for s, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)]
    daily = spark.createDataFrame(rows, "shop string, period date, total_value double")
    feats = {(r["shop"], int(r["day_index"])): r for r in forecast.features(daily, series="shop").collect()}
    assert len(feats) == 73 and feats["b", 0]["lag1"] == pytest.approx(np.mean(b)) and feats["a", 9]["lag7"] == a[2]
    fm = forecast.train(daily, series="shop", rf_trees=3, rf_depth=3, gbt_rounds=2, gbt_depth=2)
    assert {r["shop"]: r["n"] for r in fm.test.groupBy("shop").agg(F.count("*").alias("n")).collect()} == {"a": 8, "b": 7}
    for name in forecast.MODEL_NAMES[:2]:
        fc = forecast.recursive_forecast(fm, 4, model_name=name).collect()
        first = {r["shop"]: r["date"] for r in fc if r["step"] == 1}
        assert len(fc) == 8 and first == {"a": dt.date(2024, 2, 10), "b": dt.date(2024, 2, 3)}
        width = {r["shop"]: r["upper"] - r["value"] for r in fc}
        assert width["a"] == pytest.approx(0.4 * np.std(a, ddof=1)) and width["b"] == pytest.approx(0.4 * np.std(b, ddof=1))
    fm.release()


def test_growth_null_when_last30_zero(spark):
    vals = [10.0] * 20 + [0.0] * 30
    daily = _daily(spark, vals)
    fc = spark.createDataFrame([(1, dt.date(2024, 3, 1), 5.0)], "step int, date date, value double")
    k = forecast.forecast_kpis(fc, daily).first()
    assert k["last30_total"] == 0.0 and k["growth_pct"] is None


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("InvoiceDate,Description,Quantity,UnitPrice,InvoiceNo\n"
                               "2024-01-01,a,2,3,o1\n2024-01-02,b,x,3,o2\n")
    cols = ["InvoiceDate", "Description", "Quantity", "UnitPrice", "InvoiceNo"]
    out, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    q = ingest.start_ingest(ingest.clean_stream(spark, str(src), cols), out, checkpoint=ck)
    q.awaitTermination(120)
    (src / "b.csv").write_text("InvoiceDate,Description,Quantity,UnitPrice,InvoiceNo\n2024-01-03,c,1,5,o3\n")
    q = ingest.start_ingest(ingest.clean_stream(spark, str(src), cols), out, checkpoint=ck)
    q.awaitTermination(120)
    got = sorted(r["total_value"] for r in spark.read.parquet(out).collect())
    assert got == [5.0, 6.0]                    # the file of the first run is not read again
    assert os.path.isdir(ck)
    with pytest.raises(TypeError):
        ingest.start_ingest(ingest.clean_stream(spark, str(src), cols), out)      # a checkpoint must be named


def test_stream_ingest_after_restart(spark, tmp_path):
    """A new file lands when another session goes on with the checkpoint."""
    src, out, ck = tmp_path / "in3", str(tmp_path / "table3"), str(tmp_path / "ck3")
    src.mkdir()
    head = "InvoiceDate,Description,Quantity,UnitPrice\n"
    cols = ["InvoiceDate", "Description", "Quantity", "UnitPrice"]
    for k, session in enumerate((spark, spark.newSession())):
        (src / f"{k}.csv").write_text(head + f"2024-01-0{k + 1},a,1,{k + 1}\n")
        ingest.start_ingest(ingest.clean_stream(session, str(src), cols), out, checkpoint=ck).awaitTermination(120)
    assert sorted(r["total_value"] for r in spark.read.parquet(out).collect()) == [1.0, 2.0]


def test_stream_daily_revenue(spark, tmp_path):
    src = tmp_path / "in2"
    src.mkdir()
    (src / "a.csv").write_text("InvoiceDate,Description,Quantity,UnitPrice\n"
                               "2024-01-01 10:00,a,2,3\n2024-01-01 12:00,b,1,4\n2024-01-02,c,1,5\n")
    cols = ["InvoiceDate", "Description", "Quantity", "UnitPrice"]
    daily = ingest.daily_revenue_stream(ingest.clean_stream(spark, str(src), cols))
    q = (daily.writeStream.format("memory").queryName("daily_rev_test").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["period"]: r["total_value"] for r in spark.table("daily_rev_test").collect()}
    assert got == {dt.date(2024, 1, 1): 10.0, dt.date(2024, 1, 2): 5.0}


def test_itemsets_over_many_buckets(spark, monkeypatch):
    import random
    from itertools import combinations
    rnd = random.Random(5)
    bs = [rnd.sample("abcdefghijkl", rnd.randint(1, 7)) for _ in range(900)]
    pairs = basket.presence(_orders(spark, bs), "transaction_id")
    want = {}
    for b in bs:
        for k in (1, 2, 3):
            for c in combinations(sorted(set(b)), k):
                want[c] = want.get(c, 0) + 1
    for orders in (70, 1 << 14):
        monkeypatch.setattr(basket, "BUCKET_ORDERS", orders)
        got = {tuple(r["items"]): r["cnt"] for r in basket.frequent_itemsets(pairs, 900, 0.02).collect()}
        assert got == {c: n for c, n in want.items() if n >= 18}


def test_triples_move_no_pairs_of_bitmaps(spark):
    """Pairs are combined in their bucket: no shuffle by pair carries bitmaps."""
    bits = spark.createDataFrame([(b, i, [7 * b + k, 3]) for b in (0, 1) for k, i in enumerate("abcd")],
                                 "bucket int, item string, words array<bigint>").repartition("bucket")
    frequent = spark.createDataFrame([("a", "b", 4), ("a", "c", 4), ("b", "c", 4), ("c", "d", 4)], "x string, y string, cnt bigint")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = basket._triple_counts(bits, frequent)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    want = sum((x & y & z).bit_count() for b in (0, 1) for x, y, z in ((7 * b, 7 * b + 1, 7 * b + 2), (3, 3, 3)))
    assert rows == [("a", "b", "c", want)]
    assert not re.search(r"hashpartitioning\(x#\d+, y#\d+, \d+\)", plan)


def test_bitmaps_have_the_same_few_words(spark):
    """Whatever the number of orders, so that ANDs are compiled, not looped over; no order is lost."""
    n = 5000
    pairs = spark.range(n).select(F.col("id").cast("string").alias("order_id"), F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
                                                                                       .otherwise(F.array(F.lit("a")))).alias("item"))
    bits = basket.item_bitmaps(pairs, n).persist()
    got = bits.select("bucket", "item", F.size("words").alias("n"), F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w)).alias("k")).collect()
    assert {r["n"] for r in got} == {basket.WORDS} and len({(r["bucket"], r["item"]) for r in got}) == len(got) >= 4
    assert [sum(r["k"] for r in got if r["item"] == i) for i in "ab"] == [n, 1667]
    assert [tuple(r) for r in basket._pair_counts(bits).collect()] == [("a", "b", 1667)]
    bits.unpersist()
