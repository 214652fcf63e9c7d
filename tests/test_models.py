"""Node tables, models per series, and SQL that scores from stored tables."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tillroll.operators import forecast, forest, linear, trend
from tillroll.plans import report
from tillroll.sources.schema import MissingOrderKeyError

START = dt.date(2024, 1, 1)


def daily_df(spark, series: dict):
    rows = [(s, START + dt.timedelta(days=i), float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "shop string, period date, total_value double")


def wavy(n, seed=0):
    rng = np.random.default_rng(seed)
    return [200 + 2 * i + 60 * (i % 7 == 5) + 25 * np.sin(i / 9) + rng.normal(0, 15) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    fm = forecast.train(daily_df(spark, {"a": wavy(160)}).drop("shop"), rf_trees=12, rf_depth=6, gbt_rounds=15, gbt_depth=4)
    yield fm
    fm.release()


def test_nodes_predict_as_the_model(fitted):
    x = F.array(*forecast.FEATURES)
    for name in forecast.MODEL_NAMES[1:]:
        nodes, ensemble = fitted.forest(name)
        model = fitted.models[name]
        assert nodes.count() == model.totalNumNodes and nodes.select("tree").distinct().count() == len(model.trees)
        rows = (model.transform(fitted.test).crossJoin(F.broadcast(ensemble))
                .select("prediction", forest.predict(F.col("forest"), x).alias("ours")).collect())
        assert len(rows) == 32 and all(r["ours"] == pytest.approx(r["prediction"], rel=1e-12) for r in rows)


def test_recursion_walks_the_nodes(fitted):
    recent = [r["total_value"] for r in fitted.daily.orderBy("period").collect()][-30:]
    for name in forecast.MODEL_NAMES[1:]:
        values = list(recent)
        df = forecast.recursive_forecast(fitted, 9, model_name=name)
        assert "DecisionTree" not in df._jdf.queryExecution().optimizedPlan().toString()
        for r in df.orderBy("step").collect():
            day = START + dt.timedelta(days=159 + r["step"])
            x = [159.0 + r["step"], day.weekday(), day.month, float(day.weekday() > 4), np.mean(values[-7:]), np.mean(values),
                 values[-1], values[-7]]
            assert r["value"] == pytest.approx(fitted.models[name].predict(Vectors.dense(x)), rel=1e-9) and r["date"] == day
            values = (values + [r["value"]])[-30:]


SCORES = """
WITH RECURSIVE x AS (SELECT *, [day_index, dow, month, weekend, roll7, roll30, lag1, lag7] AS f FROM test),
walk AS (
  SELECT x.day_index, n.model, n.tree, n.weight, n.feature, n.threshold, n."left", n."right", n.prediction, x.f
  FROM x JOIN nodes AS n ON n.node = 0
  UNION ALL
  SELECT w.day_index, n.model, n.tree, n.weight, n.feature, n.threshold, n."left", n."right", n.prediction, w.f
  FROM walk AS w JOIN nodes AS n ON n.model = w.model AND n.tree = w.tree
    AND n.node = CASE WHEN w.f[w.feature + 1] <= w.threshold THEN w."left" ELSE w."right" END
  WHERE w.feature >= 0),
trees AS (SELECT model, day_index, CASE WHEN model = 'Random Forest' THEN avg(prediction) ELSE sum(prediction * weight) END AS p
  FROM walk WHERE feature < 0 GROUP BY model, day_index),
line AS (SELECT 'Linear Regression' AS model, day_index, (SELECT value FROM coefficients WHERE position = -1)
  + sum(c.value * x.f[c.position + 1]) AS p FROM x JOIN coefficients AS c ON c.position >= 0 GROUP BY day_index),
pred AS (SELECT model, day_index, y, greatest(p, 0) AS p FROM (SELECT * FROM trees UNION ALL SELECT * FROM line) JOIN x USING (day_index))
"""


def test_sql_scores_the_stored_tables(fitted, tmp_path):
    for name, df in {**fitted.tables(), "test": fitted.test.drop("features")}.items():
        df.write.parquet(f"{tmp_path}/{name}")
    con = duckdb.connect()
    for name in ("nodes", "coefficients", "test"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    got = {r["model"]: r for r in fitted.scores.collect()}
    for model, r2, mae, rmse, mape in con.sql(SCORES + """
        SELECT model, 1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), avg(abs(y - p)), sqrt(avg((y - p) ** 2)),
          avg(abs((y - p) / (y + 1e-8))) * 100 FROM pred GROUP BY model""").fetchall():
        r = got.pop(model)
        assert (r["r2"], r["mae"], r["rmse"], r["mape"]) == pytest.approx((r2, mae, rmse, mape), rel=1e-8)
    assert not got
    ours = sorted((r["day_index"], r["actual"], r["pred_0"], r["pred_1"], r["pred_2"]) for r in forecast.backtest(fitted).collect())
    names = ", ".join(f"max(p) FILTER (model = '{m}')" for m in forecast.MODEL_NAMES)
    theirs = con.sql(SCORES + f"SELECT day_index, max(y), {names} FROM pred GROUP BY day_index ORDER BY 1").fetchall()
    assert np.allclose(np.array(ours), np.array(theirs), rtol=1e-9)


def test_short_series_are_set_aside(spark):
    daily = daily_df(spark, {"a": wavy(60), "b": wavy(13, 1), "c": [5.0], "d": wavy(14, 2)})
    fm = forecast.train(daily, series="shop", rf_trees=2, rf_depth=2, gbt_rounds=2, gbt_depth=2)
    assert sorted((r["shop"], r["n_days"]) for r in fm.short.collect()) == [("b", 13), ("c", 1)]
    assert {r["shop"] for r in forecast.recursive_forecast(fm, 2).collect()} == {"a", "d"}
    fm.release()
    with pytest.raises(trend.ShortHistoryError):
        forecast.train(daily.where("shop in ('b', 'c')"), series="shop")
    sparse = daily.where("shop = 'a' AND (day(period) = 1 OR shop = 'x')")
    assert [r["n_days"] for r in trend.history_lengths(sparse, "shop").collect()] == [32]


def test_linear_models_per_series(spark):
    made = {"a": wavy(120), "b": wavy(75, 3), "c": [7.0] * 40, "d": [0.0] * 30 + wavy(20, 4), "e": wavy(13)}
    daily = daily_df(spark, made)
    models, short = forecast.series_linear(daily, "shop")
    assert [(r["shop"], r["n_days"]) for r in short.collect()] == [("e", 13)]
    got = {r["shop"]: r for r in models.collect()}
    assert set(got) == {"a", "b", "c", "d"}
    feats = {}
    for r in forecast.features(daily, series="shop").collect():
        feats.setdefault(r["shop"], []).append(r)
    for shop in "abd":
        rows = sorted(feats[shop], key=lambda r: r["day_index"])
        k = forecast.split_point(len(rows))
        x = np.array([[r[c] for c in forecast.FEATURES] + [1.0] for r in rows])
        y = np.array([r["y"] for r in rows])
        r = got[shop]
        ours = np.array([*r["coefficients"], r["intercept"]])
        best, *_ = np.linalg.lstsq(x[:k], y[:k], rcond=None)
        assert r["n_days"] == len(rows) and r["n_train"] == k
        assert np.allclose(x[:k] @ ours, x[:k] @ best, rtol=1e-6, atol=1e-6)
        if np.linalg.matrix_rank(x[:k]) == x.shape[1]:
            assert np.allclose(ours, best, rtol=1e-5, atol=1e-6)
        miss = y[k:] - np.maximum(x[k:] @ ours, 0)
        assert r["mae"] == pytest.approx(np.abs(miss).mean()) and r["rmse"] == pytest.approx(np.sqrt((miss ** 2).mean()))
        assert r["r2"] == pytest.approx(1 - (miss ** 2).sum() / ((y[k:] - y[k:].mean()) ** 2).sum())
    assert got["c"]["coefficients"] == [0.0] * 8 and got["c"]["intercept"] == 7.0 and got["c"]["r2"] is None
    path = {(r["shop"], r["step"]): r for r in forecast.series_forecast(daily, models, "shop", 3).collect()}
    assert len(path) == 12 and path["c", 3]["value"] == 7.0 and path["b", 1]["date"] == START + dt.timedelta(days=75)
    w, last = got["b"], made["b"][-30:]
    day = START + dt.timedelta(days=75)
    x = [75.0, day.weekday(), day.month, float(day.weekday() > 4), np.mean(last[-7:]), np.mean(last), last[-1], last[-7]]
    assert path["b", 1]["value"] == pytest.approx(max(0.0, float(np.dot(x, w["coefficients"]) + w["intercept"])))


def test_dependent_inputs_get_no_weight(spark):
    rng = np.random.default_rng(1)
    rows = [("k", float(a), float(2 * a + 1), 3.0, float(b), 5.0 + 2 * a - b) for a, b in rng.normal(size=(50, 2)).tolist()]
    df = spark.createDataFrame(rows, "g string, a double, twice double, same double, b double, y double")
    r = linear.fit(df, ["g"], ["a", "twice", "same", "b"], "y").first()
    assert r["coefficients"] == pytest.approx([2.0, 0.0, 0.0, -1.0]) and r["intercept"] == pytest.approx(5.0) and r["n_rows"] == 50


def test_report_shows_other_errors(spark):
    from helpers import sales_df
    sales = sales_df(spark, [("2024-01-01", "a", 1, 1, "o"), ("2024-01-02", "b", 1, 1, "o")])
    with pytest.raises(ValueError, match="max_len"):
        from tillroll.operators import basket
        basket.mine(sales, max_len=9)
    tables = report.report_tables(sales.drop("transaction_id"), include_forecast=False)
    assert "basket" not in tables and issubclass(MissingOrderKeyError, ValueError)
    with pytest.raises(Exception, match="no_such"):
        report.report_tables(sales, include_forecast=False, basket_item="no_such")
