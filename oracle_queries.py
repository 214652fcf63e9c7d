"""DuckDB SQL for the registered queries (the independent oracle).

Each statement runs on the driver's parquet views (lineitem, orders, part,
...) and builds the ``sales`` / ``raw_sales`` tables itself, so it shares
no code path with the Spark plans.
"""

from __future__ import annotations

from tillroll.plans.fixtures import CLEAN_RAW_SQL, DAY_FIRST_SQL, RAW_SALES_SQL, SALES_SQL

S = f"WITH {SALES_SQL}"
C = f"WITH {RAW_SALES_SQL}, {CLEAN_RAW_SQL}"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
DAY = "strftime({0}, '%Y-%m-%d')"

BASKET_ITEM = "p_brand"
BASKET_SUPPORT = 0.003
BASKET_LIFT = 1.2
MAX_RULES = 15


def _ts(c):
    return TS.format(c)


def _day(c):
    return DAY.format(c)


def _daily_cte(grain: str) -> str:
    if grain == "day":
        key, step, spine = ("CAST(order_date AS DATE)", "INTERVAL 1 DAY",
                            "CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE)")
    elif grain == "week":
        key, spine = ("CAST(date_trunc('week', order_date) AS DATE) + 6",
                      "CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE)")
    else:
        key, spine = ("last_day(CAST(order_date AS DATE))",
                      "last_day(CAST(unnest(generate_series(date_trunc('month', min(period)), "
                      "date_trunc('month', max(period)), INTERVAL 1 MONTH)) AS DATE))")
    return f"""{S},
agg AS (SELECT {key} AS period, sum(total_value) AS v FROM sales GROUP BY 1),
spine AS (SELECT {spine} AS period FROM agg),
series AS (SELECT spine.period, coalesce(agg.v, 0.0) AS total_value FROM spine LEFT JOIN agg USING (period))"""


#: Date layouts in the order in which ties are decided, with the DuckDB formats of those that a slash or ISO date can have.
LAYOUTS = (["yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy MM dd", "yyyyMMdd"]
           + ["MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "MM dd yyyy", "dd MM yyyy", "dd.MM.yyyy", "MM.dd.yyyy"]
           + ["MM/dd/yy", "dd/MM/yy", "MM-dd-yy", "dd-MM-yy", "MM dd yy", "dd MM yy", "dd.MM.yy", "MM.dd.yy"]
           + ["yyyy MMM dd", "MMM dd yyyy", "dd MMM yyyy", "MMM dd yy", "dd MMM yy"])
LAYOUT_READS = {"yyyy-MM-dd": "['%Y-%m-%d']", "MM/dd/yyyy": "['%m/%d/%Y', '%m/%d/%Y %H:%M']",
                "dd/MM/yyyy": "['%d/%m/%Y', '%d/%m/%Y %H:%M']"}


def _date_layouts() -> str:
    rows = ", ".join(f"({k}, '{n}', " + (f"(SELECT count(try_strptime(trim(InvoiceDate), {LAYOUT_READS[n]})) FROM raw_sales)"
                                         if n in LAYOUT_READS else "0") + ")" for k, n in enumerate(LAYOUTS))
    return f"""WITH {DAY_FIRST_SQL}, t AS (SELECT * FROM (VALUES {rows}) AS v(position, layout, parsed)),
won AS (SELECT position, row_number() OVER (ORDER BY parsed DESC, position) AS use FROM t
  WHERE parsed > 0 AND (layout <> 'MM/dd/yyyy' OR parsed >= (SELECT parsed FROM t WHERE layout = 'dd/MM/yyyy'))
    AND (layout <> 'dd/MM/yyyy' OR parsed > (SELECT parsed FROM t WHERE layout = 'MM/dd/yyyy')))
SELECT position, layout, parsed, (SELECT count(*) FILTER (trim(InvoiceDate) <> '') FROM raw_sales) AS filled, use::INTEGER AS use,
  layout IN ('MM/dd/yyyy', 'dd/MM/yyyy') AND parsed > 0 AND (SELECT count(DISTINCT parsed) FROM t WHERE layout IN ('MM/dd/yyyy', 'dd/MM/yyyy')) = 1 AS tied
FROM t LEFT JOIN won USING (position)"""


INPUTS = ["day_index", "dow", "month", "weekend", "roll7", "roll30", "lag1", "lag7"]


def _series_cte() -> str:
    """Linear models per brand: features, normal equations in standardised form, one elimination step per input."""
    n = len(INPUTS)
    v = f"[{', '.join(INPUTS)}, y]"
    steps = [f"""g0 AS (SELECT p_brand, i, j, CASE WHEN sd[i] > 0 AND sd[j] > 0 THEN c / sd[i] / sd[j] ELSE 0.0 END AS v
  FROM cov JOIN spread USING (p_brand) WHERE i <= {n})"""]
    for k in range(1, n + 1):
        steps.append(f"""g{k} AS (SELECT a.p_brand, a.i, a.j, CASE WHEN d.v <= 1e-9 THEN CASE WHEN a.i = {k} OR a.j = {k} THEN 0.0 ELSE a.v END
  WHEN a.i = {k} THEN a.v / d.v ELSE a.v - c.v * r.v / d.v END AS v
  FROM g{k - 1} AS a JOIN g{k - 1} AS d ON d.p_brand = a.p_brand AND d.i = {k} AND d.j = {k}
  JOIN g{k - 1} AS r ON r.p_brand = a.p_brand AND r.i = {k} AND r.j = a.j
  JOIN g{k - 1} AS c ON c.p_brand = a.p_brand AND c.i = a.i AND c.j = {k})""")
    return f"""{S.replace("WITH", "WITH RECURSIVE", 1)},
agg AS (SELECT p_brand, CAST(order_date AS DATE) AS period, sum(total_value) AS v FROM sales GROUP BY ALL),
ends AS (SELECT p_brand, min(period) AS a, max(period) AS b FROM agg GROUP BY 1),
spine AS (SELECT p_brand, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS period FROM ends WHERE b - a + 1 >= 14),
series AS (SELECT p_brand, period, coalesce(v, 0.0) AS total_value FROM spine LEFT JOIN agg USING (p_brand, period)),
f AS (SELECT p_brand, period, total_value AS y, count(*) OVER s AS n_days, CAST(row_number() OVER w - 1 AS DOUBLE) AS day_index,
  CAST(isodow(period) - 1 AS DOUBLE) AS dow, CAST(month(period) AS DOUBLE) AS month,
  CAST(CASE WHEN isodow(period) >= 6 THEN 1 ELSE 0 END AS DOUBLE) AS weekend,
  avg(total_value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll7,
  avg(total_value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS roll30,
  coalesce(lag(total_value, 1) OVER w, avg(total_value) OVER s) AS lag1, coalesce(lag(total_value, 7) OVER w, avg(total_value) OVER s) AS lag7
  FROM series WINDOW w AS (PARTITION BY p_brand ORDER BY period), s AS (PARTITION BY p_brand)),
train AS (SELECT p_brand, {v} AS x FROM f WHERE day_index < floor(n_days * 0.8)),
cells AS (SELECT p_brand, x, unnest(range(1, {n + 2})) AS i FROM train),
means AS (SELECT p_brand, i, avg(x[i]) AS m FROM cells GROUP BY ALL),
mean AS (SELECT p_brand, list(m ORDER BY i) AS m FROM means GROUP BY 1),
crossed AS (SELECT p_brand, x, i, unnest(range(1, {n + 2})) AS j FROM cells),
cov AS (SELECT p_brand, i, j, covar_pop(x[i], x[j]) AS c FROM crossed GROUP BY ALL),
spread AS (SELECT p_brand, list(sqrt(c) ORDER BY i) AS sd FROM cov WHERE i = j GROUP BY 1),
{", ".join(steps)},
slopes AS (SELECT p_brand, list(CASE WHEN sd[i] > 0 THEN v * sd[{n + 1}] / sd[i] ELSE 0.0 END ORDER BY i) AS w
  FROM g{n} JOIN spread USING (p_brand) WHERE j = {n + 1} GROUP BY 1),
models AS (SELECT p_brand, w, m[{n + 1}] - list_sum(list_transform(range(1, {n + 1}), lambda i: w[i] * m[i])) AS b
  FROM slopes JOIN mean USING (p_brand)),
tested AS (SELECT p_brand, day_index, period, y, n_days,
  greatest(b + list_sum(list_transform(range(1, {n + 1}), lambda i: w[i] * {v}[i])), 0.0) AS p
  FROM f JOIN models USING (p_brand) WHERE day_index >= floor(n_days * 0.8))"""


def _rollup_cte() -> str:
    return f"""{S},
per AS (SELECT product_name AS product, sum(total_value) AS revenue, sum(quantity) AS quantity,
               avg(unit_price) AS avg_price
        FROM sales WHERE product_name IS NOT NULL GROUP BY 1),
roll AS (SELECT *, revenue / (SELECT sum(revenue) FROM per) * 100 AS revenue_pct FROM per)"""


def _cum_cte() -> str:
    return f"""{_rollup_cte()},
cum AS (SELECT product, revenue,
               row_number() OVER (ORDER BY revenue DESC, product ASC) AS position,
               sum(revenue) OVER (ORDER BY revenue DESC, product ASC
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_revenue
        FROM roll),
cum2 AS (SELECT *, cum_revenue / (SELECT sum(revenue) FROM roll) AS cum_pct FROM cum),
abc AS (SELECT *, CASE WHEN cum_pct <= 0.8 THEN 'A-Grade (Top 80% of Revenue)'
                       WHEN cum_pct <= 0.95 THEN 'B-Grade (Next 15% of Revenue)'
                       ELSE 'C-Grade (Bottom 5% of Revenue)' END AS category FROM cum2)"""


def _plain_money(x, digits=2):
    return f"'£' || format('{{:.{digits}f}}', {x})"


def _money(x, digits=2):
    return f"'£' || format('{{:,.{digits}f}}', {x})"


def _basket_cte(item=BASKET_ITEM, support=BASKET_SUPPORT, lift=BASKET_LIFT) -> str:
    s = f"CAST({support!r} AS DOUBLE)"
    return f"""{S},
pr AS (SELECT transaction_id AS order_id, {item} AS item FROM sales
       WHERE transaction_id IS NOT NULL AND {item} IS NOT NULL GROUP BY 1, 2 HAVING sum(quantity) > 0),
nn AS (SELECT CAST(count(DISTINCT transaction_id) AS DOUBLE) AS n FROM sales
       WHERE transaction_id IS NOT NULL AND {item} IS NOT NULL),
ic AS (SELECT item, count(*) AS cnt FROM pr GROUP BY item),
ic2 AS (SELECT item, cnt, cnt / n AS support,
               cnt >= greatest(1, floor(n * 0.005)) AS kept,
               cnt >= greatest(1, floor(n * 0.005)) AND cnt / n >= {s} AS frequent
        FROM ic, nn),
f1 AS (SELECT item, cnt FROM ic2 WHERE frequent AND (SELECT count(*) FROM ic2 WHERE kept) >= 2),
tf AS (SELECT * FROM pr WHERE item IN (SELECT item FROM f1)),
o2 AS (SELECT a.order_id, a.item AS x, b.item AS y FROM tf a JOIN tf b
       ON a.order_id = b.order_id AND a.item < b.item),
l2 AS (SELECT x, y, count(*) AS cnt FROM o2 GROUP BY x, y
       HAVING count(*) / (SELECT n FROM nn) >= {s}),
o2f AS (SELECT o2.* FROM o2 JOIN l2 USING (x, y)),
l3 AS (SELECT p.x, p.y, q.y AS z, count(*) AS cnt
       FROM o2f p JOIN o2f q ON p.order_id = q.order_id AND p.x = q.x AND p.y < q.y
       JOIN l2 yz ON yz.x = p.y AND yz.y = q.y
       GROUP BY 1, 2, 3 HAVING count(*) / (SELECT n FROM nn) >= {s}),
sets AS (SELECT [item] AS items, 1 AS n_items, cnt FROM f1
         UNION ALL SELECT [x, y], 2, cnt FROM l2
         UNION ALL SELECT [x, y, z], 3, cnt FROM l3),
sup AS (SELECT items, n_items, cnt, cnt / n AS support FROM sets, nn),
splits AS (
  SELECT [items[1]] AS ante, [items[2]] AS cons, support FROM sup WHERE n_items = 2
  UNION ALL SELECT [items[2]], [items[1]], support FROM sup WHERE n_items = 2
  UNION ALL SELECT [items[1]], [items[2], items[3]], support FROM sup WHERE n_items = 3
  UNION ALL SELECT [items[2]], [items[1], items[3]], support FROM sup WHERE n_items = 3
  UNION ALL SELECT [items[3]], [items[1], items[2]], support FROM sup WHERE n_items = 3
  UNION ALL SELECT [items[1], items[2]], [items[3]], support FROM sup WHERE n_items = 3
  UNION ALL SELECT [items[1], items[3]], [items[2]], support FROM sup WHERE n_items = 3
  UNION ALL SELECT [items[2], items[3]], [items[1]], support FROM sup WHERE n_items = 3),
r1 AS (SELECT sp.ante, sp.cons, a.support AS antecedent_support, c.support AS consequent_support,
              sp.support, sp.support / a.support AS confidence
       FROM splits sp JOIN sup a ON a.items = sp.ante JOIN sup c ON c.items = sp.cons),
rules AS (SELECT array_to_string(ante, ', ') AS antecedents, array_to_string(cons, ', ') AS consequents,
                 ante, cons, antecedent_support, consequent_support, support, confidence,
                 confidence / consequent_support AS lift,
                 support - antecedent_support * consequent_support AS leverage,
                 CASE WHEN 1 - confidence = 0 THEN NULL
                      ELSE (1 - consequent_support) / (1 - confidence) END AS conviction
          FROM r1 WHERE confidence / consequent_support >= CAST({lift!r} AS DOUBLE))"""


RULE_ORDER = "lift DESC, support DESC, antecedents ASC, consequents ASC"


def _top_rules(n: int) -> str:
    return (f"top AS (SELECT row_number() OVER (ORDER BY {RULE_ORDER}) AS rank, * FROM rules "
            f"ORDER BY {RULE_ORDER} LIMIT {n})")


def _r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _describe_sql() -> str:
    num = ["quantity", "unit_price", "total_value"]
    parts = []
    # order_date first (column position 0), numbers after, as in the clean table
    cols = [("order_date", 0, True), ("quantity", 2, False), ("unit_price", 3, False),
            ("total_value", 6, False)]
    pos_of = {}
    for i, (c, _, _) in enumerate(cols):
        pos_of[c] = i
    for c, _, is_time in cols:
        i = pos_of[c]
        x = f"CAST(epoch_us({c}) AS DOUBLE)" if is_time else c
        stats = [("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", f"avg({x})"),
                 ("std", "NULL" if is_time else f"stddev_samp({x})"), ("min", f"min({x})"),
                 ("25%", f"quantile_cont({x}, 0.25)"), ("50%", f"quantile_cont({x}, 0.5)"),
                 ("75%", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})")]
        for k, (name, e) in enumerate(stats):
            if is_time and name != "count":
                val = "CAST(NULL AS DOUBLE)"
                vt = (f"strftime(make_timestamp(CAST(round({e}) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"
                      if e != "NULL" else "CAST(NULL AS VARCHAR)")
            else:
                val = f"round({e}, 2)"
                vt = "CAST(NULL AS VARCHAR)"
            src = "(SELECT 1) one" if e == "NULL" else "clean_raw"
            parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", {k} AS stat_pos, '{name}' AS statistic, "
                         f"{val} AS value, {vt} AS value_time FROM {src}")
    del num
    return C + "\n" + "\nUNION ALL ".join(parts)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["source_shape"] = (f"WITH {RAW_SALES_SQL} SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns "
                         "FROM raw_sales")
    cols = (f"{_ts('order_date')} AS order_date, product_name, quantity, unit_price, transaction_id, "
            "customer_id, total_value")
    raw_cols = ["InvoiceDate", "Description", "Quantity", "UnitPrice", "InvoiceNo", "CustomerID", "ExtraCol"]
    q["preview_raw"] = (f"WITH {RAW_SALES_SQL} SELECT * FROM raw_sales ORDER BY "
                        + ", ".join(f"{c} NULLS FIRST" for c in raw_cols) + " LIMIT 10")
    q["clean_sales"] = f"{C} SELECT {cols} FROM clean_raw"
    q["clean_day_first"] = f"WITH {DAY_FIRST_SQL} SELECT {cols} FROM clean_raw"
    q["date_layouts"] = _date_layouts()
    q["preview_clean"] = (f"{C} SELECT {cols} FROM clean_raw ORDER BY order_date NULLS FIRST, "
                          "product_name NULLS FIRST, quantity NULLS FIRST, unit_price NULLS FIRST, "
                          "transaction_id NULLS FIRST, customer_id NULLS FIRST, total_value NULLS FIRST LIMIT 20")
    q["kpi_headline"] = (f"{S} SELECT round(coalesce(sum(total_value), 0.0), 2) AS revenue, count(*) AS orders, "
                         "count(DISTINCT product_name) AS products, "
                         "round(coalesce(sum(total_value), 0.0) / count(*), 4) AS avg_order FROM sales")
    q["kpi_metrics"] = (f"{S} SELECT count(*) AS total_rows, "
                        "CAST(floor((epoch_us(max(order_date)) - epoch_us(min(order_date))) / 86400000000) AS BIGINT)"
                        " AS date_range_days, count(DISTINCT product_name) AS unique_products, "
                        "round(sum(total_value), 2) AS total_revenue, round(avg(total_value), 4) AS avg_order_value, "
                        f"{_ts('min(order_date)')} AS min_date, {_ts('max(order_date)')} AS max_date, "
                        "count(DISTINCT transaction_id) AS unique_transactions, "
                        "count(DISTINCT customer_id) AS unique_customers FROM sales")
    q["load_status"] = (f"{C} SELECT count(*) AS records, {_ts('min(order_date)')} AS first_date, "
                        f"{_ts('max(order_date)')} AS last_date FROM clean_raw")
    q["report_summary"] = f"""{S},
k AS (SELECT sum(total_value) AS rev, count(*) AS n, avg(total_value) AS mean,
             count(DISTINCT product_name) AS prods FROM sales)
SELECT 1 AS pos, 'Total Revenue' AS metric, round(rev, 2) AS value, {_money('rev')} AS display FROM k
UNION ALL SELECT 2, 'Total Orders', CAST(n AS DOUBLE), format('{{:,}}', n) FROM k
UNION ALL SELECT 3, 'Average Order Value', round(mean, 2), {_plain_money('mean')} FROM k
UNION ALL SELECT 4, 'Unique Products Sold', CAST(prods AS DOUBLE), format('{{:,}}', prods) FROM k"""
    prof = [("order_date", "timestamp_ntz"), ("product_name", "string"), ("quantity", "double"),
            ("unit_price", "double"), ("transaction_id", "string"), ("customer_id", "string"),
            ("total_value", "double")]
    q["profile_columns"] = C + "\n" + "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM clean_raw"
        for i, (c, t) in enumerate(prof))
    q["profile_describe"] = _describe_sql()
    for grain, name in (("day", "revenue_daily"), ("week", "revenue_weekly"), ("month", "revenue_monthly")):
        q[name] = (f"{_daily_cte(grain)} SELECT {_day('period')} AS period, round(total_value, 2) AS total_value "
                   "FROM series")
    q["revenue_by_date"] = (f"{S} SELECT {_day('CAST(order_date AS DATE)')} AS order_day, "
                            "round(sum(total_value), 2) AS total_value FROM sales GROUP BY 1")
    q["revenue_by_weekday"] = f"""{S},
days AS (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
                                (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) t(weekday, day)),
w AS (SELECT dayname(order_date) AS day, sum(total_value) AS v FROM sales GROUP BY 1)
SELECT weekday, day, round(coalesce(v, 0.0), 2) AS total_value FROM days LEFT JOIN w USING (day)"""
    q["revenue_by_month"] = (f"{S} SELECT strftime(order_date, '%Y-%m') AS month, "
                             "round(sum(total_value), 2) AS total_value FROM sales GROUP BY 1")
    q["weekday_best_worst"] = f"""{S},
w AS (SELECT dayname(order_date) AS day, sum(total_value) AS v FROM sales GROUP BY 1),
b AS (SELECT day, v FROM w ORDER BY v DESC, day ASC LIMIT 1),
x AS (SELECT day, v FROM w ORDER BY v ASC, day DESC LIMIT 1)
SELECT b.day AS best_day, round(b.v, 2) AS best_revenue, x.day AS worst_day, round(x.v, 2) AS worst_revenue
FROM b, x"""
    q["revenue_last_n"] = (f"{_daily_cte('day')} SELECT {_day('period')} AS period, "
                           "round(total_value, 2) AS total_value FROM series ORDER BY period DESC LIMIT 60")
    q["revenue_last30_sum"] = (f"{_daily_cte('day')} SELECT round(coalesce(sum(total_value), 0.0), 2) AS last30_sum "
                               "FROM (SELECT total_value FROM series ORDER BY period DESC LIMIT 30) t")
    q["revenue_ma7"] = f"""{_daily_cte('day')}
SELECT {_day('period')} AS period, round(total_value, 2) AS total_value,
       round(CASE WHEN count(*) OVER w = 7 AND count(*) OVER () > 7 THEN avg(total_value) OVER w END, 4) AS ma7
FROM series WINDOW w AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
    q["product_rollup"] = (f"{_rollup_cte()} SELECT product, round(revenue, 2) AS revenue, "
                           "round(quantity, 2) AS quantity, round(avg_price, 6) AS avg_price, "
                           "round(revenue_pct, 6) AS revenue_pct FROM roll")
    q["product_headline"] = (f"{_rollup_cte()} SELECT substr(product, 1, 25) || '...' AS top_product, "
                             "round(revenue, 2) AS top_revenue, round(revenue_pct, 6) AS top_share, "
                             f"{_money('revenue', 0)} AS revenue_text, format('{{:,.1f}}', revenue_pct) || '%' AS share_text "
                             "FROM roll ORDER BY revenue DESC, product ASC LIMIT 1")
    q["product_top_n"] = f"""{_rollup_cte()}
SELECT row_number() OVER (ORDER BY revenue DESC, product ASC) AS rank, product, round(revenue, 2) AS revenue,
       round(quantity, 2) AS quantity, round(avg_price, 6) AS avg_price, round(revenue_pct, 6) AS revenue_pct,
       {_money('revenue')} AS revenue_text, format('{{:,.0f}}', quantity) AS quantity_text,
       {_plain_money('avg_price')} AS avg_price_text, format('{{:,.1f}}', revenue_pct) || '%' AS revenue_pct_text
FROM roll ORDER BY revenue DESC, product ASC LIMIT 10"""
    q["product_top10"] = f"""{_rollup_cte()},
t AS (SELECT product, revenue FROM roll ORDER BY revenue DESC, product ASC LIMIT 10)
SELECT row_number() OVER (ORDER BY revenue ASC, product DESC) AS position, product, round(revenue, 2) AS revenue
FROM t"""
    for name, measure, n, asc in (("product_top5_revenue", "total_value", 5, False),
                                  ("product_top5_volume", "quantity", 5, False),
                                  ("product_bottom3", "total_value", 3, True)):
        direction = "ASC" if asc else "DESC"
        q[name] = f"""{S},
t AS (SELECT product_name AS product, sum({measure}) AS value FROM sales WHERE product_name IS NOT NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY value {direction}, product ASC) AS rank, product, round(value, 2) AS value
FROM t ORDER BY value {direction}, product ASC LIMIT {n}"""
    q["report_top_products"] = f"""{S},
t AS (SELECT product_name AS product, sum(total_value) AS value FROM sales WHERE product_name IS NOT NULL GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY value DESC, product ASC) AS rank, product, value
      FROM t ORDER BY value DESC, product ASC LIMIT 10)
SELECT rank, CASE WHEN length(product) > 40 THEN substr(product, 1, 40) || '...' ELSE product END AS product,
       round(value, 2) AS revenue, {_money('value')} AS revenue_text FROM k"""
    q["product_abc"] = (f"{_cum_cte()} SELECT position, product, round(revenue, 2) AS revenue, "
                        "round(cum_revenue, 2) AS cum_revenue, round(cum_pct, 6) AS cum_pct, category, "
                        f"{_money('revenue')} AS revenue_text FROM abc")
    q["product_abc_summary"] = f"""{_cum_cte()},
classes AS (SELECT * FROM (VALUES (0, 'A-Grade (Top 80% of Revenue)'), (1, 'B-Grade (Next 15% of Revenue)'),
                                  (2, 'C-Grade (Bottom 5% of Revenue)')) t(class_pos, category)),
cls AS (SELECT category, count(*) AS items, sum(revenue) AS revenue FROM abc GROUP BY 1)
SELECT class_pos, category, coalesce(items, 0) AS items, round(coalesce(revenue, 0.0), 2) AS revenue
FROM classes LEFT JOIN cls USING (category)"""
    q["product_pareto"] = f"""{_cum_cte()}
SELECT count(*) FILTER (WHERE cum_pct * 100 <= 80) AS n_80, count(*) AS n_products,
       round(count(*) FILTER (WHERE cum_pct * 100 <= 80) / count(*) * 100, 4) AS pct_products FROM abc"""
    q["product_pareto_curve"] = f"""{_cum_cte()}
SELECT position - 1 AS position, product, round(revenue, 2) AS revenue, round(cum_pct * 100, 4) AS cum_pct
FROM abc WHERE position <= 100"""
    q["product_search"] = (f"{_rollup_cte()} SELECT product, round(revenue, 2) AS revenue, "
                           "round(quantity, 2) AS quantity, round(avg_price, 6) AS avg_price, "
                           "round(revenue_pct, 6) AS revenue_pct FROM roll "
                           "WHERE regexp_matches(product, '(?i)RED |gizmo')")
    q["basket_items"] = (f"{S} SELECT transaction_id AS order_id, product_name AS item FROM sales "
                         "WHERE transaction_id IS NOT NULL AND product_name IS NOT NULL "
                         "GROUP BY 1, 2 HAVING sum(quantity) > 0")
    b = _basket_cte()
    q["basket_frequent_items"] = (f"{b} SELECT item, cnt, round(support, 6) AS support, kept, frequent "
                                  "FROM ic2")
    q["basket_itemsets"] = (f"{b} SELECT array_to_string(items, ', ') AS items, n_items, cnt, "
                            "round(support, 6) AS support FROM sup")
    nums = ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage",
            "conviction"]
    q["basket_rules"] = f"{b} SELECT antecedents, consequents, {_r6(nums)} FROM rules"
    q["basket_summary"] = (f"{b} SELECT count(*) AS n_rules, round(max(lift), 6) AS max_lift, "
                           "round(max(confidence), 6) AS max_confidence FROM rules")
    q["basket_summary_default"] = (f"{_basket_cte('product_name', 0.02, 1.2)} SELECT count(*) AS n_rules, "
                                   "round(max(lift), 6) AS max_lift, round(max(confidence), 6) AS max_confidence "
                                   "FROM rules")
    q["basket_cross_sell"] = f"""{b}, {_top_rules(5)}
SELECT rank, antecedents, consequents, round(lift, 6) AS lift, round(confidence, 6) AS confidence,
       format('{{:,.1f}}', lift) AS lift_text, format('{{:,.0f}}', confidence * 100) || '%' AS confidence_text
FROM top"""
    q["basket_rule_table"] = f"""{b}, {_top_rules(MAX_RULES)}
SELECT rank, antecedents AS antecedent, consequents AS consequent, round(support, 6) AS support,
       round(confidence, 6) AS confidence, round(lift, 6) AS lift, format('{{:,.3f}}', support) AS support_text,
       format('{{:,.1f}}', confidence * 100) || '%' AS confidence_text, format('{{:,.2f}}', lift) AS lift_text
FROM top"""
    ends = f"""{b}, {_top_rules(MAX_RULES)},
e0 AS (SELECT rank, list_min(ante) AS a_full, list_min(cons) AS c_full, lift FROM top),
e1 AS (SELECT *, array_to_string(list_slice(string_split_regex(trim(a_full), '\\s+'), 1, 3), ' ') AS a,
                 array_to_string(list_slice(string_split_regex(trim(c_full), '\\s+'), 1, 3), ' ') AS c FROM e0),
edges AS (SELECT least(a, c) AS src, greatest(a, c) AS dst, arg_max(lift, rank) AS weight FROM e1 GROUP BY 1, 2)"""
    q["basket_graph_edges"] = f"{ends} SELECT src, dst, round(weight, 6) AS weight FROM edges"
    q["basket_graph_nodes"] = f"""{ends},
seen AS (SELECT a AS node, a_full AS full_name, rank * 2 AS k FROM e1
         UNION ALL SELECT c, c_full, rank * 2 + 1 FROM e1),
names AS (SELECT node, arg_max(full_name, k) AS full_name FROM seen GROUP BY 1),
deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges)
        GROUP BY 1)
SELECT node, full_name, degree FROM names JOIN deg USING (node)"""
    q["report_basket"] = f"""{b}, {_top_rules(10)}
SELECT rank, substr(antecedents, 1, 30) AS antecedent, substr(consequents, 1, 30) AS consequent,
       round(lift, 6) AS lift, format('{{:,.1f}}', lift) || 'x' AS lift_text FROM top"""
    feats = f"""{_daily_cte('day')},
f AS (SELECT period, total_value AS y,
             CAST(row_number() OVER w - 1 AS DOUBLE) AS day_index,
             CAST(isodow(period) - 1 AS DOUBLE) AS dow, CAST(month(period) AS DOUBLE) AS month,
             CAST(CASE WHEN isodow(period) - 1 IN (5, 6) THEN 1 ELSE 0 END AS DOUBLE) AS weekend,
             avg(total_value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll7,
             avg(total_value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS roll30,
             coalesce(lag(total_value, 1) OVER w, (SELECT avg(total_value) FROM series)) AS lag1,
             coalesce(lag(total_value, 7) OVER w, (SELECT avg(total_value) FROM series)) AS lag7
      FROM series WINDOW w AS (ORDER BY period))"""
    q["forecast_features"] = (f"{feats} SELECT {_day('period')} AS period, round(y, 2) AS y, day_index, dow, "
                              "month, weekend, round(roll7, 6) AS roll7, round(roll30, 6) AS roll30, "
                              "round(lag1, 6) AS lag1, round(lag7, 6) AS lag7 FROM f")
    q["forecast_split"] = f"""{feats},
k AS (SELECT floor(count(*) * 0.8) AS k FROM f)
SELECT CASE WHEN day_index < k THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows,
       {_day('min(period)')} AS first_day, {_day('max(period)')} AS last_day
FROM f, k GROUP BY 1"""
    q["forecast_band"] = (f"{_daily_cte('day')} SELECT round(stddev_samp(total_value) * 0.4, 2) AS band, "
                          f"{_day('max(period) + 1')} AS first_day, {_day('max(period) + 30')} AS last_day FROM series")
    q["forecast_lag7_scores"] = f"""{feats},
t AS (SELECT y, greatest(lag7, 0.0) AS p FROM f WHERE day_index >= (SELECT floor(count(*) * 0.8) FROM f))
SELECT round(sum((y - p) * (y - p)), 0) AS sse, round(avg(y), 2) AS ybar, round(avg(abs(y - p)), 2) AS mae,
       round(sqrt(avg((y - p) * (y - p))), 2) AS rmse FROM t"""
    q["forecast_actuals"] = f"""{feats}
SELECT day_index, {_day('period')} AS period, round(y, 2) AS y FROM f
WHERE day_index >= (SELECT floor(count(*) * 0.8) FROM f)"""
    ols = _series_cte()
    weights = ", ".join(f"round(any_value(w)[{i}], 4) AS w_{c}" for i, c in enumerate(INPUTS, 1))
    q["forecast_series_models"] = f"""{ols}
SELECT p_brand, any_value(n_days) AS n_days, any_value(n_days) - count(*) AS n_train, round(any_value(b), 2) AS intercept, {weights},
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 2) AS mae,
  round(sqrt(avg((y - p) * (y - p))), 2) AS rmse FROM tested JOIN models USING (p_brand) GROUP BY p_brand"""
    q["forecast_series_backtest"] = f"""{ols}
SELECT p_brand, day_index, {_day('period')} AS period, round(y, 2) AS actual, round(p, 2) AS pred FROM tested"""
    q["forecast_series_30d"] = f"""{ols},
hist AS (SELECT p_brand, max(period) AS last, count(*) AS n, stddev_samp(total_value) * 0.4 AS band,
  list(total_value ORDER BY period)[-30:] AS recent FROM series GROUP BY 1),
path AS (SELECT p_brand, 0 AS step, recent, CAST(NULL AS DOUBLE) AS value FROM hist
  UNION ALL
  SELECT p_brand, step + 1, list_append(recent, v)[-30:], v FROM (
    SELECT p_brand, step, recent, greatest(b + w[1] * (n + step) + w[2] * (isodow(last + step + 1) - 1) + w[3] * month(last + step + 1)
      + w[4] * CASE WHEN isodow(last + step + 1) >= 6 THEN 1 ELSE 0 END + w[5] * list_avg(recent[-7:]) + w[6] * list_avg(recent)
      + w[7] * recent[-1] + w[8] * recent[-7], 0.0) AS v
    FROM path JOIN models USING (p_brand) JOIN (SELECT p_brand, last, n FROM hist) AS h USING (p_brand) WHERE step < 30) AS one)
SELECT p_brand, step, {_day('last + step')} AS date, round(value, 2) AS value, round(greatest(value - band, 0), 2) AS lower,
  round(value + band, 2) AS upper FROM path JOIN hist USING (p_brand) WHERE step > 0"""
    q["forecast_short_series"] = f"""{S}
SELECT customer_id, max(CAST(order_date AS DATE)) - min(CAST(order_date AS DATE)) + 1 AS n_days,
  {_day('min(order_date)')} AS first_day, {_day('max(order_date)')} AS last_day
FROM sales GROUP BY 1 HAVING max(CAST(order_date AS DATE)) - min(CAST(order_date AS DATE)) + 1 < 14"""
    q["report_all"] = f"""{b}, {_top_rules(10)},
named AS (SELECT count(DISTINCT product_name) AS n FROM sales)
SELECT 'summary' AS "table", 4::BIGINT AS "rows" UNION ALL SELECT 'daily', count(DISTINCT CAST(order_date AS DATE)) FROM sales
UNION ALL SELECT 'top5', least(n, 5) FROM named UNION ALL SELECT 'top_products', least(n, 10) FROM named
UNION ALL SELECT 'basket', count(*) FROM top UNION ALL SELECT 'models', 3"""
    n2 = "format('{:,.2f}', %s)"
    q["report_contents"] = f"""{b}, {_top_rules(10)},
k AS (SELECT sum(total_value) AS rev, count(*) AS n, avg(total_value) AS mean, count(DISTINCT product_name) AS prods FROM sales),
dd AS (SELECT strftime(order_date, '%Y-%m-%d') AS d, sum(total_value) AS v FROM sales GROUP BY 1),
pv AS (SELECT product_name AS p, sum(total_value) AS v FROM sales WHERE product_name IS NOT NULL GROUP BY 1),
pr10 AS (SELECT row_number() OVER (ORDER BY v DESC, p ASC) AS r, p, v FROM pv ORDER BY v DESC, p ASC LIMIT 10),
c AS (SELECT 'summary' AS t, '1' AS r, ['metric', 'display'] AS cs, ['Total Revenue', {_money('rev')}] AS ts FROM k
UNION ALL SELECT 'summary', '2', ['metric', 'display'], ['Total Orders', format('{{:,}}', n)] FROM k
UNION ALL SELECT 'summary', '3', ['metric', 'display'], ['Average Order Value', {_plain_money('mean')}] FROM k
UNION ALL SELECT 'summary', '4', ['metric', 'display'], ['Unique Products Sold', format('{{:,}}', prods)] FROM k
UNION ALL SELECT 'daily', d, ['order_day', 'total_value'], [d, {n2 % 'v'}] FROM dd
UNION ALL SELECT 'top5', CAST(r AS VARCHAR), ['product', 'value'], [p, {n2 % 'v'}] FROM pr10 WHERE r <= 5
UNION ALL SELECT 'top_products', CAST(r AS VARCHAR), ['product', 'revenue_text'],
    [CASE WHEN length(p) > 40 THEN substr(p, 1, 40) || '...' ELSE p END, {_money('v')}] FROM pr10
UNION ALL SELECT 'basket', CAST(rank AS VARCHAR), ['antecedent', 'consequent', 'lift_text'],
    [substr(antecedents, 1, 30), substr(consequents, 1, 30), format('{{:,.1f}}', lift) || 'x'] FROM top)
SELECT t AS "table", r AS "row", unnest(cs) AS "column", unnest(ts) AS text FROM c"""
    cleaned = f"{C}, sales AS (SELECT * FROM clean_raw)"
    for name, base in (("clean_product_rollup", "product_rollup"), ("clean_product_abc", "product_abc"),
                       ("clean_revenue_daily", "revenue_daily")):
        q[name] = q[base].replace(S, cleaned, 1)
    word = "split_part(product_name, ' ', 1)"
    q["clean_basket_itemsets"] = (_basket_cte(word).replace(S, cleaned, 1)
                                  + " SELECT array_to_string(items, ', ') AS items, n_items, cnt, round(support, 6) AS support FROM sup")
    q["business_brief"] = f"""{S},
k AS (SELECT coalesce(sum(total_value), 0.0) AS rev, count(*) AS n, min(order_date) AS d0,
             max(order_date) AS d1 FROM sales),
w AS (SELECT dayname(order_date) AS day, sum(total_value) AS v FROM sales GROUP BY 1),
wr AS (SELECT row_number() OVER (ORDER BY v DESC, day ASC) AS rank, day, v FROM w),
pv AS (SELECT product_name AS product, sum(total_value) AS v, sum(quantity) AS q FROM sales
       WHERE product_name IS NOT NULL GROUP BY 1)
SELECT 'kpi' AS section, 1 AS rank, 'Total Revenue' AS label, round(rev, 2) AS value,
       CAST(NULL AS VARCHAR) AS text FROM k
UNION ALL SELECT 'kpi', 2, 'Total Orders', CAST(n AS DOUBLE), NULL FROM k
UNION ALL SELECT 'kpi', 3, 'Average Order Value', round(coalesce(rev / n, 0.0), 2), NULL FROM k
UNION ALL SELECT 'dates', 1, 'first', NULL, {_day('d0')} FROM k
UNION ALL SELECT 'dates', 2, 'last', NULL, {_day('d1')} FROM k
UNION ALL SELECT 'weekday', rank, day, round(v, 2), NULL FROM wr
UNION ALL SELECT 'best_day', 1, day, round(v, 2), NULL FROM wr WHERE rank = 1
UNION ALL SELECT 'worst_day', 1, day, round(v, 2), NULL FROM wr WHERE rank = (SELECT max(rank) FROM wr)
UNION ALL SELECT * FROM (SELECT 'top_revenue', row_number() OVER (ORDER BY v DESC, product ASC), product,
                                round(v, 2), NULL FROM pv ORDER BY v DESC, product ASC LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'top_volume', row_number() OVER (ORDER BY q DESC, product ASC), product,
                                round(q, 2), NULL FROM pv ORDER BY q DESC, product ASC LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'bottom_revenue', row_number() OVER (ORDER BY v ASC, product ASC), product,
                                round(v, 2), NULL FROM pv ORDER BY v ASC, product ASC LIMIT 3)"""
    return q
