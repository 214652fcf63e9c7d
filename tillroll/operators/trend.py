"""Revenue over time.

The fact table is reduced by a partial + final hash aggregate to one row
per period before anything else happens, so every later step (calendar
spine, gap fill, moving windows) works on at most a few thousand rows per
series (one per calendar day), whatever the size of the fact table.  The
windows of a single series therefore run in one task by design: their
input is bounded by the number of days in the data, not by its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import WEEKDAY_NAMES, month_end, week_end_sunday, weekday_label

# weekday names in display order (Monday first)
WEEKDAYS = WEEKDAY_NAMES
GRAINS = ("day", "week", "month")


class ShortHistoryError(ValueError):
    """Fewer days than the forecast needs."""


def period_of(grain: str, ts="order_date"):
    d = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    if grain == "day":
        return d
    if grain == "week":
        return week_end_sunday(d)
    if grain == "month":
        return month_end(d)
    raise ValueError(f"grain must be one of {GRAINS}")


def _series_keys(series):
    if series is None:
        return []
    return [series] if isinstance(series, str) else list(series)


def revenue(df: DataFrame, grain: str = "day", value: str = "total_value",
            series=None) -> DataFrame:
    """Sum of ``value`` per period, every period between the first and the
    last one present (per series), absent periods = 0.0.

    Day periods are calendar days, weeks run Monday..Sunday and are
    labelled by their Sunday, months are labelled by their last day.
    Output: ``[series...,] period DATE, total_value DOUBLE``.

    One aggregate pass over the facts, then each present period emits
    itself plus zero rows for the missing periods up to the next present
    one (``lead`` over the period-level table, bounded by the number of
    periods): no calendar join and no second read of the facts.
    """
    keys = _series_keys(series)
    sums = (df.groupBy(*keys, period_of(grain).alias("period"))
            .agg(F.sum(value).alias("total_value")))
    sums = sums.withColumn("_next", F.lead("period").over(Window.partitionBy(*keys).orderBy("period")))
    nxt = F.col("_next")
    p = F.col("period")
    if grain == "day":
        fill = F.sequence(p, F.coalesce(F.date_sub(nxt, 1), p), F.expr("INTERVAL 1 DAY"))
    elif grain == "week":
        fill = F.sequence(p, F.coalesce(F.date_sub(nxt, 7), p), F.expr("INTERVAL 7 DAY"))
    else:
        m0 = F.trunc(p, "month")
        fill = F.transform(F.sequence(m0, F.coalesce(F.add_months(F.trunc(nxt, "month"), -1), m0),
                                      F.expr("INTERVAL 1 MONTH")), lambda m: F.last_day(m))
    return (sums.select(*keys, "period", "total_value", F.explode(fill).alias("p"))
            .select(*keys, F.col("p").alias("period"),
                    F.when(F.col("p") == F.col("period"), F.col("total_value"))
                    .otherwise(F.lit(0.0)).alias("total_value")))


def daily(df: DataFrame, value: str = "total_value", series=None) -> DataFrame:
    return revenue(df, "day", value, series)


def by_date(df: DataFrame) -> DataFrame:
    """Calendar-day sums of the days that have sales (no gap fill)."""
    return (df.groupBy(F.to_date("order_date").alias("order_day"))
            .agg(F.sum("total_value").alias("total_value")))


def by_weekday(df: DataFrame) -> DataFrame:
    """Revenue per weekday, Monday..Sunday, weekdays without sales = 0."""
    spark = df.sparkSession
    days = spark.createDataFrame([(i, d) for i, d in enumerate(WEEKDAYS)], "weekday int, day string")
    sums = df.groupBy(F.weekday("order_date").alias("weekday")).agg(F.sum("total_value").alias("v"))
    return (F.broadcast(days).join(sums, "weekday", "left")   # 7 rows by construction
            .select("weekday", "day", F.coalesce("v", F.lit(0.0)).alias("total_value")))


def by_month_label(df: DataFrame) -> DataFrame:
    """Revenue per ``yyyy-MM`` label (months without sales are absent)."""
    return (df.groupBy(F.trunc(F.to_date("order_date"), "month").alias("_m"))   # a date, not text per row
            .agg(F.sum("total_value").alias("total_value"))
            .select(F.date_format("_m", "yyyy-MM").alias("month"), "total_value"))


def weekday_ranking(df: DataFrame) -> DataFrame:
    """Weekdays with sales ranked by revenue (ties: name), one row per day."""
    sums = (df.groupBy(F.weekday("order_date").alias("_wd")).agg(F.sum("total_value").alias("total_value"))
            .select(weekday_label("_wd").alias("day"), "total_value"))
    w = Window.orderBy(F.col("total_value").desc(), F.col("day").asc())   # <= 7 rows
    return sums.withColumn("rank", F.row_number().over(w))


def weekday_best_worst(df: DataFrame) -> DataFrame:
    """Best and worst weekday (days without any sale are not considered)."""
    sums = (df.groupBy(F.weekday("order_date").alias("_wd")).agg(F.sum("total_value").alias("v"))
            .select(weekday_label("_wd").alias("day"), "v"))
    ranked = sums.agg(F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("k"), F.col("day"),
                                                           F.col("v")))).alias("a"))   # <= 7 entries
    return ranked.select(F.col("a")[0]["day"].alias("best_day"), F.col("a")[0]["v"].alias("best_revenue"),
                         F.element_at("a", -1)["day"].alias("worst_day"),
                         F.element_at("a", -1)["v"].alias("worst_revenue"))


def last_n(series_df: DataFrame, n: int, period: str = "period") -> DataFrame:
    """Last ``n`` periods of a gap-filled series (top-k, no full sort)."""
    return series_df.orderBy(F.col(period).desc()).limit(n)


def tail_sum(series_df: DataFrame, n: int = 30, value: str = "total_value",
             period: str = "period") -> DataFrame:
    return last_n(series_df, n, period).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(f"last{n}_sum"))


def require_history(series_df: DataFrame, min_days: int = 14) -> int:
    """Number of days in the series; raises when below ``min_days``."""
    n = series_df.count()
    if n < min_days:
        raise ShortHistoryError(f"need at least {min_days} days, have {n}")
    return n


def history_lengths(df: DataFrame, series, period: str = "period") -> DataFrame:
    """``[series...,] n_days``, ``first_day``, ``last_day``: the calendar days
    that a gap-free daily series of ``df`` has (``df`` may have gaps)."""
    keys = _series_keys(series)
    ends = df.groupBy(*keys).agg(F.min(F.to_date(period)).alias("first_day"), F.max(F.to_date(period)).alias("last_day"))
    return ends.select(*keys, (F.datediff("last_day", "first_day") + 1).alias("n_days"), "first_day", "last_day")


def moving_average(series_df: DataFrame, window: int = 7, value: str = "total_value",
                   period: str = "period", series=None) -> DataFrame:
    """Trailing mean over ``window`` rows, null until the frame is full, and
    null throughout when the series has ``window`` rows or fewer."""
    keys = _series_keys(series)
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(-(window - 1), 0)
    whole = Window.partitionBy(*keys)
    full = (F.count(F.lit(1)).over(w) == window) & (F.count(F.lit(1)).over(whole) > window)
    return series_df.withColumn(f"ma{window}", F.when(full, F.avg(value).over(w)))
