"""Running totals in a global order without a single-partition window.

``sum(x) OVER (ORDER BY ...)`` with no PARTITION BY sends every row to one
task.  Here the rows are range-partitioned on the full order (value
descending, then key), so equal values are split by their keys, however
long the keys' common prefix.  The ranges are written once to the reliable
checkpoint folder with their number, then each range takes its running sum
in parallel and adds the total of all ranges before it (one row per range).
Because the numbered rows are stored, a lost executor cannot move a row to
another range, and every row finds its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_parallelism, ensure_checkpoint_dir


def ordered_ranges(df: DataFrame, value: str, key: str, ranges: int | None = None,
                   range_col: str = "_range") -> DataFrame:
    """``df`` with the number of its range in ``value DESC, key ASC``; stored
    (checkpointed), so the numbers are fixed."""
    ensure_checkpoint_dir(df.sparkSession)
    n = ranges or default_parallelism(df.sparkSession)
    return (df.repartitionByRange(n, F.col(value).desc(), F.col(key).asc())
            .withColumn(range_col, F.spark_partition_id()).checkpoint(eager=True))


def descending_running_sum(df: DataFrame, value: str, key: str, buckets: int | None = None,
                           cum_col: str = "cum_value", pos_col: str = "position") -> DataFrame:
    """Add the running sum of ``value`` and the 1-based position in the
    order ``value DESC, key ASC``; ``buckets`` ranges (default: one per
    shuffle partition)."""
    tagged = ordered_ranges(df, value, key, buckets)
    order = [F.col(value).desc(), F.col(key).asc()]
    own = Window.partitionBy("_range").orderBy(*order)
    local = tagged.select("*", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_cum"),
                          F.row_number().over(own).alias("_pos"))
    totals = tagged.groupBy("_range").agg(F.sum(value).alias("_t"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)      # one row per range
    offsets = totals.select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_off"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_noff"))
    return (local.join(F.broadcast(offsets), "_range")                               # one row per range
            .withColumn(cum_col, F.col("_cum") + F.col("_off"))
            .withColumn(pos_col, (F.col("_pos") + F.col("_noff")).cast("bigint"))
            .drop("_range", "_cum", "_pos", "_off", "_noff"))
