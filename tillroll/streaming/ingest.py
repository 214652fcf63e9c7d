"""Incremental loading: sales files dropped into a folder are cleaned with
the same :func:`tillroll.operators.clean.clean` plan and appended to a
Parquet table, once per file (Structured Streaming file source and sink).
That holds across restarts because the checkpoint folder is the caller's: it
must be in shared storage, belong to one table, and be given every time.

The daily revenue of the appended table is then the ordinary batch
operator :func:`tillroll.operators.trend.daily` over that table;
:func:`daily_revenue_stream` keeps the per-day sums up to date as files
arrive, with a watermark so old days' state is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import DEFAULT_DATE_FORMATS
from ..operators.clean import clean


def read_stream(spark: SparkSession, source_dir: str, columns, fmt: str = "csv",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw rows of new files; every column a string (the file header names
    are given, since a stream needs its schema up front)."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        return (r.option("header", True).option("quote", '"').option("escape", '"')
                .option("mode", "FAILFAST").option("columnPruning", False).csv(source_dir))
    return r.parquet(source_dir)


def clean_stream(spark: SparkSession, source_dir: str, columns, mapping: dict | None = None,
                 fmt: str = "csv", formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    return clean(read_stream(spark, source_dir, columns, fmt), mapping, formats)


def start_ingest(stream: DataFrame, table_path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Append the cleaned stream to a Parquet table; files that the
    ``checkpoint`` folder already lists are not read again."""
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(table_path)


def daily_revenue_stream(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Running revenue per calendar day of a clean stream (late rows within
    the watermark still count)."""
    # watermarks need a zoned TIMESTAMP; the wall-clock time is read in the
    # session zone (UTC in get_spark), so day windows are calendar days
    return (stream.withColumn("event_time", F.col("order_date").cast("timestamp"))
            .withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "1 day").alias("w"))
            .agg(F.sum("total_value").alias("total_value"))
            .select(F.to_date(F.col("w.start")).alias("period"), "total_value"))
