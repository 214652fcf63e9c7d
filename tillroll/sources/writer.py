"""Sinks: export the clean table or any result table.

Writes are distributed (one file per task); nothing is funnelled through
one task.  Callers who need a single small file for a report may pass
``single_file=True`` for results that are bounded in size (top-k tables,
summaries), never for the fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                single_file: bool = False, partition_by=None) -> None:
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        # RFC 4180: a quote inside a field is doubled, and blanks around a value are part of it
        (w.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def export_clean(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Export the clean sales table with a header row (CSV) or as Parquet."""
    write_table(df, path, fmt=fmt, mode=mode)


def export_products(rollup: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Export the whole product rollup."""
    write_table(rollup, path, fmt=fmt, mode=mode)
