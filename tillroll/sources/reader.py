"""Readers for uploaded sales files (CSV or Parquet).

CSV columns are read as strings (no schema inference pass); typing happens
in :func:`tillroll.operators.clean.clean`, where bad values become null
instead of failing the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the charsets tried in order.  ISO-8859-1 maps every byte,
# so nothing after it could ever be reached.
CHARSETS = ["UTF-8", "ISO-8859-1"]


_CHARSETS: dict = {}


def detect_charset(spark: SparkSession, path) -> str:
    """``UTF-8`` if every line of the input is valid UTF-8, else ISO-8859-1.

    One distributed pass over the whole input: each task checks its lines,
    the driver receives a single boolean.  The answer is kept per path for
    the life of the application (:func:`forget_charsets` drops it).  Pass
    ``encoding=`` to :func:`read_csv` where the charset is known.
    """
    key = (spark.sparkContext.applicationId, tuple([path] if isinstance(path, str) else path))
    if key not in _CHARSETS:
        lines = spark.read.text(path)
        ok = lines.agg(F.coalesce(F.min(F.is_valid_utf8("value").cast("int")), F.lit(1))
                       .alias("ok")).first()["ok"]
        _CHARSETS[key] = CHARSETS[0] if ok == 1 else CHARSETS[1]
    return _CHARSETS[key]


def forget_charsets() -> None:
    _CHARSETS.clear()


def read_csv(spark: SparkSession, path, encoding: str | None = None, multi_line: bool = False,
             sep: str = ",", malformed: str = "fail") -> DataFrame:
    """Header CSV (RFC 4180: fields in double quotes, a quote inside doubled),
    every column a string.

    ``multi_line=True`` allows line breaks inside quoted fields; such a file
    is read by one task, so it is opt-in.  A record with more or fewer fields
    than the header (also what a quoted line break looks like without
    ``multi_line``) fails the job, so that no row is lost unseen;
    ``malformed="keep"`` keeps it with the fields it has.
    ``malformed="repair"`` fills the missing fields of a short record with
    null and fails on the others (:func:`load_csv` sets those aside instead).
    The check needs every field of a record, so the parser splits whole
    records whatever columns are asked for.
    """
    if malformed not in ("fail", "keep", "repair"):
        raise ValueError("malformed is 'fail', 'keep' or 'repair'")
    if malformed == "repair":
        marked = _marked(spark, path, encoding, multi_line, sep)
        bad = F.raise_error(F.concat(F.lit("malformed record ("), F.col(f"{_MARK}.status"), F.lit("): "), F.substring(f"{_MARK}.record", 1, 200)))
        fine = marked.filter(F.when(F.col(f"{_MARK}.status").isin("whole", "short"), F.lit(True)).otherwise(bad.cast("boolean")))
        return fine.drop(_MARK)
    cs = encoding or detect_charset(spark, path)
    return (spark.read.option("header", True)
            .option("inferSchema", False)
            .option("encoding", cs)
            .option("multiLine", multi_line)
            .option("sep", sep)
            .option("quote", '"')
            .option("escape", '"')
            .option("mode", "FAILFAST" if malformed == "fail" else "PERMISSIVE")
            .option("columnPruning", malformed == "keep")
            .csv(path))


_MARK = "_csv_record"


@dataclass
class CsvLoad:
    """A loaded file: its ``rows`` (short records filled with null), the
    ``rejects`` (``status``, ``n_fields``, ``record``) and ``counts`` (records
    per status: whole, short, long, quotes)."""
    rows: DataFrame
    rejects: DataFrame
    counts: DataFrame


def _field_count(record: Column, sep: str) -> Column:
    """Fields of a record: separators outside of quoted fields, and one."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1


def _marked(spark: SparkSession, path, encoding, multi_line: bool, sep: str) -> DataFrame:
    """All records as rows of strings, with ``_csv_record``: status, number of
    fields and the text of records that do not fit the header."""
    options = {"header": True, "encoding": encoding or detect_charset(spark, path), "multiLine": multi_line, "sep": sep,
               "quote": '"', "escape": '"'}
    columns = spark.read.options(**options).option("inferSchema", False).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (spark.read.options(**options).option("mode", "PERMISSIVE").option("columnPruning", False)
           .option("columnNameOfCorruptRecord", _MARK).schema(T.StructType([*text.fields, T.StructField(_MARK, T.StringType())])).csv(path))
    # Spark refuses a query on the record's text alone; nothing of the first column makes it a second one
    record = F.concat(F.col(_MARK), F.substring(F.coalesce(F.col(f"`{columns[0]}`"), F.lit("")), 1, 0))
    n = _field_count(record, sep).cast("int")
    open_quote = (F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))) % 2 == 1
    status = (F.when(record.isNull(), "whole").when(open_quote, "quotes").when(n < len(columns), "short")
              .when(n > len(columns), "long").otherwise("quotes"))
    return raw.withColumn(_MARK, F.struct(status.alias("status"), F.coalesce(n, F.lit(len(columns))).alias("n_fields"), record.alias("record")))


def load_csv(spark: SparkSession, path, encoding: str | None = None, multi_line: bool = False, sep: str = ",") -> CsvLoad:
    """Read a header CSV whose records may not all fit the header.

    A record with fewer fields keeps them and has null in the missing ones.  A
    record with more fields, or with a quote that is not closed (also a line
    break in a quoted field without ``multi_line``), is set aside with its
    text; nothing is dropped unseen and nothing fails the load.
    """
    marked = _marked(spark, path, encoding, multi_line, sep)
    status = F.col(f"{_MARK}.status")
    fits = status.isin("whole", "short")
    return CsvLoad(marked.filter(fits).drop(_MARK),
                   marked.filter(~fits).select(*[F.col(f"{_MARK}.{c}").alias(c) for c in ("status", "n_fields", "record")]),
                   marked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("records")))


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_sales(spark: SparkSession, path, fmt: str | None = None, **options) -> DataFrame:
    """Read a raw sales file by extension (``.csv`` or Parquet); short CSV
    records are filled with null unless ``malformed`` says otherwise."""
    p = path if isinstance(path, str) else path[0]
    kind = fmt or ("csv" if p.lower().rstrip("/").endswith(".csv") else "parquet")
    if kind == "csv":
        return read_csv(spark, path, **{"malformed": "repair", **options})
    if kind == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported format: {kind} (use csv or parquet)")


def source_shape(raw: DataFrame) -> DataFrame:
    """Rows and columns of a raw table, as one row."""
    return raw.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.lit(len(raw.columns)).cast("bigint").alias("n_columns"))
