from datetime import datetime

from pyspark.sql import types as T

CLEAN_SCHEMA = T.StructType([
    T.StructField("order_date", T.TimestampNTZType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("total_value", T.DoubleType()),
])


def sales_df(spark, lines):
    """lines: (date 'YYYY-MM-DD[ HH:MM]', product, qty, price[, order[, customer]])."""
    out = []
    for ln in lines:
        d, p, q, u = ln[:4]
        o = ln[4] if len(ln) > 4 else None
        c = ln[5] if len(ln) > 5 else None
        fmt = "%Y-%m-%d %H:%M" if " " in d else "%Y-%m-%d"
        out.append((datetime.strptime(d, fmt), p, float(q), float(u), o, c, float(q) * float(u)))
    return spark.createDataFrame(out, CLEAN_SCHEMA)
