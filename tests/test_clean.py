"""Sources, column detection and cleaning on hand-made rows."""

import datetime as dt

import pytest

from tillroll.operators.clean import clean, preview
from tillroll.functions import exprs
from tillroll.sources import reader, schema, writer
from tillroll.sources.reader import detect_charset, read_csv, read_sales, source_shape
from tillroll.sources.writer import export_clean


def _raw(spark, rows, cols=("InvoiceDate", "Description", "Quantity", "UnitPrice", "InvoiceNo")):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_numeric_text(spark):
    vals = ["5", " 5 ", "1e3", "1.0f", "1d", "1,234", "abc", "NaN", ""]
    raw = _raw(spark, [("2024-01-01", "p", v, "2.0", "o1") for v in vals])
    got = sorted(r["quantity"] for r in clean(raw).collect())
    assert got == [5.0, 5.0, 1000.0]


def test_sign_and_zero_dropped(spark):
    raw = _raw(spark, [("2024-01-01", "p", "-1", "2", "o"), ("2024-01-01", "p", "0", "2", "o"),
                       ("2024-01-01", "p", "1", "0", "o"), ("2024-01-01", "p", "1", "2", "o")])
    assert clean(raw).count() == 1


def test_dates(spark):
    raw = _raw(spark, [("2024-01-01", "p", "1", "1", "o"), ("2024-13-01", "p", "1", "1", "o"),
                       (None, "p", "1", "1", "o")])
    out = clean(raw).collect()
    assert len(out) == 1 and out[0]["order_date"] == dt.datetime(2024, 1, 1)


def test_date_formats(spark):
    raw = _raw(spark, [("12/1/2010 8:26", "p", "1", "1", "o")])
    out = clean(raw, formats=["M/d/yyyy H:mm"]).collect()
    assert out[0]["order_date"] == dt.datetime(2010, 12, 1, 8, 26)


def test_format_guard_matches_plain_parse(spark):
    # the literal-character guard only skips parses that cannot succeed
    from pyspark.sql import functions as F
    from tillroll.functions.exprs import DEFAULT_DATE_FORMATS, to_timestamp_ntz
    texts = ["12/1/2010 8:26", "12/1/2010 8:26:59", "12/1/2010", "2010/12/1 8:26", "2010/12/1",
             "1.12.2010 8:26", "1.12.2010", "2010-12-01", "2010-12-01 08:26:00", "not a date",
             "12/1/2010 8", "1.12", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    s = F.trim(F.col("t"))
    plain = F.coalesce(s.try_cast("timestamp_ntz"),
                       *[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in DEFAULT_DATE_FORMATS])
    rows = df.select("t", to_timestamp_ntz("t").alias("g"), plain.alias("p")).collect()
    assert all(r["g"] == r["p"] for r in rows)
    assert sum(r["g"] is not None for r in rows) == 9


def test_null_product_kept_and_total(spark):
    raw = _raw(spark, [("2024-01-01", None, "2", "3.5", "o")])
    out = clean(raw).collect()
    assert out[0]["product_name"] is None and out[0]["total_value"] == 7.0


def test_clean_columns_and_types(spark):
    raw = _raw(spark, [("2024-01-01", "p", "2", "3", "o", "x")],
               cols=("InvoiceDate", "Description", "Quantity", "UnitPrice", "InvoiceNo", "Extra"))
    out = clean(raw)
    assert out.columns == ["order_date", "product_name", "quantity", "unit_price", "transaction_id",
                           "total_value"]
    assert out.schema["order_date"].dataType.simpleString() == "timestamp_ntz"


def test_alias_priority():
    m, missing, _ = schema.detect(["date", "InvoiceDate", "Description", "Quantity", "UnitPrice"])
    assert m["order_date"] == "InvoiceDate" and not missing


def test_header_noise():
    m1, miss1, _ = schema.detect(["InvoiceDate", "Description", " quantity ", "Price"])
    m2, miss2, _ = schema.detect(["InvoiceDate", "Description", "QTY", "Price"])
    assert m1["quantity"] == " quantity " and m2["quantity"] == "QTY" and not miss1 and not miss2


def test_missing_required_names_column(spark):
    raw = spark.createDataFrame([("2024-01-01", "p", "1")], "InvoiceDate string, Description string, Qty string")
    with pytest.raises(schema.MissingColumnsError, match="unit_price"):
        clean(raw)


def test_manual_mapping(spark):
    raw = spark.createDataFrame([("2024-01-01", "p", "1", "2")], "when_ string, what string, n string, cost_ string")
    out = clean(raw, mapping={"order_date": "when_", "product_name": "what", "quantity": "n",
                              "unit_price": "cost_"})
    assert out.count() == 1


def test_transaction_id_alias_roundtrip():
    m, _, found = schema.detect(["order_date", "product_name", "quantity", "unit_price", "transaction_id"])
    assert m["transaction_id"] == "transaction_id" and "transaction_id" in found


def test_latin1_csv(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes(b"InvoiceDate,Description,Quantity,UnitPrice\n2024-01-01,caf\xe9,1,2\n")
    assert detect_charset(spark, str(p)) == "ISO-8859-1"
    df = read_csv(spark, str(p))
    assert df.collect()[0]["Description"] == "café"
    u = tmp_path / "utf.csv"
    u.write_bytes("InvoiceDate,Description,Quantity,UnitPrice\n2024-01-01,café,1,2\n".encode())
    assert detect_charset(spark, str(u)) == "UTF-8"
    assert read_sales(spark, str(u)).collect()[0]["Description"] == "café"


def test_source_shape_and_preview(spark):
    raw = _raw(spark, [("2024-01-0%d" % i, "p", "1", "1", "o") for i in range(1, 6)])
    s = source_shape(raw).collect()[0]
    assert (s["n_rows"], s["n_columns"]) == (5, 5)
    pv = preview(clean(raw), 2).collect()
    assert [r["order_date"].day for r in pv] == [1, 2]


def test_clean_is_idempotent(spark):
    raw = _raw(spark, [("2024-01-01", "p", "1", "2", "o"), ("2024-01-02", "q", "x", "2", "o")])
    once = clean(raw)
    twice = clean(once)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_export_roundtrip(spark, tmp_path):
    raw = _raw(spark, [("2024-01-01", "p", "1", "2", "o1"), ("2024-01-02", "q", "3", "2", "o2")])
    c = clean(raw)
    out = str(tmp_path / "export")
    export_clean(c, out)
    back = clean(read_csv(spark, out + "/*.csv", encoding="UTF-8"))
    assert sorted(r["total_value"] for r in back.collect()) == [2.0, 6.0]
    assert "transaction_id" in back.columns


def test_typed_parquet_filters_reach_scan(spark, tmp_path):
    from pyspark.sql import functions as F
    raw = spark.createDataFrame([(dt.datetime(2024, 1, 1), "p", 2, 3.0), (dt.datetime(2024, 1, 2), "q", 0, 3.0)],
                                "InvoiceDate timestamp_ntz, Description string, Quantity int, UnitPrice double")
    path = str(tmp_path / "typed.parquet")
    raw.write.parquet(path)
    out = clean(spark.read.parquet(path))
    assert [r["total_value"] for r in out.collect()] == [6.0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Quantity), IsNotNull(UnitPrice), IsNotNull(InvoiceDate)" in plan \
        or "GreaterThan(Quantity,0)" in plan
    assert "Generate" not in plan                      # typed input: plain projection
    assert out.schema["quantity"].dataType.simpleString() == "double"
    assert F is not None


AWKWARD = ('InvoiceDate,Description,Quantity,UnitPrice,InvoiceNo\n'
           '2024-01-01,"12"" RULER, BLUE",5,10.5,A1\n'
           '2024-01-02,  PADDED ,"\t5",\xa02,A2\n'
           '2024-01-03,"a ""quoted"" name",1,1,A3\n'
           '3/10/2024 2:30,café,1,1,A4\n')


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1"])
def test_csv_round_trip(spark, tmp_path, encoding):
    src = tmp_path / "in.csv"
    src.write_bytes(AWKWARD.encode(encoding))
    first = clean(reader.read_sales(spark, str(src)))
    names = {r["product_name"]: (r["quantity"], r["unit_price"]) for r in first.collect()}
    assert names == {'12" RULER, BLUE': (5.0, 10.5), "  PADDED ": (5.0, 2.0), 'a "quoted" name': (1.0, 1.0), "café": (1.0, 1.0)}
    writer.export_clean(first, str(tmp_path / "out"))
    again = clean(reader.read_csv(spark, str(tmp_path / "out")))
    key = lambda r: r["transaction_id"]
    assert sorted(again.collect(), key=key) == sorted(first.collect(), key=key)


def test_quoted_line_break(spark, tmp_path):
    src = tmp_path / "lines.csv"
    src.write_text('date,Item,qty,Price\n2024-01-01,"two\nlines",2,3\n2024-01-02,b,1,1\n')
    rows = clean(reader.read_csv(spark, str(src), multi_line=True)).collect()
    assert sorted(r["product_name"] for r in rows) == ["b", "two\nlines"]
    with pytest.raises(Exception, match="(?i)malformed"):
        reader.read_csv(spark, str(src)).count()                   # refused, not lost
    assert reader.read_csv(spark, str(src), malformed="keep").count() == 3


def test_dates_ignore_the_session_zone(spark):
    raw = spark.createDataFrame([("3/10/2024 2:30",), ("2024-03-10 02:30:00",), ("11/3/2024 1:30:15",)], "d string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [str(r[0]) for r in raw.select(exprs.to_timestamp_ntz("d").cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2024-03-10 02:30:00", "2024-03-10 02:30:00", "2024-11-03 01:30:15"]


def test_text_input_is_pruned(spark, tmp_path):
    rows = [("2024-01-01", "a", "1", "2", "o", "c")]
    spark.createDataFrame(rows, "InvoiceDate string, Description string, Quantity string, UnitPrice string, "
                                "InvoiceNo string, CustomerID string").write.parquet(str(tmp_path / "p"))
    from tillroll.operators import kpi
    status = kpi.load_status(clean(spark.read.parquet(str(tmp_path / "p"))))
    plan = status._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "Quantity" in schema and "Description" not in schema and "CustomerID" not in schema
    assert status.first()["records"] == 1


def test_display_forms(spark):
    df = spark.createDataFrame([(1234.5, 4.25), (-0.5, -3.14)], "a double, b double")
    got = [tuple(r) for r in df.select(exprs.plain_money("a"), exprs.signed_percent("b"), exprs.money("a")).collect()]
    assert got == [("£1234.50", "+4.2%", "£1,234.50"), ("£-0.50", "-3.1%", "£-0.50")]
