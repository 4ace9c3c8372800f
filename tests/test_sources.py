from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillgrain.sources import readers, writers

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def csv(tmp_path, text, encoding="latin-1"):
    path = tmp_path / "lines.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_is_typed_and_decoded(spark, tmp_path):
    path = csv(tmp_path, HEADER + "536365,85123A,CAFÉ £5 MUG ,6,12/1/2010 8:26,2.55,17850.0,France\n"
                                  "C536379,D,,-1,12/1/2010 9:41,27.50,,France\n")  # fmt: skip
    df = readers.load_lines(spark, path)
    assert dict(df.dtypes)["InvoiceDate"] == "timestamp_ntz"
    got = df.select("Description", "Quantity", F.col("InvoiceDate").cast("string"), F.col("TotalAmount").cast("string"), "CustomerID")
    assert rows(got) == [
        ("CAFÉ £5 MUG ", 6, "2010-12-01 08:26:00", "15.3000", 17850.0),
        (None, -1, "2010-12-01 09:41:00", "-27.5000", None),
    ]


def test_quotes_and_prices_below_a_penny(spark, tmp_path):
    path = csv(tmp_path, HEADER + '1,A,"12"" TRAY, RED",10,1/2/2011 0:05,0.001,1.0,France\n')
    got = readers.load_lines(spark, path).select("Description", F.col("TotalAmount").cast("string"))
    assert rows(got) == [('12" TRAY, RED', "0.0100")]


def test_columns_bind_by_name(spark, tmp_path):
    path = csv(tmp_path, "CustomerID,UnitPrice,Quantity,InvoiceDate,InvoiceNo\n1,2.5,4,1/2/2011 0:05,9\n")
    assert rows(readers.load_lines(spark, path), "InvoiceNo", "Quantity", "CustomerID") == [("9", 4, 1.0)]


def test_missing_column_is_named(spark, tmp_path):
    path = csv(tmp_path, "InvoiceNo,Quantity\n1,2\n")
    with pytest.raises(ValueError, match="CustomerID, InvoiceDate, UnitPrice"):
        readers.load_lines(spark, path)


def test_missing_inputs_are_all_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="(?s)sales.*rfm"):
        readers.require_paths(spark, {"sales": f"{tmp_path}/no1", "rfm": f"{tmp_path}/no2"})


def test_total_amount_is_kept_or_derived(make_lines):
    lines = make_lines(("1", "A", "a", 3, "2011-01-01 00:00", 2.5, 1, "UK"))
    assert rows(readers.with_total_amount(lines).select(F.col("TotalAmount").cast("string"))) == [("7.5000",)]
    given = lines.withColumn("TotalAmount", F.lit(1))
    assert readers.with_total_amount(given) is given


def test_sinks_refresh_fully(spark, tmp_path):
    first = spark.createDataFrame([(2010, 12, ["b", "a"]), (2011, 1, ["c"])], "year int, month int, items array<string>")
    target = f"{tmp_path}/out"
    writers.write_parquet(first, target, ("year", "month"))
    writers.write_parquet(first.limit(1), f"{tmp_path}/plain")
    scan = spark.read.parquet(target).filter("year = 2011 and month = 1")
    assert scan.count() == 1
    assert "PartitionFilters: [isnotnull(year" in scan._jdf.queryExecution().toString()
    writers.write_parquet(first.filter("year = 2010"), target, ("year", "month"))
    assert spark.read.parquet(target).count() == 1
    writers.write_csv(first, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert rows(back, "items") == [("b, a",), ("c",)]
    writers.write_table(first, "sink_check", ("year",))
    writers.write_table(first.limit(1), "sink_check", ("year",))
    assert spark.table("sink_check").count() == 1
    spark.sql("DROP TABLE sink_check")


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = spark.range(100).selectExpr("id % 7 AS CustomerID", "id AS v")
    for name in ("bucket_a", "bucket_b"):
        writers.write_table(df, name, bucket_by="CustomerID", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucket_a").join(spark.table("bucket_b").select("CustomerID"), "CustomerID")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == sum(r["count"] ** 2 for r in df.groupBy("CustomerID").count().collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucket_a")
        spark.sql("DROP TABLE bucket_b")


def test_lines_that_cannot_be_read_are_set_apart(spark, tmp_path):
    path = csv(
        tmp_path,
        HEADER
        + "1,A,fine,6,12/1/2010 8:26,2.55,17850.0,France\n"
        + "2,B,CAFÉ,six,12/1/2010 8:26,2.55,17850.0,France\n"
        + "3,C,both,x,31/31/2010 8:26,dear,1.0,France\n"
        + "4,D,short,6\n"
        + '5,E,"long, quoted",6,12/1/2010 8:26,2.55,1.0,France,more\n'
        + ",F,no number,6,12/1/2010 8:26,2.55,1.0,France\n"
        + ",G,no number,six,12/1/2010 8:26,2.55,1.0,France\n"
        + "7,H,,-1,12/1/2010 9:41,27.50,,France\n",
    )
    accepted = readers.load_lines_with_rejects(spark, path, f"{tmp_path}/rejects")
    assert rows(accepted, "InvoiceNo", "Quantity", "CustomerID") == [("1", 6, 17850.0), ("7", -1, None)]
    assert accepted.schema["Quantity"].dataType == readers.INVOICE_LINES["Quantity"].dataType
    rejected = spark.read.parquet(f"{tmp_path}/rejects")
    found = {r.line: r.reasons for r in rejected.collect()}
    assert found == {
        "2,B,CAFÉ,six,12/1/2010 8:26,2.55,17850.0,France": ["Quantity: not int"],
        "3,C,both,x,31/31/2010 8:26,dear,1.0,France": ["Quantity: not int", "InvoiceDate: not timestamp_ntz", "UnitPrice: not decimal(14,4)"],
        "4,D,short,6": ["number of columns"],
        '5,E,"long, quoted",6,12/1/2010 8:26,2.55,1.0,France,more': ["number of columns"],
        ",F,no number,6,12/1/2010 8:26,2.5500,1.0,France": ["InvoiceNo: missing"],
        ",G,no number,six,12/1/2010 8:26,2.55,1.0,France": ["Quantity: not int", "InvoiceNo: missing"],
    }
    assert all(r.file.endswith("lines.csv") for r in rejected.collect())
    # the count of rejects does not hang on the columns that are asked for
    _, bad = readers.read_csv_with_rejects(spark, path)
    assert bad.count() == 5 and bad.select("file").count() == 5


def test_nothing_is_rejected_of_good_lines_and_files_need_no_header(spark, tmp_path):
    path = csv(tmp_path, "9,2.5,4\n8,1,2\n")
    good, bad = readers.read_csv_with_rejects(spark, path, columns=["InvoiceNo", "UnitPrice", "Quantity"])
    assert rows(good.select("InvoiceNo", "Quantity")) == [("8", 2), ("9", 4)]
    assert bad.collect() == []
    with pytest.raises(ValueError, match="CustomerID"):
        readers.read_csv_with_rejects(spark, path, columns=["InvoiceNo"], required=["CustomerID"])
