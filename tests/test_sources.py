import datetime as dt
import time
from collections import Counter

import pytest

from tallymill import session
from tallymill.catalog import queries
from tallymill.operators import cleaning
from tallymill.sources import read_competitor_prices, read_sales, read_segment_sales, write_table, writers
from tallymill.sources.readers import column_check, preview

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country"


def sales_file(folder, lines, header=HEADER, name="sales.csv"):
    path = folder / name
    path.write_bytes("\n".join([header, *lines]).encode("latin-1"))
    return str(path)


def test_sales_csv(spark, tmp_path):
    path = sales_file(
        tmp_path,
        [
            '536365,85123A,"CAFÉ ""DELUXE"", RED",6,12/1/2010 8:26,2.55,17850,United Kingdom',
            "536366,00022,,-1,2010-12-02 09:05:30,NaN,,N/A",
        ],
    )
    first, second = read_sales(spark, path).orderBy("invoice").collect()
    assert tuple(first) == (
        "536365", "85123A", 'CAFÉ "DELUXE", RED', 6.0, "12/1/2010 8:26", 2.55, "17850", "United Kingdom",
    )
    # Leading zeros stay; an empty field, NaN and N/A are all missing.
    assert second.stock_code == "00022"
    assert [second.description, second.price, second.customer_id, second.country] == [None] * 4
    times = cleaning.add_calendar(read_sales(spark, path)).orderBy("invoice").collect()
    assert [r.invoice_ts for r in times] == [dt.datetime(2010, 12, 1, 8, 26), dt.datetime(2010, 12, 2, 9, 5, 30)]
    assert [(r.year_month, r.weekday, r.weekday_no, r.hour) for r in times] == [
        ("2010-12", "Wednesday", 2, 8),
        ("2010-12", "Thursday", 3, 9),
    ]


def test_columns_are_taken_by_name_not_by_place(spark, tmp_path):
    path = sales_file(tmp_path, ["9.5,3,A1,x"], "Price,Quantity,StockCode,Note")
    row = read_sales(spark, path).first()
    assert (row.price, row.quantity, row.stock_code, row.Note) == (9.5, 3.0, "A1", "x")


def test_bad_date(spark, tmp_path):
    path = sales_file(tmp_path, ["1,A,d,1,soon,1.0,c,UK"])
    df = read_sales(spark, path)
    assert cleaning.add_calendar(df, lenient=True).first().invoice_ts is None
    with pytest.raises(Exception, match="not a date in invoice_ts: soon"):
        cleaning.add_calendar(df).collect()


def test_missing_column(spark, tmp_path):
    path = sales_file(tmp_path, ["1,A"], "Invoice,StockCode")
    df = read_sales(spark, path)
    present = {r["column"]: r.present for r in column_check(df).collect()}
    assert present["invoice"] and not present["country"] and len(present) == 8
    with pytest.raises(ValueError, match="missing columns: description, quantity"):
        column_check(df, strict=True)


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception, match="does not exist"):
        read_sales(spark, str(tmp_path / "none.csv"))


def test_other_formats_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", 2, 3.0)], "Invoice string, StockCode string, Quantity int, Price double")
    df.write.parquet(str(tmp_path / "p"))
    assert read_sales(spark, str(tmp_path / "p"), "parquet").first().quantity == 2.0
    df.createOrReplaceTempView("some_sales")
    assert read_sales(spark, "some_sales", "table").columns == ["invoice", "stock_code", "quantity", "price"]


@pytest.mark.parametrize("name", ["Date", "InvoiceDate"])
def test_competitor_prices(spark, tmp_path, name):
    path = sales_file(
        tmp_path, ["2009-12-01,1.92,1.87,1.9,2.02", "never,1,1,1,1"], f"{name},our_price,competitor_A,competitor_B,competitor_C"
    )
    good, bad = read_competitor_prices(spark, path).collect()
    assert good.asDict() == {
        "our_price": 1.92, "competitor_a": 1.87, "competitor_b": 1.9, "competitor_c": 2.02, "day": dt.date(2009, 12, 1),
    }
    assert bad.day is None


@pytest.mark.parametrize("group", ["Segment", "Cluster_Name", "cluster_name"])
def test_segment_sales(spark, tmp_path, group):
    path = sales_file(tmp_path, ["2010-01-05 10:00,At Risk,4"], f"InvoiceDate,{group},Quantity")
    assert tuple(read_segment_sales(spark, path).first()) == (dt.date(2010, 1, 5), "At Risk", 4.0)


def test_segment_sales_needs_its_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="segment"):
        read_segment_sales(spark, sales_file(tmp_path, ["2010-01-05,1"], "InvoiceDate,Quantity"))


@pytest.mark.parametrize("fmt,parts", [("csv", ()), ("parquet", ("segment",))])
def test_sink_round_trip(spark, tmp_path, fmt, parts):
    rows = [("a,1", "Champions", 1.5), ('say "hi"', "At Risk", 2.0)]
    df = spark.createDataFrame(rows, "customer_id string, segment string, monetary double")
    path = str(tmp_path / "out")
    write_table(df, path, fmt, parts)
    reader = spark.read.option("header", True).option("escape", '"').schema(df.schema) if fmt == "csv" else spark.read
    back = reader.format(fmt).load(path).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(Exception, match="already exists"):
        write_table(df, path, fmt)


def test_preview(spark):
    df = spark.range(100).repartition(5)
    assert [r.id for r in preview(df, ["id"]).collect()] == [0, 1, 2, 3, 4]


def test_text_in_side_files_costs_the_value_only(spark, tmp_path):
    prices, units = tmp_path / "prices.csv", tmp_path / "units.csv"
    prices.write_text("Date,our_price,competitor_A,remark\n2020-01-01,1.5,cheap,none\n2020-01-02,x,2.5,n/a\n")
    got = sorted((str(r.day), r.our_price, r.competitor_a, r.remark) for r in read_competitor_prices(spark, str(prices)).collect())
    assert got == [("2020-01-01", 1.5, None, None), ("2020-01-02", None, 2.5, None)]
    units.write_text("InvoiceDate,Segment,Quantity\n2020-01-01,a,3\n2020-01-01,b,many\n")
    assert sorted((r.segment, r.quantity) for r in read_segment_sales(spark, str(units)).collect()) == [("a", 3.0), ("b", None)]


def test_exports_are_compressed_and_written_in_parts(spark):
    """All rows once, those without a customer too; no part is as large as the whole."""
    rows = [(f"c{n % 40}" if n % 7 else None, "a \"b\", c", n) for n in range(400)]
    df = spark.createDataFrame(rows, "customer_id string, description string, n int")
    found = queries._through_csv(df, "export")
    assert Counter(tuple(r) for r in found.collect()) == Counter(rows)
    files = found.inputFiles()
    assert all(f.endswith(".csv.gz") for f in files) and len(files) >= writers.BATCHES


def test_stored_and_checkpointed_tables_leave_no_shuffle_files(spark):
    """They would take disk beside each other until the driver collects its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    setting = spark.conf.get(session.CLEANUP, None)
    before = shuffled()
    tables = [keep(spark.range(1000).repartition(4, "id").groupBy("id").count()) for keep in (session.stored, session.checkpointed)]
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    assert [t.count() for t in tables] == [1000, 1000]
    assert spark.conf.get(session.CLEANUP, None) == setting
