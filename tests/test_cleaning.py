import datetime as dt

import numpy as np
import pandas as pd

from tallymill import fixtures as fx
from tallymill.operators import cleaning

SF = "/root/testdata/sf0.01"
T0 = dt.datetime(2010, 1, 1)


def test_positive_drops_nulls_and_zeros(spark):
    rows = [(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (-1.0, 2.0), (None, 1.0), (1.0, None)]
    df = spark.createDataFrame(rows, "quantity double, price double")
    assert cleaning.keep_positive(df).collect() == [(1.0, 1.0)]


def test_quartiles_are_taken_one_column_after_the_other(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"quantity": rng.gamma(2, 10, 400).round(), "price": rng.gamma(1.5, 3, 400)})
    # Rows with a large quantity have odd prices, so the order of the filters shows.
    frame.loc[frame.quantity > 50, "price"] *= 4
    left = frame
    for column in ("quantity", "price"):
        q1, q3 = left[column].quantile(0.25), left[column].quantile(0.75)
        reach = 1.5 * (q3 - q1)
        left = left[(left[column] >= q1 - reach) & (left[column] <= q3 + reach)]
    got = cleaning.remove_outliers(spark.createDataFrame(frame)).toPandas()
    key = ["quantity", "price"]
    pd.testing.assert_frame_equal(
        got.sort_values(key, ignore_index=True), left.sort_values(key, ignore_index=True)
    )


def test_fixture_counts(spark):
    """Row counts that sequential quartiles give on the dirty fixture."""
    rows = cleaning.keep_positive(fx.retail_dirty(spark, SF, "quantity", "price"))
    by_quantity = cleaning.remove_outliers(rows, ["quantity"])
    assert [rows.count(), by_quantity.count()] == [55482, 54777]
    assert cleaning.remove_outliers(by_quantity, ["price"]).count() == 48543


def test_outliers_of_an_empty_table(spark):
    df = spark.createDataFrame([], "quantity double, price double")
    assert cleaning.remove_outliers(df).count() == 0


def test_approximate_quartiles_on_request(spark):
    df = spark.range(1, 1001).selectExpr("CAST(id AS DOUBLE) AS quantity").unionByName(
        spark.createDataFrame([(1e6,)], "quantity double")
    )
    assert cleaning.remove_outliers(df, ["quantity"], accuracy=1000).count() == 1000


def test_descriptions(spark):
    rows = [
        ("1", "A", "old name", T0),
        ("2", "A", "new name", T0 + dt.timedelta(days=2)),
        ("3", "A", None, T0 + dt.timedelta(days=3)),
        ("4", "B", None, T0),
        ("5", "C", "x", T0),
        ("6", "C", "y", T0),
        ("7", "C", None, T0),
        ("8", None, None, T0),
    ]
    df = spark.createDataFrame(rows, "invoice string, stock_code string, description string, invoice_ts timestamp")
    got = {r.invoice: r.description for r in cleaning.fill_descriptions(df).collect()}
    assert got == {
        "1": "old name", "2": "new name", "3": "new name", "4": "Unknown", "5": "x", "6": "y", "7": "y", "8": "Unknown",
    }


def test_whole_chain_from_text(spark):
    rows = [(str(i), "A", "lamp", 2.0, f"12/{i}/2010 8:0{i}", 1.5, None, "UK") for i in range(1, 6)]
    schema = (
        "invoice string, stock_code string, description string, quantity double, invoice_ts string, "
        "price double, customer_id string, country string"
    )
    got = cleaning.clean(spark.createDataFrame(rows, schema)).orderBy("invoice").collect()
    assert len(got) == 5
    assert (got[0].customer_id, got[0].revenue, got[0].year_month, got[0].hour) == ("Unknown", 3.0, "2010-12", 8)


def test_bounds_reach_the_scan(spark):
    """The outlier bounds are literals, so parquet can skip row groups by them."""
    lines = fx.table(spark, SF, "lineitem").select(
        fx.F.col("l_quantity").alias("quantity"), fx.F.col("l_extendedprice").alias("price")
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = cleaning.remove_outliers(cleaning.keep_positive(lines))._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line][-1]
    assert "GreaterThan(l_quantity,0.0)" in pushed and "LessThanOrEqual(l_extendedprice" in pushed


def test_lines_are_shuffled_by_order_once(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = fx.retail_dirty(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Lines by order and by part; orders by customer and by order; customers; parts.
    assert text.count("Exchange hashpartitioning") == 6
    assert "hashpartitioning(c_nationkey" not in text
