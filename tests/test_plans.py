import re

import pytest
from pyspark.sql import functions as F

from tallymill import fixtures as fx
from tallymill.catalog.queries import QUERIES
from tallymill.operators import basket, cleaning, rfm, rollups

SF = "/root/testdata/sf0.001"
LAZY = (
    "monthly_revenue", "weekday_revenue", "top_products", "bottom_countries", "new_vs_returning", "avg_order_value",
    "market_basket", "sales_kpis", "product_sales_kpis", "product_kpis", "product_trends", "rfm", "cluster_profile",
    "competitor_join", "feature_table", "minmax", "sequences", "split", "forecast_kpis", "price_uplift",
)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products_of_tables_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "NestedLoopJoin", "Python", "MapInPandas"):
        assert node not in text


def test_only_needed_columns_and_tables_are_read(spark):
    text = plan(QUERIES["top_products"](spark, SF))
    assert "orders.parquet" not in text and "customer.parquet" not in text
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(read) == [
        "l_partkey:bigint,l_quantity:double,l_extendedprice:double",
        "p_partkey:bigint,p_name:string",
    ]


def test_sums_combine_before_the_shuffle(spark):
    rows = fx.sales(spark, SF, "invoice_ts", "invoice", "customer_id")
    for df in (rollups.monthly_revenue(rows), rollups.average_order_value(rows), rfm.rfm(rows)):
        assert "partial_sum(revenue" in plan(df)
    # The bits of an invoice, too, so a hot invoice sends one row per task.
    assert "partial_bit_or" in plan(basket.market_basket(fx.retail(spark, SF, "invoice", "description")))


def test_distinct_invoices_of_a_hot_customer_are_spread(spark):
    """Distinct counts shuffle by customer and invoice before they shuffle by customer."""
    rows = fx.sales(spark, SF, "invoice", "invoice_ts", "customer_id")
    text = plan(rfm.rfm(rows))
    assert re.search(r"Exchange hashpartitioning\(customer_id#\d+, invoice#\d+", text)


def test_results_do_not_depend_on_partitions(spark):
    rows = cleaning.add_features(fx.retail_dirty(spark, SF)).persist()
    for report in (
        lambda df: rollups.top_products(df),
        lambda df: basket.market_basket(df),
        lambda df: rfm.segment_customers(rfm.rfm(df)).select("customer_id", "segment"),
    ):
        first = report(rows.repartition(3)).collect()
        second = report(rows.orderBy(F.rand(5)).repartition(11)).collect()

        def values(found):
            return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in found), key=str)

        assert values(first) == values(second)


def test_sales_are_read_once_for_missing_descriptions(spark):
    df = QUERIES["clean_full"](spark, SF)
    text = plan(df)
    final = text.split("== Initial Plan ==")[-1] if "== Initial Plan ==" in text else text
    assert len(re.findall("FileScan parquet", final)) == 5


@pytest.mark.parametrize("name", ["segment_join", "sales_with_segments", "sales_with_clusters"])
def test_lookups_are_materialised(spark, name):
    """What remains to run reads the sales once; the table they are joined with is ready."""
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem", plan(QUERIES[name](spark, SF)))) <= 1
