"""The star-schema test tables seen as sales tables.

Each function joins only the tables that the wanted columns come from: `lineitem` alone
carries invoice, stock code, quantity and price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.cleaning import add_features

COLUMNS = (
    "invoice", "stock_code", "description", "quantity", "invoice_ts", "price", "customer_id", "country",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _joined(spark: SparkSession, sf_dir: str, wanted) -> DataFrame:
    """The lines with the tables that the wanted columns come from. What belongs to an order is
    joined with the orders first, so that the many lines are shuffled by order once. The few
    nations come last, so that the shuffles carry their keys and not their names."""
    lines = table(spark, sf_dir, "lineitem")
    if {"invoice_ts", "customer_id", "country", "segment"} & set(wanted):
        orders = table(spark, sf_dir, "orders")
        if {"country", "segment"} & set(wanted):
            customers = table(spark, sf_dir, "customer")
            orders = orders.join(customers, orders.o_custkey == customers.c_custkey)
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if {"description", "brand"} & set(wanted):
        parts = table(spark, sf_dir, "part")
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
    if "country" in wanted:
        nations = F.broadcast(table(spark, sf_dir, "nation"))
        lines = lines.join(nations, lines.c_nationkey == nations.n_nationkey)
    return lines


def retail(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Order lines as sales, with the wanted columns, or all of them."""
    wanted = wanted or COLUMNS
    source = {
        "invoice": _text("l_orderkey"),
        "stock_code": _text("l_partkey"),
        "description": F.col("p_name"),
        "quantity": F.col("l_quantity"),
        "invoice_ts": F.col("o_orderdate"),
        "price": F.col("l_extendedprice") / F.col("l_quantity"),
        "customer_id": _text("o_custkey"),
        "country": F.col("n_name"),
    }
    return _joined(spark, sf_dir, wanted).select(*[source[c].alias(c) for c in wanted])


def retail_brand(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """As `retail`, with the brand as stock code and description: 25 long series."""
    wanted = wanted or ("stock_code", "quantity", "invoice_ts", "price")
    source = {
        "invoice": _text("l_orderkey"),
        "stock_code": F.col("p_brand"),
        "description": F.col("p_brand"),
        "quantity": F.col("l_quantity"),
        "invoice_ts": F.col("o_orderdate"),
        "price": F.col("l_extendedprice") / F.col("l_quantity"),
        "customer_id": _text("o_custkey"),
        "country": F.col("n_name"),
    }
    needed = {*wanted, "brand"}
    return _joined(spark, sf_dir, needed).select(*[source[c].alias(c) for c in wanted])


def retail_dirty(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """`retail` with returns, outliers, free items and missing values at fixed rows."""
    wanted = wanted or COLUMNS
    returned = (F.col("l_returnflag") == "R") & ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0)
    bulk = (F.col("l_partkey") + F.col("l_linenumber")) % 83 == 0
    free = (F.col("l_orderkey") + F.col("l_partkey")) % 97 == 0
    unnamed = (F.col("l_partkey") % 101 == 0) | ((F.col("l_orderkey") + F.col("l_partkey")) % 11 == 0)
    quantity = F.when(returned, -F.col("l_quantity")).when(bulk, F.col("l_quantity") * 100)
    source = {
        "invoice": _text("l_orderkey"),
        "stock_code": _text("l_partkey"),
        "description": F.when(~unnamed, F.col("p_name")),
        "quantity": quantity.otherwise(F.col("l_quantity")),
        "invoice_ts": F.col("o_orderdate"),
        "price": F.when(free, F.lit(0.0)).otherwise(F.col("l_extendedprice") / F.col("l_quantity")),
        "customer_id": F.when(F.col("l_orderkey") % 10 != 0, _text("o_custkey")),
        "country": F.when(F.col("o_custkey") % 50 != 0, F.col("n_name")),
    }
    return _joined(spark, sf_dir, wanted).select(*[source[c].alias(c) for c in wanted])


def retail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sales: the only table with a time of day."""
    events = table(spark, sf_dir, "events")
    return events.select(
        _text("event_id").alias("invoice"),
        F.col("event_type").alias("stock_code"),
        F.col("event_type").alias("description"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        F.col("ts").alias("invoice_ts"),
        F.col("value").alias("price"),
        _text("user_id").alias("customer_id"),
        F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string")).alias("country"),
    )


def sales(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """`retail` with revenue, and with calendar columns where the time is wanted."""
    rows = retail(spark, sf_dir, *{*wanted, "quantity", "price"})
    if "invoice_ts" in wanted:
        return add_features(rows)
    return rows.withColumn("revenue", F.col("quantity") * F.col("price"))


def competitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitor prices per order day, unknown on odd days of the year, so that there are gaps."""
    orders = table(spark, sf_dir, "orders")
    days = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("level"))
    of_year = F.dayofyear("day")
    days = days.withColumn("level", F.when(of_year % 2 == 0, F.col("level")))
    return days.select(
        "day",
        F.when(of_year % 3 != 0, F.col("level") * 0.001).alias("our_price"),
        (F.col("level") * 0.00095).alias("competitor_a"),
        (F.col("level") * 0.001).alias("competitor_b"),
        (F.col("level") * 0.00105).alias("competitor_c"),
    )


def segment_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per day and market segment of the customer."""
    joined = _joined(spark, sf_dir, ("invoice_ts", "segment"))
    return joined.select(
        F.to_date("o_orderdate").alias("day"),
        F.col("c_mktsegment").alias("segment"),
        F.col("l_quantity").alias("quantity"),
    )


def _of_priority(spark: SparkSession, sf_dir: str, priority: str, *wanted: str) -> DataFrame:
    return _joined(spark, sf_dir, {"invoice_ts", *wanted}).filter(F.col("o_orderpriority") == priority)


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List prices that hold until the next one of the product: those of urgent orders."""
    lines = _of_priority(spark, sf_dir, "1-URGENT")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.select(_text("l_partkey").alias("stock_code"), F.col("o_orderdate").alias("invoice_ts"), price.alias("list_price"))


def competitor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitor prices per brand, known on the days of urgent orders only."""
    lines = _of_priority(spark, sf_dir, "1-URGENT", "brand")
    level = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.select(
        F.col("p_brand").alias("stock_code"),
        F.to_date("o_orderdate").alias("day"),
        (level * 0.95).alias("competitor_a"),
        level.alias("competitor_b"),
    )


def promotions(spark: SparkSession, sf_dir: str, priority: str = "1-URGENT") -> DataFrame:
    """Periods of a brand: from an order of this priority on, as many days as items were ordered."""
    lines = _of_priority(spark, sf_dir, priority, "brand")
    first = F.to_date("o_orderdate")
    last = F.date_add(first, F.col("l_quantity").cast("int"))
    return lines.select(F.col("p_brand").alias("stock_code"), first.alias("first_day"), last.alias("last_day")).distinct()
