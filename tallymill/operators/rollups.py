"""Revenue by month, weekday, hour, country and product, and customer behaviour.

Roll-ups take `by`, extra key columns: `by=["description"]` gives the same table for
every product at once. Sums combine before the shuffle, so a hot key costs one
partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.schema import UNKNOWN

NEW, RETURNING = "New Customers", "Returning Customers"


def _revenue() -> Column:
    return F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")


def _sum_by(df: DataFrame, *keys: str) -> DataFrame:
    """Revenue per key; a null key belongs to no group."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(_revenue())


def monthly_revenue(df: DataFrame, by=()) -> DataFrame:
    return _sum_by(df, *by, "year_month")


def weekday_revenue(df: DataFrame, by=()) -> DataFrame:
    """Monday first; a day without sales has no row."""
    return _sum_by(df, *by, "weekday_no", "weekday").orderBy(*by, "weekday_no")


def hourly_revenue(df: DataFrame, by=()) -> DataFrame:
    return _sum_by(df, *by, "hour")


def country_revenue(df: DataFrame, by=()) -> DataFrame:
    return _sum_by(df, *by, "country")


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The n best sellers, smallest of them first."""
    best = _sum_by(df, "description").orderBy(F.desc("revenue"), "description").limit(n)
    return best.orderBy("revenue", F.desc("description"))


def _bottom(totals: DataFrame, key: str, n: int) -> DataFrame:
    worst = totals.orderBy("revenue", key).limit(n)
    return worst.orderBy(F.desc("revenue"), key)


def bottom_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The n weakest named products, largest of them first."""
    return _bottom(_sum_by(df.filter(F.col("description") != UNKNOWN), "description"), "description", n)


def bottom_countries(df: DataFrame, n: int = 10) -> DataFrame:
    return _bottom(_sum_by(df, "country"), "country", n)


def new_vs_returning(df: DataFrame) -> DataFrame:
    """Revenue of known customers with exactly one invoice against all others."""
    customers = (
        df.filter(F.col("customer_id") != UNKNOWN)
        .groupBy("customer_id")
        .agg(F.countDistinct("invoice").alias("invoices"), _revenue())
    )
    category = F.when(F.col("invoices") == 1, NEW).otherwise(RETURNING)
    return customers.groupBy(category.alias("customer_category")).agg(_revenue())


def average_order_value(df: DataFrame) -> DataFrame:
    """Mean invoice total per month; an invoice over two months counts in both."""
    orders = _sum_by(df, "year_month", "invoice")
    return orders.groupBy("year_month").agg(F.avg("revenue").alias("avg_order_value"))


def product(df: DataFrame, description: str) -> DataFrame:
    return df.filter(F.col("description") == description)


def product_kpis(df: DataFrame, description: str | None = None) -> DataFrame:
    """Revenue, units, mean price and number of countries of every product, or of one."""
    rows = df if description is None else product(df, description)
    return (
        rows.dropna(subset=["description"])
        .groupBy("description")
        .agg(
            _revenue(),
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("units"),
            F.avg("price").alias("avg_price"),
            F.countDistinct("country").alias("countries"),
        )
    )
