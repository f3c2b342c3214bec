"""Column names of the sales table and how source files name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source header -> engine column.
SALES_COLUMNS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_ts",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}

COMPETITOR_COLUMNS = {
    "our_price": "our_price",
    "competitor_A": "competitor_a",
    "competitor_B": "competitor_b",
    "competitor_C": "competitor_c",
}

NUMERIC_COLUMNS = ("quantity", "price")

# The accepted spellings of a date, tried in this order.
TIMESTAMP_FORMATS = (
    "M/d/yyyy[ H:mm[:ss]]",
    "yyyy-MM-dd[ HH:mm[:ss[.SSSSSS]]]",
    "yyyy-MM-dd'T'HH:mm[:ss[.SSSSSS]]",
)

UNKNOWN = "Unknown"
UNKNOWN_CUSTOMER = "Unknown Customer"

# Day names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def rename_sales(df: DataFrame) -> DataFrame:
    """Give a sales table its engine column names; other columns are kept."""
    return df.withColumnsRenamed({k: v for k, v in SALES_COLUMNS.items() if k in df.columns})


def parse_timestamp(column: str, *, lenient: bool) -> Column:
    """Read a text date. A bad value becomes null if lenient, else it fails the job."""
    text = F.col(column)
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS])
    if lenient:
        return parsed
    bad = F.raise_error(F.concat(F.lit(f"not a date in {column}: "), text)).cast("timestamp")
    return F.when(text.isNotNull(), F.coalesce(parsed, bad))


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round to `digits`, halves to even, in floating point."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale
