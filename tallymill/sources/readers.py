"""Readers for sales, competitor-price and segment-sales files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.schema import (
    COMPETITOR_COLUMNS,
    NUMERIC_COLUMNS,
    SALES_COLUMNS,
    is_text,
    parse_timestamp,
    rename_sales,
)

# Texts that a CSV file uses for "no value".
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _read_csv(spark: SparkSession, path, multi_line: bool) -> DataFrame:
    """Every column as text, taken by header name, Latin-1, missing marks as null.

    `multi_line` allows line breaks inside quotes, but then a file cannot be split.
    """
    raw = (
        spark.read.option("header", True)
        .option("encoding", "ISO-8859-1")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    return raw.select(
        *[F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    )


def _load(spark: SparkSession, path, fmt: str, multi_line: bool) -> DataFrame:
    if fmt == "csv":
        return _read_csv(spark, path, multi_line)
    if fmt == "table":
        return spark.table(path)
    return spark.read.format(fmt).load(path)


def _as_double(df: DataFrame, columns, lenient: bool = False) -> DataFrame:
    """Numbers as doubles; a text that is none becomes null if `lenient`, else an error."""
    cast = {c: F.col(c).try_cast("double") if lenient else F.col(c).cast("double") for c in columns if c in df.columns}
    return df.withColumns(cast)


def read_sales(spark: SparkSession, path, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Sales transactions under engine names; a text date is left for the cleaning step.

    `fmt` is "csv", "table" (a catalog table) or any Spark file format.
    """
    df = _as_double(rename_sales(_load(spark, path, fmt, multi_line)), NUMERIC_COLUMNS)
    keys = [c for c in ("invoice", "stock_code", "customer_id") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string") for c in keys})


def _day_column(df: DataFrame, names, lenient: bool) -> DataFrame:
    """Turn the first of `names` that exists into a `day` date column."""
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"no date column among {list(names)}; the table has {df.columns}")
    value = parse_timestamp(found, lenient=lenient) if is_text(df, found) else F.col(found)
    return df.withColumn("day", F.to_date(value)).drop(*[n for n in names if n != "day"])


def read_competitor_prices(
    spark: SparkSession, path, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Competitor prices: `day` (null where the date is bad) and numeric price columns.

    The date column may be called InvoiceDate or Date.
    """
    df = _day_column(
        _load(spark, path, fmt, multi_line), ("InvoiceDate", "Date", "invoice_ts", "day"), True
    )
    df = df.withColumnsRenamed({k: v for k, v in COMPETITOR_COLUMNS.items() if k in df.columns})
    return _as_double(df, [c for c in df.columns if c != "day"], lenient=True)


def read_segment_sales(
    spark: SparkSession, path, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Units sold per customer group: `day`, `segment`, `quantity`.

    Takes the exports of both segmentations: the group column may be Segment,
    segment, Cluster_Name or cluster_name.
    """
    df = _day_column(_load(spark, path, fmt, multi_line), ("InvoiceDate", "invoice_ts", "day"), True)
    names = ("Segment", "segment", "Cluster_Name", "cluster_name")
    group = next((n for n in names if n in df.columns), None)
    quantity = next((n for n in ("Quantity", "quantity") if n in df.columns), None)
    if group is None or quantity is None:
        raise ValueError(f"need a segment and a quantity column; the table has {df.columns}")
    return df.select(
        "day",
        F.col(group).cast("string").alias("segment"),
        F.col(quantity).try_cast("double").alias("quantity"),
    )


def column_check(df: DataFrame, required=tuple(SALES_COLUMNS.values()), strict: bool = False) -> DataFrame:
    """One row per required column: is it there? Strict mode raises if one is missing."""
    missing = [c for c in required if c not in df.columns]
    if strict and missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = T.StructType(
        [T.StructField("column", T.StringType(), False), T.StructField("present", T.BooleanType(), False)]
    )
    return df.sparkSession.createDataFrame([(c, c not in missing) for c in required], schema)


def preview(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """The first `n` rows in a stated order."""
    return df.orderBy(*order_by).limit(n)
