"""Cleaning, imputing and deriving columns of the sales table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.joins import is_small, lookup
from tallymill.functions.quantiles import exact_quantiles
from tallymill.schema import UNKNOWN, is_text, parse_timestamp
from tallymill.session import checkpointed, stored

IQR_COLUMNS = ("quantity", "price")


def keep_positive(df: DataFrame) -> DataFrame:
    """Drop returns and free items: quantity and price must both be above zero."""
    return df.filter((F.col("quantity") > 0) & (F.col("price") > 0))


def remove_outliers(df: DataFrame, columns=IQR_COLUMNS, accuracy: int | None = None) -> DataFrame:
    """Keep rows within 1.5 interquartile ranges, one column after the other.

    A column's quartiles come from the rows that the columns before it left. The
    bounds are computed when this is called, so that the filters are plain
    comparisons that reach the scan. With `accuracy` the quartiles are approximate.
    """
    # The columns alone, so that what the rows come from is not worked out for every pass.
    values = stored(df.select(*columns), "outlier-columns")
    for column in columns:
        if accuracy is None:
            quartiles = exact_quantiles(values, {column: (0.25, 0.75)})[column]
        else:
            quartiles = values.agg(F.percentile_approx(column, [0.25, 0.75], accuracy)).first()[0]
        if quartiles is None:
            return df.filter(F.lit(False))
        first, third = quartiles
        reach = 1.5 * (third - first)
        near = F.col(column).between(first - reach, third + reach)
        df, values = df.filter(near), values.filter(near)
    return df


def fill_customers(df: DataFrame) -> DataFrame:
    return df.fillna({"customer_id": UNKNOWN})


def descriptions_by_stock_code(df: DataFrame) -> DataFrame:
    """The latest description of each stock code; the greater text wins a tie."""
    variants = (
        df.filter(F.col("description").isNotNull() & F.col("stock_code").isNotNull())
        .groupBy("stock_code", "description")
        .agg(F.max("invoice_ts").alias("last_ts"))
    )
    return variants.groupBy("stock_code").agg(
        F.max_by("description", F.struct("last_ts", "description")).alias("known_description")
    )


def fill_descriptions(df: DataFrame) -> DataFrame:
    """Fill a missing description from the stock code's other rows, else 'Unknown'.

    If the known descriptions are few enough to broadcast, the sales are read once and
    rows with a description match nothing. Otherwise only the rows without one are joined.
    """
    if is_text(df, "invoice_ts"):
        df = df.withColumn("invoice_ts", parse_timestamp("invoice_ts", lenient=False))
    # Checkpointed, so that its size can be checked without reading the sales twice.
    names = checkpointed(descriptions_by_stock_code(df))
    text = F.coalesce("description", "known_description", F.lit(UNKNOWN)).alias("description")
    columns = [text if c == "description" else F.col(c) for c in df.columns]
    if is_small(names):
        of_missing = F.when(F.col("description").isNull(), F.col("stock_code"))
        names = F.broadcast(names.withColumnRenamed("stock_code", "_known_code"))
        return df.join(names, of_missing == F.col("_known_code"), "left").select(*columns)
    known = df.filter(F.col("description").isNotNull())
    missing = df.filter(F.col("description").isNull())
    return known.unionByName(lookup(missing, names, "stock_code").select(*columns))


def impute(df: DataFrame) -> DataFrame:
    return fill_descriptions(fill_customers(df))


def add_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", F.col("quantity") * F.col("price"))


def add_calendar(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Parse the invoice time if it is text, then add month, weekday and hour."""
    if is_text(df, "invoice_ts"):
        df = df.withColumn("invoice_ts", parse_timestamp("invoice_ts", lenient=lenient))
    ts = F.col("invoice_ts")
    return df.withColumns(
        {
            "year_month": F.date_format(ts, "yyyy-MM"),
            "weekday": F.date_format(ts, "EEEE"),
            "weekday_no": F.weekday(ts),
            "hour": F.hour(ts),
        }
    )


def add_features(df: DataFrame, lenient: bool = False) -> DataFrame:
    return add_calendar(add_revenue(df), lenient)


def clean(df: DataFrame) -> DataFrame:
    """The whole cleaning chain. Persist the result if several reports read it."""
    return (
        df.transform(keep_positive).transform(remove_outliers).transform(impute).transform(add_features)
    )


def distinct_products(df: DataFrame) -> DataFrame:
    return df.select("description").distinct()


def distinct_stock_codes(df: DataFrame) -> DataFrame:
    return df.select("stock_code").distinct()
