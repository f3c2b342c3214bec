"""Reports that follow the sales as files arrive, with the same results as over all of them at once.

A run works through the files that are new since the last one and ends. Progress, the lines seen
lately and each customer's figures are in the checkpoint folder, so a run that failed is simply
run again: its batches are numbered, and a batch that is written twice is written over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH = "batch"
TIME = "invoice_ts"
STATE = "last_purchase timestamp, frequency long, monetary double, open_invoices array<string>, open_times array<timestamp>"
CUSTOMER = "customer_id string, last_purchase timestamp, frequency long, monetary double"


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def distinct_lines(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """The first of the lines with the same `keys` (null equals null). Copies, and lines at all, may
    come up to `delay` after the latest time seen; copies that come later may count again."""
    return stream.withWatermark(TIME, delay).dropDuplicatesWithinWatermark(list(keys))


def revenue_by(stream: DataFrame, *keys: str) -> DataFrame:
    """Running revenue per value of the keys (year_month, weekday, hour and columns of the sales).
    A null key belongs to no group. For `run` with mode complete."""
    known = {
        "day": F.to_date(TIME),
        "year_month": F.date_format(TIME, "yyyy-MM"),
        "weekday_no": F.weekday(TIME),
        "hour": F.hour(TIME),
    }
    rows = stream.withColumns({k: known[k] for k in keys if k in known}).dropna(subset=list(keys))
    revenue = F.sum(F.col("quantity") * F.col("price"))
    return rows.groupBy(*keys).agg(F.coalesce(revenue, F.lit(0.0)).alias("revenue"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("units"))


def _customer(delay: pd.Timedelta):
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, frequency, monetary, names, times = state.get if state.exists else (None, 0, 0.0, [], [])
        held = dict(zip(names, times, strict=True))
        for part in parts:
            monetary += float((part["quantity"] * part["price"]).sum())
            for invoice, time in zip(part["invoice"], part[TIME], strict=True):
                if pd.notna(time):
                    last = time if last is None or time > last else last
                if invoice is not None:
                    frequency += invoice not in held
                    held[invoice] = max(time, held.get(invoice, time))
        # Only invoices that may still get lines are remembered by name.
        held = {k: t for k, t in held.items() if last is None or pd.isna(t) or t >= last - delay}
        state.update((last, frequency, monetary, list(held), list(held.values())))
        yield pd.DataFrame({"customer_id": [key[0]], "last_purchase": [last], "frequency": [frequency], "monetary": [monetary]})

    return update


def customer_figures(stream: DataFrame, delay: str) -> DataFrame:
    """The last purchase, the number of invoices and the revenue so far of each customer that has
    new lines, from the figures kept in the state store. The lines of an invoice are no more than
    `delay` apart. Sales without a customer count as one. For `run` with mode update."""
    rows = stream.select(F.coalesce("customer_id", F.lit("Unknown")).alias("customer_id"), "invoice", TIME, "quantity", "price")
    return rows.groupBy("customer_id").applyInPandasWithState(_customer(pd.Timedelta(delay)), CUSTOMER, STATE, "update", GroupStateTimeout.NoTimeout)


def run(rows: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Work through what is new and write the result of each batch under its number. The
    checkpoint folder belongs to this report; both folders must be shared by all machines."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def whole(spark: SparkSession, path: str, schema) -> DataFrame:
    """The result of a report with mode complete: its last batch."""
    rows = _batches(spark, path, schema)
    last = rows.agg(F.max(BATCH)).first()[0]
    return rows.filter(F.col(BATCH) == F.lit(last)).drop(BATCH)


def newest(spark: SparkSession, path: str, schema, *keys: str) -> DataFrame:
    """The result of a report with mode update: the last row of each value of the keys."""
    order = Window.partitionBy(*keys).orderBy(F.desc(BATCH))
    rows = _batches(spark, path, schema).withColumn("_place", F.row_number().over(order))
    return rows.filter("_place = 1").drop("_place", BATCH)


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    from pyspark.sql.types import LongType, StructField, StructType

    return spark.read.schema(StructType([*schema, StructField(BATCH, LongType())])).parquet(path)


def rfm(figures: DataFrame, last_sale) -> DataFrame:
    """The figures as an RFM table: whole days up to one day after `last_sale`, the time of the last
    sale of all."""
    since = F.extract(F.lit("DAY"), F.lit(last_sale) + F.expr("INTERVAL 1 DAY") - F.col("last_purchase"))
    return figures.select("customer_id", since.cast("bigint").alias("recency"), "frequency", "monetary")
