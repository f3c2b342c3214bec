"""Streams against the same reports over all rows at once, with restarts and failures on the way."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import rfm
from tallymill.session import new_folder
from tallymill.streaming import sales as stream

T0 = dt.datetime(2011, 1, 1)
SCHEMA = "invoice string, stock_code string, quantity double, price double, invoice_ts timestamp, customer_id string, country string"
KEYS = ["invoice", "stock_code"]


def lines(n=400, seed=3):
    """Invoices of up to four lines, in order of time."""
    r = random.Random(seed)
    rows, at = [], T0
    for k in range(n):
        at += dt.timedelta(minutes=r.randrange(90))
        customer, country = r.choice(["1", "2", "3", None, "4"]), r.choice(["UK", "FR", None])
        rows += [(f"i{k}", f"s{j}", float(r.randint(1, 9)), r.randint(1, 99) / 4, at, customer, country) for j in range(r.randint(1, 4))]
    return rows


@pytest.fixture
def arrivals(spark):
    """Batches of lines as files; each holds some of its own lines twice."""
    path = new_folder(spark, "arrivals")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    rows = lines()

    def arrive(low, high):
        part = [x for k, x in enumerate(rows) if low <= k < high]
        spark.createDataFrame(part + part[::5], SCHEMA).coalesce(1).write.mode("append").parquet(path)

    return path, rows, arrive


def read(spark, path):
    return stream.distinct_lines(stream.read_files(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1), KEYS, "1 hour")


def values(df):
    return sorted(map(repr, df.collect()))


def test_revenue_over_restarts(spark, arrivals):
    path, rows, arrive = arrivals
    out, progress = new_folder(spark, "out"), new_folder(spark, "progress")
    report = stream.revenue_by(read(spark, path), "country", "year_month")
    third = len(rows) // 3
    arrive(0, third)
    stream.run(report, out, progress, "complete")
    arrive(third, 2 * third)
    arrive(2 * third, len(rows))
    stream.run(report, out, progress, "complete")
    stream.run(report, out, progress, "complete")  # nothing new
    found = stream.whole(spark, out, report.schema)
    known = spark.createDataFrame([x for x in rows if x[6] is not None], SCHEMA)
    want = known.groupBy("country", F.date_format("invoice_ts", "yyyy-MM").alias("year_month"))
    want = want.agg(F.sum(F.col("quantity") * F.col("price")).alias("revenue"), F.sum("quantity").alias("units"))
    assert values(found) == values(want.select(found.columns))


def test_customers_over_a_failure(spark, arrivals, monkeypatch):
    """A batch that fails after it was written is written again, and counts once."""
    path, rows, arrive = arrivals
    out, progress = new_folder(spark, "out"), new_folder(spark, "progress")
    figures = stream.customer_figures(read(spark, path), "1 hour")
    half = next(k for k in range(len(rows) // 2, len(rows)) if rows[k][0] != rows[k - 1][0])
    arrive(0, half + 1)  # one invoice comes in two files
    arrive(half + 1, len(rows))
    failed = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{stream.BATCH}={number}")
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost on the way")

    writer = figures.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True)
    with pytest.raises(Exception, match="lost on the way"):
        writer.foreachBatch(write).start().awaitTermination()
    assert failed
    stream.run(figures, out, progress, "update")
    newest = stream.newest(spark, out, figures.schema, "customer_id")
    batch = spark.createDataFrame(rows, SCHEMA).fillna({"customer_id": "Unknown"}).withColumn("revenue", F.col("quantity") * F.col("price"))
    assert values(stream.rfm(newest, rows[-1][4])) == values(rfm.rfm(batch))


def test_late_lines_are_left_out_beyond_the_delay(spark):
    path, out, progress = (new_folder(spark, "late") for _ in range(3))
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    report = stream.revenue_by(read(spark, path), "hour")

    def arrive(*rows):
        spark.createDataFrame([(i, "s", 1.0, 1.0, T0 + dt.timedelta(minutes=m), "1", "UK") for i, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)

    for rows in ([("a", 0), ("b", 300)], [("c", 290), ("a", 0)], [("d", 10), ("e", 301), ("b", 300)]):
        arrive(*rows)
        stream.run(report, out, progress, "complete")
    found = {r.hour: r.units for r in stream.whole(spark, out, report.schema).collect()}
    # c is within the hour; the second a and d are not; the second b is a copy.
    assert found == {0: 1.0, 4: 1.0, 5: 2.0}


def test_an_empty_folder(spark):
    path, out, progress = (new_folder(spark, "empty") for _ in range(3))
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    report = stream.customer_figures(read(spark, path), "1 hour")
    stream.run(report, out, progress, "update")
    spark.createDataFrame([], report.schema).write.mode("append").parquet(f"{out}/{stream.BATCH}=0")
    assert stream.newest(spark, out, report.schema, "customer_id").count() == 0


def test_arriving_files_are_made_by_many_tasks(spark):
    from tallymill.catalog.queries import _arrivals

    start = F.timestamp_seconds(F.col("id") * 60)
    rows = spark.range(0, 400, 1, 4).select(start.alias("invoice_ts"), F.lit("view").alias("stock_code"), F.spark_partition_id().alias("task"))
    back = spark.read.parquet(_arrivals(rows))
    assert back.count() == 400
    assert back.select("task").distinct().count() == 4
