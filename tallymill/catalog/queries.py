"""The registered queries: every operator over whole test tables.

Floating results are rounded, since the order of a distributed sum is not fixed, and
dates are text, so that the same values come out of any engine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill import fixtures as fx
from tallymill.functions.moments import LinearFit
from tallymill.operators import basket, cleaning, clusters, forecast, kpis, models, pricing, reservoir, rfm, rollups, shredding, summaries, temporal, visits
from tallymill.operators import samples as sm
from tallymill.operators import series as ts
from tallymill.plans import demand
from tallymill.schema import COMPETITOR_COLUMNS, SALES_COLUMNS, half_even
from tallymill.session import new_folder, stored
from tallymill.sources import read_competitor_prices, read_sales, read_segment_sales, write_in_batches, write_table
from tallymill.sources.checked import read_sales_checked
from tallymill.sources.incremental import add_load, read_loads
from tallymill.sources.readers import column_check, preview
from tallymill.streaming import sales as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    # A trailing underscore keeps the name of an import free.
    QUERIES[run.__name__.rstrip("_")] = run
    return run


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), digits) for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def with_time_text(df: DataFrame) -> DataFrame:
    return df.withColumn("invoice_ts", F.date_format("invoice_ts", "yyyy-MM-dd HH:mm:ss"))


# Sources and cleaning


@query
def column_check_(spark, sf):
    rows = fx.retail(spark, sf)
    return column_check(rows).withColumn("rows", rows.agg(F.count("*")).scalar())


@query
def preview_(spark, sf):
    rows = fx.retail(spark, sf, "invoice", "stock_code", "quantity", "price")
    return preview(rows, ["invoice", "stock_code", "quantity", "price"])


def _written(df: DataFrame, name: str, fmt: str = "csv", partition_by=(), **options) -> str:
    """Write to a new place in the shared folder and return its path."""
    path = new_folder(df.sparkSession, name)
    write_table(df, path, fmt, partition_by, **options)
    return path


@query
def sales_csv(spark, sf):
    """All dirty sales through a Latin-1 CSV file and back."""
    rows = fx.retail_dirty(spark, sf)
    rows = rows.withColumn("invoice_ts", F.date_format("invoice_ts", "M/d/yyyy H:mm"))
    source = rows.withColumnsRenamed({v: k for k, v in SALES_COLUMNS.items()})
    back = read_sales(spark, _written(source, "sales", encoding="ISO-8859-1"))
    return with_time_text(cleaning.add_calendar(back)).select(*fx.COLUMNS)


@query
def competitor_csv(spark, sf):
    """Competitor prices through a file whose date column is called Date."""
    source = fx.competitor(spark, sf).withColumnsRenamed({v: k for k, v in COMPETITOR_COLUMNS.items()})
    path = _written(source.withColumnRenamed("day", "Date"), "competitor")
    rows = ts.daily_competitor_prices(read_competitor_prices(spark, path))
    return as_text(rounded(rows, 4, "our_price", *ts.COMPETITORS), "day")


def _exported(df: DataFrame, name: str) -> str:
    """Sales with their customer's group written as compressed CSV, which takes several times the
    bytes of the tables otherwise, and its path."""
    path = new_folder(df.sparkSession, name)
    write_in_batches(df, path, "customer_id", compression="gzip")
    return path


def _through_csv(df: DataFrame, name: str) -> DataFrame:
    """All columns written as CSV and read back under their types."""
    path = _exported(df, name)
    spark = df.sparkSession
    return spark.read.option("header", True).option("escape", '"').schema(df.schema).csv(path)


@query
def segment_sales_csv(spark, sf):
    """The full sales with their segment exported; the file as a source of units per group and day."""
    path = _exported(_sales_with_segments(spark, sf), "segment-sales")
    units = read_segment_sales(spark, path).groupBy("day", "segment").agg(F.sum("quantity").alias("quantity"))
    return as_text(units, "day")


@query
def sales_with_segments_csv(spark, sf):
    """The full sales with their segment, through a CSV file."""
    return _through_csv(with_time_text(_sales_with_segments(spark, sf)), "sales-with-segments")


@query
def segment_summary_csv(spark, sf):
    summary = rfm.group_summary(_segmented(spark, sf))
    path = _written(summary, "segment-summary")
    return spark.read.option("header", True).option("escape", '"').schema(summary.schema).csv(path)


@query
def cluster_summary_csv(spark, sf):
    summary = rfm.group_summary(_named(spark, sf), "cluster_name")
    path = _written(summary, "cluster-summary")
    return spark.read.option("header", True).option("escape", '"').schema(summary.schema).csv(path)


def _sales_with_clusters(spark, sf) -> DataFrame:
    # Stored, since the hot customers and the join each read the sales.
    rows = stored(fx.sales(spark, sf, *fx.COLUMNS), "sales", compression="zstd")
    return with_time_text(rfm.attach_group(rows, _named(spark, sf), "cluster_name"))


@query
def sales_with_clusters(spark, sf):
    """The full sales with their cluster name, through parquet partitioned by it."""
    joined = _sales_with_clusters(spark, sf)
    path = _written(joined, "sales-with-clusters", "parquet", ("cluster_name",))
    return spark.read.schema(joined.schema).parquet(path).select(*joined.columns)


@query
def sales_with_clusters_csv(spark, sf):
    """The full sales with their cluster name, through a CSV file."""
    return _through_csv(_sales_with_clusters(spark, sf), "sales-with-clusters")


@query
def clean_positive(spark, sf):
    return with_time_text(cleaning.keep_positive(fx.retail_dirty(spark, sf)))


@query
def clean_iqr(spark, sf):
    return with_time_text(cleaning.remove_outliers(cleaning.keep_positive(fx.retail_dirty(spark, sf))))


@query
def clean_impute(spark, sf):
    return with_time_text(cleaning.impute(fx.retail_dirty(spark, sf)))


@query
def clean_features(spark, sf):
    return with_time_text(cleaning.add_features(fx.retail_events(spark, sf)))


@query
def clean_full(spark, sf):
    return with_time_text(cleaning.clean(fx.retail_dirty(spark, sf)))


@query
def distinct_products(spark, sf):
    return cleaning.distinct_products(fx.retail(spark, sf, "description"))


@query
def distinct_stock_codes(spark, sf):
    return cleaning.distinct_stock_codes(fx.retail(spark, sf, "stock_code"))


# Roll-ups


@query
def monthly_revenue(spark, sf):
    return rounded(rollups.monthly_revenue(fx.sales(spark, sf, "invoice_ts")), 2, "revenue")


@query
def weekday_revenue(spark, sf):
    return rounded(rollups.weekday_revenue(fx.sales(spark, sf, "invoice_ts")), 2, "revenue")


@query
def hourly_revenue(spark, sf):
    return rounded(rollups.hourly_revenue(cleaning.add_features(fx.retail_events(spark, sf))), 2, "revenue")


@query
def country_revenue(spark, sf):
    return rounded(rollups.country_revenue(fx.sales(spark, sf, "country")), 2, "revenue")


@query
def top_products(spark, sf):
    return rounded(rollups.top_products(fx.sales(spark, sf, "description")), 2, "revenue")


@query
def bottom_products(spark, sf):
    return rounded(rollups.bottom_products(fx.sales(spark, sf, "description")), 2, "revenue")


@query
def bottom_countries(spark, sf):
    return rounded(rollups.bottom_countries(fx.sales(spark, sf, "country")), 2, "revenue")


@query
def new_vs_returning(spark, sf):
    rows = fx.retail_dirty(spark, sf, "invoice", "customer_id", "quantity", "price")
    rows = cleaning.keep_positive(cleaning.fill_customers(rows))
    return rounded(rollups.new_vs_returning(cleaning.add_revenue(rows)), 2, "revenue")


@query
def avg_order_value(spark, sf):
    return rounded(rollups.average_order_value(fx.sales(spark, sf, "invoice", "invoice_ts")), 3, "avg_order_value")


@query
def market_basket(spark, sf):
    return basket.market_basket(fx.retail(spark, sf, "invoice", "description"))


@query
def sales_kpis(spark, sf):
    rows = fx.sales(spark, sf, "invoice_ts", "description", "country")
    return rounded(kpis.sales_kpis(rows), 2, "revenue")


@query
def sales_kpis_by_hour(spark, sf):
    """The same figures where sales have a time of day."""
    rows = cleaning.add_features(fx.retail_events(spark, sf))
    return rounded(kpis.sales_kpis(rows), 2, "revenue")


@query
def product_kpis(spark, sf):
    rows = fx.sales(spark, sf, "description", "country")
    return rounded(rollups.product_kpis(rows), 2, "revenue", "units", "avg_price")


@query
def product_sales(spark, sf):
    """The drill-down to one product."""
    return with_time_text(rollups.product(fx.retail(spark, sf), "red widget"))


@query
def product_trends(spark, sf):
    rows = fx.sales(spark, sf, "invoice_ts", "description", "country")
    return rounded(kpis.product_trends(rows), 2, "revenue")


@query
def product_sales_kpis(spark, sf):
    rows = fx.sales(spark, sf, "invoice_ts", "description", "country")
    return rounded(kpis.sales_kpis(rows, by=["description"]), 2, "revenue")


# Customer segments


def _rfm(spark, sf) -> DataFrame:
    return rfm.rfm(fx.sales(spark, sf, "invoice", "invoice_ts", "customer_id"))


def _segmented(spark, sf) -> DataFrame:
    return rfm.segment_customers(_rfm(spark, sf))


@query
def rfm_(spark, sf):
    return rounded(_rfm(spark, sf), 2, "monetary")


@query
def rfm_subday(spark, sf):
    return rounded(rfm.rfm(cleaning.add_features(fx.retail_events(spark, sf))), 2, "monetary")


@query
def rfm_scores(spark, sf):
    return rfm.score(_rfm(spark, sf)).select("customer_id", "r_score", "f_score", "m_score")


@query
def rfm_segments(spark, sf):
    return _segmented(spark, sf).select("customer_id", "segment", "action")


@query
def segment_actions(spark, sf):
    return rfm.segment_actions(_segmented(spark, sf))


@query
def segment_counts(spark, sf):
    return rfm.group_counts(_segmented(spark, sf))


@query
def segment_sales(spark, sf):
    return rounded(rfm.group_sales(_segmented(spark, sf)), 2, "monetary")


@query
def segment_share(spark, sf):
    shares = rfm.group_shares(_segmented(spark, sf))
    return rounded(shares, 4, "revenue", "customer_share", "revenue_share")


@query
def segment_summary(spark, sf):
    return rfm.group_summary(_segmented(spark, sf))


@query
def segment_kpis(spark, sf):
    kpi = rfm.group_kpis(_segmented(spark, sf))
    return rounded(kpi, 4, "revenue", "customer_share", "revenue_share")


def _sales_with_segments(spark, sf) -> DataFrame:
    """Sales without a customer are kept out of the groups, to show the default name."""
    rows = fx.retail_dirty(spark, sf)
    # Stored, since the groups, the hot customers and the join each read the sales.
    rows = stored(cleaning.add_features(cleaning.fill_customers(cleaning.keep_positive(rows))), "sales", compression="zstd")
    known = rfm.segment_customers(rfm.rfm(rows, include_unknown=False))
    return rfm.attach_group(rows, known)


@query
def sales_with_segments(spark, sf):
    return with_time_text(_sales_with_segments(spark, sf))


# Customer clusters


def _fixed_clusters(spark, sf) -> DataFrame:
    return _rfm(spark, sf).withColumn("cluster", (F.col("customer_id").cast("bigint") % 4).cast("int"))


def _named(spark, sf) -> DataFrame:
    return clusters.add_cluster_names(_fixed_clusters(spark, sf))


@query
def rfm_scaled(spark, sf):
    scaled = clusters.scaled_columns(_rfm(spark, sf)).select("customer_id", *clusters.SCALED)
    return rounded(scaled, 6, *clusters.SCALED)


@query
def elbow(spark, sf):
    return clusters.elbow(_rfm(spark, sf))


@query
def kmeans(spark, sf):
    return clusters.cluster_customers(_rfm(spark, sf)).select("customer_id", "cluster")


@query
def cluster_names(spark, sf):
    return clusters.cluster_names(_fixed_clusters(spark, sf))


@query
def cluster_summary(spark, sf):
    return rfm.group_summary(_named(spark, sf), "cluster_name")


@query
def cluster_sales(spark, sf):
    return rounded(rfm.group_sales(_named(spark, sf), "cluster_name"), 2, "monetary")


@query
def cluster_share(spark, sf):
    shares = rfm.group_shares(_named(spark, sf), "cluster_name")
    return rounded(shares, 4, "revenue", "customer_share", "revenue_share")


@query
def cluster_means(spark, sf):
    means = clusters.cluster_means(_named(spark, sf))
    return rounded(means, 4, *[f"avg_{m}" for m in clusters.METRICS])


@query
def cluster_profile(spark, sf):
    return clusters.cluster_profile(_named(spark, sf))


# Daily series


def _series(spark, sf) -> DataFrame:
    return ts.fill_prices(ts.daily_series(fx.retail_brand(spark, sf)))


def _features(spark, sf) -> DataFrame:
    return ts.feature_table(fx.retail_brand(spark, sf))


def _lag_names() -> list[str]:
    return [f"lag_{i}_days" for i in ts.LAGS]


def _rolling_names() -> list[str]:
    return [f"rolling_{kind}_{w}_days" for w in ts.WINDOWS for kind in ("mean", "std")]


@query
def daily_series(spark, sf):
    series = ts.daily_series(fx.retail_brand(spark, sf))
    return as_text(rounded(series, 4, "our_price"), "day")


@query
def one_series(spark, sf):
    """The series of a single stock code."""
    series = ts.daily_series(fx.retail_brand(spark, sf), ["Brand#12"])
    return as_text(rounded(series, 4, "our_price"), "day")


@query
def price_fill(spark, sf):
    return as_text(rounded(_series(spark, sf), 4, "our_price"), "day")


@query
def competitor_join(spark, sf):
    joined = ts.join_competitor_prices(_series(spark, sf), fx.competitor(spark, sf))
    return as_text(rounded(joined, 4, "our_price", *ts.COMPETITORS), "day")


@query
def segment_join(spark, sf):
    joined = ts.join_segment_sales(_series(spark, sf).drop("our_price"), fx.segment_sales(spark, sf))
    return as_text(joined, "day")


@query
def calendar_features(spark, sf):
    return as_text(ts.add_calendar_features(_series(spark, sf).drop("our_price")), "day")


@query
def lags(spark, sf):
    return as_text(ts.add_lags(_series(spark, sf).drop("our_price")), "day")


@query
def rolling(spark, sf):
    rows = ts.add_rolling(_series(spark, sf).drop("our_price"))
    return as_text(rounded(rows, 6, *_rolling_names()), "day")


@query
def holiday_flag(spark, sf):
    return as_text(ts.add_holidays(_series(spark, sf).drop("our_price")), "day")


@query
def asof_prices(spark, sf):
    """Each sale with the list price in force, and with the one before its moment."""
    sales = fx.retail(spark, sf, "stock_code", "invoice_ts", "quantity")
    changes = fx.price_changes(spark, sf)
    found = temporal.asof_join(sales, changes, ["stock_code"], "invoice_ts", ["list_price"])
    earlier = changes.withColumnRenamed("list_price", "earlier_price")
    found = temporal.asof_join(found, earlier, ["stock_code"], "invoice_ts", ["earlier_price"], strict=True)
    return with_time_text(rounded(found, 6, "list_price", "earlier_price"))


@query
def price_changes(spark, sf):
    """Competitor prices that hold until changed, beside the daily series."""
    rows = ts.join_price_changes(_series(spark, sf).drop("our_price"), fx.competitor_changes(spark, sf))
    return as_text(rounded(rows, 6, "competitor_a", "competitor_b"), "day")


@query
def promotion_sales(spark, sf):
    """Days and units of a brand within each of its promotion periods."""
    pairs = temporal.between_join(_series(spark, sf), fx.promotions(spark, sf), "day", "first_day", "last_day", [ts.KEY])
    sums = pairs.groupBy(ts.KEY, "first_day", "last_day").agg(F.count("*").alias("days"), F.sum("quantity").alias("units"))
    return as_text(sums, "first_day", "last_day")


@query
def promotion_overlaps(spark, sf):
    """Periods of urgent orders of a brand with those of its high-priority orders that they overlap."""
    other = fx.promotions(spark, sf, "2-HIGH").withColumnsRenamed({"first_day": "from_day", "last_day": "to_day"})
    pairs = temporal.overlap_join(fx.promotions(spark, sf), other, [("first_day", "last_day"), ("from_day", "to_day")], [ts.KEY])
    common = F.datediff(F.least("last_day", "to_day"), F.greatest("first_day", "from_day")) + 1
    sums = pairs.groupBy(ts.KEY, "first_day", "last_day").agg(F.count("*").alias("overlaps"), F.sum(common).alias("common_days"))
    return as_text(sums, "first_day", "last_day")


def _in_loads(df: DataFrame, *loads: tuple[str, Column]) -> str:
    """Folder of a table that these loads, each a part of `df`, have gone into one after the other."""
    path = new_folder(df.sparkSession, "loads")
    for name, part in loads:
        add_load(df.filter(part), path, name)
    return path


@query
def summary_rollup(spark, sf):
    """Months and countries from a daily summary by product that came in two loads: the sales are
    read for the summary only. Few enough customers a month for the sketch to be exact."""
    summary = summaries.summarize(fx.retail(spark, sf, "stock_code", "country", "invoice_ts", "quantity", "price", "customer_id", "invoice"))
    path = _in_loads(summary, ("late", F.col("day") >= "1996-03-10"), ("early", F.col("day") < "1996-03-10"))
    found = summaries.roll_up(read_loads(spark, path, summary.schema), ["country", "year_month"])
    found = found.select("country", "year_month", "lines", "units", "revenue", "customers", "invoices")
    return rounded(found, 2, "revenue")


@query
def incremental_loads(spark, sf):
    """Sales with their customer group in a table by month: loads that come late, twice and in a
    corrected form. Rows of each load and month."""
    rows = _sales_with_segments(spark, sf).withColumn("year_month", F.date_format("invoice_ts", "yyyy-MM"))
    a, b = F.col("year_month") >= "1996-01", F.col("quantity") > 25
    path = _in_loads(rows, ("new", a), ("old", ~a & b), ("old", ~a), ("new", a), ("new", a & b))
    whole = read_loads(spark, path, rows.schema)
    return rounded(whole.groupBy("load", "year_month", "segment").agg(F.count("*").alias("rows"), F.sum("quantity").alias("units")), 2, "units")


def _arrivals(df: DataFrame, parts: int = 4) -> str:
    """Folder into which the sales have come in files by time, some of them twice."""
    path = new_folder(df.sparkSession, "arrivals")
    seconds = F.col("invoice_ts").cast("double")
    edges = df.select(seconds.alias("s")).approxQuantile("s", [k / parts for k in range(1, parts)], 0.01)
    for low, high in zip([float("-inf"), *edges], [*edges, float("inf")], strict=True):
        part = df.filter((seconds >= low) & (seconds < high))
        part.unionByName(part.filter(F.col("stock_code") == "click")).repartition(1).write.mode("append").parquet(path)
    return path


def _stream(spark, sf) -> DataFrame:
    sales = fx.retail_events(spark, sf).withColumn("invoice_ts", F.col("invoice_ts").cast("timestamp"))
    lines = stream.read_files(spark, _arrivals(sales), sales.schema, files_per_batch=1)
    return stream.distinct_lines(lines, ["invoice", "stock_code"], "1 hour")


@query
def stream_revenue(spark, sf):
    """Revenue by country and weekday of files that arrive one after the other, lines that come
    twice counted once."""
    report = stream.revenue_by(_stream(spark, sf), "country", "weekday_no")
    path = new_folder(spark, "stream-revenue")
    stream.run(report, path, new_folder(spark, "stream-checkpoint"), "complete")
    return rounded(stream.whole(spark, path, report.schema), 2, "revenue", "units")


@query
def stream_rfm(spark, sf):
    """RFM figures from the state that is kept for each customer."""
    figures = stream.customer_figures(_stream(spark, sf), "1 hour")
    path = new_folder(spark, "stream-customers")
    stream.run(figures, path, new_folder(spark, "stream-checkpoint"), "update")
    newest = stream.newest(spark, path, figures.schema, "customer_id")
    last = newest.agg(F.max("last_purchase")).first()[0]
    return rounded(stream.rfm(newest, last), 2, "monetary")


@query
def visits_by_gap(spark, sf):
    """Visits of the users: events with no gap of more than six hours."""
    found = visits.visits(fx.table(spark, sf, "events"), ["user_id"], "ts", "6 hours", ["value"])
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("visit_start", "visit_end")}
    return rounded(found.withColumns(times), 4, "value")


@query
def event_properties(spark, sf):
    """The properties of the events as typed columns."""
    events = fx.table(spark, sf, "events").select("event_id", "event_type", "props")
    return shredding.shredded(events, "props").drop("props")


@query
def sales_faults(spark, sf):
    """A sales file with words for numbers and times: the good rows by stock code, the others by reason."""
    rows = fx.retail(spark, sf, "invoice", "stock_code", "quantity", "invoice_ts", "price")
    number = F.col("invoice").cast("long")
    planted = rows.select(
        F.col("invoice").alias("Invoice"),
        F.col("stock_code").alias("StockCode"),
        F.when(number % 13 == 0, "many").otherwise(F.col("quantity").cast("string")).alias("Quantity"),
        F.when(number % 17 == 0, "soon").otherwise(F.date_format("invoice_ts", "yyyy-MM-dd HH:mm:ss")).alias("InvoiceDate"),
        F.when(number % 19 == 0, "1,50 each").otherwise(F.col("price").cast("string")).alias("Price"),
    )
    checked = read_sales_checked(spark, _written(planted, "faulty-sales"))
    good = checked.good.groupBy("stock_code").agg(F.count("*").alias("rows"), F.sum("quantity").alias("units"))
    bad = checked.bad.groupBy(F.array_join("reasons", ", ").alias("reason")).agg(F.count("*").alias("rows"))
    good = good.withColumn("reason", F.lit(None).cast("string"))
    return rounded(good.unionByName(bad, allowMissingColumns=True), 2, "units")


@query
def holidays_of_other_eras(spark, sf):
    """The order days moved by whole leap cycles, to years from 1890 on and from 2090 on."""
    days = fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("at")).distinct()
    moved = days.select(F.explode(F.array(*[F.add_months("at", 12 * y) for y in (-104, -28, -16, 100, 300)])).alias("day"))
    return as_text(ts.add_holidays(moved.distinct()), "day")


@query
def segment_join_colliding(spark, sf):
    """Groups whose names differ by case or marks only get a column each."""
    name = F.when(F.col("segment") == "BUILDING", "a-b").when(F.col("segment") == "FURNITURE", "A b")
    sales = fx.segment_sales(spark, sf).withColumn("segment", name.when(F.col("segment") == "HOUSEHOLD", "A-B").otherwise(F.col("segment")))
    return as_text(ts.join_segment_sales(_series(spark, sf).drop("our_price"), sales), "day")


@query
def feature_table(spark, sf):
    rows = rounded(_features(spark, sf), 4, "our_price")
    return as_text(rounded(rows, 6, *_rolling_names()), "day")


def _products(spark, sf) -> DataFrame:
    """Sales by single stock code: as many series as there are products."""
    return fx.retail(spark, sf, "stock_code", "quantity", "invoice_ts", "price")


@query
def feature_table_products(spark, sf):
    """The features of every product: its days, and the sum of each feature over them."""
    rows = ts.feature_table(_products(spark, sf))
    names = [c for c in rows.columns if c not in (ts.KEY, ts.DAY)]
    sums = rows.groupBy(ts.KEY).agg(F.count("*").alias("days"), *[F.sum(F.col(c).cast("double")).alias(c) for c in names])
    return rounded(sums, 3, *names)


@query
def forecast_linear_products(spark, sf):
    """A linear model of yesterday over all products with enough days: test error and the next
    day of each, or the reason why it has none."""
    run = demand.forecast_table(ts.day_spans(_products(spark, sf)), "linear", seq_length=1, horizon=1, reg_grid=(0.0,))
    found = run.metrics.join(run.future, ts.KEY).select(ts.KEY, "mae", "rmse", "future_forecast", F.lit(None).cast("string").alias("reason"))
    missing = run.rejects.select(ts.KEY, *[F.lit(None).cast("double").alias(c) for c in ("mae", "rmse", "future_forecast")], "reason")
    answer = stored(rounded(found.unionByName(missing), 4, "mae", "rmse", "future_forecast"), "product-forecasts")
    run.release()
    return answer


@query
def minmax(spark, sf):
    scaled = sm.min_max_scale(_features(spark, sf))
    columns = sm.scaled_features(scaled)
    return as_text(rounded(scaled.select(ts.KEY, ts.DAY, *columns), 6, *columns), "day")


def _place(place: int) -> Callable[[Column], Column]:
    return lambda step: step[place]


@query
def sequences(spark, sf):
    """Windows of all features, three targets ahead. Each window is reduced to its length, its
    ends and the bounds of each feature, each target to a column, to compare plain values."""
    scaled = sm.min_max_scale(_features(spark, sf))
    names = sm.scaled_features(scaled)
    rows = sm.sequences(scaled, horizon=3)
    result = rows.select(
        ts.KEY,
        ts.DAY,
        "sample",
        F.size("window").alias("days"),
        *[F.col("window")[0][i].alias(f"first_{c}") for i, c in enumerate(names)],
        *[F.element_at("window", -1)[i].alias(f"last_{c}") for i, c in enumerate(names)],
        *[F.array_min(F.transform("window", _place(i))).alias(f"low_{c}") for i, c in enumerate(names)],
        *[F.array_max(F.transform("window", _place(i))).alias(f"high_{c}") for i, c in enumerate(names)],
        *[F.col("target")[i].alias(f"target_{i}") for i in range(3)],
    )
    ends = ("first_", "last_", "low_", "high_", "target_")
    return as_text(rounded(result, 6, *[c for c in result.columns if c.startswith(ends)]), "day")


@query
def split(spark, sf):
    return as_text(sm.split(sm.numbered_days(_series(spark, sf))).drop("samples"), "day")


@query
def forecast_rejects(spark, sf):
    """History of every single stock code; the short ones carry a reason."""
    series = ts.daily_series(fx.retail(spark, sf, "stock_code", "quantity", "invoice_ts", "price"))
    return sm.usable(series)


# Forecasts. The fixed tables stand for a model's output.


def _fixed_predictions(spark, sf) -> DataFrame:
    lagged = ts.add_lags(_series(spark, sf), lags=(7,))
    return lagged.filter(F.col("lag_7_days").isNotNull()).select(
        ts.KEY, ts.DAY, F.col("quantity").alias("actual"), F.col("lag_7_days").alias("predicted")
    )


def _fixed_future(spark, sf) -> DataFrame:
    """The last 30 days of each series once more, 10 percent up and 3 items down."""
    series = _series(spark, sf)
    place = F.row_number().over(Window.partitionBy(ts.KEY).orderBy(F.desc(ts.DAY)))
    recent = series.withColumn("_back", place).filter(F.col("_back") <= 30)
    return recent.select(
        ts.KEY,
        F.date_add(ts.DAY, 30).alias(ts.DAY),
        (F.lit(31) - F.col("_back")).alias("step"),
        (F.col("quantity") * 1.1 - 3.0).alias("future_forecast"),
    )


@query
def forecast_metrics(spark, sf):
    return rounded(forecast.metrics(_fixed_predictions(spark, sf)), 4, "mae", "rmse")


@query
def forecast_overall_metrics(spark, sf):
    return rounded(forecast.overall_metrics(_fixed_predictions(spark, sf)), 4, "mae", "rmse")


@query
def forecast_series(spark, sf):
    rows = forecast.combined_series(_fixed_predictions(spark, sf), _fixed_future(spark, sf))
    return as_text(rounded(rows, 4, "value"), "day")


@query
def forecast_weekday(spark, sf):
    return rounded(forecast.forecast_by_weekday(_fixed_future(spark, sf)), 4, "future_forecast")


@query
def forecast_growth(spark, sf):
    rows = forecast.growth(_series(spark, sf), _fixed_future(spark, sf))
    return rounded(rows, 4, "past_avg", "future_avg", "growth_pct")


@query
def forecast_rounded(spark, sf):
    return as_text(forecast.rounded_forecast(_fixed_future(spark, sf)), "day")


@query
def forecast_kpis(spark, sf):
    rows = forecast.forecast_kpis(
        _series(spark, sf), _fixed_predictions(spark, sf), _fixed_future(spark, sf)
    )
    return rounded(rows, 4, "safety_stock", "next_7_days", "growth_pct")


def _released(run: demand.Forecast) -> demand.Forecast:
    """What is checkpointed can still be read."""
    run.release()
    return run


@query
def forecast_linear(spark, sf):
    return as_text(_released(demand.forecast(fx.retail_brand(spark, sf), "linear")).combined, "day")


@query
def forecast_gbt(spark, sf):
    return as_text(_released(demand.forecast(fx.retail_brand(spark, sf), "gbt")).combined, "day")


@query
def forecast_reservoir(spark, sf):
    return as_text(_released(demand.forecast(fx.retail_brand(spark, sf), "reservoir")).combined, "day")


# Strengths of which the validation days choose one.
STRENGTHS = (0.0, 0.001, 0.01, 0.05, 0.2, 1.0)


@query
def ridge_choice(spark, sf):
    """The linear model of yesterday's quantity and price for several strengths: weights, the
    error on the validation days, and which strength wins."""
    scaled = sm.min_max_scale(_series(spark, sf))
    parts = sm.split(sm.samples(scaled, 1))
    model = models.fit(parts, sm.scaled_features(scaled), "linear", 1, reg_grid=STRENGTHS)
    rows = [(f.strength, f.intercept, *f.coefficients.toArray().tolist(), f.validation_mse, f is model.model) for f in model.tried]
    names = "strength double, constant double, by_quantity double, by_price double, validation_mse double, chosen boolean"
    return rounded(spark.createDataFrame(rows, names), 7, "constant", "by_quantity", "by_price", "validation_mse")


@query
def reservoir_path(spark, sf):
    """Ten days ahead by a reservoir of two units and a readout that are given: the state is
    folded over all days of a product, then over its own predictions."""
    fixed = reservoir.Reservoir(
        ["quantity", "our_price"],
        inputs=np.array([[0.5, -0.3], [0.2, 0.4]]),
        recurrent=np.array([[0.4, 0.1], [-0.2, 0.5]]),
        bias=np.array([0.1, -0.1]),
        leak=0.5,
    )
    readout = LinearFit(DenseVector([0.3, -0.2, 0.5, 0.1]), 0.05, 0.0)
    model = models.DemandModel("reservoir", readout, 1, fixed.features, reservoir=fixed)
    ahead = forecast.future(model, sm.min_max_scale(_series(spark, sf)), horizon=10)
    return as_text(rounded(ahead, 4, "future_forecast"), "day")


# Prices


def _prices(spark, sf) -> DataFrame:
    return pricing.current_prices(_series(spark, sf))


def _fixed_curve(spark, sf) -> DataFrame:
    """Demand that falls linearly with the price."""
    grid = pricing.price_grid(_prices(spark, sf))
    fall = F.lit(100.0) - F.lit(60.0) * F.col("price") / F.col("current_price")
    return pricing.price_curve(grid.withColumn("quantity", F.greatest(F.lit(0.0), fall)))


@query
def price_grid(spark, sf):
    return rounded(pricing.price_grid(_prices(spark, sf)), 6, "current_price", "price")


@query
def price_curve_fixed(spark, sf):
    columns = ("current_price", "price", "total_predicted_quantity", "total_predicted_revenue")
    return rounded(pricing.flag_best(_fixed_curve(spark, sf)), 4, *columns)


@query
def best_price(spark, sf):
    columns = ("current_price", "price", "total_predicted_quantity", "total_predicted_revenue")
    return rounded(pricing.best_price(_fixed_curve(spark, sf)), 4, *columns)


@query
def price_uplift(spark, sf):
    rows = pricing.price_uplift(_fixed_curve(spark, sf))
    columns = [f.name for f in rows.schema if f.dataType.typeName() == "double"]
    return rounded(rows, 4, *columns)


@query
def price_recommendation(spark, sf):
    return _uplift(demand.forecast(fx.retail_brand(spark, sf), "linear"))


def _uplift(run: demand.Forecast) -> DataFrame:
    uplift = demand.recommend_prices(run)["uplift"]
    run.release()
    return uplift


# Models on data whose answer SQL can work out.


@query
def kmeans_planted(spark, sf):
    """Four groups of customers that lie far apart."""
    key = F.col("c_custkey")
    place = key % 4
    customers = fx.table(spark, sf, "customer").select(
        key.cast("string").alias("customer_id"),
        (place * 100 + key % 5).alias("recency"),
        ((3 - place) * 20 + key % 3).alias("frequency"),
        (place * place * 10000 + key % 7).cast("double").alias("monetary"),
    )
    return clusters.cluster_customers(customers).select("customer_id", "cluster")


@query
def elbow_planted(spark, sf):
    """Ten groups at growing distances: the closest ones share a cluster if there are fewer."""
    value = F.pow(F.lit(3.0), F.col("c_custkey") % 10)
    metrics = [value.alias(m) for m in clusters.METRICS]
    customers = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), *metrics)
    return rounded(clusters.elbow(customers), 2, "wcss")


def _yesterday(spark, sf, **options) -> demand.Forecast:
    """A linear model of yesterday's quantity and price, without a penalty."""
    return demand.forecast_table(_series(spark, sf), "linear", seq_length=1, reg_grid=(0.0,), **options)


@query
def forecast_linear_exact(spark, sf):
    run = _released(_yesterday(spark, sf, horizon=10))
    return as_text(rounded(run.combined, 3, "value"), "day")


@query
def price_recommendation_exact(spark, sf):
    rows = _uplift(_yesterday(spark, sf))
    return rounded(rows, 3, *[f.name for f in rows.schema if f.dataType.typeName() == "double"])


@query
def forecast_gbt_exact(spark, sf):
    """One tree with one cut: a day's quantity follows yesterday's price, which has two values."""
    number = F.datediff(F.col("day"), F.lit("1992-01-01").cast("date"))

    def price(day: Column) -> Column:
        return F.when(F.shiftright(day * day * 7 + day * 3, 2) % 2 == 0, 1.0).otherwise(2.0)

    quantity = 20 + 30 * (price(number - 1) - 1) + number % 5
    table = _series(spark, sf).select(
        ts.KEY, ts.DAY, quantity.cast("double").alias("quantity"), price(number).alias("our_price")
    )
    run = _released(demand.forecast_table(table, "gbt", seq_length=1, horizon=10, max_iter=1, max_depth=1))
    return as_text(rounded(run.combined, 3, "value"), "day")
