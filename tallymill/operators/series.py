"""Gap-free daily series per product and the features for forecasting.

After the daily totals, everything is a window over one product's days, so the table
is shuffled once by `stock_code` and stays there. A hot product is no hot group here:
it has at most one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.holidays import uk_holidays
from tallymill.functions.joins import if_small
from tallymill.operators.temporal import asof_join
from tallymill.session import checkpointed

KEY, DAY = "stock_code", "day"
# Of a row that stands for several days: how many.
SPAN = "days"
LAGS = (1, 7, 14, 30)
WINDOWS = (7, 14, 30)
# The years of Spark's dates.
YEARS = (1, 9999)
COMPETITORS = ("competitor_a", "competitor_b", "competitor_c")


def whole_series():
    return Window.partitionBy(KEY)


def by_day():
    return Window.partitionBy(KEY).orderBy(DAY)


def latest_days(series: DataFrame, n: int) -> DataFrame:
    """The last n days of each product, in the sort order that the other windows use."""
    left = F.count("*").over(whole_series()) - F.row_number().over(by_day())
    return series.withColumn("_left", left).filter(F.col("_left") < n).drop("_left")


def _filled(column: str) -> Column:
    """The last value so far, or the first value of the series before there is one."""
    so_far = by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A frame over the whole series is computed once; one that runs from each row to
    # the end would be summed up again for every row.
    whole = by_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.last(column, True).over(so_far), F.first(column, True).over(whole))


def sold_days(df: DataFrame, products=None) -> DataFrame:
    """The rows of `daily_series` that have a sale."""
    rows = df.dropna(subset=[KEY, "invoice_ts"])
    if products is not None:
        rows = rows.filter(F.col(KEY).isin(*products))
    return rows.groupBy(KEY, F.to_date("invoice_ts").alias(DAY)).agg(
        F.coalesce(F.sum("quantity"), F.lit(0.0)).cast("double").alias("quantity"),
        F.avg("price").alias("our_price"),
    )


def daily_series(df: DataFrame, products=None) -> DataFrame:
    """Units and mean price per product and day, with a row for every day between the
    first and the last sale: `stock_code`, `day`, `quantity`, `our_price`.

    A day without sales has quantity 0 and a null price. `products` limits the table
    to some stock codes.
    """
    sold = sold_days(df, products)
    # Each day brings the days up to the next sale, so no calendar has to be joined.
    last_gap_day = F.coalesce(F.date_sub(F.lead(DAY).over(by_day()), 1), F.col(DAY))
    spans = sold.withColumn("_days", F.sequence(F.col(DAY), last_gap_day))
    days = spans.select(KEY, F.col(DAY).alias("_sold"), "quantity", "our_price", F.explode("_days").alias(DAY))
    is_sale = F.col(DAY) == F.col("_sold")
    return days.select(
        KEY,
        DAY,
        F.when(is_sale, F.col("quantity")).otherwise(F.lit(0.0)).alias("quantity"),
        F.when(is_sale, F.col("our_price")).alias("our_price"),
    )


def day_spans(df: DataFrame, products=None) -> DataFrame:
    """`fill_prices(daily_series(df))` with one row per sold day: `days` counts it and the days
    without sales after it, which have its price and quantity 0. `every_day` makes the rest."""
    sold = fill_prices(sold_days(df, products).filter(F.col(DAY).isNotNull()))
    gap = F.datediff(F.lead(DAY).over(by_day()), DAY)
    return sold.withColumn(SPAN, F.coalesce(gap, F.lit(1)))


def every_day(spans: DataFrame) -> DataFrame:
    """One row per product and day from `day_spans`."""
    days = spans.withColumn("_after", F.explode(F.sequence(F.lit(0), F.col(SPAN) - 1)))
    columns = {
        DAY: F.date_add(DAY, F.col("_after")),
        "quantity": F.when(F.col("_after") == 0, F.col("quantity")).otherwise(F.lit(0.0)),
    }
    return days.select([columns.get(c, F.col(c)).alias(c) for c in spans.columns if c != SPAN])


def fill_prices(series: DataFrame) -> DataFrame:
    """A price of 0 counts as missing; gaps take the last price, leading gaps the first."""
    known = series.withColumn("our_price", F.when(F.col("our_price") != 0, F.col("our_price")))
    return known.withColumn("our_price", F.coalesce(_filled("our_price"), F.lit(0.0)))


def daily_competitor_prices(prices: DataFrame) -> DataFrame:
    """Mean of every price column per day; rows without a valid day are dropped."""
    columns = [f.name for f in prices.schema if isinstance(f.dataType, T.NumericType)]
    return prices.dropna(subset=[DAY]).groupBy(DAY).agg(*[F.avg(c).alias(c) for c in columns])


def join_competitor_prices(series: DataFrame, prices: DataFrame) -> DataFrame:
    """Add competitor prices by day. An `our_price` in the file replaces ours where present;
    competitor columns are filled forward, then backward, within a series."""
    # One row per day, checkpointed before its size is read.
    daily = checkpointed(daily_competitor_prices(prices).withColumnsRenamed({"our_price": "_our_price"}))
    joined = series.join(if_small(daily), DAY, "left")
    if "_our_price" in daily.columns:
        joined = joined.withColumn("our_price", F.coalesce("_our_price", "our_price")).drop("_our_price")
    return joined.withColumns({c: _filled(c) for c in COMPETITORS if c in daily.columns})


def join_price_changes(series: DataFrame, changes: DataFrame, columns=None) -> DataFrame:
    """Add the prices of `changes` (stock_code, day, prices) that are in force on each day: those of
    the product's latest change so far, null before the first one."""
    return asof_join(series, changes, [KEY], DAY, columns or [c for c in changes.columns if c not in (KEY, DAY)])


def segment_column(name: str) -> str:
    """Column name for a customer group, such as segment_at_risk."""
    return "segment_" + "".join(ch if ch.isalnum() else "_" for ch in name.lower())


def segment_columns(names) -> list[str]:
    """A column name for each group; of groups with the same one, the later are numbered."""
    taken: set[str] = set()
    columns = []
    for name in names:
        column, n = segment_column(name), 1
        while column in taken:
            n += 1
            column = f"{segment_column(name)}_{n}"
        taken.add(column)
        columns.append(column)
    return columns


def daily_segment_sales(sales: DataFrame, segments=None) -> DataFrame:
    """Units per day with one column per customer group, over all products.

    The sales are read once: their sums per day and group are checkpointed, and the group
    names, in sorted order, come from these. `segments` chooses groups and their order.
    """
    units = sales.dropna(subset=[DAY, "segment"]).groupBy(DAY, "segment").agg(F.sum("quantity").alias("units"))
    units = checkpointed(units)
    if segments is None:
        segments = sorted(r[0] for r in units.select("segment").distinct().collect())
    columns = segment_columns(segments)
    # Each group becomes a column, so there are no more rows here than columns.
    places = units.sparkSession.createDataFrame(
        [(name, f"s{i}") for i, name in enumerate(segments)], "segment string, place string"
    )
    wide = units.join(F.broadcast(places), "segment", "left").groupBy(DAY)
    wide = wide.pivot("place", [f"s{i}" for i in range(len(columns))]).agg(F.sum("units"))
    sums = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)).cast("double").alias(c) for i, c in enumerate(columns)]
    return wide.select(DAY, *sums)


def join_segment_sales(series: DataFrame, sales: DataFrame, segments=None) -> DataFrame:
    daily = checkpointed(daily_segment_sales(sales, segments))
    columns = [c for c in daily.columns if c != DAY]
    return series.join(if_small(daily), DAY, "left").fillna(0.0, subset=columns)


def add_calendar_features(series: DataFrame) -> DataFrame:
    """Weekday (Monday 0), month and ISO week."""
    return series.withColumns(
        {"day_of_week": F.weekday(DAY), "month": F.month(DAY), "week_of_year": F.weekofyear(DAY)}
    )


def add_lags(series: DataFrame, lags=LAGS) -> DataFrame:
    return series.withColumns({f"lag_{i}_days": F.lag("quantity", i).over(by_day()) for i in lags})


def add_rolling(series: DataFrame, windows=WINDOWS) -> DataFrame:
    """Mean and sample deviation of the w days before each day, null until there are w."""
    columns = {}
    for w in windows:
        frame = by_day().rowsBetween(-w, -1)
        full = F.count("quantity").over(frame) == w
        columns[f"rolling_mean_{w}_days"] = F.when(full, F.avg("quantity").over(frame))
        columns[f"rolling_std_{w}_days"] = F.when(full, F.stddev_samp("quantity").over(frame))
    return series.withColumns(columns)


def days_with_history(sold: DataFrame, lags=LAGS, windows=WINDOWS) -> DataFrame:
    """`sold_days` (with filled prices) as a gap-free series with the columns of `add_lags` and
    `add_rolling`, 0 where these have none.

    Up to the next sale, a day looks back on the same last quantities, then on zeros. So each
    sold day sums up its past once, and the days after it pick their figures from there: they
    are neither sorted nor held in windows. The moments of the last m + 1 days are carried on
    from day to day and joined with those of the zeros, so none is a difference of large sums.
    """
    reach = max(*lags, *windows)
    number = F.unix_date(F.col(DAY))
    past = Window.partitionBy(KEY).orderBy("_number").rangeBetween(-reach, 0)
    known = sold.filter(F.col(DAY).isNotNull()).withColumn("_number", number)
    known = known.select(
        KEY,
        DAY,
        "quantity",
        "our_price",
        "_number",
        F.min("_number").over(whole_series()).alias("_start"),
        F.lead("_number").over(Window.partitionBy(KEY).orderBy("_number")).alias("_next"),
        F.lead("quantity").over(Window.partitionBy(KEY).orderBy("_number")).alias("_next_quantity"),
        F.lead("our_price").over(Window.partitionBy(KEY).orderBy("_number")).alias("_next_price"),
        F.collect_list("_number").over(past).alias("_days"),
        F.collect_list("quantity").over(past).alias("_quantities"),
    )

    def quantity_before(i: Column) -> Column:
        return F.coalesce(F.get("_quantities", F.array_position("_days", F.col("_number") - i).cast("int") - 1), F.lit(0.0))

    def joined(moments: Column, x: Column) -> Column:
        n = F.size(moments) + 1
        before = F.coalesce(F.get(moments, n - 2), F.struct(*[F.lit(0.0).alias(c) for c in ("mean", "m2", "total")]))
        off = x - before["mean"]
        mean = before["mean"] + off / n
        m2, total = before["m2"] + off * (x - mean), before["total"] + x
        return F.concat(moments, F.array(F.struct(mean.alias("mean"), m2.alias("m2"), total.alias("total"))))

    back = F.transform(F.sequence(F.lit(0), F.lit(reach)), quantity_before)
    none = F.array().cast("array<struct<mean: double, m2: double, total: double>>")
    known = known.withColumn("_back", back).withColumn("_moments", F.aggregate("_back", none, joined))
    known = known.withColumns({f"_{c}": F.col(f"_moments.{c}") for c in ("mean", "m2", "total")})

    # The days after a sale up to and with the next one, and the first day of all.
    first = F.when(F.col("_number") == F.col("_start"), F.lit(0)).otherwise(F.lit(1))
    last = F.coalesce(F.col("_next") - F.col("_number"), F.lit(0))
    steps = F.when(first <= last, F.sequence(first, last))
    days = known.withColumn("_after", F.explode(steps))
    after = F.col("_after")
    age = F.col("_number") + after - F.col("_start")
    next_sale = (after > 0) & (F.col("_number") + after == F.col("_next"))
    columns = {
        "quantity": F.when(next_sale, F.col("_next_quantity")).when(after == 0, F.col("quantity")).otherwise(F.lit(0.0)),
        "our_price": F.when(next_sale, F.col("_next_price")).otherwise(F.col("our_price")),
    }
    for i in lags:
        columns[f"lag_{i}_days"] = F.when((after > 0) & (after <= i), F.get("_back", F.lit(i) - after)).otherwise(F.lit(0.0))
    for w in windows:
        inside = (after > 0) & (after <= w) & (age >= w)
        n = F.lit(w + 1) - after
        mean, m2, total = (F.get(c, F.lit(w) - after) for c in ("_mean", "_m2", "_total"))
        squares = m2 + mean * mean * n * (after - 1) / F.lit(float(w))
        columns[f"rolling_mean_{w}_days"] = F.when(inside, total / F.lit(float(w))).otherwise(F.lit(0.0))
        columns[f"rolling_std_{w}_days"] = F.when(inside & F.lit(w > 1), F.sqrt(squares / F.lit(float(max(w - 1, 1))))).otherwise(F.lit(0.0))
    return days.select(KEY, F.date_add(DAY, after).alias(DAY), *[c.alias(name) for name, c in columns.items()])


def add_holidays(series: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """1 on a holiday, else 0. `holidays` has a `day` column; the default are the UK's, by the
    rules of each year that a date can have. They are looked up in a small table, since the
    rules would take longer for each row than all other features."""
    if holidays is None:
        listed = uk_holidays(series.sparkSession, *YEARS).select(F.col(DAY).alias("_holiday"))
        joined = series.join(F.broadcast(listed), F.col(DAY) == F.col("_holiday"), "left")
        return joined.select(*series.columns, F.col("_holiday").isNotNull().cast("int").alias("is_holiday"))
    marked = checkpointed(holidays.select(DAY, F.lit(1).alias("is_holiday")).distinct())
    return series.join(if_small(marked), DAY, "left").fillna(0, subset=["is_holiday"])


def feature_table(
    df: DataFrame,
    products=None,
    competitor_prices: DataFrame | None = None,
    segment_sales: DataFrame | None = None,
    segments=None,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """The daily series of each product with every feature; remaining nulls become 0."""
    lagged = [f"lag_{i}_days" for i in LAGS]
    rolled = [f"rolling_{kind}_{w}_days" for w in WINDOWS for kind in ("mean", "std")]
    series = days_with_history(fill_prices(sold_days(df, products)))
    if competitor_prices is not None:
        series = join_competitor_prices(series, competitor_prices)
    if segment_sales is not None:
        series = join_segment_sales(series, segment_sales, segments)
    joined = [c for c in series.columns if c not in (KEY, DAY, *lagged, *rolled)]
    series = add_holidays(add_calendar_features(series), holidays)
    features = [*joined, "day_of_week", "month", "week_of_year", *lagged, *rolled, "is_holiday"]
    return series.select(KEY, DAY, *features).fillna(0, subset=features)


def feature_columns(table: DataFrame) -> list[str]:
    """Every column but the key and the day, the quantity first."""
    return ["quantity", *[c for c in table.columns if c not in (KEY, DAY, "quantity")]]
