"""Future quantities per product, their accuracy and the figures drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.models import DemandModel, end_states, roll_forward, units
from tallymill.operators.series import DAY, KEY, latest_days

HORIZON = 30
GROWTH_LIMIT = 5.0


def future(model: DemandModel, scaled: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """`stock_code`, `day`, `step`, `future_forecast` for the days after each series.

    One row per product goes through the model; it is not clamped at 0.
    """
    return future_of(model, end_states(model, scaled), horizon)


def future_of(model: DemandModel, states: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """`future`, from the end states of the series."""
    paths = roll_forward(model, states, horizon)
    days = paths.select(KEY, DAY, "quantity_low", "quantity_span", F.posexplode("path").alias("_at", "_scaled"))
    return days.select(
        KEY,
        F.date_add(DAY, F.col("_at") + 1).alias(DAY),
        (F.col("_at") + 1).alias("step"),
        units(F.col("_scaled")).alias("future_forecast"),
    )


def metrics(predictions: DataFrame) -> DataFrame:
    """Mean absolute and root mean squared error per product."""
    return predictions.groupBy(KEY).agg(*_errors())


def overall_metrics(predictions: DataFrame) -> DataFrame:
    return predictions.agg(*_errors())


def _errors() -> list[Column]:
    error = F.col("actual") - F.col("predicted")
    return [F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")]


def combined_series(predictions: DataFrame, ahead: DataFrame) -> DataFrame:
    """Actual, predicted and future quantities in one table: stock_code, day, kind, value."""
    past = predictions.unpivot([KEY, DAY], ["actual", "predicted"], "kind", "value")
    return past.unionByName(
        ahead.select(KEY, DAY, F.lit("future").alias("kind"), F.col("future_forecast").alias("value"))
    )


def forecast_by_weekday(ahead: DataFrame) -> DataFrame:
    return ahead.groupBy(KEY, F.date_format(DAY, "EEEE").alias("weekday")).agg(
        F.sum("future_forecast").alias("future_forecast")
    )


def growth(features: DataFrame, ahead: DataFrame, days: int = 30) -> DataFrame:
    """Mean of the last `days` actual days against the mean forecast, per product.

    Growth is 0 percent when the past mean is not above zero.
    """
    past = latest_days(features, days).groupBy(KEY).agg(F.avg("quantity").alias("past_avg"))
    coming = ahead.groupBy(KEY).agg(F.avg("future_forecast").alias("future_avg"))
    change = (F.col("future_avg") - F.col("past_avg")) / F.col("past_avg") * 100
    pct = F.when(F.col("past_avg") > 0, change).otherwise(F.lit(0.0))
    trend = F.when(pct > GROWTH_LIMIT, "up").when(pct < -GROWTH_LIMIT, "down").otherwise("stable")
    return past.join(coming, KEY).withColumns({"growth_pct": pct, "trend": trend})


def rounded_forecast(ahead: DataFrame) -> DataFrame:
    """Whole items per day, halves to even."""
    return ahead.select(KEY, DAY, F.rint("future_forecast").cast("int").alias("future_forecast"))


def forecast_kpis(features: DataFrame, predictions: DataFrame, ahead: DataFrame) -> DataFrame:
    """One row per product: safety stock, next week's units, best and worst weekday
    (alphabetical on a tie), growth and trend."""
    week = F.coalesce(F.sum(F.when(F.col("step") <= 7, F.col("future_forecast"))), F.lit(0.0))
    next_week = ahead.groupBy(KEY).agg(week.alias("next_7_days"))
    total = F.col("future_forecast")
    weekdays = forecast_by_weekday(ahead).groupBy(KEY).agg(
        F.min(F.struct((-total).alias("_rank"), "weekday"))["weekday"].alias("best_weekday"),
        F.min(F.struct(total.alias("_rank"), "weekday"))["weekday"].alias("worst_weekday"),
    )
    stock = metrics(predictions).select(KEY, F.col("mae").alias("safety_stock"))
    return (
        growth(features, ahead)
        .join(next_week, KEY)
        .join(weekdays, KEY)
        .join(stock, KEY, "left")
        .select(
            KEY, "safety_stock", "next_7_days", "best_weekday", "worst_weekday", "growth_pct", "trend"
        )
    )
