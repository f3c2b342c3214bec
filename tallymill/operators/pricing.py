"""A grid of prices per product, the demand predicted for each and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.models import (
    LINEAR, DemandModel, dot, end_states, linear_path, linear_weights, roll_forward, units,
)
from tallymill.operators.series import DAY, KEY

GRID_POINTS = 20
LOWEST, HIGHEST = 0.8, 1.2
DAYS = 7


def current_prices(features: DataFrame) -> DataFrame:
    """The last `our_price` of each product, with `reason` if no price can be recommended."""
    if "our_price" not in features.columns:
        raise ValueError("price recommendations need an our_price column")
    last = features.groupBy(KEY).agg(F.max_by("our_price", DAY).alias("current_price"))
    return last.withColumn("reason", F.when(F.col("current_price") == 0, "current price is zero"))


def price_grid(prices: DataFrame, points: int = GRID_POINTS) -> DataFrame:
    """`points` evenly spaced prices from 0.8 to 1.2 times the current price of a product."""
    low, high = F.col("current_price") * LOWEST, F.col("current_price") * HIGHEST
    step = (high - low) / (points - 1)
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.when(i == points - 1, high).otherwise(i * step + low),
    )
    return prices.filter(F.col("reason").isNull()).select(
        KEY, "current_price", F.posexplode(steps).alias("point", "price")
    )


def simulate_demand(
    model: DemandModel, scaled: DataFrame, grid: DataFrame, days: int = DAYS
) -> DataFrame:
    """Units and revenue of each grid price over the next `days` days.

    The price holds for the whole window, so the model's price feature is the grid price.
    A day's units count as at least 0 in the total, but the recursion goes on with the
    unclamped value.
    """
    place = model.place_in_last("our_price")
    states = end_states(model, scaled)
    if model.kind == LINEAR and model.model is not None:
        return price_curve(_linear_demand(model, states, grid, days, place))
    scaled_price = (F.col("price") - F.col("our_price_low")) / F.col("our_price_span")
    priced = states.join(grid, KEY).withColumn(
        "last", F.transform("last", lambda x, i: F.when(i == place, scaled_price).otherwise(x))
    )
    paths = roll_forward(model, priced, days)
    return price_curve(paths.select(KEY, "current_price", "point", "price", _units_sold(F.col("path")).alias("quantity")))


def _units_sold(path: Column) -> Column:
    return F.aggregate(path, F.lit(0.0), lambda total, x: total + F.greatest(F.lit(0.0), units(x)))


def _linear_demand(model: DemandModel, states: DataFrame, grid: DataFrame, days: int, place: int) -> DataFrame:
    """Units for each grid price. A product stays one row with one window: its prices, at
    most as many as the grid has points, are worked through inside it. A price only changes
    its own part of the sum, so the other features are added up once."""
    own, other, constant = linear_weights(model)
    offers = grid.groupBy(KEY, "current_price").agg(F.collect_list(F.struct("point", "price")).alias("offers"))
    fixed = F.lit(constant) + dot(F.col("last"), other)
    rows = states.join(offers, KEY).withColumns({"_fixed": fixed, "_price": F.element_at("last", place + 1)})

    def sold(offer: Column) -> Column:
        scaled_price = (offer["price"] - F.col("our_price_low")) / F.col("our_price_span")
        moved = F.col("_fixed") + F.lit(other[place]) * (scaled_price - F.col("_price"))
        quantity = _units_sold(linear_path(F.col("window"), moved, own, days))
        return F.struct(offer["point"].alias("point"), offer["price"].alias("price"), quantity.alias("quantity"))

    return rows.select(KEY, "current_price", F.inline(F.transform("offers", sold)))


def price_curve(demand: DataFrame) -> DataFrame:
    """Total quantity and revenue per price from rows of predicted `quantity`."""
    totals = demand.groupBy(KEY, "current_price", "point", "price").agg(
        F.sum("quantity").alias("total_predicted_quantity")
    )
    revenue = F.col("price") * F.col("total_predicted_quantity")
    return totals.withColumn("total_predicted_revenue", revenue)


def _by_revenue():
    # One product's grid: as many rows as it has points.
    return Window.partitionBy(KEY).orderBy(F.desc("total_predicted_revenue"), "price")


def flag_best(curve: DataFrame) -> DataFrame:
    """Add `is_best`: the highest revenue, the lower price on a tie."""
    return curve.withColumn("is_best", F.row_number().over(_by_revenue()) == 1)


def best_price(curve: DataFrame) -> DataFrame:
    return flag_best(curve).filter("is_best").drop("is_best")


def price_uplift(curve: DataFrame) -> DataFrame:
    """The best price of each product against the grid price nearest to the current one.

    The current price is not on the grid; of two equally near prices the lower counts.
    """
    # Rounded, so that the noise of the grid's sums does not decide between equal distances.
    gap = F.round(F.abs(F.col("price") / F.col("current_price") - 1), 9)
    nearest = Window.partitionBy(KEY).orderBy(gap, "price")
    baseline = F.first("total_predicted_revenue").over(nearest)
    rows = curve.withColumn("baseline_revenue", baseline)
    best = best_price(rows)
    uplift = F.col("total_predicted_revenue") - F.col("baseline_revenue")
    change = (F.col("price") - F.col("current_price")) / F.col("current_price") * 100
    return best.select(
        KEY,
        "current_price",
        F.col("price").alias("best_price"),
        "baseline_revenue",
        uplift.alias("uplift"),
        F.when(F.col("baseline_revenue") > 0, uplift / F.col("baseline_revenue") * 100)
        .otherwise(F.lit(0.0))
        .alias("uplift_pct"),
        change.alias("price_change_pct"),
        F.when(change > 0, "increase").otherwise("decrease").alias("direction"),
        F.when(change > 0, "not very sensitive").otherwise("very sensitive").alias("sensitivity"),
        F.col("total_predicted_quantity").alias("expected_units"),
        F.col("total_predicted_revenue").alias("expected_revenue"),
    )
