"""Forecasts and price recommendations for many products in one job."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators import forecast as fc
from tallymill.operators import models, pricing, reservoir
from tallymill.operators import samples as sm
from tallymill.operators import series as ts
from tallymill.operators import spans as sp
from tallymill.session import checkpointed, stored


@dataclass
class Forecast:
    """Tables by product. `features` is persisted; `release` frees it."""

    model: models.DemandModel
    features: DataFrame
    scaled: DataFrame
    rejects: DataFrame
    predictions: DataFrame
    future: DataFrame
    metrics: DataFrame
    combined: DataFrame
    by_weekday: DataFrame
    growth: DataFrame
    rounded: DataFrame
    kpis: DataFrame

    def release(self) -> None:
        self.features.unpersist()


def forecast(
    sales: DataFrame,
    model: str = models.LINEAR,
    products=None,
    competitor_prices: DataFrame | None = None,
    segment_sales: DataFrame | None = None,
    segments=None,
    holidays: DataFrame | None = None,
    horizon: int = fc.HORIZON,
    seq_length: int = sm.SEQ_LENGTH,
    train_ratio: float = sm.TRAIN_RATIO,
    val_ratio: float = sm.VAL_RATIO,
    fit_on: str = "all",
    seed: int = 42,
    **model_options,
) -> Forecast:
    """Features, one model for all products, its test accuracy and the days ahead.

    Products with too little history are in `rejects` with the reason.
    """
    table = ts.feature_table(sales, products, competitor_prices, segment_sales, segments, holidays)
    return forecast_table(table, model, horizon, seq_length, train_ratio, val_ratio, fit_on, seed, **model_options)


def forecast_table(
    table: DataFrame,
    model: str = models.LINEAR,
    horizon: int = fc.HORIZON,
    seq_length: int = sm.SEQ_LENGTH,
    train_ratio: float = sm.TRAIN_RATIO,
    val_ratio: float = sm.VAL_RATIO,
    fit_on: str = "all",
    seed: int = 42,
    **model_options,
) -> Forecast:
    """As `forecast`, from daily rows with any features: stock_code, day, quantity, ...

    The linear model also takes `series.day_spans`, for many products that sell on few days:
    these stay in spans, and their days are laid out within tasks.

    Predictions and the days ahead are checkpointed, so what is drawn from them stays valid
    after `release`. If no product has enough history, all tables but `rejects` are empty.
    """
    if ts.SPAN in table.columns:
        if model != models.LINEAR:
            raise ValueError(f"spans of days are for the {models.LINEAR!r} model; use series.every_day")
        return _forecast_spans(table, horizon, sp.Windows((), fit_on, seq_length, train_ratio, val_ratio), model_options)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    checked = sm.usable(table, seq_length, train_ratio, val_ratio)
    accepted = table.join(checked.filter("reason IS NULL").select(ts.KEY), ts.KEY, "left_semi")
    rejects = checked.filter("reason IS NOT NULL")

    scaled = sm.min_max_scale(accepted, fit_on, seq_length, train_ratio)
    names = sm.scaled_features(scaled)
    if model == models.RESERVOIR and "reservoir" not in model_options:
        model_options = {**model_options, "reservoir": reservoir.seeded(names, seed=seed)}
    parts = sm.split(models.model_input(scaled, seq_length, model_options.get("reservoir")), train_ratio, val_ratio)
    fitted = models.fit(parts, names, model, seq_length, seed, **model_options)
    predictions = checkpointed(models.test_predictions(fitted, parts))
    ahead = checkpointed(fc.future(fitted, scaled, horizon))
    return _forecast(fitted, table, accepted, scaled, rejects, predictions, ahead)


def _forecast_spans(spans: DataFrame, horizon: int, windows: sp.Windows, model_options: dict) -> Forecast:
    """The spans are stored by product; the test days are made from them where they are read."""
    if windows.fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    windows = replace(windows, features=tuple(sp.span_features(spans)))
    products = stored(sp.by_product(spans), "products")
    rows = products.select(ts.KEY, F.explode(F.arrays_zip(*[c for c in products.columns if c != ts.KEY])).alias("_row"))
    table = rows.select(ts.KEY, "_row.*")
    held = products.select(ts.KEY, F.aggregate(ts.SPAN, F.lit(0), lambda total, x: total + x).alias(ts.SPAN))
    checked = sm.usable(held, windows.seq_length, windows.train_ratio, windows.val_ratio)
    taken = checked.filter("reason IS NULL").select(ts.KEY)
    products = stored(products.join(taken, ts.KEY, "left_semi"), "usable-products")
    fitted = models.fit_moments(windows.moments(products), windows.features, seq_length=windows.seq_length, **model_options)
    predictions = windows.test_predictions(products, fitted)
    ahead = checkpointed(fc.future_of(fitted, windows.end_states(products), horizon))
    features = ts.every_day(table)
    accepted = features.join(taken, ts.KEY, "left_semi")
    scaled = sm.min_max_scale(accepted, windows.fit_on, windows.seq_length, windows.train_ratio)
    return _forecast(fitted, features, accepted, scaled, checked.filter("reason IS NOT NULL"), predictions, ahead)


def _forecast(fitted, features, accepted, scaled, rejects, predictions, ahead) -> Forecast:
    return Forecast(
        model=fitted,
        features=features,
        scaled=scaled,
        rejects=rejects,
        predictions=predictions,
        future=ahead,
        metrics=fc.metrics(predictions),
        combined=fc.combined_series(predictions, ahead),
        by_weekday=fc.forecast_by_weekday(ahead),
        growth=fc.growth(accepted, ahead),
        rounded=fc.rounded_forecast(ahead),
        kpis=fc.forecast_kpis(accepted, predictions, ahead),
    )


def recommend_prices(run: Forecast, days: int = pricing.DAYS) -> dict[str, DataFrame]:
    """Price curve, best price and uplift per product of a forecast, and the products
    that cannot have one."""
    prices = pricing.current_prices(run.features)
    # Checkpointed, since the tables below all read it.
    curve = checkpointed(pricing.simulate_demand(run.model, run.scaled, pricing.price_grid(prices), days))
    return {
        "curve": pricing.flag_best(curve),
        "best": pricing.best_price(curve),
        "uplift": pricing.price_uplift(curve),
        "rejects": prices.filter("reason IS NOT NULL"),
    }
