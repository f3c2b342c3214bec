import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.operators import forecast as fc
from tallymill.operators import models, pricing
from tallymill.operators import samples as sm
from tallymill.operators import series as ts
from tallymill.plans import demand

T0 = dt.datetime(2010, 1, 4)
SEQ = 14


def weekly_sales(spark, days=200, products=("A", "B"), seed=1):
    """Quantities with a strong weekly pattern and little noise."""
    rng = np.random.default_rng(seed)
    pattern = np.array([10, 12, 15, 20, 35, 60, 5])
    rows = [
        (p, T0 + dt.timedelta(days=d), float(pattern[d % 7] * (1 + i) + rng.normal(0, 0.5)), 2.0 + i)
        for i, p in enumerate(products)
        for d in range(days)
    ]
    rows += [("short", T0 + dt.timedelta(days=d), 1.0, 1.0) for d in range(10)]
    return spark.createDataFrame(rows, "stock_code string, invoice_ts timestamp, quantity double, price double")


@pytest.fixture(scope="module")
def linear(spark):
    return demand.forecast(weekly_sales(spark), "linear", seq_length=SEQ, horizon=14)


@pytest.fixture(scope="module")
def boosted(spark):
    return demand.forecast(weekly_sales(spark), "gbt", seq_length=SEQ, horizon=7, max_iter=15)


@pytest.mark.parametrize("run", ["linear", "boosted"])
def test_beats_the_mean_and_keeps_the_weekly_pattern(request, run):
    result = request.getfixturevalue(run)
    errors = {r.stock_code: r.mae for r in result.metrics.collect()}
    assert set(errors) == {"A", "B"}
    # The mean absolute deviation of the pattern is about 14 for A and 28 for B.
    assert errors["A"] < 4 and errors["B"] < 8
    kpi = {r.stock_code: r for r in result.kpis.collect()}
    assert kpi["A"].best_weekday == "Saturday" and kpi["A"].worst_weekday == "Sunday"
    assert kpi["A"].trend == "stable" and abs(kpi["A"].next_7_days - 157) < 25


def test_short_products_are_rejected_with_a_reason(linear):
    assert [tuple(r) for r in linear.rejects.select("stock_code", "reason").collect()] == [
        ("short", "not enough days for one window")
    ]
    assert linear.future.filter("stock_code = 'short'").count() == 0


def test_future_days_and_series(linear):
    rows = linear.future.filter("stock_code = 'A'").orderBy("step").collect()
    last = (T0 + dt.timedelta(days=199)).date()
    assert [r.day for r in rows] == [last + dt.timedelta(days=i) for i in range(1, 15)]
    kinds = {r.kind: r["count"] for r in linear.combined.groupBy("kind").count().collect()}
    # 186 samples: 130 train, 27 validation, 29 test, for two products.
    assert kinds == {"actual": 58, "predicted": 58, "future": 28}
    rounded = linear.rounded.filter("stock_code = 'A'").orderBy("day").collect()
    assert [r.future_forecast for r in rounded] == [round(r.future_forecast) for r in rows]


def test_test_days_are_the_last_of_the_series(linear):
    days = linear.predictions.filter("stock_code = 'A'").agg(F.min("day"), F.max("day"), F.count("*")).first()
    last = (T0 + dt.timedelta(days=199)).date()
    assert tuple(days) == (last - dt.timedelta(days=28), last, 29)


def test_same_seed_same_numbers(spark, boosted):
    again = demand.forecast(weekly_sales(spark).repartition(3), "gbt", seq_length=SEQ, horizon=7, max_iter=15)
    first = {(r.stock_code, r.step): r.future_forecast for r in boosted.future.collect()}
    second = {(r.stock_code, r.step): r.future_forecast for r in again.future.collect()}
    assert first.keys() == second.keys()
    assert all(first[k] == pytest.approx(second[k], rel=1e-6) for k in first)


def test_recursion_equals_a_loop(linear):
    """The fold over steps against appending one prediction at a time."""
    weights = linear.model.model.coefficients.toArray()
    intercept = linear.model.model.intercept
    state = models.last_windows(linear.scaled, SEQ).filter("stock_code = 'B'").first()
    window, path = list(state.window), []
    for _ in range(14):
        path.append(intercept + np.dot(weights, np.concatenate([window[-SEQ:], state.last])))
        window.append(path[-1])
    want = np.array(path) * state.quantity_span + state.quantity_low
    got = [r.future_forecast for r in linear.future.filter("stock_code = 'B'").orderBy("step").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_tree_recursion_equals_single_steps(boosted):
    state = models.last_windows(boosted.scaled, SEQ).filter("stock_code = 'A'")
    for step in range(1, 4):
        row = boosted.model.predict(state).first()
        want = row.prediction * row.quantity_span + row.quantity_low
        got = boosted.future.filter(f"stock_code = 'A' AND step = {step}").first().future_forecast
        assert got == pytest.approx(want, rel=1e-12)
        state = boosted.model.predict(state).withColumn(
            "window", F.concat(F.slice("window", 2, SEQ), F.array("prediction"))
        ).drop("prediction")


def test_the_linear_recursion_has_no_python_and_no_shuffle(linear):
    states = models.last_windows(linear.scaled, SEQ)
    before = states._jdf.queryExecution().executedPlan().toString()
    after = models.roll_forward(linear.model, states, 30)._jdf.queryExecution().executedPlan().toString()
    assert after.count("Exchange") == before.count("Exchange") and "Python" not in after


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="unknown model"):
        demand.forecast(weekly_sales(spark), "other", seq_length=SEQ)


def test_growth_limits(spark):
    past = [("z", 0.0), ("up", 10.0), ("down", 10.0), ("same", 10.0)]
    coming = [("z", 5.0), ("up", 10.6), ("down", 9.4), ("same", 10.5)]
    day = T0.date()
    features = spark.createDataFrame([(k, day, q) for k, q in past], "stock_code string, day date, quantity double")
    ahead = spark.createDataFrame([(k, day, 1, q) for k, q in coming], "stock_code string, day date, step int, future_forecast double")
    got = {r.stock_code: (round(r.growth_pct, 6), r.trend) for r in fc.growth(features, ahead).collect()}
    assert got == {"z": (0.0, "stable"), "up": (6.0, "up"), "down": (-6.0, "down"), "same": (5.0, "stable")}


def test_price_search(linear):
    prices = demand.recommend_prices(linear, days=3)
    curve = prices["curve"].filter("stock_code = 'A'").orderBy("point").collect()
    assert [r.price for r in curve] == pytest.approx(np.linspace(1.6, 2.4, 20).tolist())
    assert sum(r.is_best for r in curve) == 1
    best = max(curve, key=lambda r: r.total_predicted_revenue)
    assert prices["best"].filter("stock_code = 'A'").first().price == best.price
    uplift = prices["uplift"].filter("stock_code = 'A'").first()
    base = min(curve, key=lambda r: (abs(r.price - 2.0), r.price))
    assert uplift.baseline_revenue == base.total_predicted_revenue
    assert uplift.uplift == pytest.approx(best.total_predicted_revenue - base.total_predicted_revenue)


def test_daily_units_count_as_zero_at_least_in_the_total_only(spark, linear):
    grid = pricing.price_grid(pricing.current_prices(linear.features))
    states = models.last_windows(linear.scaled, SEQ).join(grid, "stock_code").filter("stock_code = 'A' AND point = 0")
    row = states.first()
    weights, intercept = linear.model.model.coefficients.toArray(), linear.model.model.intercept
    last = list(row.last)
    place = [f for f in linear.model.features if f != "quantity"].index("our_price")
    last[place] = (row.price - row.our_price_low) / row.our_price_span
    window, total = list(row.window), 0.0
    for _ in range(5):
        window.append(intercept + np.dot(weights, np.concatenate([window[-SEQ:], last])))
        total += max(0.0, window[-1] * row.quantity_span + row.quantity_low)
    curve = pricing.simulate_demand(linear.model, linear.scaled, grid, days=5)
    got = curve.filter("stock_code = 'A' AND point = 0").first()
    assert got.total_predicted_quantity == pytest.approx(total, rel=1e-9)
    assert got.total_predicted_revenue == pytest.approx(total * row.price, rel=1e-9)


def test_planted_demand_gives_the_analytic_price(spark):
    """Demand 100 - 30 p with a price that changes every two weeks: best price 100 / 60."""
    rng = np.random.default_rng(4)
    rows, price = [], 1.8
    for d in range(900):
        if d % 14 == 0:
            price = float(rng.uniform(1.2, 2.4))
        shown = 1.8 if d > 880 else price
        units = 100 - 30 * shown + rng.normal(0, 3)
        rows.append(("A", T0 + dt.timedelta(days=d), float(units), shown))
    sales = spark.createDataFrame(rows, "stock_code string, invoice_ts timestamp, quantity double, price double")
    run = demand.forecast(sales, "linear", seq_length=SEQ, horizon=7)
    best = demand.recommend_prices(run, days=7)["uplift"].first()
    assert best.current_price == 1.8 and abs(best.best_price - 100 / 60) < 0.16
    assert best.direction == "decrease" and best.sensitivity == "very sensitive"


def test_zero_prices_get_no_recommendation(spark):
    rows = [("free", T0.date(), 1.0, 0.0), ("ok", T0.date(), 1.0, 3.0)]
    table = spark.createDataFrame(rows, "stock_code string, day date, quantity double, our_price double")
    prices = pricing.current_prices(table)
    assert [tuple(r) for r in prices.filter("reason IS NOT NULL").collect()] == [("free", 0.0, "current price is zero")]
    assert pricing.price_grid(prices).select("stock_code").distinct().collect() == [("ok",)]
    with pytest.raises(ValueError, match="our_price"):
        pricing.current_prices(table.drop("our_price"))


def test_fit_chooses_the_ridge_by_validation(spark, linear):
    parts = sm.split(sm.samples(linear.scaled, SEQ))
    features = sm.scaled_features(linear.scaled)
    strong = models.fit(parts, features, seq_length=SEQ, reg_grid=[100.0])
    both = models.fit(parts, features, seq_length=SEQ, reg_grid=[100.0, 0.001])
    assert both.validation_mse < strong.validation_mse
    assert both.model.strength == 0.001 and [f.strength for f in both.tried] == [100.0, 0.001]


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_no_product_with_enough_history(spark, kind):
    rows = [("A", dt.datetime(2020, 1, 1) + dt.timedelta(days=k), 1.0, 2.0) for k in range(30)]
    short = spark.createDataFrame(rows, "stock_code string, invoice_ts timestamp, quantity double, price double")
    for sales in (short, short.limit(0)):
        run = demand.forecast(sales, kind)
        for table in (run.predictions, run.future, run.metrics, run.combined, run.kpis, run.rounded):
            assert table.count() == 0
        assert demand.recommend_prices(run)["uplift"].count() == 0
        assert run.rejects.count() == sales.select("stock_code").distinct().count()
        run.release()


def sparse_sales(spark, products=30, seed=3):
    """Few sales per product, days apart, some of them free or without a price; `late` has one day."""
    rng = np.random.default_rng(seed)
    rows = [("late", T0, 1.0, 2.0)]
    for i in range(products):
        for d in sorted(rng.choice(300, size=int(rng.integers(1, 12)), replace=False).tolist()):
            price = [None, 0.0, 1.5, 2.5, 4.0][int(rng.integers(5))]
            rows.append((f"p{i}", T0 + dt.timedelta(days=d), float(rng.integers(1, 9)), price))
    return spark.createDataFrame(rows, "stock_code string, invoice_ts timestamp, quantity double, price double")


def test_spans_hold_every_day_once(spark):
    sales = sparse_sales(spark)
    daily = ts.fill_prices(ts.daily_series(sales))
    spans = ts.day_spans(sales)
    assert spans.count() == sales.count() < daily.count() / 5
    assert sorted(map(tuple, ts.every_day(spans).collect())) == sorted(map(tuple, daily.collect()))


@pytest.mark.parametrize("seq, fit_on", [(1, "all"), (1, "train"), (20, "all"), (20, "train")])
def test_a_forecast_from_spans_is_that_of_their_days(spark, seq, fit_on):
    spans = ts.day_spans(sparse_sales(spark))
    options = {"seq_length": seq, "horizon": 3, "fit_on": fit_on, "reg_grid": (0.01,)}
    slow = demand.forecast_table(ts.every_day(spans), "linear", **options)
    fast = demand.forecast_table(spans, "linear", **options)
    assert fast.model.validation_mse == pytest.approx(slow.model.validation_mse)
    assert sorted(map(tuple, fast.rejects.collect())) == sorted(map(tuple, slow.rejects.collect()))
    for name in ("features", "scaled", "predictions", "future", "metrics", "kpis"):
        want, got = getattr(slow, name), getattr(fast, name)
        assert got.columns == want.columns
        want, got = (sorted(map(tuple, df.collect())) for df in (want, got))
        assert len(got) == len(want) > 0
        for a, b in zip(got, want, strict=True):
            assert [x if not isinstance(x, float) else pytest.approx(x, abs=1e-9) for x in b] == list(a)
    slow.release()


def test_spans_without_enough_days(spark):
    run = demand.forecast_table(ts.day_spans(sparse_sales(spark).filter("stock_code = 'late'")), "linear", seq_length=1)
    assert run.rejects.count() == 1 and run.metrics.count() == run.future.count() == 0
    with pytest.raises(ValueError, match="spans"):
        demand.forecast_table(ts.day_spans(sparse_sales(spark)), "gbt", seq_length=1)
