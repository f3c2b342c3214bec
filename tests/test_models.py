"""Moments, ridge strengths and the reservoir against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.functions import moments as mo
from tallymill.operators import forecast, models, reservoir
from tallymill.operators import samples as sm
from tallymill.plans import demand


def rows(n=400, d=5, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * np.arange(1, d + 1)
    return x, x @ np.arange(d) + 3 + r.normal(size=n)


def frame(spark, x, y, parts):
    data = [(p, [float(v) for v in a], float(b)) for p, a, b in zip(parts, x, y, strict=True)]
    return spark.createDataFrame(data, "part string, v array<double>, y double").repartition(7)


def test_moments_of_parts_add_up(spark):
    x, y = rows()
    parts = ["train" if k % 3 else "validation" for k in range(len(y))]
    df = frame(spark, x, y, parts)
    odd = spark.createDataFrame([("train", [1.0, None, 1.0, 1.0, 1.0], 1.0), ("train", None, 1.0), ("train", [1.0] * 5, None), (None, [1.0] * 5, 1.0)], df.schema)
    found = mo.moments(df.unionByName(odd), "v", "y", "part")
    assert set(found) == {"train", "validation"}
    for part, m in found.items():
        z = np.column_stack((np.ones(len(y)), x, y))[np.array(parts) == part]
        np.testing.assert_allclose(m.sums, z.T @ z, rtol=1e-12)
    assert (found["train"] + found["validation"]).rows == len(y)
    assert mo.moments(df.limit(0), "v", "y", "part") == {}


def test_ridge_and_errors(spark):
    x, y = rows()
    m = mo.moments(frame(spark, x, y, ["a"] * len(y)), "v", "y", "part")["a"]
    for fit in mo.ridge(m, [0.0, 0.1, 10.0]):
        centered = x - x.mean(axis=0)
        want = np.linalg.solve(centered.T @ centered / len(y) + fit.strength * np.eye(5), centered.T @ (y - y.mean()) / len(y))
        np.testing.assert_allclose(fit.coefficients.toArray(), want, rtol=1e-9)
        off = y - fit.intercept - x @ want
        assert m.error(fit) == pytest.approx(np.mean(off**2), rel=1e-9)


def test_columns_that_say_nothing_or_the_same(spark):
    """Without a penalty the shortest of equally good weights: none for a constant, equal ones for twins."""
    x, y = rows(d=2)
    x = np.column_stack((x[:, 0], x[:, 0], np.full(len(y), 4.0)))
    m = mo.moments(frame(spark, x, y, ["a"] * len(y)), "v", "y", "part")["a"]
    one, two, constant = mo.ridge(m, [0.0])[0].coefficients.toArray()
    assert one == pytest.approx(two, rel=1e-6) and constant == pytest.approx(0, abs=1e-9)


def test_the_smallest_validation_error_wins():
    fits = [mo.LinearFit(None, 0.0, s) for s in (1.0, 2.0, 3.0)]

    class Errors:
        def error(self, fit):
            return {1.0: 5.0, 2.0: 4.0, 3.0: 4.0}[fit.strength]

    assert mo.choose(fits, Errors()).strength == 2.0
    assert mo.choose(fits, None).strength == 1.0


# Reservoir

T0 = dt.date(2011, 1, 1)


def table(spark, lengths=(("A", 150), ("B", 140), ("C", 12))):
    r = np.random.default_rng(4)
    data = []
    for name, n in lengths:
        level = 0.0
        for k in range(n):
            level = 0.8 * level + r.normal()  # what a window of one day does not see as well as a state
            data.append((name, T0 + dt.timedelta(days=k), 50 + 5 * level + 10 * (k % 7 == 5), 2.0 + (k % 3) / 10))
    return spark.createDataFrame(data, "stock_code string, day date, quantity double, our_price double").repartition(5)


def test_states_follow_the_days(spark):
    scaled = sm.min_max_scale(table(spark)).cache()
    fixed = reservoir.seeded(["quantity", "our_price"], units=6, seed=9)
    by_key = {}
    for r in scaled.orderBy("day").collect():
        by_key.setdefault(r.stock_code, []).append((r.day, [r.quantity, r.our_price]))
    found = reservoir.samples(scaled, fixed, 10).collect()
    assert len(found) == sum(max(0, len(x) - 10) for x in by_key.values())
    ends = {r.stock_code: r for r in reservoir.end_states(scaled, fixed, 20).collect()}
    assert set(ends) == {"A", "B"}
    held = {(r.stock_code, r.day): r for r in found}
    for name, days in by_key.items():
        state = np.zeros(6)
        for k, (day, x) in enumerate(days):
            if k >= 10:
                r = held[name, day]
                np.testing.assert_allclose(r.window, state, atol=1e-12)
                assert r.last == days[k - 1][1] and r.quantity == x[0] and (r.sample, r.samples) == (k - 9, len(days) - 10)
            state = 0.7 * state + 0.3 * np.tanh(fixed.inputs @ x + fixed.recurrent @ state + fixed.bias)
        if name in ends:
            np.testing.assert_allclose(ends[name].window, state, atol=1e-12)
            assert ends[name].day == days[-1][0] and ends[name].last == days[-1][1]
    scaled.unpersist()


def test_reservoir_forecast(spark):
    run = demand.forecast_table(table(spark), "reservoir", seq_length=14, horizon=9)
    assert run.model.reservoir is not None and run.model.validation_mse == min(f.validation_mse for f in run.model.tried)
    assert {r.stock_code for r in run.rejects.collect()} == {"C"}
    future = {(r.stock_code, r.step): r.future_forecast for r in run.future.collect()}
    assert set(future) == {(s, k) for s in "AB" for k in range(1, 10)}
    # The recursion once more, one day at a time.
    end = models.end_states(run.model, run.scaled).filter("stock_code = 'B'").first()
    state, x = np.array(end.window), np.array(end.last)
    for k in range(1, 10):
        x[0] = run.model.model.intercept + run.model.model.coefficients.toArray() @ np.concatenate((state, x))
        assert future["B", k] == pytest.approx(x[0] * end.quantity_span + end.quantity_low, rel=1e-9)
        state = run.model.reservoir.step(state[None], x[None])[0]
    worse = forecast.overall_metrics(run.predictions.withColumn("predicted", F.lit(52.0))).first()
    assert forecast.overall_metrics(run.predictions).first().mae < worse.mae
    prices = demand.recommend_prices(run)
    assert prices["best"].count() == 2
    run.release()


def test_reservoir_without_enough_history(spark):
    run = demand.forecast_table(table(spark, (("C", 12),)), "reservoir", seq_length=14, horizon=3)
    assert run.future.count() == 0 and run.predictions.count() == 0 and run.rejects.count() == 1
    run.release()


def test_same_seed_same_weights():
    one, two = (reservoir.seeded(["quantity"], units=9, seed=3) for _ in range(2))
    assert (one.recurrent == two.recurrent).all() and np.abs(np.linalg.eigvals(one.recurrent)).max() == pytest.approx(reservoir.RADIUS)
