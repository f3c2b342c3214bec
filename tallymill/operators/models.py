"""Next-day demand models, pooled over all products, and their recursive use.

The linear model and the trees read the scaled quantities of the window and the other
features of its last day; the reservoir reads a recurrent state of fixed weights that has
seen all days so far, and the last day's features. They take the place of trained recurrent
networks, so their numbers differ from those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.moments import LinearFit, Moments, choose, moments, ridge
from tallymill.operators import reservoir as rv
from tallymill.operators.samples import BOUNDED, SEQ_LENGTH, samples, scaled_features
from tallymill.operators.series import DAY, KEY, latest_days
from tallymill.session import checkpointed

LINEAR, GBT, RESERVOIR = "linear", "gbt", "reservoir"
REG_GRID = (0.0001, 0.001, 0.01)
# Steps of a tree forecast between two checkpoints of its state.
STEPS_PER_CHECKPOINT = 5


@dataclass
class DemandModel:
    kind: str
    model: object
    seq_length: int
    features: list[str]
    validation_mse: float | None = None
    # Of a linear model or readout: the fits of all strengths, in the order given.
    tried: list[LinearFit] = field(default_factory=list)
    reservoir: rv.Reservoir | None = None

    def place_in_last(self, feature: str) -> int:
        """Where the feature is in `last`; only the reservoir reads the last quantity from there."""
        return [f for f in self.features if f != "quantity" or self.kind == RESERVOIR].index(feature)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add `prediction`, the scaled quantity of the day after the window. A model that had
        nothing to learn from predicts no row."""
        if self.model is None:
            return rows.limit(0).withColumn("prediction", F.lit(0.0))
        if self.kind != GBT:
            weights = self.model.coefficients.toArray().tolist()
            return rows.withColumn("prediction", F.lit(self.model.intercept) + dot(F.concat("window", "last"), weights))
        return self.model.transform(_with_vector(rows)).drop("vector")


def _with_vector(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", array_to_vector(F.concat("window", "last")))


def fit(
    parts: DataFrame,
    features: Sequence[str],
    kind: str = LINEAR,
    seq_length: int = SEQ_LENGTH,
    seed: int = 42,
    reg_grid: Sequence[float] = REG_GRID,
    max_iter: int = 30,
    max_depth: int = 4,
    reservoir: rv.Reservoir | None = None,
) -> DemandModel:
    """Train on the `train` part and stop or choose by the `validation` part.

    Linear: one pass gives the moments of both parts, and these the weights and the
    validation error of every ridge strength; the smallest error wins. The readout of a
    `reservoir`, whose states `parts` hold, is learnt in the same way. Trees: boosting stops
    when the validation error no longer falls.
    """
    known = parts.filter(F.col("part") != "test")
    if kind in (LINEAR, RESERVOIR):
        sums = moments(known.withColumn("_vector", F.concat("window", "last")), "_vector", "quantity", "part")
        return fit_moments(sums, features, kind, seq_length, reg_grid, reservoir)
    if kind != GBT:
        raise ValueError(f"unknown model {kind!r}; use {LINEAR!r}, {RESERVOIR!r} or {GBT!r}")
    rows = _with_vector(known).select("vector", "quantity", "part").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = None if rows.filter("part = 'train'").isEmpty() else _fit_gbt(rows, seed, max_iter, max_depth)
    finally:
        rows.unpersist()
    return DemandModel(kind, model, seq_length, list(features))


def fit_moments(
    sums: dict[str, Moments],
    features: Sequence[str],
    kind: str = LINEAR,
    seq_length: int = SEQ_LENGTH,
    reg_grid: Sequence[float] = REG_GRID,
    reservoir: rv.Reservoir | None = None,
) -> DemandModel:
    """The linear model or readout that follows from the moments of the parts."""
    if "train" not in sums:
        return DemandModel(kind, None, seq_length, list(features), reservoir=reservoir)
    tried = ridge(sums["train"], reg_grid)
    best = choose(tried, sums.get("validation"))
    return DemandModel(kind, best, seq_length, list(features), best.validation_mse, tried, reservoir)


def _fit_gbt(rows: DataFrame, seed: int, max_iter: int, max_depth: int):
    boosted = GBTRegressor(
        featuresCol="vector",
        labelCol="quantity",
        validationIndicatorCol="is_validation",
        maxIter=max_iter,
        maxDepth=max_depth,
        seed=seed,
    )
    return boosted.fit(rows.withColumn("is_validation", F.col("part") == "validation"))


def test_predictions(model: DemandModel, parts: DataFrame) -> DataFrame:
    """`stock_code`, `day`, `actual`, `predicted` in units, for the test part."""
    rows = model.predict(parts.filter("part = 'test'"))
    actual, predicted = units(F.col("quantity")), units(F.col("prediction"))
    return rows.select(KEY, DAY, actual.alias("actual"), predicted.alias("predicted"))


def units(scaled: Column) -> Column:
    """Back from 0..1 to items, by the bounds of the row's product."""
    return scaled * F.col("quantity_span") + F.col("quantity_low")


def last_windows(scaled: DataFrame, seq_length: int = SEQ_LENGTH) -> DataFrame:
    """One row per product: its last `seq_length` quantities as `window`, the other
    features of its last day as `last`, that `day`, and the bounds of the scaling."""
    others = [c for c in scaled_features(scaled) if c != "quantity"]
    recent = latest_days(scaled, seq_length)
    in_order = F.array_sort(F.collect_list(F.struct(DAY, "quantity")))
    bounds = [f"{c}_{end}" for c in BOUNDED for end in ("low", "span")]
    return (
        recent.groupBy(KEY)
        .agg(
            in_order["quantity"].alias("window"),
            F.max_by(F.struct(F.array(*others).alias("last"), *bounds), DAY).alias("_end"),
            F.max(DAY).alias(DAY),
        )
        .select(KEY, DAY, "window", "_end.*")
        .filter(F.size("window") == seq_length)
    )


def model_input(scaled: DataFrame, seq_length: int = SEQ_LENGTH, reservoir: rv.Reservoir | None = None) -> DataFrame:
    """The samples that a model learns from, see `samples.samples` and `reservoir.samples`."""
    return samples(scaled, seq_length) if reservoir is None else rv.samples(scaled, reservoir, seq_length)


def end_states(model: DemandModel, scaled: DataFrame) -> DataFrame:
    """What the model's recursion starts from, one row per product."""
    if model.kind == RESERVOIR:
        return rv.end_states(scaled, model.reservoir, model.seq_length)
    return last_windows(scaled, model.seq_length)


def roll_forward(model: DemandModel, states: DataFrame, horizon: int) -> DataFrame:
    """Replace `window` and `last` by `path`, the scaled predictions for `horizon` days.

    Each prediction joins the window and the oldest day leaves it; the features of the
    last day stay as they are.
    """
    if model.model is None:
        return states.limit(0).withColumn("path", F.array().cast("array<double>")).drop("window", "last")
    if model.kind == LINEAR:
        own, other, constant = linear_weights(model)
        # The features stay the same, so their part of the sum is taken once per row.
        fixed = states.withColumn("_fixed", F.lit(constant) + dot(F.col("last"), other))
        state = fixed.withColumn("path", linear_path(F.col("window"), F.col("_fixed"), own, horizon))
        return state.drop("_fixed", "window", "last")
    if model.kind == RESERVOIR:
        return rv.roll_forward(states, model.reservoir, model.model.coefficients.toArray().tolist(), model.model.intercept, horizon)
    state = states.withColumn("path", F.array().cast("array<double>"))
    for step in range(1, horizon + 1):
        state = model.predict(state).withColumns(
            {
                "window": F.concat(F.slice("window", 2, model.seq_length), F.array("prediction")),
                "path": F.concat("path", F.array("prediction")),
            }
        )
        state = state.drop("prediction")
        if step % STEPS_PER_CHECKPOINT == 0 and step < horizon:
            state = checkpointed(state)
    return state.drop("window", "last")


def linear_weights(model: DemandModel) -> tuple[list[float], list[float], float]:
    """Weights of the window's quantities, of the other features, and the constant."""
    weights = model.model.coefficients.toArray().tolist()
    return weights[: model.seq_length], weights[model.seq_length :], float(model.model.intercept)


def dot(values: Column, weights: Sequence[float]) -> Column:
    products = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def linear_path(window: Column, fixed: Column, weights: Sequence[float], horizon: int) -> Column:
    """The recursion as one fold over the steps: the array grows by one prediction per
    step, and step i reads as many entries from i on as the window has."""
    size = len(weights)

    def step(known: Column, i: Column) -> Column:
        return F.concat(known, F.array(fixed + dot(F.slice(known, i, F.lit(size)), weights)))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), window.cast("array<double>"), step)
    return F.slice(grown, size + 1, horizon)
