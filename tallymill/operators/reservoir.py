"""Recurrent state of a daily series, by fixed weights: a reservoir whose readout alone is learnt.

A product's days are folded in order, so the state has seen all days so far, not a window of
them. A product has at most one row per day, which is what one fold holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators.samples import BOUNDED, SEQ_LENGTH, numbered, scaled_features
from tallymill.operators.series import DAY, KEY

UNITS = 48
# Size of the largest eigenvalue of the recurrent weights: below 1, so that old days fade.
RADIUS = 0.9
# Share of a unit's state that a day replaces.
LEAK = 0.3
# Share of the recurrent weights that are not 0.
DENSITY = 0.2

BOUNDS = [f"{c}_{end}" for c in BOUNDED for end in ("low", "span")]


@dataclass
class Reservoir:
    """state = (1 - leak) * state + leak * tanh(inputs x + recurrent state + bias), from zeros.
    `features` are the columns of x, the quantity first."""

    features: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    leak: float = 1.0

    def step(self, states: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The next states of many series, one row each."""
        new = np.tanh(x @ self.inputs.T + states @ self.recurrent.T + self.bias)
        return (1.0 - self.leak) * states + self.leak * new

    def fold(self, x: np.ndarray) -> np.ndarray:
        """The states of one series before its first day, after each of its days."""
        driven = x @ self.inputs.T + self.bias
        states = np.zeros((len(x) + 1, len(self.bias)))
        for t, day in enumerate(driven):
            states[t + 1] = (1.0 - self.leak) * states[t] + self.leak * np.tanh(day + self.recurrent @ states[t])
        return states


def seeded(features: list[str], units: int = UNITS, radius: float = RADIUS, leak: float = LEAK, seed: int = 42) -> Reservoir:
    """Random weights that are the same for the same arguments."""
    r = np.random.default_rng(seed)
    recurrent = r.uniform(-1, 1, (units, units)) * (r.random((units, units)) < DENSITY)
    largest = np.abs(np.linalg.eigvals(recurrent)).max()
    recurrent *= radius / largest if largest else 0.0
    return Reservoir(list(features), r.uniform(-1, 1, (units, len(features))), recurrent, r.uniform(-0.5, 0.5, units), leak)


def _folded(reservoir: Reservoir, rows: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(DAY, "ascending")]))
        x = np.column_stack([np.asarray(table.column(c).combine_chunks()) for c in reservoir.features])
        return rows(table, x, reservoir.fold(x))

    return run


def _lists(values: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def samples(scaled: DataFrame, reservoir: Reservoir, seq_length: int = SEQ_LENGTH) -> DataFrame:
    """Model input, one row per day after the first `seq_length` ones: the state after the day
    before (`window`), that day's features (`last`) and the day's `quantity`. Columns and split
    are those of `samples.samples`."""
    columns = [KEY, DAY, "sample", "samples", "quantity", *BOUNDS]

    def rows(table: pa.Table, x: np.ndarray, states: np.ndarray) -> pa.Table:
        at = np.arange(seq_length, len(x))
        held = table.select(columns).take(pa.array(at)).combine_chunks()
        return held.append_column("window", _lists(states[at])).append_column("last", _lists(x[at - 1]))

    given = numbered(scaled, seq_length)
    types = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in columns), "window array<double>", "last array<double>"])
    return given.groupBy(KEY).applyInArrow(_folded(reservoir, rows), schema)


def end_states(scaled: DataFrame, reservoir: Reservoir, seq_length: int = SEQ_LENGTH) -> DataFrame:
    """One row per product with `seq_length` days or more: its last `day`, the state after it
    (`window`), that day's features (`last`) and the bounds of the scaling."""
    columns = [KEY, DAY, *BOUNDS]

    def rows(table: pa.Table, x: np.ndarray, states: np.ndarray) -> pa.Table:
        held = table.select(columns).slice(len(x) - 1).slice(0, 1 if len(x) >= seq_length else 0).combine_chunks()
        n = held.num_rows
        return held.append_column("window", _lists(states[len(x) : len(x) + n])).append_column("last", _lists(x[len(x) - 1 : len(x) - 1 + n]))

    types = {f.name: f.dataType.simpleString() for f in scaled.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in columns), "window array<double>", "last array<double>"])
    return scaled.select(KEY, DAY, *reservoir.features, *BOUNDS).groupBy(KEY).applyInArrow(_folded(reservoir, rows), schema)


def roll_forward(states: DataFrame, reservoir: Reservoir, weights: list[float], constant: float, horizon: int) -> DataFrame:
    """Replace `window` and `last` by `path`, the scaled predictions for `horizon` days. Each
    prediction is the quantity of the next day read; its other features stay as they are."""
    kept = [f for f in states.schema if f.name not in ("window", "last")]
    readout = np.array(weights)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            state, x = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1).astype(float) for c in ("window", "last"))
            path = np.zeros((batch.num_rows, horizon))
            for k in range(horizon):
                path[:, k] = constant + np.concatenate((state, x), axis=1) @ readout
                x = np.concatenate((path[:, k : k + 1], x[:, 1:]), axis=1)
                state = reservoir.step(state, x)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), _lists(path)], [*(f.name for f in kept), "path"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "path array<double>"])
    return states.select(*[f.name for f in kept], "window", F.col("last")).mapInArrow(run, schema)
