"""Samples of the linear model from `series.day_spans`: one row per product holds its spans.

Products that sell on few days have many more days than sales. Their days are not made as
rows of a table: each task lays out the days of one product after the other as arrays, and
sends on sums, test days and end states only. The samples are those of `samples.samples`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.moments import SUMS, Moments, added, sums_batch
from tallymill.operators.models import DemandModel, linear_weights
from tallymill.operators.samples import BOUNDED, SEQ_LENGTH, TRAIN_RATIO, VAL_RATIO
from tallymill.operators.series import DAY, KEY, SPAN, feature_columns

# Products whose test days a task holds at once.
SLICE = 1000
BOUNDS = [f"{c}_{end}" for c in BOUNDED for end in ("low", "span")]
STATES = f"{KEY} string, {DAY} date, window array<double>, last array<double>, {', '.join(f'{c} double' for c in BOUNDS)}"
TESTED = f"{KEY} string, days array<date>, actual array<double>, predicted array<double>"


def span_features(spans: DataFrame) -> list[str]:
    return [c for c in feature_columns(spans) if c != SPAN]


def by_product(spans: DataFrame) -> DataFrame:
    """One row per product: its key, and an array of each other column in the order of days."""
    names = [DAY, SPAN, *span_features(spans)]
    held = F.array_sort(F.collect_list(F.struct(DAY, *[F.col(c).cast("double" if c != SPAN else "int").alias(c) for c in names[1:]])))
    rows = spans.groupBy(KEY).agg(held.alias("_spans"))
    return rows.select(KEY, *[F.col("_spans")[c].alias(c) for c in names])


@dataclass(frozen=True)
class Windows:
    """How the days of a product become samples; see `samples` for the arguments."""

    features: tuple[str, ...]
    fit_on: str = "all"
    seq_length: int = SEQ_LENGTH
    train_ratio: float = TRAIN_RATIO
    val_ratio: float = VAL_RATIO

    def ends(self, n: int) -> tuple[int, int]:
        """The samples in the training part, and in that and the validation part."""
        train = int(np.floor((n - self.seq_length) * self.train_ratio))
        return train, train + int(np.floor((n - self.seq_length) * self.val_ratio))

    def series(self, batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each product: key, days (since 1970), scaled features by day, and their lows and spans."""
        keys = batch.column(KEY).to_pylist()
        starts = batch.column(DAY).offsets.to_numpy()
        held = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (SPAN, *self.features)}
        held[DAY] = batch.column(DAY).flatten().cast(pa.int32()).to_numpy(zero_copy_only=False)
        starts = starts - starts[0]
        for key, a, b in zip(keys, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            lengths = held[SPAN][a:b]
            sold = np.cumsum(lengths) - lengths
            n = int(lengths.sum())
            days = np.arange(n) + np.repeat(held[DAY][a:b] - sold, lengths)
            rows = np.empty((n, len(self.features)))
            rows[:, 0] = 0.0
            rows[sold, 0] = held["quantity"][a:b]
            for i, c in enumerate(self.features[1:], 1):
                rows[:, i] = np.repeat(held[c][a:b], lengths)
            known = rows if self.fit_on == "all" else rows[: self.seq_length + self.ends(n)[0]]
            # A NaN is above all numbers, as in Spark.
            low, high = np.fmin.reduce(known), np.max(known, axis=0)
            span = np.where(high == low, 1.0, high - low)
            yield key, days, (rows - low) / span, low, span

    def matrix(self, rows: np.ndarray, first: int) -> np.ndarray:
        """The samples from number `first` (0 for the first one) on: window, and the last day's
        other features."""
        size = self.seq_length
        windows = np.lib.stride_tricks.sliding_window_view(rows[first:-1, 0], size)
        return np.column_stack((windows, rows[first + size - 1 : -1, 1:]))

    def moments(self, products: DataFrame) -> dict[str, Moments]:
        """As `functions.moments.moments` for the training and validation samples."""
        return added(products.mapInArrow(self._sums, SUMS))

    def _sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for _, _, rows, _, _ in self.series(batch):
                train, checked = self.ends(len(rows))
                found = self.matrix(rows, 0)
                found = np.column_stack((np.ones(len(found)), found, rows[self.seq_length :, 0]))
                for part, own in (("train", found[:train]), ("validation", found[train:checked])):
                    if np.isnan(own).any():
                        own = own[~np.isnan(own).any(axis=1)]
                    sums[part] = sums.get(part, 0.0) + own.T @ own
        yield sums_batch(sums)

    def test_predictions(self, products: DataFrame, model: DemandModel) -> DataFrame:
        """As `models.test_predictions`."""
        if model.model is None:
            empty = f"{KEY} string, {DAY} date, actual double, predicted double"
            return products.sparkSession.createDataFrame([], empty)
        own, other, constant = linear_weights(model)
        weights = np.array([*own, *other])

        def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slices = (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE))
            for batch in slices:
                keys, sizes, days, actual, predicted = [], [0], [], [], []
                for key, at, rows, low, span in self.series(batch):
                    first = self.ends(len(rows))[1]
                    keys.append(key)
                    days.append(at[first + self.seq_length :])
                    sizes.append(len(days[-1]))
                    actual.append(rows[first + self.seq_length :, 0] * span[0] + low[0])
                    predicted.append((self.matrix(rows, first) @ weights + constant) * span[0] + low[0])
                offsets = pa.array(np.cumsum(sizes), pa.int32())
                dates = pa.array(np.concatenate(days).astype(np.int32)).cast(pa.date32())
                values = [dates, *[pa.array(np.concatenate(x)) for x in (actual, predicted)]]
                lists = [pa.ListArray.from_arrays(offsets, x) for x in values]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *lists], [KEY, "days", "actual", "predicted"])

        found = products.mapInArrow(tested, TESTED)
        row: Column = F.explode(F.arrays_zip("days", "actual", "predicted")).alias("_row")
        return found.select(KEY, row).select(KEY, F.col("_row.days").alias(DAY), "_row.actual", "_row.predicted")

    def end_states(self, products: DataFrame) -> DataFrame:
        """As `models.last_windows`."""
        return products.mapInArrow(self._ends, STATES)

    def _ends(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [self.features.index(c) for c in BOUNDED]
        names = [KEY, DAY, "window", "last", *BOUNDS]
        for batch in batches:
            out = []
            for key, days, rows, low, span in self.series(batch):
                bounds = [float(x[i]) for i in places for x in (low, span)]
                out.append((key, int(days[-1]), rows[-self.seq_length :, 0].tolist(), rows[-1, 1:].tolist(), *bounds))
            if out:
                columns = [list(x) for x in zip(*out, strict=True)]
                days = pa.array(columns[1], pa.int32()).cast(pa.date32())
                lists = [pa.array(x, pa.list_(pa.float64())) for x in columns[2:4]]
                held = [pa.array(columns[0], pa.string()), days, *lists, *[pa.array(x, pa.float64()) for x in columns[4:]]]
                yield pa.RecordBatch.from_arrays(held, names)
