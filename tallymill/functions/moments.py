"""Second moments of a table, summed in one pass, and the linear models that follow from them.

The moments of parts of a table add up, so tasks need not see each other's rows, and all that
a ridge regression asks for is in them: the weights for any strength, and the squared error of
any weights on the same or on other rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks that add up the sums of all others.
ADDERS = 16
# Directions whose variance is below this share of the largest one carry no information.
FLAT = 1e-12
SUMS = "part string, sums binary"


@dataclass
class Moments:
    """Sums of z z' for rows z = (1, features, target)."""

    sums: np.ndarray

    @property
    def rows(self) -> int:
        return round(float(self.sums[0, 0]))

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums)

    def centered(self) -> tuple[np.ndarray, np.ndarray]:
        """Means, and the covariances of features and target."""
        mean = self.sums[0] / self.sums[0, 0]
        return mean, (self.sums / self.sums[0, 0] - np.outer(mean, mean))[1:, 1:]

    def error(self, fit: LinearFit) -> float | None:
        """Mean squared error of the fit on these rows."""
        if not self.rows:
            return None
        off = np.concatenate(([-fit.intercept], -np.asarray(fit.coefficients), [1.0]))
        return max(0.0, float(off @ self.sums @ off / self.sums[0, 0]))


@dataclass
class LinearFit:
    coefficients: DenseVector
    intercept: float
    strength: float
    validation_mse: float | None = None


def sums_batch(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    held = [pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(held, ["part", "sums"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column("vector")
        n = len(vectors)
        if not n:
            continue
        features = np.asarray(vectors.flatten()).reshape(n, -1)
        rows = np.column_stack((np.ones(n), features, np.asarray(batch.column("target"))))
        parts = batch.column("part").dictionary_encode()
        # A null has become a NaN.
        at = np.where(np.isnan(rows).any(axis=1), -1, np.asarray(parts.indices))
        for k, part in enumerate(parts.dictionary.to_pylist()):
            own = rows[at == k]
            sums[part] = sums.get(part, 0.0) + own.T @ own
    yield sums_batch(sums)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, held in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            sums[part] = sums.get(part, 0.0) + np.frombuffer(held)
    yield sums_batch(sums)


def moments(rows: DataFrame, vector: str, target: str, part: str) -> dict[str, Moments]:
    """The moments of each value of `part` (few), from one pass over `rows`: `vector` is an array
    of doubles of one length, `target` a double. Rows with a null or NaN in any are left out.

    Each task sends one matrix per part; ADDERS tasks add them up, and the driver adds theirs.
    """
    known = rows.select(F.col(part).alias("part"), F.col(vector).alias("vector"), F.col(target).cast("double").alias("target"))
    return added(known.dropna().mapInArrow(_summed, SUMS))


def added(sums: DataFrame) -> dict[str, Moments]:
    """The moments of each part, from the matrices (`SUMS`) that tasks have made."""
    sums = sums.withColumn("adder", F.pmod(F.spark_partition_id(), F.lit(ADDERS)))
    out: dict[str, Moments] = {}
    for name, held in sums.repartition(ADDERS, "adder").mapInArrow(_added, SUMS).collect():
        flat = np.frombuffer(held)
        size = int(round(len(flat) ** 0.5))
        own = Moments(flat.reshape(size, size))
        out[name] = out[name] + own if name in out else own
    return out


def ridge(train: Moments, strengths: Sequence[float]) -> list[LinearFit]:
    """For each strength s the weights w and constant with the least mean squared error / 2 +
    s / 2 * |w|², all from one decomposition; of equally good ones the shortest."""
    mean, spread = train.centered()
    values, axes = np.linalg.eigh(spread[:-1, :-1])
    values = np.where(values > FLAT * max(values.max(initial=0.0), 0.0), values, 0.0)
    along = axes.T @ spread[:-1, -1]
    fits = []
    for s in strengths:
        weights = axes @ np.divide(along, values + s, out=np.zeros_like(along), where=values + s > 0)
        fits.append(LinearFit(DenseVector(weights), float(mean[-1] - weights @ mean[1:-1]), float(s)))
    return fits


def choose(fits: Sequence[LinearFit], validation: Moments | None) -> LinearFit:
    """The fit with the smallest error on the validation rows, the first of equal ones; without
    such rows the first."""
    for fit in fits:
        fit.validation_mse = validation.error(fit) if validation else None
    known = [f for f in fits if f.validation_mse is not None]
    return min(known, key=lambda f: f.validation_mse) if known else fits[0]
