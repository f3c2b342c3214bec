"""Many K-Means fits over the same points in shared passes.

An elbow curve asks for many numbers of clusters, each from several starts. Fitting them
one after the other reads the points once per fit and round. Here a round is one pass:
every task assigns its points to the nearest centre of each fit and gives partial sums,
Spark adds them up, and the driver moves the centres, a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A fit ends when its centres together move less than this (squared, as a share of the variance).
TOLERANCE = 1e-4


@dataclass
class Fit:
    k: int
    start: int
    centers: np.ndarray
    cost: float = float("inf")
    moving: bool = True


def best_fits(
    points: DataFrame, columns: Sequence[str], key: str, ks: Sequence[int], starts: int, max_iter: int, seed: int
) -> dict[int, Fit]:
    """The cheapest of `starts` fits for each k. `columns` should have mean 0 and deviation 1;
    `key` tells rows apart, so that the draws do not depend on their order. Persist `points`."""
    if points.isEmpty():
        return {}
    seeds = _first_centers(points, columns, key, max(ks), starts, seed)
    # The first k centres of a start are a proper start for k clusters.
    fits = [Fit(k, s, seeds[s][:k].copy()) for k in ks for s in range(starts)]
    for _ in range(max_iter):
        active = [fit for fit in fits if fit.moving]
        if not active:
            break
        for fit, (counts, sums, _) in zip(active, _pass(points, columns, active)):
            moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], fit.centers)
            fit.moving = float(((moved - fit.centers) ** 2).sum()) > TOLERANCE
            fit.centers = moved
    for fit, (_, _, cost) in zip(fits, _pass(points, columns, fits)):
        fit.cost = cost
    return {k: min((f for f in fits if f.k == k), key=lambda f: (f.cost, f.start)) for k in ks}


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre, one axis at a time to save memory."""
    total = np.zeros((len(x), len(centers)))
    for axis in range(centers.shape[1]):
        total += (x[:, axis, None] - centers[None, :, axis]) ** 2
    return total


def _uniform(hashes: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1] from row hashes, a different set for each draw."""
    z = hashes.astype(np.uint64) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)) + 1.0) / 2.0**53


def _first_centers(points, columns, key, size, starts, seed) -> list[np.ndarray]:
    """Centres chosen one by one. Some points are drawn, each with a chance in proportion to
    its squared distance from the centres so far, and the one that lowers the sum of squared
    distances most becomes the next centre."""
    trials = 2 + int(np.log(size))
    chosen = [np.empty((0, len(columns))) for _ in range(starts)]
    for step in range(size):
        drawn = _draw(points, columns, key, chosen, trials if step else 1, (seed, step))
        if step:
            costs = _costs_with(points, columns, chosen, drawn)
            drawn = [options[[int(np.argmin(cost))]] for options, cost in zip(drawn, costs)]
        chosen = [np.vstack([centers, option]) for centers, option in zip(chosen, drawn)]
    return chosen


def _draw(points, columns, key, chosen, trials, salt) -> list[np.ndarray]:
    """`trials` points per start. The smallest of `-log(u) / weight` is a draw by weight, and a
    minimum combines over tasks. u comes from a hash of the row, so a repeated task draws the same."""
    names = [f"x{i}" for i in range(len(columns))]
    numbers = [F.col(c).alias(n) for c, n in zip(columns, names)]
    hashed = F.xxhash64(F.col(key), *[F.lit(part) for part in salt]).alias("hash")

    def race(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x, hashes = batch[names].to_numpy(), batch["hash"].to_numpy()
            rows = []
            for s, centers in enumerate(chosen):
                weight = _distances(x, centers).min(axis=1) if len(centers) else np.ones(len(x))
                for t in range(trials):
                    arrival = np.full(len(x), np.inf)
                    luck = -np.log(_uniform(hashes, s * trials + t))
                    np.divide(luck, weight, out=arrival, where=weight > 0)
                    # Rows at the same place in the race are ordered by value.
                    first = np.lexsort([*x.T[::-1], arrival])[0]
                    rows.append((s, t, arrival[first], *x[first]))
            yield pd.DataFrame(rows, columns=["start", "trial", "race", *names])

    schema = "start int, trial int, race double, " + ", ".join(f"{n} double" for n in names)
    raced = points.select(*numbers, hashed).mapInPandas(race, schema)
    best = raced.groupBy("start", "trial").agg(F.min(F.struct("race", *names)).alias("best")).collect()
    drawn = [np.empty((trials, len(columns))) for _ in chosen]
    for row in best:
        drawn[row.start][row.trial] = [row.best[n] for n in names]
    return drawn


def _costs_with(points, columns, chosen, drawn) -> list[np.ndarray]:
    """Per start and drawn point: the sum of squared distances if it became a centre."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(chosen), len(drawn[0])))
        for batch in batches:
            x = batch.to_numpy()
            for s, centers in enumerate(chosen):
                now = _distances(x, centers).min(axis=1)
                totals[s] += np.minimum(_distances(x, drawn[s]), now[:, None]).sum(axis=0)
        starts, trials = np.indices(totals.shape)
        yield pd.DataFrame({"start": starts.ravel(), "trial": trials.ravel(), "cost": totals.ravel()})

    partial = points.select(*columns).mapInPandas(add_up, "start int, trial int, cost double")
    costs = [np.zeros(len(options)) for options in drawn]
    for row in partial.groupBy("start", "trial").agg(F.sum("cost").alias("cost")).collect():
        costs[row.start][row.trial] = row.cost
    return costs


def _pass(points, columns, fits: list[Fit]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per fit: points per centre, their sums, and the sum of squared distances."""
    stacked = np.vstack([fit.centers for fit in fits])
    ends = np.cumsum([len(fit.centers) for fit in fits])
    ranges = [(int(end) - len(fit.centers), int(end)) for fit, end in zip(fits, ends)]
    names = [f"s{i}" for i in range(len(columns))]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(stacked), len(columns) + 2))
        for batch in batches:
            x = batch.to_numpy()
            own = (x**2).sum(axis=1)
            # Squared distance without the part that is the same for every centre, a row per centre.
            d = stacked @ (-2.0 * x.T) + (stacked**2).sum(axis=1)[:, None]
            values = np.column_stack([np.ones(len(x)), x])
            for low, high in ranges:
                least = d[low:high].min(axis=0)
                near = d[low:high] == least
                if near.sum() != len(x):
                    # Of equally near centres the first.
                    near = np.arange(high - low)[:, None] == d[low:high].argmin(axis=0)
                shares = near.astype(float)
                totals[low:high, :-1] += shares @ values
                totals[low:high, -1] += shares @ np.maximum(own + least, 0.0)
        held = np.flatnonzero(totals[:, 0])
        frame = pd.DataFrame(totals[held], columns=["n", *names, "cost"])
        frame.insert(0, "center", held.astype("int32"))
        yield frame

    schema = "center int, n double, " + ", ".join(f"{n} double" for n in names) + ", cost double"
    partial = points.select(*columns).mapInPandas(assign, schema)
    added = partial.groupBy("center").agg(*[F.sum(c).alias(c) for c in ("n", *names, "cost")]).collect()
    table = np.zeros((len(stacked), len(columns) + 2))
    for row in added:
        table[row.center] = row[1:]
    return [(table[a:b, 0], table[a:b, 1:-1], float(table[a:b, -1].sum())) for a, b in ranges]
