"""Exact interpolated quantiles of a whole column without gathering the column."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import stored

# Values around one rank that may be sorted in one list.
FETCH_ROWS = 200_000
# Rank error of the pivots, as a share of the rows that are still in question.
ACCURACY = 10_000


@dataclass(frozen=True)
class Gap:
    """The values strictly between two bounds hold a wanted rank; None is an open end."""

    low: float | None
    high: float | None
    below: int
    inside: int

    def holds(self, value: Column) -> Column:
        condition = value.isNotNull()
        if self.low is not None:
            condition = condition & (value > self.low)
        if self.high is not None:
            condition = condition & (value < self.high)
        return condition


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    fetch_rows: int = FETCH_ROWS,
    accuracy: int = ACCURACY,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column; None for a column without values.

    The values at the ranks around each quantile are found exactly, by narrowing down: a
    pass counts the rows below a few pivots, and the gap that holds the rank stays. Only
    counts, pivots and the last gap reach one task. All columns share the passes, and
    every size of table goes the same way. The passes read the columns alone from where
    they are stored, not what they come from.
    """
    df = stored(df.select(*wanted), "quantile-columns")
    # One pass for the sizes and the first pivots.
    asks = [F.count(c).alias(f"n_{c}") for c in wanted]
    for c, shares in wanted.items():
        near = [x for p in shares for x in _around(p, accuracy)]
        asks.append(F.percentile_approx(F.col(c).cast("double"), near, accuracy).alias(f"p_{c}"))
    seen = df.agg(*asks).first()
    ranks, gaps, pivots = {}, {}, {}
    for c in wanted:
        n = seen[f"n_{c}"]
        ranks[c] = [p * (n - 1) for p in wanted[c]] if n else []
        for i, position in enumerate(ranks[c]):
            for rank in {math.floor(position), math.ceil(position)}:
                gaps[c, rank] = Gap(None, None, 0, n)
                pivots.setdefault((c, rank), set()).update(seen[f"p_{c}"][3 * i : 3 * i + 3])
    values = _values_at(df, gaps, pivots, fetch_rows, accuracy)
    return {c: [_between(values, c, position) for position in ranks[c]] or None for c in wanted}


def _around(share: float, accuracy: int) -> list[float]:
    reach = 2.0 / accuracy
    return [max(0.0, share - reach), share, min(1.0, share + reach)]


def _between(values, column: str, position: float) -> float:
    """Measured from the nearer rank, so that equal steps from both sides agree."""
    low, high = values[column, math.floor(position)], values[column, math.ceil(position)]
    part = position - math.floor(position)
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def _values_at(df, gaps, pivots, fetch_rows, accuracy) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank of its sorted column."""
    found: dict[tuple[str, int], float] = {}

    def value(target) -> Column:
        return F.col(target[0]).cast("double")

    while gaps:
        gaps = _narrowed(df, gaps, pivots, found, value, fetch_rows, accuracy)
        near = {t: gap for t, gap in gaps.items() if gap.inside <= fetch_rows}
        if near:
            lists = [F.sort_array(F.collect_list(F.when(g.holds(value(t)), value(t)))) for t, g in near.items()]
            picks = [
                F.element_at(values, t[1] - near[t].below + 1).alias(f"v{i}")
                for i, (t, values) in enumerate(zip(near, lists))
            ]
            found.update(zip(near, df.agg(*picks).first()))
        gaps = {t: gap for t, gap in gaps.items() if t not in near}
        if gaps:
            asks = []
            for t, gap in gaps.items():
                shares = _around((t[1] - gap.below) / gap.inside, accuracy)
                asks.append(F.percentile_approx(F.when(gap.holds(value(t)), value(t)), shares, accuracy))
            pivots = {t: set(picked) for t, picked in zip(gaps, df.agg(*asks).first())}
    return found


def _narrowed(df, gaps, pivots, found, value, fetch_rows, accuracy) -> dict[tuple[str, int], Gap]:
    """Count around the pivots; a rank that falls on a pivot is found, others get a smaller gap.

    Pivots are values of the column, so every pass takes at least one value out. Where the
    outer pivots are certain to enclose few rows, the same pass picks the value from these.
    """
    counts, places = [], []
    picks = {}
    for t, gap in gaps.items():
        first, last = min(pivots[t]), max(pivots[t])
        # The outer pivots are 4 / accuracy apart, and each is off by 1 / accuracy at most.
        if 6 * gap.inside / accuracy <= fetch_rows:
            near = F.when(gap.holds(value(t)) & (value(t) > first) & (value(t) < last), value(t))
            before = F.count_if(gap.holds(value(t)) & (value(t) <= first))
            place = F.lit(t[1] - gap.below) - before
            # No value if the place is outside the list.
            picks[t] = F.get(F.sort_array(F.collect_list(near)), place.cast("int"))
    for t, gap in gaps.items():
        for pivot in sorted(pivots[t]):
            inside = gap.holds(value(t))
            counts.append(F.count_if(inside & (value(t) < pivot)))
            counts.append(F.count_if(inside & (value(t) <= pivot)))
            places.append((t, pivot))
    row = df.agg(*counts, *picks.values()).first()
    for t, picked in zip(picks, row[len(counts) :]):
        if picked is not None:
            found[t] = picked
    smaller = dict(gaps)
    for i, (t, pivot) in enumerate(places):
        gap, rank = smaller[t], t[1]
        under, upto = gaps[t].below + row[2 * i], gaps[t].below + row[2 * i + 1]
        end = gap.below + gap.inside
        if under <= rank < upto:
            found[t] = pivot
        elif upto <= rank:
            smaller[t] = replace(gap, low=pivot, below=upto, inside=end - upto)
        elif under < end:
            smaller[t] = replace(gap, high=pivot, inside=under - gap.below)
    return {t: gap for t, gap in smaller.items() if t not in found}
