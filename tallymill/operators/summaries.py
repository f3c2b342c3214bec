"""A summary of the sales that any later report by its keys or days is drawn from.

Sums add up; distinct customers and invoices are kept as HyperLogLog sketches and prices as
quantile sketches, which merge, so a roll-up reads the summary and never the sales again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("day", "stock_code", "country")
# 2 to this power registers: a standard error of about 1.6 percent; small counts are exact.
REGISTERS = 12
# Size of a quantile sketch: ranks are off by about 1.3 percent.
QUANTILE_SIZE = 200
QUARTILES = (0.25, 0.5, 0.75)
DISTINCT = {"customers": "customer_id", "invoices": "invoice"}


def summarize(sales: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per value of `keys` (`day` comes from the time of sale, `year_month` with it):
    lines, units, revenue, and sketches of customers, invoices and prices.

    A null key is a group of its own. Unknown customers, invoices and prices are in no sketch.
    """
    day = F.to_date("invoice_ts")
    rows = sales.withColumns({"day": day, "year_month": F.date_format(day, "yyyy-MM")})
    names = [*keys, *["year_month"] * ("day" in keys)]
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(REGISTERS)).alias(name) for name, c in DISTINCT.items()]
    return rows.groupBy(*names).agg(
        F.count("*").alias("lines"),
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("units"),
        F.coalesce(F.sum(F.col("quantity") * F.col("price")), F.lit(0.0)).alias("revenue"),
        *sketches,
        F.kll_sketch_agg_double(F.col("price").cast("double"), F.lit(QUANTILE_SIZE)).alias("prices"),
    )


def _merged(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return summary.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("lines", "units", "revenue")],
        *[F.hll_union_agg(c).alias(c) for c in DISTINCT],
        F.kll_merge_agg_double("prices", F.lit(QUANTILE_SIZE)).alias("prices"),
    )


def coarser(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """The summary by fewer keys, itself a summary: what was summarised by day becomes months."""
    return _merged(summary, by)


def roll_up(summary: DataFrame, by: Sequence[str] = (), first_day=None, last_day=None) -> DataFrame:
    """lines, units, revenue, average line, distinct customers and invoices (approximate) and the
    quartiles of the price (approximate) per value of `by`, over days from `first_day` to
    `last_day`, both included."""
    if first_day is not None:
        summary = summary.filter(F.col("day") >= F.lit(first_day))
    if last_day is not None:
        summary = summary.filter(F.col("day") <= F.lit(last_day))
    merged = _merged(summary, by)
    known = F.kll_sketch_get_n_double("prices") > 0
    quartiles = [F.when(known, F.kll_sketch_get_quantile_double("prices", F.lit(q))).alias(f"price_q{i}") for i, q in enumerate(QUARTILES, 1)]
    counts = [F.hll_sketch_estimate(c).alias(c) for c in DISTINCT]
    return merged.select(*by, "lines", "units", "revenue", (F.col("revenue") / F.col("lines")).alias("avg_line"), *counts, *quartiles)
