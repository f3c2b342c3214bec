"""Visits: runs of events of one visitor without a long gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import stored


def _runs(rows: DataFrame, within: Sequence[str], start: str, end: str, gap: Column) -> DataFrame:
    """Adds `_run`: the number of the run within its group; a new one starts more than `gap`
    after the latest end so far."""
    order = Window.partitionBy(*within).orderBy(start, end)
    latest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(latest.isNull() | (F.col(start) > latest + gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def visits(events: DataFrame, by: Sequence[str], at: str, gap: str = "30 minutes", sums: Sequence[str] = ()) -> DataFrame:
    """(by, visit_start, visit_end, events, sums): a visit ends where the visitor's next event is
    more than `gap` away.

    The events are dealt by range of visitor and time, so a busy visitor's lie in many
    partitions. Each partition makes visits of its own; of a visitor who goes on in the next
    partition, only the first and the last visit of each partition are looked at again.

    - Events without a time are in no visit; a null visitor is one visitor.
    - Sums leave nulls out, and are null if there is nothing else.
    """
    pause = F.expr(f"INTERVAL {gap}")
    rows = events.filter(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), *sums)
    order = [*by, "_at"]
    rows = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "visit-events")
    local = _runs(rows, ["_part", *by], "_at", "_at", pause).groupBy("_part", *by, "_run")
    local = local.agg(
        F.min("_at").alias("visit_start"), F.max("_at").alias("visit_end"), F.count("*").alias("events"), *[F.sum(c).alias(c) for c in sums]
    )
    own = Window.partitionBy("_part", *by)
    edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(own))
    local = stored(local.withColumn("_edge", edge).drop("_run"), "partition-visits")
    # No more than two rows for each visitor and partition.
    edges = _runs(local.filter("_edge"), by, "visit_start", "visit_end", pause).groupBy(*by, "_run")
    merged = edges.agg(
        F.min("visit_start").alias("visit_start"), F.max("visit_end").alias("visit_end"), F.sum("events").alias("events"), *[F.sum(c).alias(c) for c in sums]
    )
    names = [*by, "visit_start", "visit_end", "events", *sums]
    return local.filter(~F.col("_edge")).select(names).unionByName(merged.select(names))
