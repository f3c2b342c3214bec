"""Joins on time: the value in force at a moment, and moments or periods within periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.joins import if_small, is_small
from tallymill.session import stored

# Moments that meet one copy of a bucket's periods.
MOMENTS_PER_COPY = 200_000


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Every row of `left`, with `columns` of the latest row of `right` that has the same `by`
    and an `on` that is not later (with `strict`: that is earlier); nulls where there is none.

    Both tables are sorted together by range of (`by`, `on`), so the rows of one key may lie in
    many partitions. Within a partition the last value is carried from row to row; across
    partitions one row for each carries it on.

    - A null `by` or `on` matches nothing.
    - Of several rows of `right` with the same `by` and `on` the one with the largest `columns`,
      in their order, counts.
    - `columns` must not be columns of `left`.
    """
    known = right.dropna(subset=[*by, on])
    kind = {"left": 0 if strict else 1, "right": 1 if strict else 0}
    mine = left.select(*by, F.col(on), F.lit(kind["left"]).alias("_kind"), F.struct(*left.columns).alias("_left"))
    theirs = known.select(*by, F.col(on), F.lit(kind["right"]).alias("_kind"), F.struct(*columns).alias("_right"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    # Equal moments of a key are dealt out too, as far as the order allows.
    order = [*by, on, "_kind", "_right", F.xxhash64("_left")]
    both = stored(both.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "asof-rows")

    # One row per partition: its last value, which holds until the next one's.
    ends = both.filter(F.col("_right").isNotNull()).groupBy("_part").agg(F.max(F.struct(*by, on, "_right")).alias("_end"))
    final = both.agg(F.max("_part")).first()[0] or 0
    ends = ends.withColumn("_until", F.coalesce(F.lead("_part").over(Window.orderBy("_part")), F.lit(final)))
    next_part = F.col("_part") + 1
    carried = ends.select(F.explode(F.sequence(next_part, F.greatest("_until", next_part))).alias("_part"), "_end")
    carried = stored(carried, "carried-values")

    so_far = Window.partitionBy("_part", *by).orderBy(on, "_kind", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_last", F.last("_right", ignorenulls=True).over(so_far)).filter(F.col("_left").isNotNull())
    joined = filled.join(if_small(carried), "_part", "left")
    same = F.lit(True)
    for name in by:
        same = same & (F.col(name) == F.col(f"_end.{name}"))
    value = F.when(F.col("_last").isNotNull(), F.col("_last")).when(same & F.col(on).isNotNull(), F.col("_end._right"))
    return joined.select("_left.*", value.alias("_value")).select(*left.columns, *[F.col(f"_value.{c}").alias(c) for c in columns])


def _number(moment: Column, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(moment).cast("long")
    return F.unix_micros(moment.cast("timestamp")) if kind.startswith("timestamp") else moment.cast("long")


def _shifted(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def between_join(moments: DataFrame, periods: DataFrame, at: str, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of a row of `moments` and a row of `periods` with the same `by` and `start` <= `at`
    <= `end`, with all columns of both, `by` once. Moments are dates, times or whole numbers.

    Periods are kept in buckets of widths that are powers of two: each in the one or two
    buckets of the least width above its length, however long it is. A moment looks into one
    bucket of each width that occurs, so a pair meets once. Where the buckets are too large for
    a broadcast, those of which many moments ask are copied, and each copy serves part of them.

    - A null `by`, `at`, `start` or `end`, or an `end` before `start`, matches nothing.
    - Repeated rows give repeated pairs.
    - Other columns of both tables must have different names.
    """
    names = [c for c in (*moments.columns, *[c for c in periods.columns if c not in by])]
    first, last = (_number(F.col(c), periods.schema[c].dataType.typeName()) for c in (start, end))
    known = periods.dropna(subset=[*by]).withColumns({"_first": first, "_last": last}).filter("_last >= _first")
    width = F.when(F.col("_last") == F.col("_first"), 0).otherwise(F.length(F.bin(F.col("_last") - F.col("_first"))))
    known = known.withColumn("_level", width)
    places = F.array_distinct(F.array(*[_shifted(F.col(c), F.col("_level")) for c in ("_first", "_last")]))
    buckets = stored(known.withColumn("_bucket", F.explode(places)), "period-buckets")
    # No more than the bits of a moment.
    levels = sorted(r[0] for r in buckets.select("_level").distinct().collect())

    spot = _number(F.col(at), moments.schema[at].dataType.typeName())
    asked = moments.dropna(subset=[*by, at]).withColumn("_at", spot)
    asked = asked.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    asked = asked.withColumn("_bucket", _shifted(F.col("_at"), F.col("_level")))
    keys = [*by, "_level", "_bucket"]
    if is_small(buckets):
        pairs = asked.join(F.broadcast(buckets), keys)
    else:
        # Copies of a bucket without periods cost nothing, so the keys of these aren't joined.
        crowd = asked.groupBy(keys).agg(F.count("*").alias("_asked")).filter(F.col("_asked") > MOMENTS_PER_COPY)
        crowd = stored(crowd, "asked-buckets")
        copies = F.ceil(F.coalesce("_asked", F.lit(1)) / MOMENTS_PER_COPY)
        # A crowded bucket has MOMENTS_PER_COPY moments at least, so there are few of them.
        crowded = if_small(crowd)
        asked = asked.join(crowded, keys, "left").withColumn("_copy", F.pmod(F.monotonically_increasing_id(), copies))
        copied = buckets.join(crowded, keys, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
        # Else Spark may send a table to the driver for a broadcast: it goes by the size of the
        # files, which rows take many times, and of moments without their copies for each width.
        pairs = asked.drop("_asked").join(copied.drop("_asked").hint("merge"), [*keys, "_copy"])
    return pairs.filter((F.col("_first") <= F.col("_at")) & (F.col("_at") <= F.col("_last"))).select(names)


def overlap_join(one: DataFrame, two: DataFrame, periods: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows with the same `by` whose periods have a moment in common; `periods` names
    the (start, end) of `one` and of `two`, which are closed. A pair meets once: where the later
    start lies in the other period, that of `two` if both start at once.

    Nulls, reversed periods, repeated rows and names as in `between_join`.
    """
    (start_1, end_1), (start_2, end_2) = periods
    names = [*one.columns, *[c for c in two.columns if c not in by]]
    # Each serves as buckets, as moments and for the count of these, in one join or the other.
    good_1 = stored(one.filter(F.col(start_1) <= F.col(end_1)), "periods")
    good_2 = stored(two.filter(F.col(start_2) <= F.col(end_2)), "other-periods")
    inside = between_join(good_2, good_1, start_2, start_1, end_1, by).select(names)
    around = between_join(good_1, good_2, start_1, start_2, end_2, by).filter(F.col(start_1) > F.col(start_2))
    return inside.unionByName(around.select(names))
