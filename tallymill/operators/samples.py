"""Scaling, sliding windows and the split into training, validation and test samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.series import DAY, KEY, SPAN, by_day, feature_columns, whole_series

SEQ_LENGTH = 90
TRAIN_RATIO, VAL_RATIO = 0.7, 0.15
# Columns whose bounds travel along, to turn scaled values back.
BOUNDED = ("quantity", "our_price")


def _count_up_to(share: float, samples: Column) -> Column:
    return F.floor(samples * F.lit(float(share))).cast("int")


def min_max_scale(
    table: DataFrame,
    fit_on: str = "all",
    seq_length: int = SEQ_LENGTH,
    train_ratio: float = TRAIN_RATIO,
) -> DataFrame:
    """Every feature of a product on 0..1, as doubles; a constant feature becomes 0.

    Adds `quantity_low`, `quantity_span` and the same for the price. Bounds come from
    the whole series, or with `fit_on="train"` from the days before the validation part.
    The windows keep the partitioning by product, so nothing is shuffled again.
    """
    columns = feature_columns(table)
    rows = table.select(KEY, DAY, *[F.col(c).cast("double").alias(c) for c in columns])
    known = F.lit(True)
    if fit_on == "train":
        rows = rows.withColumns(
            {"_row": F.row_number().over(by_day()), "_samples": F.count("*").over(whole_series()) - seq_length}
        )
        known = F.col("_row") <= seq_length + _count_up_to(train_ratio, F.col("_samples"))
    elif fit_on != "all":
        raise ValueError("fit_on is 'all' or 'train'")
    low = {c: F.min(F.when(known, F.col(c))).over(whole_series()) for c in columns}
    high = {c: F.max(F.when(known, F.col(c))).over(whole_series()) for c in columns}
    bounds = rows.select(
        KEY,
        DAY,
        *columns,
        *[low[c].alias(f"{c}_low") for c in columns],
        *[high[c].alias(f"{c}_high") for c in columns],
    )

    def span(c: str) -> Column:
        width = F.col(f"{c}_high") - F.col(f"{c}_low")
        return F.when(width == 0, F.lit(1.0)).otherwise(width)

    return bounds.select(
        KEY,
        DAY,
        *[((F.col(c) - F.col(f"{c}_low")) / span(c)).alias(c) for c in columns],
        *[F.col(f"{c}_low") for c in BOUNDED],
        *[span(c).alias(f"{c}_span") for c in BOUNDED],
    )


def scaled_features(scaled: DataFrame) -> list[str]:
    extra = {f"{c}_{end}" for c in BOUNDED for end in ("low", "span")}
    return [c for c in feature_columns(scaled) if c not in extra]


def numbered(scaled: DataFrame, seq_length: int = SEQ_LENGTH) -> DataFrame:
    """Sample number of each day, from 1 for the first day with a full window before it."""
    return scaled.withColumns(
        {
            "sample": F.row_number().over(by_day()) - seq_length,
            "samples": (F.count("*").over(whole_series()) - seq_length).cast("int"),
        }
    )


def sequences(scaled: DataFrame, seq_length: int = SEQ_LENGTH, horizon: int = 1, columns=None) -> DataFrame:
    """One row per window: `window` holds an array of feature values for each of its days,
    `target` the scaled quantities of the `horizon` days after it. `day` is the first of these.

    A window repeats each day `seq_length` times, so pass only the `columns` you need.
    """
    columns = list(columns or scaled_features(scaled))
    past, ahead = by_day().rowsBetween(-seq_length, -1), by_day().rowsBetween(0, horizon - 1)
    step = F.array(*columns)
    rows = scaled.select(
        KEY,
        DAY,
        (F.row_number().over(by_day()) - seq_length).alias("sample"),
        F.collect_list(step).over(past).alias("window"),
        F.collect_list("quantity").over(ahead).alias("target"),
    )
    return rows.filter((F.col("sample") > 0) & (F.size("target") == horizon))


def samples(scaled: DataFrame, seq_length: int = SEQ_LENGTH) -> DataFrame:
    """Model input, one row per day with a full window before it: the window's quantities
    (`window`), the other features of its last day (`last`) and the day's `quantity`."""
    others = [c for c in scaled_features(scaled) if c != "quantity"]
    past = by_day().rowsBetween(-seq_length, -1)
    rows = numbered(scaled, seq_length).withColumns(
        {
            "window": F.collect_list("quantity").over(past),
            "last": F.lag(F.array(*others), 1).over(by_day()),
        }
    )
    bounds = [f"{c}_{end}" for c in BOUNDED for end in ("low", "span")]
    return rows.filter("sample > 0").select(
        KEY, DAY, "sample", "samples", "window", "last", "quantity", *bounds
    )


def split(numbered: DataFrame, train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO) -> DataFrame:
    """Add `part`: train, validation, test in order of time, both sizes rounded down."""
    train = _count_up_to(train_ratio, F.col("samples"))
    validation = _count_up_to(val_ratio, F.col("samples"))
    part = (
        F.when(F.col("sample") <= train, "train")
        .when(F.col("sample") <= train + validation, "validation")
        .otherwise("test")
    )
    return numbered.withColumn("part", part)


def numbered_days(scaled: DataFrame, seq_length: int = SEQ_LENGTH) -> DataFrame:
    """The days that are samples, without their windows: enough to see the split."""
    return numbered(scaled.select(KEY, DAY), seq_length).filter("sample > 0")


def usable(
    table: DataFrame,
    seq_length: int = SEQ_LENGTH,
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
) -> DataFrame:
    """Per product: days, samples, and `reason` why it cannot be forecast, or null. `table` has a
    row per day, or for several days (`series.day_spans`)."""
    held = F.sum(SPAN) if SPAN in table.columns else F.count("*")
    days = table.groupBy(KEY).agg(held.cast("int").alias("days"))
    counted = days.withColumn("samples", F.greatest(F.col("days") - seq_length, F.lit(0)))
    reason = (
        F.when(F.col("samples") < 1, "not enough days for one window")
        .when(_count_up_to(val_ratio, F.col("samples")) < 1, "no validation samples")
        .when(_count_up_to(train_ratio, F.col("samples")) < 1, "no training samples")
    )
    return counted.withColumn("reason", reason)
