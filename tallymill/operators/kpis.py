"""The busiest month, weekday and hour, and the top product and country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.schema import WEEKDAYS

# KPI name -> the column whose best value it reports.
KPIS = {
    "busiest_month": "year_month",
    "busiest_weekday": "weekday",
    "busiest_hour": "hour",
    "top_product": "description",
    "top_country": "country",
}


def revenue_cube(df: DataFrame, by=(), kpis=tuple(KPIS)) -> DataFrame:
    """Revenue per value of every KPI column in one pass: by, kpi, key, hour, revenue.

    `key` is the value as text; hours also keep their number.
    """
    # A column of `by` is in every grouping, so its own KPI is told apart last.
    kpis = sorted(kpis, key=lambda k: KPIS[k] in by)
    columns = [KPIS[k] for k in kpis]
    sets = [[*by, c] if c not in by else list(by) for c in columns]
    rows = df.dropna(subset=list(by)) if by else df
    totals = rows.groupingSets(sets, *dict.fromkeys([*by, *columns])).agg(
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        *[F.grouping(c).alias(f"_{c}") for c in columns],
    )
    kpi = F.coalesce(*[F.when(F.col(f"_{KPIS[k]}") == 0, F.lit(k)) for k in kpis])
    key = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in columns])
    hour = F.col("hour") if "hour" in columns else F.lit(None).cast("int")
    return totals.select(
        *by, kpi.alias("kpi"), key.alias("key"), hour.alias("hour"), "revenue"
    ).filter(F.col("key").isNotNull())


def sales_kpis(df: DataFrame, by=(), kpis=tuple(KPIS)) -> DataFrame:
    """One row per KPI: its best key and that key's revenue. The first key wins a tie.

    The hour is written as a span such as `9:00 - 10:00`.
    """
    cube = revenue_cube(df, by, kpis)
    best = F.min(F.struct((-F.col("revenue")).alias("loss"), "hour", "key")).alias("best")
    winners = cube.groupBy(*by, "kpi").agg(best)
    span = F.concat(
        F.col("best.key"), F.lit(":00 - "), (F.col("best.hour") + 1).cast("string"), F.lit(":00")
    )
    return winners.select(
        *by,
        "kpi",
        F.when(F.col("kpi") == "busiest_hour", span).otherwise(F.col("best.key")).alias("key"),
        (-F.col("best.loss")).alias("revenue"),
    )


def product_trends(df: DataFrame) -> DataFrame:
    """Monthly, weekday and country revenue of every product in one table."""
    names = {"busiest_month": "month", "busiest_weekday": "weekday", "top_country": "country"}
    cube = revenue_cube(df, ["description"], tuple(names))
    trend = F.coalesce(*[F.when(F.col("kpi") == k, F.lit(v)) for k, v in names.items()])
    # Position in the week, so that a chart can show Monday first.
    place = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("key")).cast("int")
    return cube.select(
        "description",
        trend.alias("trend"),
        F.when(F.col("kpi") == "busiest_weekday", place).alias("weekday_place"),
        "key",
        "revenue",
    )
