import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.functions import joins
from tallymill.functions.holidays import is_uk_holiday, uk_holidays
from tallymill.functions.quantiles import exact_quantiles
from tallymill.functions.ranking import with_position
from tallymill.operators import cleaning

PROBABILITIES = (0.0, 0.2, 0.25, 0.5, 0.75, 0.8, 1.0)


@pytest.mark.parametrize("kind", ["spread", "hot", "few"])
def test_quantiles_equal_numpy_at_every_limit(spark, kind):
    rng = np.random.default_rng(7)
    values = {
        "spread": rng.normal(50, 20, 3000),
        # A third of the rows share one value, and another third a second one.
        "hot": np.concatenate([np.full(1000, 3.25), np.full(1000, 9.5), rng.uniform(0, 10, 1000)]),
        "few": rng.integers(1, 4, 3000).astype(float),
    }[kind]
    rows = [(float(v),) for v in values] + [(None,)] * 10
    df = spark.createDataFrame(rows, "v double").repartition(4)
    want = np.quantile(values, PROBABILITIES)
    # A coarse accuracy and a small limit force several rounds; the second picks the values
    # in the pass that counts around the pivots. All are the same numbers to the last digit.
    for options in ({}, {"fetch_rows": 20, "accuracy": 20}, {"fetch_rows": 200, "accuracy": 100}):
        assert exact_quantiles(df, {"v": PROBABILITIES}, **options)["v"] == want.tolist()


def test_rows_on_the_fence_stay_at_every_limit(spark, monkeypatch):
    """Cents whose upper fence is one of the values."""
    cents = [round(1 + 0.01 * k, 2) for k in range(55)]
    first, third = np.quantile(cents, [0.25, 0.75])
    fence = float(third + 1.5 * (third - first))
    values = [*cents, fence]
    for _ in range(50):  # the fence moves with the value on it
        first, third = np.quantile(values, [0.25, 0.75])
        values[-1] = float(third + 1.5 * (third - first))
    df = spark.createDataFrame([(v,) for v in values], "price double").repartition(3)
    kept = set()
    for fetch_rows in (100_000, 10, 3):
        monkeypatch.setattr(cleaning, "exact_quantiles", lambda d, w, n=fetch_rows: exact_quantiles(d, w, fetch_rows=n, accuracy=20))
        kept.add(cleaning.remove_outliers(df, ["price"]).count())
    assert kept == {56}


def test_columns_share_their_passes(spark):
    rng = np.random.default_rng(8)
    frame = {"a": rng.normal(0, 1, 500), "b": rng.integers(0, 5, 500).astype(float)}
    df = spark.createDataFrame(list(zip(*(map(float, v) for v in frame.values()))), "a double, b double")
    wanted = {"a": (0.2, 0.4, 0.6, 0.8), "b": (0.25, 0.75)}
    for options in ({}, {"fetch_rows": 5, "accuracy": 50}):
        got = exact_quantiles(df, wanted, **options)
        for c, shares in wanted.items():
            assert got[c] == np.quantile(frame[c], shares).tolist()


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, {"v": [0.5]}) == {"v": None}


def test_position_over_hot_value(spark):
    rng = random.Random(3)
    ids = [f"c{i:04d}" for i in range(2000)]
    rows = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 40)) for i in ids]
    df = spark.createDataFrame(rows, "id string, n int").repartition(7)
    got = {r.id: r.position for r in with_position(df, "n", "id").collect()}
    want = {i: p for p, (_, i) in enumerate(sorted((n, i) for i, n in rows), 1)}
    assert got == want
    assert with_position(df, "n", "id").select("position_count").distinct().collect() == [(2000,)]


@pytest.mark.parametrize("broadcast_bytes", [100_000, 0])
def test_lookup_of_hot_and_null_keys(spark, broadcast_bytes):
    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(100)]
    rows += [(f"k{i}", i) for i in range(300)]
    fact = spark.createDataFrame(rows, "k string, v int")
    table = spark.createDataFrame([("hot", "H"), *[(f"k{i}", f"K{i}") for i in range(200)]], "k string, name string")
    got = joins.lookup(fact, table, "k", broadcast_bytes=broadcast_bytes, hot_share=0.1, salts=8)
    assert got.columns == ["k", "v", "name"]
    found = {"hot": "H", **{f"k{i}": f"K{i}" for i in range(200)}}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        ((k, v, found.get(k)) for k, v in rows), key=str
    )


def test_lookup_spreads_the_hot_key(spark):
    fact = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    table = spark.createDataFrame([("hot", "H"), ("cold", "C")], "k string, name string")
    joined = joins.lookup(fact, table, "k", broadcast_bytes=0, hot_share=0.1, salts=8)
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "_salt" in plan and "explode" in plan
    # Equal rows are spread too, and types without a hash do no harm.
    same = fact.select("k", F.lit(1).alias("v"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    joined = joins.lookup(same, table, "k", broadcast_bytes=0, hot_share=0.1, salts=8)
    assert joined.filter("name = 'H'").count() == 4000


def test_size_is_measured_in_bytes(spark):
    wide = spark.range(10).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert joins.is_small(wide, 20_000) and not joins.is_small(wide, 10_000)


def test_shared_folder_is_empty_after_release(spark):
    from pathlib import Path

    from tallymill import session

    kept = session.checkpointed(spark.range(5))
    assert session.stored(spark.range(7), "numbers").count() == 7 and kept.count() == 5
    folder = Path(session.shared_folder(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    session.release(spark)
    assert not any(folder.iterdir())
    assert session.stored(spark.range(7), "numbers").count() == 7


# Easter Sundays.
EASTER = {1961: "1961-04-02", 2000: "2000-04-23", 2008: "2008-03-23", 2010: "2010-04-04", 2011: "2011-04-24", 2024: "2024-03-31", 2038: "2038-04-25"}


def test_holidays(spark):
    table = {r.day: r.name for r in uk_holidays(spark, 1960, 2040).collect()}
    for year, sunday in EASTER.items():
        monday = dt.date.fromisoformat(sunday) + dt.timedelta(days=1)
        assert table[monday] == "Easter Monday"
        assert table[monday - dt.timedelta(days=3)] == "Good Friday"
    days_of_2010 = sorted(d.isoformat()[5:] for d in table if d.year == 2010)
    assert days_of_2010 == ["01-01", "04-02", "04-05", "05-03", "05-31", "08-30", "12-25", "12-26", "12-27", "12-28"]
    assert dt.date(2012, 5, 28) not in table and dt.date(2012, 6, 4) in table
    assert dt.date(2022, 12, 27) in table and dt.date(1977, 5, 2) not in table
    # Eras: no New Year's Day before 1974, Whit Monday and early August before 1971.
    assert dt.date(1973, 1, 1) not in table and dt.date(1974, 1, 1) in table
    assert dt.date(1970, 5, 18) in table and dt.date(1970, 8, 3) in table and dt.date(1970, 8, 31) not in table
    assert dt.date(1977, 6, 7) in table and dt.date(1981, 7, 29) in table


def test_the_flag_agrees_with_the_table_in_any_year(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1860-01-01', DATE'2310-12-31')) AS day")
    flagged = {r.day for r in days.filter(is_uk_holiday(F.col("day"))).collect()}
    assert flagged == {r.day for r in uk_holidays(spark, 1860, 2310).collect()}
    assert dt.date(2200, 12, 25) in flagged


def test_quantiles_and_outliers_work_out_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def touched(x):
        seen.add(1)
        return float(x)

    rows = spark.range(500).select(touched("id").alias("quantity"), F.lit(1.0).alias("price"))
    assert exact_quantiles(rows, {"quantity": (0.5,)}, fetch_rows=5, accuracy=10) == {"quantity": [249.5]}
    assert seen.value == 500
    cleaning.remove_outliers(rows)
    assert seen.value == 1000
