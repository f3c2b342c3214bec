"""Joins on time against plain loops, with nulls, ties, hot keys and long periods."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import series, temporal

T0 = dt.datetime(2011, 1, 1)


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in as many partitions as large ones."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def multiset(rows):
    return sorted(map(repr, rows))


def latest(rows, key, at, strict):
    """The largest value of the latest moment of the key."""
    found = [(m, v) for k, m, v in rows if k is not None and m is not None and k == key and at is not None and (m < at or (m == at and not strict))]
    return max(found, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[1] if found else None


def moments(seed, n, hot=0.6):
    r = random.Random(seed)
    rows = [("hot" if r.random() < hot else r.choice(["a", "b", "c", None]), T0 + dt.timedelta(minutes=r.randrange(400)), r.randrange(50)) for _ in range(n)]
    return rows + [(None, None, 1), ("a", None, 2), ("hot", T0, None)] * 2


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, strict):
    left, right = moments(1, 600), moments(2, 90)
    one = spark.createDataFrame(left, "k string, at timestamp, n int").withColumn("_extra", F.lit("x")).repartition(5)
    two = spark.createDataFrame(right, "k string, at timestamp, v int").repartition(3)
    found = temporal.asof_join(one, two, ["k"], "at", ["v"], strict)
    assert found.columns == ["k", "at", "n", "_extra", "v"]
    assert multiset((r.k, r.at, r.n, r.v) for r in found.collect()) == multiset((k, at, n, latest(right, k, at, strict)) for k, at, n in left)


def test_a_hot_key_lies_in_many_partitions(spark):
    """One key, and a single value that has to be carried through all partitions."""
    one = spark.range(4000).select(F.lit("k").alias("k"), (F.lit(T0) + F.make_interval(secs=F.col("id"))).alias("at"), "id")
    two = spark.createDataFrame([("k", T0, 7.0)], "k string, at timestamp, v double")
    found = temporal.asof_join(one, two, ["k"], "at", ["v"])
    assert found.filter("v = 7").count() == 4000
    both = one.select("k", "at").repartitionByRange("k", "at").withColumn("part", F.spark_partition_id())
    assert both.select("part").distinct().count() > 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_join_of_nothing(spark):
    one = spark.createDataFrame(moments(3, 20), "k string, at timestamp, n int")
    two = spark.createDataFrame(moments(4, 20), "k string, at timestamp, v int")
    assert temporal.asof_join(one.limit(0), two, ["k"], "at", ["v"]).count() == 0
    assert temporal.asof_join(one, two.limit(0), ["k"], "at", ["v"]).filter("v is null").count() == one.count()


def test_prices_hold_until_changed(spark):
    days = [("A", dt.date(2011, 1, d), 1.0) for d in range(1, 8)] + [("B", dt.date(2011, 1, 3), 1.0)]
    rows = spark.createDataFrame(days, "stock_code string, day date, quantity double")
    changes = spark.createDataFrame([("A", dt.date(2011, 1, 3), 5.0), ("A", dt.date(2011, 1, 6), 6.0)], "stock_code string, day date, competitor_a double")
    found = series.join_price_changes(rows, changes).filter("stock_code = 'A'").orderBy("day").collect()
    assert [r.competitor_a for r in found] == [None, None, 5.0, 5.0, 5.0, 6.0, 6.0]
    assert series.join_price_changes(rows, changes).filter("stock_code = 'B'").first().competitor_a is None


def periods(seed, n):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        start = r.randrange(-100, 900)
        rows.append((r.choice(["hot", "hot", "a", None]), start, start + r.choice([-1, 0, 0, 1, 2, 5, 7, 8, 30, 1000, 5000]), k))
    return rows + [("hot", 3, None, -1), ("hot", None, 3, -2), ("hot", 10, 20, -3), ("hot", 10, 20, -3)]


@pytest.mark.parametrize("large", [False, True])
def test_between_join(spark, monkeypatch, large):
    """Also as a shuffled join in which the crowded buckets are copied."""
    if large:
        monkeypatch.setattr(temporal, "is_small", lambda df: False)
        monkeypatch.setattr(temporal, "MOMENTS_PER_COPY", 40)
    r = random.Random(8)
    spots = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, *range(0, 1000)]), k) for k in range(700)] + [("hot", 12, 1)] * 2
    held = periods(5, 120)
    one = spark.createDataFrame(spots, "k string, t long, n int").repartition(4)
    two = spark.createDataFrame(held, "k string, first long, last long, p int").repartition(3)
    found = temporal.between_join(one, two, "t", "first", "last", ["k"])
    want = [(k, t, n, a, b, p) for k, t, n in spots for q, a, b, p in held if k is not None and k == q and None not in (t, a, b) and a <= t <= b]
    assert multiset(tuple(x) for x in found.collect()) == multiset(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_between_join_without_keys_and_with_dates(spark):
    days = spark.sql("SELECT explode(sequence(date'2011-01-01', date'2011-12-31')) AS day")
    held = spark.sql("SELECT date'2011-02-01' AS a, date'2011-02-28' AS b, 1 AS p UNION ALL SELECT date'2000-01-01', date'2030-01-01', 2")
    found = {r.p: r["count"] for r in temporal.between_join(days, held, "day", "a", "b").groupBy("p").count().collect()}
    assert found == {1: 28, 2: 365}
    assert temporal.between_join(days, held.limit(0), "day", "a", "b").count() == 0
    assert temporal.between_join(days.limit(0), held, "day", "a", "b").count() == 0


def test_a_long_period_takes_two_buckets(spark):
    held = spark.createDataFrame([(0, 10**12, 1), (5, 5, 2), (7, 8, 3)], "a long, b long, p int")
    widths = {r.p: r.n for r in temporal.overlap_join(held, held.withColumnsRenamed({"a": "c", "b": "d", "p": "q"}), [("a", "b"), ("c", "d")]).groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert widths == {1: 3, 2: 2, 3: 2}


def test_overlap_join(spark):
    a, b = periods(6, 70), periods(7, 60)
    one = spark.createDataFrame(a, "k string, a long, b long, p int")
    two = spark.createDataFrame(b, "k string, c long, d long, q int")
    found = temporal.overlap_join(one, two, [("a", "b"), ("c", "d")], ["k"])
    good = [[x for x in rows if x[0] is not None and None not in x and x[1] <= x[2]] for rows in (a, b)]
    want = [(*x, *y[1:]) for x in good[0] for y in good[1] if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert multiset(tuple(x) for x in found.collect()) == multiset(want)


def test_overlap_join_reads_its_tables_once(spark):
    """They may be joins of large tables themselves."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("k", n, n + n % 5) for n in range(100)]
    one = spark.createDataFrame(rows, "k string, a long, b long").mapInArrow(counted, "k string, a long, b long")
    two = spark.createDataFrame(rows, "k string, c long, d long").mapInArrow(counted, "k string, c long, d long")
    found = temporal.overlap_join(one, two, [("a", "b"), ("c", "d")], ["k"]).count()
    assert found == sum(x[1] <= y[2] and y[1] <= x[2] for x in rows for y in rows)
    assert read.value == 200


def test_large_buckets_are_not_sent_to_the_driver(spark, monkeypatch):
    """Once there are no crowded buckets, Spark plans the join anew, by the size of files."""
    monkeypatch.setattr(temporal, "is_small", lambda df: False)
    spots = spark.range(2000).selectExpr("'k' AS k", "id AS t")
    held = spark.range(2000).selectExpr("'k' AS k", "id AS first", "id + id % 50 AS last")
    found = temporal.between_join(spots, held, "t", "first", "last", ["k"])
    assert len(found.collect()) == sum(min(n + n % 50, 1999) - n + 1 for n in range(2000))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
