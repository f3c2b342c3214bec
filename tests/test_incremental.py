"""Summaries that carry sketches, and tables that grow by loads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import summaries
from tallymill.session import new_folder
from tallymill.sources.incremental import add_load, read_loads

T0 = dt.datetime(2011, 1, 1)


def sales(spark, n=6000, seed=1):
    r = random.Random(seed)
    rows = [(r.choice("AB"), r.choice(["X", None]), T0 + dt.timedelta(days=r.randrange(90)), float(r.randint(1, 9)), r.uniform(1, 100), str(r.randrange(3000)), str(r.randrange(4000))) for _ in range(n)]
    rows += [("A", "X", T0, None, None, None, None)]
    return spark.createDataFrame(rows, "stock_code string, country string, invoice_ts timestamp, quantity double, price double, customer_id string, invoice string")


def test_roll_up_of_any_days(spark):
    rows = sales(spark)
    summary = summaries.summarize(rows).cache()
    first, last = dt.date(2011, 1, 15), dt.date(2011, 3, 3)
    days = rows.filter(F.to_date("invoice_ts").between(first, last))
    for by in ((), ("stock_code",), ("country", "stock_code")):
        exact = days.groupBy(*by).agg(
            F.count("*").alias("lines"), F.sum("quantity").alias("units"), F.sum(F.col("quantity") * F.col("price")).alias("revenue"),
            F.countDistinct("customer_id").alias("customers"), F.countDistinct("invoice").alias("invoices"), F.sort_array(F.collect_list("price")).alias("prices"),
        )
        want = {tuple(r[c] for c in by): r for r in exact.collect()}
        found = {tuple(r[c] for c in by): r for r in summaries.roll_up(summary, by, first, last).collect()}
        assert found.keys() == want.keys()
        for key, r in found.items():
            w = want[key]
            assert r.lines == w.lines and r.units == pytest.approx(w.units) and r.revenue == pytest.approx(w.revenue)
            assert r.avg_line == pytest.approx(w.revenue / w.lines)
            assert r.customers == pytest.approx(w.customers, rel=0.06) and r.invoices == pytest.approx(w.invoices, rel=0.06)
            for q, value in zip(summaries.QUARTILES, (r.price_q1, r.price_q2, r.price_q3), strict=True):
                rank = sum(p <= value for p in w.prices) / len(w.prices)
                assert abs(rank - q) < 0.05
    summary.unpersist()


def test_a_coarser_summary_is_a_summary(spark):
    summary = summaries.summarize(sales(spark))
    months = summaries.coarser(summary, ["year_month", "country"])
    one, two = (summaries.roll_up(s, ["country"]).orderBy("country").collect() for s in (summary, months))
    assert [(r.country, r.lines, r.units) for r in one] == [(r.country, r.lines, r.units) for r in two]
    # Sketches merged in another order estimate a little differently.
    assert [r.customers for r in one] == pytest.approx([r.customers for r in two], rel=0.06)
    assert {r.lines for r in summaries.roll_up(summary.limit(0)).collect()} == {None}
    assert summaries.roll_up(summary.limit(0), ["country"]).count() == 0


def test_unknown_prices_have_no_quartiles(spark):
    row = summaries.roll_up(summaries.summarize(sales(spark, 0)), ["stock_code"]).first()
    assert (row.lines, row.units, row.customers, row.price_q2) == (1, 0.0, 0, None)


def rows_of(df):
    return sorted(map(repr, df.select("id", "year_month", "load").collect()))


def months(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, year_month string")


def test_loads_repeat_and_correct(spark):
    path = new_folder(spark, "loads-test")
    a = months(spark, (1, "2011-01"), (2, "2011-02"), (3, None))
    b = months(spark, (4, "2011-02"), (4, "2011-02"), (5, "2011-03"))
    assert add_load(a, path, "a") == [None, "2011-01", "2011-02"]
    assert add_load(b, path, "b") == ["2011-02", "2011-03"]
    whole = read_loads(spark, path, a.schema)
    once = rows_of(whole)
    assert len(once) == 6
    add_load(a, path, "a")
    add_load(b, path, "b")
    assert rows_of(read_loads(spark, path, a.schema)) == once
    # A correction takes back rows, also the last ones of a month.
    assert add_load(months(spark, (9, "2011-02")), path, "b") == ["2011-02", "2011-03"]
    found = read_loads(spark, path, a.schema)
    assert sorted((r.id, r.load) for r in found.collect()) == [(1, "a"), (2, "a"), (3, "a"), (9, "b")]
    add_load(months(spark).limit(0), path, "b")
    assert sorted(r.id for r in read_loads(spark, path, a.schema).collect()) == [1, 2, 3]
    assert add_load(months(spark).limit(0), new_folder(spark, "loads-test"), "x") == []


def test_a_late_load_rewrites_its_month_only(spark):
    path = new_folder(spark, "loads-test")
    add_load(months(spark, (1, "2011-01"), (2, "2011-02")), path, "a")
    files = {f.split("/")[-2]: f for f in spark.read.parquet(path).inputFiles()}
    add_load(months(spark, (3, "2011-01")), path, "late")
    after = {f.split("/")[-2]: f for f in spark.read.parquet(path).inputFiles()}
    assert after["year_month=2011-02"] == files["year_month=2011-02"] and after["year_month=2011-01"] != files["year_month=2011-01"]


def test_reads_are_pruned(spark):
    path = new_folder(spark, "loads-test")
    add_load(months(spark, (1, "2011-01"), (2, "2011-02"), (3, None)), path, "a")
    found = read_loads(spark, path, months(spark).schema, ["2011-02", None])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(year_month" in plan.replace("PartitionFilters: [((", "PartitionFilters: [(") and sorted(r.id for r in found.collect()) == [2, 3]
