import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymill.operators import basket, cleaning, kpis, rollups
from tallymill.plans import sales as sales_plan

SCHEMA = (
    "invoice string, stock_code string, description string, quantity double, invoice_ts timestamp, "
    "price double, customer_id string, country string"
)


def sale(invoice, description, amount, when="2010-03-01 09:00", customer="c1", country="UK"):
    return (invoice, description, description, 1.0, dt.datetime.fromisoformat(when), amount, customer, country)


def sales(spark, rows):
    return cleaning.add_features(spark.createDataFrame(rows, SCHEMA))


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        sale("1", "lamp", 10.0, "2010-03-01 09:00"),
        sale("1", "vase", 5.0, "2010-03-01 09:00"),
        sale("2", "lamp", 10.0, "2010-04-02 10:00", "c2", "France"),
        sale("2", None, 4.0, "2010-05-02 23:59", "c2", None),
        sale("3", "Unknown", 1.0, "2010-04-04 10:30", "Unknown", "Spain"),
        sale("4", "cup", 5.0, "2010-03-07 09:15", "c1", "UK"),
    ]
    return sales(spark, rows).persist()


def test_null_keys_belong_to_no_group(small):
    assert sorted(pairs(rollups.country_revenue(small), "country", "revenue")) == [
        ("France", 10.0), ("Spain", 1.0), ("UK", 20.0),
    ]
    assert sorted(pairs(rollups.monthly_revenue(small), "year_month", "revenue")) == [
        ("2010-03", 20.0), ("2010-04", 11.0), ("2010-05", 4.0),
    ]


def test_weekdays_in_order_without_empty_days(small):
    assert pairs(rollups.weekday_revenue(small), "weekday", "revenue") == [
        ("Monday", 15.0), ("Friday", 10.0), ("Sunday", 10.0),
    ]


def test_hours(small):
    assert sorted(pairs(rollups.hourly_revenue(small), "hour", "revenue")) == [(9, 20.0), (10, 11.0), (23, 4.0)]


def test_top_and_bottom_with_ties(small):
    assert pairs(rollups.top_products(small, 2), "description") == [("cup",), ("lamp",)]
    assert pairs(rollups.bottom_products(small, 2), "description") == [("cup",), ("vase",)]
    assert pairs(rollups.bottom_countries(small, 2), "country") == [("France",), ("Spain",)]


def test_new_and_returning(small):
    got = dict(pairs(rollups.new_vs_returning(small), "customer_category", "revenue"))
    assert got == {"New Customers": 14.0, "Returning Customers": 20.0}
    unknown = small.filter("customer_id = 'Unknown'")
    assert rollups.new_vs_returning(unknown).count() == 0


def test_an_invoice_over_two_months_counts_in_both(small):
    got = dict(pairs(rollups.average_order_value(small), "year_month", "avg_order_value"))
    assert got == {"2010-03": 10.0, "2010-04": 5.5, "2010-05": 4.0}


def test_kpis_take_the_first_key_of_a_tie(spark, small):
    got = {r.kpi: (r.key, r.revenue) for r in kpis.sales_kpis(small).collect()}
    assert got == {
        "busiest_month": ("2010-03", 20.0),
        "busiest_weekday": ("Monday", 15.0),
        "busiest_hour": ("9:00 - 10:00", 20.0),
        "top_product": ("lamp", 20.0),
        "top_country": ("UK", 20.0),
    }
    tie = sales(spark, [sale("1", "b", 5.0, "2010-03-01 10:00"), sale("2", "a", 5.0, "2010-02-05 09:00")])
    got = {r.kpi: r.key for r in kpis.sales_kpis(tie).collect()}
    # Friday comes before Monday in the alphabet, and hour 9 before hour 10.
    assert got["busiest_weekday"] == "Friday" and got["busiest_hour"] == "9:00 - 10:00"
    assert got["busiest_month"] == "2010-02" and got["top_product"] == "a"


def test_kpis_of_every_product_equal_those_of_each(small):
    both = kpis.sales_kpis(small, by=["description"])
    for name in ("lamp", "cup"):
        alone = kpis.sales_kpis(rollups.product(small, name))
        assert sorted(map(tuple, both.filter(F.col("description") == name).drop("description").collect())) == sorted(
            map(tuple, alone.collect())
        )


def test_product_figures(small):
    figures = rollups.product_kpis(small, "lamp").collect()
    assert figures == [("lamp", 20.0, 2.0, 10.0, 2)]


def test_trends_place_weekdays(small):
    rows = kpis.product_trends(small).filter("description = 'lamp'").collect()
    got = {(r.trend, r.key): (r.weekday_place, r.revenue) for r in rows}
    assert got[("weekday", "Friday")] == (5, 10.0) and got[("month", "2010-03")] == (None, 10.0)


def test_totals_agree(small):
    known = small.dropna(subset=["country", "description"])
    totals = {
        f(known).agg(F.sum("revenue")).first()[0]
        for f in (rollups.monthly_revenue, rollups.weekday_revenue, rollups.hourly_revenue, rollups.country_revenue)
    }
    assert totals == {31.0}


@pytest.mark.parametrize("n", [1, 5, 70])
def test_basket_against_pandas(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame(
        {
            "invoice": rng.integers(0, 60, 900).astype(str),
            "description": [f"item {int(i)}" for i in rng.zipf(1.4, 900).clip(max=90)],
        }
    )
    # One invoice holds a third of all lines.
    frame.loc[frame.index % 3 == 0, "invoice"] = "hot"
    counts = frame.description.value_counts().reset_index()
    top = counts.sort_values(["count", "description"], ascending=[False, True]).description.head(n).tolist()
    flags = pd.crosstab(frame.invoice, frame.description)[top].gt(0).astype(int)
    matrix = flags.T.dot(flags)
    got = basket.market_basket(spark.createDataFrame(frame), n).collect()
    assert len(got) == len(top) ** 2
    for row in got:
        want = 0 if row.product_a == row.product_b else matrix.loc[row.product_a, row.product_b]
        assert row.invoices == want, row


def test_basket_as_a_grid(small):
    cells = basket.market_basket(small, 3)
    grid = basket.basket_matrix(cells, ["Unknown", "cup", "lamp"]).orderBy("product_a").collect()
    assert [tuple(r) for r in grid] == [("Unknown", 0, 0, 0), ("cup", 0, 0, 0), ("lamp", 0, 0, 0)]


def test_reports_have_every_table(small):
    report = sales_plan.sales_report(small)
    assert all(t.columns for t in report.values()) and len(report) == 11
    drill = sales_plan.product_report(small, "lamp")
    assert drill["figures"].first().revenue == 20.0
    assert drill["monthly"].count() == 2
