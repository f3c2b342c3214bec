"""Files with faults, visits by gaps and JSON as columns."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import shredding, visits
from tallymill.sources.checked import read_sales_checked

T0 = dt.datetime(2011, 1, 1)


@pytest.fixture
def many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_each_bad_record_has_its_number_and_reasons(spark, tmp_path):
    """Two files, one of them cut into many blocks."""
    lines = ["Invoice,StockCode,Quantity,InvoiceDate,Price,Customer ID,Country"]
    want = []
    for k in range(1, 3001):
        quantity, date, price, more = "2", "12/1/2010 8:26", "1.5", ""
        reasons = []
        if k % 701 == 0:
            quantity, reasons = "two", [*reasons, "quantity is not a number"]
        if k % 997 == 0 or k == 701:
            date, reasons = "someday", [*reasons, "invoice_ts is not a time"]
        if k % 1100 == 0:
            more, reasons = ",one too many", ["wrong number of values", *reasons]
        if k % 500 == 0:
            quantity = ""  # a missing value is no fault
        lines.append(f"{k},A,{quantity},{date},{price},17,UK{more}")
        if reasons:
            want.append(("long.csv", k, reasons))
    (tmp_path / "long.csv").write_text("\n".join(lines) + "\n", encoding="latin-1")
    (tmp_path / "short.csv").write_text(lines[0] + "\n1,B,1,2010-12-01,x,17,Caf\xe9\n2,B,1,2010-12-01,3,,NA\n", encoding="latin-1")
    want.append(("short.csv", 1, ["price is not a number"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        checked = read_sales_checked(spark, str(tmp_path))
        bad = sorted((r.file.split("/")[-1], r.record, r.reasons, r.raw) for r in checked.bad.collect())
        good = checked.good.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [b[:3] for b in bad] == sorted(want)
    assert "one too many" in next(b[3] for b in bad if b[1] == 1100) and json.loads(bad[-1][3])["country"] == "Café"
    assert len(good) == 3002 - len(want)
    assert {r.quantity for r in good} == {2.0, None, 1.0} and next(r for r in good if r.stock_code == "B").country is None
    assert checked.good.schema["price"].dataType.typeName() == "double" and checked.good.schema["invoice_ts"].dataType.typeName() == "timestamp"


def test_a_file_without_records(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("Invoice,StockCode,Quantity,InvoiceDate,Price,Customer ID,Country\n")
    checked = read_sales_checked(spark, str(tmp_path))
    assert checked.good.count() == 0 and checked.bad.count() == 0


def slow_visits(rows, gap):
    by_user: dict = {}
    for user, at, value in rows:
        if at is not None:
            by_user.setdefault(user, []).append((at, value))
    out = []
    for user, events in by_user.items():
        events.sort(key=lambda e: e[0])
        start = 0
        for k in range(1, len(events) + 1):
            if k == len(events) or events[k][0] - events[k - 1][0] > gap:
                values = [v for _, v in events[start:k] if v is not None]
                out.append((user, events[start][0], events[k - 1][0], k - start, sum(values) if values else None))
                start = k
    return sorted(map(repr, out))


@pytest.mark.usefixtures("many_partitions")
@pytest.mark.parametrize("busy", [5, 60])
def test_visits(spark, busy):
    """A busy user whose visits run over many partitions; with few minutes a single visit does."""
    r = random.Random(busy)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), T0 + dt.timedelta(minutes=r.randrange(busy * 200)), r.choice([None, 1, 2])) for _ in range(900)]
    rows += [("late", None, 1), ("once", T0, None)]
    events = spark.createDataFrame(rows, "user string, at timestamp, value int").repartition(6)
    found = visits.visits(events, ["user"], "at", "30 minutes", ["value"])
    assert found.columns == ["user", "visit_start", "visit_end", "events", "value"]
    assert sorted(map(repr, map(tuple, found.collect()))) == slow_visits(rows, dt.timedelta(minutes=30))
    assert visits.visits(events.limit(0), ["user"], "at").count() == 0


def test_shredding(spark):
    texts = ['{"k": 1, "deep": {"a": "x", "b": 2.5}, "none": null, "list": [1, 2]}', '{"k": 20000000000, "odd name": true}', '{"deep": {"b": 7}, "mixed": 1}',
             '{"mixed": "text"}', "no json", "[1, 2]", "5", None, "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, props string").repartition(3)
    found = shredding.shredded(rows, "props", prefix="p_")
    got = {r.id: r.asDict() for r in found.withColumn("p_mixed", F.col("p_mixed").cast("string")).collect()}
    assert set(got[0]) == {"id", "props", "p_k", "p_deep_a", "p_deep_b", "p_list", "p_mixed", "p_odd name"}
    assert got[0]["p_k"] == 1 and got[1]["p_k"] == 20000000000 and got[2]["p_k"] is None
    assert got[0]["p_deep_a"] == "x" and [float(got[k]["p_deep_b"]) for k in (0, 2)] == [2.5, 7.0]
    assert got[0]["p_list"] == [1, 2] and got[1]["p_odd name"] is True
    assert [got[k]["p_mixed"] for k in (2, 3)] == ["1", "text"]
    assert all(v is None for k in (4, 5, 6, 7, 8) for c, v in got[k].items() if c.startswith("p_"))
    assert shredding.shredded(rows.filter("id >= 4"), "props").columns == ["id", "props"]
