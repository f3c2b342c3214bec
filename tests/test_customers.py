import subprocess
import sys
from pathlib import Path

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymill.functions import centers
from tallymill.operators import clusters, rfm
from tallymill.plans import customers as plan

T0 = dt.datetime(2010, 6, 1, 12, 0)


def customers(spark, frame):
    rows = [
        (str(i), int(r), int(f), float(m))
        for i, r, f, m in frame[["customer_id", "recency", "frequency", "monetary"]].itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "customer_id string, recency bigint, frequency bigint, monetary double")


def random_customers(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "customer_id": [f"c{i:05d}" for i in range(n)],
            "recency": rng.permutation(n * 3)[:n] + 1,
            "frequency": rng.geometric(0.5, n),
            "monetary": rng.gamma(2, 100, n),
        }
    )


def test_fits_deal_customers_of_one_file_out(spark, monkeypatch):
    found = []
    monkeypatch.setattr(clusters, "best_fits", lambda points, *rest: found.append(points.rdd.getNumPartitions()) or {})
    monkeypatch.setattr(clusters, "PARTITION_ROWS", 10)
    key = F.col("id")
    for rows, want in ((35, 4), (100_000, clusters.PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)):
        table = spark.range(rows).coalesce(1).select(key.cast("string").alias("customer_id"), *[key.alias(m) for m in clusters.METRICS])
        clusters._fits(table, [2], 1, 1, 0)
        assert found.pop() == want
    x = np.random.default_rng(5).normal(size=(300, 3))
    middles = np.vstack([x[:4], x[:1]])
    points = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    # The last centre equals the first, which gets their points.
    counts, sums, cost = centers._pass(points, ["a", "b", "c"], [centers.Fit(5, 0, middles)])[0]
    away = ((x[:, None] - middles[None]) ** 2).sum(axis=2)
    near = away.argmin(axis=1)
    assert counts.tolist() == np.bincount(near, minlength=5).tolist()
    np.testing.assert_allclose(sums, [x[near == i].sum(axis=0) for i in range(5)], atol=1e-9)
    assert cost == pytest.approx(away.min(axis=1).sum())


@pytest.mark.parametrize("n", [5, 6, 7, 10, 333])
def test_scores_equal_quantile_cuts(spark, n):
    frame = random_customers(n, n)
    want = frame.set_index("customer_id")
    want["r"] = pd.qcut(want.recency, 5, labels=[5, 4, 3, 2, 1]).astype(int)
    want["f"] = pd.qcut(want.frequency.rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    want["m"] = pd.qcut(want.monetary, 5, labels=[1, 2, 3, 4, 5]).astype(int)
    got = rfm.score(customers(spark, frame.sample(frac=1, random_state=1))).toPandas().set_index("customer_id")
    joined = want.join(got, rsuffix="_got")
    for short in "rfm":
        assert (joined[short] == joined[f"{short}_score"]).all(), short


def test_scores_with_repeated_edges_and_one_customer(spark):
    frame = random_customers(20, 1).assign(recency=7, monetary=1.0)
    got = rfm.score(customers(spark, frame)).select("r_score", "m_score").distinct().collect()
    assert got == [(5, 1)]
    assert rfm.score(customers(spark, frame.head(1))).first().f_score == 1
    assert rfm.score(customers(spark, frame.head(0))).count() == 0


def test_segments_cover_all_pairs(spark):
    grid = spark.createDataFrame([(r, f) for r in range(1, 6) for f in range(1, 6)], "r_score int, f_score int")
    got = {(x.r_score, x.f_score): x.segment for x in rfm.add_action(rfm.add_segment(grid)).collect()}
    assert got[(1, 5)] == "Can't Lose Them" and got[(2, 3)] == "At Risk" and got[(3, 3)] == "Need Attention"
    assert got[(4, 1)] == "Promising" and got[(5, 1)] == "New Customers" and got[(4, 4)] == "Loyal Customers"
    assert got[(5, 5)] == "Champions" and got[(4, 3)] == got[(5, 2)] == "Potential Loyalists"
    assert len(set(got.values())) == 10 and set(got.values()) == set(rfm.ACTIONS)


def test_whole_days_since_the_last_purchase(spark):
    rows = [
        ("a", "1", T0, 1.0),
        ("b", "2", T0 - dt.timedelta(hours=23, minutes=59), 2.0),
        ("c", "3", T0 - dt.timedelta(days=1), 3.0),
        ("Unknown", "4", T0 - dt.timedelta(days=9), 4.0),
        ("Unknown", "5", T0 - dt.timedelta(days=3), 4.0),
        (None, "6", T0 - dt.timedelta(days=3), 4.0),
    ]
    df = spark.createDataFrame(rows, "customer_id string, invoice string, invoice_ts timestamp, revenue double")
    got = {r.customer_id: (r.recency, r.frequency, r.monetary) for r in rfm.rfm(df).collect()}
    assert got == {"a": (1, 1, 1.0), "b": (1, 1, 2.0), "c": (2, 1, 3.0), "Unknown": (4, 2, 8.0)}
    assert rfm.rfm(df, include_unknown=False).count() == 3


def test_group_attached_to_every_sale(spark):
    sales = spark.createDataFrame([("a", 1), ("a", 2), ("zz", 3), (None, 4)], "customer_id string, line int")
    groups = spark.createDataFrame([("a", "Champions"), ("b", "Fading")], "customer_id string, segment string")
    got = sorted((r.line, r.customer_id, r.segment) for r in rfm.attach_group(sales, groups).collect())
    assert got == [
        (1, "a", "Champions"), (2, "a", "Champions"), (3, "zz", "Unknown Customer"), (4, None, "Unknown Customer"),
    ]


def test_summary_rounds_halves_to_even_and_shares_use_rounded_totals(spark):
    frame = pd.DataFrame(
        {
            "customer_id": list("abcd"),
            "recency": [1, 2, 10, 20],
            "frequency": [1, 1, 2, 3],
            "monetary": [0.125, 0.0, 10.0, 20.004],
            "segment": ["x", "x", "y", "y"],
        }
    )
    df = customers(spark, frame).withColumn("segment", F.when(F.col("customer_id") < "c", "x").otherwise("y"))
    want = frame.groupby("segment").agg(
        customer_count=("recency", "count"),
        avg_recency=("recency", "mean"),
        avg_frequency=("frequency", "mean"),
        total_revenue=("monetary", "sum"),
        avg_revenue=("monetary", "mean"),
    ).round(2)
    want["pct_of_customers"] = (want.customer_count / want.customer_count.sum() * 100).round(2)
    want["pct_of_revenue"] = (want.total_revenue / want.total_revenue.sum() * 100).round(2)
    want = want.sort_values("total_revenue", ascending=False).reset_index()
    got = rfm.group_summary(df).toPandas()
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    kpi = {r.kpi: r.group for r in rfm.group_kpis(df).collect()}
    assert kpi == {"most_valuable": "y", "least_revenue": "x"}


def named(spark, means):
    """One customer per cluster, with the given recency, frequency and spend."""
    rows = [(str(c), c, r, f, float(m)) for c, (r, f, m) in enumerate(means)]
    df = spark.createDataFrame(rows, "customer_id string, cluster int, recency int, frequency int, monetary double")
    return {r.cluster: r.cluster_name for r in clusters.cluster_names(df).collect()}


def test_cluster_names(spark):
    best, low, lapsed = clusters.BEST, clusters.LOWEST, clusters.LAPSED
    assert named(spark, [(5, 1, 10)]) == {0: best}
    assert named(spark, [(5, 1, 10), (9, 1, 20)]) == {0: low, 1: best}
    assert named(spark, [(5, 1, 10), (9, 1, 20), (7, 1, 15)]) == {0: low, 1: best, 2: "Potential Loyalists"}
    assert named(spark, [(5, 1, 10), (9, 1, 15), (7, 1, 20)]) == {0: low, 1: lapsed, 2: best}
    ten = [(i, 20 - i if i else 1, 10 * i + 10) for i in range(10)]
    ten[4] = (99, 1, 50)
    got = named(spark, ten)
    assert got[9] == best and got[0] == low and got[4] == lapsed and got[1] == "Potential Loyalists"
    assert [got[i] for i in (2, 3, 5, 6, 7, 8)] == [f"Standard Group {i}" for i in range(1, 7)]


def planted(spark, n=240):
    rng = np.random.default_rng(5)
    centers = np.array([[300, 2, 50], [10, 30, 9000], [20, 4, 300]])
    which = np.arange(n) % 3
    points = centers[which] + rng.normal(0, 1, (n, 3)) * [3, 0.3, 10]
    frame = pd.DataFrame(points.round().clip(min=1), columns=list(clusters.METRICS))
    return customers(spark, frame.assign(customer_id=[f"c{i:03d}" for i in range(n)])), which


def test_planted_clusters(spark):
    df, which = planted(spark)
    first = {r.customer_id: r.cluster for r in clusters.cluster_customers(df, 3, starts=2).collect()}
    again = {r.customer_id: r.cluster for r in clusters.cluster_customers(df.repartition(3), 3, starts=2).collect()}
    # Numbered by spend: 50, 300, 9000.
    expected = {f"c{i:03d}": {0: 0, 1: 2, 2: 1}[w] for i, w in enumerate(which)}
    assert first == expected == again


def test_elbow_falls_and_bends_at_the_planted_number(spark):
    df, _ = planted(spark)
    curve = {r.k: r.wcss for r in clusters.elbow(df, max_k=4, starts=2).collect()}
    scaled = df.toPandas()[list(clusters.METRICS)]
    # With population scaling the cost of one cluster is rows times columns.
    assert curve[1] == pytest.approx(scaled.size, rel=1e-9)
    assert curve[1] > curve[2] > curve[3] and curve[3] < 0.05 * curve[2]


def test_reports(spark):
    rng = np.random.default_rng(2)
    rows = [
        (f"c{int(rng.integers(0, 40)):02d}", str(i), "A", T0 - dt.timedelta(days=int(rng.integers(0, 300))), float(i % 17 + 1))
        for i in range(300)
    ]
    sales = spark.createDataFrame(
        rows, "customer_id string, invoice string, stock_code string, invoice_ts timestamp, revenue double"
    )
    report = plan.segment_report(sales)
    assert report["sales"].count() == 300
    shares = report["shares"].agg(F.sum("customer_share"), F.sum("revenue_share")).first()
    assert shares[0] == pytest.approx(100) and shares[1] == pytest.approx(100)
    assert report["counts"].agg(F.sum("customers")).first()[0] == report["customers"].count()
    assert report["actions"].count() == report["summary"].count()
    smart = plan.cluster_report(sales, k=3, starts=1)
    assert smart["sales"].filter("cluster_name IS NULL").count() == 0
    profile = {r.cluster_name: r.interpretation for r in smart["profile"].collect()}
    assert profile[clusters.BEST].startswith("These are your best customers")
    assert smart["summary"].agg(F.sum("customer_count")).first()[0] == 40


def test_fits_equal_a_plain_lloyd_loop(spark):
    """From the same first centres, the shared passes move them as a loop in memory does."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 2))
    points = spark.createDataFrame([(str(i), *map(float, p)) for i, p in enumerate(x)], "id string, a double, b double")
    points = points.repartition(4).persist()
    seeds = centers._first_centers(points, ("a", "b"), "id", 5, 3, 1)
    # Every first centre is a point, and no start draws one twice.
    for start in seeds:
        assert len({tuple(c) for c in start}) == 5 and all((x == c).all(axis=1).any() for c in start)
    got = centers.best_fits(points, ("a", "b"), "id", [2, 5], 3, 300, 1)
    for k in (2, 5):
        costs = []
        for start in seeds:
            c = start[:k]
            while True:
                near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
                moved = np.array([x[near == j].mean(0) for j in range(k)])
                shift, c = ((moved - c) ** 2).sum(), moved
                if shift <= centers.TOLERANCE:
                    break
            costs.append(((x[:, None] - c) ** 2).sum(2).min(1).sum())
        assert got[k].cost == pytest.approx(min(costs), rel=1e-9) and got[k].start == int(np.argmin(costs))


def test_far_points_are_drawn_first(spark):
    """Two tight groups: the second centre comes from the other group, whatever the start."""
    rows = [(str(i), float(i % 2) * 100 + i * 1e-6) for i in range(200)]
    points = spark.createDataFrame(rows, "id string, a double")
    for start in centers._first_centers(points, ("a",), "id", 2, 6, 0):
        assert sorted(round(float(c[0])) for c in start) == [0, 100]


def test_fewer_points_than_clusters(spark):
    df, _ = planted(spark, 3)
    assert clusters.cluster_customers(df, 4, starts=2).select("cluster").distinct().count() == 3
    assert clusters.elbow(df.limit(0)).count() == 0


def test_groups_without_revenue(spark):
    rows = [("a", 1, 1, 0.0, "x"), ("b", 2, 1, 0.0, "y")]
    customers = spark.createDataFrame(rows, "customer_id string, recency long, frequency long, monetary double, segment string")
    assert {r.revenue_share for r in rfm.group_shares(customers).collect()} == {None}
    assert {r.pct_of_revenue for r in rfm.group_summary(customers).collect()} == {None}
    kpis = {r.kpi: (r.group, r.customer_share) for r in rfm.group_kpis(customers).collect()}
    assert kpis == {"most_valuable": ("x", 50.0), "least_revenue": ("y", 50.0)}
    assert rfm.group_kpis(customers.limit(0)).count() == 0


def test_clusters_of_no_customers(spark):
    none = spark.createDataFrame([], "customer_id string, recency long, frequency long, monetary double")
    found = clusters.cluster_customers(none)
    assert found.columns[-1] == "cluster" and found.count() == 0
    assert clusters.elbow(none).count() == 0


def test_workers_need_not_have_the_package(tmp_path):
    """The passes over the customers run in a session that was started elsewhere."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["elbow_planted"](spark, "/root/testdata/sf0.001").count() == 10
assert e.queries()["kmeans"](spark, "/root/testdata/sf0.001").count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, capture_output=True)
