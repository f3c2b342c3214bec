"""K-Means customer groups, their names and their profiles."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.centers import Fit, best_fits
from tallymill.schema import half_even
from tallymill.session import checkpointed

METRICS = ("recency", "frequency", "monetary")
SCALED = tuple(f"{m}_scaled" for m in METRICS)
# Customers per partition while fitting, at least: short passes should not be many tasks.
PARTITION_ROWS = 4_000
# Partitions per core while fitting, at most: each task of the many passes reports to the driver.
PARTITIONS_PER_CORE = 2
# K-Means fits that are submitted side by side.
FITS_AT_ONCE = 5

# Names in the order in which clusters receive them.
BEST, LOWEST, LAPSED = "High-Value Champions", "Low-Spenders / New", "At-Risk / Lapsed"
POTENTIAL, STANDARD = "Potential Loyalists", "Standard Group"

# Parts of a cluster name -> who they are, how to engage them.
# The first match counts; the last row is for all other names.
PROFILES = (
    (
        ("Champions",),
        "These are your best customers: they buy often, spend the most, and have bought recently.",
        "Engage with VIP treatment, early access to new products, and loyalty rewards. "
        "Turn them into brand ambassadors.",
    ),
    (
        ("Low-Spenders",),
        "This group consists of new or infrequent customers with low spending.",
        "Help them grow! Send welcome offers, product recommendations, and deals to encourage "
        "a second purchase.",
    ),
    (
        ("At-Risk", "Lapsed"),
        "These customers used to be valuable but haven't purchased in a long time. "
        "They might not come back.",
        "Launch a special campaign to win them back. Offer a great discount or show them what's "
        "new to get their attention.",
    ),
    (
        ("Potential",),
        "This is a group of mid-tier customers who are starting to buy more often.",
        "Encourage higher spending and frequency through bundling, cross-selling, and multi-buy offers.",
    ),
    (
        (),
        "This is a group of your typical, everyday customers.",
        "Keep them engaged with regular newsletters and promotions on popular products.",
    ),
)


def scaled_columns(customers: DataFrame) -> DataFrame:
    """Add each metric with mean 0 and population deviation 1, as `<metric>_scaled`.

    A constant metric becomes 0. Mean and deviation are six numbers, read when this is called.
    """
    asks = [f(m).alias(f"{name}_{m}") for m in METRICS for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    seen = customers.agg(*asks).first()
    scaled = {}
    for m in METRICS:
        mean, deviation = seen[f"mean_{m}"] or 0.0, seen[f"std_{m}"] or 1.0
        scaled[f"{m}_scaled"] = (F.col(m) - F.lit(mean)) / F.lit(deviation)
    return customers.withColumns(scaled)


def _fits(customers: DataFrame, ks, starts: int, max_iter: int, seed: int) -> tuple[DataFrame, dict[int, Fit]]:
    """The scaled customers and the fits over them. The metrics stay in memory for the many
    short passes, dealt out evenly whatever files they come from; a table the caller persisted
    is left as it is."""
    own = customers.storageLevel == StorageLevel.NONE
    if own:
        customers.persist(StorageLevel.MEMORY_AND_DISK)
    points = None
    try:
        scaled = scaled_columns(customers)
        most = PARTITIONS_PER_CORE * customers.sparkSession.sparkContext.defaultParallelism
        parts = max(1, min(most, -(-customers.count() // PARTITION_ROWS)))
        points = scaled.select("customer_id", *SCALED).repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
        return scaled, best_fits(points, SCALED, "customer_id", ks, starts, max_iter, seed)
    finally:
        if points is not None:
            points.unpersist()
        if own:
            customers.unpersist()


def elbow(customers: DataFrame, max_k: int = 10, starts: int = 10, max_iter: int = 300, seed: int = 0) -> DataFrame:
    """Within-cluster sum of squares for k = 1 .. max_k: `k`, `wcss`."""
    _, best = _fits(customers, range(1, max_k + 1), starts, max_iter, seed)
    rows = [(k, fit.cost) for k, fit in best.items()]
    return customers.sparkSession.createDataFrame(rows, "k int, wcss double")


def cluster_customers(
    customers: DataFrame, k: int = 4, starts: int = 10, max_iter: int = 300, seed: int = 0
) -> DataFrame:
    """Add `cluster`, numbered from 0 in order of mean spend.

    The cheapest of `starts` K-Means fits, which run side by side over the same points. The
    customers are checkpointed, so that what they come from is read once.
    """
    customers = checkpointed(customers)
    if k == 1 or customers.isEmpty():
        return customers.withColumn("cluster", F.lit(0))
    scaled = scaled_columns(customers)
    points = scaled.select(array_to_vector(F.array(*SCALED)).alias("features"))
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        points.count()
        fits = [KMeans(k=k, maxIter=max_iter, seed=seed + s) for s in range(starts)]
        with ThreadPoolExecutor(min(starts, FITS_AT_ONCE)) as pool:
            models = list(pool.map(lambda fit: fit.fit(points), fits))
    finally:
        points.unpersist()
    best = min(range(starts), key=lambda s: (models[s].summary.trainingCost, s))
    # Spend is the last axis, so this order of the centres is the order of mean spend.
    centers = sorted((c.tolist() for c in models[best].clusterCenters()), key=lambda center: center[::-1])
    away = [
        F.struct(
            sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(SCALED, center)).alias("away"),
            F.lit(i).alias("cluster"),
        )
        for i, center in enumerate(centers)
    ]
    nearest = F.least(*away) if len(away) > 1 else away[0]
    return scaled.withColumn("cluster", nearest["cluster"]).drop(*SCALED)


def cluster_names(clustered: DataFrame) -> DataFrame:
    """`cluster`, `cluster_name`, by the means of each cluster.

    Highest spend, then lowest spend, then highest recency if it has no name yet; the
    others follow by frequency. Windows run over one row per cluster.
    """
    means = clustered.groupBy("cluster").agg(*[F.avg(m).alias(m) for m in METRICS])
    whole = Window.partitionBy()
    ranked = means.withColumns(
        {
            "spend_place": F.row_number().over(Window.orderBy(F.desc("monetary"), F.desc("cluster"))),
            "recency_place": F.row_number().over(Window.orderBy(F.desc("recency"), "cluster")),
            "clusters": F.count("*").over(whole),
        }
    )
    first_names = (
        F.when(F.col("spend_place") == 1, BEST)
        .when(F.col("spend_place") == F.col("clusters"), LOWEST)
        .when(F.col("recency_place") == 1, LAPSED)
    )
    named = ranked.withColumn("cluster_name", first_names)
    rest = Window.partitionBy(F.col("cluster_name").isNull()).orderBy(F.desc("frequency"), "cluster")
    named = named.withColumn("_place", F.row_number().over(rest))
    other = F.when(F.col("_place") == 1, POTENTIAL).otherwise(
        F.concat(F.lit(f"{STANDARD} "), (F.col("_place") - 1).cast("string"))
    )
    return named.select("cluster", F.coalesce("cluster_name", other).alias("cluster_name"))


def add_cluster_names(clustered: DataFrame) -> DataFrame:
    # One row per cluster, so its size does not grow with the customers.
    return clustered.join(F.broadcast(cluster_names(clustered)), "cluster")


def cluster_means(named: DataFrame) -> DataFrame:
    return named.groupBy("cluster_name").agg(*[F.avg(m).alias(f"avg_{m}") for m in METRICS])


def cluster_profile(named: DataFrame) -> DataFrame:
    """Rounded means and size per cluster, who they are and how to engage them."""
    profile = named.groupBy("cluster", "cluster_name").agg(
        *[half_even(F.avg(m), 2).alias(f"avg_{m}") for m in METRICS],
        F.count("*").alias("customer_count"),
    )

    def text(place: int):
        column = F.lit(PROFILES[-1][place])
        for row in reversed(PROFILES[:-1]):
            matches = [F.col("cluster_name").contains(part) for part in row[0]]
            column = F.when(reduce(or_, matches), row[place]).otherwise(column)
        return column

    return profile.withColumns({"interpretation": text(1), "strategy": text(2)})
