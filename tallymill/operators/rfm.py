"""Recency, frequency and monetary value per customer, quintile scores and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.joins import lookup
from tallymill.functions.quantiles import exact_quantiles
from tallymill.functions.ranking import with_position
from tallymill.schema import UNKNOWN, UNKNOWN_CUSTOMER, half_even
from tallymill.session import checkpointed

FIFTHS = (0.2, 0.4, 0.6, 0.8)

# Segment by recency score (one row each, 1 to 5) and frequency score.
SEGMENTS = (
    ("Sleeping", "Sleeping", "At Risk", "At Risk", "Can't Lose Them"),
    ("Sleeping", "Sleeping", "At Risk", "At Risk", "Can't Lose Them"),
    ("Fading", "Fading", "Need Attention", "Loyal Customers", "Loyal Customers"),
    ("Promising", "Potential Loyalists", "Potential Loyalists", "Loyal Customers", "Loyal Customers"),
    ("New Customers", "Potential Loyalists", "Potential Loyalists", "Champions", "Champions"),
)

# What to do for each segment.
ACTIONS = {
    "Sleeping": "Try to win them back with special offers or reminders.",
    "Loyal Customers": "Reward them with exclusive deals and loyalty points.",
    "Champions": "Treat them like VIPs! Offer early access and special gifts.",
    "At Risk": "Send personalized emails and discounts to bring them back.",
    "Potential Loyalists": "Encourage them to join a membership or loyalty program.",
    "Fading": "Send 'we miss you' emails with a special offer.",
    "Need Attention": "Ask for their feedback and suggest popular products.",
    "Can't Lose Them": "Offer a great deal to keep them from leaving.",
    "Promising": "Suggest other products they might like.",
    "New Customers": "Give them a great first experience and a welcome discount.",
}


def rfm(df: DataFrame, include_unknown: bool = True) -> DataFrame:
    """Per customer: whole days since the last purchase, invoices and revenue.

    Days count up to one day after the last sale of the table. Sales without a known
    customer form one customer unless `include_unknown` is off.
    """
    sales = df.dropna(subset=["customer_id"])
    last_sale = df.agg(F.max("invoice_ts")).scalar()
    if not include_unknown:
        sales = sales.filter(F.col("customer_id") != UNKNOWN)
    customers = sales.groupBy("customer_id").agg(
        F.max("invoice_ts").alias("last_purchase"),
        F.countDistinct("invoice").alias("frequency"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("monetary"),
    )
    # A difference of two times is an interval, whose day part counts whole days.
    since = F.extract(F.lit("DAY"), last_sale + F.expr("INTERVAL 1 DAY") - F.col("last_purchase"))
    return customers.select("customer_id", since.cast("bigint").alias("recency"), "frequency", "monetary")


def _above(column: str, edges: list[float]) -> Column:
    """How many edges the value exceeds; a value on an edge belongs below it."""
    return sum((F.col(column) > edge).cast("int") for edge in edges)


def score(customers: DataFrame) -> DataFrame:
    """Add r_score, f_score and m_score, 1 to 5.

    Recency and spend are cut at their quintiles. Frequency is cut by the rank of the
    customers ordered by frequency, then by id, so equal frequencies may be split.
    """
    ranked = with_position(customers, "frequency", "customer_id", name="rank")
    edges = exact_quantiles(ranked, {"recency": FIFTHS, "monetary": FIFTHS})
    if edges["recency"] is None:
        edges = {c: [0.0] * len(FIFTHS) for c in edges}
    before, last = F.col("rank") - 1, F.col("rank_count") - 1
    passed = sum((before * 5 > last * i).cast("int") for i in range(1, 5))
    return ranked.withColumns(
        {
            "r_score": F.lit(5) - _above("recency", edges["recency"]),
            "f_score": F.lit(1) + passed,
            "m_score": F.lit(1) + _above("monetary", edges["monetary"]),
        }
    ).drop("rank", "rank_count")


def add_segment(scored: DataFrame) -> DataFrame:
    cells = F.array(*[F.lit(name) for row in SEGMENTS for name in row])
    place = (F.col("r_score") - 1) * 5 + F.col("f_score")
    return scored.withColumn("segment", F.element_at(cells, place))


def add_action(segmented: DataFrame) -> DataFrame:
    pairs = F.create_map(*[F.lit(text) for pair in ACTIONS.items() for text in pair])
    return segmented.withColumn("action", F.try_element_at(pairs, F.col("segment")))


def segment_customers(customers: DataFrame) -> DataFrame:
    return customers.transform(score).transform(add_segment).transform(add_action)


def segment_actions(segmented: DataFrame) -> DataFrame:
    return segmented.select("segment", "action").distinct()


def attach_group(sales: DataFrame, customers: DataFrame, column: str = "segment") -> DataFrame:
    """Every sale with its customer's group; a customer without one is 'Unknown Customer'."""
    # Checkpointed, so that its size can be checked without computing the groups twice.
    groups = checkpointed(customers.select("customer_id", column))
    return lookup(sales, groups, "customer_id").fillna({column: UNKNOWN_CUSTOMER})


# Tables over any customer grouping; `group` is "segment" or "cluster_name".


def group_counts(customers: DataFrame, group: str = "segment") -> DataFrame:
    return customers.groupBy(group).agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), group)


def group_sales(customers: DataFrame, group: str = "segment") -> DataFrame:
    return (
        customers.groupBy(group).agg(F.sum("monetary").alias("monetary")).orderBy(F.desc("monetary"), group)
    )


def _share(column: str) -> Column:
    """Percent of the whole, null of a whole of 0. The window runs over one row per group, not per customer."""
    return F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy())) * 100


def group_shares(customers: DataFrame, group: str = "segment") -> DataFrame:
    totals = customers.groupBy(group).agg(
        F.count("recency").alias("customers"), F.sum("monetary").alias("revenue")
    )
    return totals.withColumns(
        {"customer_share": _share("customers"), "revenue_share": _share("revenue")}
    )


def group_summary(customers: DataFrame, group: str = "segment") -> DataFrame:
    """Counts, means and totals per group; shares are taken from the rounded totals."""
    totals = customers.groupBy(group).agg(
        F.count("recency").alias("customer_count"),
        half_even(F.avg("recency"), 2).alias("avg_recency"),
        half_even(F.avg("frequency"), 2).alias("avg_frequency"),
        half_even(F.sum("monetary"), 2).alias("total_revenue"),
        half_even(F.avg("monetary"), 2).alias("avg_revenue"),
    )
    return totals.withColumns(
        {
            "pct_of_customers": half_even(_share("customer_count"), 2),
            "pct_of_revenue": half_even(_share("total_revenue"), 2),
        }
    ).orderBy(F.desc("total_revenue"), group)


def group_kpis(customers: DataFrame, group: str = "segment") -> DataFrame:
    """The most valuable group with its shares, and the group with the least revenue."""
    # One row: the best and the worst of a few groups; of equal ones the first and the last name.
    shares = group_shares(customers, group)
    row = F.struct(F.col(group).alias("group"), "customer_share", "revenue", "revenue_share")
    ends = shares.agg(
        F.min_by(row, F.struct(-F.col("revenue"), group)).alias("most_valuable"),
        F.max_by(row, F.struct(-F.col("revenue"), group)).alias("least_revenue"),
    )
    kpis = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("row")) for k in ("most_valuable", "least_revenue")])
    return ends.select(F.inline(kpis)).filter(F.col("row").isNotNull()).select("kpi", "row.*")
