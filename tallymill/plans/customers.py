"""From cleaned sales to customer groups and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymill.operators import clusters as cl
from tallymill.operators import rfm as seg
from tallymill.session import checkpointed


def segment_report(cleaned: DataFrame) -> dict[str, DataFrame]:
    """Segments by quintile scores, and every table drawn from them.

    The scored customers are checkpointed while they are ranked, so the reports do not
    read the sales again; only `sales` does.
    """
    customers = seg.segment_customers(seg.rfm(cleaned))
    return {
        "customers": customers,
        "summary": seg.group_summary(customers),
        "counts": seg.group_counts(customers),
        "revenue": seg.group_sales(customers),
        "shares": seg.group_shares(customers),
        "kpis": seg.group_kpis(customers),
        "actions": seg.segment_actions(customers),
        "sales": seg.attach_group(cleaned, customers, "segment"),
    }


def cluster_report(cleaned: DataFrame, k: int = 4, starts: int = 10) -> dict[str, DataFrame]:
    """K-Means groups of customers, and every table drawn from them.

    The metrics and the named customers are checkpointed, for the same reason as above.
    """
    metrics = checkpointed(seg.rfm(cleaned))
    customers = checkpointed(cl.add_cluster_names(cl.cluster_customers(metrics, k, starts)))
    group = "cluster_name"
    return {
        "customers": customers,
        "summary": seg.group_summary(customers, group),
        "revenue": seg.group_sales(customers, group),
        "shares": seg.group_shares(customers, group),
        "means": cl.cluster_means(customers),
        "profile": cl.cluster_profile(customers),
        "sales": seg.attach_group(cleaned, customers, group),
    }
