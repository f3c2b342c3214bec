"""Connected components of a graph given as links, for nodes that can be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import hot_join, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each end of `links` (a, b); root is the smallest node it reaches.

    Each node with smaller neighbours keeps a link to the smallest of them and hands its
    other links over to those neighbours, until every node has one link at most; then each
    node takes over its parent's parent until nothing changes. Every round is written to
    the shared folder.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    links = stored(links.filter(F.col("a") != F.col("b")).select(big.alias("node"), small.alias("to")).distinct(), "links")
    while True:
        first = links.groupBy("node").agg(F.min("to").alias("least"), F.count("*").alias("n"))
        first = stored(first, "first-links")
        if not first.filter("n > 1").head(1):
            break
        handed = hot_join(links, first.filter("n > 1"), "node", "n").filter(F.col("to") != F.col("least"))
        handed = handed.select(F.col("to").alias("node"), F.col("least").alias("to"))
        links = stored(first.select("node", F.col("least").alias("to")).unionByName(handed).distinct(), "links")
    up = first.select("node", F.col("least").alias("root"))
    while True:
        children = up.groupBy(F.col("root").alias("node")).agg(F.count("*").alias("n"))
        parents = up.withColumnRenamed("root", "above").join(children, "node")
        parents = stored(parents.select(F.col("node").alias("root"), "above", "n"), "parents")
        if not parents.head(1):
            break
        moved = hot_join(up, parents, "root", "n", "left")
        up = stored(moved.select("node", F.coalesce("above", "root").alias("root")), "roots")
    roots = up.select(F.col("root").alias("node"), "root").distinct()
    return up.unionByName(roots)


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` (node, root) after more links between nodes; a node without a row is its own root."""
    if not links.head(1):
        return roots
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    above = components(links.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    above = stored(above.withColumnRenamed("root", "top"), "tops")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).join(above.withColumnRenamed("node", "root"), "root")
    moved = hot_join(roots, stored(sizes, "moved-roots"), "root", "n", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = above.join(roots, "node", "left_anti").select("node", F.col("top").alias("root"))
    return stored(moved.unionByName(new), "roots")
