"""Which of the most frequent products share an invoice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Products held in one long, one bit each.
WORD = 62


def frequent_products(df: DataFrame, n: int) -> DataFrame:
    """The n products with the most lines, numbered from 0: `item`, `description`, `lines`."""
    top = (
        df.dropna(subset=["description"])
        .groupBy("description")
        .agg(F.count("*").alias("lines"))
        .orderBy(F.desc("lines"), "description")
        .limit(n)
    )
    # The window sees n rows.
    place = F.row_number().over(Window.orderBy(F.desc("lines"), "description"))
    return top.select((place - 1).alias("item"), "description", "lines")


def market_basket(df: DataFrame, n: int = 15) -> DataFrame:
    """For each pair of the n most frequent products, the invoices that contain both.

    Every pair has a row, zeros included, and a product with itself counts 0.
    An invoice becomes a set of bits, which combines before the shuffle however many
    lines it has. Invoices with the same set are counted together, and each set
    gives one row per product in it, never one per pair.
    """
    items = frequent_products(df, n)
    words = -(-n // WORD)
    lines = df.select("invoice", "description").dropna().join(F.broadcast(items), "description")

    def bit(word: int):
        here = (F.col("item") >= word * WORD) & (F.col("item") < (word + 1) * WORD)
        return F.when(here, F.expr(f"shiftleft(1L, item - {word * WORD})")).otherwise(F.lit(0))

    names = [f"word_{w}" for w in range(words)]
    sets = lines.groupBy("invoice").agg(*[F.bit_or(bit(w)).alias(names[w]) for w in range(words)])
    counted = sets.groupBy(*names).agg(F.count("*").alias("invoices"))

    def has(item: int):
        return F.getbit(F.col(names[item // WORD]), F.lit(item % WORD))

    members = F.array_compact(F.array(*[F.when(has(i) == 1, F.lit(i)) for i in range(n)]))
    matrix = (
        counted.withColumn("item_a", F.explode(members))
        .groupBy("item_a")
        .agg(*[F.sum(F.col("invoices") * has(i)).alias(str(i)) for i in range(n)])
    )
    pairs = matrix.unpivot("item_a", [str(i) for i in range(n)], "item_b", "invoices")
    names_a = items.select(F.col("item").alias("item_a"), F.col("description").alias("product_a"))
    names_b = items.select(
        F.col("item").cast("string").alias("item_b"), F.col("description").alias("product_b")
    )
    return (
        pairs.join(F.broadcast(names_a), "item_a")
        .join(F.broadcast(names_b), "item_b")
        .select(
            "product_a",
            "product_b",
            F.when(F.col("product_a") == F.col("product_b"), 0)
            .otherwise(F.col("invoices"))
            .cast("bigint")
            .alias("invoices"),
        )
    )


def basket_matrix(pairs: DataFrame, products: list[str]) -> DataFrame:
    """The pair table as a grid with one column per product."""
    return pairs.groupBy("product_a").pivot("product_b", products).agg(F.sum("invoices"))
