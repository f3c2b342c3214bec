"""Left joins that stay balanced when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import checkpointed

# A lookup table up to this size is sent to every executor.
BROADCAST_BYTES = 16_000_000
# A key above this share of the rows is split; at most 1 / share keys can be.
HOT_SHARE = 0.001
SALTS = 64


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows fit into `max_bytes`: 16 for each value, and the bytes of texts.
    Materialise `df` first, since this reads it."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    row = sum(texts, F.lit(16 * len(df.columns)))
    return (df.agg(F.sum(row)).first()[0] or 0) <= max_bytes


def if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark `df` for broadcast if it is small; materialise it first."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_share: float = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Left join with a table that has one row per `key`.

    A small table is broadcast. Otherwise rows of hot keys (and of a null key, which
    matches nothing) are spread over `salts` copies of their table row, so no task
    gets a whole hot key. Materialise `table` first, since its size is read.
    """
    if is_small(table, broadcast_bytes):
        return rows.join(F.broadcast(table), key, "left")
    # The total and the keys that may be hot, from one pass over the rows.
    per_key = checkpointed(rows.groupBy(key).count())
    total = per_key.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in per_key.filter(F.col("count") > hot_share * total).select(key).collect()]
    if not hot:
        return rows.join(table, key, "left")
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    known = [k for k in hot if k is not None]
    is_hot = F.col(key).isin(*known) if known else F.lit(False)
    left = rows.withColumn("_salt", F.when(F.col(key).isNull() | is_hot, spread).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], "left").drop("_salt")
