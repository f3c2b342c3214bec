"""Writers for summaries and for sales with their customer group attached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import without_leftovers

# Parts of a table that is written part by part.
BATCHES = 4


def write_table(
    df: DataFrame, path: str, fmt: str = "csv", partition_by=(), mode: str = "errorifexists", **options
) -> None:
    """Write `df` as CSV with a header, or in another Spark format.

    The executors write one file per partition; nothing passes through the driver.
    """
    writer = df.write.mode(mode).format(fmt).options(**options)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_in_batches(df: DataFrame, path: str, key: str, batches: int = BATCHES, **options) -> None:
    """`write_table` to a new place, in parts by the hash of `key`. Where `df` is a join on `key`
    with rows that are stored, each part shuffles its rows only, and its shuffle files go before
    the next one; the stored rows are read once for each part."""
    for k in range(batches):
        part = df.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        with without_leftovers(df.sparkSession):
            write_table(part, path, mode="append" if k else "errorifexists", **options)
