"""Sales files with faults: the good rows, and beside them the bad ones with place and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallymill.functions.joins import if_small
from tallymill.schema import NUMERIC_COLUMNS, SALES_COLUMNS, parse_timestamp
from tallymill.session import stored
from tallymill.sources.readers import MISSING_TEXTS

CORRUPT = "_corrupt"
TEXTS = ("invoice", "stock_code", "customer_id")


@dataclass
class CheckedSales:
    """`good` has the columns of the sales, numbers and times parsed. `bad` has file, record (the
    record's number in its file, from 1), reasons (an array) and raw (the record's values as JSON)."""

    good: DataFrame
    bad: DataFrame


def _reasons(columns: list[str]) -> Column:
    faults = [(F.col(CORRUPT).isNotNull(), "wrong number of values")]
    for c in columns:
        if c in NUMERIC_COLUMNS:
            faults.append((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), f"{c} is not a number"))
        if c == "invoice_ts":
            faults.append((F.col(c).isNotNull() & parse_timestamp(c, lenient=True).isNull(), f"{c} is not a time"))
    return F.filter(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in faults]), lambda r: r.isNotNull())


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds `record`: rows of the file's earlier blocks, and of the own one up to this. A file is cut
    into blocks, each read in order by one task."""
    block = ["_file", "_block"]
    blocks = stored(rows.groupBy(*block).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows")), "file-blocks")
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.select(*block, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")), "block-starts")
    return rows.join(if_small(blocks), block).withColumn("record", F.col("_before") + F.col("_id") - F.col("_first") + 1)


def read_sales_checked(spark: SparkSession, path, multi_line: bool = False) -> CheckedSales:
    """Read CSV sales as `read_sales` does, but a record that can't be read costs only itself.

    A record is bad if it has too many or too few values, or a quantity, price or time that is
    none; a missing value is no fault. The files are read once: what is read is written down
    with its reasons, and both tables come from that.
    """
    csv = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').option("multiLine", multi_line)
    header = csv.csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in (*header, CORRUPT)])
    raw = csv.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    names = {c: SALES_COLUMNS.get(c, c) for c in header}
    known = [F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(names[c]) for c in header]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = raw.select(*known, CORRUPT, *place, F.monotonically_increasing_id().alias("_id"))
    rows = stored(rows.withColumn("reasons", _reasons(list(names.values()))), "checked-sales")

    kept = [c for c in names.values()]
    parsed = {c: F.col(c).cast("double") for c in NUMERIC_COLUMNS if c in kept}
    if "invoice_ts" in kept:
        parsed["invoice_ts"] = parse_timestamp("invoice_ts", lenient=True)
    good = rows.filter(F.size("reasons") == 0).select(kept).withColumns(parsed)
    values = F.coalesce(CORRUPT, F.to_json(F.struct(*kept)))
    bad = _numbered(rows).filter(F.size("reasons") > 0)
    return CheckedSales(good, bad.select(F.col("_file").alias("file"), "record", "reasons", values.alias("raw")))
