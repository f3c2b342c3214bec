"""Tables that grow by loads: each load rewrites the partitions it touches and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.session import stored

PARTITION = "year_month"
LOAD = "load"


def _ledger(path: str) -> str:
    return path.rstrip("/") + "_loads"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _among(column: str, values: list) -> Column:
    """Literals, so that the scan reads only these partitions."""
    known = [v for v in values if v is not None]
    found = F.col(column).isin(*known) if known else F.lit(False)
    return found | F.col(column).isNull() if None in values else found


def _overwrite(df: DataFrame, path: str, partition: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _drop_partitions(spark: SparkSession, path: str, partition: str, values: list) -> None:
    """Delete partitions that no row is left of."""
    jvm = spark.sparkContext._jvm
    names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for value in values:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{names.getPartitionPathString(partition, value)}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def add_load(df: DataFrame, path: str, load: str, partition: str = PARTITION) -> list:
    """Put the rows of `df` into the Parquet table at `path`, partitioned by a text column, as the
    load of this name; rows that an earlier run of the same load has put there go. So loads can
    be repeated, corrected and come late: the result is that of all loads' last runs. Returns the
    partitions that were rewritten, those of the rows and those the load was in before.

    The loads' partitions are noted beside the table before it is touched, so a run that
    fails on the way is mended by running it again. One load at a time.
    """
    spark = df.sparkSession
    rows = stored(df.withColumn(LOAD, F.lit(load)), "load")
    # As many as there are partitions, not rows.
    touched = {r[0] for r in rows.select(partition).distinct().collect()}
    note = f"{LOAD} string, {partition} string"
    if _exists(spark, _ledger(path)):
        before = spark.read.schema(note).parquet(_ledger(path)).filter(F.col(LOAD) == load)
        touched |= {r[0] for r in before.select(partition).collect()}
    if not touched:
        return []
    order = sorted(touched, key=lambda v: (v is not None, v))
    _overwrite(spark.createDataFrame([(load, v) for v in order], note), _ledger(path), LOAD)
    if _exists(spark, path):
        held = spark.read.schema(rows.schema).parquet(path).filter(_among(partition, order))
        rows = stored(held.filter(F.col(LOAD) != load).unionByName(rows), "merged-load")
    _overwrite(rows, path, partition)
    left = {r[0] for r in rows.select(partition).distinct().collect()}
    _drop_partitions(spark, path, partition, [v for v in order if v not in left])
    return order


def read_loads(spark: SparkSession, path: str, schema, values: list | None = None, partition: str = PARTITION) -> DataFrame:
    """The table of `add_load`, or only the partitions `values`; `schema` is that of its rows."""
    from pyspark.sql.types import StringType, StructField, StructType

    names = [f for f in schema if f.name not in (partition, LOAD)]
    whole = StructType([*names, StructField(LOAD, StringType()), StructField(partition, StringType())])
    rows = spark.read.schema(whole).parquet(path)
    return rows if values is None else rows.filter(_among(partition, values))
