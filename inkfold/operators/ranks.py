"""Places in one order over all rows, without one task for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions, written


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the place (from 0) in the order: rows are dealt by ranges of it, numbered within a range, and moved on by the sizes of the
    ranges before, which are as many as there are partitions. The order must be total."""
    spark = rows.sparkSession
    parts = written(rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    start = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")
