"""Positions within groups of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def positioned(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """``rows`` with position (from 1, by ``order`` within ``by``) and total, the size of the group.

    Rows are cut into ranges of (by, order), so that a large group lies in many of them;
    what stands in earlier ranges is then added to the place within a range. Only one row a
    range and group is ever gathered.
    """
    # One range's ids follow each other in order; the table keeps them, as ranges are chosen by sampling.
    sorted_rows = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    placed = written(sorted_rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    parts = placed.groupBy(by, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), "_first", before.alias("_before"), F.sum("_n").over(group).alias("total"))
    joined = placed.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("position", (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_id", "_range", "_by", "_r", "_first", "_before")
