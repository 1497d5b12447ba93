"""Ranks over a whole table, without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.operators.shared import cut

#: Rows up to which one sort in one task is the quicker way.
ONE_TASK = 1_000_000
#: Bits that monotonically_increasing_id has for the row within a partition.
ROW_BITS = 33


def with_rank(rows: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in the order of keys, which should leave no ties.

    Larger tables are sorted by range over all tasks. The sorted rows are checkpointed, so that the numbers of rows in
    the ranges before and the places within one belong to the same cut; only these numbers, one for each range, meet.
    """
    if rows.count() <= ONE_TASK:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*keys)))
    ranged = cut(rows.orderBy(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", ROW_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << ROW_BITS) - 1) + 1
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, place.cast("int")).drop("_id", "_part", "_before")
