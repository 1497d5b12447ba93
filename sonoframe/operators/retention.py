"""What is kept under a byte budget, lookups of the latest value, and set operations on libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.operators.ranking import ROW_BITS
from sonoframe.operators.shared import cut


def newest_within(rows: DataFrame, age: str, size: str, budget: int, partition: str | None = None) -> DataFrame:
    """The newest rows whose sizes fit the budget together; the newest is kept even if it alone does not.

    A running sum from the newest on. Without a partition this is one sequence by its nature; it is summed in two steps
    so that no task holds it all: sizes by range of age first, then within each range.
    """
    if partition is not None:
        w = Window.partitionBy(partition).orderBy(F.desc(age)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_sum", F.sum(size).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(age)))).where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")
    total = running_total(rows, age, size)
    return total.where((F.col("_sum") <= budget) | (F.col("_sum") == F.col(size))).drop("_sum")


def running_total(rows: DataFrame, age: str, size: str) -> DataFrame:
    """_sum: the sizes of a row and all newer ones; of equal ages in no fixed order.

    Rows are sorted by range, so that a burst of ages is spread as well; only the ranges' sums, one for each, meet.
    """
    ranged = cut(rows.orderBy(F.desc(age)).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", ROW_BITS))
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("_s"))
    newer = sums.select("_range", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_newer"))
    within = F.sum(size).over(Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(newer), "_range").withColumn("_sum", within + F.col("_newer")).drop("_range", "_newer", "_id")


def families_within(rows: DataFrame, parent: str, inserted: str, size: str, budget: int) -> DataFrame:
    """Whole families (rows of a parent), the oldest of which go first until the rest fits the budget."""
    families = rows.groupBy(parent).agg(F.min(inserted).alias("_first"), F.sum(size).alias("_size"))
    kept = running_total(families, "_first", "_size").where(F.col("_sum") <= budget).select(parent)
    return rows.join(kept, parent, "left_semi")


def latest(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def unknown(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return rows.join(known.select(on).distinct(), on, "left_anti")


def merged(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Both libraries; of second only what first has no name for."""
    return first.unionByName(unknown(second, first, on))


def round_robin(rows: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """Which of n alternatives each event of a key takes in turn, from 0."""
    return rows.withColumn("turn_of", F.pmod(F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, F.lit(n)))


def without_step(variants: DataFrame, step: str) -> DataFrame:
    """Variants whose steps (an array of names) don't have step."""
    return variants.where(~F.exists("steps", lambda s: s == step))


def usage(rows: DataFrame, size: str, limit: int) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), ((1 - F.sum(size) / F.lit(limit)) * 100).alias("free"))


def first_available(*columns: str) -> Column:
    """Variant, earlier variant, base or raw sound: the first that there is."""
    return F.coalesce(*columns)
