"""Running positions and running maxima over one global order, without a task that sees it all.

Rows are range-partitioned by the order, whatever its type, and written once with the number of their partition;
what each partition adds is one small row, and the sums or maxima of these are carried into the next
partitions. Rows that share a value are told apart by the columns that follow in the order, so that
one value's rows may fill many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

#: Rows of a range partition, about.
PART_ROWS = 1_000_000
PART = "__part"


def dealt(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df with the number of its range partition; the order of partitions is that of the rows. Written once, so that every use sees the same cuts."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    return storage.written(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def positions(df: DataFrame, by: list[str], order: str, ties: list[str] | None = None) -> DataFrame:
    """df with position (from 1, by order and ties) and size of each group. Keys and order may be of any type that can be ordered."""
    keys = [order, *(ties or [])]
    salt = "__salt"
    placed = dealt(df.withColumn(salt, F.monotonically_increasing_id()), [*keys, salt])
    counts = placed.groupBy(*by, PART).agg(F.count("*").alias("__n"))
    groups = by or [F.lit(0)]
    before = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "size": F.sum("__n").over(Window.partitionBy(*groups))}).drop("__n")
    names = {b: f"__by{i}" for i, b in enumerate([*by, PART])}
    met = placed.join(counts.withColumnsRenamed(names), [F.col(b).eqNullSafe(F.col(n)) for b, n in names.items()])
    inside = Window.partitionBy(*by, PART).orderBy(*keys, salt)
    return met.select(*df.columns, (F.col("__before") + F.row_number().over(inside)).alias("position"), "size")


def running_max(df: DataFrame, order: list[str | Column], value: str, name: str = "before") -> DataFrame:
    """df with the greatest value of all rows that come earlier; null where none does."""
    placed = dealt(df, list(order))
    tops = placed.groupBy(PART).agg(F.max(value).alias("__top"))
    # A row a partition.
    carried = tops.select(F.col(PART).alias("__p"), F.max("__top").over(Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(F.broadcast(carried), F.col(PART) == F.col("__p"))
    return met.withColumn(name, F.greatest("__carried", F.max(value).over(inside))).select(*df.columns, name)


def low(bound: Column) -> Column:
    """A lower bound that sorts; null is below everything."""
    return F.struct(F.when(bound.isNull(), 0).otherwise(1).alias("side"), bound.alias("at"))


def high(bound: Column) -> Column:
    """An upper bound that sorts; null is above everything."""
    return F.struct(F.when(bound.isNull(), 2).otherwise(1).alias("side"), bound.alias("at"))
