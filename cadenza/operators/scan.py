"""Numbers and running values over groups that lie in many tasks.

A window puts a group into one task.  Here rows are dealt by ranges of (keys, order); each range is gone
through by itself, and what a group's earlier ranges give is carried into its later ones.  Of the groups of a
range only the first can have begun in an earlier one, so that there is at most one carried row a range: these
are broadcast.  Empty tables give empty results; null keys are a group, and nulls come first in an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import cut, table


def dealt(rows: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """Rows by ranges of (keys, order), written down, with the number of their range as _block."""
    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn("_block", F.spark_partition_id()))


def carried(values: DataFrame, keys: list[str], value: str, fold: Callable[[str], Column], name: str) -> DataFrame:
    """Of values (keys, _block, value), what fold makes of a group's earlier ranges; only groups that have such."""
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return values.select(*keys, "_block", fold(value).over(earlier).alias(name)).where(F.col(name).isNotNull())


def with_carried(rows: DataFrame, carry: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with the carried value of their group and range, null where there is none."""
    on = [*keys, "_block"]
    small = F.broadcast(carry.select(*(F.col(k).alias(f"_of_{k}") for k in on), name))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in on]
    return rows.join(small, same, "left").drop(*(f"_of_{k}" for k in on))


def positions(rows: DataFrame, keys: list[str], order: list[str], name: str, blocks: int | None = None) -> DataFrame:
    """Add the position of each row in its group, from 1, and _block."""
    placed, on = dealt(rows, keys, order, blocks), [*keys, "_block"]
    local = placed.withColumn(name, F.row_number().over(Window.partitionBy(*on).orderBy(*order)))
    before = carried(placed.groupBy(*on).agg(F.count("*").alias("_rows")), keys, "_rows", F.sum, "_before")
    return with_carried(local, before, keys, "_before").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, blocks: int | None = None) -> DataFrame:
    """Add the position of each row in its group, from 1, if groups are few and large: one shuffle; where groups begin in ranges is broadcast."""
    n, by = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, *order]
    # an id is the number of a partition and, in the low 33 bits, that of the row in it
    placed = table(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())).withColumn("_block", F.shiftright("_id", 33))
    runs = placed.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    earlier = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    begin = runs.select(*keys, "_block", (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_begin"))
    return with_carried(placed, begin, keys, "_begin").withColumn(name, F.col("_id") + F.col("_begin")).drop("_id", "_block", "_begin")
