"""Row numbers and running sums over a whole table without one task holding it.

Rows are range-partitioned by their order and stored; what each partition holds
in all is a short list, whose running sum gives the offsets.  A partition then
numbers its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.scratch import stored


def _offset(df: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """The rows with `_part`, `_value` and `_before`, what the partitions before theirs add up to."""
    spread = df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    held = stored(spread, "ordered")
    total = held.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(total.select("_part", before.alias("_before"))), "_part")  # one row a partition


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Adds the 1-based place of each row in the order."""
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return _offset(df, order, F.lit(1)).withColumn(name, place).drop("_part", "_value", "_before")


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of the values of all rows before each row; the order must be unique."""
    own = F.coalesce(F.sum("_value").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _offset(df, order, value).withColumn(name, own + F.col("_before")).drop("_part", "_value", "_before")
