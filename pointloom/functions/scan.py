"""Running totals in one global order, in two levels: within sorted ranges, and over the ranges' sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def running_total(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value (NULL counts as 0) over all rows up to each one, in order, nulls first.

    A sort deals the rows by ranges; each range is summed up by itself, and what the ranges before it hold is added. Only
    the ranges' sums, one row each, are ever in one task. Rows that are equal in order follow each other in any order.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    sorted_ = staged(rows.orderBy(*by).withColumn("_mid", F.monotonically_increasing_id()))
    ranged = sorted_.withColumn("_range", F.shiftright("_mid", 33))  # the partition that the number begins with
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))  # one row a range
    return ranged.withColumn("_own", own).join(F.broadcast(base), "_range").withColumn(name, F.col("_own") + F.col("_base")).select(*rows.columns, name)
