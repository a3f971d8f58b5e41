"""Dense numbers over rows of any number, without a window that puts a group of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcode.store import written


def numbered(rows: DataFrame, name: str, order: list[Column], keys: tuple[str, ...] = (), sums: dict[str, str] | None = None) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... in the given order, within rows of equal keys; and, for each (to, column) of sums, the sum of a column over them.

    Rows are dealt by ranges of keys and order and sorted there, so that a group of any size lies in as many partitions as it fills. A row's number is its
    place behind the first row of its group in its partition, and the group's rows in the partitions before. Only counts meet in a window: one
    for each partition that a group is in. The dealt rows are a table, as ranges are drawn from a sample; the counts are one too, so that readers of a part of
    the result do not count all of it again.
    """
    sums = sums or {}
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    held = written(dealt.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")), "numbered")
    starts = held.groupBy("__p", *keys).agg(F.min("__i").alias("__first"), F.count("*").alias("__n"), *(F.sum(c).alias(to) for to, c in sums.items()))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col("__p").alias("__q"), *(F.col(k).alias(f"__k_{k}") for k in keys), (before - F.col("__first")).alias("__shift"), *(F.sum(to).over(group).alias(to) for to in sums))
    starts = written(starts, "starts")
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = held.join(starts, same)
    return out.select(*rows.columns, *sums, (F.col("__i") + F.col("__shift")).alias(name))
