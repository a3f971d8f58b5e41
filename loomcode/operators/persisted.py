"""Relations of workspaces on disk: a change rewrites the partition of its workspace, and no other file.

A relation is a folder root/name, partitioned by workspace_id; relations without one (codings, expressions and others that hang on a document, a run or
a code) are kept with the workspace of what they hang on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.store import dropped, exists, removed, written


def create(root: str, relations: dict[str, DataFrame]) -> None:
    """Writes relations anew; each has a workspace_id."""
    for name, df in relations.items():
        df.write.mode("overwrite").partitionBy("workspace_id").parquet(f"{root}/{name}")


def opened(spark: SparkSession, root: str, name: str, workspace_id: int | None = None) -> DataFrame:
    """A relation, or the rows of one workspace, of which only the partition is read."""
    df = spark.read.parquet(f"{root}/{name}")
    return df if workspace_id is None else df.where(F.col("workspace_id") == workspace_id)


def changed(spark: SparkSession, root: str, workspace_id: int, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], names: list[str]) -> None:
    """Applies change to the workspace's rows of the named relations, and writes those that it returns.

    change gets and returns relations by name; rows of other workspaces that it returns (a copy's) go to theirs, beside what is there. New rows are a table of
    their own first, so that nothing is overwritten while it is still read; then each partition is replaced at once, as the writer commits. A
    workspace that has no row left in a relation has no partition there.
    """
    before = {k: opened(spark, root, k, workspace_id) for k in names}
    for name, df in change(before).items():
        if df is before.get(name):
            continue
        new = written(df, "change")
        mine = F.col("workspace_id") == workspace_id
        kept, others = new.where(mine), new.where(~mine)
        if kept.isEmpty():
            path = f"{root}/{name}/workspace_id={workspace_id}"
            if exists(spark, path):
                removed(spark, path)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(f"{root}/{name}")
        if not others.isEmpty():
            others.write.mode("append").partitionBy("workspace_id").parquet(f"{root}/{name}")
        dropped(new)
