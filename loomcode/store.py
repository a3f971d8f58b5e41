"""Where tables go that are read again: the folder that all machines of a cluster see."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or else one of our own in the warehouse, which goes with the session.

    On a cluster, a warehouse on the driver's own disk is refused: executors would write tables there that nobody else sees.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = "loomcode.shared.dir"
        found = spark.conf.get(own, None)
        if not found:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if not _on_one_machine(spark) and (warehouse.startswith(("file:", "/")) or ":" not in warehouse):
                raise ValueError(f"{warehouse} is a folder of one machine: set spark.checkpoint.dir to one that all machines see")
            found = f"{warehouse}/loomcode-{uuid.uuid4().hex}"
            spark.conf.set(own, found)
            atexit.register(_gone, spark, found)
    return found.rstrip("/")


def _on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _gone(spark: SparkSession, path: str) -> None:
    try:
        removed(spark, path)
    except Exception:  # the session has ended already, and took its gateway along
        import shutil

        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.loomcode_path = path
    return again


def dropped(df: DataFrame) -> None:
    """Deletes what written() has made, when no later plan reads it."""
    removed(df.sparkSession, df.loomcode_path)
