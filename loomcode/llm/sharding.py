"""Balanced contiguous shards from global prefix sums of sizes.

Documents are put in order of doc_id by a range partitioning. Each partition's total goes into a
table with a row for each partition; its running sums, added to those inside each partition, give
every document its place among all bytes. Equal targets cut that line into shards.

Edges: a null text has no bytes; null doc_ids come first; rows that agree in doc_id and text are
interchangeable; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcode.llm.common import parts, written

OVERHEAD = 16


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, shard (0 to n_shards - 1), slot in the shard.

    A shard's size differs from total / n_shards by a document's size at most, since a document
    goes where the middle of its bytes lies.
    """
    spark = docs.sparkSession
    order = ["doc_id", "text_crc32", "size"]
    rows = sized(docs, id_col, text_col)
    ranged = rows.repartitionByRange(parts(spark), *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "shards")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    # A row for each partition, and so few enough for one task.
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(line), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(line), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(everything).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("end_here", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank_here", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "part")  # as many rows as there are partitions
        .withColumn("twice_middle", 2 * (F.col("size_before") + F.col("end_here")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast((twice_middle * {n_shards}) div (2 * total) as int)"))
        .withColumn("rank", F.col("rows_before") + F.col("rank_here"))
        .select("doc_id", "size", "text_crc32", "shard", "rank")
    )
    placed = written(placed, "shards")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot")
    )
