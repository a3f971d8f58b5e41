"""Continuous ingest: document files are coded as they come, by the same plan as a batch, and a document counts once.

A state by document keeps the hash of the text that counts, and how often it has changed. A document that arrives again with the same text is nothing new; with
another one, the later text wins, of one batch or two. What has changed in a batch is written first, and everything else is made from that
table, so that a batch that is run again after a crash writes the same again in its own folder. Facts of a text that was replaced stay
on disk; they are not read, as a document's last version alone is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomcode.operators import facts, segment

ARRIVING = "doc_id long, text string, lang string"
CHANGED = "doc_id long, text string, lang string, version long"


def _last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last text of a document, if it is another than the one that counts; a row at a time is held, and its hash from then on."""
    best = None
    for b in batches:
        for row in zip(b["arrived"], b["hash"], b["text"], b["lang"], strict=True):
            best = row if best is None or row[:2] > best[:2] else best
    seen, version = state.get if state.exists else (None, 0)
    if best is not None and best[1] != seen:
        state.update((best[1], version + 1))
        yield pd.DataFrame([(key[0], best[2], best[3], version + 1)], columns=["doc_id", "text", "lang", "version"])


def changed_documents(arriving: DataFrame) -> DataFrame:
    """arriving: a stream of doc_id, text, lang, arrived. doc_id, text, lang, version of the documents whose text is new; a document without an id cannot be known again,
    and is left out. Null texts are empty; texts that arrive at one time are taken in the order of their hashes."""
    text = F.coalesce("text", F.lit(""))
    rows = arriving.where("doc_id is not null").select("doc_id", text.alias("text"), "lang", "arrived", F.sha2(F.concat_ws("\u0001", F.coalesce("lang", F.lit("")), text), 256).alias("hash"))
    return rows.groupBy("doc_id").applyInPandasWithState(_last, CHANGED, "hash string, version long", "update", GroupStateTimeout.NoTimeout)


def coded_stream(spark: SparkSession, path: str, codes: DataFrame, expressions: DataFrame, out: str, checkpoint: str, unit: str = "paragraph", run_id: int = 0) -> StreamingQuery:
    """Reads parquet files of doc_id, text, lang under path, all that is there, and writes facts under out; ingested() reads them.

    The state has a row for each document; with many of them, spark.sql.streaming.stateStore.providerClass should be the one that keeps it on disk.
    """

    def write(batch: DataFrame, number: int) -> None:
        home = lambda table: f"{out}/{table}/run_id={run_id}/batch={number}"
        batch.write.mode("overwrite").parquet(home("documents"))
        held = spark.read.schema(CHANGED).parquet(home("documents"))
        units = segment.plain_units(held, unit, ("lang", "version"))
        coded = facts.DictionaryCoder(codes, expressions).outcomes(units, None)
        facts.facts_of(coded).write.mode("overwrite").parquet(home("units"))

    source = spark.readStream.schema(ARRIVING).parquet(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    return changed_documents(source).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str, run_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(segments, codings) of what has been ingested: of each document's last text."""
    mine = F.col("run_id") == run_id
    # A text without units counts too: it replaces an earlier one that had some.
    last = spark.read.parquet(f"{out}/documents").where(mine).groupBy("doc_id").agg(F.max("version").alias("version"))
    units = spark.read.parquet(f"{out}/units").where(mine).join(last, ["doc_id", "version"], "left_semi").drop("batch")
    return facts.segments_view(units), facts.codings_view(units)
