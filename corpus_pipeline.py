"""A corpus pipeline of five stages, each an operator of loomcode.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the next documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.llm.classifier import classify, hash_of, site_of
from loomcode.llm.common import written
from loomcode.llm.debruijn import remove_passages
from loomcode.llm.minhash import near_duplicates
from loomcode.llm.mixing import mix_sources
from loomcode.llm.packing import pack
from loomcode.llm.queries import WEIGHTS, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows that share a doc_id, or have none, are told apart by their text and site."""
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_key=True)
    gone = judged.where("not kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), F.col("path").alias("site")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (hash_of() == F.col("h")) & (site_of()[1] == F.col("site"))
    return docs.select(COLUMNS).join(gone, same, "left_anti")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    # Numbers in the order of doc_id stand for rows, as ids may be null or repeated; the least one stays.
    rows = written(docs.select(COLUMNS).orderBy(F.col("doc_id").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates(rows, width=5, percent=80, id_col="row").where("not kept").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; a document of which nothing is left goes."""
    cut = remove_passages(docs, 50).where("kept is not null").select(F.col("doc_id").alias("id"), F.col("th").alias("h"), "kept").dropDuplicates(["id", "h"])
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    both = docs.select(COLUMNS).join(cut, F.col("doc_id").eqNullSafe(F.col("id")) & (text_hash == F.col("h")), "left")
    both = both.withColumn("n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")))
    return both.withColumn("text", F.coalesce("kept", "text")).where("kept is null or kept <> ''").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights."""
    return mix_sources(docs, WEIGHTS, epochs=1.0, seed=17).select(COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as pieces of token windows."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_distinct),
    ("substring dedup", cut_passages),
    ("mixing", mix),
    ("packing", pack_windows),
]

#: The fitted classifier and the tokenizer are beyond SQL; tests/llm compares the stages with plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
