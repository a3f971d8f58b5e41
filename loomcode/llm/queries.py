"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.llm.audit import audit_filters
from loomcode.llm.classifier import classify
from loomcode.llm.common import joined_small, written
from loomcode.llm.debruijn import remove_passages
from loomcode.llm.fingerprints import edited_fingerprints, nearest
from loomcode.llm.licenses import scan_licenses
from loomcode.llm.minhash import near_duplicates
from loomcode.llm.mixing import mix_sources
from loomcode.llm.packing import pack
from loomcode.llm.rules import apply_rules
from loomcode.llm.sharding import assign_shards
from loomcode.llm.suffix_dedup import remove_repeats
from loomcode.llm.trie import prefix_trie
from loomcode.llm.warc import archived_path, read_archives, write_archives

#: Sources that are wanted more or less than the others.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), WEIGHTS, epochs=1.0, seed=17)
    # The text has gone through the shuffle; its digest stands for it.
    return mixed.select("doc_id", "source", "copy", "rate", "shuffle_key", F.octet_length("text").cast("long").alias("text_bytes"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def tokenizer_path() -> str:
    """The vocabulary's place on this machine; it is installed on all."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archived_path(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prints = written(edited_fingerprints(docs), "prints")
    near = nearest(docs, prints.select("doc_id", "fingerprint", "text_sha256"), least=0.9, every=50)
    return joined_small(prints.drop("text_sha256"), near, "doc_id", 200_000)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(documents(spark, sf_dir), 50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("digest")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_mixing,
        op3_minhash,
        op4_packing,
        op5_warc,
        op6_fingerprints,
        op7_suffix_dedup,
        op8_substring_dedup,
        op9_rules,
        op10_classifier,
        op11_filter_audit,
        op12_prefix_trie,
        op13_licenses,
    )
}
