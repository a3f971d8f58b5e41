"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with a share w of the wanted bytes is repeated w * budget / bytes times on average. Each
document draws its number of copies from the Poisson distribution with that mean, by inverting
it at a number that a hash of the seed and the document gives; copies are then put in a global random
order by a range partitioning on a hash.

Documents are told apart by id and text; rows that are equal in both are numbered, so that each row draws a number of its own. Only such rows are numbered,
over ranges, so that a group of any size is spread; which of them has which number makes no difference.

A mean over CHUNK_MEAN is drawn as a sum of independent parts, so that no probability underflows.

Edges: a null source is a source of its own; a source without a weight takes `default_weight`; null and
empty texts are the same and count OVERHEAD bytes; rows without a doc_id, or that repeat one, draw numbers of their own each. An empty table
gives an empty result. The columns of the input are kept; an input column named as one that is added
is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.llm.common import joined_small, parts, written
from loomcode.operators.numbering import numbered

OVERHEAD = 16
CHUNK_MEAN = 16.0
#: Terms of the distribution function, enough for means up to CHUNK_MEAN in double precision.
TERMS = 80
MAX_SOURCES = 10_000
#: Documents that stand more than once: so many are looked up by a broadcast, more by a shuffle.
MAX_REPEATED = 100_000


def unit_hash(*what: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *what)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, epochs: float, source_col: str, text_col: str) -> DataFrame:
    """mix_source, rate, n_chunks, cdf (of one part): a row for each source."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(OVERHEAD)
    name = F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("null"))
    totals = docs.groupBy(name.alias("mix_source")).agg(F.sum(size.cast("long")).alias("bytes"))
    weight = F.lit(float(default_weight))
    for k, v in weights.items():
        weight = F.when(F.col("mix_source") == "s:" + k, F.lit(float(v))).otherwise(weight)
    totals = totals.withColumn("weight", weight)
    sums = totals.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rates = totals.crossJoin(F.broadcast(sums))  # one row
    rates = rates.withColumn("rate", F.col("weight") / F.col("all_weight") * F.lit(float(epochs)) * F.col("all_bytes") / F.col("bytes"))
    rates = rates.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK_MEAN)).cast("int"))
    rates = rates.withColumn("mean", F.col("rate") / F.col("n_chunks"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda acc, k: F.struct(
            (acc["p"] * F.col("mean") / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k)).alias("cdf"),
        ),
    )
    return rates.select("mix_source", "rate", "n_chunks", step["cdf"].alias("cdf"))


def with_own_name(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds mix_name, a string that no other row has: id, MD5 of the text, and a number among rows that are equal in both."""
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    named = docs.withColumn("mix_name", F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text))
    twice = named.groupBy("mix_name").agg(F.count("*").alias("mix_rows")).where("mix_rows > 1")
    twice = written(twice.select("mix_name", F.lit(True).alias("mix_again")), "mix_repeated")
    number = lambda n: F.concat_ws(":", "mix_name", n.cast("string"))
    if twice.isEmpty():
        return named.withColumn("mix_name", number(F.lit(0)))
    told = joined_small(named, twice, "mix_name", MAX_REPEATED)
    one = told.where("mix_again is null").withColumn("mix_nth", F.lit(0).cast("long"))
    many = numbered(told.where("mix_again").withColumn("mix_at", F.monotonically_increasing_id()), "mix_nth", [F.col("mix_at")], ("mix_name",)).drop("mix_at")
    return one.unionByName(many).withColumn("mix_name", number(F.col("mix_nth"))).drop("mix_again", "mix_nth")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The columns of docs, with copy (from 0), rate, shuffle_key: a row for each copy, in a global order by shuffle_key."""
    added = ["copy", "rate", "shuffle_key", "mix_source", "n_chunks", "cdf", "n_copies", "mix_name", "mix_again", "mix_nth", "mix_at"]
    kept = [c for c in docs.columns if c not in added]
    rates = source_rates(docs, weights or {}, default_weight, epochs, source_col, text_col)
    name = F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("null"))
    own = with_own_name(docs.select(*(F.col(f"`{c}`") for c in kept)), id_col, text_col)
    drawn = joined_small(own.withColumn("mix_source", name), rates, "mix_source", MAX_SOURCES)
    ident = F.col("mix_name")
    # The hash is bound once a part, outside the search in the distribution function.
    draw = lambda i: F.element_at(
        F.transform(F.array(unit_hash(F.lit(str(seed)), ident, i.cast("string"))), lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u))), 1
    )
    n = F.aggregate(F.sequence(F.lit(1), F.col("n_chunks")), F.lit(0), lambda acc, i: acc + draw(i))
    copies = drawn.withColumn("n_copies", n).where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), ident, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    copies = copies.withColumn("shuffle_key", key)
    n_parts = parts(docs.sparkSession)
    return copies.repartitionByRange(n_parts, "shuffle_key").sortWithinPartitions("shuffle_key").select(*(F.col(f"`{c}`") for c in kept), "copy", "rate", "shuffle_key")
