"""Filter interaction audit: what each filter removes at each step of every order in which the filters can be applied.

A filter is a condition under which a document fails; one of them may be "this text stands in a document with a smaller id". Each
document becomes a mask with a bit for each filter it fails, and documents are at once counted by part and mask, so that what follows is as long as
parts times masks and not as the corpus. The counts are then unpivoted against the steps of every order; a running bit-or over the steps before tells whether a
filter before this one has failed, conditional sums give the metrics of a step, and a window over all steps of a filter gives its total.

Copies are found without a group of copies ever meeting in a task: documents are counted by (digest, part, labels) with partial sums first, keeping the
least id and how many rows have it; the digest's least id is joined back to these counts. A text is known by its SHA-256.

Edges: a null text is empty; a null part is the empty string, as is an empty one; rows that repeat a doc_id are documents each, and rows with the least
doc_id of a text are all first; a row without a doc_id is neither before nor after another, so that it is no copy and makes none; a document with several
labels is good, or toxic, if one says so; labels without a document are not looked at. Very long texts are split once. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcode.llm.common import GAP, written

#: A filter: the columns text, n_words and n_distinct (words) in, whether the document fails out.
Filter = Callable[[Column, Column, Column], Column]


def few_words(text: Column, n_words: Column, n_distinct: Column) -> Column:
    return n_words < 200


def poor_vocabulary(text: Column, n_words: Column, n_distinct: Column) -> Column:
    return n_distinct * 100 < n_words * 50


def many_capitals(text: Column, n_words: Column, n_distinct: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > F.length(text) * 2


def signs(text: Column, n_words: Column, n_distinct: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


FILTERS: dict[str, Filter] = {"A": few_words, "B": poor_vocabulary, "C": many_capitals, "D": signs}
COPY = "E"
#: All orders of so many filters are listed at most: 5,040 of them.
MAX_FILTERS = 7


def masks(docs: DataFrame, filters: dict[str, Filter], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, digest, mask: a row for each document, with a bit for each of `filters` in their order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, GAP), "").alias("words"))
    rows = rows.select("doc_id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("n_words"), F.col("n_distinct")), 1 << i).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def labelled(labels: DataFrame) -> DataFrame:
    """label_id, good, toxic: a row for each document that is one of the two."""
    own = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("label_id"))
    return own.agg(F.coalesce(F.max(F.expr("quality = 1")), F.lit(False)).alias("good"), F.coalesce(F.max(F.expr("toxic = 1")), F.lit(False)).alias("toxic"))


def mask_counts(rows: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """part, mask, n, n_good, n_toxic: as many rows as parts have masks. Copies of a text with a smaller doc_id have copy_bit in their mask."""
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(labelled(labels), F.col("doc_id") == F.col("label_id"), "left")
    known = F.col("doc_id").isNotNull()
    kinds = ["digest", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), known.alias("known")]
    # A doc_id is once at most in a group, so that n of its least doc_id is the number of rows that have it.
    cells = written(rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")), "audit_cells")
    first = cells.where("known").groupBy("digest").agg(F.min("least").alias("first"))
    cells = cells.join(first, "digest", "left")
    fresh = F.when(~F.col("known"), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), fresh.alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - fresh).alias("n")))
    split = cells.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0L)")).alias("n_good"), F.sum(F.expr("if(toxic, n, 0L)")).alias("n_toxic"))


def steps_of(counts: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step and its metrics, from part, mask (bit i for names[i]), n, n_good, n_toxic."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    long = counts.withColumn("filter_order", F.explode(orders))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).where("filter <> ''")
    long = long.withColumn("bit", F.expr(" ".join(["case filter", *(f"when '{x}' then {1 << i}" for i, x in enumerate(names)), "end"])))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("failed", F.expr("mask & bit")).withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    total = lambda when, what="n": F.sum(F.when(F.expr(when), F.col(what)).otherwise(F.lit(0).cast("long")))
    steps = long.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter").agg(
        total("failed | earlier = 0").alias("kept"),
        total("failed <> 0 and earlier = 0").alias("removed"),
        total("failed <> 0 and earlier <> 0").alias("redundant"),
        total("failed <> 0 and mask = bit").alias("unique_fails"),
        total("failed <> 0 and earlier = 0", "n_good").alias("good_lost"),
        total("failed <> 0 and earlier = 0", "n_toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] | None = None, copy: str = COPY, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each step of each order in each part.

    filters: named by one letter each; `copy` names the filter that removes copies, which comes last among them.
    """
    filters = FILTERS if filters is None else filters
    names = "".join(filters) + copy
    if len(set(names)) != len(filters) + 1 or len(names) > MAX_FILTERS:
        raise ValueError(f"filters need names of one letter each, {MAX_FILTERS} at most: {names}")
    return steps_of(mask_counts(masks(docs, filters, id_col, text_col, part_col), labels, 1 << len(filters)), names)
