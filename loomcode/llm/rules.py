"""Quality rules whose cutoffs carry a guarantee, in DataFrame operations only.

Each rule is a number of a document, higher for worse. LEVELS are sets of cutoffs, one for each rule, that grow stricter from one to the next; a
document is rejected at a level if any rule is over its cutoff. Labelled good documents that pass the base rules are the holdout. In each stratum (language),
levels are tested in their fixed order, the mildest first: a level is certified if P(Binomial(n, risk) <= x) <= delta / strata, where x of n good documents are
rejected there, that is, if the exact upper bound on the share of good documents that the rules together reject is at most `risk`. The first level that fails ends
the sequence, so that levels need no correction among each other; strata have Bonferroni's. The last certified level counts, and a stratum without any
rejects nothing. So with probability 1 - delta, no stratum loses more than `risk` of its good documents. A level can be certified from
log(delta / strata) / log(1 - risk) good documents on: 437 with 4 strata, a risk of 0.01 and a delta of 0.05.

Edges: a null or empty text has no words and fails the base rules; a null language is a stratum of its own; a document with
several labels is good if one says so; labels without a document are not looked at; rows that repeat a doc_id are judged each; empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.llm.common import GAP, joined_small, written

WINDOW = 5
#: rule: (its number, its cutoffs from level to level).
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15]),
    "word_length": ("word_chars / greatest(n_words, 1)", [60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 11.0, 10.0]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.1, 0.08]),
}
LEVELS = 10
MAX_STRATA = 1000


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(hashes: Column) -> Column:
    """How many words lie in windows found twice or more, from the hashes of all windows in order."""

    def count(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = bound(ordered, lambda a: F.filter(a, lambda s, j: F.coalesce(F.get(a, j - 1)["x"] == s["x"], F.lit(False)) | F.coalesce(F.get(a, j + 1)["x"] == s["x"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda s: s["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bound(hashes, count)).otherwise(F.lit(0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s:"), F.col(stratum_col)), F.lit("null")).alias("stratum"),
        text.alias("text"),
        F.array_remove(F.split(text, GAP), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>"))
    rows = rows.select(
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    rows = rows.withColumn("n_repeat_words", repeated_words(F.col("windows")).cast("long")).drop("windows")
    return rows.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def binomial_cdf(x: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= x), summed term by term in logarithms; 1 where x is not below n * p, and so can't be small."""
    import math

    odds = math.log(p / (1 - p))
    first = F.struct((n * math.log1p(-p)).alias("term"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(acc, k):
        term = acc["term"] + F.log((n - k + 1) / k) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(x >= 1, F.sequence(F.lit(1), x.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, first, step, lambda acc: acc["sum"]))


def rejected(level: int) -> Column:
    """Whether any rule is over its cutoff of a level."""
    return F.expr(" or ".join(f"{rule} > {cuts[level]!r}D" for rule, cuts in RULES.values()))


def certified_levels(measures: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """stratum, level: the last level of the sequence that is certified; null where none is. A row for each stratum with a good document."""
    good = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality")).where("quality = 1")
    holdout = measures.where("not base_failed").join(good, F.col("doc_id") == F.col("labelled"), "left_semi")
    counts = written(holdout.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(rejected(i)).alias(f"x{i}") for i in range(LEVELS))), "holdout")
    strata = max(counts.count(), 1)
    sure = [binomial_cdf(F.col(f"x{i}"), F.col("n").cast("double"), risk) <= delta / strata for i in range(LEVELS)]
    passed, level = F.lit(True), F.lit(None).cast("int")
    for i, ok in enumerate(sure):
        passed = passed & ok
        level = F.when(passed, F.lit(i)).otherwise(level)
    return counts.select("stratum", level.alias("level"))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, level (its stratum's, or null): a row for each document."""
    measures = written(measured(docs, id_col, text_col, stratum_col), "measures")
    levels = written(certified_levels(measures, labels, risk, delta), "levels")
    judged = joined_small(measures, levels, "stratum", MAX_STRATA)
    bad = F.lit(False)
    for i in range(LEVELS):
        bad = F.when(F.col("level") == i, rejected(i)).otherwise(bad)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "level")
