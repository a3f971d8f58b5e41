"""Codebooks: snapshots of codes and expressions, and the changes to them, each a new DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcode.functions import text as T

CODES = "code_id long, label string, description string, example string, is_deleted boolean, proposed_in_run_id long"
EXPRESSIONS = "expr_id long, code_id long, lang string, expression string"


def active(codes: DataFrame) -> DataFrame:
    return codes.where(~F.coalesce("is_deleted", F.lit(False)))


def marked_duplicates(rows: DataFrame, label: str = "label", order: str = "ord") -> DataFrame:
    """Adds norm and duplicate: all but the first row of a normalised label."""
    rows = rows.withColumn("norm", T.normalize_label(F.col(label)))
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("norm").orderBy(order)) > 1)


def new_codes(codes: DataFrame, proposals: DataFrame, next_id: int) -> DataFrame:
    """proposals: ord, label, description, example. Those whose label no active code has, the first of each; ids from next_id."""
    known = active(codes).select(T.normalize_label(F.col("label")).alias("norm"))
    fresh = marked_duplicates(proposals).where("not duplicate").join(known, "norm", "left_anti")
    ids = F.row_number().over(Window.orderBy("ord")) - 1 + next_id  # proposals are a codebook's size
    return fresh.select(ids.cast("long").alias("code_id"), "label", "description", "example", F.lit(False).alias("is_deleted"))


def with_code(codes: DataFrame, label: str, next_id: int, description: str | None = None, example: str | None = None) -> DataFrame:
    """Adds a code; rejects a blank label, and one that an active code has."""
    if not label.strip():
        raise ValueError("a code needs a label")
    one = codes.sparkSession.createDataFrame([(0, label.strip(), description, example)], "ord int, label string, description string, example string")
    fresh = new_codes(codes, one, next_id)
    if fresh.isEmpty():
        raise ValueError(f"a code has the label {label}")
    return codes.unionByName(fresh, allowMissingColumns=True)


def resolve(codes: DataFrame, entries: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """entries: doc_id, position, entry, label, description, example, in which codes are named by label.

    (entries with code_id, codes with the new ones): the first proposal of an unknown label creates its code, later ones map to it.
    """
    ranked = entries.withColumn("norm", T.normalize_label(F.col("label")))
    order = F.struct("doc_id", "position", "entry")
    known = active(codes).groupBy(T.normalize_label(F.col("label")).alias("norm")).agg(F.min("code_id").alias("code_id"))
    first = ranked.join(known, "norm", "left_anti").groupBy("norm").agg(F.min_by(F.struct("label", "description", "example"), order).alias("c"), F.min(order).alias("at"))
    ids = F.row_number().over(Window.orderBy("at")) - 1 + next_id  # as many rows as there are new codes
    made = first.select("norm", ids.cast("long").alias("code_id"), "c.*")
    both = known.unionByName(made.select("norm", "code_id"))
    added = made.select("code_id", "label", "description", "example", F.lit(False).alias("is_deleted"))
    return ranked.join(both, "norm", "left").drop("norm"), codes.unionByName(added, allowMissingColumns=True)


def renamed(codes: DataFrame, code_id: int, label: str) -> DataFrame:
    """Rejects a label that another active code has."""
    spark = codes.sparkSession
    norm = spark.range(1).select(T.normalize_label(F.lit(label)).alias("n")).first()["n"]
    if active(codes).where((F.col("code_id") != code_id) & (T.normalize_label(F.col("label")) == norm)).limit(1).count():
        raise ValueError(f"another code has the label {label}")
    return codes.withColumn("label", F.when(F.col("code_id") == code_id, F.lit(label)).otherwise(F.col("label")))


def soft_deleted(codes: DataFrame, code_id: int) -> DataFrame:
    return codes.withColumn("is_deleted", F.when(F.col("code_id") == code_id, True).otherwise(F.coalesce("is_deleted", F.lit(False))))


def with_expressions(expressions: DataFrame, code_id: int, wanted: DataFrame, next_id: int, fold_case: bool = True) -> DataFrame:
    """wanted: ord, lang, expression. Replaces a code's expressions; equal ones are kept once, the first, and case tells them apart only
    without fold_case, as when a code is made or read from a table."""
    once = wanted.withColumn("expression", T.strip("expression")).where("expression <> ''")
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("lang", F.lower("expression") if fold_case else F.col("expression")).orderBy("ord"))).where("n = 1")
    ids = F.row_number().over(Window.orderBy("ord")) - 1 + next_id
    added = once.select(ids.cast("long").alias("expr_id"), F.lit(code_id).cast("long").alias("code_id"), "lang", "expression")
    return expressions.where(F.col("code_id") != code_id).unionByName(added)


def expression_counts(codes: DataFrame, expressions: DataFrame) -> DataFrame:
    """code_id, lang, n: of active codes."""
    return expressions.join(active(codes).select("code_id"), "code_id", "left_semi").groupBy("code_id", "lang").agg(F.count("*").alias("n"))


def uncovered(codes: DataFrame, expressions: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, n_codes: for each corpus language, how many active codes have no expression in it. Deleted codes count neither as codes nor as
    covered ones, though their expressions are still there."""
    grid = active(codes).select("code_id").crossJoin(languages.select("lang"))  # a codebook by at most a few languages
    have = expressions.select("code_id", "lang").distinct()
    missing = grid.join(have, ["code_id", "lang"], "left_anti").groupBy("lang").agg(F.count("*").alias("n_codes"))
    return languages.select("lang").join(missing, "lang", "left").fillna(0, ["n_codes"])


def wide(codes: DataFrame, expressions: DataFrame) -> DataFrame:
    """code_id, label, description, example, Expressions_<lang> joined by "; "."""
    per = expressions.groupBy("code_id").pivot("lang", T.LANGUAGES).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("expr_id", "expression"))), lambda x: x["expression"]), "; "))
    out = active(codes).join(per, "code_id", "left").fillna("", T.LANGUAGES)
    return out.select("code_id", "label", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("example", F.lit("")).alias("example"), *(F.col(x).alias(f"Expressions_{x}") for x in T.LANGUAGES)).orderBy("label")


def parsed_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A codebook table as read: (ord, label, description, example), (ord, lang, expression). Headers in any case; blank or "nan" is null."""
    names = {c.strip().lower(): c for c in rows.columns}
    if "code" not in names:
        raise ValueError("a codebook needs a column Code")
    cell = lambda key: F.nullif(F.nullif(T.strip(F.col(f"`{names[key]}`").cast("string")), F.lit("")), F.lit("nan")) if key in names else F.lit(None).cast("string")
    order = F.col("ord") if "ord" in rows.columns else F.monotonically_increasing_id()
    base = rows.withColumn("ord", order).withColumn("label", cell("code")).where("label is not null")
    codes = base.select("ord", "label", cell("description").alias("description"), cell("example").alias("example"))
    langs = [k.removeprefix("expressions_") for k in names if k.startswith("expressions_")]
    listed = F.array(*(F.struct(F.lit(x).alias("lang"), T.split_expressions(F.coalesce(cell(f"expressions_{x}"), F.lit(""))).alias("xs")) for x in langs)) if langs else None
    if listed is None:
        return codes, base.select("ord", F.lit("").alias("lang"), F.lit("").alias("expression")).where("false")
    exprs = base.select("ord", F.explode(listed).alias("x")).select("ord", "x.lang", F.explode("x.xs").alias("expression"))
    return codes, exprs


def active_or_referenced(codes: DataFrame, codings: DataFrame) -> DataFrame:
    """Active codes and those that codings name, once each."""
    used = codes.join(codings.select("code_id").distinct(), "code_id", "left_semi")
    return active(codes).unionByName(used).dropDuplicates(["code_id"])


def lemma_warning(n):
    """inert without a lemma, weak with one."""
    return F.when(n == 0, "inert").when(n == 1, "weak")


def lemma_preview(spark: SparkSession, expressions: list[str], lang: str) -> DataFrame:
    """expression, phrase, lemmas, warning: inert without a lemma, weak with one."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(expressions)], "ord int, expression string").withColumn("lang", F.lit(lang))
    rows = rows.withColumn("phrase", T.is_phrase("expression")).withColumn("lemmas", T.expression_lemmas(F.col("expression"), F.col("lang")))
    return rows.withColumn("warning", lemma_warning(F.size("lemmas"))).orderBy("ord")
