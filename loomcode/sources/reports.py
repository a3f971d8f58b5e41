"""The tables of a run's and an analysis's workbook, as DataFrames; sinks.workbook writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.functions import text as T
from loomcode.operators import codebook
from loomcode.operators.analysis import Analysis

NO_GROUP = "(no group)"


def _shown(x) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(""))


def _group(x="grp") -> Column:
    return F.when(F.coalesce(F.col(x), F.lit("")) == "", NO_GROUP).otherwise(F.col(x))


def coding_rows(codings: DataFrame, documents: DataFrame, codes: DataFrame) -> DataFrame:
    """The twelve columns of a coding, in the order of documents and places; nulls of text are empty, lists are joined by "; ".

    codings: coding_id, doc_id, code_id, row_no, speaker, segment_text, rationale, matched_expressions, score, start_offset, end_offset;
    documents: doc_id, name, grp; codes: code_id, label, is_model_proposed.
    """
    rows = codings.join(documents.select("doc_id", "name", "grp"), "doc_id").join(codes.select("code_id", "label", "is_model_proposed"), "code_id")
    return rows.orderBy("doc_id", F.asc_nulls_first("start_offset"), "coding_id").select(
        F.col("name").alias("document"),
        _shown("grp").alias("group"),
        F.col("row_no").alias("excel_row"),
        _shown("speaker").alias("speaker"),
        "segment_text",
        F.col("label").alias("code"),
        _shown("rationale").alias("rationale"),
        F.array_join(F.coalesce("matched_expressions", F.array().cast("array<string>")), "; ").alias("matched_expressions"),
        F.col("score").alias("relevance_score"),
        "start_offset",
        "end_offset",
        F.coalesce("is_model_proposed", F.lit(False)).alias("model_proposed_code"),
    )


def segment_rows(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """segments: doc_id, position, row_no, speaker, text, status, codes, no_code_rationale. The eight columns, in the order of documents."""
    rows = segments.join(documents.select("doc_id", "name"), "doc_id").orderBy("doc_id", "position")
    return rows.select(
        F.col("name").alias("document"), F.col("row_no").alias("excel_row"), _shown("speaker").alias("speaker"), "position", F.col("text").alias("segment_text"), "status", "codes",
        _shown("no_code_rationale").alias("no_code_rationale"),
    )


def codebook_rows(codes: DataFrame, expressions: DataFrame, proposed: bool = False) -> DataFrame:
    """A codebook as it is read again by codebook.parsed_rows; with `proposed`, which codes a model has proposed."""
    rows = codebook.wide(codes, expressions)
    more = []
    if proposed:
        rows = rows.join(codes.select("code_id", F.coalesce("is_model_proposed", F.lit(False)).alias("Proposed by model")), "code_id")
        more = ["Proposed by model"]
    return rows.orderBy("label").select(F.col("label").alias("Code"), F.col("description").alias("Description"), F.col("example").alias("Example"), *more, *(f"Expressions_{x}" for x in T.LANGUAGES))


def run_sheets(run_id: int, codings: DataFrame, segments: DataFrame, documents: DataFrame, codes: DataFrame, expressions: DataFrame) -> dict[str, DataFrame]:
    """Codings, segments (if there are any; old runs have none) and the codebook."""
    sheets = {f"run_{run_id}_codings": coding_rows(codings, documents, codes)}
    if not segments.isEmpty():
        sheets["segments"] = segment_rows(segments, documents)
    return sheets | {"codebook": codebook_rows(codes, expressions, proposed=True)}


def analysis_sheets(a: Analysis) -> dict[str, DataFrame]:
    """A table for each block that has rows; lemmas and expressions by language. The driver holds the codes' labels and the languages."""
    codes = a.codes()
    labels = [r["label"] for r in codes.select("label").collect()]
    names = a.documents.select("doc_id", "name")
    sheets = {"codes": codes.drop("code_id")}
    groups = a.groups().orderBy("label", "grp")
    sheets["groups"] = groups.select(F.col("label").alias("code"), _group().alias("group"), F.col("pct").alias("pct_units_coded"), F.col("deviation").alias("deviation_from_mean"), F.col("mean").alias("cross_group_mean"))
    if labels:
        sheets["cooccurrence"] = a.square(labels)
        wide = a.documents_by_codes(labels)
        shown = a.coverage().select("doc_id", "name", "grp", "segments", "coded", "coverage_pct").join(wide, "doc_id", "left").fillna(0, labels)
        sheets["documents"] = shown.orderBy("name").select(F.col("name").alias("document"), F.col("grp").alias("group"), "segments", "coded", "coverage_pct", *labels)
    cell = [F.col("label").alias("code"), "lemma", "freq", "norm", F.col("total").alias("total_lemmas"), F.col("flagged").alias("low_volume")]
    with_group = [cell[0], _group().alias("group"), *cell[1:]]
    firing = [F.col("label").alias("code"), "expression", "firings"]
    by_lang = {
        "lemmas": (a.lemmas().orderBy("rank"), ["lemma", "freq", "norm"]),
        "lemmas_by_code": (a.lemmas_by_code().orderBy("label", "rank"), cell),
        "lemmas_by_code_group": (a.lemmas_by_code_group().orderBy("label", "grp", "rank"), with_group),
        "expressions": (a.expressions().orderBy(F.desc("firings"), "label", "expression"), firing),
        "expr_by_code_group": (a.expressions_by_code_group().orderBy("label", "grp", F.desc("firings"), "expression"), [firing[0], _group().alias("group"), *firing[1:]]),
    }
    # One look at each of the two tables tells which languages have a sheet.
    lemmas = {tuple(r) for r in a.lemma_cells.select("level", "lang").distinct().collect()}
    fired = {r["lang"] for r in a.firings.select("lang").distinct().collect()}
    there = {"lemmas": {x for k, x in lemmas if k == 0}, "lemmas_by_code": {x for k, x in lemmas if k == 1}, "lemmas_by_code_group": {x for k, x in lemmas if k == 2}, "expressions": fired, "expr_by_code_group": fired}
    known = {}
    for lang in T.LANGUAGES:
        for name, (block, columns) in by_lang.items():
            if lang in there[name]:
                known[f"{name}_{lang}"] = block.where(F.col("lang") == lang).select(*columns)
    top = a.top_extracts(True).join(names, "doc_id").orderBy("label", "grp", "rank")
    last = {"top_extracts": top.select(F.col("label").alias("code"), _group().alias("group"), "score", F.col("name").alias("document"), "text")}
    return {k: df for k, df in sheets.items() if not df.isEmpty()} | known | {k: df for k, df in last.items() if not df.isEmpty()}


def chart_rows(a: Analysis, name: str, code: str | None = None, group: str | None = None) -> DataFrame:
    """What a chart shows: label, value, ord. Lemmas have 20 bars, expressions 25, all others every row; a group counts only with a code."""
    from loomcode.sources.sinks import chart_data

    if name == "codes":
        return chart_data(a.codes(), "label", "codings")
    if name == "groups":
        return chart_data(a.groups().withColumn("label", F.concat_ws(" / ", "label", _group())), "label", "pct")
    if name in ("cooccurrence", "documents"):
        cells = a.cooccurrence_matrix().withColumn("label", F.concat_ws(" / ", "label_a", "label_b")) if name == "cooccurrence" else a.documents_grid().withColumn("label", F.concat_ws(" / ", F.col("doc_id").cast("string"), "label"))
        return chart_data(cells, "label", "units")
    if name not in ("lemmas", "expressions"):
        raise ValueError(f"unknown chart: {name}")
    level = 0 if code is None else 1 if group is None else 2
    # A chart sums over languages and ranks what is left: no cell's rank is needed.
    block = a.lemma_counts(level) if name == "lemmas" else a.expressions_by_code_group() if level == 2 else a.expressions()
    if code is not None:
        block = block.where(F.col("label") == code)
        block = block.where(F.col("grp") == group) if group is not None else block
    key, value, most = ("lemma", "freq", 20) if name == "lemmas" else ("expression", "firings", 25)
    return chart_data(block.groupBy(key).agg(F.sum(value).alias(value)), key, value, most)


def chart_scale(rows: DataFrame) -> DataFrame:
    """One row, most: the largest value, which a colour scale ends at; 1 where there is none."""
    return rows.agg(F.greatest(F.coalesce(F.max("value"), F.lit(1.0)), F.lit(1.0)).alias("most"))
