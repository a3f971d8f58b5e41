"""The analysis of a run: long blocks over facts.

facts: segments (doc_id, position, text, status, start_offset, end_offset), codings (doc_id, position, code_id, score, matched_expressions),
documents (doc_id, grp, lang, name), codes (code_id, label). Ties are broken by the first coding or unit in the order of
(doc_id, position). Percentages have one decimal place, as rounded() rounds, and stand beside their numerator and denominator.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcode.functions import text as T
from loomcode.operators.numbering import numbered
from loomcode.store import exists, written

LOW_VOLUME = 50
TOP_LEMMAS = 30
TOP_EXTRACTS = 5


class Analysis:
    def __init__(self, segments: DataFrame, codings: DataFrame, documents: DataFrame, codes: DataFrame, stoplists: dict[str, list[str]] | None = None):
        label = F.coalesce("label", F.concat(F.lit("code "), F.col("code_id").cast("string")))
        self.documents = documents.withColumn("grp", F.coalesce("grp", F.lit("")))
        self.segments = segments
        self.codable = segments.where("status <> 'excluded'")
        self.labels = codes.select("code_id", "label")
        self.label = label
        self.codings = codings.join(self.labels, "code_id", "left").withColumn("label", label)
        self.unit_codes = self.codings.select("doc_id", "position", "code_id", "label").distinct()
        self.stoplists = stoplists or {}

    def meta(self) -> DataFrame:
        return self.segments.agg(F.count("*").alias("n_segments"), F.count_if(F.col("status") == "coded").alias("n_coded"), F.count_if(F.col("status") == "excluded").alias("n_excluded"))

    def codes(self) -> DataFrame:
        n = self.codable.agg(F.count("*").alias("n_codable"))
        per = self.codings.groupBy("code_id", "label").agg(F.count("*").alias("codings"), F.countDistinct("doc_id", "position").alias("units"), F.min(F.struct("doc_id", "position")).alias("first"))
        out = per.crossJoin(F.broadcast(n))  # one row
        return out.withColumn("pct_units", T.percent(F.col("units"), F.col("n_codable"), 1)).orderBy(F.desc("codings"), "first").drop("first")

    @cached_property
    def coded(self) -> DataFrame:
        """segments with code_ids: the distinct codes of a unit, in order."""
        if "code_ids" in self.segments.columns:
            return self.segments.withColumn("code_ids", F.sort_array("code_ids"))
        per = self.unit_codes.groupBy("doc_id", "position").agg(F.sort_array(F.collect_set("code_id")).alias("code_ids"))
        return self.segments.join(per, ["doc_id", "position"], "left").withColumn("code_ids", F.coalesce("code_ids", F.array().cast("array<long>")))

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows with the label of their code_id."""
        return rows.join(self.labels, "code_id", "left").withColumn("label", F.when(F.col("code_id").isNotNull(), self.label))

    @cached_property
    def group_counts(self) -> DataFrame:
        """grp, codable, code_ids, n: how many units of a group have a set of codes; all that is said of groups is summed from this table."""
        rows = self.coded.select("doc_id", (F.col("status") != "excluded").alias("codable"), "code_ids").join(self.documents.select("doc_id", "grp"), "doc_id")
        return written(rows.groupBy("grp", "codable", "code_ids").agg(F.count("*").alias("n")), "groups")

    def units_per_group(self) -> DataFrame:
        return self.group_counts.where("codable").groupBy("grp").agg(F.sum("n").alias("n_units"))

    def groups(self) -> DataFrame:
        """label, grp, units, n_units, pct, mean, deviation: every code by every group. Empty with fewer than two groups."""
        present = self.group_counts.select("grp").distinct()
        n = present.agg(F.count("*").alias("n_groups")).where("n_groups >= 2")
        hits = self.labelled(self.group_counts.select("grp", "n", F.explode("code_ids").alias("code_id"))).groupBy("label", "grp").agg(F.sum("n").alias("units"))
        labels = hits.select("label").distinct()
        grid = labels.crossJoin(present.crossJoin(n).select("grp"))  # codes by groups: as many rows as the result has
        out = grid.join(hits, ["label", "grp"], "left").join(self.units_per_group(), "grp", "left").fillna(0, ["units", "n_units"])
        out = out.withColumn("pct", T.percent(F.col("units"), F.col("n_units"), 1))
        # The mean is of the rounded shares.
        listed = F.array_sort(F.collect_list(F.struct("grp", "pct")).over(Window.partitionBy("label")))
        mean = F.aggregate(listed, F.lit(0.0), lambda acc, x: acc + x["pct"]) / F.size(listed)
        return out.withColumn("mean", T.rounded(mean, 1)).withColumn("deviation", T.rounded(F.col("pct") - F.col("mean"), 1))

    def cooccurrence(self) -> DataFrame:
        """label_a, label_b, units: both orders; the diagonal has a code's units. Only pairs that occur."""
        if "code_ids" in self.segments.columns:
            units = self.coded.select("code_ids")
        else:
            units = self.codings.groupBy("doc_id", "position").agg(F.sort_array(F.collect_set("code_id")).alias("code_ids"))
        # Units are counted by their sets of codes, of which there are far fewer; pairs are made of the sets.
        sets = self.labelled(units.groupBy("code_ids").agg(F.count("*").alias("n")).select("n", "code_ids", F.explode("code_ids").alias("code_id")))
        sets = sets.groupBy("code_ids").agg(F.first("n").alias("n"), F.collect_set("label").alias("labels"))
        pairs = sets.select("n", "labels", F.explode("labels").alias("label_a")).select("n", "label_a", F.explode("labels").alias("label_b"))
        return pairs.groupBy("label_a", "label_b").agg(F.sum("n").alias("units"))

    def cooccurrence_matrix(self) -> DataFrame:
        """label_a, label_b, units: every code that occurs with every other, and 0 where they never meet."""
        labels = self.unit_codes.select("label").distinct()
        grid = labels.select(F.col("label").alias("label_a")).crossJoin(labels.select(F.col("label").alias("label_b")))  # codes by codes
        return grid.join(self.cooccurrence(), ["label_a", "label_b"], "left").fillna(0, ["units"])

    def square(self, labels: list[str]) -> DataFrame:
        """The matrix as a table: label_a, and a column for each label."""
        return self.cooccurrence_matrix().where(F.col("label_a").isin(labels)).groupBy("label_a").pivot("label_b", labels).agg(F.first("units")).orderBy("label_a")

    def documents_grid(self) -> DataFrame:
        """doc_id, label, units: every document with a codable unit by every code that occurs, and 0 where there is none."""
        labels = self.unit_codes.select("label").distinct()
        hits = self.unit_codes.groupBy("doc_id", "label").agg(F.count("*").alias("units"))
        grid = self.codable.select("doc_id").distinct().crossJoin(labels)  # documents by codes: as many rows as the result has
        return grid.join(hits, ["doc_id", "label"], "left").fillna(0, ["units"])

    def coverage(self) -> DataFrame:
        per = self.codable.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_if(F.col("status") == "coded").alias("coded"))
        return per.join(self.documents, "doc_id").withColumn("coverage_pct", T.percent(F.col("coded"), F.col("segments"), 1))

    def documents_by_codes(self, labels: list[str]) -> DataFrame:
        return self.unit_codes.groupBy("doc_id").pivot("label", labels).agg(F.count("position")).fillna(0, labels)

    def lemma_tokens(self) -> DataFrame:
        """doc_id, position, lang, grp, code_ids, lemma: of coded units, without stop words, digits and the stop lists."""
        docs = self.documents.where(F.col("lang").isin(T.LANGUAGES)).select("doc_id", "lang", "grp")
        rows = self.coded.where("status = 'coded'").select("doc_id", "position", "text", "code_ids").join(docs, "doc_id")
        rows = rows.select("doc_id", "position", "lang", "grp", "code_ids", F.explode(T.content(T.tokens(F.col("text")), F.col("lang"))).alias("lemma"))
        rows = rows.where(~F.rlike("lemma", F.lit(r"^[\p{N}'_-]+$")))
        for lang, words in self.stoplists.items():
            own = sorted({w.strip().lower() for w in words} - {""})
            if own:
                rows = rows.where(~((F.col("lang") == lang) & F.col("lemma").isin(own)))
        return rows

    def lemma_counts(self, level: int) -> DataFrame:
        """lang, lemma, freq of languages (level 0); with label of codes (1), and with grp of codes in groups (2): counts alone, nothing ranked or written.

        Texts are cut once. Lemmas are counted by sets of codes first, so that what a unit's codes repeat are counts and not tokens.
        """
        keys = [["lang"], ["lang", "label"], ["lang", "label", "grp"]][level]
        if level == 0:
            return self.lemma_tokens().groupBy("lang", "lemma").agg(F.count("*").alias("freq"))
        own = ["lang", "grp"] if level == 2 else ["lang"]
        per = self.lemma_tokens().groupBy(*own, "code_ids", "lemma").agg(F.count("*").alias("n"))
        rows = self.labelled(per.select(*own, "lemma", "n", F.explode("code_ids").alias("code_id")))
        return rows.groupBy(*keys, "lemma").agg(F.sum("n").alias("freq"))

    @cached_property
    def lemma_cells(self) -> DataFrame:
        """level, lang, label, grp, lemma, freq, total, rank: of a language (level 0), a code (1), a code in a group (2).

        Texts are cut once. Lemmas are counted by sets of codes first, so that what a unit's codes repeat are counts and not tokens; the two levels of codes
        are grouping sets of these counts. Ranks and totals are by range partitions, so that no language is in one task.
        """
        per = self.lemma_tokens().groupBy("lang", "grp", "code_ids", "lemma").agg(F.count("*").alias("n"))
        # The language's own cell is a set of codes that all units have: none.
        every = F.concat(F.array(F.lit(None).cast("long")), F.col("code_ids").cast("array<long>"))
        rows = self.labelled(per.select("lang", "grp", "lemma", "n", F.explode(every).alias("code_id")))
        sets = rows.groupingSets([[F.col(c) for c in ("lang", "label", "lemma")], [F.col(c) for c in ("lang", "label", "grp", "lemma")]], "lang", "label", "grp", "lemma")
        cells = sets.agg(F.sum("n").alias("freq"), F.grouping("grp").alias("over_groups"))
        level = F.when(F.col("label").isNull(), 0).when(F.col("over_groups") == 1, 1).otherwise(2)
        cells = cells.where("label is not null or over_groups = 1").select(level.alias("level"), "lang", "label", "grp", "lemma", "freq")
        return numbered(cells, "rank", [F.desc("freq"), F.col("lemma")], ("level", "lang", "label", "grp"), {"total": "freq"})

    def _cells(self, level: int, keys: list[str]) -> DataFrame:
        out = self.lemma_cells.where(F.col("level") == level).withColumn("norm", T.rounded(F.col("freq") / F.col("total"), 4))
        return out.select(*keys, "lemma", "freq", "total", "norm", (F.col("total") < LOW_VOLUME).alias("flagged"), (F.col("rank") + 1).cast("int").alias("rank"))

    @staticmethod
    def top(cells: DataFrame, most: int = TOP_LEMMAS) -> DataFrame:
        """The leading lemmas of each cell."""
        return cells.where(F.col("rank") <= most)

    def lemmas(self) -> DataFrame:
        return self._cells(0, ["lang"])

    def lemmas_by_code(self) -> DataFrame:
        return self._cells(1, ["lang", "label"])

    def lemmas_by_code_group(self) -> DataFrame:
        return self._cells(2, ["lang", "label", "grp"])

    @cached_property
    def firings(self) -> DataFrame:
        """lang, label, grp, expression, firings, over_groups: of codes, and of codes in groups, as grouping sets of one pass."""
        docs = self.documents.where(F.col("lang").isin(T.LANGUAGES)).select("doc_id", "lang", "grp")
        rows = self.codings.select("doc_id", "label", "matched_expressions").join(docs, "doc_id").select("lang", "grp", "label", F.explode("matched_expressions").alias("expression"))
        per = rows.groupBy("lang", "label", "grp", "expression").agg(F.count("*").alias("n"))
        columns = ["lang", "label", "expression", "grp"]
        sets = per.groupingSets([[F.col(c) for c in columns], [F.col(c) for c in columns[:3]]], *columns)
        return written(sets.agg(F.sum("n").alias("firings"), F.grouping("grp").alias("over_groups")), "firings")

    def expressions(self) -> DataFrame:
        return self.firings.where("over_groups = 1").select("lang", "label", "expression", "firings")

    def expressions_by_code_group(self) -> DataFrame:
        return self.firings.where("over_groups = 0").select("lang", "label", "grp", "expression", "firings")

    def top_extracts(self, by_group: bool = False, k: int = TOP_EXTRACTS) -> DataFrame:
        keys = ["label", "grp"] if by_group else ["label"]
        rows = self.codings.join(self.documents.select("doc_id", "grp"), "doc_id").withColumn("score", F.coalesce("score", F.lit(0)))
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id", "position")
        best = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        # The text is joined after the cut, so that only the winners' texts move.
        text = self.segments.select("doc_id", "position", "text")
        return best.select(*keys, "rank", "score", "doc_id", "position").join(text, ["doc_id", "position"])

    def segments_export(self) -> DataFrame:
        per = self.codings.groupBy("doc_id", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code_id", "label"))), lambda x: x["label"]), "; ").alias("codes"))
        return self.segments.join(per, ["doc_id", "position"], "left").withColumn("codes", F.coalesce("codes", F.lit("")))

    def blocks(self) -> dict[str, DataFrame]:
        return {
            "meta": self.meta(), "codes": self.codes(), "groups": self.groups(), "cooccurrence": self.cooccurrence(), "documents": self.coverage(), "lemmas": self.lemmas(),
            "lemmas_by_code": self.lemmas_by_code(), "lemmas_by_code_group": self.lemmas_by_code_group(), "expressions": self.expressions(),
            "expressions_by_code_group": self.expressions_by_code_group(), "top_extracts": self.top_extracts(), "top_extracts_by_group": self.top_extracts(True),
        }


SCHEMA_VERSION = 2
BLOCKS = ["meta", "codes", "groups", "cooccurrence", "documents", "lemmas", "lemmas_by_code", "lemmas_by_code_group", "expressions", "expressions_by_code_group", "top_extracts", "top_extracts_by_group"]


def read_cube(spark, run_id: int, root: str) -> dict[str, DataFrame] | None:
    """The blocks that write_cube has written under the present version of the schema; null if there are none, and the cube is to be made anew."""
    home = f"{root}/run_id={run_id}/schema={SCHEMA_VERSION}"
    if not exists(spark, f"{home}/_complete"):
        return None
    return {k: spark.read.parquet(f"{home}/{k}") for k in BLOCKS}


def write_cube(analysis: Analysis, run_id: int, root: str) -> None:
    """A table for each block, under the run and the version of the schema."""
    for name, df in analysis.blocks().items():
        df.write.mode("overwrite").parquet(f"{root}/run_id={run_id}/schema={SCHEMA_VERSION}/{name}")
    home = f"{root}/run_id={run_id}/schema={SCHEMA_VERSION}"
    analysis.segments.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{home}/_complete")
