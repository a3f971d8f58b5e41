"""Units of documents: the one operator that turns a workspace's documents and a run's settings into units.

A document is a workbook column (source_type excel, with cells) or a transcript (text). A transcript is read by speakers if the unit is
a turn, or if it has a convention and the unit is a sentence or a paragraph; a turn's lines, front matter, accepted speakers and roles
are then as in segment.py.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcode.functions import text as T
from loomcode.operators import conventions, segment

UNITS = ["document", "utterance_regex", "paragraph", "sentence", "cell"]
CONTEXT = "array<struct<speaker:string,text:string>>"


@dataclass(frozen=True)
class Workspace:
    """The settings that units depend on: the unit of old runs, the language and the pattern of documents without their own."""

    mode: str = "paragraph"
    language: str | None = None
    regex: str = conventions.POSITIONAL
    library: dict[str, str] = field(default_factory=dict)
    excluded_roles: tuple[str, ...] = ()


def resolved_unit(unit, source_type, mode) -> Column:
    """The unit of a run, where old runs say per_row or per_utterance; a workbook knows cells and sentences only."""
    excel = source_type == "excel"
    return (
        F.when(excel & unit.isin("cell", "sentence"), unit)
        .when(excel | (unit == "per_utterance"), mode)
        .when(unit == "per_row", "document")
        .otherwise(unit)
    )


class _Chosen:
    """The pattern that a row's column names, one of a few; `other` where it names none."""

    def __init__(self, patterns: dict[str, conventions.Pattern], other: conventions.Pattern, name: Column):
        self.patterns, self.other, self.name = patterns, other, name

    def columns(self, line: Column):
        given = [self.other.columns(line)] + [p.columns(line) for p in self.patterns.values()]
        chosen = list(given[0])
        for key, columns in zip(self.patterns, given[1:], strict=True):
            chosen = [F.when(F.coalesce(self.name == key, F.lit(False)), c).otherwise(o) for c, o in zip(columns, chosen, strict=True)]
        return tuple(chosen)


def units_for(docs: DataFrame, unit: str, workspace: Workspace, cells: DataFrame | None = None, context: int = 0) -> tuple[DataFrame, DataFrame]:
    """(units, documents that fail). docs: doc_id, text, source_type, lang, convention, roles (map); cells: doc_id, row_no, text.

    Units: doc_id, position, text, speaker, ts, row_no, excluded, context. Failed: doc_id, reason: a document without units, or with
    sentences to cut and no language.
    """
    if unit not in [*UNITS, "per_row", "per_utterance"]:
        raise ValueError(f"unknown unit: {unit}")
    docs = docs.withColumn("unit", resolved_unit(F.lit(unit), F.col("source_type"), F.lit(workspace.mode))).withColumn("lang", F.coalesce("lang", F.lit(workspace.language)))
    mute = (F.col("unit") == "sentence") & F.col("lang").isNull()
    able = docs.where(~mute)
    known = dict(conventions.candidates(workspace.library))
    has = F.coalesce(F.col("convention").isin(list(known)), F.lit(False))
    turns = (F.col("unit") == "utterance_regex") | (has & F.col("unit").isin("sentence", "paragraph"))
    texts = able.where("source_type <> 'excel'")

    rows = [_by_speaker(texts.where(turns), known, workspace), _plain(texts.where(~turns))]
    if cells is not None:
        rows.append(_cells(able.where("source_type = 'excel'"), cells))
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    if context:
        # Excel answers and whole documents have a context of their own, or none.
        framed = segment.with_context(found.where("row_no is null and unit <> 'document'").drop("context"), context)
        found = framed.unionByName(found.where("row_no is not null or unit = 'document'"))
    else:
        found = found.withColumn("context", F.when(F.col("row_no").isNotNull(), F.col("context")))
    found = found.drop("unit")
    reason = F.when(mute, "no language").otherwise("no units")
    failed = docs.select("doc_id", reason.alias("reason"), mute.alias("mute")).join(found.select("doc_id").distinct().withColumn("some", F.lit(True)), "doc_id", "left")
    return found, failed.where("mute or some is null").select("doc_id", "reason")


def _shaped(rows: DataFrame, **own: Column) -> DataFrame:
    """The columns of a unit, null where rows has none."""
    kinds = {"speaker": "string", "ts": "string", "row_no": "int", "context": CONTEXT}
    missing = {k: F.lit(None).cast(t) for k, t in kinds.items() if k not in rows.columns}
    return rows.withColumns(missing | own).select("doc_id", F.col("position").cast("int").alias("position"), "text", "speaker", "ts", "row_no", "excluded", "context", "unit")


def _by_speaker(docs: DataFrame, known: dict[str, conventions.Pattern], workspace: Workspace) -> DataFrame:
    pattern = _Chosen(known, conventions.Pattern(workspace.regex), F.col("convention"))
    no_roles = F.create_map().cast("map<string,string>")
    heads = docs.select("doc_id", "unit", F.coalesce("roles", no_roles).alias("roles"))
    speakers = heads.select("doc_id", F.transform(F.map_keys("roles"), T.normalize_speaker).alias("accepted"))
    rows = segment.parsed_lines(segment.lines(docs, ("convention",)), pattern, speakers)
    said = segment.numbered(segment.merged_headers(segment.carried(rows)))
    marked = segment.with_exclusion(said.where("text <> ''"), heads.select("doc_id", "roles"), list(workspace.excluded_roles)).join(heads.select("doc_id", "unit"), "doc_id")
    whole = F.col("excluded") | (F.col("unit") != "sentence")
    parts = F.when(whole, F.array("text")).otherwise(T.line_sentences(F.col("text")))
    cut = marked.select("doc_id", "position", "speaker", "ts", "excluded", "unit", F.posexplode(parts).alias("part", "text"))
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "part")) - 1
    return _shaped(cut.withColumn("position", position))


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    parts = F.when(F.col("unit") == "document", F.array(T.strip(text))).when(F.col("unit") == "sentence", T.line_sentences(text)).otherwise(T.paragraphs(text))
    return _shaped(docs.select("doc_id", "unit", F.posexplode(parts).alias("position", "text")), excluded=F.lit(False))


def _cells(docs: DataFrame, cells: DataFrame) -> DataFrame:
    rows = cells.withColumn("text", T.strip("text")).where("text <> ''").join(docs.select("doc_id", "unit"), "doc_id")
    parts = F.when(F.col("unit") == "sentence", T.line_sentences(F.col("text"))).otherwise(F.array("text"))
    cell = F.array(F.struct(F.lit("").alias("speaker"), F.col("text").alias("text"))).cast(CONTEXT)
    rows = rows.select("doc_id", F.col("row_no").cast("int").alias("row_no"), "unit", parts.alias("parts"), F.when((F.col("unit") == "sentence") & (F.size(parts) > 1), cell).alias("context"))
    rows = rows.select("doc_id", "row_no", "unit", "context", F.posexplode("parts").alias("part", "text"))
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no", "part")) - 1
    return _shaped(rows.withColumn("position", position), excluded=F.lit(False))


def previews(texts: DataFrame, unit: str, most: int = 12) -> DataFrame:
    """The first units of each text (doc_id, text, lang): doc_id, position, text. A cell is shown by paragraphs."""
    mode = "paragraph" if unit == "cell" else unit
    rows = segment.utterances(texts, conventions.Pattern(conventions.POSITIONAL)) if mode == "utterance_regex" else segment.plain_units(texts, mode)
    return rows.where(F.col("position") < most)


def preview(text: str, unit: str, spark, lang: str | None = None, most: int = 12) -> DataFrame:
    """previews() of one pasted text, in order; sentences are English unless told otherwise."""
    return previews(spark.createDataFrame([(0, text, lang or "en")], "doc_id long, text string, lang string"), unit, most).orderBy("position")
