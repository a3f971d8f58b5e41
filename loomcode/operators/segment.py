"""Documents to units: paragraphs, sentences, documents, cells, speaker turns; contexts and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcode.functions import text as T

MODES = ["document", "utterance", "paragraph", "sentence", "cell"]


def plain_units(docs: DataFrame, mode: str, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """docs: doc_id, text and the columns to keep. doc_id, position (from 0), text: units without speakers."""
    if mode not in MODES or mode == "utterance":
        raise ValueError(f"unknown unit: {mode}")
    kept = [F.col(c) for c in keep]
    if mode in ("document", "cell"):
        return docs.select("doc_id", *kept, F.lit(0).alias("position"), T.strip("text").alias("text")).where("text <> ''")
    split = T.paragraphs if mode == "paragraph" else T.line_sentences
    return docs.select("doc_id", *kept, F.posexplode(split(F.col("text"))).alias("position", "text"))


def lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, line_no, line, and the columns to keep: the lines that are not blank."""
    return docs.select("doc_id", *keep, F.posexplode(T.paragraphs(F.col("text"))).alias("line_no", "line"))


def parsed_lines(rows: DataFrame, pattern, speakers: DataFrame | None = None) -> DataFrame:
    """rows: doc_id, line_no, line. Adds turn, speaker, ts, body. speakers (doc_id, accepted): a line of another speaker continues."""
    speaker, ts, body, ok = pattern.columns(F.col("line"))
    rows = rows.select("*", ok.alias("turn"), T.normalize_speaker(speaker).alias("speaker"), ts.alias("ts"), body.alias("body"))
    if speakers is not None:
        rows = rows.join(speakers, "doc_id", "left").withColumn(
            "turn", F.col("turn") & ((F.coalesce(F.size("accepted"), F.lit(0)) == 0) | F.array_contains("accepted", F.col("speaker")))
        ).drop("accepted")
    rows = rows.withColumn("turn", F.col("turn") & (F.col("speaker") != ""))
    return rows.select(
        "doc_id",
        "line_no",
        "line",
        "turn",
        F.when(F.col("turn"), F.col("speaker")).alias("speaker"),
        F.when(F.col("turn"), F.col("ts")).alias("ts"),
        F.when(F.col("turn"), T.strip("body")).otherwise(F.col("line")).alias("body"),
    )


def carried(rows: DataFrame) -> DataFrame:
    """Continuation lines take the last turn's speaker; lines before the first turn are front matter."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("front", ~F.max("turn").over(so_far)).withColumn("speaker", F.last("speaker", ignorenulls=True).over(so_far))


def merged_headers(rows: DataFrame) -> DataFrame:
    """A turn without text gives its time to the next line of its speaker; pairs are taken from the left, and lines without text go.

    link: such a turn, and the next line fits. In a chain of links, a line at an odd distance from the chain's start
    takes the time of the line before it.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    link = F.col("turn") & ~F.col("front") & (F.col("body") == "") & (F.lead("speaker").over(w) == F.col("speaker")) & ~F.lead("front").over(w)
    rows = rows.withColumn("link", F.coalesce(link, F.lit(False))).withColumn("linked", F.coalesce(F.lag("link").over(w), F.lit(False)))
    rows = rows.withColumn("chain", F.sum((~F.col("linked")).cast("int")).over(w)).withColumn("before", F.lag("ts").over(w))
    level = F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("line_no")) - 1
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("ts", F.when(F.col("level") % 2 == 1, F.col("before")).otherwise(F.col("ts")))
    return rows.where("front or body <> ''").drop("link", "linked", "chain", "before", "level")


def utterances(docs: DataFrame, pattern, speakers: DataFrame | None = None) -> DataFrame:
    """doc_id, position, speaker, ts, text, front: a row for each turn line or continuation."""
    return numbered(merged_headers(carried(parsed_lines(lines(docs), pattern, speakers))))


def numbered(rows: DataFrame) -> DataFrame:
    """Lines as turns: doc_id, position, speaker, ts, text, front."""
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return rows.select("doc_id", position.alias("position"), "speaker", "ts", F.col("body").alias("text"), "front")


def with_exclusion(units: DataFrame, roles: DataFrame, excluded: list[str]) -> DataFrame:
    """roles: doc_id, roles (map speaker to role). Adds role and excluded; front matter is always excluded."""
    rows = units.join(roles, "doc_id", "left")
    role = F.when(F.col("speaker").isNotNull(), F.coalesce(F.try_element_at("roles", F.col("speaker")), F.lit("participant")))
    return rows.withColumn("role", role).withColumn("excluded", F.coalesce("front", F.lit(False)) | F.coalesce(F.col("role").isin(excluded or [""]), F.lit(False))).drop("roles")


def speaker_sentences(units: DataFrame) -> DataFrame:
    """Coded turns in sentences; excluded turns stay whole. Positions are numbered anew."""
    parts = F.when(F.col("excluded"), F.array("text")).otherwise(T.sentences(F.col("text")))
    others = [c for c in units.columns if c not in ("text", "position")]
    rows = units.select("position", *others, F.posexplode(parts).alias("part", "text"))
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "part")) - 1
    return rows.withColumn("position", position).drop("part")


def with_context(units: DataFrame, n: int) -> DataFrame:
    """Adds context: the n units before, excluded ones too; null for n = 0, empty for the first unit."""
    if n == 0:
        return units.withColumn("context", F.lit(None).cast("array<struct<speaker:string,text:string>>"))
    speaker = F.col("speaker") if "speaker" in units.columns else F.lit(None).cast("string")
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(-n, -1)
    return units.withColumn("context", F.collect_list(F.struct(speaker.alias("speaker"), F.col("text").alias("text"))).over(w))


#: Units that are looked up in one stretch of a document's text.
STRETCH = 64


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(full: Column, units: Column, absent, repeats: bool) -> Column:
    """An array of struct(s, e): the spans of the units' texts in full, in their order.

    A text is looked up from where the last one ended, or else from the start; absent(unit) gives the span of one that is nowhere, which leaves the
    place to look from. With repeats, a text that follows itself has the same span again. The fold goes over stretches of units: a stretch looks in what
    is left of the text from where it began, so that no look-up walks over all that is behind it, and spans are appended to short arrays.
    """
    none = F.lit(None).cast("int")
    no_span = F.struct(none.alias("s"), none.alias("e"))
    no_spans = F.array().cast("array<struct<s:int,e:int>>")

    def stretch(done: Column, i: Column) -> Column:
        base = done["at"]

        # What is left of the text is named outside of the fold: a state that holds it would be copied with it.
        def within(rest: Column) -> Column:
            def found(a: Column, text: Column) -> Column:
                # A text may be found before the stretch's beginning, and the place to look from is there then.
                near = _once(F.position(text, rest, a["at"] - base + 1), lambda x: F.when(x > 0, x + base).otherwise(0))
                ahead = F.when(a["at"] >= base, near).otherwise(F.position(text, full, a["at"] + 1))
                return F.when(F.length(text) == 0, a["at"]).otherwise(_once(ahead, lambda x: F.when(x > 0, x).otherwise(F.position(text, full))) - 1)

            def step(a: Column, u: Column) -> Column:
                again = F.coalesce(a["last"] == u["text"], F.lit(False)) if repeats else F.lit(False)

                def put(place: Column) -> Column:
                    end, missing = place + F.length(u["text"]), absent(u)
                    span = F.when(again, a["span"]).when(place >= 0, F.struct(place.alias("s"), end.alias("e"))).otherwise(F.struct(missing[0].alias("s"), missing[1].alias("e")))
                    at = F.when(again | (place < 0), a["at"]).otherwise(end)
                    return _once(span, lambda x: F.struct(at.alias("at"), u["text"].alias("last"), x.alias("span"), F.concat(a["spans"], F.array(x)).alias("spans")))

                return _once(F.when(again, F.lit(-1)).otherwise(found(a, u["text"])), put)

            start = F.struct(done["at"].alias("at"), done["last"].alias("last"), done["span"].alias("span"), no_spans.alias("spans"))
            return F.aggregate(F.slice(units, i * STRETCH + 1, STRETCH), start, step)

        ended = F.transform(F.array(F.substring(full, base + 1, F.length(full))), within)
        return F.aggregate(ended, done, lambda d, x: F.struct(x["at"].alias("at"), x["last"].alias("last"), x["span"].alias("span"), F.concat(d["spans"], x["spans"]).alias("spans")))

    empty = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("last"), no_span.alias("span"), no_spans.alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(units) - 1) / STRETCH).cast("int")), empty, stretch, lambda a: a["spans"])


def _listed(docs: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """doc_id, full, u: a row for each document that has rows, with all their other columns in order; a document's rows are one row meanwhile."""
    others = [c for c in rows.columns if c not in ("doc_id", order)]
    # Rows of the same number stand as they came.
    counted = rows.withColumn("__n", F.monotonically_increasing_id())
    listed = counted.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order, "__n", *others))).alias("u"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("full")).join(listed, "doc_id")


def _placed(listed: DataFrame, spans: Column, columns: list[str]) -> DataFrame:
    both = listed.select("doc_id", "u", spans.alias("spans")).select("doc_id", F.explode(F.arrays_zip("u", "spans")).alias("x"))
    own = [F.col(f"x.u.{c}").alias(c) for c in columns if c not in ("doc_id", "start_offset", "end_offset")]
    return both.select("doc_id", *own, F.col("x.spans.s").alias("start_offset"), F.col("x.spans.e").alias("end_offset"))


def anchored(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Adds start_offset and end_offset to the units (doc_id, position, text) of docs (doc_id, text): places in code points. A text that is
    nowhere gets the document's beginning, as long as it is itself."""
    listed = _listed(docs, units, "position")
    spans = _spans(F.col("full"), F.col("u"), lambda u: (F.lit(0), F.length(u["text"])), repeats=False)
    return _placed(listed, spans, units.columns)


def reanchored(docs: DataFrame, codings: DataFrame) -> DataFrame:
    """codings: doc_id, ord, text, start_offset, end_offset. Spans found anew, where a text that follows itself keeps its span, and a text
    that is nowhere keeps its stored offsets, or gets the whole document."""
    listed = _listed(docs, codings.select("doc_id", "ord", "text", "start_offset", "end_offset"), "ord")
    full = F.col("full")

    def stored(u: Column) -> tuple[Column, Column]:
        has = u["start_offset"].isNotNull()
        return F.when(has, u["start_offset"]).otherwise(0).cast("int"), F.when(has, u["end_offset"]).otherwise(F.length(full)).cast("int")

    return _placed(listed, _spans(full, F.col("u"), stored, repeats=True), ["doc_id", "ord", "text", "start_offset", "end_offset"])


def full_text_of_cells(cells: DataFrame) -> DataFrame:
    """cells: doc_id, row_no, text. doc_id, text: lines `[R<row>] text`."""
    lines_ = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda c: F.concat(F.lit("[R"), c["row_no"].cast("string"), F.lit("] "), c["text"]))
    return cells.groupBy("doc_id").agg(F.array_join(lines_, "\n").alias("text"))
