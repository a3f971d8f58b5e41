"""Table functions for SQL: a transcript's turns, a document at a time.

    select t.* from transcript_turns(table(documents) partition by doc_id, regex => '...')

A partition's rows are one document's text; the function holds that text and no other.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loomcode.operators.conventions import Pattern

_SPACE = re.compile(r"\s+")


def turns_of(text: str | None, pattern: re.Pattern, at: tuple[int, int | None, int]) -> list[tuple]:
    """(position, speaker, ts, text, front) of a transcript, where at has the groups of speaker, time and text: as segment.utterances() has them."""
    rows: list[list] = []
    speaker = None
    for line in (x.strip() for x in (text or "").split("\n")):
        if not line:
            continue
        found = pattern.match(line)
        name = re.sub(r"^[.:]+|[.:]+$", "", _SPACE.sub("", found[at[0]] or "")).upper() if found else ""
        if name:
            speaker = name
            rows.append([True, speaker, (found[at[1]] or None) if at[1] else None, (found[at[2]] or "").strip()])
        else:
            rows.append([False, speaker, None, line])
    out, given = [], None
    for i, (turn, who, ts, said) in enumerate(rows):
        if given is not None:
            ts, given = given[0], None
        elif turn and not said and i + 1 < len(rows) and rows[i + 1][1] == who:
            given = (ts,)  # a turn without text gives its time to its speaker's next line
        front = who is None
        if said or front:
            out.append((len(out), who, ts, said, front))
    return out


class TranscriptTurns:
    """doc_id, position, speaker, ts, text, front; the table has doc_id and text. A document in several rows is read in their order."""

    @staticmethod
    def analyze(documents: AnalyzeArgument, regex: AnalyzeArgument) -> AnalyzeResult:
        if not regex.isConstantExpression or not regex.value:
            raise ValueError("regex is a constant")
        Pattern(regex.value)
        own = StructType().add("doc_id", documents.dataType["doc_id"].dataType).add("position", IntegerType())
        for name in ("speaker", "ts", "text"):
            own = own.add(name, StringType())
        return AnalyzeResult(own.add("front", BooleanType()))

    def __init__(self):
        self.id, self.parts, self.regex = None, [], None

    def eval(self, row, regex: str):
        self.id, self.regex = row["doc_id"], regex
        self.parts.append(row["text"] or "")

    def terminate(self):
        if self.regex is None:
            return
        p = Pattern(self.regex)
        for r in turns_of("\n".join(self.parts), re.compile(self.regex), (p.group("speaker"), p.group("ts"), p.group("text"))):
            yield self.id, *r


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("transcript_turns", udtf(TranscriptTurns))
