"""Transcript conventions: line patterns, scores, detection and roles."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcode.functions import text as T
from loomcode.operators.segment import lines

#: What a line of each known convention looks like, in the order in which they are tried. They decide which lines are turns, so
#: they are as transcription programs write lines and as users' stored documents name them.
PRESETS = {
    "default": r"^(?P<speaker>[^:\[\]]{1,24}?)\s*\[(?P<ts>\d{1,2}:\d{2}:\d{2})\]\s*:\s*(?P<text>.+)$",
    "f4": r"^(?P<speaker>[^\s:.\[\]]{1,24})\s*[:.]\s+(?P<text>.+?)\s*(?:#(?P<ts>\d{1,2}:\d{2}:\d{2})-\d+#)?\s*$",
    "plain": r"^(?P<speaker>[^\s:\[\]]{1,24})\s*:\s+(?P<text>.+)$",
    "ts_lead": r"^\[(?P<ts>\d{1,2}:\d{2}:\d{2})\]\s+(?P<speaker>[^\s:]{1,24})\s*:\s+(?P<text>.+)$",
    "happyscribe": r"^\[(?P<ts>\d{2}:\d{2}:\d{2})\.\d{3}\]\s*-\s*(?P<speaker>.+?)\s*(?P<text>)$",
}
#: Fixed value: the pattern of a workspace that has none of its own; groups in the order speaker, time, text.
POSITIONAL = r"^(.+?) \[(\d{2}:\d{2}:\d{2})\]: (.+)$"
LEAST_SCORE = 0.45
LINES = 400


@dataclass(frozen=True)
class Pattern:
    """A line pattern with named groups, or with groups in the order speaker, [time,] text."""

    regex: str

    def __post_init__(self):
        compiled = re.compile(self.regex)
        if not {"speaker", "text"} <= set(compiled.groupindex) and compiled.groups < 2:
            raise ValueError("a pattern needs a speaker and a text group")

    @property
    def java(self) -> str:
        own = self.regex.replace("(?P<", "(?<")
        own = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", own)
        return f"(?dU)^(?:{own})"

    def group(self, name: str) -> int | None:
        compiled = re.compile(self.regex)
        if compiled.groupindex:
            return compiled.groupindex.get(name)
        places = {"speaker": 1, "ts": 2 if compiled.groups >= 3 else None, "text": compiled.groups}
        return places[name]

    @property
    def timed(self) -> bool:
        return "(?P<ts>" in self.regex

    def columns(self, line: Column) -> tuple[Column, Column, Column, Column]:
        """(speaker, time or null, text, whether the line fits)."""
        get = lambda name: F.regexp_extract(line, self.java, self.group(name)) if self.group(name) else F.lit(None).cast("string")
        return get("speaker"), F.nullif(get("ts"), F.lit("")), get("text"), F.rlike(line, F.lit(self.java))


def checked(library: dict[str, str]) -> dict[str, str]:
    """A library whose names are its own and whose patterns are sound."""
    taken = sorted(set(library) & set(PRESETS))
    if taken:
        raise ValueError(f"names of presets: {', '.join(taken)}")
    for regex in library.values():
        Pattern(regex)
    return library


def with_convention(library: dict[str, str], name: str, regex: str) -> dict[str, str]:
    """The library with a convention of its own added or replaced; the pattern needs named groups."""
    name = name.strip()
    if not name:
        raise ValueError("a convention needs a name")
    groups = re.compile(regex).groupindex
    if not {"speaker", "text"} <= set(groups):
        raise ValueError("a pattern needs the groups speaker and text")
    return library | checked({name: regex})


def suggested(sample: list[str], coder, most_lines: int = 25, most_chars: int = 4000) -> str | None:
    """A pattern for a sample's lines from a model coder, or null if the answer is no sound pattern."""
    head = "\n".join([x for x in sample if x.strip()][:most_lines])[:most_chars]
    try:
        regex = str(coder(head, "")).strip().strip("`").strip()
        return next(iter(with_convention({}, "suggested", regex).values()))
    except (re.error, ValueError):
        return None


def samples(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, lines: the first n lines that are not blank."""
    return docs.select("doc_id", F.slice(T.paragraphs(F.col("text")), 1, n).alias("lines"))


def candidates(library: dict[str, str] | None = None) -> list[tuple[str, Pattern]]:
    """Presets, then the library's own."""
    own = [(k, Pattern(v)) for k, v in checked(library or {}).items()]
    return [(k, Pattern(v)) for k, v in PRESETS.items()] + own


def stamps(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """rows: the keys, line_no, sec (null without a time). keys, n_ts, n_ordered (times not before the last one), and more aggregates."""
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last("sec", ignorenulls=True).over(before))
    return rows.groupBy(*keys).agg(*more, F.count("sec").alias("n_ts"), F.count_if(F.col("sec") >= F.col("last")).alias("n_ordered"))


def monotonic(n: Column, n_ordered: Column) -> Column:
    """At least three times, of which nine in ten are not before the last one."""
    return (n >= 3) & (n_ordered >= 0.9 * (n - 1))


def scores(docs: DataFrame, tried: list[tuple[str, Pattern]], most_lines: int = LINES) -> DataFrame:
    """doc_id, ord, name, n_lines, turn_lines, recurring, recurring_turns, n_ts, n_ordered, score: a row for each document and candidate."""
    head = lines(docs).where(F.col("line_no") < most_lines)
    fits = []
    for i, (name, pattern) in enumerate(tried):
        speaker, ts, _, ok = pattern.columns(F.col("line"))
        who = T.normalize_speaker(speaker)
        fits.append(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), F.lit(pattern.timed).alias("timed"), F.when(ok & (who != ""), who).alias("speaker"), F.when(ok & (who != ""), ts).alias("ts")))
    rows = head.select("doc_id", "line_no", F.explode(F.array(*fits)).alias("x")).select("doc_id", "line_no", "x.*")
    keys = ["doc_id", "ord", "name", "timed"]
    line_stats = stamps(rows.withColumn("sec", T.seconds(F.col("ts"))), keys, F.count("*").alias("n_lines"), F.count("speaker").alias("turn_lines"))
    turns = rows.where("speaker is not null").groupBy("doc_id", "ord", "speaker").agg(F.count("*").alias("n"))
    who = turns.where("n >= 2").groupBy("doc_id", "ord").agg(F.count("*").alias("recurring"), F.sum("n").alias("recurring_turns"), F.array_sort(F.collect_list("speaker")).alias("speakers"))
    out = line_stats.join(who, ["doc_id", "ord"], "left").where("turn_lines > 0").fillna(0, ["recurring", "recurring_turns"])
    rec_ok = F.col("recurring").between(2, 12) & (F.col("recurring_turns") >= 0.8 * F.col("turn_lines"))
    ts_ok = monotonic(F.col("n_ts"), F.col("n_ordered"))
    score = 0.6 * F.col("turn_lines") / F.col("n_lines") + F.when(rec_ok, 0.25).otherwise(0.0) + F.when(ts_ok, 0.15).otherwise(0.0) + F.when(F.col("timed"), 0.03).otherwise(0.0)
    return out.withColumn("score", T.rounded(score, 3)).drop("timed")


def detect(docs: DataFrame, tried: list[tuple[str, Pattern]]) -> DataFrame:
    """doc_id, name, score, speakers, roles: the best candidate of each document that reaches LEAST_SCORE; the first wins ties."""
    best = scores(docs, tried).groupBy("doc_id").agg(F.max_by(F.struct("name", "score", "speakers"), F.struct("score", -F.col("ord"))).alias("b"))
    out = best.select("doc_id", "b.*").where(F.col("score") >= LEAST_SCORE)
    speakers = F.coalesce("speakers", F.array().cast("array<string>"))
    return out.withColumn("speakers", speakers).withColumn("roles", F.map_from_arrays("speakers", F.transform("speakers", T.default_role)))


def candidate_table(spark: SparkSession, library: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame([(i, k, p.regex) for i, (k, p) in enumerate(candidates(library))], "ord int, name string, regex string")
