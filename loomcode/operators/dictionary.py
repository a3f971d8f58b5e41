"""The dictionary engine: expressions matched in the sentences of units.

A small index is grouped to one array for each language and joined by language, so that matching is a projection without a shuffle of texts, and
a unit's codings stand in its row. That array is held by each task. An index of more than SMALL_INDEX expressions is joined by the
rarest lemma of each expression, of the lemmas that sentences have: only sentences with that lemma meet it, and are looked at whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.functions import text as T
from loomcode.store import written

SMALL_INDEX = 500
#: An index of so many expressions is broadcast by its key lemmas; a larger one is shuffled.
BROADCAST_INDEX = 100_000
_JOINT = "\u0001"
_ENTRY = pa.struct([("expr_id", pa.int64()), ("code_id", pa.int64()), ("expression", pa.string()), ("phrase", pa.bool_()), ("lemmas", pa.list_(pa.string()))])


def build_index(codes: DataFrame, expressions: DataFrame) -> DataFrame:
    """codes: code_id, label, is_deleted; expressions: expr_id, code_id, lang, expression.

    expr_id, code_id, lang, expression, phrase, lemmas: of active codes, in languages with a model, with a lemma at least.
    """
    active = codes.where(~F.coalesce("is_deleted", F.lit(False))).select("code_id")
    rows = expressions.join(active, "code_id", "left_semi").where(F.col("lang").isin(T.LANGUAGES))
    rows = rows.withColumn("phrase", T.is_phrase("expression")).withColumn("lemmas", T.expression_lemmas(F.col("expression"), F.col("lang")))
    return rows.where(F.size("lemmas") > 0).select("expr_id", "code_id", "lang", "expression", "phrase", "lemmas")


def unit_sentences(units: DataFrame) -> DataFrame:
    """units: doc_id, position, text, lang. A row for each sentence, with its tokens and its content tokens."""
    rows = units.where(F.col("lang").isin(T.LANGUAGES)).select("doc_id", "position", "lang", F.posexplode(T.sentences(F.col("text"))).alias("sent", "sentence"))
    rows = rows.withColumn("seq", T.tokens(F.col("sentence"))).where(F.size("seq") > 0)
    return rows.withColumn("bag", T.content(F.col("seq"), F.col("lang")))


def _token(lemma: str) -> str:
    """A pattern of a lemma as a token of its own. What stands before it is looked at after it is found, which is seldom."""
    literal = "".join("\\" + c if c == "-" else c for c in lemma)  # a lemma has letters, digits, and _'-
    inside = T.TOKEN.removesuffix("+")
    return f"{literal}(?<!{inside}{literal})(?!{inside})"


def _by_language(index: DataFrame) -> tuple[DataFrame, dict[str, list[str]]] | None:
    """(lang, entries: an index of at most SMALL_INDEX expressions as an array for each language; the longest
    lemmas of each language's); None for a larger one."""
    held = index.limit(SMALL_INDEX + 1).collect()
    if len(held) > SMALL_INDEX:
        return None
    by_lang: dict[str, list] = {}
    for r in sorted(held, key=lambda r: r["expr_id"]):
        by_lang.setdefault(r["lang"], []).append({k.name: r[k.name] for k in _ENTRY})
    local = pa.table({"lang": pa.array(list(by_lang), pa.string()), "entries": pa.array(list(by_lang.values()), pa.list_(_ENTRY))})
    longest = {k: sorted({max(e["lemmas"], key=len) for e in entries}) for k, entries in by_lang.items()}
    return index.sparkSession.createDataFrame(local), longest


def _line(seq: Column) -> Column:
    """Tokens as one string, each between two joints."""
    return F.concat(F.lit(_JOINT), F.array_join(seq, _JOINT), F.lit(_JOINT))


def _holds(e: Column, line: Column, bag: Column) -> Column:
    """Whether a sentence has a phrase's lemmas consecutively, or all of a bag's."""
    return F.when(e["phrase"], F.contains(line, _line(e["lemmas"]))).otherwise(F.forall(e["lemmas"], lambda x: F.array_contains(bag, x)))


def _may_hold(text: Column, longest: dict[str, list[str]]) -> Column:
    """Whether a text has, as a token, the longest lemma of one of its language's entries; it has all of them where one hits."""

    def any_of(lemmas: list[str]) -> Callable[[Column], Column]:
        # Most texts do not have a lemma as a substring either, which is looked at first.
        return lambda low: reduce(or_, (F.contains(low, F.lit(x)) & F.rlike(low, F.lit(_token(x))) for x in lemmas))

    out = F.lit(False)
    for lang, lemmas in longest.items():
        # In an array, so that a text is lowered once and not for each lemma.
        out = F.when(F.col("lang") == lang, F.exists(F.array(F.lower(text)), any_of(lemmas))).otherwise(out)
    return out


def match_sentences(units: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, position, sent, sentence, code_id, expr_id, expression: a row for each hit of an expression in a sentence."""
    small = _by_language(index)
    if small is None:
        return _match_inverted(unit_sentences(units), index)
    entries, longest = small
    rows = unit_sentences(units.where(_may_hold(F.col("text"), longest)))
    rows = rows.withColumn("line", _line(F.col("seq"))).join(F.broadcast(entries), "lang")  # at most SMALL_INDEX expressions
    rows = rows.select("doc_id", "position", "sent", "sentence", F.explode(F.filter("entries", lambda e: _holds(e, F.col("line"), F.col("bag")))).alias("e"))
    return rows.select("doc_id", "position", "sent", "sentence", "e.code_id", "e.expr_id", "e.expression")


def key_lemmas(rows: DataFrame, index: DataFrame) -> DataFrame:
    """index with key: the lemma of an expression that the fewest sentences have. An expression with a lemma that no sentence has goes.

    rows: sentences as unit_sentences() gives. Stop words count too, as a phrase may have no others.
    """
    wanted = index.select("expr_id", "lang", F.explode(F.array_distinct("lemmas")).alias("lemma"))
    # Lemmas that no expression has go before they are counted: they are nearly all of a corpus's.
    asked = wanted.select("lang", "lemma").distinct()
    seen = rows.select("lang", F.explode(F.array_distinct("seq")).alias("lemma")).join(asked, ["lang", "lemma"], "left_semi").groupBy("lang", "lemma").agg(F.count("*").alias("n"))
    found = wanted.join(seen, ["lang", "lemma"], "left").groupBy("expr_id").agg(F.min(F.struct("n", "lemma")).alias("k"), F.count_if(F.col("n").isNull()).alias("missing"))
    return index.join(found.where("missing = 0").select("expr_id", F.col("k.lemma").alias("key")), "expr_id")


def _match_inverted(rows: DataFrame, index: DataFrame, broadcast: int = BROADCAST_INDEX) -> DataFrame:
    """Sentences meet an expression at its key lemma, and are verified there. A sentence's other lemmas are not posted."""
    keyed = written(key_lemmas(rows, index).select("lang", F.col("key").alias("lemma"), "expr_id", "code_id", "expression", "phrase", "lemmas"), "keyed")
    small = keyed.limit(broadcast + 1).count() <= broadcast
    keys = keyed.groupBy("lang", "lemma").agg(F.count("*").alias("n")).drop("n")
    posted = rows.select("doc_id", "position", "sent", "sentence", "lang", "seq", F.explode(F.array_distinct("seq")).alias("lemma"))
    if small:
        met = posted.join(F.broadcast(keyed), ["lang", "lemma"])
    else:
        # A key has at most its expressions; a key that many sentences have is split by Spark's skew join.
        met = posted.join(keys, ["lang", "lemma"], "left_semi").join(keyed, ["lang", "lemma"])
    # A line is made of what has met alone; a bag's lemmas have no stop words, so that they are in a sentence's tokens if they are in its content.
    entry = F.struct("phrase", "lemmas")
    return met.where(_holds(entry, _line(F.col("seq")), F.col("seq"))).select("doc_id", "position", "sent", "sentence", "code_id", "expr_id", "expression")


def coded_units(units: DataFrame, index: DataFrame) -> DataFrame | None:
    """units with codings: an array of struct(code_id, score, matched_expressions, sentences, rationale), by code_id; empty without a hit, and in
    excluded units. Nothing is shuffled. None for an index of more than SMALL_INDEX expressions."""
    small = _by_language(index)
    if small is None:
        return None
    entries, longest = small
    open_ = ~F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in units.columns else F.lit(True)
    rows = units.join(F.broadcast(entries), "lang", "left")
    # Tokens are cut of sentences that may hit alone, and sentences of units that may.
    cut = F.transform(T.sentences(F.col("text")), lambda s, i: F.struct(i.alias("sent"), s.alias("sentence")))
    rows = rows.withColumn("__s", F.when(open_ & F.col("entries").isNotNull() & _may_hold(F.col("text"), longest), F.filter(cut, lambda x: _may_hold(x["sentence"], longest))))
    look = lambda x: F.struct(x["sent"].alias("sent"), x["sentence"].alias("sentence"), T.tokens(x["sentence"]).alias("seq"))
    # An expression's bag has no stop words of its language, so that it is in a sentence's tokens if it is in its content.
    lined = lambda x: F.struct(x["sent"].alias("sent"), x["sentence"].alias("sentence"), _line(x["seq"]).alias("line"), x["seq"].alias("bag"))
    rows = rows.withColumn("__s", F.transform(F.transform("__s", look), lined))
    hit = lambda x: F.transform(
        F.filter("entries", lambda e: _holds(e, x["line"], x["bag"])),
        lambda e: F.struct(x["sent"].alias("sent"), e["expr_id"].alias("expr_id"), e["code_id"].alias("code_id"), e["expression"].alias("expression"), x["sentence"].alias("sentence")),
    )
    rows = rows.withColumn("__h", F.sort_array(F.flatten(F.transform("__s", hit))))

    def coding(c: Column) -> Column:
        own = F.filter("__h", lambda h: h["code_id"] == c)
        return F.struct(
            c.alias("code_id"), F.size(own).cast("long").alias("score"), F.array_distinct(F.transform(own, lambda h: h["expression"])).alias("matched_expressions"),
            F.array_distinct(F.transform(own, lambda h: h["sentence"])).alias("sentences"),
        )

    found = F.transform(F.sort_array(F.array_distinct(F.transform("__h", lambda h: h["code_id"]))), coding)
    rows = rows.withColumn("__c", F.coalesce(found, F.array().cast("array<struct<code_id:bigint,score:bigint,matched_expressions:array<string>,sentences:array<string>>>")))
    rows = rows.withColumn("codings", F.transform("__c", lambda c: c.withField("rationale", rationale(c["matched_expressions"], c["sentences"]))))
    return rows.select(*units.columns, "codings")


def first_seen(pairs) -> F.Column:
    """The distinct values of an array of struct(order, value), in the order in which they are first seen."""
    ordered = F.transform(F.sort_array(pairs), lambda p: p["v"])
    return F.array_distinct(ordered)


def rationale(expressions: Column, sentences: Column) -> Column:
    """The fired expressions and the first sentence; a fixed form, as stored rationales are compared."""
    return F.concat(F.lit("Matched expressions: "), F.array_join(expressions, ", "), F.lit(' — in: "'), F.element_at(sentences, 1), F.lit('"'))


def codings(matches: DataFrame) -> DataFrame:
    """doc_id, position, code_id, score, matched_expressions, sentences, rationale: a row for each code of a unit."""
    out = matches.groupBy("doc_id", "position", "code_id").agg(
        F.count("*").alias("score"),
        first_seen(F.collect_list(F.struct("sent", "expr_id", F.col("expression").alias("v")))).alias("matched_expressions"),
        first_seen(F.collect_list(F.struct("sent", F.lit(0).alias("z"), F.col("sentence").alias("v")))).alias("sentences"),
    )
    return out.withColumn("rationale", rationale(F.col("matched_expressions"), F.col("sentences")))
