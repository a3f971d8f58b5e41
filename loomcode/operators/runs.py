"""Runs: units and codings as facts, statuses, model coders, retries and costs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.operators import dictionary
from loomcode.operators.facts import RateLimited, SingleFlight, context_lines, execute, executed, format_codebook, read_facts, study_context, system_block  # noqa: F401

#: US dollars for a million tokens in and out, where a model has no price of its own.
DEFAULT_PRICE = (3.0, 15.0)
ENTRIES = "array<struct<action:string,code:string,description:string,example:string,rationale:string>>"


def dictionary_codings(units: DataFrame, codes: DataFrame, expressions: DataFrame) -> DataFrame:
    """Codings of the units that are not excluded."""
    open_ = units.where("not excluded") if "excluded" in units.columns else units
    return dictionary.codings(dictionary.match_sentences(open_, dictionary.build_index(codes, expressions)))


def segments(units: DataFrame, codings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """units with n_codings and status: excluded, error, coded or no_code. failed: doc_id, position of units without an answer."""
    n = codings.groupBy("doc_id", "position").agg(F.count("*").alias("n_codings"))
    rows = units.join(n, ["doc_id", "position"], "left").fillna(0, ["n_codings"])
    excluded = F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in units.columns else F.lit(False)
    bad = F.lit(False)
    if failed is not None:
        rows = rows.join(failed.select("doc_id", "position", F.lit(True).alias("failed")), ["doc_id", "position"], "left")
        bad = F.coalesce("failed", F.lit(False))
    status = F.when(excluded, "excluded").when(bad, "error").when(F.col("n_codings") > 0, "coded").otherwise("no_code")
    return rows.withColumn("status", status).drop("failed")


def parsed_answer(answer: Column) -> Column:
    """The entries of a coder's answer: a JSON array, bare or in a fenced block; null if it is anything else."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(answer))
    return F.when(F.substring(body, 1, 1) == "[", F.from_json(body, ENTRIES))


format_context = context_lines


def model_answers(units: DataFrame, coder: Callable[[str, str], str], retries: int = 5, pause: float = 1.0, wait_for: tuple = (RateLimited, TimeoutError, ConnectionError)) -> DataFrame:
    """units: doc_id, position, text, context. doc_id, position, answer (null after all retries), tokens_in, tokens_out.

    coder takes (text, context lines) and returns the answer, or the answer and the tokens it has read (those of a cached prompt too) and
    written; it runs on the executors, a call for each unit. After the k-th error of the kinds to wait for, it is asked again in
    2**k pauses (seconds).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            out = []
            for d, p, text, context in zip(b["doc_id"], b["position"], b["text"], b["lines"], strict=True):
                answer = None
                for k in range(retries):
                    try:
                        answer = coder(text, context)
                        break
                    except tuple(wait_for):
                        if k < retries - 1:
                            time.sleep(2**k * pause)
                    except Exception:  # any other error is an empty answer
                        break
                if isinstance(answer, tuple):
                    answer, read, wrote = answer
                else:
                    read, wrote = (len(text) + len(context or "")) // 4, len(answer or "") // 4
                out.append((d, p, answer, read, wrote))
            yield pd.DataFrame(out, columns=["doc_id", "position", "answer", "tokens_in", "tokens_out"])

    rows = units.select("doc_id", "position", "text", F.coalesce(context_lines(F.col("context")), F.lit("")).alias("lines"))
    return rows.mapInPandas(run, "doc_id long, position int, answer string, tokens_in long, tokens_out long")


def model_entries(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries that name a code, units that failed, units with rationales for no code joined by " | ")."""
    rows = answers.withColumn("entries", parsed_answer(F.col("answer")))
    failed = rows.where("entries is null").select("doc_id", "position")
    each = rows.where("entries is not null").select("doc_id", "position", F.posexplode("entries").alias("entry", "e"))
    spoken = lambda c: F.trim(F.coalesce(c, F.lit("")))
    # An entry without an action names a code if it has one.
    is_none = lambda e: F.coalesce(e["action"] == "no_code", F.lit(False))
    named = each.where(~is_none(F.col("e")) & (spoken(F.col("e.code")) != "")).select("doc_id", "position", "entry", spoken(F.col("e.code")).alias("label"), "e.description", "e.example", "e.rationale")
    why = F.array_join(F.filter(F.transform(F.filter("entries", is_none), lambda e: spoken(e["rationale"])), lambda r: r != ""), " | ")
    none = rows.where("entries is not null").select("doc_id", "position", F.nullif(why, F.lit("")).alias("no_code_rationale"))
    return named, failed, none


#: What names a unit in facts whose positions are not kept: offsets are null for whole documents.
UNIT_KEY = ["doc_id", "start_offset", "end_offset", "segment_text"]


def with_codings(segments_: DataFrame, codings: DataFrame, value) -> DataFrame:
    """segments with codings: an ordered list of struct(code_id, value) of the same unit key, nulls being equal; empty without any."""
    per = codings.groupBy(*UNIT_KEY).agg(F.array_sort(F.collect_list(F.struct("code_id", value.alias("value")))).alias("codings"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in UNIT_KEY]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = segments_.alias("s").join(per.alias("c"), on, "left")
    return out.select("s.*", F.coalesce("c.codings", F.array().cast(per.schema["codings"].dataType)).alias("codings"))


def costs(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """tokens: run_id, model, tokens_in, tokens_out; prices: model, price_in, price_out a million. Adds cost, with the default price for others."""
    rows = tokens.join(prices, "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(DEFAULT_PRICE[0])) + F.col("tokens_out") * F.coalesce("price_out", F.lit(DEFAULT_PRICE[1]))) / 1e6
    return rows.withColumn("cost", cost)


def estimated_seconds(engine, n_units, workers) -> Column:
    """The seconds that a run of so many units takes, about: by the dictionary 8 and 0.012 for each; by a model 4 for each call, `workers` at a time. 0 without units."""
    each = F.floor(F.lit(8.0) + n_units * F.lit(0.012))
    return F.when(n_units <= 0, 0).when(engine == "dictionary", each).otherwise(F.ceil(n_units / F.greatest(workers, F.lit(1))) * 4).cast("long")


def estimate_seconds(engine: str, n_units: int, workers: int) -> int:
    if n_units <= 0:
        return 0
    return int(8 + 0.012 * n_units) if engine == "dictionary" else -(-n_units // max(workers, 1)) * 4


def estimate_run(docs: DataFrame, units: DataFrame, system: str, price: tuple[float, float] = DEFAULT_PRICE, sample: int = 8, prompt: int = 50, output: int = 150) -> DataFrame:
    """segments, input_tokens, output_tokens, cost_usd of a model run, from the units of the first `sample` documents, scaled to all.

    docs: doc_id; units: doc_id, text, and excluded and context where there are any. The system block counts once in full, and by a tenth for each further call, as
    it is cached then; documents without units do not count; excluded units are not sent. Zeros where nothing is to be sent.
    """
    first = docs.select("doc_id").orderBy("doc_id").limit(sample)
    own = units.join(F.broadcast(first), "doc_id", "left_semi")  # `sample` rows
    sent = ~F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in units.columns else F.lit(True)
    context = F.floor(F.aggregate("context", F.lit(0), lambda acc, u: acc + F.length(u["text"])) / 4) if "context" in units.columns else F.lit(0)
    s = own.agg(
        F.countDistinct("doc_id").alias("counted"), F.count_if(sent).alias("u"),
        F.sum(F.when(sent, F.expr("length(text) div 4"))).alias("t"), F.sum(F.when(sent, F.coalesce(context, F.lit(0)))).alias("c"),
    )
    s = s.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row
    whole = lambda x: F.bround(F.coalesce(F.col(x), F.lit(0)) * (F.col("n") / F.col("counted"))).cast("long")
    s = s.select((F.col("u") > 0).alias("some"), whole("u").alias("u"), whole("t").alias("t"), whole("c").alias("c"))
    block = len(system) // 4
    read = F.lit(block) + F.lit(int(block * 0.1)) * (F.col("u") - 1) + F.col("t") + F.col("c") + F.lit(prompt) * F.col("u")
    or_none = lambda x, none: F.when(F.col("some"), x).otherwise(none)
    s = s.select("some", F.col("u"), read.alias("r"), (F.col("u") * output).alias("w"))
    cost = F.bround((F.col("r") * price[0] + F.col("w") * price[1]) / 1e6, 4)
    return s.select(or_none(F.col("u"), 0).alias("segments"), or_none(F.col("r"), 0).alias("input_tokens"), or_none(F.col("w"), 0).alias("output_tokens"), or_none(cost, 0.0).alias("cost_usd"))


def validated(engine: str, context: int, workers: int, unit: str, allowed: list[str], roles: list[str] = [], model: str | None = None, models: list[str] = []) -> None:  # noqa: B006
    if engine not in ("dictionary", "llm"):
        raise ValueError("engine")
    if set(roles) - {"interviewer", "participant", "other"}:
        raise ValueError("roles")
    if engine == "llm" and models and model not in models:
        raise ValueError("model")
    if not 0 <= context <= 20:
        raise ValueError("context window")
    if not 1 <= workers <= 10:
        raise ValueError("workers")
    if unit not in allowed:
        raise ValueError("unit")


def pending(run_documents: DataFrame) -> DataFrame:
    """What a retry does: the documents of a run that are not completed."""
    return run_documents.where("status <> 'completed'")


def recovered(runs: DataFrame) -> DataFrame:
    """After a crash: what was pending or running has failed."""
    return runs.withColumn("status", F.when(F.col("status").isin("pending", "running"), "failed").otherwise(F.col("status")))


def progress(run_documents: DataFrame, elapsed: float) -> DataFrame:
    """run_id, n_docs, n_done, eta in seconds."""
    s = run_documents.groupBy("run_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("status") == "completed").alias("n_done"))
    return s.withColumn("eta", F.when(F.col("n_done") > 0, F.lit(float(elapsed)) / F.col("n_done") * (F.col("n_docs") - F.col("n_done"))))
