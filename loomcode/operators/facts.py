"""Facts of runs: what a coder says of each unit, written once, and visible when its attempt is committed.

root/answers    what a model coder has answered, a row for each unit: the one source of what follows
root/units      the facts: a row for each unit with its status, and its codings in an array
root/documents  run_id, attempt, doc_id, status, error, tokens: how each document of an attempt has ended
root/commits    a row for each attempt that is complete, written last, as one file

All are under run_id=, attempt=; facts lie in a fixed number of buckets of doc_id besides, so that some documents are read from some
files. Segments and codings are two views of one table, so that they cannot contradict each other, and a crash anywhere before the
commit leaves nothing that is read: only committed attempts are. A document of which an error is recorded writes no facts in its
attempt; the others are not touched by it. A retry is a further attempt over the documents that are not completed, so that
each document's facts stand in one committed attempt.

A coder is asked once for each unit that is not excluded. (A task that Spark runs again, after a lost executor, asks again for its
units; what is kept is the last one's answer.)
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loomcode.functions import text as T
from loomcode.operators import codebook, dictionary
from loomcode.store import exists

BUCKETS = 32
#: A codebook is held on the driver to write prompts, and in each task to resolve labels.
MAX_CODES = 20_000
CODING = "struct<code_id:bigint,label:string,description:string,example:string,rationale:string,score:bigint,matched_expressions:array<string>,sentences:array<string>>"
OUTCOME = f"codings array<{CODING}>, no_code_rationale string, unit_error boolean, error string, tokens_in long, tokens_out long"


#: What the dictionary fills in of a coding.
DICTIONARY = {"code_id", "score", "matched_expressions", "sentences", "rationale"}


class RateLimited(Exception):
    """What a coder raises when it is asked too often."""


class SingleFlight:
    """Jobs by key, one at a time for each: a second call waits for the first one's result."""

    def __init__(self):
        self._lock, self._jobs = threading.Lock(), {}

    def run(self, key, job: Callable):
        with self._lock:
            running = self._jobs.get(key)
            mine = running is None
            if mine:
                running = self._jobs[key] = Future()
        if mine:
            try:
                running.set_result(job())
            except BaseException as e:
                running.set_exception(e)
            finally:
                with self._lock:
                    del self._jobs[key]
        return running.result()

    def active(self) -> list:
        """The keys whose jobs are running."""
        with self._lock:
            return list(self._jobs)


RUNS = SingleFlight()


class Progress:
    """What a run has coded so far, by batches of documents: read by other threads while it goes on."""

    def __init__(self):
        self._lock, self._batches, self.ended = threading.Lock(), [], False

    def add(self, counts: dict[str, int]) -> None:
        with self._lock:
            self._batches.append(counts)

    def counts(self) -> dict[str, int]:
        """n_batches, n_units, n_excluded, n_coded, n_error."""
        with self._lock:
            return {"n_batches": len(self._batches)} | {k: sum(b[k] for b in self._batches) for k in ("n_units", "n_excluded", "n_coded", "n_error")}


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Facts whose units are counted as they are written."""
    seen = Observation()
    status = F.col("status")
    return rows.observe(seen, F.count("*").alias("n_units"), F.count_if(status == "excluded").alias("n_excluded"), F.count_if(status == "coded").alias("n_coded"), F.count_if(status == "error").alias("n_error")), seen


def counted(seen: Observation) -> dict[str, int]:
    """What has been observed; zeros where there was nothing to write, as Spark then drops the plan that counts."""
    try:
        return seen.get
    except Py4JJavaError:
        return dict.fromkeys(("n_units", "n_excluded", "n_coded", "n_error"), 0)


def excluded_of(units: DataFrame) -> Column:
    return F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in units.columns else F.lit(False)


def context_lines(context: Column) -> Column:
    """`SPEAKER: text` lines."""
    return F.array_join(F.transform(context, lambda u: F.when(F.coalesce(u["speaker"], F.lit("")) != "", F.concat(u["speaker"], F.lit(": "), u["text"])).otherwise(u["text"])), "\n")


def _unasked(rows: DataFrame) -> DataFrame:
    """The columns of OUTCOME that only an answer fills."""
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(OUTCOME) if f.name != "codings"})


@dataclass(frozen=True)
class DictionaryCoder:
    """Matches expressions; its answers name codes by id, so that they are facts at once."""

    codes: DataFrame
    expressions: DataFrame
    asks = False

    def outcomes(self, units: DataFrame, codes: DataFrame | None) -> DataFrame:
        index = dictionary.build_index(self.codes, self.expressions)
        rows = dictionary.coded_units(units, index)
        if rows is None:
            open_ = units.where(~excluded_of(units))
            return self.shaped(units, dictionary.codings(dictionary.match_sentences(open_, index)))
        own = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in DICTIONARY else None for f in StructType.fromDDL(f"c {CODING}")["c"].dataType]
        names = StructType.fromDDL(f"c {CODING}")["c"].dataType.names
        each = lambda c: F.struct(*(c[n].alias(n) if x is None else x for n, x in zip(names, own, strict=True)))
        return _unasked(rows.withColumn("codings", F.transform("codings", each)))

    @staticmethod
    def shaped(units: DataFrame, found: DataFrame) -> DataFrame:
        """units with OUTCOME, from codings: doc_id, position, code_id and what else there is of CODING."""
        kinds = StructType.fromDDL(f"c {CODING}")["c"].dataType
        own = [(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]
        # A unit has at most a coding for each code.
        per = found.groupBy("doc_id", "position").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("codings"))
        rows = units.join(per, ["doc_id", "position"], "left").withColumn("codings", F.coalesce("codings", F.array().cast(f"array<{CODING}>")))
        return _unasked(rows)


@dataclass(frozen=True)
class Coded:
    """A coder from a function of units to codings."""

    code: Callable[[DataFrame], DataFrame]
    asks = False

    def outcomes(self, units: DataFrame, codes: DataFrame | None) -> DataFrame:
        return DictionaryCoder.shaped(units, self.code(units))


def study_context(*chain: str | None) -> str:
    """The first of a run's, a workspace's and the general study context that is not blank."""
    return next((x.strip() for x in chain if x and x.strip()), "")


def format_codebook(codes: DataFrame | None) -> str:
    """The codebook's bullets, for a codebook of MAX_CODES codes at most."""
    rows = [] if codes is None else codebook.active(codes).orderBy("label").select("label", "description").limit(MAX_CODES + 1).collect()
    if len(rows) > MAX_CODES:
        raise ValueError(f"a codebook of more than {MAX_CODES} codes does not fit a prompt")
    return "\n".join(f"- {r['label']}: {r['description']}" if r["description"] else f"- {r['label']}" for r in rows) or "(no codes yet: propose some)"


def system_block(codes: str, context: str) -> str:
    """What is the same for all units of a batch, and is cached by a model service: the study's context and the codebook."""
    return f"Study: {context or '(not described)'}\n\nCodebook:\n{codes}"


def user_message(text: str, lines: str | None) -> str:
    """The unit to code, behind the units before it, if there are any."""
    return f"Before it, not to be coded:\n{lines}\n\nTo be coded:\n{text.strip()}" if lines else f"To be coded:\n{text.strip()}"


def parsed_entries(answer: str | None) -> tuple[list | None, str | None, str | None]:
    """(entries that name a code; rationales for no code; why its document fails).

    No answer, or one that is not JSON, is no entry list (None): the unit is in error, its document goes on. JSON of another form than a
    list of objects fails the document, but empty values of any form are an empty list.
    """
    if answer is None:
        return None, None, None
    body = answer.strip()
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)```", body)
    try:
        found = json.loads(fenced[1].strip() if fenced else body)
    except ValueError:
        return None, None, None
    if found is None:
        return None, None, None
    entries, why = [], []
    try:
        for e in found or []:
            if e.get("action") == "no_code":
                why += [e["rationale"].strip()] if (e.get("rationale") or "").strip() else []
            elif label := (e.get("code") or "").strip():
                entries.append({"label": label, "description": (e.get("description") or "").strip() or None, "example": (e.get("example") or "").strip() or None, "rationale": e.get("rationale")})
    except (AttributeError, TypeError, KeyError) as x:
        return [], None, f"malformed answer: {x}"
    return entries, " | ".join(why) or None, None


@dataclass(frozen=True)
class ModelCoder:
    """A language model, or any function (system block, message) -> answer or (answer, tokens read, tokens written).

    It runs on the executors, a call for each unit, `workers` at a time in a task. After the k-th error of the kinds to wait for, it is asked again
    in 2**k pauses (seconds), `retries` times in all; any other error is no answer. An error that is listed in `fails` fails the unit's document.
    """

    ask: Callable[[str, str], str | tuple]
    study: tuple[str | None, ...] = ()
    retries: int = 5
    pause: float = 1.0
    workers: int = 1
    wait_for: tuple = (RateLimited, TimeoutError, ConnectionError)
    fails: tuple = ()
    asks = True

    def outcomes(self, units: DataFrame, codes: DataFrame | None) -> DataFrame:
        system = system_block(format_codebook(codes), study_context(*self.study))
        coder, kept = self, units.columns
        lines = F.coalesce(context_lines(F.col("context")), F.lit("")) if "context" in kept else F.lit("")
        rows = units.withColumns({"__lines": lines, "__skip": excluded_of(units)})
        own = [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(OUTCOME)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(coder.workers) as pool:
                for b in batches:
                    given = zip(*(b.column(c).to_pylist() for c in ("text", "__lines", "__skip")), strict=True)
                    out = list(pool.map(lambda x: coder.one(system, *x), given))
                    new = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(own)]
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, names=[*kept, *(f.name for f in own)])

        return rows.mapInArrow(run, StructType(units.schema.fields + StructType.fromDDL(OUTCOME).fields))

    def one(self, system: str, text: str, lines: str, skip: bool) -> tuple:
        if skip:
            return [], None, None, None, 0, 0
        try:
            answer, read, wrote = self.answered(system, user_message(text or "", lines))
        except self.fails as e:
            return [], None, None, f"{type(e).__name__}: {e}", 0, 0
        entries, why, error = parsed_entries(answer)
        whole = [{"code_id": None, "score": None, "matched_expressions": None, "sentences": None} | e for e in entries or []]
        return whole, why, entries is None, error, read, wrote

    def answered(self, system: str, message: str) -> tuple[str | None, int, int]:
        import time

        for k in range(self.retries):
            try:
                answer = self.ask(system, message)
                return answer if isinstance(answer, tuple) else (answer, (len(system) + len(message)) // 4, len(answer or "") // 4)
            except self.wait_for:
                if k < self.retries - 1:
                    time.sleep(2**k * self.pause)
            except self.fails:
                raise
            except Exception:  # any other error is no answer
                break
        return None, 0, 0


def _read(spark: SparkSession, root: str, table: str, run_id: int, attempts: list[int], schema: StructType | None = None) -> DataFrame:
    paths = [f"{root}/{table}/run_id={run_id}/attempt={a}" for a in attempts]
    reader = spark.read.option("basePath", f"{root}/{table}")
    return (reader if schema is None else reader.schema(schema)).parquet(*paths)


def _commits(spark: SparkSession, root: str, run_id: int) -> list:
    """A row for each committed attempt of a run; there are as many as it was started and retried."""
    if not exists(spark, f"{root}/commits"):
        return []
    return spark.read.schema("anew boolean, schema string, run_id long, attempt long").parquet(f"{root}/commits").where(F.col("run_id") == run_id).collect()


def committed(spark: SparkSession, root: str, run_id: int) -> list:
    """The commits that count, in order: those from the last one on that was a run anew."""
    rows = _commits(spark, root, run_id)
    first = max((r["attempt"] for r in rows if r["anew"]), default=0)
    return sorted((r for r in rows if r["attempt"] >= first), key=lambda r: r["attempt"])


def _commit(spark: SparkSession, root: str, run_id: int, attempt: int, anew: bool, facts: StructType) -> None:
    """The mark of a complete attempt; it keeps the schema of its facts, of which there may be no file."""
    one = spark.range(1).coalesce(1).select(F.lit(anew).alias("anew"), F.lit(facts.json()).alias("schema"))
    one.write.mode("overwrite").parquet(f"{root}/commits/run_id={run_id}/attempt={attempt}")


def _attempts(spark: SparkSession, root: str, run_id: int) -> int:
    """The last attempt that is committed; what another has left under the next number is overwritten."""
    return max((r["attempt"] for r in _commits(spark, root, run_id)), default=0)


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.hash(doc_id), F.lit(buckets)).cast("int")


def _write_units(rows: DataFrame, path: str, buckets: int) -> None:
    """Facts by buckets. Rows are dealt by the hash that buckets are made of, to a multiple of their number, so that a task writes one file."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(-(-n // buckets) * buckets, "doc_id")
    dealt.withColumn("bucket", bucket_of(F.col("doc_id"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def facts_of(outcomes: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("codings"), F.lit(0))
    status = F.when(excluded_of(outcomes), "excluded").when(F.coalesce("unit_error", F.lit(False)), "error").when(n > 0, "coded").otherwise("no_code")
    return outcomes.withColumn("n_codings", n.cast("long")).withColumn("status", status).drop("unit_error", "error")


def resolved(outcomes: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes whose codings have code_id, codes with the new ones): the first proposal of an unknown label, in the order of (doc_id, position, entry),
    creates its code, later ones map to it."""
    spark = codes.sparkSession
    each = outcomes.select("doc_id", "position", F.posexplode("codings").alias("entry", "c")).where("c.code_id is null")
    named = each.select(F.struct("doc_id", "position", "entry").alias("at"), T.normalize_label(F.col("c.label")).alias("norm"), F.struct("c.label", "c.description", "c.example").alias("c"))
    held = codebook.active(codes).groupBy(T.normalize_label(F.col("label")).alias("norm")).agg(F.min("code_id").alias("code_id"))
    known = {r["norm"]: r["code_id"] for r in held.limit(MAX_CODES + 1).collect()}
    fresh = named.join(held, "norm", "left_anti").groupBy("norm").agg(F.min("at").alias("at"), F.min_by("c", "at").alias("c"))
    new = sorted(fresh.limit(MAX_CODES + 1).collect(), key=lambda r: tuple(r["at"]))
    if len(known) + len(new) > MAX_CODES:
        raise ValueError(f"the codebook would have more than {MAX_CODES} codes")
    following = (codes.agg(F.max("code_id")).first()[0] or 0) + 1
    known |= {r["norm"]: following + i for i, r in enumerate(new)}
    if new:
        made = spark.createDataFrame([(following + i, *r["c"], False) for i, r in enumerate(new)], "code_id long, label string, description string, example string, is_deleted boolean")
        codes = codes.unionByName(made, allowMissingColumns=True)
    ids = spark.createDataFrame([(known,)], "__ids map<string,long>")  # one row of MAX_CODES entries at most
    code = lambda c: c.withField("code_id", F.coalesce(c["code_id"], F.try_element_at(F.col("__ids"), T.normalize_label(c["label"]))))
    return outcomes.crossJoin(F.broadcast(ids)).withColumn("codings", F.transform("codings", code)).drop("__ids"), codes


def _batches(todo: DataFrame, size: int | None) -> Iterator[DataFrame]:
    """todo: doc_id. Documents in their order, `size` at a time; all at once without a size. The driver sees the last id of each batch."""
    if size is None:
        yield todo
        return
    last = None
    while True:
        rest = todo if last is None else todo.where(F.col("doc_id") > last)
        end = rest.orderBy("doc_id").limit(size).agg(F.max("doc_id")).first()[0]
        if end is None:
            return
        yield rest.where(F.col("doc_id") <= end)
        last = end


def execute(run_id: int, units: DataFrame, failed: DataFrame | None, run_documents: DataFrame | None, coder, root: str, codes: DataFrame | None = None, batch: int | None = None, anew: bool = False, buckets: int = BUCKETS, progress: Progress | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Codes a run's pending documents (all, if anew): (the run's documents with status and error, the codebook with the codes that were proposed).

    units: doc_id, position, text and what is to be kept; failed (doc_id, reason): documents that cannot be coded; run_documents: run_id, doc_id,
    status. batch: so many documents are coded with one state of the codebook; codes that they propose stand in the next one's prompts.
    Running it again, with the result as run_documents, codes what is not completed. Without run_documents, all documents of units are coded, and
    the documents are those that have units. progress has a batch's counts as soon as its facts are written. Two calls for a run are one: the second waits.
    """
    progress = progress or Progress()
    try:
        return RUNS.run((root, run_id), lambda: _execute(run_id, units, failed, run_documents, coder, root, codes, batch, anew, buckets, progress))
    finally:
        progress.ended = True


def _execute(run_id, units, failed, run_documents, coder, root, codes, batch, anew, buckets, progress):
    spark = units.sparkSession
    if run_documents is None:
        attempt = _attempts(spark, root, run_id) + 1
        home = f"{root}/{{}}/run_id={run_id}/attempt={attempt}/batch=0"
        rows, seen = observed(facts_of(coder.outcomes(units, codes)))
        _write_units(rows, home.format("units"), buckets)
        progress.add(counted(seen))
        done = spark.read.parquet(home.format("units")).groupBy("doc_id").agg(F.lit("completed").alias("status"))
        done.select("doc_id", "status", F.lit(None).cast("string").alias("error"), *(F.lit(0).cast("long").alias(c) for c in ("tokens_in", "tokens_out"))).write.mode("overwrite").parquet(home.format("documents"))
        _commit(spark, root, run_id, attempt, True, rows.schema)
        return _read(spark, root, "documents", run_id, [attempt]).select(F.lit(run_id).cast("long").alias("run_id"), "doc_id", "status", "error"), codes
    own = run_documents.where(F.col("run_id") == run_id)
    todo = (own if anew else own.where("status <> 'completed'")).select("doc_id").distinct()
    bad = failed.join(todo, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("reason").alias("error"))
    if todo.isEmpty():
        return own.select("run_id", "doc_id", "status", F.lit(None).cast("string").alias("error")).unionByName(others(run_documents, run_id)), codes
    attempt = _attempts(spark, root, run_id) + 1
    home = lambda table, k: f"{root}/{table}/run_id={run_id}/attempt={attempt}/batch={k}"
    for k, docs in enumerate(_batches(todo, batch)):
        rows = units.join(docs, "doc_id", "left_semi").join(bad, "doc_id", "left_anti")
        outcomes = coder.outcomes(rows, codes)
        ended = docs.join(bad, "doc_id", "left")
        if coder.asks:
            outcomes.write.mode("overwrite").parquet(home("answers", k))
            outcomes = spark.read.schema(outcomes.schema).parquet(home("answers", k))
            said = outcomes.groupBy("doc_id").agg(F.min("error").alias("said"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
            ended = ended.join(said, "doc_id", "left").withColumn("error", F.coalesce("error", "said")).drop("said")
            outcomes = outcomes.join(said.where("said is not null"), "doc_id", "left_anti")
            if codes is not None:
                outcomes, codes = resolved(outcomes, codes)
        else:
            ended = ended.withColumns({"tokens_in": F.lit(0).cast("long"), "tokens_out": F.lit(0).cast("long")})
        rows, seen = observed(facts_of(outcomes))
        _write_units(rows, home("units", k), buckets)
        progress.add(counted(seen))
        status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
        ended.select("doc_id", status.alias("status"), "error", F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"), F.coalesce("tokens_out", F.lit(0)).alias("tokens_out")).write.mode("overwrite").parquet(home("documents", k))
    _commit(spark, root, run_id, attempt, anew, rows.schema)
    done = _read(spark, root, "documents", run_id, [attempt]).select("doc_id", F.col("status").alias("now"), "error")
    after = own.select("run_id", "doc_id", "status").join(done, "doc_id", "left")
    after = after.select("run_id", "doc_id", F.coalesce("now", "status").alias("status"), "error")
    return after.unionByName(others(run_documents, run_id)), codes


def others(run_documents: DataFrame, run_id: int) -> DataFrame:
    return run_documents.where(F.col("run_id") != run_id).select("run_id", "doc_id", "status", F.lit(None).cast("string").alias("error"))


def executed(run_id: int, units: DataFrame, failed: DataFrame, run_documents: DataFrame, code, root: str) -> DataFrame:
    """The documents that execute() gives; code: a coder, or a function of units to codings."""
    return execute(run_id, units, failed, run_documents, code if hasattr(code, "outcomes") else Coded(code), root)[0]


def read_units(spark: SparkSession, root: str, run_id: int, doc_ids: list[int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The facts of a run's committed attempts, of some documents if they are given: only their buckets are read then."""
    commits = committed(spark, root, run_id)
    if not commits:
        raise ValueError(f"run {run_id} has no facts")
    schema = StructType.fromJson(json.loads(commits[-1]["schema"])).add("run_id", "long")
    for name in ("attempt", "batch", "bucket"):
        schema = schema.add(name, "integer")
    rows = _read(spark, root, "units", run_id, [r["attempt"] for r in commits], schema)
    if doc_ids is not None:
        wanted = spark.range(1).select(F.array_distinct(F.transform(F.array(*(F.lit(d).cast(rows.schema["doc_id"].dataType) for d in doc_ids)), lambda d: bucket_of(d, buckets)))).first()[0] if doc_ids else []
        rows = rows.where(F.col("bucket").isin(wanted) & F.col("doc_id").isin(doc_ids))
    return rows.drop("attempt", "batch", "bucket")


def segments_view(units: DataFrame) -> DataFrame:
    """A row for each unit, with the ids of its codes in code_ids."""
    return units.withColumn("code_ids", F.array_distinct(F.transform("codings", lambda c: c["code_id"]))).drop("codings", "tokens_in", "tokens_out")


def codings_view(units: DataFrame) -> DataFrame:
    """run_id, doc_id, position, code_id, score, matched_expressions, sentences, rationale: a row for each coding."""
    rows = units.select(*(c for c in ("run_id", "doc_id", "position") if c in units.columns), F.explode("codings").alias("c"))
    return rows.select(*(c for c in rows.columns if c != "c"), "c.code_id", "c.score", "c.matched_expressions", "c.sentences", "c.rationale")


def read_facts(spark: SparkSession, root: str, run_id: int, doc_ids: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, codings) of a run, of some documents if they are given."""
    units = read_units(spark, root, run_id, doc_ids)
    return segments_view(units), codings_view(units)
