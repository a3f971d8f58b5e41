"""Workspaces: the relations around documents and runs, and the changes to them, each a new DataFrame.

Relations: documents (doc_id, workspace_id, filename, file_path, source_type, lang, grp, convention, roles), runs (run_id, workspace_id,
status, ...), run_documents (run_id, doc_id, status), segments and codings (run_id, doc_id, ...), members (workspace_id, user_id).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcode.functions import text as T
from loomcode.operators import conventions, language
from loomcode.operators.numbering import numbered

ROLES = ["interviewer", "participant", "other"]
COSTS_SHOWN = 20
GROUP_VALUES = 30


def _blank_as_null(x) -> Column:
    return F.nullif(T.strip(F.coalesce(x, F.lit(""))), F.lit(""))


def _only(known: Iterable[str], wanted: Iterable[str], what: str) -> None:
    """Raises for what is wanted and not known."""
    bad = sorted(set(wanted) - set(known))
    if bad:
        raise ValueError(f"unknown {what}: {', '.join(bad)}")


# Changes to documents.


def grouped(documents: DataFrame, workspace_id: int, ids: list[int], label: str | None) -> tuple[DataFrame, int]:
    """(documents, how many changed): a group's label for documents of the workspace; a blank one takes the label away."""
    mine = (F.col("workspace_id") == workspace_id) & F.col("doc_id").isin([int(i) for i in ids] or [-1])
    new = documents.withColumn("grp", F.when(mine, _blank_as_null(F.lit(label).cast("string"))).otherwise(F.col("grp")))
    return new, documents.where(mine).count()


def _roles_by(documents: DataFrame, patterns: list[tuple[str, conventions.Pattern]], convention: str) -> DataFrame:
    """doc_id, found: the roles of the speakers who recur by the convention's pattern."""
    scored = conventions.scores(documents.select("doc_id", "text"), [(k, p) for k, p in patterns if k == convention])
    speakers = F.coalesce("speakers", F.array().cast("array<string>"))
    return scored.select("doc_id", F.map_from_arrays(speakers, F.transform(speakers, T.default_role)).alias("found"))


def described(documents: DataFrame, doc_id: int, library: dict[str, str] | None = None, **changes: str | None) -> DataFrame:
    """changes: lang, grp, convention of one document. A changed convention derives the roles anew, and a blank one clears both; a blank
    language or group becomes null."""
    _only({"lang", "grp", "convention"}, changes, "field")
    this = F.col("doc_id") == doc_id
    new = documents
    for name in ("lang", "grp"):
        if name in changes:
            if name == "lang" and (changes[name] or "").strip():
                _only(T.LANGUAGES, [changes[name].strip()], "language")
            new = new.withColumn(name, F.when(this, _blank_as_null(F.lit(changes[name]).cast("string"))).otherwise(F.col(name)))
    if "convention" not in changes:
        return new
    wanted = (changes["convention"] or "").strip() or None
    if wanted is None:
        gone = F.lit(None)
        return new.withColumn("roles", F.when(this, gone).otherwise(F.col("roles"))).withColumn("convention", F.when(this, gone).otherwise(F.col("convention")))
    patterns = conventions.candidates(library)
    _only([k for k, _ in patterns], [wanted], "convention")
    found = _roles_by(documents.where(this), patterns, wanted)
    other = this & ~F.col("convention").eqNullSafe(F.lit(wanted))
    none = F.create_map().cast("map<string,string>")
    new = new.join(F.broadcast(found), "doc_id", "left")  # one document
    new = new.withColumn("roles", F.when(other, F.coalesce("found", none)).otherwise(F.col("roles")))
    return new.withColumn("convention", F.when(this, F.lit(wanted)).otherwise(F.col("convention"))).drop("found").select(documents.columns)


def redetected(documents: DataFrame, library: dict[str, str] | None = None, first: int | None = 5000, model: language.Model | None = None) -> DataFrame:
    """Language, convention and roles of all documents found anew; null where nothing is found. Languages are by stop words, or by a model of trigrams."""
    best = conventions.detect(documents.select("doc_id", "text"), conventions.candidates(library)).select("doc_id", F.col("name").alias("convention"), "roles")
    rows = documents.drop("convention", "roles").withColumn("lang", T.detect_language(F.col("text"), first) if model is None else language.detected(F.col("text"), model, first=first))
    return rows.join(best, "doc_id", "left").select(documents.columns)


def with_roles(documents: DataFrame, doc_id: int, roles: dict[str, str]) -> DataFrame:
    """A document's roles replaced; speakers are normalised, and blank ones dropped."""
    _only(ROLES, roles.values(), "role")
    pairs = [F.struct(T.normalize_speaker(F.lit(k)).alias("key"), F.lit(v).alias("value")) for k, v in roles.items()]
    kept = F.filter(F.array(*pairs), lambda x: x["key"] != "") if pairs else F.array().cast("array<struct<key:string,value:string>>")
    # Of speakers that become one, the last counts.
    last = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, i + 2, F.size(kept) + 1), lambda y: y["key"] == x["key"])) if pairs else kept
    return documents.withColumn("roles", F.when(F.col("doc_id") == doc_id, F.map_from_entries(last)).otherwise(F.col("roles")))


# Deletes and copies.


def shared_files(documents: DataFrame) -> DataFrame:
    """documents with others: how many other documents have the same file."""
    return documents.withColumn("others", F.count("*").over(Window.partitionBy("file_path")) - 1)


def without_documents(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, file paths that no document has any more). Documents go, and all rows of other tables that name them."""
    ids = ids.select("doc_id").distinct()
    left = {k: df.join(ids, "doc_id", "left_anti") if "doc_id" in df.columns else df for k, df in tables.items()}
    files = tables["documents"].join(ids, "doc_id", "left_semi").select("file_path").distinct()
    return left, files.join(left["documents"].select("file_path"), "file_path", "left_anti")


def without_runs(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Runs go with their rows in other tables; codes that they proposed stay, and forget the run."""
    ids = ids.select("run_id").distinct()
    left = {k: df.join(ids, "run_id", "left_anti") if "run_id" in df.columns else df for k, df in tables.items()}
    if "codes" in tables:
        gone = ids.withColumnRenamed("run_id", "proposed_in_run_id").withColumn("gone", F.lit(True))
        codes = tables["codes"].join(gone, "proposed_in_run_id", "left")
        left["codes"] = codes.withColumn("proposed_in_run_id", F.when(F.col("gone").isNull(), F.col("proposed_in_run_id"))).select(tables["codes"].columns)
    return left


def copied(tables: dict[str, DataFrame], workspace_id: int, new_id: int, user_id: int, codebook: bool = True) -> dict[str, DataFrame]:
    """A workspace with its settings, members (and the user), documents and, if asked for, active codes and their expressions; never its
    runs. New ids follow the largest ones, in the old order."""
    mine = lambda name: tables[name].where(F.col("workspace_id") == workspace_id)

    def renumbered(rows: DataFrame, key: str) -> DataFrame:
        first = tables_max(tables, key) + 1
        return numbered(rows.withColumn("old", F.col(key)), "__new", [F.col(key)]).withColumn(key, (F.col("__new") + first).cast("long")).drop("__new")

    moved = lambda rows: rows.withColumn("workspace_id", F.lit(new_id).cast("long"))
    new = dict(tables)
    add = lambda name, rows: new.update({name: tables[name].unionByName(rows.select(tables[name].columns))})
    add("workspaces", moved(mine("workspaces")))
    user = tables["members"].sparkSession.range(1).select(F.lit(new_id).cast("long").alias("workspace_id"), F.lit(user_id).cast("long").alias("user_id"))
    add("members", moved(mine("members")).select("workspace_id", "user_id").union(user).distinct())
    add("documents", moved(renumbered(mine("documents"), "doc_id")))
    if codebook:
        codes = renumbered(mine("codes").where(~F.coalesce("is_deleted", F.lit(False))), "code_id").withColumn("proposed_in_run_id", F.lit(None).cast("long"))
        add("codes", moved(codes))
        ids = codes.select(F.col("old").alias("code_id"), F.col("code_id").alias("new_code"))
        exprs = tables["expressions"].join(ids, "code_id").withColumn("workspace_id", F.lit(new_id))
        exprs = renumbered(exprs, "expr_id").withColumn("code_id", F.col("new_code"))
        add("expressions", exprs)
    return new


def tables_max(tables: dict[str, DataFrame], key: str) -> int:
    """The largest id of a kind."""
    home = {"doc_id": "documents", "code_id": "codes", "expr_id": "expressions"}[key]
    return tables[home].agg(F.coalesce(F.max(key), F.lit(0))).first()[0]


def without_workspace(tables: dict[str, DataFrame], workspace_id: int) -> dict[str, DataFrame]:
    """A workspace goes with its documents, runs, codes and members, and what hangs on them."""
    here = F.col("workspace_id") == workspace_id
    left, _ = without_documents(tables, tables["documents"].where(here))
    left = without_runs(left, tables["runs"].where(here)) if "runs" in tables else left
    if "expressions" in left and "codes" in tables:
        left["expressions"] = left["expressions"].join(tables["codes"].where(here).select("code_id"), "code_id", "left_anti")
    return {k: df.where(~here) if "workspace_id" in df.columns else df for k, df in left.items()}


def with_member(members: DataFrame, workspace_id: int, user_id: int) -> DataFrame:
    one = members.sparkSession.range(1).select(F.lit(workspace_id).cast("long").alias("workspace_id"), F.lit(user_id).cast("long").alias("user_id"))
    return members.select("workspace_id", "user_id").union(one).distinct()


def without_member(members: DataFrame, workspace_id: int, user_id: int) -> DataFrame:
    return members.where(~((F.col("workspace_id") == workspace_id) & (F.col("user_id") == user_id)))


# What is shown of a workspace.


def shared_with(workspaces: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """The workspaces of others in which the user is a member."""
    mine = members.where(F.col("user_id") == user_id).select("workspace_id")
    return workspaces.where(F.col("owner_id") != user_id).join(mine, "workspace_id", "left_semi")


def analyzed(documents: DataFrame, run_documents: DataFrame) -> DataFrame:
    """documents with analyzed: whether a run has completed the document."""
    done = run_documents.where("status = 'completed'").select("doc_id").distinct().withColumn("analyzed", F.lit(True))
    return documents.join(done, "doc_id", "left").fillna(False, ["analyzed"])


def codings_per_code(codings: DataFrame, runs: DataFrame, workspace_id: int) -> DataFrame:
    mine = runs.where(F.col("workspace_id") == workspace_id).select("run_id")
    return codings.join(mine, "run_id", "left_semi").groupBy("code_id").agg(F.count("*").alias("codings"))


def runs_with_code(runs: DataFrame, codings: DataFrame, code_id) -> DataFrame:
    return runs.join(codings.where(F.col("code_id") == code_id).select("run_id"), "run_id", "left_semi")


def of_completed(codings: DataFrame, run_documents: DataFrame) -> DataFrame:
    """The codings of documents that their run has completed."""
    done = run_documents.where("status = 'completed'").select("run_id", "doc_id")
    return codings.join(done, ["run_id", "doc_id"], "left_semi")


def run_counters(runs: DataFrame, segments: DataFrame, codings: DataFrame, codes: DataFrame) -> DataFrame:
    """run_id, n_codings, n_new_codes, n_segments, n_excluded, n_uncoded: units neither coded nor excluded count as not coded, failed ones too."""
    per_segment = segments.groupBy("run_id").agg(
        F.count("*").alias("n_segments"), F.count_if(F.col("status") == "excluded").alias("n_excluded"), F.count_if(~F.col("status").isin("coded", "excluded")).alias("n_uncoded")
    )
    per_coding = codings.groupBy("run_id").agg(F.count("*").alias("n_codings"))
    new = codes.where("proposed_in_run_id is not null").groupBy(F.col("proposed_in_run_id").alias("run_id")).agg(F.count("*").alias("n_new_codes"))
    out = runs.select("run_id")
    for df in (per_coding, new, per_segment):
        out = out.join(df, "run_id", "left")
    return out.fillna(0)


def extracts(codings: DataFrame, code_id=None) -> DataFrame:
    """doc_id, n, extracts: a code's codings by document, in the order of their places."""
    rows = codings if code_id is None else codings.where(F.col("code_id") == code_id)
    # Nulls first, then by place.
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("start_offset", F.lit(-1)).alias("at"), "coding_id", "segment_text")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.transform(listed, lambda x: x["segment_text"]).alias("extracts"))


def user_cost(log: DataFrame, user_id: int) -> DataFrame:
    return log.where(F.col("user_id") == user_id).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def logged(log: DataFrame, new: DataFrame) -> DataFrame:
    """The cost log after a run: one row for each run and user, of the new entry where there is one."""
    return log.join(new.select("run_id", "user_id"), ["run_id", "user_id"], "left_anti").unionByName(new.select(log.columns))


def latest_costs(log: DataFrame, most: int = COSTS_SHOWN) -> DataFrame:
    return log.orderBy(F.desc("recorded_at"), F.desc("run_id")).limit(most)


def overview(documents: DataFrame) -> DataFrame:
    """One row: n_documents, n_groups, n_languages, n_without_language, n_unsegmented (transcripts without a convention)."""
    return documents.agg(
        F.count("*").alias("n_documents"),
        F.countDistinct(F.when(F.col("grp") != "", F.col("grp"))).alias("n_groups"),
        F.countDistinct("lang").alias("n_languages"),
        F.count_if(F.col("lang").isNull()).alias("n_without_language"),
        F.count_if((F.col("source_type") != "excel") & F.col("convention").isNull()).alias("n_unsegmented"),
    )


def filtered(documents: DataFrame, lang: str | None = None, grp: str | None = None, convention: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the documents that fit all that is given, one row: shown, total). A blank value asks for documents without one."""
    fits = F.lit(True)
    for name, value in (("lang", lang), ("grp", grp), ("convention", convention)):
        if value is not None:
            fits = fits & (F.coalesce(F.col(name), F.lit("")) == value)
    return documents.where(fits), documents.agg(F.count_if(fits).alias("shown"), F.count("*").alias("total"))


def sorted_by(rows: DataFrame, column: str, falling: bool = False) -> DataFrame:
    """As a table is sorted on a click: without regard to case, ties in the order of doc_id."""
    key = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return rows.orderBy(key.desc() if falling else key.asc(), "doc_id")


def in_order(rows: DataFrame, column: str, falling: bool = False) -> DataFrame:
    """rows with ord: their place (from 0) in the order of sorted_by()."""
    key = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return numbered(rows.withColumn("__key", key), "ord", [F.desc("__key") if falling else F.asc("__key"), F.col("doc_id")]).drop("__key")


def group_values(cells: DataFrame, column: str, most: int = GROUP_VALUES) -> list[str]:
    """The distinct values of a grouping column; one with more than `most` is refused."""
    found = [r[0] for r in cells.where(F.col("column") == column).select("text").distinct().orderBy("text").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return found


def checked_columns(known: Iterable[str], wanted: Iterable[str]) -> None:
    _only(known, wanted, "column")


def snapshot(codes: DataFrame, expressions: DataFrame) -> DataFrame:
    """One row, codebook: the active codes and their expressions as JSON, as a run keeps them when it is launched."""
    from loomcode.operators import codebook

    own = expressions.groupBy("code_id").agg(F.array_sort(F.collect_list(F.struct("expr_id", "lang", "expression"))).alias("e"))
    rows = codebook.active(codes).join(own, "code_id", "left")
    said = F.transform(F.coalesce("e", F.array().cast("array<struct<expr_id:bigint,lang:string,expression:string>>")), lambda x: F.struct(x["lang"].alias("lang"), x["expression"].alias("expression")))
    listed = F.array_sort(F.collect_list(F.struct("label", "code_id", F.coalesce("description", F.lit("")).alias("description"), said.alias("expressions"))))
    return rows.agg(F.to_json(listed).alias("codebook"))
