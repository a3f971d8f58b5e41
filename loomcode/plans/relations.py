"""Queries over the relations around runs: workspaces, members, documents, conventions, units and exports.

The driver's tables stand for them: orders are runs, line items codings, documents documents, customers members of nations as workspaces, and
conversations transcripts in five layouts.
"""

from __future__ import annotations

import html
import uuid
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcode.functions import tables
from loomcode.functions import text as T
from loomcode.operators import codebook, conventions, facts, runs, segment, workspace
from loomcode.operators import units as U
from loomcode.operators.analysis import read_cube, write_cube
from loomcode.operators.numbering import numbered
from loomcode.plans import catalog as C
from loomcode.plans.catalog import query
from loomcode.sources import datasource, files, reports, sinks, stored
from loomcode.sources.sinks import docx, packed
from loomcode.store import shared_dir

_BEFORE = set(C.QUERIES)

# Relations, and the same as SQL.

_REL = """with runs as (select o_orderkey as run_id, o_custkey % 10 as workspace_id, o_custkey % 7 as user_id, o_totalprice as cost, o_orderdate as recorded_at,
    case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'pending' end as status from orders),
codings as (select l_orderkey as run_id, l_orderkey * 10 + l_linenumber as coding_id, l_partkey as doc_id, l_returnflag || l_linestatus as code_id,
    case when l_linenumber % 3 = 0 then null else l_linenumber * 5 end as start_offset, case when l_linenumber % 3 = 0 then null else l_linenumber * 5 + 3 end as end_offset,
    l_linenumber || ' of ' || l_suppkey % 4 as segment_text from lineitem),
docs as (select doc_id, doc_id % 5 as workspace_id, source || '.txt' as filename, source || '/' || doc_id % 40 as file_path, case when doc_id % 4 = 0 then 'excel' else 'docx' end as source_type,
    case when lang <> 'es' then lang end as lang, case when source <> 'src3' then source else '' end as grp, case when doc_id % 3 > 0 then 'plain' end as convention from documents)
"""


def run_table(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    return C.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 10).alias("workspace_id"), (F.col("o_custkey") % 7).alias("user_id"), F.col("o_totalprice").alias("cost"),
        F.col("o_orderdate").alias("recorded_at"), status.alias("status"),
    )


def coding_table(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    some = lambda x: F.when(n % 3 != 0, x)
    return C.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") * 10 + n).alias("coding_id"), F.col("l_partkey").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("code_id"),
        some(n * 5).alias("start_offset"), some(n * 5 + 3).alias("end_offset"), F.concat(n.cast("string"), F.lit(" of "), (F.col("l_suppkey") % 4).cast("string")).alias("segment_text"),
    )


def document_table(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    return C.table(spark, sf, "documents").select(
        "doc_id", (i % 5).alias("workspace_id"), F.concat("source", F.lit(".txt")).alias("filename"), F.concat("source", F.lit("/"), (i % 40).cast("string")).alias("file_path"),
        F.when(i % 4 == 0, "excel").otherwise("docx").alias("source_type"), F.when(F.col("lang") != "es", F.col("lang")).alias("lang"),
        F.when(F.col("source") != "src3", F.col("source")).otherwise("").alias("grp"), F.when(i % 3 > 0, "plain").alias("convention"),
    )


@query(_REL + " select code_id, count(*) as codings from codings join runs using (run_id) where workspace_id = 3 group by code_id")
def codings_of_workspace(spark, sf):
    return workspace.codings_per_code(coding_table(spark, sf), run_table(spark, sf), 3)


@query("""select n.n_nationkey::bigint as workspace_id from nation n where n.n_regionkey <> 2 and exists (select 1 from customer c where c.c_nationkey = n.n_nationkey and c.c_custkey % 40 = 2)""")
def workspaces_shared_with_user(spark, sf):
    spaces = C.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("workspace_id"), F.col("n_regionkey").cast("long").alias("owner_id"))
    members = C.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("workspace_id"), (F.col("c_custkey") % 40).alias("user_id"))
    return workspace.shared_with(spaces, members, 2).select("workspace_id")


@query(_REL + " select run_id, status from runs where run_id in (select run_id from codings where code_id = 'RF')")
def runs_containing_code(spark, sf):
    return workspace.runs_with_code(run_table(spark, sf), coding_table(spark, sf), "RF").select("run_id", "status")


@query(_REL + """, done as (select distinct run_id from runs where status = 'completed') select c.coding_id, c.code_id from codings c join done using (run_id)""")
def codings_of_completed(spark, sf):
    c = coding_table(spark, sf)
    linked = c.select("run_id", "doc_id").distinct().join(run_table(spark, sf).select("run_id", "status"), "run_id")
    return workspace.of_completed(c, linked).select("coding_id", "code_id")


@query(_REL + """, s as (select distinct doc_id, start_offset, end_offset, segment_text from codings where doc_id % 2 = 0 union select distinct doc_id, null, null, 'nowhere' from codings where doc_id % 5 = 0)
select s.doc_id, s.start_offset, s.end_offset, s.segment_text, coalesce((select string_agg(code_id, '; ' order by code_id) from codings c where c.doc_id = s.doc_id and c.start_offset is not distinct from s.start_offset
    and c.end_offset is not distinct from s.end_offset and c.segment_text = s.segment_text), '') as codes from s""")
def unit_key_join(spark, sf):
    c = coding_table(spark, sf)
    own = c.where("doc_id % 2 = 0").select(*runs.UNIT_KEY).distinct()
    none = c.where("doc_id % 5 = 0").select("doc_id", F.lit(None).cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset"), F.lit("nowhere").alias("segment_text")).distinct()
    both = runs.with_codings(own.unionByName(none), c, F.col("code_id"))
    return both.select(*runs.UNIT_KEY, F.array_join(F.transform("codings", lambda x: x["value"]), "; ").alias("codes"))


@query("""with e as (select p_partkey, split_part(p_type, ' ', 1) || case when p_partkey % 2 = 0 then '_' else '  ' end || p_size % 9 as label from part),
n as (select *, trim(regexp_replace(translate(lower(label), '_-', '  '), '\\s+', ' ', 'g')) as norm from e),
f as (select norm, min(p_partkey) as first from n where norm <> 'promo 1' group by norm),
i as (select norm, 100 + row_number() over (order by first) - 1 as code_id from f)
select p_partkey as doc_id, case when norm = 'promo 1' then 1 else code_id end::bigint as code_id from n left join i using (norm)""")
def proposals_resolved(spark, sf):
    label = F.concat(F.split("p_type", " ")[0], F.when(F.col("p_partkey") % 2 == 0, "_").otherwise("  "), (F.col("p_size") % 9).cast("string"))
    none = F.lit(None).cast("string")
    entries = C.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("position"), F.lit(0).alias("entry"), label.alias("label"), none.alias("description"), none.alias("example"))
    known = C.local(spark, [(1, "Promo-1", None, None, False, None)], codebook.CODES)
    return codebook.resolve(known, entries, 100)[0].select("doc_id", "code_id")


@query(C._ALL + """, l as (select distinct label from codings), h as (select a.label as x, b.label as y, count(*) as n from codings a join codings b using (doc_id, position) group by 1, 2)
select l.label as label_a, m.label as label_b, coalesce(n, 0) as units from l cross join l m left join h on x = l.label and y = m.label""")
def cooccurrence_dense(spark, sf):
    return C.analysis(spark, sf).cooccurrence_matrix()


@query(C._ALL + """, l as (select distinct label from codings), d as (select distinct doc_id from segs), h as (select doc_id, label, count(*) as units from codings group by 1, 2)
select doc_id, label, coalesce(units, 0) as units from d cross join l left join h using (doc_id, label)""")
def documents_by_codes_dense(spark, sf):
    return C.analysis(spark, sf).documents_grid()


@query(C._ALL + " select count(*) as n_segments, count(*) filter (where status = 'coded') as n_coded, count(*) filter (where status = 'excluded') as n_excluded from segs")
def run_meta(spark, sf):
    return C.analysis(spark, sf).meta()


@query(C._ALL + C._LEM + """, f as (select lang, label, grp, lemma, count(*) as freq from lem join codings using (doc_id, position) group by 1, 2, 3, 4),
x as (select *, sum(freq) over w::bigint as total, (row_number() over (partition by lang, label, grp order by freq desc, lemma))::int as rank from f window w as (partition by lang, label, grp))
select lang, label, grp, lemma, freq, total, """ + C._rounded("freq / total::double", 4) + """ as norm, total < 50 as flagged, rank from x where rank <= 30""")
def lemma_cells_top(spark, sf):
    a = C.analysis(spark, sf)
    return a.top(a.lemmas_by_code_group()).select("lang", "label", "grp", "lemma", "freq", "total", "norm", "flagged", "rank")


@query(_REL + """, o as (select doc_id, file_path, count(*) over (partition by file_path) - 1 as others from docs) select doc_id, others from o""")
def documents_sharing_file(spark, sf):
    return workspace.shared_files(document_table(spark, sf)).select("doc_id", "others")


@query(_REL + " select run_id, status from runs where status <> 'completed'")
def pending_documents(spark, sf):
    return runs.pending(run_table(spark, sf)).select("run_id", "status")


@query(_REL + " select run_id, case when status in ('pending', 'running') then 'failed' else status end as status from runs")
def recovered_runs(spark, sf):
    return runs.recovered(run_table(spark, sf)).select("run_id", "status")


@query(_REL + """, p as (select workspace_id as run_id, count(*) as n_docs, count(*) filter (where status = 'completed') as n_done from runs group by 1)
select *, case when n_done > 0 then 90.0::double / n_done * (n_docs - n_done) end as eta from p""")
def run_progress(spark, sf):
    return runs.progress(run_table(spark, sf).withColumn("run_id", F.col("workspace_id")), 90.0)


@query(_REL + """, seg as (select l_orderkey as run_id, case l_shipinstruct when 'x' then 'x' else case l_linenumber % 4 when 0 then 'excluded' when 1 then 'coded' when 2 then 'no_code' else 'error' end end as status
    from (select *, '' as l_shipinstruct from lineitem)),
n as (select run_id, count(*) as n_segments, count(*) filter (where status = 'excluded') as n_excluded, count(*) filter (where status not in ('coded', 'excluded')) as n_uncoded from seg group by 1),
k as (select run_id, count(*) as n_codings from codings group by 1), p as (select p_partkey * 3 as run_id, count(*) as n_new_codes from part group by 1)
select run_id, coalesce(n_codings, 0) as n_codings, coalesce(n_new_codes, 0) as n_new_codes, coalesce(n_segments, 0) as n_segments, coalesce(n_excluded, 0) as n_excluded, coalesce(n_uncoded, 0) as n_uncoded
from runs left join n using (run_id) left join k using (run_id) left join p using (run_id)""")
def run_counters(spark, sf):
    kinds = F.element_at(F.array(*(F.lit(x) for x in ("excluded", "coded", "no_code", "error"))), F.col("l_linenumber") % 4 + 1)
    seg = C.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), kinds.alias("status"))
    made = C.table(spark, sf, "part").select((F.col("p_partkey") * 3).alias("proposed_in_run_id"))
    return workspace.run_counters(run_table(spark, sf), seg, coding_table(spark, sf), made)


@query(_REL + " select coalesce(sum(cost), 0)::double as cost from (select run_id % 3 as x, run_id % 1000 / 4.0::double as cost, user_id from runs) where user_id = 5")
def cost_of_user(spark, sf):
    log = run_table(spark, sf).select("run_id", "user_id", (F.col("run_id") % 1000 / F.lit(4.0)).alias("cost"))
    return workspace.user_cost(log, 5)


@query(_REL + " select run_id, user_id, case when run_id % 5 = 0 then 1.5::double else cost end as cost from runs")
def cost_log_upsert(spark, sf):
    log = run_table(spark, sf).select("run_id", "user_id", "cost")
    return workspace.logged(log, log.where("run_id % 5 = 0").withColumn("cost", F.lit(1.5)))


@query(_REL + " select run_id, recorded_at::varchar as at from runs order by recorded_at desc, run_id desc limit 20")
def latest_costs(spark, sf):
    return workspace.latest_costs(run_table(spark, sf)).select("run_id", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(_REL + """ select count(*) as n_documents, count(distinct nullif(grp, '')) as n_groups, count(distinct lang) as n_languages, count(*) filter (where lang is null) as n_without_language,
    count(*) filter (where source_type <> 'excel' and convention is null) as n_unsegmented from docs""")
def corpus_overview(spark, sf):
    return workspace.overview(document_table(spark, sf))


@query(_REL + """, f as (select * from docs where coalesce(lang, '') = '' and coalesce(convention, '') = 'plain') select doc_id, (select count(*) from f) as shown, (select count(*) from docs) as total from f""")
def corpus_filter(spark, sf):
    rows, n = workspace.filtered(document_table(spark, sf), lang="", convention="plain")
    return rows.select("doc_id").crossJoin(F.broadcast(n))  # one row


@query(_REL + """, x as (select doc_id, segment_text, coding_id, coalesce(start_offset, -1) as place from codings where code_id = 'AF' and doc_id % 7 = 0)
select doc_id, count(*) as n, string_agg(segment_text, '|' order by place, coding_id) as extracts from x group by doc_id""")
def extracts_by_document(spark, sf):
    return workspace.extracts(coding_table(spark, sf).where("doc_id % 7 = 0"), "AF").select("doc_id", "n", F.array_join("extracts", "|").alias("extracts"))


@query(_REL + """ select n.name as document, '' as "group", null::int as excel_row, case when coding_id % 2 = 0 then 'S' || coding_id % 3 else '' end as speaker, segment_text, 'code ' || code_id as code, '' as rationale,
    case when coding_id % 3 = 0 then 'a; b' else '' end as matched_expressions, (coding_id % 6)::bigint as relevance_score, start_offset, end_offset, code_id = 'RF' as model_proposed_code
from codings join (select distinct doc_id, 'doc ' || doc_id as name from codings) n using (doc_id)""")
def coding_export(spark, sf):
    c = coding_table(spark, sf)
    rows = c.withColumns({
        "row_no": F.lit(None).cast("int"), "speaker": F.when(F.col("coding_id") % 2 == 0, F.concat(F.lit("S"), (F.col("coding_id") % 3).cast("string"))), "rationale": F.lit(None).cast("string"),
        "matched_expressions": F.when(F.col("coding_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))), "score": F.col("coding_id") % 6,
    })
    named = c.select("doc_id").distinct().select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("grp"))
    codes = c.select("code_id").distinct().select("code_id", F.concat(F.lit("code "), F.col("code_id")).alias("label"), (F.col("code_id") == "RF").alias("is_model_proposed"))
    return reports.coding_rows(rows, named, codes)


@query(C._BOOK + """ select label as "Code", coalesce(description, '') as "Description", '' as "Example", """ + ", ".join(f"""coalesce((select string_agg(expression, '; ' order by expr_id) from exprs e where e.code_id = c.code_id and lang = '{x}'), '') as "Expressions_{x}" """ for x in T.LANGUAGES) + " from codes c where not is_deleted")
def codebook_round_trip(spark, sf):
    """Written as a codebook's table, read again, and written once more."""
    sheet = reports.codebook_rows(*C.book(spark, sf))
    read, exprs = codebook.parsed_rows(numbered(sheet, "ord", [F.col("Code")]))
    again = read.select(F.col("ord").cast("long").alias("code_id"), "label", "description", "example", F.lit(False).alias("is_deleted"))
    expressions = exprs.withColumn("expr_id", F.monotonically_increasing_id()).withColumn("code_id", F.col("ord").cast("long"))
    return reports.codebook_rows(again, expressions)


@query(_REL + """, m as (select doc_id, workspace_id, case when workspace_id = 2 and doc_id in (2, 7, 8, 12) then 'north' else grp end as grp from docs) select doc_id, grp from m""")
def bulk_group(spark, sf):
    return workspace.grouped(document_table(spark, sf), 2, [2, 7, 8, 12], " north ")[0].select("doc_id", "grp")


_DROP = _REL + ", gone as (select doc_id from docs where workspace_id = 1)"


@query(_DROP + " select 'documents' as name, count(*) as n from docs where doc_id not in (select doc_id from gone) union all select 'codings', count(*) from codings where doc_id not in (select doc_id from gone) union all select 'files', count(distinct file_path) from docs where doc_id in (select doc_id from gone) and file_path not in (select file_path from docs where doc_id not in (select doc_id from gone))")
def documents_deleted(spark, sf):
    d = document_table(spark, sf)
    left, unlinked = workspace.without_documents({"documents": d, "codings": coding_table(spark, sf)}, d.where("workspace_id = 1"))
    sizes = [left["documents"], left["codings"], unlinked]
    out = None
    for name, df in zip(("documents", "codings", "files"), sizes, strict=True):
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select p_partkey as code_id, case when p_partkey * 3 % 4 <> 0 then p_partkey * 3 end as proposed_in_run_id from part""")
def runs_deleted_keep_codes(spark, sf):
    codes = C.table(spark, sf, "part").select(F.col("p_partkey").alias("code_id"), (F.col("p_partkey") * 3).alias("proposed_in_run_id"))
    gone = codes.where("proposed_in_run_id % 4 = 0").select(F.col("proposed_in_run_id").alias("run_id"))
    return workspace.without_runs({"runs": run_table(spark, sf), "codings": coding_table(spark, sf), "codes": codes}, gone)["codes"]


@query(_REL + """, m as (select max(doc_id) as top from docs) select doc_id, workspace_id, file_path from docs union all
select top + row_number() over (order by doc_id), 77, file_path from docs, m where workspace_id = 4""")
def workspace_copied(spark, sf):
    tables = {
        "workspaces": spark.range(5).select(F.col("id").alias("workspace_id")), "members": spark.range(5).select(F.col("id").alias("workspace_id"), F.lit(1).cast("long").alias("user_id")),
        "documents": document_table(spark, sf), "codes": C.codes(spark).withColumn("workspace_id", F.lit(4).cast("long")), "expressions": C.expressions(spark),
    }
    return workspace.copied(tables, 4, 77, 2)["documents"].select("doc_id", "workspace_id", "file_path")


# Names, times and small functions.


@query(_REL + """ select doc_id, case when source_type = 'excel' then filename || ' [' || lang || ']' || case when grp <> '' then ' (' || grp || ')' else '' end else filename end as name from docs where lang is not null""")
def display_names(spark, sf):
    d = document_table(spark, sf).where("lang is not null")
    column = F.when(F.col("source_type") == "excel", F.col("lang"))
    return d.select("doc_id", T.display_name(F.col("filename"), column, F.col("grp")).alias("name"))


@query("""with t as (select o_orderkey as k, (o_orderkey % 3 || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') || ':' || lpad((o_custkey % 60)::varchar, 2, '0')) as ts, (o_orderkey * 37 % 9000)::bigint as s, o_orderdate from orders)
select k, ((k % 3) * 3600 + split_part(ts, ':', 2)::int * 60 + split_part(ts, ':', 3)::int)::int as sec, case when s < 60 then s || ' s' when s < 3600 then s // 60 || ' m ' || s % 60 || ' s' else s // 3600 || ' h ' || s % 3600 // 60 || ' m' end as took,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(o_orderdate, '%H:%M:%S') as clock, strftime(o_orderdate, '%Y-%m-%d %H:%M') || ' UTC' as shown from t""")
def times(spark, sf):
    two = lambda x: F.lpad((x % 60).cast("string"), 2, "0")
    o = C.table(spark, sf, "orders")
    ts = F.concat_ws(":", (F.col("o_orderkey") % 3).cast("string"), two(F.col("o_orderkey")), two(F.col("o_custkey")))
    return o.select(F.col("o_orderkey").alias("k"), T.seconds(ts).alias("sec"), T.duration(F.col("o_orderkey") * 37 % 9000).alias("took"), T.iso_time("o_orderdate").alias("iso"), T.clock("o_orderdate").alias("clock"), T.shown_time("o_orderdate").alias("shown"))


_LABELS = "['I:', ' i2 .', 'IV', 'int', 'Mod', 'moderator', 'INTERVIEWER:', 'E', 'Ina', 'I 3', 'S 01:']"


@query(f"""with s as (select c_custkey as k, {_LABELS}[(c_custkey % 11)::int + 1] as said from customer), n as (select k, upper(regexp_replace(regexp_replace(said, '\\s+', '', 'g'), '^[.:]+|[.:]+$', '', 'g')) as speaker from s)
select k, speaker, case when regexp_matches(speaker, '^(I[0-9]*|IV|INT|MOD|MODERATOR|INTERVIEWER)$') then 'interviewer' else 'participant' end as role from n""")
def speaker_roles(spark, sf):
    said = F.element_at(F.array(*(F.lit(x) for x in ["I:", " i2 .", "IV", "int", "Mod", "moderator", "INTERVIEWER:", "E", "Ina", "I 3", "S 01:"])), (F.col("c_custkey") % 11).cast("int") + 1)
    rows = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), T.normalize_speaker(said).alias("speaker"))
    return rows.withColumn("role", T.default_role(F.col("speaker")))


@query("""select s_suppkey as k, (array_to_string(list_transform(string_split(' a;;' || s_name || ' ; b c;', ';'), lambda x: trim(x)), '|')) as raw, array_to_string(list_filter(list_transform(string_split(' a;;' || s_name || ' ; b c;', ';'), lambda x: trim(x)), lambda x: x <> ''), '|') as parts,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(['The ', '', s_name, 'the', ' AND'], lambda x: lower(trim(x))), lambda x: x <> ''))), '|') as stops,
    regexp_replace(s_name || '.DOCX', '\\.(docx|txt|pdf|xlsx)\\b', '', 'gi') as stem from supplier""")
def lists_and_names(spark, sf):
    cell = F.concat(F.lit(" a;;"), F.col("s_name"), F.lit(" ; b c;"))
    stops = T.stoplist(F.array(F.lit("The "), F.lit(""), F.col("s_name"), F.lit("the"), F.lit(" AND")))
    return C.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), F.array_join(F.transform(F.split(cell, ";"), T.strip), "|").alias("raw"), F.array_join(T.split_expressions(cell), "|").alias("parts"), F.array_join(stops, "|").alias("stops"), T.stem_name(F.concat("s_name", F.lit(".DOCX"))).alias("stem")
    )


@query(C._BOOK + f""", p as (select expr_id, expression, lang, starts_with(expression, '"') as phrase, {C._TOK.format("expression")} as toks from exprs)
select expr_id, phrase, n, case n when 0 then 'inert' when 1 then 'weak' end as warning from (select expr_id, phrase, len(case when phrase then toks else list_filter(toks, lambda x: not list_contains({C._STOP}, x)) end)::int as n from p)""")
def expression_warnings(spark, sf):
    rows = C.book(spark, sf)[1].withColumn("phrase", T.is_phrase("expression")).withColumn("n", F.size(T.expression_lemmas(F.col("expression"), F.col("lang"))))
    return rows.select("expr_id", "phrase", "n", codebook.lemma_warning(F.col("n")).alias("warning"))


@query("""select lk as k, unit, source_type, case when source_type = 'excel' and unit in ('cell', 'sentence') then unit when source_type = 'excel' or unit = 'per_utterance' then 'paragraph' when unit = 'per_row' then 'document' else unit end as resolved
from (select c_custkey as lk, ['cell', 'sentence', 'per_row', 'per_utterance', 'document'][(c_custkey % 5)::int + 1] as unit, case when c_custkey % 2 = 0 then 'excel' else 'docx' end as source_type from customer)""")
def legacy_units(spark, sf):
    unit = F.element_at(F.array(*(F.lit(x) for x in ("cell", "sentence", "per_row", "per_utterance", "document"))), (F.col("c_custkey") % 5).cast("int") + 1)
    rows = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), unit.alias("unit"), F.when(F.col("c_custkey") % 2 == 0, "excel").otherwise("docx").alias("source_type"))
    return rows.withColumn("resolved", U.resolved_unit(F.col("unit"), F.col("source_type"), F.lit("paragraph")))


# Workbooks as cells.

_CELLS = """with cells as (select 'b.xlsx' as filename, 's' as sheet, p_partkey::int + 1 as row_no, x.c as "column", trim(x.t) as text
    from part, unnest([{'c': 'brand', 't': p_brand}, {'c': 'type', 't': case when p_size % 3 = 0 then '' else p_type end}, {'c': 'size', 't': case when p_size % 11 = 0 then ' ' else 'g' || p_size % 6 end}]) as u(x) where trim(x.t) <> '')"""


def cell_table(spark: SparkSession, sf: str) -> DataFrame:
    column = lambda name, text: F.struct(F.lit(name).alias("column"), T.strip(text).alias("text"))
    size = F.col("p_size")
    values = F.array(
        column("brand", F.col("p_brand")), column("type", F.when(size % 3 == 0, "").otherwise(F.col("p_type"))),
        column("size", F.when(size % 11 == 0, " ").otherwise(F.concat(F.lit("g"), (size % 6).cast("string")))),
    )
    rows = C.table(spark, sf, "part").select(F.lit("b.xlsx").alias("filename"), F.lit("s").alias("sheet"), (F.col("p_partkey") + 1).cast("int").alias("row_no"), F.explode(values).alias("x"))
    return rows.select("filename", "sheet", "row_no", "x.column", "x.text").where("text <> ''")


@query(_CELLS + """ select "column", count(*) as n, array_to_string(list_slice(list(text order by row_no), 1, 3), '|') as samples from cells group by 1""")
def workbook_profile(spark, sf):
    return files.profiled(cell_table(spark, sf)).select("column", "n", F.array_join("samples", "|").alias("samples"))


@query(_CELLS + """ select c.row_no, c.text from cells c join cells g using (row_no) where c."column" = 'type' and g."column" = 'size' and g.text = 'g2'""")
def workbook_column(spark, sf):
    return files.column_cells(cell_table(spark, sf), "type", "size", "g2").select("row_no", "text")


@query(_CELLS + """ select c."column", g.text as grp, count(*) as n from cells c join cells g using (row_no) where c."column" in ('type', 'brand') and g."column" = 'size' group by 1, 2""")
def workbook_documents(spark, sf):
    return files.group_documents(cell_table(spark, sf), ["type", "brand"], "size").select("column", "grp", "n")


@query(_CELLS + """ select row_no % 20 as doc_id, string_agg('[R' || row_no || '] ' || text, chr(10) order by row_no) as text from cells where "column" = 'type' group by 1""")
def workbook_full_text(spark, sf):
    rows = cell_table(spark, sf).where("column = 'type'").withColumn("doc_id", F.col("row_no") % 20)
    return segment.full_text_of_cells(rows)


# Transcripts.

_TIME = "lpad((turn * 7 // 60)::varchar, 2, '0') || ':' || lpad((turn * 7 % 60)::varchar, 2, '0')"
_LINES = f"""with said as (select conv_id as doc_id, turn, upper(role) as who, coalesce(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''), 'nothing') as t, '00:' || {_TIME} as ts, '0:' || {_TIME} as short from conversations),
text as (select doc_id, string_agg(case doc_id % 6 when 0 then who || ' [' || ts || ']: ' || t when 1 then who || ': ' || t || ' #' || short || '-1#' when 2 then who || ': ' || t when 3 then '[' || ts || '] ' || who || ': ' || t
    when 4 then '[' || ts || '.000] - ' || who || chr(10) || t else t end, chr(10) order by turn) as text from said group by doc_id),
lines as (select doc_id, i - 1 as line_no, ls[i] as line from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ls from text), unnest(range(1, len(ls) + 1)) as u(i))"""


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text: conversations in six layouts."""
    c = C.table(spark, sf, "conversations")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    seconds = F.col("turn") * 7
    time = F.concat(two(F.floor(seconds / 60)), F.lit(":"), two(seconds % 60))
    t = F.coalesce(F.nullif(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")), F.lit("nothing"))
    rows = c.select(F.col("conv_id").alias("doc_id"), "turn", F.upper("role").alias("who"), t.alias("t"), F.concat(F.lit("00:"), time).alias("ts"), F.concat(F.lit("0:"), time).alias("short"))
    kind = F.col("doc_id") % 6
    line = (
        F.when(kind == 0, F.expr("concat(who, ' [', ts, ']: ', t)")).when(kind == 1, F.expr("concat(who, ': ', t, ' #', short, '-1#')")).when(kind == 2, F.expr("concat(who, ': ', t)"))
        .when(kind == 3, F.expr("concat('[', ts, '] ', who, ': ', t)")).when(kind == 4, F.expr("concat('[', ts, '.000] - ', who, '\\n', t)")).otherwise(F.col("t"))
    )
    listed = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


_CANDS = ", ".join(f"({i}, '{k}', {'true' if p.timed else 'false'}, '{p.regex}')" for i, (k, p) in enumerate(conventions.candidates()))
_PLACE = {k: (p.group("speaker"), p.group("ts"), p.group("text")) for k, p in conventions.candidates()}
_GET = lambda j: "case name " + " ".join(f"when '{k}' then {f'regexp_extract(line, {chr(39)}{conventions.PRESETS[k]}{chr(39)}, {g[j]})' if g[j] else 'null'}" for k, g in _PLACE.items()) + " end"
_PARSED = _LINES + f""", cands(ord, name, timed, regex) as (values {_CANDS}),
fits as (select doc_id, line_no, line, ord, name, timed, case name {" ".join(f"when '{k}' then regexp_matches(line, '{v}')" for k, v in conventions.PRESETS.items())} end as ok, {_GET(0)} as sp, {_GET(1)} as ts, {_GET(2)} as body from lines cross join cands),
turns as (select *, upper(regexp_replace(regexp_replace(sp, '\\s+', '', 'g'), '^[.:]+|[.:]+$', '', 'g')) as speaker from fits)"""
_DETECT = _PARSED + f""", heads as (select *, ok and speaker <> '' as turn, case when ok and speaker <> '' and ts <> '' then split_part(ts, ':', 1)::int * 3600 + split_part(ts, ':', 2)::int * 60 + split_part(ts, ':', 3)::int end as sec from turns where line_no < 400),
stamped as (select doc_id, ord, sec, lag(sec) over (partition by doc_id, ord order by line_no) as before from heads where sec is not null),
st as (select doc_id, ord, count(*) as n_ts, count(*) filter (where sec >= before) as n_ordered from stamped group by 1, 2),
ln as (select doc_id, ord, name, timed, count(*) as n_lines, count(*) filter (where turn) as turn_lines from heads group by 1, 2, 3, 4),
sp as (select doc_id, ord, speaker, count(*) as n from heads where turn group by 1, 2, 3),
rec as (select doc_id, ord, count(*) as recurring, sum(n) as recurring_turns, list(speaker order by speaker) as speakers from sp where n >= 2 group by 1, 2),
sc as (select ln.doc_id, ln.ord, name, speakers, 0.6::double * turn_lines / n_lines + case when coalesce(recurring, 0) between 2 and 12 and recurring_turns >= 0.8::double * turn_lines then 0.25::double else 0 end
    + case when coalesce(n_ts, 0) >= 3 and n_ordered >= 0.9::double * (n_ts - 1) then 0.15::double else 0 end + case when timed then 0.03::double else 0 end as raw
    from ln left join st using (doc_id, ord) left join rec on rec.doc_id = ln.doc_id and rec.ord = ln.ord where turn_lines > 0),
best as (select *, {C._rounded("raw", 3)} as score, row_number() over (partition by doc_id order by {C._rounded("raw", 3)} desc, ord) as r from sc)"""


@query(_DETECT + """ select doc_id, name, score, coalesce(array_to_string(speakers, '|'), '') as speakers, coalesce(array_to_string(list_transform(speakers, lambda x: case when regexp_matches(x, '^(I[0-9]*|IV|INT|MOD|MODERATOR|INTERVIEWER)$') then 'interviewer' else 'participant' end), '|'), '') as roles
from best where r = 1 and score >= 0.45""")
def detect_conventions(spark, sf):
    found = conventions.detect(transcripts(spark, sf), conventions.candidates())
    return found.select("doc_id", "name", "score", F.array_join("speakers", "|").alias("speakers"), F.array_join(F.transform("speakers", T.default_role), "|").alias("roles"))


#: Turns of the layout that a document is written in; the sixth has none, and is read as the workspace's pattern says.
_KINDS = ["default", "f4", "plain", "ts_lead", "happyscribe"]
_OWN = _PARSED + f""", mine as (select doc_id, line_no, line, ok and speaker in ('USER', 'ASSISTANT', 'SYSTEM') as turn, speaker, ts, trim(body) as body from turns where ord = doc_id % 6
    union all select doc_id, line_no, line, regexp_matches(line, '{conventions.POSITIONAL}') and false, '', '', '' from lines where doc_id % 6 = 5),
flow as (select doc_id, line_no, turn, case when turn then body else line end as body, case when turn then nullif(ts, '') end as ts,
    last_value(case when turn then speaker end ignore nulls) over w as speaker, not bool_or(turn) over w as front from mine window w as (partition by doc_id order by line_no rows between unbounded preceding and current row)),
-- a turn without text takes the next line; layouts alternate, so that pairs do not chain
merged as (select *, coalesce(lag(turn and body = '') over o, false) as after_head, lag(ts) over o as head_ts from flow window o as (partition by doc_id order by line_no)),
spoken as (select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as pos, body, speaker, case when after_head and not turn then head_ts else ts end as ts, front,
    front or coalesce(speaker in ('SYSTEM'), false) as excluded from merged where body <> '')"""


def transcript_documents(spark: SparkSession, sf: str) -> DataFrame:
    kind = (F.col("doc_id") % 6).cast("int")
    roles = F.create_map(F.lit("user"), F.lit("participant"), F.lit("assistant"), F.lit("participant"), F.lit("system"), F.lit("other"))
    upper = F.transform_keys(roles, lambda k, v: F.upper(k))
    return transcripts(spark, sf).select("doc_id", "text", F.lit("docx").alias("source_type"), F.lit("en").alias("lang"), F.get(F.array(*(F.lit(k) for k in _KINDS)), kind).alias("convention"), upper.alias("roles"))


def transcript_units(spark: SparkSession, sf: str, unit: str, context: int = 0) -> DataFrame:
    found, _ = U.units_for(transcript_documents(spark, sf), unit, U.Workspace(excluded_roles=("other",)), context=context)
    return found


@query(_OWN + " select doc_id, pos::int as position, speaker, ts, body as text, excluded from spoken")
def transcript_turns(spark, sf):
    return transcript_units(spark, sf, "utterance_regex").select("doc_id", "position", "speaker", "ts", "text", "excluded")


@query(_OWN + f""", cut as (select doc_id, pos, speaker, excluded or front or doc_id % 6 = 5 as whole, case when excluded then [body] else {C._SENTS.format("body")} end as parts, excluded from spoken),
parts as (select doc_id, pos, i, speaker, excluded, parts[i] as text from cut, unnest(range(1, len(parts) + 1)) as u(i)),
plain as (select doc_id, line_no as pos, {C._SENTS.format("line")} as parts from lines where doc_id % 6 = 5),
both_ as (select doc_id, pos, i, speaker, excluded, text from parts where doc_id % 6 <> 5 union all select doc_id, pos, i, null, false, parts[i] from plain, unnest(range(1, len(parts) + 1)) as u(i))
select doc_id, (row_number() over (partition by doc_id order by pos, i) - 1)::int as position, speaker, text, excluded from both_""")
def transcript_sentences(spark, sf):
    return transcript_units(spark, sf, "sentence").select("doc_id", "position", "speaker", "text", "excluded")


@query(_OWN + """ select doc_id, pos::int as position, coalesce(lag(coalesce(speaker || ': ', '') || body, 2) over w || chr(10), '') || coalesce(lag(coalesce(speaker || ': ', '') || body, 1) over w, '') as context from spoken window w as (partition by doc_id order by pos)""")
def transcript_context(spark, sf):
    return transcript_units(spark, sf, "utterance_regex", 2).select("doc_id", "position", runs.format_context(F.col("context")).alias("context"))


@query(_LINES + " select doc_id, array_to_string(list_slice(list(line order by line_no), 1, 25), chr(10)) as lines from lines group by doc_id")
def sample_lines(spark, sf):
    return conventions.samples(transcripts(spark, sf), 25).select("doc_id", F.array_join("lines", "\n").alias("lines"))


@query(C._BASE + " select doc_id, position, text from units where position < 12")
def pasted_preview(spark, sf):
    """The first 12 units of each text that is pasted."""
    return U.previews(C.docs(spark, sf), "cell").select("doc_id", "position", "text")


#: Units in the order of lines, where some are asked for late, some twice, and some are nowhere.
_DRIFTED = _LINES.replace("with said", "with recursive said", 1) + """, n as (select doc_id, count(*) as n from lines group by 1),
coded as (select doc_id, ord, case when ord % 7 = 6 then line || '!' || ord when ord % 5 = 4 then prev else line end as t from (
    select l.doc_id, (case when l.line_no % 4 = 1 then (l.line_no + 2) else l.line_no end * 10 + l.line_no % 4)::int as ord, line, coalesce(lag(line) over (partition by l.doc_id order by case when l.line_no % 4 = 1 then l.line_no + 2 else l.line_no end * 10 + l.line_no % 4), line) as prev from lines l)),
placed as (select *, row_number() over (partition by doc_id order by ord) as k from coded)"""
_FOLD = """, walk as (
    select doc_id, 0::bigint as k, 0::bigint as cur, null::varchar as last, null::bigint as s, null::bigint as e, null::int as ord, null::varchar as t from n
    union all
    select doc_id, k, case when again or found < 0 then cur else found + length(t) end, t, case when again then s when found >= 0 then found else {start} end, case when again then e when found >= 0 then found + length(t) else {end} end, ord, t
    from (select w.doc_id, p.k, w.cur, w.last, w.s, w.e, p.ord, p.t, length(text) as full_length, {again} as again,
            case when strpos(substr(text, w.cur + 1), p.t) > 0 then w.cur + strpos(substr(text, w.cur + 1), p.t) - 1 else strpos(text, p.t) - 1 end as found
        from walk w join placed p on p.doc_id = w.doc_id and p.k = w.k + 1 join text on text.doc_id = w.doc_id))"""


def drifted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(transcripts, units: doc_id, ord, text), of which the SQL is _DRIFTED."""
    t = transcripts(spark, sf)
    late = F.when(F.col("line_no") % 4 == 1, F.col("line_no") + 2).otherwise(F.col("line_no"))
    rows = segment.lines(t).select("doc_id", (late * 10 + F.col("line_no") % 4).cast("int").alias("ord"), "line")
    before = F.coalesce(F.lag("line").over(Window.partitionBy("doc_id").orderBy("ord")), "line")
    text = F.when(F.col("ord") % 7 == 6, F.concat("line", F.lit("!"), F.col("ord").cast("string"))).when(F.col("ord") % 5 == 4, before).otherwise(F.col("line"))
    return t, rows.select("doc_id", "ord", text.alias("text"))


@query(_DRIFTED + _FOLD.format(again="false", start="0", end="length(t)") + " select doc_id, ord as position, t as text, s::int as start_offset, e::int as end_offset from walk where k > 0")
def offsets_of_drifted_units(spark, sf):
    """Forward, backward and absent texts."""
    t, rows = drifted(spark, sf)
    return segment.anchored(t, rows.withColumnRenamed("ord", "position"))


@query(_DRIFTED + _FOLD.format(again="coalesce(w.last = p.t, false)", start="case when ord % 2 = 0 then 3 else 0 end", end="case when ord % 2 = 0 then 9 else full_length end")
    + " select doc_id, ord, t as text, s::int as start_offset, e::int as end_offset from walk where k > 0")
def reanchored_codings(spark, sf):
    """Codings whose stored offsets are wrong, of which every second one has none; texts that follow themselves keep their span."""
    t, rows = drifted(spark, sf)
    even = F.col("ord") % 2 == 0
    return segment.reanchored(t, rows.withColumns({"start_offset": F.when(even, 3), "end_offset": F.when(even, 9)}))


@query(_DETECT + ", b as (select doc_id, name from best where r = 1 and score >= 0.45) select t.doc_id, b.name as convention from text t left join b using (doc_id)")
def documents_redetected(spark, sf):
    t = transcript_documents(spark, sf).withColumn("convention", F.lit("old"))
    return workspace.redetected(t).select("doc_id", "convention")


@query(_DETECT + """, b as (select doc_id, speakers from best_of where name = 'plain')
select t.doc_id, case when t.doc_id = 2 then 'plain' else 'old' end as convention, case when t.doc_id = 2 then 'fr' else 'en' end as lang, case when t.doc_id = 2 then 'north' end as grp,
    case when t.doc_id = 2 then coalesce((select array_to_string(list_transform(speakers, lambda x: x || '=' || case when regexp_matches(x, '^(I[0-9]*|IV|INT|MOD|MODERATOR|INTERVIEWER)$') then 'interviewer' else 'participant' end), '|') from b where b.doc_id = 2), '')
    else (select string_agg(who || '=other', '|' order by who) from (select distinct who from said where said.doc_id = t.doc_id)) end as roles from text t""".replace("best_of", "sc"))
def convention_changed(spark, sf):
    """Document 2 gets a convention, and with it the roles of the speakers who recur in it; a language and a group. All others stay."""
    t = _with_speakers(spark, sf).withColumn("convention", F.lit("old")).withColumn("grp", F.lit(None).cast("string"))
    new = workspace.described(t, 2, convention="plain", lang="fr", grp=" north ")
    return new.select("doc_id", "convention", "lang", "grp", _shown_roles())


def _with_speakers(spark, sf):
    """Transcripts with a role for each speaker who is in them."""
    c = C.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_set(F.upper("role"))).alias("who"))
    rows = transcript_documents(spark, sf).drop("roles").join(c, "doc_id")
    return rows.withColumn("roles", F.map_from_arrays("who", F.transform("who", lambda x: F.lit("other")))).drop("who")


def _shown_roles():
    pairs = F.transform(F.array_sort(F.map_entries("roles")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return F.array_join(pairs, "|").alias("roles")


@query(_LINES + """ select doc_id, case when doc_id = 2 then 'ASSISTANT=interviewer|USER=participant' else string_agg(who || '=other', '|' order by who) end as roles from (select distinct doc_id, who from said) group by doc_id""")
def roles_replaced(spark, sf):
    """Document 2's roles, by speakers as they are typed; all others keep theirs."""
    new = workspace.with_roles(_with_speakers(spark, sf), 2, {" user:": "other", "assist ant": "interviewer", " : ": "other", "User": "participant"})
    return new.select("doc_id", _shown_roles())


@query(_DETECT + f""", b as (select doc_id, name, speakers from best where r = 1 and score >= 0.45), votes(v, words) as (values {C._VOTES}),
seq as (select doc_id, {C._TOK.format("substr(text, 1, 5000)")} as seq from text),
counted as (select doc_id, v, len(list_filter(seq, lambda x: list_contains(words, x))) as n from seq cross join votes),
lang as (select doc_id, case when n > 0 then v end as lang from (select *, row_number() over (partition by doc_id order by n desc, v) as r from counted) where r = 1)
select t.doc_id, lang, b.name as convention, coalesce(array_to_string(list_transform(speakers, lambda x: x || '=' || case when regexp_matches(x, '^(I[0-9]*|IV|INT|MOD|MODERATOR|INTERVIEWER)$') then 'interviewer' else 'participant' end), '|'), '') as roles
from text t left join b using (doc_id) left join lang using (doc_id)""")
def documents_redetected_whole(spark, sf):
    """Language (of the first 5,000 characters, as is the feature), convention and roles of every transcript."""
    t = _with_speakers(spark, sf).withColumn("convention", F.lit("old"))
    return workspace.redetected(t).select("doc_id", "lang", "convention", F.coalesce(_shown_roles(), F.lit("")).alias("roles"))


@query(C._ALL + """, f as (select label, count(*) as v from codings group by 1) select label, v::double as value, (row_number() over (order by v desc, label))::int as ord, (select max(v) from f)::double as most from f""")
def chart_of_codes(spark, sf):
    rows = reports.chart_rows(C.analysis(spark, sf), "codes")
    return rows.crossJoin(F.broadcast(reports.chart_scale(rows)))  # one row


@query(C._ALL + C._LEM + """, f as (select lemma, count(*) as v from lem join codings using (doc_id, position) where label = 'alpha' group by 1) select * from (select lemma as label, v::double as value, (row_number() over (order by v desc, lemma))::int as ord from f) where ord <= 20""")
def chart_of_lemmas(spark, sf):
    a = C.analysis(spark, sf)
    return reports.chart_rows(a, "lemmas", "alpha")


@query()
def pages_as_lines(spark, sf):
    """The pages' HTML as text; beyond SQL."""
    return C.table(spark, sf, "pages").select("page_id", files.html_lines(F.col("html")).alias("text"))


@query(C._BOOK + """, c as (select label, code_id, any_value(description) as d, list({'lang': lang, 'expression': expression} order by expr_id) filter (where expr_id is not null) as e from codes left join exprs using (code_id) where not is_deleted group by 1, 2)
select '[' || string_agg('{"label":"' || label || '","code_id":' || code_id || ',"description":"' || coalesce(d, '') || '","expressions":[' || coalesce(array_to_string(list_transform(e, lambda x: '{"lang":"' || x.lang || '","expression":"' || replace(x.expression, '"', '\\"') || '"}'), ','), '') || ']}', ',' order by label) || ']' as codebook from c""")
def codebook_snapshot(spark, sf):
    return workspace.snapshot(*C.book(spark, sf))


@query("""with a as (select doc_id, case doc_id % 5 when 3 then text else case doc_id % 5 when 1 then 'so:' || chr(10) || '```json' || chr(10) else '' end
    || case when doc_id % 5 = 4 then '{"action":"no_code"}' else '[{"action":"create_new","code":" ' || source || ' ","rationale":"r"},{"code":"' || lang || '"},{"action":"use_existing","code":"  "},{"action":"no_code","rationale":" ' || n_chars || ' "},{"action":"no_code"}'
    || case when doc_id % 5 = 2 then ',{"action":"no_code","rationale":"' || lang || '","code":"' || source || '"}' else '' end || ']' end || case doc_id % 5 when 1 then chr(10) || '```' else '' end end as answer from documents),
b as (select doc_id, case when contains(answer, '```') then trim(regexp_extract(answer, '(?s)```(?:json)?\\s*(.*?)```', 1), chr(10) || ' ') else trim(answer) end as body from a),
e as (select doc_id, case when body[1] = '[' and json_valid(body) then json_transform(body, '[{"action":"VARCHAR","code":"VARCHAR","rationale":"VARCHAR"}]') end as es from b)
select doc_id, coalesce(array_to_string(list_sort(list_transform(list_filter(es, lambda x: coalesce(x.action, '') <> 'no_code' and trim(coalesce(x.code, '')) <> ''), lambda x: trim(x.code))), '|'), '') as labels,
    nullif(array_to_string(list_filter(list_transform(list_filter(es, lambda x: x.action = 'no_code'), lambda x: trim(coalesce(x.rationale, ''))), lambda x: x <> ''), ' | '), '') as no_code_rationale, es is null as failed from e""")
def model_answers_parsed(spark, sf):
    """Answers that name a document's source, language and length as codes and reasons; in a fenced block, of another form, or its text alone."""
    d = C.table(spark, sf, "documents")
    kind, q = F.col("doc_id") % 5, F.lit
    entries = F.concat(
        q('[{"action":"create_new","code":" '), "source", q(' ","rationale":"r"},{"code":"'), "lang", q('"},{"action":"use_existing","code":"  "},{"action":"no_code","rationale":" '), F.col("n_chars").cast("string"), q(' "},{"action":"no_code"}'),
        F.when(kind == 2, F.concat(q(',{"action":"no_code","rationale":"'), "lang", q('","code":"'), "source", q('"}'))).otherwise(""), q("]"),
    )
    answer = F.when(kind == 3, F.col("text")).when(kind == 4, '{"action":"no_code"}').when(kind == 1, F.concat(q("so:\n```json\n"), entries, q("\n```"))).otherwise(entries)
    rows = d.select("doc_id", F.lit(0).alias("position"), answer.alias("answer"))
    named, failed, why = runs.model_entries(rows)
    labels = named.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"))
    out = rows.select("doc_id").join(labels, "doc_id", "left").join(why.select("doc_id", "no_code_rationale"), "doc_id", "left")
    out = out.join(failed.select("doc_id", F.lit(True).alias("bad")), "doc_id", "left")
    return out.select("doc_id", F.coalesce("labels", F.lit("")).alias("labels"), "no_code_rationale", F.coalesce("bad", F.lit(False)).alias("failed"))


@query(C._ALL + """, f as (select m.doc_id, m.position, m.code_id, expression, min(sent) as s, min_by(expr_id, sent * 1000 + expr_id) as e from matches m group by 1, 2, 3, 4),
one as (select doc_id, position, code_id, min_by(sentence, sent) as sentence from matches group by 1, 2, 3)
select doc_id, position, f.code_id::bigint as code_id, 'Matched expressions: ' || string_agg(expression, ', ' order by s, e) || ' — in: "' || any_value(sentence) || '"' as rationale from f join one using (doc_id, position, code_id) group by 1, 2, f.code_id""")
def dictionary_rationales(spark, sf):
    return C.codings(spark, sf).select("doc_id", "position", "code_id", "rationale")


@query(C._ALL + """ select 'document ' || s.doc_id as document, null::int as excel_row, '' as speaker, s.position, s.text as segment_text, s.status, coalesce(x.codes, '') as codes, '' as no_code_rationale from segs s
    left join (select doc_id, position, string_agg(label, '; ' order by code_id) as codes from codings group by 1, 2) x using (doc_id, position)""")
def run_segments_sheet(spark, sf):
    """The segments sheet of a run's workbook, as run_sheets gives it."""
    a = C.analysis(spark, sf)
    own = a.segments_export().withColumns({"row_no": F.lit(None).cast("int"), "speaker": F.lit(None).cast("string")})
    placed = a.segments.select("doc_id", "position", "text")
    coded = a.codings.join(placed, ["doc_id", "position"]).select(
        (F.col("doc_id") * 100_000 + F.col("position")).alias("coding_id"), "doc_id", "code_id", F.lit(None).cast("int").alias("row_no"), F.lit(None).cast("string").alias("speaker"), F.col("text").alias("segment_text"),
        "rationale", "matched_expressions", "score", F.lit(None).cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset"),
    )
    codes = C.codes(spark).withColumn("is_model_proposed", F.lit(False))
    return reports.run_sheets(C.RUN, coded, own, a.documents, codes, C.expressions(spark))["segments"]


@query(_REL + """ select run_id, n, case when n <= 0 then 0 when run_id % 2 = 0 then floor(8.0::double + n * 0.012::double)::bigint else -(-n // (run_id % 5 + 1)) * 4 end as seconds from (select run_id, (run_id % 40 - 5)::bigint as n from runs)""".replace("-(-n // (run_id % 5 + 1))", "ceil(n / (run_id % 5 + 1)::double)::bigint"))
def run_seconds(spark, sf):
    rows = run_table(spark, sf).select("run_id", (F.col("run_id") % 40 - 5).alias("n"))
    return rows.withColumn("seconds", runs.estimated_seconds(F.when(F.col("run_id") % 2 == 0, "dictionary").otherwise("llm"), F.col("n"), F.col("run_id") % 5 + 1))


@query(_REL + """ select doc_id, (row_number() over (order by lower(coalesce(grp, '')) desc, doc_id))::bigint - 1 as ord from docs""")
def documents_sorted(spark, sf):
    """The order in which a table of documents stands after a click on its group."""
    return workspace.in_order(document_table(spark, sf), "grp", falling=True).select("doc_id", "ord")


@query("""select distinct c_nationkey::bigint as workspace_id, c_custkey % 7 as user_id from customer union select 3, 99""")
def members_and_user(spark, sf):
    members = C.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("workspace_id"), (F.col("c_custkey") % 7).alias("user_id"))
    return workspace.with_member(members, 3, 99)


@query(C._BOOK + """, lows as (select min(code_id) as a, max(code_id) as z from codes where not is_deleted), t as (select max(code_id) as top from codes)
select code_id, case when code_id = (select a from lows) then 'A new name' else label end as label, is_deleted or code_id = (select z from lows) as is_deleted from codes union all select top + 1, 'Added', false from t""")
def codebook_changed(spark, sf):
    """A code is renamed, one deleted, one added."""
    codes, _ = C.book(spark, sf)
    a, z, top = codes.agg(F.min(F.when(~F.col("is_deleted"), F.col("code_id"))), F.max(F.when(~F.col("is_deleted"), F.col("code_id"))), F.max("code_id")).first()
    new = codebook.with_code(codebook.soft_deleted(codebook.renamed(codes, a, "A new name"), z), " Added ", top + 1)
    return new.select("code_id", "label", "is_deleted")


@query(C._BOOK + """, one as (select min(code_id) as a from codes), t as (select max(expr_id) as top from exprs), w as (select p_name as x, min(p_partkey) as o from part group by 1 union all select upper(p_name), max(p_partkey) from part group by 1),
k as (select lower(x) as l, min(o) as o from w group by 1)
select expr_id, code_id, lang, expression from exprs where code_id <> (select a from one)
union all select top + row_number() over (order by k.o), a, 'en', w.x from k join w on lower(w.x) = k.l and w.o = k.o, t, one""")
def expressions_replaced(spark, sf):
    """A code's expressions replaced by all names of parts, in two spellings: case does not tell them apart."""
    codes, exprs = C.book(spark, sf)
    parts = C.table(spark, sf, "part")
    names = parts.groupBy(F.col("p_name").alias("x")).agg(F.min("p_partkey").alias("ord"), F.max("p_partkey").alias("last"))
    wanted = names.select("ord", F.lit("en").alias("lang"), F.col("x").alias("expression")).unionByName(names.select(F.col("last").alias("ord"), F.lit("en").alias("lang"), F.upper("x").alias("expression")))
    return codebook.with_expressions(exprs, codes.agg(F.min("code_id")).first()[0], wanted, exprs.agg(F.max("expr_id")).first()[0] + 1)


@query(_LINES + f""", parsed as (select doc_id, line_no, line, regexp_extract(line, '^(?:\\[[^\\]]*\\] )?([A-Z]+)[: ]', 1) as speaker from lines) select doc_id, line_no::int as line_no, speaker <> '' as turn, nullif(speaker, '') as speaker from parsed""")
def lines_by_own_pattern(spark, sf):
    """A workspace's own pattern, as it is added to its library and then read with."""
    mine = conventions.with_convention({}, "mine", r"^(?:\[[^\]]*\] )?(?P<speaker>[A-Z]+)[: ](?P<text>.*)$")
    pattern = dict(conventions.candidates(mine))["mine"]
    return segment.parsed_lines(segment.lines(transcripts(spark, sf)), pattern).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "turn", "speaker")


_PROPS = """with p as (select event_id, user_id, case event_id % 11 when 3 then props[1 : -2] when 5 then '{"k": "' || event_type || '"}' when 7 then ' ' else props end as props from events)"""


def _props(spark, sf):
    kind, props = F.col("event_id") % 11, F.col("props")
    broken = F.when(kind == 3, F.substring(props, F.lit(1), F.length(props) - 1)).when(kind == 5, F.concat(F.lit('{"k": "'), "event_type", F.lit('"}'))).when(kind == 7, " ").otherwise(props)
    rows = C.table(spark, sf, "events").select("event_id", broken.alias("props"))
    return stored.read_json(rows, "props", "struct<k:bigint>", ("event_id",))


@query(_PROPS + " select event_id, case when event_id % 11 not in (3, 5, 7) then (props::json->>'k')::bigint end as k from p")
def json_column_read(spark, sf):
    """A JSON column by its schema; a text that is cut off, or of another type, reads as null."""
    return _props(spark, sf)[0].select("event_id", F.col("props.k").alias("k"))


@query(_PROPS + " select event_id, props as text from p where event_id % 11 in (3, 5)")
def json_column_malformed(spark, sf):
    return _props(spark, sf)[1]


@query(C._ALL + C._LEM + """, c2 as (select distinct doc_id, position, code_id, label from codings), g as (select distinct grp from segs), l as (select distinct label from c2),
x as (select lang, lemma from lem group by 1, 2), y as (select lang, label, lemma from lem join codings using (doc_id, position) group by 1, 2, 3), z as (select lang, label, grp, lemma from lem join codings using (doc_id, position) group by 1, 2, 3, 4),
e as (select distinct m.doc_id, m.code_id, expression from matches m), f as (select d.lang, code_id, expression from e join documents d using (doc_id) where d.lang in (""" + C._LANGS + """) group by 1, 2, 3),
h as (select d.lang, d.source, code_id, expression from e join documents d using (doc_id) where d.lang in (""" + C._LANGS + """) group by 1, 2, 3, 4), t as (select label, grp, least(count(*), 5) as n from codings join units using (doc_id, position) group by 1, 2)
select 'codes' as sheet, count(*)::bigint as n from l union all select 'groups', (select count(*) from l) * (select count(*) from g) union all select 'cooccurrence', count(*) from l union all select 'documents', count(distinct doc_id) from segs
union all select 'lemmas_' || lang, count(*) from x group by lang union all select 'lemmas_by_code_' || lang, count(*) from y group by lang union all select 'lemmas_by_code_group_' || lang, count(*) from z group by lang
union all select 'expressions_' || lang, count(*) from f group by lang union all select 'expr_by_code_group_' || lang, count(*) from h group by lang union all select 'top_extracts', sum(n)::bigint from t""")
def analysis_workbook(spark, sf):
    """The sheets of an analysis's workbook, and how many rows each has."""
    out = None
    for name, df in reports.analysis_sheets(C.analysis(spark, sf)).items():
        one = df.agg(F.lit(name).alias("sheet"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# A run of a model coder, which is a plain function here: it names a unit's length, fails on some, and answers in a wrong form on a few.


def _ask(system: str, message: str) -> str:
    n = len(message.split("To be coded:\n")[1])
    if n % 11 == 0:
        raise KeyError("no answer")
    if n % 53 == 0:
        return '{"x": 1}'
    if n % 4 == 0:
        return f'[{{"action": "no_code", "rationale": " len {n} "}}, {{"action": "no_code"}}]'
    return f'so:\n```json\n[{{"action": "create_new", "code": " Kind-{n % 7} "}}, {{"code": "parity {n % 2}"}}, {{"code": " "}}]\n```'


_MODEL = """with u as (select conv_id as doc_id, (row_number() over (partition by conv_id order by turn) - 1)::int as position, coalesce(role = 'system', false) as excluded, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as n from conversations),
bad as (select distinct doc_id from u where not excluded and n % 11 <> 0 and n % 53 = 0),
said as (select *, case when excluded then 'excluded' when n % 11 = 0 then 'error' when n % 4 = 0 then 'no_code' else 'coded' end as status from u where doc_id not in (select doc_id from bad)),
named as (select doc_id, position, i, case i when 0 then 'Kind-' || n % 7 else 'parity ' || n % 2 end as label from said, unnest([0, 1]) as t(i) where status = 'coded'),
book as (select label, case label when 'parity 0' then 1 else 1 + row_number() over (partition by label <> 'parity 0' order by a) end as code_id from (select label, min(doc_id * 1000000 + position * 10 + i) as a from named group by 1 union select 'parity 0', -1 where 'parity 0' not in (select label from named)))"""


def _model_run(spark, sf):
    """(segments, codings, the run's documents, the codebook) of a model run over conversations."""
    t = C._turns(spark, sf)
    units = t.select("doc_id", "position", "speaker", "text", F.coalesce(F.col("speaker") == "system", F.lit(False)).alias("excluded"))
    codes = C.local(spark, [(1, "Parity_0", None, None, False, None)], codebook.CODES)
    todo = units.select(F.lit(5).cast("long").alias("run_id"), "doc_id", F.lit("pending").alias("status")).distinct()
    none = C.local(spark, [(0, "")], "doc_id long, reason string").where("false")
    root = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    done, grown = facts.execute(5, units, none, todo, facts.ModelCoder(_ask), root, codes)
    segments, codings = facts.read_facts(spark, root, 5)
    return segments, codings, done, grown


@query(_MODEL + """ select s.doc_id, s.position, status, case when status = 'no_code' then 'len ' || n end as no_code_rationale, coalesce((select string_agg(b.code_id, ',' order by i) from named m join book b using (label) where m.doc_id = s.doc_id and m.position = s.position), '') as code_ids from said s""")
def model_run_units(spark, sf):
    segments, _, _, _ = _model_run(spark, sf)
    return segments.select("doc_id", "position", "status", "no_code_rationale", F.array_join(F.col("code_ids").cast("array<string>"), ",").alias("code_ids"))


@query(_MODEL + " select distinct doc_id, case when doc_id in (select doc_id from bad) then 'failed' else 'completed' end as status from u")
def model_run_documents(spark, sf):
    return _model_run(spark, sf)[2].select("doc_id", "status")


@query(_MODEL + " select code_id, case label when 'parity 0' then 'Parity_0' else label end as label from book")
def model_run_codebook(spark, sf):
    return _model_run(spark, sf)[3].select("code_id", "label")


@query(C._ALL + f""" select code_id, label, codings, units, n_codable, {C._rounded("100::double * units / n_codable", 1)} as pct_units from (
    select code_id::bigint as code_id, label, count(*) as codings, count(*) as units, (select count(*) from segs) as n_codable from codings group by 1, 2)""")
def cube_of_codes(spark, sf):
    """A block of the cube, as it is written and read again."""
    root = f"{shared_dir(spark)}/cube-{uuid.uuid4().hex}"
    write_cube(C.analysis(spark, sf), C.RUN, root)
    return read_cube(spark, C.RUN, root)["codes"]


@query(C._BOOK + " select label, coalesce(description, '') as description from codes where not is_deleted")
def codebook_exchange(spark, sf):
    """The codes of an exchange file, read from its XML."""
    root = ElementTree.fromstring(sinks.codebook_xml(C.book(spark, sf)[0]))
    space = root.tag.split("}")[0] + "}"
    found = [(c.get("name"), c.findtext(f"{space}Description") or "") for c in root.iter(f"{space}Code")]
    return spark.createDataFrame(found, "label string, description string")


@query("""select n_name || '.txt' as filename, n_regionkey as region, case when n_nationkey % 3 > 0 then 'en' end as language, case when n_nationkey % 2 = 0 then 'g' || n_regionkey end as grp, 'text of ' || min(n_name) over (partition by n_regionkey) as content from nation""")
def bundle_files(spark, sf):
    """Nations as documents of which a region's share a file: packed to a bundle, and read from it."""
    n = C.table(spark, sf, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_name").alias("first"))
    docs = n.join(first, "n_regionkey").select(
        F.concat("n_name", F.lit(".txt")).alias("filename"), F.concat(F.lit("/p/"), F.col("n_regionkey").cast("string")).alias("file_path"), F.when(F.col("n_nationkey") % 3 > 0, "en").alias("language"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))).alias("grp"), F.concat(F.lit("text of "), "first").cast("binary").alias("content"),
    )
    folder = f"{shared_dir(spark)}/bundles-{uuid.uuid4().hex}"
    one = spark.createDataFrame([("b.zip", bytearray(sinks.bundle(docs, "docx", {"own": "(a)(b)"})))], "filename string, content binary")
    sinks.write_files(one, folder).write.format("noop").mode("overwrite").save()
    back = sinks.read_bundles(spark, folder, "docx")[0]
    keys = n.select(F.concat("n_name", F.lit(".txt")).alias("filename"), F.col("n_regionkey").alias("region"))
    return back.join(keys, "filename").select("filename", "region", "language", "grp", F.col("content").cast("string").alias("content"))


@query(_CELLS + """ select distinct text as value from cells where "column" = 'size'""")
def grouping_values(spark, sf):
    """The values of a column that documents may be grouped by; there may be 30."""
    return spark.createDataFrame([(v,) for v in workspace.group_values(cell_table(spark, sf), "size")], "value string")


# Files, written by the executors and read as a data source.


def _stored_files(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The data source over files (filename, content) that are written first."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    sinks.write_files(rows, folder).write.format("noop").mode("overwrite").save()
    datasource.register(spark)
    return spark.read.format(datasource.NAME).option("group_bytes", 1 << 16).load(folder)


def _transcript_files(spark, sf):
    """A file for each transcript: text of two encodings, a page, a Word file; every tenth one cannot be read, and some are not admitted."""

    @F.pandas_udf("binary")
    def content(doc_id: pd.Series, text: pd.Series) -> pd.Series:
        def one(i, t):
            if i % 10 == 9:
                return b"no archive"
            if i % 4 == 1:
                return t.encode("latin-1", "ignore") if t == t.encode("latin-1", "ignore").decode("latin-1") else t.encode()
            if i % 4 == 2:
                return ("<html><body>" + "".join(f"<p> {html.escape(x)}</p>" for x in t.split("\n"))).encode()
            return docx(t) if i % 4 == 3 else t.replace("\n", "\r\n\n ").encode()

        return pd.Series([one(i, t) for i, t in zip(doc_id, text, strict=True)])

    kind = F.col("doc_id") % 4
    suffix = F.when(F.col("doc_id") % 10 == 9, ".docx").when(F.col("doc_id") % 12 == 4, ".doc").when(kind == 2, ".HTML").when(kind == 3, ".docx").otherwise(".txt")
    return transcripts(spark, sf).select(F.concat(F.lit("t"), F.col("doc_id").cast("string"), suffix).alias("filename"), content("doc_id", "text").alias("content"))


@query(_LINES + """ select 't' || doc_id || case when doc_id % 10 = 9 then '.docx' when doc_id % 12 = 4 then '.doc' when doc_id % 4 = 2 then '.HTML' when doc_id % 4 = 3 then '.docx' else '.txt' end as filename,
    case when doc_id % 10 <> 9 and doc_id % 12 <> 4 then (select string_agg(trim(line), chr(10) order by line_no) from lines l where l.doc_id = text.doc_id) end as text, case when doc_id % 10 = 9 then 'BadZipFile' when doc_id % 12 = 4 then 'old Word format' end as error from text""")
def transcript_files(spark, sf):
    rows = _stored_files(spark, _transcript_files(spark, sf))
    return rows.select("filename", "text", F.regexp_extract("error", "^[^:]+", 0).alias("error"))


_SHEETS = """with s as (select s_nationkey as n, (row_number() over (partition by s_nationkey order by s_suppkey) + 1)::int as row_no, s_name, case when s_suppkey % 3 > 0 then 'note ' || s_suppkey else ' ' end as note, s_suppkey from supplier)"""


@query(_SHEETS + """ select 'n' || n || '.xlsx' as filename, 'suppliers' as sheet, row_no, x.c as "column", trim(x.t) as text from s, unnest([{'c': 'Name', 't': s_name}, {'c': 'Note', 't': note}, {'c': 'Key', 't': 'k' || s_suppkey}]) as u(x) where trim(x.t) <> ''""")
def workbook_files(spark, sf):
    """A workbook for each nation, its suppliers as rows."""

    def book(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("s_suppkey")
        cells = [(r.s_name, f"note {r.s_suppkey}" if r.s_suppkey % 3 else " ", f"k{r.s_suppkey}") for r in own.itertuples()]
        return pd.DataFrame([(f"n{key[0]}.xlsx", packed({"suppliers": (["Name", " Note ", "Key"], cells)}))], columns=["filename", "content"])

    s = C.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    made = s.groupBy("s_nationkey").applyInPandas(book, "filename string, content binary")
    return _stored_files(spark, made).select("filename", "sheet", "row_no", "column", "text")


@query(_OWN.replace("ord = doc_id % 6", "ord = 2 and doc_id % 6 = 2").replace("where doc_id % 6 = 5)", "where false)") + " select doc_id, pos::int as position, speaker, ts, body as text, front from spoken")
def transcript_turns_sql(spark, sf):
    """The turns of the transcripts in one layout, by a table function in SQL."""
    tables.register(spark)
    transcripts(spark, sf).where("doc_id % 6 = 2").createOrReplaceTempView("loomcode_transcripts")
    regex = conventions.PRESETS["plain"].replace("\\", "\\\\").replace("'", "\\'")
    return spark.sql(f"select t.* from transcript_turns(table(loomcode_transcripts) partition by doc_id, regex => '{regex}') t")


#: Names of this module's queries, in order.
NAMES = [k for k in C.QUERIES if k not in _BEFORE]
