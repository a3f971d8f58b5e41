"""The registered queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loomcode.functions import text as T
from loomcode.operators import codebook, conventions, dictionary, language, runs, segment, workspace
from loomcode.operators import facts as F_
from loomcode.operators.analysis import Analysis
from loomcode.store import shared_dir

CODES = [(1, "alpha", False), (2, "beta", False), (3, "gamma", False), (4, "delta", False), (5, "unused", False), (6, "gone", True)]
EXPRESSIONS = [
    (1, 1, "en", "thst"), (2, 1, "de", "erch"), (3, 1, "fr", "ére"), (4, 2, "en", "eron"), (5, 2, "en", '"of the"'), (6, 3, "en", "erhe"), (7, 3, "en", "thst eron"),
    (8, 4, "en", "attion"), (9, 4, "en", '"in the"'), (10, 4, "fr", '"de la"'), (11, 4, "de", '"der der"'), (12, 6, "en", "thst"), (13, 1, "es", "que"),
]

#: Bytes by the optimizer's estimate below which a table is dealt to all cores.
SMALL_TABLE = 256 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation, which needs no Python worker."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True))
    arrow = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields, strict=True)], names=fields.names)
    return spark.createDataFrame(arrow, fields)


def codes(spark: SparkSession) -> DataFrame:
    return local(spark, [(i, x, None, None, d, None) for i, x, d in CODES], codebook.CODES)


def expressions(spark: SparkSession) -> DataFrame:
    return local(spark, EXPRESSIONS, codebook.EXPRESSIONS)


_BOOK_LANGS = ["de", "en", "fr", "it", "es"]


def book(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(codes, expressions) that the parts give: a code for each name, and an expression of types and brands for each name and language."""
    lang = F.element_at(F.lit(_BOOK_LANGS), F.col("p_size") % 5 + 1)
    kind = F.col("p_partkey") % 3
    said = F.when(F.col("p_size") % 10 == 0, "the and").when(kind == 0, F.concat_ws(" ", "p_type", "p_brand")).when(kind == 1, F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).otherwise(F.col("p_type"))
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", lang.alias("lang"), said.alias("expression"))
    codes = parts.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("code_id"), F.min("p_brand").alias("b"))
    own = parts.groupBy("p_name", "lang", "expression").agg(F.min("p_partkey").alias("expr_id")).join(codes, F.col("p_name") == F.col("label"))
    described = F.when(F.col("code_id") % 3 > 0, F.col("b"))
    none = F.lit(None)
    codes = codes.select("code_id", "label", described.alias("description"), none.cast("string").alias("example"), (F.col("code_id") % 7 == 3).alias("is_deleted"), none.cast("long").alias("proposed_in_run_id"))
    return codes, own.select("expr_id", "code_id", "lang", "expression")


_BOOK = f"""with parts as (select p_partkey, p_name, p_brand, {"['" + "', '".join(_BOOK_LANGS) + "']"}[p_size % 5 + 1] as lang,
    case when p_size % 10 = 0 then 'the and' when p_partkey % 3 = 0 then p_type || ' ' || p_brand when p_partkey % 3 = 1 then '"' || p_brand || '"' else p_type end as expression from part),
codes as (select code_id, label, case when code_id % 3 > 0 then b end as description, code_id % 7 = 3 as is_deleted from (select p_name as label, min(p_partkey) as code_id, min(p_brand) as b from parts group by p_name)),
exprs as (select expr_id, code_id, lang, expression from (select p_name, lang, expression, min(p_partkey) as expr_id from parts group by all) e join codes c on c.label = p_name)"""


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores: one row group is one task, however small. A large table has a task for each of its
    row groups and moves nothing."""
    small = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_TABLE
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if small else rows


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("source").alias("grp")))


def units(spark: SparkSession, sf: str) -> DataFrame:
    return segment.plain_units(docs(spark, sf), "paragraph")


RUN = 1
_FACTS: dict[tuple[str, str], tuple[tuple, str]] = {}
_FLIGHTS = F_.SingleFlight()


def _stamp(docs: DataFrame) -> tuple:
    """What tells a table from what it was: its rows, and when its files were last written. No column is read."""
    return tuple(docs.agg(F.count("*"), F.max("_metadata.file_modification_time"), F.count_distinct("_metadata.file_path")).first())


def dictionary_run(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """A run of the dictionary over all documents, with its facts under root: the run's documents."""
    return F_.execute(RUN, units(spark, sf), None, None, F_.DictionaryCoder(codes(spark), expressions(spark)), root)[0]


def _run_anew(spark: SparkSession, sf: str, stamp: tuple) -> DataFrame:
    """Executes the run, whose facts count from now on: the run's documents."""
    root = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
    done = dictionary_run(spark, sf, root)
    _FACTS[(spark.sparkContext.applicationId, sf)] = (stamp, root)
    return done


def facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(segments, codings) of the dictionary run over documents. A run is executed once for a state of its table, and its facts are written; what is
    computed from a run reads them, and no text of a document again."""
    key = (spark.sparkContext.applicationId, sf)

    def held() -> tuple[DataFrame, DataFrame]:
        stamp = _stamp(table(spark, sf, "documents"))
        if _FACTS.get(key, (None,))[0] == stamp:
            try:
                return F_.read_facts(spark, _FACTS[key][1], RUN)
            except ValueError:  # the shared folder has been cleaned
                pass
        _run_anew(spark, sf, stamp)
        return F_.read_facts(spark, _FACTS[key][1], RUN)

    segments, found = _FLIGHTS.run(key, held)
    return segments.drop("run_id"), found.drop("run_id")


def codings(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf)[1]


def analysis(spark: SparkSession, sf: str, stoplists=None) -> Analysis:
    segments, found = facts(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("grp"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"))
    return Analysis(segments, found, d, codes(spark), stoplists)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_STOP = "case lang " + " ".join(f"when '{k}' then {_sql_list(v)}" for k, v in T.STOP_WORDS.items()) + " else []::varchar[] end"
_LANGS = ", ".join(f"'{x}'" for x in T.LANGUAGES)
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_''-]+')"
_SENTS = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '')"
_PARAS = r"list_filter(list_transform(string_split(text, chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '')"



def _rounded(x: str, places: int) -> str:
    """x to so many places, half to even on the binary value: the product's exact error tells a half from its neighbours."""
    scale = 10**places
    c = f"{2 * scale}::double"
    split = f"lambda v: {{'v': v, 'h': v * 134217729::double - (v * 134217729::double - v), 't': v * {c}}}"
    rest = f"lambda s: {{'t': s.t, 'r': (s.h * {c} - s.t) + (s.v - s.h) * {c}, 'b': floor(s.t / 2)}}"
    whole = "lambda s: case when s.t = floor(s.t) and abs(s.t % 2) = 1 then s.b + case when s.r > 0 or (s.r = 0 and s.b % 2 <> 0) then 1 else 0 end else floor((s.t + 1) / 2) end"
    return f"(list_transform(list_transform(list_transform([{x}], {split}), {rest}), {whole})[1] / {scale}::double)"


_BASE = f"""
with codes(code_id, label, is_deleted) as (values {", ".join(f"({i}, '{x}', {str(d).lower()})" for i, x, d in CODES)}),
exprs(expr_id, code_id, lang, expression) as (values {", ".join(f"({a}, {b}, '{c}', '{d}')" for a, b, c, d in EXPRESSIONS)}),
paras as (select doc_id, lang, source as grp, {_PARAS} as ps from documents),
units as (select doc_id, lang, grp, (i - 1)::int as position, ps[i] as text from paras, unnest(range(1, len(ps) + 1)) as t(i))"""
_MATCH = f""",
idx as (
    select expr_id, e.code_id, e.lang, expression, starts_with(expression, '"') as phrase,
        case when starts_with(expression, '"') then {_TOK.format("expression")} else list_filter({_TOK.format("expression")}, lambda x: not list_contains({_STOP}, x)) end as lemmas
    from exprs e join codes c on c.code_id = e.code_id and not c.is_deleted where lang in ({_LANGS})),
ss as (select doc_id, position, lang, {_SENTS.format("text")} as ss from units where lang in ({_LANGS})),
sents as (select doc_id, position, lang, i - 1 as sent, ss[i] as sentence, {_TOK.format("ss[i]")} as seq from ss, unnest(range(1, len(ss) + 1)) as t(i)),
matches as (
    select doc_id, position, sent, sentence, code_id, expr_id, expression from sents s join idx x on x.lang = s.lang and len(seq) > 0 and len(lemmas) > 0 and
    case when phrase then contains(chr(1) || array_to_string(seq, chr(1)) || chr(1), chr(1) || array_to_string(lemmas, chr(1)) || chr(1))
    else len(list_filter(lemmas, lambda z: not list_contains(seq, z))) = 0 end),
codings as (
    select m.doc_id, m.position, m.code_id, label, count(*) as score from matches m join codes using (code_id) group by 1, 2, 3, 4),
segs as (
    select u.*, coalesce(n, 0) as n_codings, case when n > 0 then 'coded' else 'no_code' end as status
    from units u left join (select doc_id, position, count(*) as n from codings group by 1, 2) using (doc_id, position))"""
_ALL = _BASE + _MATCH
_LEM = f""",
lem as (
    select doc_id, position, lang, grp, lemma from (
        select doc_id, position, lang, grp, unnest(list_filter({_TOK.format("text")}, lambda x: not list_contains({_STOP}, x))) as lemma
        from segs where status = 'coded' and lang in ({_LANGS}))
    where not regexp_full_match(lemma, '[\\p{{N}}''_-]+'))"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(_BASE + " select distinct 1::bigint as run_id, doc_id, 'completed' as status, (count(*) over (partition by doc_id))::bigint as units from units")
def run_executed(spark, sf):
    """The run anew: its documents, and the units that their committed facts have. The analysis queries read these facts from then on."""
    done = _run_anew(spark, sf, _stamp(table(spark, sf, "documents")))
    return done.join(facts(spark, sf)[0].groupBy("doc_id").agg(F.count("*").alias("units")), "doc_id").select("run_id", "doc_id", "status", "units")


@query(_BASE + " select doc_id, count(*) as n, max(position)::int as last from units group by doc_id")
def paragraphs_per_doc(spark, sf):
    return units(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("position").alias("last"))


@query(_BASE + f" select lang, sum(len({_SENTS.format('text')}))::bigint as n_sentences from units group by lang")
def sentences_per_lang(spark, sf):
    return docs(spark, sf).select("lang", F.size(T.line_sentences(F.col("text"))).alias("n")).groupBy("lang").agg(F.sum("n").alias("n_sentences"))


@query(f"""select lang, token, count(*) as n from (select lang, unnest({_TOK.format("text")}) as token from documents) group by lang, token""")
def token_freq_by_lang(spark, sf):
    return docs(spark, sf).select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


@query(f"""with f as (select lang, token, count(*) as n from (select lang, unnest({_TOK.format("text")}) as token from documents) group by lang, token)
select lang, token, n, total, n / total::double as share, rank from (
    select *, sum(n) over (partition by lang)::bigint as total, (row_number() over (partition by lang order by n desc, token))::int as rank from f) where rank <= 30""")
def token_freq_topk(spark, sf):
    f = token_freq_by_lang(spark, sf)
    # The rank alone is in a window, which takes 30 rows of a language from each task.
    best = f.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).where("rank <= 30")
    totals = f.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    return best.join(totals, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "token", "n", "total", (F.col("n") / F.col("total")).alias("share"), "rank")


@query(_ALL + " select doc_id, position, sent::int as sent, code_id::bigint as code_id, expr_id::bigint as expr_id from matches where not starts_with(expression, '\"')")
def dict_match_bag(spark, sf):
    return _matches(spark, sf).where("not startswith(expression, '\"')").select("doc_id", "position", "sent", "code_id", "expr_id")


@query(_ALL + " select doc_id, position, sent::int as sent, code_id::bigint as code_id, expr_id::bigint as expr_id from matches where starts_with(expression, '\"')")
def dict_match_phrase(spark, sf):
    return _matches(spark, sf).where("startswith(expression, '\"')").select("doc_id", "position", "sent", "code_id", "expr_id")


def _matches(spark, sf):
    return dictionary.match_sentences(units(spark, sf), dictionary.build_index(codes(spark), expressions(spark)))


@query(_ALL + " select doc_id, position, sent::int as sent, code_id::bigint as code_id, expr_id::bigint as expr_id from matches")
def dict_match_inverted(spark, sf):
    rows = dictionary._match_inverted(dictionary.unit_sentences(units(spark, sf)), dictionary.build_index(codes(spark), expressions(spark)))
    return rows.select("doc_id", "position", "sent", "code_id", "expr_id")


@query(_ALL + """ select c.doc_id, c.position, c.code_id::bigint as code_id, score,
    (select string_agg(expression, '|' order by s, e) from (select expression, min(sent) as s, min_by(expr_id, sent * 1000 + expr_id) as e from matches m where m.doc_id = c.doc_id and m.position = c.position and m.code_id = c.code_id group by expression)) as expressions
from codings c""")
def dict_scores(spark, sf):
    return codings(spark, sf).select("doc_id", "position", "code_id", "score", F.array_join("matched_expressions", "|").alias("expressions"))


@query(_ALL + f""" select code_id, label, codings, units, n_codable, {_rounded("100::double * units / n_codable", 1)} as pct_units from (
    select code_id::bigint as code_id, label, count(*) as codings, count(*) as units, (select count(*) from segs) as n_codable from codings group by 1, 2)""")
def codes_block(spark, sf):
    return analysis(spark, sf).codes()


@query(_ALL + f""" select *, {_rounded("100::double * coded / segments", 1)} as coverage_pct from (
    select doc_id, any_value(grp) as grp, any_value(lang) as lang, count(*) as segments, count(*) filter (where status = 'coded') as coded from segs group by doc_id)""")
def coverage_by_doc(spark, sf):
    return analysis(spark, sf).coverage().drop("name")


@query(_ALL + " select grp, count(*) as n_units from segs group by grp")
def coverage_by_group(spark, sf):
    return analysis(spark, sf).units_per_group()


@query(_ALL + f""", g as (select grp, count(*) as n_units from segs group by grp),
    h as (select label, s.grp, count(*) as units from codings c join segs s using (doc_id, position) group by 1, 2),
    p as (select label, grp, coalesce(units, 0) as units, n_units, {_rounded("100::double * coalesce(units, 0) / n_units", 1)} as pct
        from (select distinct label from codings) cross join g left join h using (label, grp)),
    m as (select label, list_reduce(list_prepend(0::double, list(pct order by grp)), lambda a, b: a + b) / count(*)::double as m from p group by label),
    r as (select label, {_rounded("m", 1)} as mean from m)
select label, grp, units, n_units, pct, mean, {_rounded("pct - mean", 1)} as deviation from p join r using (label)""")
def group_percentages(spark, sf):
    return analysis(spark, sf).groups().select("label", "grp", "units", "n_units", "pct", "mean", "deviation")


@query(_ALL + """, c2 as (select distinct doc_id, position, label from codings)
select a.label as label_a, b.label as label_b, count(*) as units from c2 a join c2 b using (doc_id, position) group by 1, 2""")
def cooccurrence_long(spark, sf):
    return analysis(spark, sf).cooccurrence()


@query("""with c as (select distinct l_orderkey as o, l_returnflag || l_linestatus as code from lineitem)
select a.code as code_a, b.code as code_b, count(*) as units from c a join c b on a.o = b.o and a.code <= b.code group by 1, 2""")
def cooccurrence_orders(spark, sf):
    """Orders as units, flag and status of their lines as codes."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("position"), (F.ascii("l_returnflag") * 256 + F.ascii("l_linestatus")).cast("long").alias("code_id"), F.concat("l_returnflag", "l_linestatus").alias("label"))
    codes = lines.select("code_id", "label").distinct()
    none = lines.select("doc_id", "position", F.lit("coded").alias("status"))
    a = Analysis(none, lines.drop("label"), lines.select("doc_id", F.lit("").alias("grp")), codes)
    return a.cooccurrence().where("label_a <= label_b").select(F.col("label_a").alias("code_a"), F.col("label_b").alias("code_b"), "units")


@query(_ALL + ", c2 as (select distinct doc_id, position, label from codings) select doc_id, " + ", ".join(f"count(*) filter (where label = '{x}') as {x}" for _, x, _ in CODES[:5]) + " from c2 group by doc_id")
def docs_by_codes_pivot(spark, sf):
    return analysis(spark, sf).documents_by_codes([x for _, x, _ in CODES[:5]])


@query(_ALL + _LEM + """, f as (select lang, lemma, count(*) as freq from lem group by 1, 2)
select * exclude (norm_), norm_ as norm from (select * exclude (norm_), """ + _rounded("norm_", 4) + """ as norm_ from (
    select *, sum(freq) over (partition by lang)::bigint as total, freq / (sum(freq) over (partition by lang))::double as norm_, sum(freq) over (partition by lang) < 50 as flagged,
    (row_number() over (partition by lang order by freq desc, lemma))::int as rank from f))""")
def lemmas(spark, sf):
    return analysis(spark, sf).lemmas()


@query(_ALL + _LEM + """ select lang, label, lemma, count(*) as freq from lem join codings using (doc_id, position) group by 1, 2, 3""")
def lemma_by_code(spark, sf):
    return analysis(spark, sf).lemma_counts(1)


@query(_ALL + _LEM + """ select lang, label, grp, lemma, count(*) as freq from lem join codings using (doc_id, position) group by 1, 2, 3, 4""")
def lemma_by_code_group(spark, sf):
    return analysis(spark, sf).lemma_counts(2)


@query(_ALL + _LEM + " select lang, lemma, count(*) as freq from lem where not (lang = 'en' and lemma in ('thst', 'er')) group by 1, 2")
def stoplist_filtered_lemmas(spark, sf):
    return analysis(spark, sf, {"en": [" THST ", "er", ""]}).lemma_counts(0)


@query(_ALL + """, f as (select distinct m.doc_id, position, code_id, expression from matches m)
select d.lang, label, expression, count(*) as firings from f join codes using (code_id) join documents d using (doc_id) group by 1, 2, 3""")
def expression_firings(spark, sf):
    return analysis(spark, sf).expressions()


@query(_ALL + """, f as (select distinct m.doc_id, position, code_id, expression from matches m)
select d.lang, label, d.source as grp, expression, count(*) as firings from f join codes using (code_id) join documents d using (doc_id) group by 1, 2, 3, 4""")
def expression_firings_by_group(spark, sf):
    return analysis(spark, sf).expressions_by_code_group()


def _top(keys: str) -> str:
    return _ALL + f""" select * from (select {keys}, (row_number() over (partition by {keys} order by score desc, doc_id, position))::int as rank, score, doc_id, position, text
    from codings join units using (doc_id, position)) where rank <= 5"""


@query(_top("label"))
def top_extracts_by_code(spark, sf):
    return analysis(spark, sf).top_extracts()


@query(_top("label, grp"))
def top_extracts_by_group(spark, sf):
    return analysis(spark, sf).top_extracts(by_group=True)


@query(_ALL + """ select s.doc_id, s.position, s.text, s.status, coalesce(x.codes, '') as codes from segs s
    left join (select doc_id, position, string_agg(label, '; ' order by code_id) as codes from codings group by 1, 2) x using (doc_id, position)""")
def segments_export(spark, sf):
    return analysis(spark, sf).segments_export().select("doc_id", "position", "text", "status", "codes")


_CONV = """with u as (select conv_id as doc_id, (row_number() over (partition by conv_id order by turn) - 1)::int as position, role as speaker, text from conversations),
r as (select *, case speaker when 'assistant' then 'interviewer' when 'user' then 'participant' else 'other' end as role from u)"""
_ROLES = {"assistant": "interviewer", "user": "participant", "system": "other"}


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select(F.col("conv_id").alias("doc_id"), pos.alias("position"), F.col("role").alias("speaker"), "text", F.lit(False).alias("front"))


def _excluded(spark, sf):
    t = _turns(spark, sf)
    roles = t.select("doc_id").distinct().withColumn("roles", F.create_map(*(F.lit(x) for kv in _ROLES.items() for x in kv)))
    return segment.with_exclusion(t, roles, ["interviewer"])


@query(_CONV + " select role, count(*) as n, count(*) filter (where role = 'interviewer') as n_excluded from r group by role")
def role_exclusion(spark, sf):
    return _excluded(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.count_if("excluded").alias("n_excluded"))


@query(_CONV + """ select case when role = 'interviewer' then 'excluded' when contains(lower(text), 'the') then 'coded' else 'no_code' end as status, count(*) as n from r group by 1""")
def unit_status_counts(spark, sf):
    u = _excluded(spark, sf)
    hits = u.where("not excluded and contains(lower(text), 'the')").select("doc_id", "position")
    return runs.segments(u, hits).groupBy("status").agg(F.count("*").alias("n"))


@query(_CONV + """ select doc_id, position, coalesce(lag(speaker, 3) over w || ': ' || lag(text, 3) over w || chr(10), '') || coalesce(lag(speaker, 2) over w || ': ' || lag(text, 2) over w || chr(10), '')
    || coalesce(lag(speaker, 1) over w || ': ' || lag(text, 1) over w, '') as context from r window w as (partition by doc_id order by position)""")
def context_window_3(spark, sf):
    return segment.with_context(_turns(spark, sf), 3).select("doc_id", "position", runs.context_lines(F.col("context")).alias("context"))


@query("""with x as (select user_id, event_id, case when event_type = 'click' then event_type || (event_id % 7) end as speaker, ts from events)
select event_id, last_value(speaker ignore nulls) over w as speaker, coalesce(count(speaker) over w = 0, true) as front from x
window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def carry_forward_speaker(spark, sf):
    e = table(spark, sf, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select("event_id", F.col("user_id").alias("doc_id"), order.alias("line_no"), (F.col("event_type") == "click").alias("turn"), F.when(F.col("event_type") == "click", F.concat("event_type", (F.col("event_id") % 7).cast("string"))).alias("speaker"))
    return segment.carried(rows).select("event_id", "speaker", "front")


@query("""with x as (select user_id, ts, lag(ts) over (partition by user_id order by event_id) as before from events)
select user_id, count(*) as n, count(*) filter (where ts >= before) as n_ordered, count(*) >= 3 and count(*) filter (where ts >= before) >= 0.9 * (count(*) - 1) as monotonic from x group by user_id""")
def monotonic_ts(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id"), F.col("event_id").alias("line_no"), F.col("ts").alias("sec"))
    out = conventions.stamps(e, ["user_id"]).select("user_id", F.col("n_ts").alias("n"), "n_ordered")
    return out.withColumn("monotonic", conventions.monotonic(F.col("n"), F.col("n_ordered")))


@query(f"""with lines as (select doc_id, i, string_split(text, chr(10))[i] as line from documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as t(i)),
placed as (select doc_id, i, {_STRIP.format("line")} as body, sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 + length(line) - length(regexp_replace(line, '^\\s+', '')) as b from lines)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as position, b::int as start_offset, (b + length(body))::int as end_offset from placed where body <> ''""")
def offset_anchor(spark, sf):
    d, u = docs(spark, sf), units(spark, sf)
    return segment.anchored(d, u).select("doc_id", "position", "start_offset", "end_offset")


@query("""select p_partkey, norm, rn > 1 as duplicate from (
    select p_partkey, trim(regexp_replace(translate(lower(p_name), '_-', '  '), '\\s+', ' ', 'g')) as norm,
        row_number() over (partition by trim(regexp_replace(translate(lower(p_name), '_-', '  '), '\\s+', ' ', 'g')) order by p_partkey) as rn from part)""")
def label_normalise_dedup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey"), F.col("p_name").alias("label"))
    return codebook.marked_duplicates(p, order="p_partkey").select("p_partkey", "norm", "duplicate")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def covered_docs(spark, sf):
    """The documents that a run has completed; a label stands for that."""
    return _analyzed(spark, sf).where("analyzed").select("doc_id")


def _analyzed(spark, sf):
    done = table(spark, sf, "labels").select("doc_id", F.lit("completed").alias("status"))
    return workspace.analyzed(table(spark, sf, "documents").select("doc_id"), done)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def uncovered_docs(spark, sf):
    return _analyzed(spark, sf).where("not analyzed").select("doc_id")


@query(_BOOK + " select code_id, lang, count(*) as n from exprs join codes using (code_id) where not is_deleted group by 1, 2")
def expressions_per_code_lang(spark, sf):
    return codebook.expression_counts(*book(spark, sf))


@query(_BASE + """ select lang, count(*) filter (where not exists (select 1 from exprs e where e.code_id = c.code_id and e.lang = l.lang)) as n_codes
    from (select distinct lang from documents) l, codes c where not is_deleted group by lang""")
def uncovered_codes_per_lang(spark, sf):
    return codebook.uncovered(codes(spark), expressions(spark), table(spark, sf, "documents").select("lang").distinct())


@query(_ALL + " select code_id::bigint as code_id, label from codes where not is_deleted or code_id in (select code_id from codings)")
def active_union_referenced(spark, sf):
    return codebook.active_or_referenced(codes(spark), codings(spark, sf)).select("code_id", "label")


@query(_BASE + """, d as (select distinct doc_id from documents order by doc_id limit 8), s as (select u.*, position % 3 = 2 as excluded,
    coalesce(length(lag(text, 1) over w), 0) + coalesce(length(lag(text, 2) over w), 0) as ctx from units u join d using (doc_id) window w as (partition by doc_id order by position)),
a as (select count(distinct doc_id) as counted, count(*) filter (where not excluded) as u, sum(length(text) // 4) filter (where not excluded) as t, sum(ctx // 4) filter (where not excluded) as c from s),
b as (select round_even(u * (n / counted::double), 0)::bigint as u, round_even(t * (n / counted::double), 0)::bigint as t, round_even(c * (n / counted::double), 0)::bigint as c from a, (select count(*) as n from documents)),
r as (select u, (1000 // 4) + 25 * (u - 1) + t + c + 50 * u as i, 150 * u as o from b)
select u as segments, i as input_tokens, o as output_tokens, round_even((i * 3.0::double + o * 15.0::double) / 1e6::double, 4) as cost_usd from r""")
def estimate_tokens(spark, sf):
    """A model run over paragraphs with two paragraphs of context, every third one excluded, and a system block of 1,000 characters."""
    own = units(spark, sf).withColumn("excluded", F.col("position") % 3 == 2)
    return runs.estimate_run(table(spark, sf, "documents"), segment.with_context(own, 2), "x" * 1000)


@query("""with t as (select user_id % 20 as run_id, case when event_type = 'click' then 'a' when event_type = 'view' then 'b' else 'c' end as model, count(*) as tokens_in, sum(event_id % 11)::bigint as tokens_out from events group by 1, 2)
select run_id, model, tokens_in, tokens_out, (tokens_in * case model when 'a' then 1.0 when 'b' then 5.0 else 3.0 end::double + tokens_out * case model when 'a' then 5.0 when 'b' then 25.0 else 15.0 end::double) / 1e6::double as cost from t""")
def run_cost(spark, sf):
    model = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").otherwise("c")
    t = table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("run_id"), model.alias("model")).agg(F.count("*").alias("tokens_in"), F.sum(F.col("event_id") % 11).alias("tokens_out"))
    prices = spark.createDataFrame([("a", 1.0, 5.0), ("b", 5.0, 25.0)], "model string, price_in double, price_out double")
    return runs.costs(t, prices).select("run_id", "model", "tokens_in", "tokens_out", "cost")


@query(_BOOK + " select c.code_id, any_value(label) as label, coalesce(any_value(description), '') as description, '' as example, " + ", ".join(f"coalesce(string_agg(expression, '; ' order by expr_id) filter (where lang = '{x}'), '') as Expressions_{x}" for x in T.LANGUAGES) + " from codes c left join exprs using (code_id) where not is_deleted group by 1")
def codebook_pivot(spark, sf):
    return codebook.wide(*book(spark, sf))


_VOTES = ", ".join(f"('{k}', {_sql_list(v)})" for k, v in sorted(T.STOP_WORDS.items()))


@query(f"""with votes(v, words) as (values {_VOTES}), t as (select doc_id, lang, {_TOK.format("text")} as seq from documents),
n as (select doc_id, lang, v, len(list_filter(seq, lambda x: list_contains(words, x))) as n from t cross join votes),
best as (select doc_id, lang, v, n, row_number() over (partition by doc_id order by n desc, v) as r from n)
select doc_id, lang, case when n > 0 then v end as detected from best where r = 1""")
def language_votes(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", T.detect_language(F.col("text")).alias("detected"))


@query("""with c as (select doc_id, lang, list_transform(string_split(lower(text), ''), lambda x: unicode(x)::bigint) as cs from documents),
g as (select doc_id, lang, i, (cs[i] * 961 + cs[i + 1] * 31 + cs[i + 2]) % 4096 as b from c, unnest(range(1, len(cs) - 1)) as t(i)),
n as (select lang, b, count(*) as n from g group by 1, 2), t as (select lang, sum(n) as total from n group by 1),
w as (select t.lang as v, x.b, ln((coalesce(n.n, 0) + 1) / (total + 4096)::double) as w from t cross join range(4096) as x(b) left join n on n.lang = t.lang and n.b = x.b),
s as (select doc_id, v, sum(w * m) as s from (select doc_id, b, count(*) as m from g where i <= 4998 group by 1, 2) join w using (b) group by 1, 2),
best as (select doc_id, v, row_number() over (partition by doc_id order by s desc, v) as r from s)
select doc_id, lang, case when v in (""" + _LANGS + """) then v end as detected from documents left join (select doc_id, v from best where r = 1) using (doc_id)""")
def languages_detected(spark, sf):
    """The language of each document's first 5,000 characters, as is the feature, by trigrams that all documents teach; a language without a model is none."""
    d = docs(spark, sf)
    return d.select("doc_id", "lang", language.detected(F.col("text"), language.fitted(d)).alias("detected"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return codes_block(spark, sf)
