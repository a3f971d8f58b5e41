"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

from loomcode.llm.licenses import PHRASES, TEMPLATES, alpha_of, words_in
from loomcode.llm.queries import WEIGHTS

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_WEIGHT = "case source " + " ".join(f"when '{k}' then {v!r}::double" for k, v in WEIGHTS.items()) + " else 1.0::double end"

#: The table of CRC-32 by bytes, and the bytes of a text.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))"

OP1 = f"""
with t as (select {_CRC_TABLE} as crcs),
b as (select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents),
d as (
    select doc_id, (len(bytes) + 16)::bigint as size,
        xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32 from b, t),
line as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding)::bigint as upto, (sum(size) over ())::bigint as total from d),
placed as (select *, (((2 * upto - size) * 40) // (2 * total))::int as shard from line)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by upto) - 1 as slot, null::int as grown_shard from placed
"""

OP2 = f"""
with recursive sizes as (
    select source, sum(octet_length(encode(coalesce(text, ''))) + 16)::bigint as bytes, any_value({_WEIGHT}) as weight
    from documents group by source),
rates as (
    select source, weight / (select sum(weight) from sizes) * 1.0 * (select sum(bytes) from sizes)::double / bytes as rate from sizes),
chunks as (select source, rate, greatest(1, ceil(rate / 16.0))::int as n_chunks from rates),
cdf as (
    select source, rate, n_chunks, 0 as k, exp(-(rate / n_chunks)) as p, exp(-(rate / n_chunks)) as c from chunks
    union all
    select source, rate, n_chunks, k + 1, p * (rate / n_chunks) / (k + 1), c + p * (rate / n_chunks) / (k + 1) from cdf where k < 80),
named as (
    select *, coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, '')) || ':' || (row_number() over (partition by doc_id, coalesce(text, '')) - 1) as name from documents),
drawn as (
    select name, doc_id, d.source, text, rate, i,
        (('0x' || substr(md5('17:' || name || ':' || i), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
    from named d join chunks using (source), unnest(range(1, n_chunks + 1)) as t(i)),
counts as (
    select any_value(d.doc_id) as doc_id, name, d.source, d.rate, any_value(d.text) as text, count(c.k) as n
    from drawn d left join cdf c on c.source = d.source and c.c <= d.u group by name, d.source, d.rate)
select doc_id, source, copy::int as copy, rate, ('0x' || substr(md5('order17:' || name || ':' || copy), 1, 15))::bigint as shuffle_key,
    octet_length(encode(coalesce(text, '')))::bigint as text_bytes
from counts, unnest(range(0, n)) as t(copy) where n > 0
"""

OP3 = f"""
with recursive w as (
    select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (
    select distinct doc_id, array_to_string(ws[i : i + 3], ' ') as g
    from w, unnest(range(1, greatest(len(ws) - 2, 2))) as t(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
    select i.a, i.b from inter i join n x on x.doc_id = i.a join n y on y.doc_id = i.b
    where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id, doc_id as to_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.to_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(to_id)::bigint as component_id, d.doc_id = min(to_id) as kept
from documents d join reach r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n
"""

OP8 = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
wins as (select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as h from w, unnest(range(1, len(ws) - 48)) as t(i)),
hits as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as m from wins) where m < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from hits),
each as (select w.doc_id, t.j, ws[t.j] as x, g.j is not null as dropped
    from w, unnest(range(1, len(ws) + 1)) as t(j) left join gone g on g.doc_id = w.doc_id and g.j = t.j)
select w.doc_id, any_value(len(w.ws))::bigint as n_words, count(*) filter (where dropped)::bigint as n_removed,
    sha256(coalesce(string_agg(x, ' ' order by j) filter (where not dropped), '')) as kept_sha256
from w left join each e on e.doc_id = w.doc_id group by w.doc_id
"""

OP11 = f"""
with base as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, {_WORDS} as ws from documents),
firsts as (select text, min(doc_id) as first from base group by text),
lab as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
fails as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n,
        [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(b.doc_id > first, false)] as f
    from base b join firsts using (text) left join lab on lab.doc_id = b.doc_id group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
    select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
each as (
    select part, good, toxic, n, f, o as filter_order, step, f[ascii(o[step]) - 64] as bad,
        len(list_filter(range(1, step), lambda k: f[ascii(o[k]) - 64])) > 0 as earlier, len(list_filter(f, lambda x: x)) = 1 as alone
    from fails, orders, unnest(range(1, 6)) as t(step)),
steps as (
    select part, filter_order, step, sum(case when not bad and not earlier then n else 0 end)::bigint as kept, sum(case when bad and not earlier then n else 0 end)::bigint as removed,
        sum(case when bad and earlier then n else 0 end)::bigint as redundant, sum(case when bad and alone then n else 0 end)::bigint as unique_fails,
        sum(case when bad and not earlier and good then n else 0 end)::bigint as good_lost, sum(case when bad and not earlier and toxic then n else 0 end)::bigint as toxic_lost
    from each group by part, filter_order, step)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, filter_order[step]))::bigint as shapley from steps
"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

OP12 = f"""
with turns as (
    select conv_id, list(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) order by turn nulls first) as ts,
        list(octet_length(encode(coalesce(text, ''))) order by turn nulls first) as bs
    from conversations where conv_id is not null group by conv_id),
heads as (select *, ({_CRC} % 9)::int as h from turns),
rebuilt as (
    select c.conv_id, list_concat(coalesce(b.ts, [])[1 : c.h], c.ts[c.h + 1 :]) as ts, list_concat(coalesce(b.bs, [])[1 : c.h], c.bs[c.h + 1 :]) as bs
    from heads c left join turns b on b.conv_id = c.conv_id - c.conv_id % 5),
paths as (select conv_id, d, array_to_string(ts[1 : d], ',') as node, array_to_string(ts[1 : d - 1], ',') as parent, d = len(ts) as last, coalesce(bs[d], 0) as bytes
    from rebuilt, unnest(range(0, len(ts) + 1)) as t(d)),
nodes as (select d, node, min(conv_id) as conv_id, any_value(parent) as parent, any_value(bytes) as bytes, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '') as ends from paths group by d, node),
kids as (select d - 1 as d, parent as node, count(*) as n_children from nodes where d > 0 group by all),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (d, node)),
sums as (
    select p.d, p.node, count(*) filter (where n.n_children = 0) as n_leaves, sum((n.n_convs - 1) * n.bytes) as saved
    from full_nodes n join paths p on p.conv_id = n.conv_id and p.d <= n.d group by p.d, p.node)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from full_nodes n join sums s using (d, node) left join nodes u on u.d = n.d - 1 and u.node = n.parent
"""


def _texts(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LICENSE_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_HALF = max(len(words_in(t.text)) for t in TEMPLATES)
_PLACES = ", ".join(
    f"list_filter(range(0, len(ws)), lambda i: {' and '.join(f"coalesce(ws[i + {k + 1}] = '{w}', false)" for k, w in enumerate(words_in(p)))}) as p{j}" for j, p in enumerate(PHRASES)
)
_BASE = ", ".join(f"case when len(p{j}) > 0 then '{label}' end" for j, label in enumerate(PHRASES.values()))
_ROWS = ", ".join(f"('{t.name}', '{t.label}', {_texts(sorted(set(words_in(t.text))))}, {_texts(sorted(set(words_in(t.required))))}, {alpha_of(len(set(words_in(t.text))), 0.8)})" for t in TEMPLATES)

OP13 = f"""
with w as (select row_number() over () as id, doc_id, {_LICENSE_WORDS} as ws from documents),
places as (select id, doc_id, len(ws) as n_words, {_PLACES} from w),
base as (select id, doc_id, n_words, list_concat({', '.join(f'p{j}' for j in range(len(PHRASES)))}) as p, list_filter([{_BASE}], lambda x: x is not null) as b from places),
templates(name, label, words, required, alpha) as (values {_ROWS}),
blocks as (
    select id, k, list_distinct(ws[k * {_HALF} + 1 : (k + 2) * {_HALF}]) as ws
    from w, unnest(range(0, greatest(len(ws) - {_HALF}, 0) // {_HALF} + 1)) as t(k)),
found as (
    select id, k, name, label, words, len(list_intersect(ws, words)) / len(words) as containment from blocks, templates
    where list_has_any(ws, required) and len(list_intersect(ws, words)) >= alpha and list_has_all(ws, required)),
own as (select * from found f where not exists (select 1 from found g where g.id = f.id and g.k = f.k and len(g.words) > len(f.words) and list_has_all(g.words, f.words))),
docs as (select id, list(label) as l, max(containment) as score, count(distinct k) as n_blocks from own group by id)
select doc_id, n_words, len(p)::bigint as n_base, list_min(p) as first_word, list_max(p) as last_word, coalesce(array_to_string(list_sort(list_distinct(b)), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(b, coalesce(l, [])))), ','), '') as labels, coalesce(score, 0.0)::double as score, coalesce(n_blocks, 0)::bigint as n_blocks
from base left join docs using (id)
"""

ORACLES: dict[str, str] = {"op1_sharding": OP1, "op2_mixing": OP2, "op3_minhash": OP3, "op8_substring_dedup": OP8, "op11_filter_audit": OP11, "op12_prefix_trie": OP12, "op13_licenses": OP13}
