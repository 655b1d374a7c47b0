"""The queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from tabloom.llm import chat, decontam, lines, minhash, mixing, pii, quality, sharding, tokens, topk
from tabloom.sources.files import table


def op1_hilbert_sharding(spark, d):
    return sharding.shard_documents(table(spark, d, "documents"))


def op2_ball_tree_topk(spark, d):
    return topk.top_vectors(table(spark, d, "embeddings"))


def op3_quality_grades(spark, d):
    return quality.quality_grades(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_minhash_dedup(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"), words=3, threshold=(85, 100))


def op5_chat_formatting(spark, d):
    return chat.chat_digest(table(spark, d, "conversations"))


def op6_pii_sanitisation(spark, d):
    return pii.span_digest(table(spark, d, "documents"))


def op7_edited_token_counts(spark, d):
    return tokens.token_digest(table(spark, d, "documents"))


def op8_fuzzy_lines(spark, d):
    return lines.line_digest(table(spark, d, "documents"))


def op9_decontamination(spark, d):
    return decontam.decontamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op10_source_mixing(spark, d):
    return mixing.mix_documents(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_sharding,
        op2_ball_tree_topk,
        op3_quality_grades,
        op4_minhash_dedup,
        op5_chat_formatting,
        op6_pii_sanitisation,
        op7_edited_token_counts,
        op8_fuzzy_lines,
        op9_decontamination,
        op10_source_mixing,
    )
}

_MIX = r"""
with recursive s as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::bigint as source_size from documents group by source),
w as materialized (select source, source_size, list_extract([5.0, 2.0, 1.0]::double[], (row_number() over (order by source nulls last) - 1) % 3 + 1) as weight, source_size * 3.0::double as cap from s),
l(n, level) as (
    select 0, 0.0::double
    union all
    select l.n + 1, (select (sum(source_size) - coalesce(sum(cap) filter (where cap <= weight * l.level), 0)) / nullif(sum(weight) filter (where cap > weight * l.level), 0) from w)
    from l where l.n < (select count(*) + 1 from w) and l.level is not null
),
t as (select source, source_size, least(cap, weight * (select max(level) from l)) as target from w),
d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix'), 1, 8))::bigint as h from documents),
j as (select d.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) as rate,
        h % ((count(*) over (partition by d.source)) // 5000 + 1) as stratum from d join t on d.source is not distinct from t.source),
k as (select *, row_number() over (partition by source, stratum order by size, h, doc_id nulls first) as draw,
        ('0x' || substr(md5(coalesce(source, '') || '/' || stratum::varchar || ':mix'), 1, 8))::bigint / 4294967296.0::double as u from j)
select doc_id, size, source_size, target, ((floor(rate) + floor(u + (rate - floor(rate)) * draw) - floor(u + (rate - floor(rate)) * (draw - 1))) * size)::bigint as taken, source, rate from k
"""

_SPLIT = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HITS = f"""
with i as (select item_id, {_SPLIT.format(t='text')} as w from benchmark),
n as (select distinct least(10, len(w)) as n from i where len(w) > 0),
iw as (select distinct item_id, n.n, array_to_string(list_slice(w, p, p + n.n - 1), ' ') as run
    from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as p from i where len(w) > 0), n where n.n = least(10, len(w))),
d as (select doc_id, {_SPLIT.format(t='text')} as w from documents),
dw as (select doc_id, p, n.n, array_to_string(list_slice(w, p, p + n.n - 1), ' ') as run
    from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d), n where p + n.n - 1 <= len(w)),
m as (select doc_id, p, dw.n, item_id from dw join iw using (n, run)),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from m) group by doc_id),
f as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join f using (doc_id)
"""

_NEAR = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, array_to_string(list_slice(w, p, p + 2), ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as p from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as materialized (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
b as materialized (select x, y from e union all select y, x from e),
r as (select doc_id as d, doc_id as m from w union select b.y, r.m from r join b on b.x = r.d where r.m < b.y),
k as (select d, min(m) as m from r group by d)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, k.m as component_id, k.m = w.doc_id as kept from w join k on k.d = w.doc_id left join n on n.doc_id = w.doc_id
"""

_TOP = """
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
    from v q, v c where q.vec_id % 50 = 0 and q.vec_id != c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

ORACLE = {"op2_ball_tree_topk": _TOP, "op4_minhash_dedup": _NEAR, "op9_decontamination": _HITS, "op10_source_mixing": _MIX}
