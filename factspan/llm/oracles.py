"""DuckDB SQL for the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_NEAR_DEDUP = f"""
with recursive words as (
    select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w
    from documents
), shingles as (
    select distinct doc_id, unnest(
        case when len(w) >= 4
             then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
             when len(w) > 0 then [array_to_string(w, ' ')]
             else [] end) as s
    from words
), sizes as (
    select doc_id, count(s) as n from shingles group by doc_id
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
    group by 1, 2
), links as (
    select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * c.n >= 80 * (x.n + y.n - c.n)
), edges as (
    select a, b from links union select b, a from links
), reach(node, near) as (
    select doc_id, doc_id from documents
    union
    select r.node, e.b from reach r join edges e on e.a = r.near
)
select d.doc_id, coalesce(any_value(z.n), 0) as n_shingles,
       min(r.near) as component_id, min(r.near) = d.doc_id as kept
from documents d join reach r on r.node = d.doc_id left join sizes z on z.doc_id = d.doc_id
group by d.doc_id
"""

_PASSAGES = f"""
with words as (
    select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents
), windows as (
    select doc_id, unnest(range(1, len(w) - 48)) as i,
           unnest([array_to_string(w[i:i + 49], ' ') for i in range(1, len(w) - 48)]) as s
    from words
), firsts as (
    select s, min(doc_id) as low from windows group by s
), hits as (
    select doc_id, i from windows join firsts using (s) where low < doc_id
), places as (
    select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from words
), judged as (
    select p.doc_id, p.i, p.word,
           coalesce(max(h.i) over (partition by p.doc_id order by p.i), -50) >= p.i - 49 as gone
    from places p left join hits h on h.doc_id = p.doc_id and h.i = p.i
), cut as (
    select doc_id, count(*) filter (gone) as n_removed,
           coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept
    from judged group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from words left join cut using (doc_id)
"""

_MIXTURE = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
           md5('mix:' || doc_id::varchar) as key
    from documents
), sources as (
    select source, sum(size)::bigint as source_size from sized group by source
), named as (
    select *, 2 * source_size as cap,
           case (row_number() over (order by source nulls last) - 1) % 3
                when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
    from sources
), shared as (
    select *, cap / weight as ratio,
           (sum(source_size) over () * 150 / 100 - coalesce(sum(cap) over w, 0))
           / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as share
    from named
    window w as (order by cap / weight, source nulls last
                 rows between unbounded preceding and 1 preceding)
), level as (
    select max(share) filter (share <= ratio) as level from shared
), targets as (
    select source, source_size,
           least(cap::double, coalesce(level * weight, cap::double)) as target
    from shared, level
), placed as (
    select *, coalesce(sum(size) over (
        partition by source order by key, doc_id
        rows between unbounded preceding and 1 preceding), 0)::bigint as start
    from sized
)
select doc_id, size::bigint as size, source_size, target,
       (greatest(0, least(size, floor(target)::bigint - start))
        + greatest(0, least(size, floor(target)::bigint - source_size - start)))::bigint as taken
from placed p join targets t on p.source is not distinct from t.source
"""

_BYTES = """
with raw as (
    select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents
), windows as (
    select doc_id, unnest(range(0, len(h) // 2 - 399)) as i,
           unnest([md5(substr(h, (2 * i + 1)::bigint, 800))
                   for i in range(0, len(h) // 2 - 399)]) as s
    from raw
), repeated as (
    select s from windows group by s having count(*) > 1
), hits as (
    select doc_id, i from windows semi join repeated using (s)
), starts as (
    select *, i - coalesce(lag(i) over w, -1000) > 400 as new
    from hits window w as (partition by doc_id order by i)
), numbered as (
    select *, sum(new::int) over (partition by doc_id order by i) as run from starts
), runs as (
    select doc_id, run, min(i) as a, max(i) + 400 as b from numbered group by doc_id, run
), gaps as (
    select doc_id, coalesce(lag(b) over w, 0) as a, a as b
    from runs window w as (partition by doc_id order by run)
    union all
    select doc_id, max(b), null from runs group by doc_id
), cut as (
    select doc_id, string_agg(
        substr(h, (2 * a + 1)::bigint, (2 * (coalesce(b, len(h) // 2) - a))::bigint), '' order by a) as kept
    from gaps join raw using (doc_id) group by doc_id
), counted as (
    select doc_id, sum(b - a) as n_removed, count(*) as n_spans from runs group by doc_id
)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, h))) as kept_sha256
from raw left join counted using (doc_id) left join cut using (doc_id)
"""

_TOP_K = """
with ints as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from ints q join ints c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), ranked as (
    select query_id, (row_number() over (
        partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
    from scored
)
select * from ranked where rank <= 20
"""

_LEAKS = f"""
with texts as (
    select 'd' as kind, doc_id as id, text from documents
    union all select 'i', item_id, text from benchmark
), words as (
    select kind, id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w
    from texts
), shingles as (
    select distinct kind, id,
           unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) as s
    from words
), sizes as (
    select id, count(*) as n from shingles where kind = 'i' group by id
)
select d.id as doc_id, i.id as item_id, any_value(n) as n_shingles, count(*) as n_shared
from shingles d join shingles i on d.kind = 'd' and i.kind = 'i' and d.s = i.s
join sizes z on z.id = i.id
group by d.id, i.id
having 100 * count(*) >= 80 * any_value(n)
"""

_PERSPECTIVES = """
with turns as (
    select distinct conv_id, turn, turn // 64 as piece,
           replace(replace(coalesce(nullif(trim(role), ''), 'unknown'), '&', '&amp;'), '<|', '&lt;|')
               as role,
           replace(replace(coalesce(text, ''), '&', '&amp;'), '<|', '&lt;|') as text
    from conversations
), speakers as (
    select distinct conv_id, role as speaker from turns where role <> 'system'
), shown as (
    select conv_id, speaker, piece, turn, role, text, role = speaker as own,
           '<|im_start|>' || case when role = 'system' then role when role = speaker
               then 'assistant' else 'user name=' || role end || chr(10) as header
    from turns join speakers using (conv_id)
), placed as (
    select *, header || text || '<|im_end|>' || chr(10) as line,
           coalesce(sum(length(header) + length(text) + 11) over (
               partition by conv_id, speaker, piece order by turn, role, text
               rows between unbounded preceding and 1 preceding), 0) + length(header) as start
    from shown
)
select conv_id, speaker, piece, count(*) as n_turns,
       string_agg(line, '' order by turn, role, text) as rendered,
       coalesce(string_agg(start::bigint || '-' || (start + length(text) + 10)::bigint, ','
                order by turn, role, text) filter (own), '') as mask
from placed group by conv_id, speaker, piece
"""



def _centroids(k: int, rounds: int, width: int, scale: int, seed: int) -> str:
    """One common table per round: nearest centroids, then their vectors' floored means."""
    steps = [
        f"""
with kept as materialized (
    select row_number() over () as r, vec_id,
           list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q
    from embeddings
    where len(embedding) = {width} and len(list_filter(embedding, lambda x: isfinite(x))) = {width}
), m0 as materialized (
    select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c, q as m
    from kept order by c limit {k}
)"""
    ]
    squares = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (q[i] - m[i]) * (q[i] - m[i])))"
    for step in range(rounds + 1):
        steps.append(f""", d{step} as materialized (
    select r, c, {squares}::bigint as d from kept cross join m{step}
), a{step} as materialized (
    select r, (arg_min(c, [d, c]))::int as c, min(d) as d from d{step} group by r
)""")
        if step < rounds:
            steps.append(f""", s{step} as (
    select c, place, sum(part) as total, count(*) as n
    from (select c, unnest(q) as part, unnest(range(1, {width + 1})) as place
          from kept join a{step} using (r)) group by c, place
), v{step} as (
    select c, list(((total - ((total % n) + n) % n) // n)::bigint order by place) as m
    from s{step} group by c
), m{step + 1} as materialized (
    select c, coalesce(v{step}.m, m{step}.m) as m from m{step} left join v{step} using (c)
)""")
    return "".join(steps) + f"""
select vec_id, c as cluster, d as distance,
       (sum(d) over (partition by c))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia,
       sha256(array_to_string(m, ',')) as centroid_sha256
from kept join a{rounds} using (r) join m{rounds} using (c)
"""


# Five hexadecimal digits are four of base 32.
_ARCHIVES = """
with payloads as (
    select page_id, coalesce(html, '') as payload, row_number() over () as r from pages
), ranked as (
    select page_id, octet_length(encode(payload)) as size, sha1(payload) as hex,
           row_number() over (partition by payload order by page_id desc nulls last, r) as place,
           max(page_id) over (partition by payload) as first
    from payloads
)
select page_id, size::bigint as payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4),
           lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::int >> (15 - 5 * j)) & 31)::int, 1)), '')), '')
           as payload_digest,
       case when place = 1 then 'response' else 'revisit' end as record_type,
       case when place > 1 then first end as refers_to
from ranked
"""

ORACLES = {
    "op1_block_top_k": _TOP_K,
    "op4_minhash_near_dedup": _NEAR_DEDUP,
    "op6_benchmark_leaks": _LEAKS,
    "op7_seed_extend_dedup": _PASSAGES,
    "op8_source_mixture": _MIXTURE,
    "op9_chat_perspectives": _PERSPECTIVES,
    "op10_run_index_dedup": _BYTES,
    "op11_table_centroids": _centroids(k=8, rounds=10, width=64, scale=1024, seed=3),
    "op13_warc_archives": _ARCHIVES,
}
