"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

WARC = """
with read as (
    select page_id, url, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
    select payload_digest, min(page_id) as first_id from read where payload_bytes >= 100 group by payload_digest
)
select page_id, payload_bytes, payload_digest,
       case when page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when page_id <> first_id then first_id end as refers_to, url
from read left join firsts using (payload_digest)
"""


_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"

# Candidates need no seeds: of n tokens with r replaced, some run of (n - r) / (r + 1) is whole, rounded up.
DECONTAMINATION = f"""
with items as (
    select tokens, min(item_id) as item_id, len(tokens)::bigint as n from (select item_id, {_TOKENS} as tokens from benchmark) where len(tokens) > 0 group by tokens
), sized as (
    select *, case when n >= 20 then 4 when n >= 10 then 3 when n >= 5 then 2 else n end as run from items
), texts as (
    select row_number() over () as r, doc_id, {_TOKENS} as tokens from documents
), lengths as (select distinct run from sized), wanted as (
    select item_id, run, i as item_place, list_slice(tokens, i + 1, i + run) as words from (select *, unnest(range(n - run + 1)) as i from sized)
), runs as (
    select r, run, i as place, list_slice(tokens, i + 1, i + run) as words from (select *, unnest(range(len(tokens) - run + 1)) as i from texts, lengths where len(tokens) >= run)
), hits as (
    select distinct r, item_id, place - item_place as shift from runs join wanted using (run, words)
), same as (
    select hits.r, doc_id, hits.item_id, shift, n, least(n, 20) as stretch,
           list_transform(range(n), lambda j: case when shift + j >= 0 and texts.tokens[shift + j + 1] = items.tokens[j + 1] then 1 else 0 end) as same
    from hits join texts using (r) join items on items.item_id = hits.item_id
    where n >= 3 or (shift = 0 and len(texts.tokens) = n)
), sums as (
    select doc_id, item_id, stretch, shift + i as position, list_sum(list_slice(same, i + 1, i + stretch))::bigint as matched
    from (select *, unnest(range(n - stretch + 1)) as i from same)
), good as (
    select *, row_number() over (partition by doc_id, item_id order by matched desc, position) as place
    from sums where matched >= ceil(stretch * 0.8::double)
)
select doc_id, item_id, matched, stretch, position from good where place = 1
"""


FILL_IN_MIDDLE = r"""
with units as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
           list_filter(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda u: u <> '') as u
    from documents
), drawn as (
    select doc_id, text, u, len(u)::bigint as n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::bigint) as h from units
), cuts as (
    select *, least(h[1] % (n + 1), h[2] % (n + 1)) as low, greatest(h[1] % (n + 1), h[2] % (n + 1)) as high,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form
    from drawn
), parts as (
    select *, coalesce(array_to_string(u[1:low], ''), '') as prefix, coalesce(array_to_string(u[low + 1:high], ''), '') as middle, coalesce(array_to_string(u[high + 1:], ''), '') as suffix from cuts
)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""


def _codes() -> str:
    """Two rounds of assigning and replacing, then the codes; vectors as rows of (vector, part, place, value)."""
    steps = []
    for k in range(3):
        steps.append(f"""
near{k} as (
    select r, part, arg_min(entry, (distance, entry)) as entry, min(distance) as distance
    from (select v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x))::bigint as distance from cells v join book{k} b using (part, place) group by all) group by all
)""")
        if k < 2:
            steps.append(f"""
book{k + 1} as (
    select b.part, b.entry, b.place, coalesce(n.x, b.x) as x from book{k} b left join (
        select part, entry, place, floor(sum(x)::double / count(*))::bigint as x from cells join near{k} using (r, part) group by all
    ) n using (part, entry, place)
)""")
    return f"""
with good as (
    select vec_id, label, embedding, row_number() over (order by vec_id, embedding) as r from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cells as (
    select r, (i // w)::int as part, (i % w)::int as place, floor(embedding[i + 1]::double * 256)::bigint as x
    from (select r, embedding, len(embedding) // 16 as w, unnest(range(len(embedding))) as i from good)
), book0 as (select part, (r - 1)::int as entry, place, x from cells where r <= 64), {",".join(steps)},
coded as (select r, string_agg(lower(printf('%02x', entry)), '' order by part) as code, sum(distance)::bigint as error from near2 group by r),
books as (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) as codebooks_sha256 from book2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join good using (r), books
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query."""
    return {"op6_warc": WARC, "op9_decontamination": DECONTAMINATION, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_vector_codes": _codes()}
