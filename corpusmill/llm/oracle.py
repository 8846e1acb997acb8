"""SQL for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from corpusmill.llm.text_quality import COMMON_WORDS

ITEMS = r"""
recs as (select id, topics, geographic from shelf_features where id is not null),
raw as (select id, unnest(list_concat(coalesce(topics, []), coalesce(geographic, []))) as x from recs),
items as (
  select distinct id, item from (
    select id, nullif(regexp_replace(regexp_replace(lower(x), '[\s\p{Z}_-]+', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '') as item from raw
  ) where item is not null),
n as (select count(distinct id) as n from recs),
cnt as (select item, count(*) as c from items group by item),
ab as (select a.item as item_a, b.item as item_b, count(*) as n_ab from items a join items b on a.id = b.id and a.item < b.item group by 1, 2),
every as (
  select item_a, item_b, n_ab, ca.c as n_a, cb.c as n_b, n.n as n
  from ab join cnt ca on ca.item = item_a join cnt cb on cb.item = item_b cross join n
),
pairs as (select * from every where n_ab >= 5 and n_ab * 1000 >= 4 * n)
"""

P1_FOUND = f"with {ITEMS} select item_a, item_b from pairs where n_ab * n >= 3 * n_a * n_b"

P1_ASSOCIATION = f"""with {ITEMS}
select item_a, item_b, n_ab, n_a, n_b, n,
  floor((n_ab::double * n / (n_a::double * n_b)) * 1e6 + 0.5) / 1e6 as lift,
  floor(ln(n_ab::double * n / (n_a::double * n_b)) * 1e6 + 0.5) / 1e6 as pmi
from pairs"""

P1_PAIRS = f"""with {ITEMS} select item_a, item_b, n_ab, n_a, n_b, floor((n_ab::double * n / (n_a::double * n_b)) * 1e6 + 0.5) / 1e6 as lift from every"""

P4_FOUND = r"""
with al as (
  select distinct facet, term, unnest(case facet
    when 'lcc_code' then [t, 'lcc' || t, t || 'lcc', b, t || b, b || t]
    when 'lcgft_form' then [t, 'lcgft' || t, t || 'lcgft']
    else [t, 'register' || t, t || 'register'] end) as key
  from (select facet, term, regexp_replace(lower(term), '[^\p{L}\p{N}]+', '', 'g') as t, regexp_replace(lower(broader), '[^\p{L}\p{N}]+', '', 'g') as b
        from label_space where facet <> 'model')
  union select facet, term, regexp_replace(lower(term), '[^\p{L}\p{N}]+', '', 'g') from label_space where facet = 'model'),
v as (
  select id, 'lcc_code' as facet, regexp_replace(lower(lcc_code), '[^\p{L}\p{N}]+', '', 'g') as key from shelf_features
  union all select id, 'lcgft_form', regexp_replace(lower(lcgft_form), '[^\p{L}\p{N}]+', '', 'g') from shelf_features
  union all select id, 'register', regexp_replace(lower(register), '[^\p{L}\p{N}]+', '', 'g') from shelf_features
  union all select id, 'model', regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(model)), '^.*/', ''), '[:@](free|paid|latest|beta|preview|community|self|extended)\s*$', ''), '^[^:@]*[:@]', ''), '[^\p{L}\p{N}]+', '', 'g') from shelf_features),
have as (select facet, term as category, count(distinct id) as available from v join al using (facet, key) where id is not null group by 1, 2),
n as (select count(distinct id) as n from shelf_features)
select facet, category from sample_targets left join have using (facet, category) cross join n
where coalesce(available, 0) < greatest(target_share * sample_fraction * n.n, min_records)
"""

P7_FOUND = r"""
with recursive k as (
  select distinct id, model, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(model, E' \n\t\r')), '^.*/', ''), '[:@](free|paid|latest|beta|preview|community|self|extended)\s*$', ''), '^[^:@]*[:@]', ''), '([0-9])[^\p{L}\p{N}]+([0-9])', '\1~\2', 'g'), '[^\p{L}\p{N}~]+', '', 'g') as key
  from shelf_features where trim(model, E' \n\t\r') <> ''),
e as (select distinct a.key as u, b.key as v from k a join k b on a.id = b.id),
reach(u, v) as (select distinct key, key from k union select r.u, e.v from reach r join e on e.u = r.v),
comp as (select u as key, min(v) as comp from reach group by u),
vals as (select distinct model, comp from k join comp using (key))
select a.model as model_a, b.model as model_b from vals a join vals b on a.comp = b.comp and a.model < b.model
"""


#: Groups of rows by writing model and id, put one by one, largest first, into the split furthest below its target.
P7_SHARES = r"""
with recursive k as (
  select rec_no, nullif(trim(id), '') as id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(model, E' \n\t\r')), '^.*/', ''), '[:@](free|paid|latest|beta|preview|community|self|extended)\s*$', ''), '^[^:@]*[:@]', ''), '([0-9])[^\p{L}\p{N}]+([0-9])', '\1~\2', 'g'), '[^\p{L}\p{N}~]+', '', 'g'), '') as key from shelf_features),
e as (select distinct a.key as u, b.key as v from k a join k b on a.id = b.id and a.key is not null and b.key is not null union select distinct key, key from k where key is not null),
reach(u, v) as (select distinct key, key from k where key is not null union select r.u, e.v from reach r join e on e.u = r.v),
comp as (select u as key, min(v) as comp from reach group by u),
byid as (select id, min(comp) as comp from k left join comp using (key) where id is not null group by id),
rw as (select rec_no, coalesce('m' || coalesce(comp.comp, byid.comp), 'i' || k.id, 'r' || rec_no) as g from k left join comp using (key) left join byid on byid.id = k.id),
sz as (select g, count(*) as n from rw group by g), od as (select n, row_number() over (order by n desc, g) as i from sz), tot as (select sum(n)::double as t from sz),
put(i, a, b, c, na, nb, nc) as (
  select 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint
  union all select od.i, a + case w when 1 then n else 0 end, b + case w when 2 then n else 0 end, c + case w when 3 then n else 0 end, na + (w = 1)::bigint, nb + (w = 2)::bigint, nc + (w = 3)::bigint
  from (select put.*, case when 0.8 * t - a >= 0.1 * t - b and 0.8 * t - a >= 0.1 * t - c then 1 when 0.1 * t - b >= 0.1 * t - c then 2 else 3 end as w from put cross join tot) p join od on od.i = p.i + 1)
select split, target_share, n_rows, n_groups, floor(n_rows / t * 1e6 + 0.5) / 1e6 as share_reached from (select * from put order by i desc limit 1) cross join tot cross join lateral (values ('train', 0.8::double, a, na), ('validation', 0.1::double, b, nb), ('test', 0.1::double, c, nc)) x(split, target_share, n_rows, n_groups)
"""

#: Sets of three-word runs of every row, one head for each set, and all pairs of heads that agree to 0.6: plain comparison of everything that shares a run.
SIMILAR = r"""
tk as (select rec_no, split, model, regexp_extract_all(strip_accents(lower(TEXT)), '[\p{L}\p{N}]+') as ts from shelf_features where TEXT is not null),
sh as (select rec_no, split, model, hash(list_sort(ss)) as h, ss from (select rec_no, split, model, case when len(ts) < 3 then [array_to_string(ts, ' ')] else list_distinct([array_to_string(ts[i:i+2], ' ') for i in range(1, len(ts) - 1)]) end as ss from tk where len(ts) > 0)),
hd as (select min(rec_no) as head, h, any_value(ss) as ss, len(any_value(ss)) as n from sh group by h),
ex as (select head, n, hash(unnest(ss)) as s from hd),
it as (select a.head as a, b.head as b, count(*) as m from ex a join ex b on a.s = b.s and a.head < b.head and least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) group by 1, 2),
sim as (select a, b from it join hd x on x.head = a join hd y on y.head = b where m >= 0.6 * (x.n + y.n - m)),
rw as (select sh.rec_no, sh.split, sh.model, hd.head from sh join hd using (h))"""
OVERLAPS = f"""with {SIMILAR.replace('TEXT', 'text')}, ln as (select a, b from sim union all select b, a from sim union all select head, head from hd),
ov as (select t.rec_no as train_row, e.rec_no as eval_row, e.split as eval_split, e.model as source from rw t join ln on ln.a = t.head join rw e on e.head = ln.b where t.split = 'train' and e.split in ('dev', 'test'))"""
P3_FOUND = f"{OVERLAPS} select distinct least(train_row, eval_row) as rec_a, greatest(train_row, eval_row) as rec_b from ov"
P3_COUNTS = f"{OVERLAPS} select eval_split, source, count(distinct eval_row) as eval_rows, count(*) as pairs from ov group by 1, 2"
GROUPS = f"""with recursive {SIMILAR.replace('TEXT', 'body')}, ed as (select a as u, b as v from sim union all select b, a from sim),
reach(u, v) as (select distinct u, u from ed union select r.u, ed.v from reach r join ed on ed.u = r.v),
cp as (select u as head, min(v) as comp from reach group by u), dg as (select u as head, count(*) as links from ed group by 1),
gr as (select rec_no, coalesce(comp, rw.head) as g, coalesce(links, 0) as links from rw left join cp using (head) left join dg using (head)),
ok as (select g, min(rec_no) as least from gr group by g having count(*) > 1)"""
P5_GROUPS = f'{GROUPS} select rec_no, least as "group", links from gr join ok using (g)'
P5_FOUND = f"{GROUPS} select x.rec_no as rec_a, y.rec_no as rec_b from gr x join gr y on x.g = y.g and x.rec_no < y.rec_no"

WS = r" \t\n\x0b\f\r"
QUALITY = rf"""
b as (select rec_no, coalesce(body, '') as t from shelf_features),
l as (select rec_no, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as ls, regexp_extract_all(t, '[^{WS}]+') as ws, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}''’]+'), lambda x: x <> '') as bare from b),
m as (select *, list_filter(ls, lambda x: regexp_matches(x, '^[{WS}]*(?:[-*+•‣◦▪●–—»·]|\(?[0-9]{{1,3}}[.)\]]|\(?[a-zA-Z][.)])[{WS}]')) as bs, case when len(ls) > 1 then ls else string_split(regexp_replace(trim(t, ' '), '([.!?])[{WS}]+', '\1' || chr(1), 'g'), chr(1)) end as us from l),
q as (select rec_no, len(ws) as n, len(ls) as nl, (length(t) - len(regexp_extract_all(t, '[{WS}]'))) / nullif(len(ws), 0) as mean_len, len(regexp_extract_all(t, '[#<>{{}}|\[\]=\\^~_\t]|\.\.\.|…')) / nullif(len(ws), 0) as symbols, len(regexp_extract_all(t, '[^{WS}]*\p{{L}}[^{WS}]*')) / nullif(len(ws), 0) as alpha,
 len(bs) / nullif(len(ls), 0) as bullets, coalesce(list_sum(list_transform(bs, lambda x: len(regexp_extract_all(x, '[^{WS}]+')))), 0) / nullif(len(ws), 0) as bullet_words, len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…)[{WS}]*$'))) / nullif(len(ls), 0) as ellipses,
 len(list_filter(bare, lambda x: x in (COMMON))) / nullif(len(bare), 0) as common, len(us) - len(list_distinct(us)) as dup, (len(us) - len(list_distinct(us))) / nullif(len(us), 0) as dup_share from m)"""
P6_FOUND = f"""with {QUALITY.replace('COMMON', ', '.join("'" + w + "'" for w in sorted(set(COMMON_WORDS))))} select rec_no from q where n > 0 and (coalesce(common < 0.1, false) or coalesce(bullets > 0.8 or (bullet_words > 0.6 and nl > 4), false) or coalesce(symbols > 0.1 and common < 0.25, false) or coalesce(alpha < 0.8, false) or coalesce(mean_len < 3 or mean_len > 10, false) or coalesce(ellipses > 0.3 and nl > 3, false) or coalesce(dup_share > 0.3 and dup >= 3, false))"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_association": P1_ASSOCIATION, "p1_pairs": P1_PAIRS, "p3_found": P3_FOUND, "p3_counts": P3_COUNTS, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_groups": P5_GROUPS, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p7_shares": P7_SHARES}
