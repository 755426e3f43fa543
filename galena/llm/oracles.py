"""SQL twins of the corpus queries that SQL can express, by plain comparison of words and windows."""

from galena.llm.exprs import LOWER, UPPER
from galena.llm.quality_rules import CUTOFFS, DELTA, RISK

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP3 = rf"""
with recursive w as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) same from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 75 * (x.n + y.n - same)),
e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.c = e.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id from documents d left join n using (doc_id) join (select doc_id, min(c) c from r group by 1) m using (doc_id)"""

OP6 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) m from (select doc_id, h, unnest(range(0, cast(length(h) // 2 - 399 as bigint))) i from d where length(h) >= 800)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by m) c from w) where c > 1),
s as (select doc_id, i, sum(b) over (partition by doc_id order by i) k from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 400 then 0 else 1 end b from r)),
sp as (select doc_id, k, min(i) a, max(i) + 400 z from s group by 1, 2),
kp as (select doc_id, string_agg(substr(h, 2 * pz + 1, 2 * (a - pz)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) kept, cast(sum(z - a) as bigint) n_removed, count(*) n_spans
 from (select doc_id, a, z, h, coalesce(lag(z) over (partition by doc_id order by a), 0) pz from sp join d using (doc_id)) group by 1)
select doc_id, cast(length(h) // 2 as bigint) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256, coalesce(n_removed, 0) > 0 has_repeat from d left join kp using (doc_id)"""

OP8 = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) p from documents),
v as (select *, row_number() over (partition by doc_id order by p) r from (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) w from l) where w > 0),
m as (select a.doc_id k, b.doc_id o, a.r - b.r dg, a.r i, a.p, a.w from v a join v b on a.line = b.line and b.doc_id < a.doc_id),
s as (select *, i - row_number() over (partition by k, o, dg order by i) g from m),
ok as (select k, o, dg, g from s group by all having sum(w) >= 20),
gone as (select distinct k doc_id, p from s join ok using (k, o, dg, g)),
c as (select doc_id, count(*) n_lines, count(g.p) n_removed, string_agg(case when g.p is null then line end, chr(10) order by l.p) kept from l left join gone g using (doc_id, p) group by 1)
select doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) kept_sha256 from c"""

OP9 = rf"""
with w as (select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from documents),
v as (select doc_id, i, list_slice(ws, i, i + 7) g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
h as (select doc_id, count(distinct i + k) n from (select doc_id, i, count(*) over (partition by doc_id, g) c from v), range(8) r(k) where c > 1 group by 1),
b as (select doc_id, lang, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
 cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, coalesce(n, 0) n_repeat_words, len(ls) n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '!!|^\p{{Lu}}{{2,}}\W*$'))) n_shouts from w left join h using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from b),
s as (select *, [coalesce(n_symbols / nullif(word_chars, 0), 0), coalesce(n_dup_lines / nullif(n_lines, 0), 0), coalesce(n_repeat_words / nullif(n_words, 0), 0), coalesce(n_shouts / nullif(n_words, 0), 0)] x from f),
y as (select *, list_transform(x, lambda v: len(list_filter({list(CUTOFFS)}, lambda c: v > c))) e from s),
k as (select lang, quality, e from y join labels using (doc_id) where quality = 1 or (quality = 0 and not base_failed)),
g as (select *, coalesce(sum(n) over (order by n, lang nulls first rows between unbounded preceding and 1 preceding), 0) u, ceil(ln({DELTA} / count(*) over ()) / ln(1 - {RISK})) m
 from (select lang, count(*) n from k where quality = 1 group by 1)),
o as (select lang, case when n < m or (u > 0 and u < m) then '*' else coalesce('=' || lang, '-') end part from g),
kp as (select part, quality, e from k join o on k.lang is not distinct from o.lang),
c as (select part, r, count(*) caught, min(e[r]) - 1 lim from kp, range(1, 5) t(r) where quality = 0 and e[r] > 0 group by 1, 2),
q as (select *, row_number() over (partition by part order by caught desc, r) place from c),
st as (select part, place, r, unnest(range(lim, {len(CUTOFFS)})) i from q),
pa as (select st.part, st.place * {len(CUTOFFS)} - st.i step, m, case when m = st.r then st.i when q.place < st.place then q.lim else {len(CUTOFFS)} end lim from st, range(1, 5) u(m) left join q on q.part = st.part and q.r = m),
pl as (select part, step, list(lim order by m) lims from pa group by 1, 2),
n as (select part, step, lims, count(*) n, count(*) filter (where e[1] > lims[1] or e[2] > lims[2] or e[3] > lims[3] or e[4] > lims[4]) k from pl join kp using (part) where quality = 1 group by 1, 2, 3),
pv as (select part, step, lims, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) p from (select *, unnest(range(0, k + 1)) i from n) group by 1, 2, 3),
ok as (select part, step, lims from pv where step < coalesce((select min(step) from pv z where z.part = pv.part and z.p > {DELTA} / (select count(distinct part) from o)), 1e9)),
ch as (select lang, arg_max(lims, step) lims from ok join o using (part) group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
not base_failed and not coalesce(e[1] > lims[1] or e[2] > lims[2] or e[3] > lims[3] or e[4] > lims[4], false) kept from y left join ch on y.lang is not distinct from ch.lang"""

OP10 = rf"""
with d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
g as (select item_id, least(len(ws), 13) n, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') g from (select item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) i from b where len(ws) > 0)),
v as (select doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, (select distinct n from g) where len(ws) >= n)),
h as (select doc_id, item_id, i, n from v join g using (n, g)),
c as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from h) group by 1),
t as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) ids from (select distinct doc_id, cast(item_id as varchar) x from h) group by 1)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated from d left join c using (doc_id) left join t using (doc_id)"""

#: The checksum goes byte by byte through a table made by its rule; near words are found by leaving each letter out.
OP11 = r"""
with recursive bit(i, v, k) as (select i, i, 0 from range(256) r(i) union all select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bit where k < 8),
tab as (select list(v order by i) t from bit where k = 8),
r as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) w from documents),
c as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w, count(*) n from r group by 1, 2),
x as (select doc_id, w, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || w)) x from c),
h as (select w, n, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint)), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295)) h from x, tab),
m as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end w, n from h),
v as (select w, cast(sum(n) as bigint) n from m where length(w) >= 5 group by 1 having sum(n) >= 3),
d as (select w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) g from (select w, n, unnest(range(1, length(w) + 1)) i from v)),
p as (select a.w a, b.w b, b.n from d a join d b using (i, g) where a.w <> b.w union select d.w, v.w, v.n from d join v on d.g = v.w union select v.w, d.w, d.n from d join v on d.g = v.w),
f as (select a, count(*) near, max(n) most, min_by(b, (-n, b)) best from p group by 1),
o as (select v.w, v.n, coalesce(near, 0) near, case when most >= 2 * v.n then best end form, case when most >= 2 * v.n then most end form_n from v left join f on v.w = f.a),
e(w, far) as (select w, w from o union all select e.w, o.form from e join o on e.far = o.w where o.form is not null)
select o.w as word, o.form, e.far as root, o.n, o.near as n_near, o.form_n from o join e on e.w = o.w join o z on z.w = e.far where z.form is null"""
