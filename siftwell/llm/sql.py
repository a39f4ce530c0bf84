"""DuckDB SQL for the results of the corpus operators, where SQL can express them."""

from __future__ import annotations

from .quality import CALLS, CAPITAL, CLOSED, NOTICES, SENTENCE, at_edge

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP3 = rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) as sh from w where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by 1),
links as materialized (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach as (select doc_id, doc_id as root from documents union select l.b, r.root from reach r join links l on l.a = r.doc_id)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.root) as component_id, d.doc_id = min(r.root) as kept
from documents d join reach r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""

_EDGES = {"notice": at_edge(NOTICES).replace("'", "''"), "call": at_edge(CALLS), "closed": CLOSED.replace("'", "''"), "sentence": SENTENCE.replace("'", "''")}

#: The line rules and the base measures; gives doc_id and all measures.
QUALITY = rf"""
w as (select doc_id, coalesce(text, '') as text, {WORDS} as ws from documents),
win as (select doc_id, unnest(range(0, len(ws) - 7)) as p, ws from w),
hashed as (select doc_id, p, array_to_string(ws[p + 1:p + 8], ' ') as h from win),
twice as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, h) as k from hashed) where k > 1),
cover as (select doc_id, sum(least(8, coalesce(nx - p, 8)))::bigint as n_repeat_words from (select doc_id, p, lead(p) over (partition by doc_id order by p) as nx from twice) group by 1),
l0 as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
l1 as (select *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') as lw from l0),
l2 as (select *, len(lw) as n, len(regexp_extract_all(line, '[|»›•]')) as seps, not regexp_matches(line, '{_EDGES["closed"]}') and not regexp_matches(line, '{_EDGES["sentence"]}') as bare from l1),
l3 as (select *, n > 0 and (
    (seps >= 3 and seps * 4 >= n) or len(regexp_extract_all(line, '[#*$%&|<>]')) * 2 > n or (n >= 3 and len(regexp_extract_all(line, '!!')) * 2 > n)
    or (bare and coalesce(lead(bare) over (partition by doc_id order by i), true) and (n <= 7 or len(regexp_extract_all(line, '{CAPITAL}')) * 100 >= n * 60))
    or (n <= 20 and regexp_matches(line, '(?i){_EDGES["notice"]}')) or ((n <= 4 or (bare and n <= 8)) and regexp_matches(line, '(?i){_EDGES["call"]}'))
    or (n >= 12 and len(list_distinct(lw)) * 100 < n * 34)) as fails from l2 where n > 0),
counts as (select doc_id, count(*) - count(distinct line) as n_dup_lines, coalesce(sum(n) filter (not fails), 0)::bigint as n_clean_words, count(*) filter (fails) as n_removed_lines from l3 group by 1),
lines as (select doc_id, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_clean_words, 0) as n_clean_words, coalesce(n_removed_lines, 0) as n_removed_lines from w left join counts using (doc_id)),
base as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  n_clean_words, n_removed_lines::bigint as n_removed_lines from w join lines using (doc_id) left join cover using (doc_id)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base)
"""

OP5 = f"with {QUALITY} select *, not base_failed and n_clean_words * 100 >= n_words * 50 as kept from judged"

OP7 = r"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as x from p),
b as (select *, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
  (((('0x' || x[5 * (i // 4) + 1:5 * (i // 4) + 5])::bigint >> (5 * (3 - i % 4))) & 31) + 1)::int]), '') as payload_digest from d),
m as (select *, min(page_id) over (partition by x) as first from b)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from m
"""

OP10 = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
win as (select doc_id, ws, unnest(range(0, len(ws) - 49)) as p from w),
h as (select doc_id, p, md5(array_to_string(ws[p + 1:p + 50], ' ')) as h from win),
hit as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by h) as first from h) where first < doc_id),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as i from hit),
words as (select doc_id, unnest(range(0, len(ws))) as i, unnest(ws) as word from w),
rest as (select words.doc_id, string_agg(word, ' ' order by words.i) as text, count(*) as n from words anti join gone on gone.doc_id = words.doc_id and gone.i = words.i group by 1)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(rest.text, '')) as kept_sha256
from w left join rest on rest.doc_id = w.doc_id
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
with d as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS}) as term from documents) group by all),
sizes as (select doc_id, sum(tf)::bigint as n from d group by 1),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as terms from sizes),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from d, corpus group by term, docs),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
scored as (select q.item_id, d.doc_id, sum(q.times * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * sizes.n * docs) // terms))))::bigint as score
  from q join weights using (term) join d using (term) join sizes on sizes.doc_id = d.doc_id, corpus group by 1, 2)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0) where rank <= 10
"""

#: The checksum's table follows from its polynomial; near words share what a deleted code point leaves.
OP12 = r"""
with recursive t as (select list(list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b) order by b) as tab from range(256) z(b)),
run as (select doc_id, w, count(*) as k from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as w from documents) group by all),
hexed as (select *, hex(encode(doc_id || ':' || w)) as x from run),
summed as (select w, k, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint), lambda c, y: xor(c // 256, tab[(xor(c, y) % 256 + 1)::int]), 4294967295::bigint), 4294967295) as h from hexed, t),
cut as (select case when h % 97 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, k from summed),
v as materialized (select word, sum(k)::bigint as n from cut where length(word) >= 5 group by 1 having sum(k) >= 3),
del as materialized (select word, n, i, left(word, (i - 1)::int) || substr(word, (i + 1)::int) as rest from v, unnest(range(1, length(word) + 1)) u(i)),
near as (select distinct word, other, other_n from (
  select a.word, b.word as other, b.n as other_n from del a join del b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union all select d.word, v.word, v.n from del d join v on d.rest = v.word union all select v.word, d.word, d.n from del d join v on d.rest = v.word)),
best as (select word, count(*) as n_near, min({'m': -other_n, 'o': other}) as b from near group by 1),
f as materialized (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when -b.m >= 2 * v.n then b.o end as form, case when -b.m >= 2 * v.n then -b.m end as form_n from v left join best using (word)),
r as (select word, word as at, 0 as step from f union all select r.word, f.form, step + 1 from r join f on f.word = r.at where f.form is not null)
select f.word, f.form, arg_max(r.at, r.step) as root, f.n, f.n_near, f.form_n::bigint as form_n from f join r on r.word = f.word group by all
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_setsketch_neardup": OP3, "op5_line_first_quality": OP5, "op7_warc_segments": OP7, "op10_phrase_automata": OP10, "op11_ranked_search": OP11, "op12_spelling_variants": OP12}
