"""DuckDB SQL of the registered queries' results."""

from __future__ import annotations

PHOTOS = """
p as (select (k // 250)::bigint as session_id, (k % 250)::int as upload_idx, k as photo_id, n_chars * 1000 as size,
  case when k % 7 <> 0 then 1704067200000 + floor((ms - 1704067200000) / 300)::bigint end as taken_at_ms,
  case when k % 3 <> 0 then embedding::double[] end as embedding,
  case when k % 50 = 0 then repeat('f', 64) else concat(substr(sha256(source), 1, 56), substr(sha256(text), 1, 8)) end as hash,
  list_transform(range(32), lambda i: (60 + (label * 17 + i * 5) % 60 + k % 4)::int) as color_signature,
  (1 + k * 37 % 100)::double as sharpness, 0.005::double + (k * 53 % 97) / 400::double as focus, 0.5::double + (k * 29 % 41) / 10::double as noise_ratio,
  (5 + k * 17 % 61)::double as contrast, (20 + k * 43 % 221)::double as brightness, (k * 31 % 89) / 300::double as hi, (k * 23 % 83) / 310::double as lo,
  (30 + k * 19 % 151)::double as dynamic_range, (5 + k * 13 % 59)::double as colorfulness
  from (select e.vec_id as k, e.embedding, e.label, d.text, d.source, d.n_chars, epoch_us(v.ts) // 1000 as ms
    from embeddings e join documents d on d.doc_id = e.vec_id join events v on v.event_id = e.vec_id))"""


def _ramp(x: str, a: float, b: float) -> str:
    return f"greatest(0::double, least(1::double, (({x}) - {a}::double) / ({b}::double - {a}::double)))"


def _log(x: str, a: float, b: float) -> str:
    from math import log10

    return _ramp(f"log10(greatest({x}, 1e-6::double))", log10(a), log10(b))


SCORED = f"""{PHOTOS},
q as (select *, least({_log('focus', 0.01, 0.12)}, {_log('sharpness', 2, 40)}) * (1::double - 0.6::double * {_ramp('noise_ratio', 1.2, 3.5)}) as focus_score,
  0.6::double * (1::double - {_ramp('greatest(hi, lo)', 0.02, 0.15)}) + 0.4::double * case when brightness < 110 then {_ramp('brightness', 35, 110)} else 1::double - {_ramp('brightness', 150, 235)} end as exposure_score,
  0.6::double * {_ramp('dynamic_range', 40, 170)} + 0.4::double * {_ramp('contrast', 12, 55)} as tone_score, {_ramp('colorfulness', 8, 55)} as color_score from p),
s as (select *, 0.5::double * focus_score + 0.3::double * exposure_score + 0.1::double * tone_score + 0.1::double * color_score as score,
  case when focus_score < 0.3::double then 'out of focus' when hi > 0.25::double then 'blown highlights' when lo > 0.25::double then 'crushed shadows' end as rejected_for from q),
r as (select *, row_number() over (partition by session_id order by floor(score * 100 + 0.5::double) desc, size desc, upload_idx)::int as rank from s)"""

_WORDS = [f"bit_count(xor(('0x' || substr(a.hash, {8 * i + 1}, 8))::bigint, ('0x' || substr(b.hash, {8 * i + 1}, 8))::bigint))::int" for i in range(8)]
_ONES = "(" + " + ".join(f"bit_count(('0x' || substr(hash, {8 * i + 1}, 8))::bigint)::int" for i in range(8)) + ")"
_COLOR = "list_sum(list_transform(list_zip(a.color_signature, b.color_signature), lambda z: abs(z[1] - z[2])::double)) / 32"
_DOT = "list_dot_product(a.embedding, b.embedding)"


def _pairs(threshold: float = 0.35) -> str:
    return f"""{SCORED},
h as (select *, {_ONES} as ones from r),
j as (select a.session_id, a.photo_id as a, b.photo_id as b, a.rank as ra, b.rank as rb, ({" + ".join(_WORDS)})::bigint as bits, {_COLOR} as color,
  case when a.embedding is not null and b.embedding is not null then {_DOT} end as cosine, abs(a.taken_at_ms - b.taken_at_ms) as gap,
  a.ones between 26 and 230 and b.ones between 26 and 230 as structured
  from h a join h b on a.session_id = b.session_id and a.rank < b.rank),
n as (select *, case when cosine is not null then cosine >= {threshold}::double when bits > 48 then false when structured and bits <= 10 and color <= 4 then true
    when gap is null then false when gap > 30000 then false else color <= 10 end as near,
  case when cosine is not null then greatest(0::double, least(1::double, (cosine - 0.19::double) / 0.81::double))
    else 0.5::double * (1::double - least(1::double, color / 40)) + 0.3::double * (1::double - least(1::double, bits / 128::double)) + 0.2::double * coalesce(1::double - least(1::double, gap / 1200000::double), 0) end as sim from j)"""


_CONTENT = "case when embedding is not null then 5.0::double + list_sum(list_transform(embedding, lambda x, i: x * (((((i - 1) * 37) % 64 - 32) / 16.0)::double))) end"

TAPS = """
t as (select user_id % 10 as session_id, event_id % 20 as photo_id, case when event_type in ('click', 'purchase') then 'like' else 'reject' end as action, ts, event_id
  from events where event_type in ('click', 'purchase', 'error')),
tl as (select *, row_number() over w as i, last_value(action) over (partition by session_id, photo_id order by ts, event_id rows between unbounded preceding and unbounded following) as last
  from t window w as (partition by session_id, photo_id order by ts, event_id)),
st as (select session_id, photo_id, any_value(last) as action from tl group by 1, 2 having (max(i) - coalesce(max(i) filter (action <> last), 0)) % 2 = 1)"""

_LEADERS = """
g as (select session_id, 0 as step, []::int[] as leaders, 0 as last from (select distinct session_id from r)
  union all select g.session_id, step + 1, case when hit is null then list_append(leaders, step + 1) else leaders end, coalesce(hit, step + 1) from (
    select g.session_id, g.step, g.leaders, (select min(n.ra) from n where n.session_id = g.session_id and n.rb = g.step + 1 and n.near and list_contains(g.leaders, n.ra)) as hit
    from g where step < (select count(*) from r where r.session_id = g.session_id)) g),
lead as (select session_id, step as rank, last as lead_rank from g where step > 0),
grp as (select l.session_id, b.photo_id as leader_id, a.photo_id, row_number() over (partition by l.session_id, l.lead_rank order by l.rank) - 1 as rank_in_group, a.rank
  from lead l join r a on a.session_id = l.session_id and a.rank = l.rank join r b on b.session_id = l.session_id and b.rank = l.lead_rank)"""


def _greedy(pool: str, k: str, weight: float = 0.15) -> str:
    """Greedy picks over a CTE (session_id, photo_id, rank, value), with the similarities of n."""
    return f"""
sims as materialized (select session_id, a as x, b as y, sim from n union all select session_id, b, a, sim from n),
pk as (select session_id, 0 as step, []::bigint[] as chosen from (select distinct session_id from {pool})
  union all select session_id, step + 1, list_append(chosen, nxt) from (
    select c.session_id, c.step, c.chosen, (select arg_max(q.photo_id, {{'v': q.value - {weight}::double * greatest(0, coalesce((select max(sims.sim) from sims where sims.x = q.photo_id and sims.session_id = c.session_id and list_contains(c.chosen, sims.y)), 0)), 't': -q.rank}})
      from {pool} q where q.session_id = c.session_id and not list_contains(c.chosen, q.photo_id)) as nxt
    from pk c where c.step < (select {k} from {pool} q where q.session_id = c.session_id)) where nxt is not null),
full_ as (select session_id, arg_max(chosen, step) as chosen from pk group by 1)"""


_PX = """
px as (select vec_id as photo_id, i % 48 as x, i // 48 as y from embeddings, range(1920) t(i)),
c as (select photo_id, x::int as x, y::int as y, ((x * 7 + y * 3 + photo_id * 31 + (x * y) % 11) % 256)::double as r, ((x * 5 + y * 11 + photo_id * 17) % 256)::double as g, ((x * y + photo_id * 13) % 256)::double as b from px),
l as (select *, (0.299::double * r + 0.587::double * g + 0.114::double * b)::float::double as luma from c),
v as (select *, least(255, greatest(0, floor(luma + 0.5::double)))::int as level from l)"""


def _laplace(src: str, where: str = "") -> str:
    return f"""(select photo_id, var_pop(lap) as v from (select photo_id, x, y, lag(luma) over rx + lead(luma) over rx + lag(luma) over cy + lead(luma) over cy - 4 * luma as lap from {src}
  window rx as (partition by photo_id, y order by x), cy as (partition by photo_id, x order by y)) {where} group by 1)"""


_CELLS = lambda n, size: f"(select c, unnest(range(c * {size} // {n}, greatest(c * {size} // {n} + 1, (c + 1) * {size} // {n}))) as at from range({n}) t(c))"

_ACTED = f"""{TAPS},
ap as (select p.session_id, p.photo_id, st.action, p.embedding from st join p on p.session_id = st.session_id and p.upload_idx = st.photo_id),
lab as (select * from ap where embedding is not null),
md as (select session_id, action, i, avg(x) as m from (select session_id, action, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from lab) group by 1, 2, 3),
mu as (select *, m / sqrt(sum(m * m) over (partition by session_id, action)) as u from md),
df as (select a.session_id, a.i, a.u - b.u as w from mu a join mu b on a.session_id = b.session_id and a.i = b.i and a.action = 'like' and b.action = 'reject'),
nl as (select session_id, least(count(*) filter (action = 'like'), count(*) filter (action = 'reject')) as n from lab group by 1),
td as (select df.session_id, least(1::double, n / 10::double) as confidence, i, w / sqrt(sum(w * w) over (partition by df.session_id)) as x from df join nl on nl.session_id = df.session_id where n >= 3),
tv as (select session_id, any_value(confidence) as confidence, list(x order by i) as vector from td group by 1)"""

_BASE = f"""
bc as (select session_id, c, row_number() over (partition by session_id order by c) as i, count(*) over (partition by session_id) as n from (select session_id, {_CONTENT} as c from r) where c is not null),
bl as (select session_id, quantile_cont(c, 0.5) as median, max(c) filter (i = least(n - 1, floor(n * 0.75::double)) + 1) as standout from bc where n >= 4 group by 1)"""

_K = "case when {n} <= 0 then 0 else least({n}, greatest(5, least(50, floor({n} * 0.1::double + 0.5::double)))) end::bigint"


def oracle_sql() -> dict[str, str]:
    from . import intake_sql

    return _selection_sql() | intake_sql.oracle_sql()


def _selection_sql() -> dict[str, str]:
    pairs = _pairs()
    r6 = lambda *cs: ", ".join(f"round({c}, 6) as {c}" for c in cs)
    return {
        "score_photos": f"with {SCORED} select session_id, photo_id, {r6('focus_score', 'exposure_score', 'tone_score', 'color_score', 'score')}, rejected_for from s",
        "reject_counts": f"with {SCORED} select session_id, coalesce(rejected_for, 'passes') as outcome, count(*) as n from s group by 1, 2",
        "selection_sizes": f"""with t as (select count(*) as total from events group by user_id union select count(*) from lineitem group by l_orderkey union select count(*) from documents group by source
  union select count(*) from lineitem group by l_returnflag, l_linenumber) select total, {_K.format(n='total')} as wanted from t""",
        "rank_photos": f"with {SCORED} select session_id, photo_id, rank from r",
        "top_n_per_session": f"with {SCORED} select session_id, photo_id, rank, round(score, 6) as score from r where rejected_for is null and rank <= 50",
        "embedding_shortlist": f"with {SCORED}, z as (select *, row_number() over (partition by session_id order by rank)::int as place, count(*) over (partition by session_id) as n from r where rejected_for is null) select session_id, photo_id, place from z where place <= greatest(2 * {_K.format(n='n')}, least(n, 16))",
        "hash_popcount_degenerate": f"with {PHOTOS} select photo_id, {_ONES}::bigint as ones, {_ONES} < 25.6 or {_ONES} > 230.4 as degenerate from p",
        "pair_distances": f"with {pairs} select session_id, a, b, bits, round(color, 6) as color from n where bits <= 48",
        "embedding_pairs": f"with {pairs} select session_id, a, b, round(cosine, 6) as cosine from n where round(cosine, 6) >= 0.3",
        "near_duplicate_pairs": f"with {pairs} select session_id, a, b from n where near",
        "pair_similarity": f"with {pairs} select session_id, a as photo_id, round(max(sim), 9) as nearest, count(*) as later from n group by 1, 2",
        "content_scores": f"with {PHOTOS} select photo_id, round({_CONTENT}, 6) as content, null::double as other_length from p",
        "content_baseline": f"with {SCORED}, {_BASE} select session_id, {r6('median', 'standout')} from bl",
        "exif_epoch_ms": "select event_id, case when event_id % 11 <> 0 then epoch_us(date_trunc('second', ts)) // 1000 + case event_id % 5 when 0 then 25200000 when 1 then -19800000 else 0 end end as ms from events",
        "file_name_repair": "select p_partkey, case when p_partkey % 2 = 0 then p_name || '.JPeG' when regexp_matches(p_name, '(?i)\\.[a-z0-9]{3,4}$') then p_name else p_name || case when p_partkey % 3 = 0 then '.png' else '.jpg' end end as file_name from part",
        "duplicate_groups": f"with recursive {pairs}, {_LEADERS} select session_id, leader_id, photo_id, rank_in_group from grp",
        "group_alternates": f"with recursive {pairs}, {_LEADERS} select session_id, leader_id, count(*) - 1 as alternates from grp group by 1, 2 having count(*) > 1",
        "diverse_top_k": f"with recursive {pairs}, pool as materialized (select session_id, photo_id, rank, score as value from r where rejected_for is null), {_greedy('pool', 'least(25, count(*))')} select session_id, unnest(chosen) as photo_id, generate_subscripts(chosen, 1) - 1 as pick from full_",
        "best_photos": f"""with recursive {pairs}, {_LEADERS},
reps as (select r.* from r join grp on grp.session_id = r.session_id and grp.photo_id = r.photo_id and rank_in_group = 0), k as (select session_id, count(*) as n from reps group by 1),
good as (select reps.*, {_CONTENT} as content, k.n from reps join k using (session_id) where rejected_for is null),
cb as (select session_id, median(content) as median from good where content is not null group by 1 having count(*) >= 4),
pool as materialized (select good.session_id, photo_id, rank, n, score + coalesce(case when content is not null then 0.12::double * greatest(-1::double, least(1::double, (content - median) / 0.82::double)) end, 0) as value from good left join cb using (session_id)),
{_greedy('pool', _K.format(n='any_value(q.n)'))} select session_id, unnest(chosen) as photo_id, generate_subscripts(chosen, 1) - 1 as pick from full_""",
        "steering_state": f"with {TAPS} select * from st",
        "mean_embedding": f"with {PHOTOS}, e as (select session_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from p where embedding is not null), m as (select session_id, i, avg(x) as m from e group by 1, 2) select session_id, i, round(m / sqrt(sum(m * m) over (partition by session_id)), 5) as x from m",
        "taste_direction": f"with {PHOTOS}, {_ACTED} select session_id, round(confidence, 6) as confidence, i, round(x, 5) as x from td",
        "taste_biases": f"with {PHOTOS}, {_ACTED} select p.session_id, photo_id, round(coalesce(case when embedding is not null then 0.12::double * confidence * greatest(-1::double, least(1::double, list_dot_product(embedding, vector) / 0.45::double)) end, 0), 5) as bias from p left join tv on tv.session_id = p.session_id",
        "nearest_affinity": f"with {SCORED} select a.session_id, a.photo_id, round(coalesce(max(case when b.embedding is not null then greatest(0::double, least(1::double, ({_DOT} - 0.19::double) / 0.81::double)) end), 0), 6) as nearest from r a left join r b on a.session_id = b.session_id and b.rejected_for is not null and b.embedding is not null and a.embedding is not null group by 1, 2",
        "budgeted_originals": f"""with recursive {SCORED}, f as (select session_id, 0 as step, 20000000::bigint as left_, null::bigint as photo_id from (select distinct session_id from r)
  union all select f.session_id, step + 1, case when r.size <= left_ then left_ - r.size else left_ end, case when r.size <= left_ then r.photo_id end from f join r on r.session_id = f.session_id and r.rank = f.step + 1)
select session_id, photo_id from f where photo_id is not null""",
        "upload_chunks": f"with {PHOTOS} select session_id, photo_id, (upload_idx // 5)::bigint as chunk, upload_idx // 5 = max(upload_idx // 5) over (partition by session_id) as is_last from p",
        "session_summary": f"""with recursive {pairs}, {_LEADERS}, b as (select session_id, count(*) as total, count(rejected_for) as rejected, bool_or(embedding is not null) as steerable from r group by 1),
u as (select session_id, leader_id, count(*) - 1 as more from grp group by 1, 2), v as (select session_id, count(*) filter (more > 0) as burst_groups, sum(more)::bigint as collapsed from u group by 1)
select * from b left join v using (session_id)""",
        "preference_upsert": f"""with {PHOTOS}, e as (select photo_id % 16 as session_id, count(*) filter (photo_id % 5 < 3) as l, count(*) filter (photo_id % 5 >= 3) as r from p where embedding is not null group by 1)
select session_id, case when session_id = 3 then 5000 else 1000 + session_id * 7 % 16 end as updated_at, case when session_id = 3 then least(l, 20) else l end::int as n_liked, case when session_id = 3 then least(r, 20) else r end::int as n_rejected from e order by 2 desc limit 10""",
        "remembered_counts": f"with {PHOTOS} select count(*) filter (photo_id % 5 < 3) as liked, count(*) filter (photo_id % 5 >= 3) as rejected, count(distinct photo_id % 16) as batches from p where embedding is not null",
        "px_luma_stats": f"with {_PX} select photo_id, round(avg(luma), 6) as brightness, round(stddev_pop(luma), 6) as contrast, round(avg((level <= 2)::int), 6) as clipped_shadows, round(avg((level >= 253)::int), 6) as clipped_highlights, (quantile_disc(level, 0.95) - quantile_disc(level, 0.05))::double as dynamic_range from v group by 1",
        "px_focus_noise": f"""with {_PX}, hs as (select photo_id, x // 2 as x, y // 2 as y, avg(luma)::float::double as luma from l group by all),
m as (select a.photo_id, a.v as sharpness, b.v as center_sharpness, h.v as half, s.c from {_laplace('l')} a join {_laplace('l', 'where x >= 12 and x < 36 and y >= 10 and y < 30')} b using (photo_id) join {_laplace('hs')} h using (photo_id) join (select photo_id, stddev_pop(luma) as c from l group by 1) s using (photo_id)),
o as (select *, greatest(1::double, c * c) as sq from m)
select photo_id, round(sharpness, 4) as sharpness, round(center_sharpness, 4) as center_sharpness, round(greatest(sharpness, center_sharpness) / sq, 4) as focus, round(greatest(sharpness, center_sharpness) / sq / greatest(half / sq, 1e-6::double), 4) as noise_ratio from o""",
        "px_colorfulness": f"with {_PX}, o as (select photo_id, r - g as rg, 0.5::double * (r + g) - b as yb from c) select photo_id, round(sqrt(var_pop(rg) + var_pop(yb)) + 0.3::double * sqrt(avg(rg) * avg(rg) + avg(yb) * avg(yb)), 6) as colorfulness from o group by 1",
        "px_dhash": f"""with {_PX}, cell as (select photo_id, cx.c as cx, cy.c as cy, avg(luma) as v from l join {_CELLS(17, 48)} cx on cx.at = l.x join {_CELLS(16, 40)} cy on cy.at = l.y group by all),
bit as (select photo_id, cy * 16 + cx as i, v > lead(v) over (partition by photo_id, cy order by cx) as b, cx from cell),
dig as (select photo_id, i // 4 as d, sum(case when b then 1 << (3 - i % 4)::int else 0 end)::int as n from bit where cx < 16 group by all)
select photo_id, string_agg('0123456789abcdef'[n + 1], '' order by d) as hash from dig group by 1""",
        "px_chroma": f"""with {_PX}, cell as (select photo_id, cy.c as cy, cx.c as cx, sum(r) as r, sum(g) as g, sum(r + g + b) as t, count(*) as n from c join {_CELLS(4, 48)} cx on cx.at = c.x join {_CELLS(4, 40)} cy on cy.at = c.y group by all)
select photo_id, ((cy * 4 + cx) * 2 + k)::int as i, case when t < 12 * n then 85 else floor(255::double * case k when 0 then r else g end / t + 0.5::double) end::int as v from cell, range(2) z(k)""",
    }
