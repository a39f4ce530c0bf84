"""DuckDB SQL of the intake queries' results."""

from __future__ import annotations

from .sql import _ACTED, _CONTENT, _K, _LEADERS, _PX, PHOTOS, SCORED, TAPS, _greedy, _laplace, _pairs

#: Without the photos that could not be measured.
_MEASURED = lambda sql: sql.replace("join events v on v.event_id = e.vec_id))", "join events v on v.event_id = e.vec_id and e.vec_id % 9 <> 0))")

_OTHER = "o as (select (vec_id // 250)::bigint as session_id, (vec_id % 250)::int as upload_idx, vec_id as photo_id from embeddings e join documents d on d.doc_id = e.vec_id join events v on v.event_id = e.vec_id where vec_id % 9 = 0)"

_BEST = f"""reps as (select r.* from r join grp on grp.session_id = r.session_id and grp.photo_id = r.photo_id and rank_in_group = 0), k as (select session_id, count(*) as n from reps group by 1),
good as (select reps.*, {_CONTENT} as content, k.n from reps join k using (session_id) where rejected_for is null),
cb as (select session_id, median(content) as median from good where content is not null group by 1 having count(*) >= 4),
pool as materialized (select good.session_id, photo_id, rank, n, score + coalesce(case when content is not null then 0.12::double * greatest(-1::double, least(1::double, (content - median) / 0.82::double)) end, 0) as value from good left join cb using (session_id)),
{_greedy('pool', _K.format(n='any_value(q.n)'))}, best as (select session_id, unnest(chosen) as photo_id, generate_subscripts(chosen, 1) - 1 as pick from full_)"""

_POOL = """lead_ok as (select r.session_id, r.photo_id from r join grp using (session_id, photo_id) where rank_in_group = 0 and r.rejected_for is null),
cand as materialized (select r.* from r where (session_id, photo_id) in (select (session_id, photo_id) from lead_ok) or session_id not in (select session_id from lead_ok))"""

#: Ranks come first; then only the shortlist of a session has its vectors, where these are two or more.
_TWO_PASS = SCORED.replace("r as (select *, row_number", "r0 as (select *, row_number") + f""",
z as (select session_id, photo_id, row_number() over (partition by session_id order by rank) as place, count(*) over (partition by session_id) as n, embedding from r0 where rejected_for is null),
zz as (select session_id, photo_id, count(embedding) over (partition by session_id) as vectors from z where place <= greatest(2 * {_K.format(n='n')}, least(n, 16))),
r as (select r0.* replace (case when zz.vectors > 1 then r0.embedding end as embedding) from r0 left join zz using (session_id, photo_id))"""

_PREF = """pf as (select photo_id % 16 as owner, 1000 + photo_id % 16 * 7 % 16 as updated_at, case when photo_id % 5 < 3 then 'like' else 'reject' end as action, photo_id, embedding,
  row_number() over (partition by photo_id % 16, photo_id % 5 < 3 order by photo_id) - 1 as i from p where embedding is not null)"""


#: The newest ten batches, twenty vectors a side.
_STORED = f"""{_PREF},
nb as (select owner from pf group by owner order by max(updated_at) desc, owner limit 10),
sp as materialized (select pf.*, row_number() over (partition by action order by updated_at desc, owner, i) as place from pf join nb using (owner) where i < 20)"""


def _steered(memory: bool = False) -> str:
    labels = _ACTED[len(TAPS) :]
    rest = labels[labels.index("lab as") :]
    if memory:
        rest = rest.replace("lab as (select * from ap where embedding is not null)", "lab as (select session_id, photo_id, action, embedding from ap where embedding is not null union all select s.session_id, null, sp.action, sp.embedding from (select distinct session_id from cand) s join sp on sp.owner <> s.session_id)")
    affinity = lambda vector: f"greatest(0::double, least(1::double, (list_dot_product(c.embedding, {vector}) - 0.19::double) / 0.81::double))"
    greedy = _greedy("spool", "any_value(q.k)").replace("select session_id, 0 as step, []::bigint[] as chosen from (select distinct session_id from spool)", "select session_id, count(*) filter (seed) as step, coalesce(list(photo_id order by rank) filter (seed), []::bigint[]) as chosen from spool group by 1")
    greedy = greedy.replace("'v': q.value - 0.15::double *", "'v': q.value - 0.15::double * q.discount *")
    remembers = lambda a: f"select c.session_id, c.photo_id, max({affinity('sp.embedding')}) as r from pl c join sp on sp.owner <> c.session_id and sp.action = '{a}' where c.embedding is not null group by 1, 2" if memory else "select 0 as session_id, 0 as photo_id, 0::double as r where false"
    return f"""with recursive {_pairs()}, {_LEADERS}, {_POOL}, {_STORED}, {TAPS},
ap as (select c.session_id, c.photo_id, st.action, c.embedding from st join cand c on c.session_id = st.session_id and c.upload_idx = st.photo_id),
{rest},
ca as (select cand.*, ap.action from cand left join ap using (session_id, photo_id)),
pl as (select *, {_CONTENT} as content from ca where action is null or action = 'like'),
bm as (select session_id, median(content) as median from pl where content is not null group by 1 having count(*) >= 4),
own as (select * from ap where embedding is not null and action = 'like'),
lk as (select session_id, i, avg(x) as m from (select session_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from own) group by 1, 2),
lm as (select session_id, list(u order by i) as liked from (select session_id, i, m / sqrt(sum(m * m) over (partition by session_id)) as u from lk) group by 1),
un as (select c.session_id, c.photo_id, max({affinity('l.embedding')}) as unwanted from pl c join ap l on l.session_id = c.session_id and l.action = 'reject' and l.embedding is not null where c.embedding is not null group by 1, 2),
ry as ({remembers('like')}), rn as ({remembers('reject')}),
ks as (select session_id, greatest({_K.format(n='count(*)')}, count(*) filter (action = 'like')) as k from pl group by 1),
spool as materialized (select c.session_id, c.photo_id, c.rank, ks.k, coalesce(c.action = 'like', false) as seed,
  1::double - greatest(0.5::double * coalesce(case when c.embedding is not null then {affinity('lm.liked')} end, 0), 0.3::double * coalesce(ry.r, 0)) as discount,
  c.score - 0.5::double * coalesce(un.unwanted, 0) - 0.2::double * coalesce(rn.r, 0) + coalesce(case when c.embedding is not null then 0.12::double * confidence * greatest(-1::double, least(1::double, list_dot_product(c.embedding, tv.vector) / 0.45::double)) end, 0)
    + coalesce(case when c.content is not null and median is not null then 0.12::double * (1::double - least(1::double, greatest(0.5::double * coalesce(confidence, 0), coalesce(ry.r, 0), coalesce(rn.r, 0)))) * greatest(-1::double, least(1::double, (c.content - median) / 0.82::double)) end, 0) as value
  from pl c join ks on ks.session_id = c.session_id left join un on un.session_id = c.session_id and un.photo_id = c.photo_id left join tv on tv.session_id = c.session_id
  left join ry on ry.session_id = c.session_id and ry.photo_id = c.photo_id left join rn on rn.session_id = c.session_id and rn.photo_id = c.photo_id
  left join bm on bm.session_id = c.session_id left join lm on lm.session_id = c.session_id),
{greedy}, picked as materialized (select session_id, unnest(chosen) as photo_id, generate_subscripts(chosen, 1) - 1 as pick from full_)"""


def _explained() -> str:
    """The picks of a steered selection with memory, with novelty and reason; taste and baseline count over dropped photos, too."""
    affinity = "greatest(0::double, least(1::double, (list_dot_product(c.embedding, sp.embedding) - 0.19::double) / 0.81::double))"
    content = _CONTENT.replace("embedding", "c.embedding")
    return f"""{_steered(True)},
nv as (select a.session_id, a.photo_id, coalesce(least(1::double, min(1::double - s.sim)), 1::double) as novelty from picked a
  left join (picked b join sims s on s.session_id = b.session_id and s.y = b.photo_id) on b.session_id = a.session_id and b.pick < a.pick and s.x = a.photo_id group by 1, 2),
al as (select session_id, leader_id as photo_id, count(*) - 1 as alternates from grp group by 1, 2),
bc as (select session_id, {_CONTENT} as c, row_number() over (partition by session_id order by {_CONTENT}) as i, count(*) over (partition by session_id) as n from cand where embedding is not null),
bl as (select session_id, max(c) filter (i = least(n - 1, floor(n * 0.75::double)) + 1) as standout from bc where n >= 4 group by 1),
yes as (select c.session_id, c.photo_id, max({affinity}) as r from cand c join sp on sp.owner <> c.session_id and sp.action = 'like' where c.embedding is not null group by 1, 2),
ex as (select k.session_id, k.photo_id, k.pick, nv.novelty, coalesce(al.alternates, 0) as alternates,
  case when c.action = 'like' then 'kept' when coalesce(al.alternates, 0) > 0 then 'best-of-similar'
    when (tv.vector is not null and c.embedding is not null and 0.12::double * confidence * greatest(-1::double, least(1::double, list_dot_product(c.embedding, tv.vector) / 0.45::double)) >= 0.12::double * confidence * 0.5::double)
      or coalesce(yes.r, 0) >= 0.55::double then 'like-your-picks'
    when coalesce({content} >= standout, false) then 'well-composed'
    when k.pick = 0 or nv.novelty < 0.45::double then 'top-quality' else 'different-subject' end as reason
  from picked k join nv using (session_id, photo_id) join ca c on c.session_id = k.session_id and c.photo_id = k.photo_id left join al on al.session_id = k.session_id and al.photo_id = k.photo_id
  left join tv on tv.session_id = k.session_id left join bl on bl.session_id = k.session_id left join yes on yes.session_id = k.session_id and yes.photo_id = k.photo_id)"""


def _affinity(action: str) -> str:
    return f"round(coalesce(max(case when pf.action = '{action}' and p.embedding is not null then greatest(0::double, least(1::double, (list_dot_product(p.embedding, pf.embedding) - 0.19::double) / 0.81::double)) end), 0), 6)"


def oracle_sql() -> dict[str, str]:
    pairs, measured = _pairs(), _MEASURED(_pairs())
    outcome = "case when {s} = '' then 'session id required' when not regexp_full_match({s}, '[A-Za-z0-9_-]{{1,64}}') then 'bad session id' when event_id % 2 <> 0 and event_id % 3 = 0 then 'files required' when event_id % 5 = 0 then 'unknown session' else 'ok' end"
    session = "(case event_id % 7 when 0 then '' when 1 then 'no good/' else 's' || (event_id % 7) end)"
    blank = "case when p_partkey % 4 = 0 then '' when p_partkey % 4 <> 1 then {} end"
    fitted = lambda x: f"case when greatest(w, h) <= 512 then {x} else greatest(1, floor({x} * (512::double / greatest(w, h)) + 0.5::double)) end::int"
    sessions = "s as (select photo_id % 16 as session_id, max(photo_id) as created_at, count(*) as n from p group by 1)"
    return {
        "steered_selection": f"{_steered()} select * from picked",
        "steered_with_memory": f"{_steered(True)} select * from picked",
        "pick_novelty": f"{_explained()} select session_id, photo_id, pick, round(novelty, 6) as novelty from ex",
        "pick_reasons": f"{_explained()} select session_id, photo_id, pick, reason, case reason when 'best-of-similar' then 'best of ' || (alternates + 1) when 'kept' then 'you kept this' else replace(reason, '-', ' ') end as label from ex",
        "analysis_split": f"with {PHOTOS} select session_id, photo_id, upload_idx, case when photo_id % 9 <> 0 then 'analysed' else 'unanalysed' end as part, case when photo_id % 9 <> 0 then floor(brightness + 0.5::double)::bigint end as brightness from p",
        "embedding_overlay": f"with {PHOTOS}, x as (select session_id, photo_id, case when photo_id % 4 <> 0 then embedding end as v from p) select session_id, photo_id, coalesce(len(v), 0)::int as dims, case when v is null then case when photo_id % 4 <> 0 then 'decode failed' else 'Not embedded' end end as embed_error from x",
        "shown_sources": f"with {PHOTOS} select session_id, photo_id, case when photo_id % 6 = 0 then 'original ' else 'preview ' end || photo_id as source, photo_id % 6 = 0 as saveable from p where photo_id % 6 = 0 or photo_id % 4 = 0",
        "merged_originals": f"with {PHOTOS} select session_id, photo_id, case when photo_id % 6 = 0 then 2 * size else size end as size from p where photo_id % 6 = 0 or photo_id % 4 = 0",
        "zipped_originals": f"with {PHOTOS} select session_id, session_id || ':' || photo_id as key, size from p",
        "ranked_without_collapsed": f"with recursive {pairs}, {_LEADERS} select session_id, photo_id, rank from grp where rank_in_group = 0",
        "kept_photos": f"with recursive {measured}, {_LEADERS}, {_OTHER}, {_BEST} select session_id, photo_id from grp where rank_in_group = 0 union select session_id, photo_id from best union select session_id, photo_id from o",
        "selection_top_up": f"""with recursive {measured}, {_LEADERS}, {_OTHER}, {_BEST}, hv as (select session_id, count(*) as have from best group by 1),
t as (select session_id, count(*) as total from (select session_id from r union all select session_id from o) group by 1),
u as (select *, row_number() over (partition by session_id order by upload_idx) as i from o)
select u.session_id, photo_id, upload_idx from u join t using (session_id) left join hv using (session_id) where i <= {_K.format(n='total')} - coalesce(have, 0)""",
        "kept_rows": f"""with recursive {measured}, {_LEADERS}, {_OTHER}, {_BEST}, kp as (select session_id, photo_id from grp where rank_in_group = 0 union select session_id, photo_id from best)
select session_id, photo_id, upload_idx, size, true as measured from r semi join kp using (session_id, photo_id) union all select o.session_id, o.photo_id, o.upload_idx, d.n_chars * 1000, false from o join documents d on d.doc_id = o.photo_id""",
        "kept_scores": f"with recursive {measured}, {_LEADERS}, {_BEST}, kp as (select session_id, photo_id from grp where rank_in_group = 0 union select session_id, photo_id from best) select session_id, photo_id, rank, round(score, 6) as score, embedding is not null as has_vector from r semi join kp using (session_id, photo_id)",
        "selected_scores": f"with recursive {measured}, {_LEADERS}, {_BEST} select session_id, photo_id, rank, round(score, 6) as score from r semi join best using (session_id, photo_id)",
        "embedding_files": f"with {SCORED}, z as (select *, row_number() over (partition by session_id order by rank)::int as place, count(*) over (partition by session_id) as n from r where rejected_for is null) select session_id, photo_id, place, 'file-' || photo_id as file from z where place <= greatest(2 * {_K.format(n='n')}, least(n, 16)) and taken_at_ms is not null",
        "preference_store": f"""with {PHOTOS}, e as (select photo_id % 16 as owner, count(*) filter (photo_id % 5 < 3) as l, count(*) filter (photo_id % 5 >= 3) as r from p where embedding is not null group by 1),
f as (select owner, 1000 + owner * 7 % 16 as upd, least(l, 20) as l, least(r, 20) as r from e), one as (select * from f order by upd desc, owner limit 10),
two as (select * from (select * from one where owner <> 3 union all select owner, 5000 as upd, l, r from f where owner = 3) order by upd desc, owner limit 10), four as (select * from f where owner = 3)
select 1::int as step, coalesce(sum(l), 0)::bigint as liked, coalesce(sum(r), 0)::bigint as rejected, count(*) as batches from one union all select 2, coalesce(sum(l), 0)::bigint, coalesce(sum(r), 0)::bigint, count(*) from two
union all select 3, 0, 0, 0 union all select 4, coalesce(sum(l), 0)::bigint, coalesce(sum(r), 0)::bigint, count(*) from four""",
        "photo_lookups": f"""with {PHOTOS}, a as (select case when photo_id % 10 <> 3 then session_id + case when photo_id % 10 = 4 then 1000 else 0 end end as session_id, photo_id, taken_at_ms, size from p)
select session_id, photo_id::varchar as id, case when ok then 'n' || photo_id end as name, case when ok then 'image/jpeg' end as type, case when ok then size end as size,
  case when session_id is null then 'missing session id' when ok then 'ok' else 'not found' end as status from (select *, taken_at_ms is not null and photo_id % 10 not in (3, 4) as ok from a)""",
        "session_lookups": f"""with {PHOTOS}, s as (select session_id, count(*) as total from p group by 1), a as (select distinct case when user_id % 50 > 0 then user_id % 50 - 1 end as session_id from events)
select a.session_id, total % 2 = 0 as finalized, total, case when a.session_id is null then 'missing session id' when total is not null then 'ok' else 'unknown session' end as status from a left join s using (session_id)""",
        "review_pool": f"with recursive {pairs}, {_LEADERS}, {_POOL} select session_id, photo_id from cand",
        "review_pool_of_failures": f"with recursive {pairs}, {_LEADERS}, {_POOL} select session_id, photo_id from cand where session_id % 2 = 1 union all select session_id, photo_id from r where session_id % 2 = 0",
        "review_summary": f"""with recursive {measured}, {_LEADERS}, {_OTHER}, b as (select session_id, count(*) as analysed, count(rejected_for) as rejected, bool_or(embedding is not null) as steerable, bool_or(session_id % 2 = 0 and photo_id % 6 = 0) as can_save from r group by 1),
u as (select session_id, leader_id, count(*) - 1 as more from grp group by 1, 2), v as (select session_id, count(*) filter (more > 0) as burst_groups, sum(more)::bigint as collapsed from u group by 1), w as (select session_id, count(*) as unanalysed from o group by 1)
select session_id, analysed + coalesce(unanalysed, 0) as total, rejected, steerable, burst_groups, collapsed, coalesce(unanalysed, 0) as unanalysed, can_save from b left join v using (session_id) left join w using (session_id)""",
        "two_pass_selection": f"with recursive {_pairs().replace(SCORED, _TWO_PASS)}, {_LEADERS}, {_BEST} select * from best",
        "remembered_exemplars": f"with {PHOTOS}, {_PREF} select 3::bigint as session_id, row_number() over (partition by action order by updated_at desc, owner, i) as place, action, round(embedding[1], 5) as x from pf where owner <> 3",
        "remembered_steering": f"with {PHOTOS}, {_STORED} select p.session_id, p.photo_id, {_affinity('like')} as remembers_yes, {_affinity('reject')} as remembers_no from p left join sp pf on pf.owner <> p.session_id group by 1, 2",
        "exemplar_order": f"with {PHOTOS}, {_PREF} select owner as session_id, -updated_at as age, i::int as i, round(embedding[1], 5) as x from pf where action = 'like'",
        "unit_vectors": f"with {PHOTOS}, e as (select photo_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from p where embedding is not null) select photo_id, i, case when photo_id % 5 = 0 then 0::double else round(x / sqrt(sum(x * x) over (partition by photo_id)), 5) end as x from e",
        "decoded_head": f"with {PHOTOS} select photo_id, round({_CONTENT}, 6) as score from p where embedding is not null",
        "safe_ids": "select p_partkey, regexp_full_match(case p_partkey % 3 when 0 then p_name when 1 then 'p_' || p_partkey else '' end, '[A-Za-z0-9_-]{1,64}') as safe from part",
        "upload_statuses": f"select event_id, {outcome.format(s=session)} as status from events",
        "file_defaults": f"select p_partkey, coalesce(nullif({blank.format('p_name')}, ''), 'photo-' || (p_partkey + 1) || '.jpg') as name, coalesce(nullif({blank.format('p_type')}, ''), 'image/jpeg') as type from part",
        "fitted_sizes": f"with {PHOTOS}, x as (select photo_id, photo_id * 37 % 4000 + 1 as w, photo_id * 91 % 3000 + 1 as h from p) select photo_id, {fitted('w')} as width, {fitted('h')} as height from x",
        "progress_percent": f"with {PHOTOS} select photo_id, case when photo_id % 250 > 0 then floor(photo_id * 7 % 200 * 100::double / (photo_id % 250) + 0.5::double) else 0 end::bigint as percent from p",
        "session_upsert": f"with {PHOTOS}, {sessions} select session_id, case when session_id = 3 then 7 else created_at end as created_at, session_id = 5 as finalized, case when session_id = 4 then 2 else 0 end::int as liked, case when session_id = 4 then 1 else 0 end::int as rejected, case when session_id = 4 then 9 else n end as first_selected from s where session_id <> 6",
        "session_keep_newest": f"with {PHOTOS}, {sessions} select session_id, created_at from s order by created_at desc, session_id limit 1",
        "session_append": f"""with {PHOTOS}, x as (select session_id, row_number() over (partition by session_id order by upload_idx) - 1 as position, case when photo_id % 3 > 0 then 'n' || photo_id else '' end as n, size from p),
y as (select *, 'p' || case when position < 10000 then lpad(position::varchar, 4, '0') else position::varchar end || '_' || substr(sha256(session_id || '/' || position || '/' || n), 1, 6) as id from x)
select session_id, position::int as position, id, case when n = '' then id || '.jpg' else n end as name, 'image/jpeg' as type, size from y""",
        "stored_originals": f"""with recursive {SCORED}, f as (select session_id, 0 as step, 5000000::bigint as left_, null::bigint as photo_id, null::bigint as size from (select distinct session_id from r)
  union all select f.session_id, step + 1, case when r.size <= left_ then left_ - r.size else left_ end, case when r.size <= left_ then r.photo_id end, r.size from f join r on r.session_id = f.session_id and r.rank = f.step + 1)
select session_id, photo_id::varchar as photo_id, size from f where photo_id is not null""",
        "px_metrics": f"""with {_PX}, hs as (select photo_id, x // 2 as x, y // 2 as y, avg(luma)::float::double as luma from l group by all),
m as (select a.photo_id, a.v as sharpness, b.v as center, h.v as half from {_laplace('l')} a join {_laplace('l', 'where x >= 12 and x < 36 and y >= 10 and y < 30')} b using (photo_id) join {_laplace('hs')} h using (photo_id)),
s0 as (select photo_id, avg(luma) as brightness, stddev_pop(luma) as contrast, avg((level <= 2)::int) as lo, avg((level >= 253)::int) as hi, (quantile_disc(level, 0.95) - quantile_disc(level, 0.05))::double as dynamic_range,
  sqrt(var_pop(r - g) + var_pop(0.5::double * (r + g) - b)) + 0.3::double * sqrt(avg(r - g) * avg(r - g) + avg(0.5::double * (r + g) - b) * avg(0.5::double * (r + g) - b)) as colorfulness from v group by 1),
p as (select s0.*, sharpness, greatest(sharpness, center) / greatest(1::double, contrast * contrast) as focus, greatest(sharpness, center) / greatest(1::double, contrast * contrast) / greatest(half / greatest(1::double, contrast * contrast), 1e-6::double) as noise_ratio from s0 join m using (photo_id)),
{SCORED[SCORED.index("q as (select *") : SCORED.index("r as (select *, row_number")].rstrip().rstrip(",")}
select photo_id, round(score, 5) as score, rejected_for, 32 as cells, null::varchar as error from s""",
        "model_inputs": f"""with {_PX}, w as (select floor(i * 40 / 256)::int as at, count(*) as k from range(256) t(i) group by 1)
select photo_id, {", ".join(f"round(sum({c} * a.k * b.k) / 65536, 9) as {c}" for c in "rgb")} from c join w a on a.at = c.x - 4 join w b on b.at = c.y group by 1""",
    }
