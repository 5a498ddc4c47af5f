"""SQL of the engine's queries, for DuckDB: one chain of common table expressions, written independently of the plans."""

from __future__ import annotations

import re

from vettle import lexicon as L
from vettle.operators import score as S
from vettle.queries import fixtures as X
from vettle.queries.screening import SETTINGS, STOP


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: str) -> str:
    """A pattern, case-insensitive, with Unicode word characters."""
    return q("(?i)" + p)


def uni(p: str) -> str:
    return p.replace(r"[\w.+-]", r"[\pL\pN_.+-]").replace(r"[\w-]", r"[\pL\pN_-]").replace(r"(\w)", r"([\pL\pN_])")


WS = r"[\s\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def alnum(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def email(c: str) -> str:
    return f"nullif(regexp_replace(regexp_extract({c}, {q(uni(L.EMAIL))}), '[.]+$', ''), '')"


def clean(c: str) -> str:
    return f"regexp_replace({c}, {rx(L.NOISE)}, ' ', 'g')"


BUL = r"^\s*[•\-*]\s*"
CTES: dict[str, str] = {}
CTES["resumes"] = X.RESUMES
CTES["aliases(alias, name)"] = "values " + ", ".join(f"({q(a)}, {q(n)})" for n, al in L.SECTIONS for a in al)
CTES["skills(ord, name, pattern, tier)"] = "values " + ", ".join(f"({i}, {q(n)}, {rx(p)}, {q(t)})" for i, (n, p, t) in enumerate(L.SKILLS))
CTES["dims(ord, name, pattern)"] = "values " + ", ".join(f"({i}, {q(n)}, {rx(p)})" for i, (n, p) in enumerate(L.DEPTH_DIMS))
CTES["cats(ord, name, pattern)"] = "values " + ", ".join(f"({i}, {q(n)}, {rx(p)})" for i, (n, p) in enumerate(L.ENG_DEPTH))
CTES["raw_lines"] = "select file_ord, i - 1 as pos, ls[i] as line from (select file_ord, ls, unnest(range(1, len(ls) + 1)) as i from (select file_ord, string_split(text, chr(10)) as ls from resumes))"
CTES["line_heads"] = f"""
  select *, trim(string_split(norm, ' & ')[1]) as first_,
    s <> '' and len(regexp_split_to_array(s, '\\s+')) <= 5 and not regexp_matches(s, {q(BUL)}) and not regexp_matches(s, '[|\\d@]') as possible,
    (upper(s) = s and lower(s) <> s) or (regexp_matches(s, '[A-Z]') and not regexp_matches(s, '(^|[^\\pL])\\p{{Ll}}') and not regexp_matches(s, '\\pL\\p{{Lu}}')) as cased
  from (select *, trim(regexp_replace(lower(s), '[^a-z& ]', '', 'g')) as norm from (select *, {strip(f"regexp_replace({strip('line')}, '^:+|:+$', '', 'g')")} as s from raw_lines))"""
CTES["headed"] = "select h.file_ord, h.pos, h.line, case when possible then coalesce(a.name, case when cased then b.name end) end as heading from line_heads h left join aliases a on h.norm = a.alias left join aliases b on h.first_ = b.alias"
CTES["lines"] = """
  select *, min(pos) over (partition by file_ord, section) as section_pos from (
    select *, coalesce(last_value(heading ignore nulls) over (partition by file_ord order by pos rows between unbounded preceding and current row), 'header') as section from headed)"""
CTES["sections"] = f"select * from (select file_ord, section, section_pos, {strip('coalesce(string_agg(line, chr(10) order by pos) filter (heading is null), chr(0))')} as body from lines group by 1, 2, 3) where body not in ('', chr(0))"
CTES["marked"] = f"""
  select *, bool_or(in_block) over (partition by file_ord) as has_block, bool_or(in_body) over (partition by file_ord) as has_body from (
    select *, {strip('line')} as s, heading is null and {strip('line')} <> '' and section in ('experience', 'projects', 'other') as in_block,
      heading is null and {strip('line')} <> '' and section not in ('education', 'certifications', 'skills') as in_body from lines)"""
CTES["bl"] = f"""
  select file_ord, case when has_block then section else 'unknown' end as section, case when has_block or has_body then section_pos else 0 end as first_, pos, s, regexp_matches(s, {q(BUL)}) as bul
  from marked where case when has_block then in_block when has_body then in_body else s <> '' end"""
CTES["bl2"] = f"""
  select *, sum(bul::int) over (partition by file_ord, section order by first_, pos) as g,
    (not bul and not coalesce(regexp_matches(s, '^\\p{{Ll}}') or not (regexp_matches(prev, '[.!?:;]\\s*$') or regexp_matches(s, {rx(L.DATE)}) or contains(s, '|') or contains(s, ' — ') or contains(s, ' – ')), true))::int as brk
  from (select *, lag(s) over (partition by file_ord, section order by first_, pos) as prev from bl)"""
CTES["bl3"] = "select *, case when bul then 'b' when g > 0 and max(brk) over (partition by file_ord, section, g order by first_, pos) = 0 then 'c' else 't' end as type from bl2"
CTES["bl4"] = """
  select *, sum(starts) over (partition by file_ord order by case when section = 'unknown' then 0 else first_ end, first_, pos) - 1 as block_idx from (
    select *, case when pt is null or (type = 't' and pt <> 't') then 1 else 0 end as starts from (select *, lag(type) over (partition by file_ord, section order by first_, pos) as pt from bl3))"""
CTES["bullets_"] = f"""
  select file_ord, block_idx, bn, string_agg(case when type = 'b' then regexp_replace(s, {q(BUL)}, '') else s end, ' ' order by first_, pos) as bullet, min(first_) as f, min(pos) as p from (
    select *, sum(bul::int) over (partition by file_ord, block_idx order by first_, pos) as bn from bl4 where type <> 't') group by 1, 2, 3"""
CTES["titles_"] = "select file_ord, block_idx, list(s order by first_, pos) as ts from bl4 where type = 't' group by 1, 2"
CTES["blocks"] = f"""
  select k.file_ord, k.block_idx::bigint as block_idx, k.section, coalesce(t.title, '') as title, coalesce(n, 0)::bigint as n_bullets,
    {strip("coalesce(t.title, '') || coalesce(chr(10) || body, '')")} as text
  from (select distinct file_ord, block_idx, section from bl4) k
  left join (select file_ord, block_idx, case when len(ts) = 1 then ts[1] else list_reduce(ts, lambda a, x: regexp_replace(a || ' | ' || x, '^[ |]+|[ |]+$', '', 'g')) end as title from titles_) t using (file_ord, block_idx)
  left join (select file_ord, block_idx, count(*) as n, string_agg(bullet, chr(10) order by bn) as body from bullets_ group by 1, 2) b using (file_ord, block_idx)"""
CTES["cleaned"] = f"select *, {clean('text')} as clean from blocks"
CTES["found_"] = "select file_ord, block_idx, ord, name, tier from cleaned, skills where regexp_matches(clean, pattern)"
CTES["found"] = f"""
  select file_ord, block_idx, ord, name, tier from found_ union all
  select file_ord, block_idx, 99, 'Agents', 'strong' from cleaned c where regexp_matches(clean, {rx(L.AGENT)}) and exists (select 1 from found_ f where f.file_ord = c.file_ord and f.block_idx = c.block_idx and f.tier in ('strong', 'llm'))"""
CTES["claims"] = f"select file_ord, {clean('''coalesce(max(body) filter (section = 'skills'), '') || chr(10) || coalesce(max(body) filter (section = 'summary'), '')''')} as claims from sections group by 1"
CTES["hits"] = """
  select file_ord, name, tier, list_sort(list(distinct block_idx) filter (block_idx is not null)) as blocks, bool_or(block_idx is null) as in_claims from (
    select file_ord, name, tier, block_idx from found union all select file_ord, name, tier, null from claims, skills where regexp_matches(claims, pattern)) group by 1, 2, 3"""
CTES["h"] = "select *, coalesce(len(blocks), 0) > 0 as built, coalesce(len(blocks), 0) = 0 and in_claims as only_ from hits"
CTES["gated"] = f"""
  select r.file_ord,
    case when bool_or(name = 'Python') then 'explicit' when bool_or(tier in ('pyfw', 'pylib')) then 'implied' else 'none' end as python_level,
    case when bool_or(tier in ('strong', 'llm') and built) then 'implemented' when bool_or(tier = 'strong' and only_) or count(*) filter (tier = 'llm' and only_) >= 2 then 'skills_only'
      when bool_or(tier = 'ml') then 'ml_only' else 'none' end as ai_level,
    coalesce(list_sort(list(name) filter (tier in ('strong', 'llm') and built)), []) as built_terms, coalesce(list_sort(list(name) filter (tier in ('strong', 'llm') and only_)), []) as claimed_terms,
    coalesce(list_sort(list(name) filter (tier = 'ml')), []) as ml_terms, coalesce(list_sort(list(name) filter (name is not null)), []) as matched,
    coalesce(bool_or(t.taught), false) as taught
  from resumes r left join h using (file_ord)
  left join (select file_ord, bool_or(regexp_matches(body, {rx(next(p for n, p, _ in L.SKILLS if n == 'Python'))})) as taught from sections where section in ('education', 'certifications') group by 1) t using (file_ord) group by 1"""
CTES["gate"] = """
  select *, case ai_level when 'implemented' then built_terms when 'skills_only' then claimed_terms when 'ml_only' then ml_terms else [] end as terms,
    list_filter([case when python_level = 'none' then case when taught then 'Python only mentioned in education/coursework' else 'No evidence of Python stack' end end,
      case when ai_level = 'ml_only' then 'Only classical ML/DL evidence; no LLM/RAG/agentic work' when ai_level = 'none' then 'No AI/agentic project evidence' end], lambda x: x is not null) as reasons from gated"""
PROTOS = {"depth": SETTINGS.depth_prototype, "thin": SETTINGS.thin_prototype, "jd": SETTINGS.job_description}
CTES["protos(name, text)"] = "values " + ", ".join(f"({q(k)}, {q(v)})" for k, v in PROTOS.items())
CTES["evidence"] = "select file_ord, string_agg(body, chr(10) order by section_pos) as text from sections where section not in ('education', 'certifications') group by 1"


def terms(source: str, keys: str) -> str:
    toks = r"regexp_extract_all(lower(text), '\b[a-zA-Z][a-zA-Z0-9+#.\-]{1,}\b')"
    stop = "[" + ", ".join(map(q, STOP)) + "]"
    return f"select {keys}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from (select {keys}, list_filter({toks}, lambda x: not list_contains({stop}, x)) as t from {source})"


CTES["corpus"] = "select row_number() over () as id, text from (select text from blocks union all select text from protos)"
CTES["df"] = f"select term, count(distinct id) as df from ({terms('corpus', 'id')}) group by 1"
CTES["nn"] = "select count(*)::double as n from corpus"


def weighed(source: str, keys: str) -> str:
    return f"select {keys}, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) as w from (select {keys}, term, count(*)::double as tf from ({terms(source, keys)}) group by {keys}, term) join df using (term), nn"


CTES["proto_w"] = f"select name, term, w / sqrt(sum(w * w) over (partition by name)) as p from ({weighed('protos', 'name')})"


def cosine(source: str, keys: str, names: tuple[str, ...]) -> str:
    sims = ", ".join(f"round(coalesce(sum(w * p_{n}), 0) / sqrt(sum(w * w)), 6) as sim_{n}" for n in names)
    ps = ", ".join(f"max(p) filter (name = '{n}') as p_{n}" for n in names)
    return f"select {keys}, {sims} from ({weighed(source, keys)}) left join (select term, {ps} from proto_w group by 1) using (term) group by {keys}"


CTES["clean_texts"] = "select file_ord, block_idx, clean as text from cleaned"
CTES["sims"] = cosine("clean_texts", "file_ord, block_idx", ("depth", "thin"))
CTES["jd"] = cosine("evidence", "file_ord", ("jd",))
CTES["block_dims"] = "select file_ord, block_idx, list(name order by ord) as dims from cleaned, dims where regexp_matches(clean, pattern) group by 1, 2"
CTES["ai_blocks"] = """
  select c.*, coalesce(d.dims, []) as dims, strong, llm,
    least(40, case when len(strong) > 0 then 6 else 3 end + 3.5 * len(coalesce(d.dims, [])) + least(2, greatest(0, len(strong) - 1))
      + 8.0 * greatest(0, least(1, (coalesce(sim_depth, 0) - 0.6 * coalesce(sim_thin, 0)) / 0.25)))::double as score
  from cleaned c join (select file_ord, block_idx, coalesce(list_sort(list(name) filter (tier = 'strong')), []) as strong, coalesce(list_sort(list(name) filter (tier = 'llm')), []) as llm from found group by 1, 2) f using (file_ord, block_idx)
  left join block_dims d using (file_ord, block_idx) left join sims using (file_ord, block_idx) where len(strong) + len(llm) > 0"""
CTES["signals"] = "select pattern from dims union all select pattern from skills where tier in ('strong', 'llm')"
CTES["block_lines"] = "select file_ord, block_idx, i, ls[i] as line from (select file_ord, block_idx, ls, unnest(range(1, len(ls) + 1)) as i from (select file_ord, block_idx, string_split(clean, chr(10)) as ls from cleaned))"


def trimmed(c: str, n: int = 220) -> str:
    one = strip(f"regexp_replace({c}, '\\s+', ' ', 'g')")
    return f"case when length({one}) <= {n} then {one} else regexp_replace(left({one}, {n - 1}), '\\s+$', '') || '…' end"


CTES["bests"] = f"""
  select b.file_ord, b.block_idx, coalesce(x.best, [ {trimmed('b.first_line')} ]) as best from (select file_ord, block_idx, line as first_line from block_lines where i = 1) b
  left join (select file_ord, block_idx, list({trimmed('line')} order by k desc, i) as best from (
    select *, row_number() over (partition by file_ord, block_idx order by k desc, i) as rn from (
      select file_ord, block_idx, i, line, (select count(*) from signals where regexp_matches(line, pattern)) as k from block_lines where i > 1)) where rn <= 2 and k > 0 group by 1, 2) x using (file_ord, block_idx)"""
CTES["topped"] = "select *, row_number() over (partition by file_ord order by score desc, block_idx) as rn from ai_blocks"
CTES["depths"] = "select file_ord, coalesce(max(score) filter (rn = 1), 0) + 0.2 * coalesce(max(score) filter (rn = 2), 0) + 0.1 * coalesce(max(score) filter (rn = 3), 0) as depth from topped group by 1"
CTES["whole"] = "select file_ord, string_agg(clean, chr(10) order by block_idx) as t from cleaned group by 1"


def pts(name: str, built: float, claimed: float) -> str:
    return f"coalesce(max(case when built then {built} when in_claims then {claimed} else 0 end) filter (name = {q(name)}), 0)"


def has(name: str) -> str:
    return f"coalesce(bool_or(name = {q(name)}), false)"


def made(name: str) -> str:
    return f"coalesce(bool_or(name = {q(name)} and built), false)"


CTES["points"] = f"""
  select r.file_ord, {pts('FastAPI', 5, 2)} as fastapi, greatest({pts('Flask', 3, 1)}, {pts('Django', 3, 1)}) as web,
    case when {has('PostgreSQL')} then {pts('PostgreSQL', 3, 1)} else {pts('MySQL/SQLite/SQL', 1.5, 0.5)} end as db, {pts('Redis', 3, 1)} as redis,
    case when {has('GCP')} then {pts('GCP', 4, 1.5)} else greatest({pts('AWS', 2.5, 1)}, {pts('Azure', 2.5, 1)}) end as cloud, {pts('Docker', 4, 1.5)} + {pts('Kubernetes', 1.5, 0.5)} + {pts('CI/CD', 1, 0.5)} as ops,
    {made('React')} or {made('Next.js')} as front, {made('FastAPI')} as m_fastapi, {made('PostgreSQL')} as m_pg, {made('Redis')} as m_redis, {made('Docker')} as m_docker, {has('Docker')} as h_docker,
    {has('GCP')} or {has('AWS')} or {has('Azure')} as h_cloud
  from resumes r left join h using (file_ord) group by 1"""
CTES["py_blocks"] = f"select file_ord, count(distinct b) as n from (select file_ord, unnest(blocks) as b from h where tier in ('python', 'pyfw', 'pylib') or name in ({', '.join(map(q, L.PY_BLOCK_SKILLS))})) group by 1"
CTES["doc_cats"] = "select file_ord, list(name order by ord) as cats from whole, cats where regexp_matches(t, pattern) group by 1"
CTES["documents_"] = f"""
  select g.*, depth, b.dims, b.strong, b.llm, b.title as b_title, b.text as b_text, b.block_idx as b_idx, coalesce(t, '') as t, coalesce(p.n, 0) as n_py, coalesce(dc.cats, []) as cats, x.* exclude (file_ord),
    round(coalesce(sim_jd, 0), 3) as jd_similarity, ai_level = 'implemented' and depth is not null as built_ai,
    len(list_filter(coalesce(b.dims, []), lambda d: d <> 'production')) as structural
  from gate g left join depths using (file_ord) left join topped b on g.file_ord = b.file_ord and b.rn = 1 left join whole w on g.file_ord = w.file_ord left join py_blocks p on g.file_ord = p.file_ord
  left join doc_cats dc on g.file_ord = dc.file_ord join points x on g.file_ord = x.file_ord left join jd on g.file_ord = jd.file_ord"""
CTES["scores"] = f"""
  select *,
    (case when built_ai then least(40, depth) when ai_level = 'skills_only' then least(6, 2 * len(terms)) when ai_level = 'ml_only' then 6 else 0 end)::double as ai,
    least(30, case when python_level <> 'none' then 3 else 0 end + 6 * least(n_py, 2) + fastapi + web + case when regexp_matches(t, {rx(L.ASYNC)}) then 3 else 0 end + db + redis
      + least(2, len(list_distinct(list_transform(regexp_extract_all(t, {rx(L.BACKEND)}), lambda x: lower(x))))))::double as python_backend,
    least(15, cloud + ops + case when regexp_matches(t, {rx(L.DEPLOY)}) then 2 else 0 end + case when front and python_level <> 'none' then 2 else 0 end)::double as cloud_fullstack,
    least(5, len(cats))::double as engineering_depth,
    list_filter([
      case when built_ai and structural = 0 then {{'reason': {q(S.THIN)}, 'points': 10.0::double}} end,
      case when built_ai and structural = 1 and len(strong) = 0 then {{'reason': {q(S.SHALLOW)}, 'points': 5.0::double}} end,
      case when built_ai and (regexp_matches(b_text, {rx(L.TUTORIAL)}) or not regexp_matches(b_text, {rx(L.OWNERSHIP)})) then {{'reason': {q(S.TUTORIAL)}, 'points': 5.0::double}} end,
      case when not built_ai and ai_level = 'skills_only' then {{'reason': {q(S.SKILLS_ONLY)}, 'points': 5.0::double}} end], lambda x: x is not null) as penalties
  from documents_"""
_D = r"\s*\(?\b(?:\d{1,2}/)?(?:19|20)\d{2}\b.*$|\s+\d{1,2}/\S*.*$|\s+[A-Z][a-z]{2,8}\.? ?(?:19|20)\d{2}.*$"
_TITLE = f"regexp_replace(string_split(regexp_replace(regexp_replace(b_title, {q(_D)}, ''), '\\s+(?:GitHub|Live Link|Demo)\\b.*$', ''), '|')[1], '^[ \\-—–|]+|[ \\-—–|]+$', '', 'g')"
CTES["explained"] = f"""
  select s.*, nt, b.best,
    list_filter([
      case when built_ai then 'AI project ''' || nt || ''' uses ' || array_to_string(list_concat(strong, llm)[1:5], ', ') || case when structural > 0 then ' with ' || array_to_string(list_transform(list_filter(dims, lambda d: d <> 'production'), lambda d: replace(d, '_', ' ')), ', ') else '' end end,
      case when m_fastapi then 'FastAPI used in project/experience work' end, case when n_py >= 2 then 'Python used across multiple projects/roles' end,
      case when m_docker and h_cloud then 'Containerised/cloud deployment experience' end, case when len(cats) >= 3 then 'Non-trivial engineering signals: ' || array_to_string(cats[1:4], ', ') end], lambda x: x is not null)[1:5] as strengths,
    list_concat(list_filter([
      case when built_ai and not list_contains(dims, 'evaluation') then 'No evaluation/metrics evidence in the AI project' end, case when not built_ai and ai_level = 'skills_only' then 'AI keywords appear only in the skills list' end,
      case when not m_pg then 'Limited PostgreSQL evidence' end, case when not m_redis then 'Limited Redis evidence' end, case when not h_docker then 'No Docker/deployment evidence' end,
      case when not list_contains(cats, 'testing') then 'No testing evidence' end], lambda x: x is not null), list_transform(penalties, lambda p: p.reason))[1:6] as concerns,
    case when built_ai then nt || ': ' || b.best[1] when ai_level = 'skills_only' then {q(S.ONLY_CLAIMED)} else '' end as project_summary
  from (select *, coalesce(nullif({trimmed(_TITLE, 80)}, ''), 'Project') as nt from scores) s left join bests b on s.file_ord = b.file_ord and s.b_idx = b.block_idx"""
CTES["answers"] = X.ANSWERS
CTES["objects"] = """
  select file_ord, case when strpos(bare, '{') > 0 and strpos(bare, '}') > 0 then substr(bare, strpos(bare, '{'), length(bare) - strpos(reverse(bare), '}') - strpos(bare, '{') + 2) end as o
  from (select file_ord, trim(regexp_replace(json, '(?m)^```(?:json)?|```$', '', 'g'), ' ' || chr(10)) as bare from answers)"""
CTES["judged"] = f"""
  select r.file_ord, o is not null and (o->>'$.overall_ai_depth')::int between 0 and 10 as valid, (o->>'$.overall_ai_depth')::bigint as depth, (o->>'$.summary') as summary,
    json_array_length(o, '$.projects') as n_all,
    list_filter(from_json(coalesce(o->'$.projects', '[]'::json), '[{{"name":"VARCHAR","kind":"VARCHAR","depth":"INTEGER","evidence":"VARCHAR"}}]'), lambda p: length({alnum('p.evidence')}) >= 12 and contains({alnum('r.text')}, {alnum('p.evidence')})) as kept,
    from_json(coalesce(o->'$.strengths', '[]'::json), '["VARCHAR"]') as j_strengths, from_json(coalesce(o->'$.concerns', '[]'::json), '["VARCHAR"]') as j_concerns
  from resumes r join (select file_ord, case when json_valid(o) then o::json end as o from objects) using (file_ord)"""
CTES["handles"] = r"""
  select file_ord, 'user' || regexp_extract(text, 'github\.com/user([0-9]+)', 1) as github_username from resumes where regexp_matches(text, 'github\.com/user[0-9]+')"""
CTES["repos"] = X.REPOS
CTES["lookups"] = X.LOOKUPS
CTES["repo_scores"] = f"""
  select key, case when days <= 30 then 5.0 when days <= 90 then 4.0 when days <= 180 then 3.0 when days <= 365 then 1.5 else 0.0 end::double as activity,
    (least(5, case when maintained >= 5 then 3 when maintained >= 3 then 2 when maintained >= 1 then 1 else 0 end + case when relevant >= 2 then 2 when relevant >= 1 then 1 else 0 end))::double as repo,
    maintained, relevant, strftime(last, '%Y-%m-%d') as last_push from (
    select lower(username) as key, max(pushed_at) filter (not fork) as last, count(*) filter (not fork and not archived and pushed_at >= timestamp '{X.NOW}' - interval 365 days) as maintained,
      count(*) filter (not fork and not archived and pushed_at >= timestamp '{X.NOW}' - interval 365 days and (language = 'Python' or regexp_matches(name, {rx(L.AI_REPO)}))) as relevant,
      floor((epoch_us(timestamp '{X.NOW}') - epoch_us(max(pushed_at) filter (not fork))) / 86400000000.0) as days from repos group by 1)"""
CTES["enriched"] = """
  select r.file_ord, github_username,
    case when github_username is null then 'no_profile' when http_status is null then 'error' when http_status = 404 then 'not_found' when http_status = 429 or (http_status = 403 and ratelimit_remaining = '0') then 'rate_limited' when http_status between 200 and 299 then 'ok' else 'error' end as status,
    activity, repo, maintained, relevant, last_push from resumes r left join handles using (file_ord) left join lookups l on lower(github_username) = l.username left join repo_scores s on lower(github_username) = s.key"""
CTES["github"] = """
  select file_ord, github_username, status as github_status, case when status = 'ok' then least(10, coalesce(activity, 0) + coalesce(repo, 0)) else 0 end::double as github, case when status = 'ok' then coalesce(maintained, 0) else 0 end::bigint as maintained_repos,
    case status when 'ok' then coalesce('Last push ' || last_push || '; ' || maintained || ' maintained repos (' || relevant || ' Python/AI-relevant)', 'No original public repositories') when 'no_profile' then 'No GitHub profile found in resume'
      when 'not_found' then 'GitHub user not found / private' when 'rate_limited' then 'GitHub API rate-limited' else 'GitHub enrichment failed' end as github_summary from enriched"""
CTES["keyed"] = f"select file_ord, sha256({alnum('text')}) as h, {email('text')} as e from resumes"
# only documents that share a key with another one are decided one after another
CTES["counted"] = "select *, count(*) over (partition by h) > 1 or (e is not null and count(*) over (partition by e) > 1) as contested from keyed"
CTES["contest"] = "select *, row_number() over (order by file_ord) as i from counted where contested"
CTES["greedy(i, seen, kept)"] = """
  select 0::bigint, map{''::varchar: 0::bigint}, true
  union all
  select k.i, case when map_contains(seen, 'h' || h) or (e is not null and map_contains(seen, 'e' || e)) then seen else map_concat(seen, map{'h' || h: file_ord}, case when e is null then map{} else map{'e' || e: file_ord} end) end,
    not (map_contains(seen, 'h' || h) or (e is not null and map_contains(seen, 'e' || e)))
  from greedy g join contest k on k.i = g.i + 1"""
CTES["holders"] = "select file_ord, h, e, g.kept from greedy g join contest k using (i) union all select file_ord, h, e, true from counted where not contested"
CTES["verdicts"] = """
  select k.file_ord, k.kept, case when not k.kept then case when a.file_ord < k.file_ord then a.file_ord when b.file_ord < k.file_ord then b.file_ord end end as duplicate_of
  from holders k left join holders a on a.kept and a.h = k.h left join holders b on b.kept and b.e = k.e"""


def chain(select: str, kept: bool = False) -> str:
    ctes = dict(CTES)
    if kept:
        ctes = {"all_resumes": ctes.pop("resumes"), "keyed": CTES["keyed"].replace("from resumes", "from all_resumes"), **{k: CTES[k] for k in ("counted", "contest", "greedy(i, seen, kept)", "holders", "verdicts")},
                "resumes": "select r.* from all_resumes r join verdicts v using (file_ord) where v.kept", **{k: v for k, v in ctes.items() if k not in ("keyed", "counted", "contest", "greedy(i, seen, kept)", "holders", "verdicts")}}
    needed, todo = set(), [select]
    while todo:
        text = todo.pop()
        new = [k for k in ctes if k not in needed and re.search(rf"\b{k.split('(')[0]}\b", text)]
        needed.update(new)
        todo += [ctes[k] for k in new]
    said = (f"{k} as ({v})" for k, v in ctes.items() if k in needed)
    return "with recursive " + ",\n".join(said) + "\n" + select


FINAL = f"""
select e.file_ord, r.file, regexp_extract(r.text, '^[^\\n]*') as candidate_name, g.github, g.github_status, e.reasons, len(e.reasons) = 0 as eligible, e.jd_similarity,
  case when coalesce(j.valid, false) and ai > 0 then round(least(40, ai + 8, 0.6 * ai + 0.4 * (depth_ / 10.0 * 40)), 1) else ai end as ai, e.python_backend, e.cloud_fullstack, e.engineering_depth,
  case when not coalesce(j.valid, false) then 'failed' when ai <= 0 then 'ok(no-op: no deterministic AI evidence)' else 'ok' end as llm_status,
  case when coalesce(j.valid, false) and ai > 0 and len(j.kept) > 0 and not list_has_any(list_transform(list_filter(j.kept, lambda p: p.depth >= 4), lambda p: p.kind), ['agentic', 'rag'])
    and len(list_filter(j.kept, lambda p: p.kind not in ('llm_wrapper', 'tutorial'))) = 0 and len(list_filter(penalties, lambda p: p.reason like 'Thin%')) = 0
    then list_append(penalties, {{'reason': {q(S.JUDGED_THIN)}, 'points': 10.0::double}}) else penalties end as penalties
from explained e join resumes r using (file_ord) join github g using (file_ord) left join (select file_ord, valid, depth as depth_, kept from judged) j using (file_ord)"""
CTES["final"] = FINAL
CTES["totals"] = "select *, round(greatest(0, least(100, ai + python_backend + cloud_fullstack + github + engineering_depth - least(15, coalesce(list_sum(list_transform(penalties, lambda p: p.points)), 0)))), 1)::double as total_score from final"
CTES["ranks"] = "select *, row_number() over (order by total_score desc, ai desc, jd_similarity desc, candidate_name, file_ord) as rank from totals where eligible"

PEN = "array_to_string(list_transform(penalties, lambda p: {0} || p.points::int || ' ' || p.reason), '; ')"


def digest(expression: str) -> str:
    return f"select doc_id, md5({expression}) as digest from documents"


def token(capacity: float, rate: float, ttl: float | None, source: str = X.CALLS_DUCK) -> str:
    expired = f"k.ts >= f.made + {ttl}" if ttl else "false"
    level = f"(case when {expired} then {capacity} else least({capacity}, f.tokens + greatest(0, k.ts - f.ts) * {rate}) end)"
    level = f"({level})::double"
    return f"""
with recursive c as ({source}), k as (select *, row_number() over (partition by key order by ts, seq) as i from c),
f as (
  select key, i, seq, ts, ts as made, cost, cost <= {capacity} as allowed, ({capacity} - case when cost <= {capacity} then cost else 0 end)::double as tokens from k where i = 1
  union all
  select k.key, k.i, k.seq, k.ts, case when {expired} then k.ts else f.made end, k.cost, {level} >= k.cost, {level} - case when {level} >= k.cost then k.cost else 0 end from f join k on k.key = f.key and k.i = f.i + 1)
select key, seq, allowed, round(case when allowed then 0 else (cost - tokens) / {rate} end, 4)::double as retry_after_s, round(tokens, 4)::double as remaining from f"""


SLIDING = f"""
with recursive c as ({X.CALLS_DUCK}), k as (select *, row_number() over (partition by key order by ts, seq) as i from c),
f as (
  select key, i, seq, ts, ts as start, case when cost <= 5 then cost else 0 end as cur, 0.0::double as prev, cost <= 5 as allowed, 0.0::double as passed, cost as used from k where i = 1
  union all
  select key, i, seq, ts, start, cur + case when ok then cost else 0 end, prev, ok, passed, used + cost from (
    select *, used + cost <= 5 as ok from (
      select *, ts - start as passed, cur + prev * greatest(0, 1 - (ts - start) / 86400.0) as used from (
        select k.key, k.i, k.seq, k.ts, k.cost,
          case when k.ts - f.start >= 172800 then k.ts when k.ts - f.start >= 86400 then f.start + 86400 else f.start end as start,
          case when k.ts - f.start >= 86400 then 0 else f.cur end as cur,
          case when k.ts - f.start >= 172800 then 0 when k.ts - f.start >= 86400 then f.cur else f.prev end as prev
        from f join k on k.key = f.key and k.i = f.i + 1))))
select key, seq, allowed, round(case when allowed then 0 else greatest(0.1, 86400 - passed) end, 4)::double as retry_after_s, round(case when allowed then greatest(0, 5 - used) else 0 end, 4)::double as remaining from f"""
LEAKY = f"""
with recursive c as ({X.CALLS_DUCK}), k as (select *, row_number() over (partition by key order by ts, seq) as i from c),
f as (
  select key, i, seq, ts, true as allowed, 0.0::double as wait_s, ts + 40000.0 as free from k where i = 1
  union all
  select key, i, seq, ts, w <= 50000, w, case when w <= 50000 then ts + w + 40000.0 else free end from (
    select k.key, k.i, k.seq, k.ts, f.free, greatest(k.ts, f.free) - k.ts as w from f join k on k.key = f.key and k.i = f.i + 1))
select key, seq, allowed, round(wait_s, 3)::double as wait_s from f"""
PAUSE = f"""
select key, seq, round(max(until_) over (partition by key order by ts, seq rows unbounded preceding), 4)::double as paused_until from (
  select *, case when seq % 7 = 0 then ts + value
    when event_type in ('error', 'signup') and seq % 4 = 0 then ts + case when seq % 3 <> 0 then least(3600, greatest(0, (ts + value) - ts) + 0.5) else 5 end
    when seq % 4 <= 1 then ts + 2 end as until_ from ({X.CALLS_DUCK}))"""
_REQUESTS = f"select (case when event_type = 'purchase' then 'w|' else 'r|' end) || key as key, ts / 5000 as ts, seq, 1.0::double as cost from ({X.CALLS_DUCK})"
HTTP = f"""
select * from (select key, seq, case when allowed then 202 else 429 end::bigint as status, case when not allowed then ceil(retry_after_s)::bigint else -1 end as retry_after from ({token(2.0, 0.1, 3600, f"select * from ({_REQUESTS}) where key like 'w%'")}))
union all
select * from (select key, seq, case when allowed then 202 else 429 end::bigint as status, case when not allowed then ceil(retry_after_s)::bigint else -1 end as retry_after from ({token(20.0, 2.0, 3600, f"select * from ({_REQUESTS}) where key like 'r%'")}))"""
STACK = f"""
with a as (select key, seq, row_number() over (order by ts, seq) as p from ({X.CALLS_DUCK})), b as (select *, lag(p) over (partition by key order by p) as was, lead(p) over (partition by key order by p) as next_ from a)
select x.seq, x.key as k, x.was is not null and (select count(*) from b y where y.p > x.was and y.p < x.p and (y.next_ is null or y.next_ > x.p)) < 100 as hit from b x"""
TTL = f"""
with recursive c as ({X.CALLS_DUCK}), k as (select *, row_number() over (partition by key order by ts, seq) as i from c),
f as (select key, i, seq, ts as put, false as hit from k where i = 1
  union all select k.key, k.i, k.seq, case when k.ts < f.put + 100000 then f.put else k.ts end, k.ts < f.put + 100000 from f join k on k.key = f.key and k.i = f.i + 1)
select seq, key as k, hit from f"""
SHARES = f"""
with a as (select 'c' || (key::bigint % 4) as cache, key, seq, row_number() over (order by ts, seq) as p from ({X.CALLS_DUCK})), b as (select *, lag(p) over (partition by key order by p) as was, lead(p) over (partition by key order by p) as next_ from a),
l as (select cache, x.was is not null and (select count(*) from b y where y.cache = x.cache and y.p > x.was and y.p < x.p and (y.next_ is null or y.next_ > x.p)) < 20 as hit from b x)
select cache, count(*) filter (hit) as hits, count(*) filter (not hit) as misses, round(count(*) filter (hit) / count(*), 4)::double as hit_ratio from l group by rollup (cache)"""

#: Token buckets that a bounded cache of the 50 keys used last keeps: a key that left it begins anew.
BOUNDED = f"""
with a as (select *, row_number() over (order by ts, seq) as p from ({X.CALLS_DUCK})), b as (select *, lag(p) over (partition by key order by p) as was, lead(p) over (partition by key order by p) as next_ from a),
s as (select x.*, case when x.was is null or (select count(*) from b y where y.p > x.was and y.p < x.p and (y.next_ is null or y.next_ > x.p)) >= 50 then 1 else 0 end as anew from b x)
select key || '#' || sum(anew) over (partition by key order by p) as key, ts, seq, cost from s"""
SHARDED = f"""
with a as (select 'all/' || (('0x' || substr(md5(key), 1, 8))::bigint % 16) as cache, key, seq, row_number() over (order by ts, seq) as p from ({X.CALLS_DUCK})), b as (select *, lag(p) over (partition by key order by p) as was, lead(p) over (partition by key order by p) as next_ from a)
select cache, seq, x.was is not null and (select count(*) from b y where y.cache = x.cache and y.p > x.was and y.p < x.p and (y.next_ is null or y.next_ > x.p)) < 4 as hit from b x"""
#: Lists have the key used last at their end: 4 keys on probation, 16 protected.
SEGMENTED = f"""
with recursive k as (select event_type as cache, key, seq, row_number() over (partition by event_type order by ts, seq) as i from ({X.CALLS_DUCK})),
f as (
  select cache, i, seq, key, false as hit, [key] as low, []::varchar[] as high from k where i = 1
  union all
  select k.cache, k.i, k.seq, k.key, list_contains(f.low, k.key) or list_contains(f.high, k.key),
    case when list_contains(f.high, k.key) then f.low when list_contains(f.low, k.key) then list_filter(f.low, lambda x: x <> k.key) else list_append(f.low, k.key)[-4:] end,
    case when list_contains(f.high, k.key) or list_contains(f.low, k.key) then list_append(list_filter(f.high, lambda x: x <> k.key), k.key)[-16:] else f.high end
  from f join k on k.cache = f.cache and k.i = f.i + 1)
select seq, key as k, hit, len(low) + len(high) as items from f"""
QUEUE = f"""
with recursive r as (
  select event_type as service, ts, seq, event_type = 'signup' and seq % 401 = 0 as stops, value * 30 as run_s, row_number() over (partition by event_type order by ts, seq) as i from ({X.CALLS_DUCK})),
f as (
  select service, 0::bigint as i, 0::bigint as seq, '' as status, null::double as started, null::double as completed, []::double[] as starts, -1e300::double as free, true as open from (select distinct service from r)
  union all
  select service, i, seq, status, case when status = 'queued' then begins end, case when status = 'queued' then begins + run_s end, case when status = 'queued' and begins > ts then list_append(starts, begins) else starts end,
    case when status = 'queued' then begins + run_s else free end, open and not stops
  from (
    select *, case when stops then 'stopping' when not open then 'unavailable' when len(starts) >= 3 then 'full' else 'queued' end as status from (
      select r.*, list_filter(f.starts, lambda x: x > r.ts) as starts, f.free, f.open, greatest(r.ts, f.free) as begins from f join r on r.service = f.service and r.i = f.i + 1)))
select service, seq, status, round(started, 3)::double as started, round(completed, 3)::double as completed from f where i > 0"""
#: Three calls at once, a burst of two and one each two seconds; pauses count from when their response came.
OUTBOUND = f"""
with recursive r as (
  select event_type as key, ts / 1000 as ts, seq, value / 10 as run_s, seq % 9 = 0 as refused, case when seq % 31 = 0 then value end as retry_after, seq % 5 as remaining,
    row_number() over (partition by event_type order by ts, seq) as i from ({X.CALLS_DUCK})),
f as (
  select key, 0::bigint as i, 0::bigint as seq, 0::double as started, 0::double as ended, []::double[] as ends, []::struct(t double, until double)[] as told, -1e300::double as turn, -1e300::double as paused, 2.0::double as tokens, (select min(ts) from r y where y.key = x.key)::double as last from (select distinct key from r) x
  union all
  select key, i, seq, started, started + run_s, list_sort(list_append(ends, started + run_s)),
    list_append(told, {{'t': started + run_s, 'until': case when retry_after is not null then started + run_s + retry_after when refused and remaining = 0 then started + run_s + 5 when remaining <= 1 then started + run_s + 2 else -1e300 end}}),
    turn, paused, tokens, now
  from (
    select *, case when have >= 1 then now else now + (1 - have) / 0.5 end as started, have - case when have >= 1 then 1 else 0 end as tokens, list_filter(all_told, lambda x: x.t > now) as told,
      greatest(was_paused, coalesce(list_max(list_transform(list_filter(all_told, lambda x: x.t <= now), lambda x: x.until)), -1e300)) as paused
    from (
      select *, least(2.0, had + greatest(0, now - was) * 0.5)::double as have from (
        select *, list_reduce(list_sort(all_told), lambda acc, x: case when x.t <= acc.t then {{'t': greatest(acc.t, x.until), 'until': acc.until}} else acc end, {{'t': greatest(turn, was_paused), 'until': 0::double}}).t as now from (
          select r.key, r.i, r.seq, r.run_s, r.refused, r.retry_after, r.remaining, f.told as all_told, f.paused as was_paused, f.tokens as had, f.last as was,
            case when len(f.ends) >= 3 then f.ends[2:] else f.ends end as ends, greatest(r.ts, f.turn, case when len(f.ends) >= 3 then f.ends[1] else r.ts end) as turn
          from f join r on r.key = f.key and r.i = f.i + 1)))))
select key, seq, round(started, 3)::double as started, round(ended, 3)::double as ended from f where i > 0"""
RETRIED = f"""
with t as (select *, http_status is null and answer like 'good%' as good from ({X.ATTEMPTS}) where attempt <= 2),
e as (select file_ord, min(attempt) filter (good or (http_status is not null and http_status not in (429, 500, 502, 503, 529))) as ended from t group by 1)
select e.file_ord, case when good then 'ok' else 'failed' end as status, (coalesce(ended, 2) + 1)::bigint as attempts, case when good then answer end as answer, case coalesce(ended, 2) when 0 then 0 when 1 then 1 else 3 end::double as wait_s
from e left join t on t.file_ord = e.file_ord and t.attempt = e.ended"""
GUARD = f"""
with e as (select event_type as cache, key as k, max(ts) as used, count(*) as size from ({X.CALLS_DUCK}) group by 1, 2),
u as (select *, sum(size) over () > 1600 as over_, (select count(distinct cache) from e) as n from e)
select cache, k, over_ and sum(size) over (partition by cache order by used desc, k desc rows unbounded preceding) > floor(1200.0 / n) as evicted from u"""
BLOOM = """
with owners as (select distinct o_custkey::varchar as h from orders), n as (select greatest(1, count(*)) as n from owners),
s as (select greatest(8, cast(trunc(-n * ln(0.05) / (ln(2) * ln(2))) as bigint)) as m, n from n), size as (select m, greatest(1, cast(round_even(m / n * ln(2), 0) as bigint)) as k from s),
placed as (select h, unnest(list_transform(range(0, k), lambda i: ((('0x' || substr(md5(h), 1, 15))::bigint % m) + i * ((('0x' || substr(md5(h), 17, 15))::bigint | 1) % m)) % m)) as p
  from (select h from owners union select c_custkey::varchar from customer), size),
filled as (select distinct p from placed where h in (select h from owners))
select c_custkey, bool_and(p in (select p from filled)) as maybe from customer join placed on h = c_custkey::varchar group by 1"""
_PAGE = "text"
for _odd, _plain in X.PAGE_LETTERS.items():
    _PAGE = f"replace({_PAGE}, '{_odd}', '{_plain}')"
FOLDER = f"select *, row_number() over (order by 'n=' || n) as file_ord from (select n::bigint as n, {_PAGE} as text from ({X.PAGES}))"
HANDLE_CACHE = f"""
select lower(username) as username, case when has = 1 then lower(username) || '-tool' end as name, case when has = 1 then 'Python' end as language, case when has = 1 then epoch(timestamp '1998-07-01')::bigint end as pushed from ({X.HANDLES}) where hours < 24"""

ORACLES: dict[str, str] = {
    "norm_space": digest(r"regexp_replace(text, '[ \t\x{A0}]+', ' ', 'g')"),
    "norm_ctrl": digest(r"regexp_replace(text, '[\x{E000}-\x{F8FF}\x00-\x08\x0B-\x1F\x7F-\x9F\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')"),
    "norm_bullets": digest(f"translate(text, {q(L.BULLETS)}, {q('•' * len(L.BULLETS))})"),
    "norm_dehyphen": digest(r"regexp_replace(text, '([\pL\pN_])-\n([\pL\pN_])', '\1\2', 'g')"),
    "norm_blank": digest(strip(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")),
    "norm_alnum": digest(alnum("text")),
    "clean_noise": digest(clean("text")),
    "truncate_chars": digest("left(text, 12000)"),
    "ext_email": f"select doc_id, {email('text')} as email from documents",
    "ext_name": chain(f"""
      select file_ord, coalesce(name, 'x') as name from (select file_ord, first(s order by pos) as name from (select file_ord, pos, {strip('line')} as s from raw_lines where pos < 8)
        where s <> '' and not contains(s, '@') and not regexp_matches(s, '\\d') and length(s) <= 50 and not regexp_matches(s, {rx(L.NOT_A_NAME)}) and regexp_matches(s, '^[A-Za-z.''’-]+(?:\\s+[A-Za-z.''’-]+){{1,3}}$') group by 1)"""),
    "ext_github": chain("select * from handles"),
    "hash_fingerprint": f"select doc_id, sha256({alnum('text')}) as h, sha256({strip('text')}) as content from documents",
    "flt_min_chars": "select doc_id, length(text) as n from documents where length(text) >= 80",
    "trim_ellipsis": f"select doc_id, {trimmed('text')} as short from documents",
    "json_extract": chain('select file_ord, o as "object" from objects'),
    "dedup_hash": f"select doc_id, min(doc_id) over (partition by h) as duplicate_of, doc_id = min(doc_id) over (partition by h) as kept from (select doc_id, sha256({alnum('text')}) as h from documents)",
    "dedup_first_wins": chain("select file_ord, kept, coalesce(duplicate_of, -1) as duplicate_of from verdicts"),
    "gen_sections": chain("select * from sections"),
    "gen_blocks": chain("select file_ord, block_idx, section, title, n_bullets, text from blocks"),
    "gen_lexicon_scan": chain("select file_ord, block_idx, name, tier from found"),
    "flt_tier": chain("select file_ord, name, built from h where tier in ('strong', 'llm') and (built or only_)"),
    "clean_title": chain(f"select file_ord, block_idx, coalesce(nullif({trimmed(_TITLE.replace('b_title', 'title'), 80)}, ''), 'Project') as title from blocks"),
    "win_top3_blocks": chain("select file_ord, round(depth, 5) as depth from depths"),
    "scan_github_ttl": f"select o_orderkey from orders where o_orderdate > timestamp '{X.NOW}' - interval 8760 hours",
    "agg_hits": chain("select file_ord, name, tier, coalesce(array_to_string(blocks, ','), '') as blocks, in_claims from hits"),
    "gate": chain("select file_ord, python_level, ai_level, len(reasons) = 0 as eligible, array_to_string(terms, ',') as ai_terms, array_to_string(matched, ',') as matched_skills, array_to_string(reasons, ',') as reasons from gate"),
    "tfidf_df": chain("select * from df"),
    "tfidf_weight": chain(f"select file_ord, block_idx, term, round(w / sqrt(sum(w * w) over (partition by file_ord, block_idx)), 9) as w from ({weighed('blocks', 'file_ord, block_idx')})"),
    "tfidf_distinctive": chain(f"select file_ord, block_idx, array_to_string((list(term order by w desc, term desc))[1:8], ',') as terms from ({weighed('blocks', 'file_ord, block_idx')}) group by 1, 2"),
    "tfidf_cosine": chain("select * from sims"),
    "tfidf_jd": chain("select * from jd"),
    "score_block": chain("select file_ord, block_idx, array_to_string(dims, ',') as dims, round(score, 5) as score from ai_blocks"),
    "win_best_bullets": chain("select file_ord, block_idx, array_to_string(best, '|') as best from bests"),
    "score_categories": chain("select file_ord, round(ai, 4) as ai, python_backend, cloud_fullstack, engineering_depth, jd_similarity from scores"),
    "pen_all": chain(f"select file_ord, {PEN.format(q(''))} as penalties from scores"),
    "explain": chain("select file_ord, array_to_string(strengths, '; ') as strengths, array_to_string(concerns, '; ') as concerns, project_summary from explained"),
    "agg_github": chain("select * from repo_scores"),
    "join_github_left": chain("select file_ord, github_status, github, maintained_repos, github_summary from github"),
    "verify_evidence": chain("select file_ord, coalesce(valid, false) as valid, case when valid then len(kept) else -1 end::bigint as kept, case when valid then depth else -1 end as depth from judged"),
    "win_rank": chain("select file, candidate_name, total_score, round(ai, 1) as ai, llm_status, rank from ranks", kept=True),
    "report_rows": chain(f"select file, eligible, case when eligible then total_score end as total_score, case when eligible then {PEN.format(q('-'))} else '' end as penalties, case when eligible then github_status end as github_status, array_to_string(reasons, '; ') as rejection_reasons from totals", kept=True),
    "limit_top": chain("select file, total_score from ranks where rank <= 10", kept=True),
    "agg_summary": chain("""
      select (select count(*) from all_resumes) as total_files, 0::bigint as failed_unreadable, (select count(*) from verdicts) as parsed_ok, (select count(*) from verdicts where not kept) as duplicates_skipped,
        (select count(*) from totals where eligible) as eligible, (select count(*) from totals t join github using (file_ord) where eligible and t.github_status = 'ok' and github_username is not null) as github_ok,
        (select count(*) from totals t join github using (file_ord) where eligible and t.github_status in ('error', 'rate_limited', 'not_found') and github_username is not null) as github_failed,
        (select count(*) from totals where eligible and llm_status like 'ok%') as llm_ok, (select count(*) from totals where eligible and llm_status = 'failed') as llm_failed, (select count(*) from totals where not eligible) as rejected""", kept=True),
    "rl_token_bucket": token(4.0, 0.0001, None),
    "rl_keyed": token(2.0, 0.00001, 86400.0),
    "rl_keyed_bounded": f"select split_part(key, '#', 1) as key, seq, allowed, retry_after_s, remaining from ({token(2.0, 0.00001, 86400.0, BOUNDED)})",
    "rl_outbound": OUTBOUND,
    "job_queue": QUEUE,
    "rss_probe": "select 'driver' as process, true as measured",
    "llm_retry": RETRIED,
    "guard_replay": GUARD,
    "cache_slru": SEGMENTED,
    "cache_sharded": SHARDED,
    "bloom_membership": BLOOM,
    "norm_nfkc": f"select n::bigint as n, {_PAGE} as text from ({X.PAGES})",
    "parse_ts": "select o_orderkey, case o_orderkey % 3 when 0 then epoch(o_orderdate::timestamp) + 37230 when 1 then epoch(o_orderdate::timestamp) + 30030 end::bigint as at from orders",
    "scan_text": f"select file_ord, n, case when length(text) >= 100 then text else '' end as text, case when length(text) < 100 then 'No extractable text (scanned image or empty file?)' end as error from ({FOLDER})",
    "scan_discover": f"select n::bigint as n, strlen(text) + 1 as bytes, 'txt' as suffix from ({X.PAGES})",
    "scan_github_cache": HANDLE_CACHE,
    "sink_cache": f"select o_orderkey from orders where o_orderdate > timestamp '{X.NOW}' - interval 87600 hours",
    "rl_sliding_window": SLIDING,
    "rl_leaky_bucket": LEAKY,
    "rl_pause_until": PAUSE,
    "http_rate_limit": HTTP,
    "cache_lru_stackdist": STACK,
    "cache_lru_ttl": TTL,
    "agg_cache_stats": SHARES,
    "metrics_rollup": "select event_type, count(*) as n, round(sum(value), 2) as value from events group by rollup (event_type)",
    "single_flight": "select user_id::varchar as key, count(*) as waiting from events group by 1",
    "win_first_seen": "select user_id, arg_min(event_type, event_id) as first from events group by 1",
    "mem_guard": "select event_type as cache, count(*) as bytes, case when sum(count(*)) over () > 800 then floor(600.0 / count(*) over ())::bigint else -1 end as evict_to from events group by 1",
}
ORACLES |= {"sink_csv": ORACLES["report_rows"], "sink_json": ORACLES["win_rank"]}
ORACLES["sink_terminal"] = f"""
with s as ({ORACLES["agg_summary"]})
select 0 as at, 'Batch: ' || total_files || ' files | parsed ' || parsed_ok || ' | eligible ' || eligible || ' | rejected ' || rejected || ' | failed ' || failed_unreadable || ' | duplicates ' || duplicates_skipped as line from s
union all select 1, 'GitHub ok/failed: ' || github_ok || '/' || github_failed || ' | LLM ok/failed: ' || llm_ok || '/' || llm_failed from s"""
