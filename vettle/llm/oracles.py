"""SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

from vettle.llm.secrets import ACCESS, ASSIGN, ENTROPY, HEX, MOST_REPOSITORIES, TOUCHING, UUID, WIDE


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, value: int, keep: str) -> str:
    p = _quoted(pattern)
    return f"""
      select row_, doc_id, owner, repository, {kind} as kind, start_, start_ + length(m) as end_, v as value from (
        select row_, doc_id, owner, repository, ms[i] as m, vs[i] as v,
               cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as bigint) as start_
        from (select *, unnest(range(1, len(ms) + 1)) as i from (
          select row_, doc_id, owner, repository, regexp_extract_all(text, {p}) as ms, regexp_extract_all(text, {p}, {value}) as vs, regexp_split_to_array(text, {p}) as ps from docs))
      ) where {keep}"""


RANDOM = f"len(regexp_extract_all(v, '[A-Za-z][0-9]')) + len(regexp_extract_all(v, '[0-9][A-Za-z]')) >= {TOUCHING} and not regexp_matches(v, '{UUID}') and list_entropy(string_split(v, '')) >= {ENTROPY}"

OP2 = f"""
with docs as (select row_number() over () as row_, doc_id, source as owner, coalesce(text, '') as text, md5(coalesce(text, '')) as repository from documents),
found as ({' union all '.join((_spans(0, ASSIGN, 2, 'length(v) >= 6'), _spans(1, ACCESS, 1, 'true'), _spans(2, HEX, 1, 'true'), _spans(3, WIDE, 1, RANDOM)))}),
owned as (
  select value, count(distinct coalesce('o' || owner, '') || '|' || repository) as n_repositories, count(distinct owner) + max(case when owner is null then 1 else 0 end) as n_owners from found group by value),
judged as (select f.*, o.n_owners = 1 and o.n_repositories <= {MOST_REPOSITORIES} as live from found f join owned o using (value)),
all_ as (
  select * from judged where kind < 3
  union all
  select j.* from judged j where kind = 3 and live and not exists (select 1 from judged b where b.row_ = j.row_ and b.kind < 3 and b.start_ < j.end_ and j.start_ < b.end_)),
named as (select *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start_ || ':' || end_ as said from all_)
select d.doc_id,
  count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  sha256(coalesce(string_agg(said, ',' order by start_, kind) filter (kind < 3), '')) as base_sha256,
  coalesce(string_agg(said, ',' order by start_, kind), '') as spans,
  count(*) filter (live) as n_live, count(*) filter (not live) as n_example
from docs d left join named n using (row_) group by d.row_, d.doc_id
"""

_FIGURES = ("symbols", "length", "size", "distinct")
OP7 = rf"""
with words as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
counted as (
  select doc_id, source, len(w)::bigint as size, len(list_distinct(w)) as d, length(text) as n, len(regexp_extract_all(text, '[#*$%&|<>]')) as y,
    (('0x' || substr(md5('mix' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint)::double as u from words),
sized as (
  select doc_id, source, size, u, case when y = 0 then 0 when 100 * y < n then 1 when 20 * y < n then 2 else 3 end as f_symbols,
    least(15, n // greatest(size, 1)) as f_length, least(16, length(bin(size))) as f_size, 10 * d // greatest(size, 1) as f_distinct from counted),
labelled as (select s.*, quality from sized s join labels l using (doc_id) where quality in (0, 1)),
total as (select count(*) filter (quality = 1) as g, count(*) filter (quality = 0) as b from labelled),
bins as ({' union all '.join(f"select '{f}' as figure, f_{f} as bin, count(*) filter (quality = 1) as good, count(*) filter (quality = 0) as bad from labelled group by f_{f}" for f in _FIGURES)}),
odds as (
  select figure, bin, ln((coalesce(good, 0) + 1)::double / (g + 17)::double) - ln((coalesce(bad, 0) + 1)::double / (b + 17)::double) as o
  from (select * from (values {', '.join(f"('{f}')" for f in _FIGURES)}) f(figure), range(0, 17) r(bin)) left join bins using (figure, bin), total),
judged as (
  select s.*, greatest(0.05::double, 1.0::double / (1.0::double + exp(-((select ln((g + 1)::double / (b + 1)::double) from total) + {' + '.join(f"o_{f}.o" for f in _FIGURES)})))) as quality
  from sized s {' '.join(f"join odds o_{f} on o_{f}.figure = '{f}' and o_{f}.bin = s.f_{f}" for f in _FIGURES)}),
drawn as (select *, -ln((u + 0.5::double) / 4503599627370496.0::double) / quality as draw from judged),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from drawn group by source),
weighed as (select *, [5.0, 2.0, 1.0][(rank % 3 + 1)::int]::double as w, 2.0::double * source_size as cap, sum(source_size) over () as all_ from sources),
levels as (
  select *, (1.5::double * all_ - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, rank rows between current row and unbounded following) as level from weighed),
cut as (select level from levels where level * w <= cap order by cap / w, rank limit 1),
targets as (
  select source, source_size, case when (select count(*) from cut) = 0 then cap else least(cap, (select level from cut) * w) end as target from levels),
plans as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from targets),
ordered as (
  select d.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as left_,
    sum(size) over (partition by d.source order by draw, doc_id) as upto,
    sum(size) over (partition by d.source, draw, doc_id) as peers
  from drawn d join plans p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, (size * (epochs + case when upto - peers / 2.0 <= left_ then 1 else 0 end))::bigint as taken from ordered
"""

OP8 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from words)),
sizes as (select d.doc_id, count(s) as n from documents d left join shingles using (doc_id) group by d.doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as i from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from both_ join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * i >= 85 * (x.n + y.n - i)),
reach(id, other) as (select doc_id, doc_id from documents union select r.id, l.b from reach r join links l on r.other = l.a)
select s.doc_id, n as n_shingles, min(other) as component_id, s.doc_id = min(other) as kept from sizes s join reach r on s.doc_id = r.id group by s.doc_id, n
"""

OP9 = r"""
with docs as (
  select row_number() over () as row_, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select row_, i, array_to_string(w[i:i+7], chr(1)) as s from (select row_, w, unnest(range(1, len(w) - 6)) as i from docs where len(w) >= 8)),
twice as (select row_, i from (select *, count(*) over (partition by row_, s) as n from windows) where n > 1),
covered as (select row_, count(distinct i + j) as n from twice, range(0, 8) t(j) group by row_),
lines as (
  select row_, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
  from (select row_, unnest(string_split(text, chr(10))) as l from docs) where regexp_matches(l, '[^\x20\x09-\x0D]') group by row_),
feats as (
  select d.row_, doc_id, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words
  from docs d left join covered c using (row_) left join lines using (row_)),
based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from feats),
rules as (
  select source, 'base' as rule, base_failed::int as f from based
  union all select source, 'symbols', (10 * n_symbols > word_chars)::int from based
  union all select source, 'lines', (10 * n_dup_lines > 3 * n_lines)::int from based
  union all select source, 'words', (n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words))::int from based),
hosts as (select source, rule, sum(f)::double as f, count(*)::double as n from rules group by source, rule),
prior as (select rule, sum(f) / sum(n) as m, sum(f * f / n) as ff, sum(n) as n_all, sum(n * n) as nn, count(*) as hosts from hosts group by rule),
between_ as (select *, case when m > 0 and m < 1 and hosts > 1 then ((ff - m * m * n_all) / (m * (1 - m)) - (hosts - 1)) / nullif(n_all - nn / n_all - (hosts - 1), 0) end as b from prior),
strength as (select rule, m, case when b > 0 then least(1e6, greatest(1.0, 1 / b - 1)) else 1e6 end as k from between_),
rates as (select source, n + k as nk, (f + m * k) / (n + k) as r from hosts join strength using (rule)),
verdicts as (select source, bool_or(r - sqrt(r * (1 - r) / (nk + 1)) > 0.3) as failed from rates group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not failed as kept
from based b join verdicts v on b.source is not distinct from v.source
"""

OP10 = r"""
with docs as (select doc_id, length(coalesce(text, '')) as len_, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
ranked as (select *, first_value(doc_id) over (partition by text_sha256 order by len_ desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from docs)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from ranked
"""

ORACLES = {"op2_secret_scan": OP2, "op7_mixing": OP7, "op8_near_dedup": OP8, "op9_quality_rules": OP9, "op10_exact_dedup": OP10}
