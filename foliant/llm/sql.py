"""DuckDB SQL for the queries that SQL can express."""

URL_RULES = r"""
with u as (
  select page_id, case when url is not null and instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), p as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u
), h as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
  from p
), r(rule_host, rule_path, rule_verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m as (
  select h.page_id, h.host, h.path, rule_host || rule_path as rule, rule_verdict,
         row_number() over (partition by h.page_id, h.host, h.path order by length(rule_host || rule_path) desc, rule_host || rule_path desc) as n
  from h left join r on (h.host = rule_host or ends_with(h.host, '.' || rule_host)) and starts_with(h.path, rule_path)
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from m where n = 1
"""

MIXING = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('17:' || coalesce(doc_id::varchar, '')) as draw
  from documents
), per as (
  select source, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint] as weight
  from sizes group by source
), run as (
  select *, 2 * source_size as cap, sum(source_size) over () as all_size, sum(weight) over () as all_weight,
         coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
         coalesce(sum(weight) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weight_before
  from per
), levels as (
  select *, (all_size::double * 1.5 - cap_before::double) / (all_weight - weight_before)::double as level from run
), final as (
  select *, (select arg_min(level, cap / weight) from levels where level * weight <= cap) as water from levels
), goal as (
  select source, source_size, least(cap::double, water * weight) as target from final
), whole as (
  select *, least(2, coalesce(floor(case when source_size > 0 then target / source_size end), 0))::bigint as repeats from goal
), rest as (
  select *, greatest(0.0, target - repeats * source_size) as more from whole
), ordered as (
  select s.doc_id, s.size, s.draw, r.*,
         coalesce(sum(s.size) over (partition by s.source order by s.draw, s.size rows between unbounded preceding and 1 preceding), 0) as got
  from sizes s join rest r on s.source is not distinct from r.source
), edges as (
  select source, max(draw) filter (where 2 * got + size <= 2 * more and got < more) as edge from ordered group by source
)
select o.doc_id, o.size, o.source_size::bigint as source_size, o.target, (o.size * (o.repeats + case when o.draw <= e.edge then 1 else 0 end))::bigint as taken
from ordered o join edges e on o.source is not distinct from e.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": URL_RULES, "op9_mixing": MIXING}
