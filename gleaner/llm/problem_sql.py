"""DuckDB SQL for problems 2 to 5, written independently of the Spark plans."""

USABLE = "({0} is not null and lower(trim({0})) not in ('', 'unknown', 'n/a', 'tbd', '-'))"

#: Acceptance round by round: a packet is out once an earlier one that is in links to it, and in once all earlier ones are out.
P2_FOUND = """
with recursive d as (select packet_id id, any_value(batch_no) b, any_value(statement) s from packets group by 1),
w as (select id, b, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')) ws from d where s is not null),
e as (select id, b, len(ws) n, unnest(ws) x from w where len(ws) > 0),
c as (select p.id i, q.id j, any_value(p.n) m, any_value(q.n) n, count(*) c from e p join e q on p.x = q.x and (p.b < q.b or (p.b = q.b and p.id < q.id)) group by 1, 2),
l as materialized (select i, j from c where c >= 0.7 * (m + n - c) - 1e-9),
r as (
  select 0 k, []::bigint[] gone, (select list(distinct i) from l where i not in (select j from l)) taken
  union all
  select k + 1, n.gone, list_distinct(list_concat(r.taken, (select coalesce(list(j), []) from (select l.j from l group by l.j having bool_and(list_contains(n.gone, l.i))))))
  from r, lateral (select coalesce(list(distinct l.j), []) gone from l where list_contains(r.taken, l.i)) n
  where k = 0 or len(n.gone) > len(r.gone)
), f as (select unnest(gone) id from (select gone from r order by k desc limit 1))
select i as accepted_id, j as packet_id from l where j in (select id from f) and i not in (select id from f)
"""

P3_FOUND = f"""
with r as (
  select upper(trim(principle_code)) code, record_id, authoritative_support a, live_revalidated l, null::int c, null::timestamp f, public_summary p, generated_at::timestamp t from principles
  union
  select upper(trim(principle_code)), packet_id, authoritative_support, live_revalidated, contradiction_count, freshness_checked_at::timestamp, public_summary, freshness_checked_at::timestamp from packets
), g as (
  select *, case lower(trim(a)) when 'strong' then 0 when 'medium' then 1 when 'weak' then 2 when 'none' then 3 else 4 end rk,
         case when t >= timestamp '2000-01-01' then t end tt
  from r where code in (select code from r where code is not null group by code having count(distinct record_id) > 1)
), e as (
  select code, 'authoritative_support' field_name, record_id, rk, tt from g where {USABLE.format("a")}
  union all select code, 'live_revalidated', record_id, rk, tt from g where l is not null
  union all select code, 'contradiction_count', record_id, rk, tt from g where c >= 0
  union all select code, 'freshness_checked_at', record_id, 0, f from g where f >= timestamp '2000-01-01'
  union all select code, 'public_summary', record_id, rk, tt from g where {USABLE.format("p")}
)
select code as principle_code, field_name, record_id from e
qualify row_number() over (partition by code, field_name order by rk, tt desc nulls last, record_id) = 1
"""

_CLAIMS = f"""
with recursive r as (
  select upper(trim(principle_code)) code, record_id rec, 'principles/' || lower(snapshot_id) src, generated_at::timestamp t, authoritative_support a, live_revalidated l, null::int c, null::timestamp f, public_summary p from principles
  union all select upper(trim(principle_code)), packet_id, 'packets/' || lower(community_repo), freshness_checked_at::timestamp, authoritative_support, live_revalidated, contradiction_count, freshness_checked_at::timestamp, public_summary from packets
), e as (
  select code || '|authoritative_support' item, src, lower(trim(a)) v, t, rec from r where {USABLE.format("a")}
  union all select code || '|live_revalidated', src, l::varchar, t, rec from r where l is not null
  union all select code || '|contradiction_count', src, c::varchar, t, rec from r where c >= 0
  union all select code || '|freshness_checked_at', src, f::varchar, t, rec from r where f >= timestamp '2000-01-01'
  union all select code || '|public_summary', src, lower(trim(p)), t, rec from r where {USABLE.format("p")}
), o as materialized (select item, src s, v from e where item is not null and src is not null qualify row_number() over (partition by item, src order by t desc nulls last, rec, v) = 1),
prs as materialized (select x.item, x.s i, y.s j, x.v v, x.v = y.v same from o x join o y on x.item = y.item and x.s < y.s),
acc0 as materialized (select distinct s, 0.8::double acc from o)"""


def _fused(rounds: int = 4) -> str:
    """Accuracies, dependences and posteriors, round by round."""

    def dependence(k: int, t: str, f: str, d: str, source: str) -> str:
        return f""", cnt{k} as (select i, j, count(*) filter (where {t}) t, count(*) filter (where {f}) f, count(*) filter (where {d}) d from {source} group by 1, 2),
        dep{k} as materialized (select i, j, 1 / (1 + 9 * exp(least(50, greatest(-50, t * ln(m * m / (m * 0.8 + m * m * 0.2)) + f * ln(((1 - m) * (1 - m) / 10) / ((1 - m) * 0.8 + (1 - m) * (1 - m) / 10 * 0.2)) + d * ln(1 / 0.2))))) dep
          from (select c.*, least(0.95, greatest(0.05, (x.acc + y.acc) / 2)) m from cnt{k} c join acc{k} x on x.s = i join acc{k} y on y.s = j))"""

    def posterior(k: int) -> str:
        return f""", los{k} as (select item, case when x.acc < y.acc then p.i else p.j end s, sum(ln(1 - 0.8 * dep)) lost from prs p join dep{k} d on d.i = p.i and d.j = p.j join acc{k} x on x.s = p.i join acc{k} y on y.s = p.j where same group by 1, 2),
        sco{k} as (select o.item, o.v, sum(exp(coalesce(lost, 0)) * ln(10 * least(0.99, greatest(0.01, acc)) / (1 - least(0.99, greatest(0.01, acc))))) score, count(*) n from o join acc{k} a on a.s = o.s left join los{k} l on l.item = o.item and l.s = o.s group by 1, 2),
        top{k} as (select *, greatest(0, max(score) over (partition by item)) top, count(*) over (partition by item) k from sco{k}),
        pos{k} as materialized (select item, v, exp(score - top) / (sum(exp(score - top)) over (partition by item) + greatest(11 - k, 0) * exp(-top)) p, n from top{k}),
        bst{k} as materialized (select * from pos{k} qualify row_number() over (partition by item order by round(p, 9) desc, v) = 1)"""

    out = [_CLAIMS, dependence(0, "same", "false", "not same", "prs")]
    for k in range(rounds):
        out.append(posterior(k))
        out.append(f", acc{k + 1} as materialized (select o.s, least(0.95, greatest(0.05, (sum(p) + 0.8) / (count(*) + 1))) acc from o join pos{k} q on q.item = o.item and q.v = o.v group by 1)")
        out.append(dependence(k + 1, "same and v = bv", "same and v <> bv", "not same", f"(select p.*, b.v bv from prs p join bst{k} b on b.item = p.item)"))
    out.append(posterior(rounds))
    return "".join(out) + f" select string_split(item, '|')[1] as principle_code, string_split(item, '|')[2] as field_name, v as value, round(p, 4) as posterior, n::int as n_sources from bst{rounds}"


P4_FOUND = """
with files as (select packet_id, payload from packet_files where json_valid(payload)),
a as (
  select packet_id, kind, topic, statement, recommendation_strength strength, applicability from packets
  union
  select packet_id, json_extract_string(payload, '$.kind'), json_extract_string(payload, '$.topic'), json_extract_string(payload, '$.statement'),
         json_extract_string(payload, '$.recommendationStrength'), json_extract_string(payload, '$.applicability') from files
), c as (
  select distinct packet_id, regexp_replace(lower(kind), '[^a-z0-9]+', '', 'g') k, regexp_replace(lower(topic), '[^a-z0-9]+', '', 'g') t,
         regexp_replace(lower(statement), '[^a-z0-9]+', '', 'g') s, regexp_replace(lower(strength), '[^a-z0-9]+', '', 'g') r,
         regexp_replace(lower(applicability), '[^a-z0-9]+', '', 'g') p
  from a where regexp_matches(statement, '\\S')
), g as (select packet_id, min(packet_id) over (partition by k, t, s, r, p) f from c)
select f as first_id, packet_id as copy_id from g where f <> packet_id
"""

_TERMS = """
with n as (select note_id, any_value(text) t from notes group by 1),
w as (select note_id, unnest(regexp_extract_all(lower(t), '[a-z]{3,}')) term from n where t is not null),
f as (select note_id, term, count(*) tf from w group by 1, 2),
s as (select term, count(*) df, sum(tf) cf from f group by 1)
"""

P5_FOUND = _TERMS + "select note_id, term from f join s using (term) where tf >= 4 and df between 2 and 6"

P5_SCORES = _TERMS + """
, l as (select note_id, sum(tf) len from f group by 1),
m as (select (select sum(tf) from f)::double / (select count(*) from n) mean, (select count(*) from n)::double n),
x as (
  select f.note_id, term, f.tf, s.df, s.cf, f.tf * log2(1 + m.mean / l.len) tfn, s.cf / m.n lam
  from f join s using (term) join l using (note_id), m
)
select note_id, term, tf, df, cf::bigint as cf, round((log2(1 + lam) - tfn * log2(lam / (1 + lam))) / (tfn + 1), 6) as score from x
"""

SQL = {"p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_fused": _fused(), "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_scores": P5_SCORES}
