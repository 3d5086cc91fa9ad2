"""SQL of the sequential operators: star clusters name by name, and one-to-one assignment in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.rules import CATEGORIES
from ledgerloom.plans.enrich_queries import _RULED, _recurring, _squeeze, _title
from ledgerloom.plans.reconcile_queries import _LCS, _OUT, _SCORED, _set_ratio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _clusters(source: str, column: str) -> str:
    """CTEs ``named`` (name, canonical, canonical_id): each name in order leads unless an earlier leader is similar to it."""
    pairs = "(select lower(x.name) as a, lower(y.name) as b from names x join names y on x.name < y.name)"
    in_order = lambda x: f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"
    ordered = f"(select a as a0, b as b0, {in_order('a')} as a, {in_order('b')} as b from {pairs})"
    todo, set_ratio = _set_ratio(pairs)
    return f"""names as (select distinct {column} as name from {source} where {column} <> ''),
todo as (select a, b from {pairs} union select a, b from {ordered} union {todo}), {_LCS},
near as (select x.name, list(distinct y.name) as before from names x join names y on y.name < x.name
  join lcs p on p.a = lower(y.name) and p.b = lower(x.name) join {ordered} o on o.a0 = lower(y.name) and o.b0 = lower(x.name) join lcs q on q.a = o.a and q.b = o.b
  join {set_ratio} s on s.a = lower(y.name) and s.b = lower(x.name) where greatest(p.ratio, q.ratio, s.ratio) >= 0.8 group by 1),
ranked as (select names.name, coalesce(before, []) as before, row_number() over (order by names.name) as r from names left join near on near.name = names.name),
steps as (select cast(0 as bigint) as step, cast([] as varchar[]) as leaders
  union all select r, case when list_has_any(leaders, before) then leaders else list_append(leaders, name) end from steps join ranked on r = step + 1),
led as (select name, case when list_contains(leaders, name) then name else list_min(list_intersect(leaders, before)) end as leader from ranked, (select leaders from steps order by step desc limit 1)),
named as (select name, canonical, regexp_replace(lower(canonical), '[^a-z0-9]', '', 'g') as canonical_id
  from led join (select leader, min({{'n': length(name), 'name': name}}).name as canonical from led group by 1) using (leader))"""


_NORMAL = f"""n0 as (select *, {_title(_squeeze("regexp_replace(merchant_clean, '[^a-zA-Z0-9 ]', ' ', 'g')"))} as nt from ruled),
n1 as (select *, case when length(merchant_clean) > 3 and length(nt) > 2 then nt else merchant_clean end as merchant_normalized from n0)"""
_ALLOWED = "rc in (" + ", ".join(f"'{x}'" for x in CATEGORIES) + ")"
_RECURSIVE = _RULED.replace("with ", "with recursive ", 1)

ORACLE_SQL: dict[str, str] = {
    "A5_cluster_merchants": f"{_RECURSIVE}, {_clusters('clean', 'merchant_clean')} select * from named",
    "A17_process": f"""{_RECURSIVE}, {_NORMAL}, {_clusters('n1', 'merchant_normalized')},
        src as (select * from n1 left join named on name = merchant_normalized)
        select transaction_id, canonical as merchant_canonical, case when {_ALLOWED} then rc end as category, case when {_ALLOWED} then 'fallback' else 'uncategorized' end as status,
          format('{{:.2f}}', cast(abs(amount) as double)) || '_' || strftime(date, '%Y%m%d') || '_' || canonical_id as fingerprint, transaction_type
        from src join ({_recurring('src', ((25, 35), (13, 15)))}) using (transaction_id)""",
    "J14_reconcile": f"""{_SCORED}, pool as (select * from (select * from m qualify row_number() over (partition by t_id, d_id order by confidence desc, k) = 1) where confidence >= 0.6),
        live as (select t_ord, d_ord, confidence, 0 as it from pool
          union all select t_ord, d_ord, confidence, it + 1 from (select *, count(*) filter (gone) over () as n from (select *, holder is not null and holder < t_ord as gone
            from (select *, min(case when best then t_ord end) over (partition by d_ord) as holder from (select *, row_number() over (partition by t_ord order by confidence desc, d_ord) = 1 as best from live)))) where n > 0 and not gone),
        last as (select t_ord, d_ord from live where it = (select max(it) from live) qualify row_number() over (partition by t_ord order by confidence desc, d_ord) = 1)
        {_OUT} pool join last using (t_ord, d_ord)""",
}
