"""Registered queries of the data operators, and SQL that tells the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import forest, keyed_tree, orphans, reconcile
from ..runtime import read_table as t


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return keyed_tree.heavy_edge_keys(t(spark, d, "edges"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return keyed_tree.edge_key_counts(t(spark, d, "edges"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.call_site_differences(t(spark, d, "observed_calls"), t(spark, d, "inferred_edges"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.call_site_difference_counts(t(spark, d, "observed_calls"), t(spark, d, "inferred_edges"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.graph_orphans(*[t(spark, d, n) for n in ("edges", "inferred_edges", "symbols", "external_symbols")])


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.containment(t(spark, d, "edges")).select("id", "root", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return forest.descendant_counts(forest.containment(t(spark, d, "edges"), with_paths=True))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return forest.descendants(forest.containment(t(spark, d, "edges"), with_paths=True))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_counts, p4_found, p4_report, p5_found, p5_paths, p5_descendants)}

_KEY = "upper(trim(type, ' \t\r\n'))"
_P3 = r"""with o as (select site_id, arg_max({'caller': caller, 'callee': callee, 'file': file, 'line': line}, (recorded_at, obs_id)) r
  from observed_calls where site_id is not null group by 1),
i as (select site_id, arg_max({'caller': caller, 'callee': callee, 'file': file, 'line': line}, (indexed_at, edge_no)) r
  from inferred_edges where site_id is not null group by 1),
u as (select 0 side, site_id, r.caller caller, r.callee callee, r.file file, r.line line from o
  union all select 1, site_id, r.caller, r.callee, r.file, r.line from i),
s as (select *, regexp_replace(regexp_replace(caller, '^\s+|\s+$', '', 'g'), '^python://', '') a,
  regexp_replace(regexp_replace(callee, '^\s+|\s+$', '', 'g'), '^python://', '') b from u),
v as (select side, site_id, file, line,
  regexp_replace(case when strpos(a, ':') > 0 then split_part(a, ':', 1) else regexp_extract(a, '^(.*)\.[^.]*$', 1) end, '\.__init__$', '') am,
  regexp_replace(case when strpos(a, ':') > 0 then substr(a, strpos(a, ':') + 1) else regexp_extract(a, '([^.]*)$', 1) end, '(^|\.)[^.<]*<.*$', '') aq,
  regexp_replace(case when strpos(b, ':') > 0 then split_part(b, ':', 1) else regexp_extract(b, '^(.*)\.[^.]*$', 1) end, '\.__init__$', '') bm,
  case when strpos(b, ':') > 0 then substr(b, strpos(b, ':') + 1) else regexp_extract(b, '([^.]*)$', 1) end bq from s),
x as (select coalesce(o.site_id, i.site_id) site_id, o.site_id is not null and i.site_id is not null two,
  [case when o.site_id is null then 'only_inferred' end, case when i.site_id is null then 'only_observed' end,
   case when two and (o.am is distinct from i.am or o.aq is distinct from i.aq) then 'caller' end,
   case when two and (o.bm is distinct from i.bm or o.bq is distinct from i.bq) then 'callee' end,
   case when two and o.file is distinct from i.file then 'file' end,
   case when two and o.line is distinct from i.line then 'line' end] ds
  from (select * from v where side = 0) o full outer join (select * from v where side = 1) i on o.site_id = i.site_id),
d as (select site_id, diff from (select site_id, unnest(ds) diff from x) where diff is not null)
"""
_P4 = """with r as (select 'edges' tbl, edge_id row_id, 'source' field, source ref, indexed_at seen from edges where source is not null
  union all select 'edges', edge_id, 'target', target, indexed_at from edges where target is not null
  union all select 'inferred_edges', edge_no, 'callee', callee, indexed_at from inferred_edges where resolved and callee is not null),
x as (select distinct * from r where ref not in (select id from external_symbols where id is not null)),
y as (select x.*, count(s.id) n, count(*) filter (s.indexed_at <= seen and (s.removed_at is null or seen < s.removed_at)) live,
  count(*) filter (s.indexed_at > seen) later from x left join symbols s on s.id = x.ref group by all),
o as (select distinct tbl, strftime(seen, '%Y-%m') period, row_id, field,
  case when n = 0 then 'missing' when later = n then 'late' else 'deleted' end reason from y where live = 0)
"""
_P5 = f"""with recursive c as (select target, source, indexed_at, edge_id from edges
  where {_KEY} = 'CONTAINS' and source is not null and target is not null),
p as materialized (select target id, arg_max(source, (indexed_at, edge_id)) parent from c group by 1),
n as materialized (select target id from c union select source from c),
t as materialized (with recursive w as (select id, id root, 0 depth, id path, [id] a from n where id not in (select id from p)
  union all select p.id, w.root, w.depth + 1, w.path || ' > ' || p.id, list_append(w.a, p.id) from w join p on p.parent = w.id) select * from w),
q as materialized (select p.* from p where id not in (select id from t)),
k as (select id a, parent b from q union select k.a, q.parent from k join q on q.id = k.b),
below as materialized (select q.id, case when exists (select 1 from k where k.a = q.id and k.b = q.id) then -1 else -2 end depth from q),
s as materialized (select x id, count(*) - 1 nd from (select unnest(a) x from t) group by 1)
"""

SQL = {
    "p2_found": f"select {_KEY} as type, target from edges where target is not null group by 1, 2 having count(*) * 100 >= (select count(*) from edges)",
    "p2_counts": f"select {_KEY} as type, target, count(*) n_edges, count(distinct source) n_sources, count(distinct file) n_files from edges group by 1, 2",
    "p3_found": _P3 + "select site_id, diff from d",
    "p3_counts": _P3 + "select diff, count(*) n_sites from d group by 1",
    "p4_found": _P4 + "select tbl, period, row_id, field, reason from o",
    "p4_report": _P4 + "select tbl, period, field, reason, count(*) n_references from o group by all",
    "p5_found": _P5 + "select id, root, depth from t union all select id, '', depth from below",
    "p5_paths": _P5 + "select t.id, root, depth, path, nd n_descendants from t join s using (id) union all select id, '', depth, null, 0 from below",
    "p5_descendants": _P5 + "select ancestor, id descendant, depth - list_position(a, ancestor) + 1 distance from (select id, depth, a, unnest(a[1:-2]) ancestor from t)",
}
