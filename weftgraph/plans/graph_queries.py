"""Registered queries of the graph operators, and SQL that tells the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import extract_all
from ..functions import paths
from ..functions.keys import call_end, symbol_key
from ..graph import CodeGraph, first_wins, from_tables
from ..operators import accuracy, export, incremental, lookup, stats, traverse
from ..operators.keyed_tree import edge_type
from ..runtime import read_table as t
from ..runtime import stage

QUERIES, SQL = {}, {}

_SPACE = "' \t\r\n'"
_G = f"""s as materialized (select id, ord, r.type as type, r.language as language, r.name as name, r.file as file, r.line as line from (select id, min(ord) ord,
  arg_min({{'type': type, 'language': language, 'name': name, 'file': file, 'line': line}}, ord) r from symbols where id is not null group by id)),
e as materialized (select distinct edge_id seq, upper(trim(type, {_SPACE})) as type, source, target, language, confidence, file, line
  from edges where source is not null and target is not null),
hub as materialized (select target id from e where type = 'CALLS' and target in (select id from s where type = 'function') group by 1 order by count(*) desc, 1 limit 1),
far as materialized (select min(x.source) id from e x join e y on y.source = x.target where x.type = 'CALLS' and y.type = 'CALLS' and y.target = (select id from hub) and x.source <> y.target),
busy as materialized (select source id from e where type = 'CALLS' and source in (select id from s where type = 'function') group by 1 order by count(*) desc, 1 limit 1)
"""


def query(sql: str | None = None, graph: bool = True):
    """Registers a query; ``sql`` is its oracle, after the graph's tables where ``graph`` is set."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            more = sql.startswith("+")
            SQL[f.__name__] = f"with recursive {_G}{', ' if more else ''}{sql[1:] if more else sql}" if graph else sql
        return f

    return add


def _most(g: CodeGraph, end: str) -> str:
    functions = g.symbols.filter(F.col("type") == "function").select(F.col("id").alias(end))
    top = g.edges.filter(F.col("type") == "CALLS").join(functions, end, "left_semi").groupBy(end).count().orderBy(F.desc("count"), end)
    row = top.first()
    return row[0] if row else ""


def hub(g: CodeGraph) -> str:
    """The function that most CALLS edges go to."""
    return _most(g, "target")


def busy(g: CodeGraph) -> str:
    """The function that most CALLS edges come from."""
    return _most(g, "source")


def far(g: CodeGraph) -> str:
    """The first function in order of id that calls a caller of the hub."""
    calls = g.steps().filter(F.col("type") == "CALLS")
    top = hub(g)
    near = calls.filter(F.col("target") == top).select(F.col("source").alias("target"))
    return calls.filter(F.col("source") != top).join(near, "target", "left_semi").agg(F.min("source")).first()[0] or ""


def _file(g: CodeGraph, id_: str) -> str:
    row = g.symbols.filter(F.col("id") == id_).select("file").first()
    return row[0] if row and row[0] else ""


@query("select id, type, name, coalesce(file, '') file from s where contains(lower(name), 'ledger') or contains(lower(id), 'ledger') order by type, id limit 20")
def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    return lookup.find_symbol(from_tables(spark, d), "Ledger")


@query("select id, type, name, file, line from s where contains(lower(name), 'ledger') or contains(lower(id), 'ledger')")
def find_all(spark: SparkSession, d: str) -> DataFrame:
    return lookup.matching(from_tables(spark, d), "Ledger").select("id", "type", "name", "file", "line")


@query("select id from s where contains(id, 'Ledger') or contains(name, 'Ledger') order by ord limit 1")
def probe_symbol(spark: SparkSession, d: str) -> DataFrame:
    return lookup.probe(from_tables(spark, d), "Ledger")


@query("select id from hub")
def exact_by_id(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return spark.createDataFrame([(x,) for x in lookup.exact_ids(g, hub(g))], "id string")


@query("select id, ord from s where name = 'emit_ledger'")
def exact_by_name(spark: SparkSession, d: str) -> DataFrame:
    return lookup.symbols_by_name(from_tables(spark, d), "emit_ledger")


@query("select id from s where file = (select file from s where id = (select id from hub))")
def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return lookup.file_symbols(g, _file(g, hub(g)))


@query("select id, row_number() over (order by type, id) - 1 as rank from s where contains(lower(name), 'ledgerp') or contains(lower(id), 'ledgerp') order by type, id limit 25")
def resolve_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    ids = lookup.resolve_ids(from_tables(spark, d), "LedgerP")
    return spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "id string, rank long")


_CALLS = """select e.{there} {out}, coalesce(s.name, e.{there}) {out}_name, e.line, e.confidence, e.seq from e left join s on s.id = e.{there}
  where e.type = 'CALLS' and e.{here} = (select id from {who}) order by coalesce(e.confidence, ''), e.{there}, e.seq limit 50"""


@query(_CALLS.format(here="target", there="source", out="caller", who="hub"))
def callers(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return lookup.callers_of(g, hub(g))


@query(_CALLS.format(here="source", there="target", out="callee", who="busy"))
def callees(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return lookup.callees_of(g, busy(g))


_EDGE = ("seq", "type", "source", "target", "confidence", "line")


@query(f"select {', '.join(_EDGE)} from e where source = (select id from busy)")
def edges_from(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return lookup.edges_from(g, busy(g)).select(*_EDGE)


@query(f"select {', '.join(_EDGE)} from e where target = (select id from hub)")
def edges_to(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return lookup.edges_to(g, hub(g)).select(*_EDGE)


@query(f"select {', '.join(_EDGE)} from e where type = 'INHERITS'")
def edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    return lookup.edges_by_type(from_tables(spark, d), "INHERITS").select(*_EDGE)


_IMPACT = """+ b(id, depth, path, via) as (select id, 0, cast([] as bigint[]), '' from hub
  union all select e.source, b.depth + 1, list_append(b.path, e.seq), e.type from b join e on e.target = b.id where e.type in ({types}) and b.depth < {depth}),
f as (select * from (select *, row_number() over (partition by id order by depth, path) k from b) where k = 1 and depth > 0),
c as (select * from f order by depth, path limit {limit})
select c.depth distance, c.via, c.id, coalesce(s.type, 'unknown') as type, coalesce(s.name, c.id) as name, coalesce(s.file, '') as file from c left join s on s.id = c.id"""
_USUAL = "'CALLS', 'IMPORTS', 'CONTAINS'"


@query(_IMPACT.format(types=_USUAL, depth=3, limit=200))
def impact_d3(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.impact_of(g, hub(g))


@query(_IMPACT.format(types=_USUAL, depth=3, limit=7))
def impact_truncated(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.impact_of(g, hub(g), limit=7)


@query(_IMPACT.format(types="'CALLS'", depth=4, limit=200))
def impact_calls_only(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.impact_of(g, hub(g), depth=4, types=["CALLS"])


_PATH = """+ ends as (select (select id from {a}) a, (select id from {b}) b),
back(id, d) as (select b, 0 from ends union select e.source, back.d + 1 from back join e on e.target = back.id where e.type in ({types}) and back.d < {depth}),
r as materialized (select id, min(d) d from back group by 1),
walk(step, edge, id, d) as (select 0, '', a, r.d from ends join r on r.id = a
  union all select step + 1, n.type, n.target, w.d - 1 from walk w, lateral (select e.type, e.target from e join r on r.id = e.target
    where e.source = w.id and e.type in ({types}) and r.d = w.d - 1 order by e.seq limit 1) n where w.d > 0)
select step, edge, walk.id, coalesce(s.type, 'unknown') as type, coalesce(s.name, walk.id) as name, coalesce(s.file, '') as file from walk left join s on s.id = walk.id"""
_ALL = "'CALLS', 'IMPORTS', 'CONTAINS', 'INHERITS'"


@query(_PATH.format(a="far", b="hub", types=_ALL, depth=12))
def path_default(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.shortest_path(g, far(g), hub(g))


@query(_PATH.format(a="far", b="hub", types="'CALLS'", depth=12))
def path_typed(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.shortest_path(g, far(g), hub(g), types=["CALLS"])


@query(_PATH.format(a="hub", b="busy", types="'INHERITS'", depth=12))
def path_none(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.shortest_path(g, hub(g), busy(g), types=["INHERITS"])


_NEAR = """+ u as (select source a, target b from e union all select target, source from e),
n(id, d) as (select id, 0 from {seed} union select u.b, n.d + 1 from n join u on u.a = n.id where n.d < 2),
near as materialized (select id, min(d) d from n group by 1)"""


@query(_NEAR.format(seed="s where file = (select file from s where id = (select id from hub))") + "\nselect distinct file from s where length(file) > 0 and id in (select id from near) order by file limit 100")
def related_files_d2(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.related_files(g, _file(g, hub(g)))


_CLOSE = _NEAR.format(seed="hub") + ",\nclose as materialized (select id from near order by d, id limit 120)\n"


@query(_CLOSE + "select id, name as label, type, coalesce(file, '') as file, language from s where id in (select id from close)")
def neighborhood_rows(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.neighbourhood(g, hub(g))[0]


@query(_CLOSE + "select source, target, type, arg_min({'c': confidence}, seq).c as confidence from e where source in (select id from close) and target in (select id from close) group by 1, 2, 3")
def neighborhood_edges(spark: SparkSession, d: str) -> DataFrame:
    g = from_tables(spark, d)
    return traverse.neighbourhood(g, hub(g))[1]


@query("""select 'totals' section, 'symbols' metric, count(*) n from s union all select 'totals', 'edges', count(*) from e
union all select 'symbol_types', type, count(*) from s group by type union all select 'languages', language, count(*) from s group by language
union all select 'edge_types', type, count(*) from e group by type
union all select 'confidence', case when length(confidence) > 0 then confidence else 'unknown' end, count(*) from e group by all""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.stats(from_tables(spark, d))


@query("""with f as (select rel, arg_max({'lang': lang, 'ok': content is not null}, file_seq) r from source_files where rel is not null group by 1)
select r.lang as language, count(*) files_seen, count(*) filter (r.ok) files_indexed, count(*) filter (r.ok) * 10000 // count(*) basis_points from f group by 1""", graph=False)  # fmt: skip
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(t(spark, d, "source_files"))


@query("select id, ord, type, language, name, file, line from s")
def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return from_tables(spark, d).symbols.select("id", "ord", "type", "language", "name", "file", "line")


@query("""select id, arg_min({'t': type}, (file is null, ord)).t as type, arg_min({'f': file}, (file is null, ord)).f as file from symbols where id is not null group by 1""", graph=False)
def dedupe_definition_wins(spark: SparkSession, d: str) -> DataFrame:
    return first_wins(t(spark, d, "symbols").select("ord", "id", "type", "file"), keep="definition").select("id", "type", "file")


_VISUAL = "+ v as materialized (select id, name, type, coalesce(file, '') as file from s order by type, id limit 5000)\n"


@query(_VISUAL + "select * from v")
def visual_nodes(spark: SparkSession, d: str) -> DataFrame:
    return export.visual(from_tables(spark, d))[0]


@query(_VISUAL + "select source, target, type, seq from e where source in (select id from v) and target in (select id from v)")
def visual_links(spark: SparkSession, d: str) -> DataFrame:
    return export.visual(from_tables(spark, d))[1]


@query("select sha256(text) as hash, min(doc_id) doc_id, count(*) n from documents where text is not null group by 1", graph=False)
def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unique_contents(t(spark, d, "documents"), "doc_id", "text")


_NEWEST = "select rel, arg_max({{'l': lang, 'h': hash, 'm': mtime_ns}}, (mtime_ns, file_seq)) r from source_files where rel is not null and {} group by 1"


@query(f"""with a as ({_NEWEST.format("content is not null")}), b as ({_NEWEST.format("status = 'reused'")})
select coalesce(a.rel, b.rel) rel, case when a.rel is null then 'removed' when b.rel is null then 'added' when a.r is not distinct from b.r then 'reused' else 'changed' end as action
from a full outer join b on a.rel = b.rel""", graph=False)  # fmt: skip
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "source_files")
    return incremental.reuse(incremental.newest_files(files.filter(F.col("content").isNotNull())), incremental.newest_files(files.filter(F.col("status") == "reused")))


@query("select rel, sha256(content) as hash, length(content) n_chars from source_files where content is not null", graph=False)
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    f = t(spark, d, "source_files").filter(F.col("content").isNotNull())
    return f.select("rel", incremental.content_hash(F.col("content").cast("binary")).alias("hash"), F.length("content").cast("long").alias("n_chars"))


@query("""select distinct rel, case lower(regexp_extract(rel, '[^/](\\.[^./]+)$', 1)) when '.py' then 'python' when '.go' then 'go' when '.java' then 'java'
  when '.ts' then 'typescript' when '.tsx' then 'typescript' when '.js' then 'typescript' when '.cjs' then 'typescript' when '.mjs' then 'typescript' end as language
from source_files where rel is not null and len(list_intersect(string_split(rel, '/'), (select list(dir_name) from exclude_dirs))) = 0""", graph=False)  # fmt: skip
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in t(spark, d, "exclude_dirs").select("dir_name").filter("dir_name is not null").distinct().collect()]
    f = t(spark, d, "source_files").filter(F.col("rel").isNotNull())
    return f.filter(~paths.excluded(F.col("rel"), names)).select("rel", paths.language(F.col("rel")).alias("language")).distinct()


@query("""select distinct rel, replace(regexp_replace(regexp_replace(rel, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') as module from source_files
where rel like '%.py' and len(list_intersect(string_split(rel, '/'), (select list(dir_name) from exclude_dirs))) = 0 and regexp_replace(regexp_replace(rel, '\\.py$', ''), '(^|/)__init__$', '') <> ''""", graph=False)  # fmt: skip
def module_names(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in t(spark, d, "exclude_dirs").select("dir_name").filter("dir_name is not null").distinct().collect()]
    f = t(spark, d, "source_files").select("rel", paths.module_name(F.col("rel"), names).alias("module"))
    return f.filter(F.col("module").isNotNull()).distinct()


def _key_sql(c: str) -> str:
    rest = f"substr({c}, 10)"
    m = f"case when strpos({rest}, ':') > 0 then split_part({rest}, ':', 1) else regexp_extract({rest}, '^(.*)\\.[^.]*$', 1) end"
    q = f"case when strpos({rest}, ':') > 0 then substr({rest}, strpos({rest}, ':') + 1) else regexp_extract({rest}, '([^.]*)$', 1) end"
    return f"case when starts_with({c}, 'python://') and length({m}) > 0 and length({q}) > 0 then {m} || chr(0) || {q} end"


_PARTS = "case when k is null then null else split_part(k, chr(0), 1) end as module, case when k is null then null else split_part(k, chr(0), 2) end as qualname"


@query(f"select id, {_PARTS} from (select id, {_key_sql('id')} k from s)")
def symbol_key_parse(spark: SparkSession, d: str) -> DataFrame:
    return from_tables(spark, d).symbols.select("id", symbol_key(F.col("id")).alias("k")).select("id", "k.module", "k.qualname")


_O = r"""regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '^python://', '')"""


def _end_sql(c: str, caller: bool) -> str:
    s = _O.format(c=c)
    m = f"regexp_replace(case when strpos({s}, ':') > 0 then split_part({s}, ':', 1) else regexp_extract({s}, '^(.*)\\.[^.]*$', 1) end, '\\.__init__$', '')"
    q = f"case when strpos({s}, ':') > 0 then substr({s}, strpos({s}, ':') + 1) else regexp_extract({s}, '([^.]*)$', 1) end"
    if caller:
        q = f"regexp_replace({q}, '(^|\\.)[^.<]*<.*$', '')"
    return f"{m} || chr(0) || {q}"


_A = f"""+ defined as materialized (select distinct {_key_sql('id')} k from s where file is not null),
c as materialized (select seq, source, target, {_key_sql('source')} caller, {_key_sql('target')} callee, confidence, file, line from e where type = 'CALLS'),
calls as materialized (select c.*, caller is not null and callee is not null and callee in (select k from defined where k is not null) resolved from c),
pairs as materialized (select distinct {_end_sql('caller', True)} caller, {_end_sql('callee', False)} callee from observed_calls where caller is not null and callee is not null),
named as materialized (select caller, callee, max(seq) seq from calls where caller is not null and callee is not null group by 1, 2),
miss as materialized (select p.* from pairs p left join named n using (caller, callee) where n.seq is null)
"""
_TWO = "split_part(caller, chr(0), 1) caller_module, split_part(caller, chr(0), 2) caller_qualname, split_part(callee, chr(0), 1) callee_module, split_part(callee, chr(0), 2) callee_qualname"


def _two(df: DataFrame, *more: str) -> DataFrame:
    each = [F.col(f"{e}.{p}").alias(f"{e}_{p}") for e in ("caller", "callee") for p in ("module", "qualname")]
    return df.select(*each, *more)


def _accuracy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    calls = stage(accuracy.split_calls(from_tables(spark, d)), "calls")
    return calls, accuracy.observed_pairs(t(spark, d, "observed_calls"))


@query(_A + "select seq, source, target, resolved from calls")
def acc_split(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy(spark, d)[0].select("seq", "source", "target", "resolved")


@query(_A + f"select {_TWO}, seq, confidence, file, line from (select p.*, n.seq, c.confidence, c.file, c.line from pairs p join named n using (caller, callee) join calls c using (seq))")
def acc_matched(spark: SparkSession, d: str) -> DataFrame:
    return _two(accuracy.matched(*_accuracy(spark, d)), "seq", "confidence", "file", "line")


@query(_A + f"select {_TWO} from miss")
def acc_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _two(accuracy.unmatched(*_accuracy(spark, d)))


@query(_A + f"select {_TWO}, seq from calls where resolved and not exists (select 1 from pairs p where p.caller = calls.caller and p.callee = calls.callee)")
def acc_unobserved(spark: SparkSession, d: str) -> DataFrame:
    return _two(accuracy.unobserved(*_accuracy(spark, d)), "seq")


@query(_A + "select split_part(caller, chr(0), 1) as module, split_part(caller, chr(0), 2) as qualname from calls where caller is not null group by caller having not bool_or(resolved)")
def acc_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.unresolved_only_callers(_accuracy(spark, d)[0]).select("caller.module", "caller.qualname")


_METHOD = "regexp_extract(split_part(callee, chr(0), 2), '([^.]*)$', 1)"


@query(_A + f"select split_part(caller, chr(0), 1) as module, split_part(caller, chr(0), 2) as qualname, {_METHOD} as method, array_to_string(list_sort(list(distinct split_part(callee, chr(0), 2))), '|') as declared from calls where resolved group by caller, method")
def acc_declared(spark: SparkSession, d: str) -> DataFrame:
    x = accuracy.declared_targets(_accuracy(spark, d)[0])
    return x.select("caller.module", "caller.qualname", "method", F.array_join("qualnames", "|").alias("declared"))


@query(_A + f""", lonely as materialized (select caller from calls where caller is not null group by caller having not bool_or(resolved)),
names as materialized (select distinct caller, {_METHOD} as method, split_part(callee, chr(0), 2) q from calls where resolved)
select case when caller in (select caller from lonely) then 'unresolved'
  when exists (select 1 from names n where n.caller = miss.caller and n.method = regexp_extract(split_part(miss.callee, chr(0), 2), '([^.]*)$', 1) and n.q <> split_part(miss.callee, chr(0), 2)) then 'override'
  else 'silent' end as class, count(*) n from miss group by 1""")  # fmt: skip
def acc_miss_class(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.miss_classes(*_accuracy(spark, d))


@query(_A + """select o n_observed, m n_matched, i n_inferred, u n_unresolved, i - u n_judgeable, case when o > 0 then m * 10000 // o end precision_bp
from (select (select count(*) from pairs) o, (select count(*) from pairs join named using (caller, callee)) m, (select count(*) from calls) i, (select count(*) from calls where not resolved) u)""")  # fmt: skip
def acc_precision(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.summary(*_accuracy(spark, d))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Observed calls as hand labels would name them."""
    o = t(spark, d, "observed_calls")
    c = call_end(o["callee"], False)
    return o.select(F.col("file").alias("caller_file"), call_end(o["caller"], True)["qualname"].alias("caller_qualname"), F.concat_ws(":", c["module"], c["qualname"]).alias("callee"), F.col("obs_id").alias("seq")).filter("caller_file is not null and caller_qualname is not null and callee <> ''")


_CALLEE = f"replace({_end_sql('callee', False)}, chr(0), ':')"
_L = f"""+ l as materialized (select file caller_file, split_part({_end_sql('caller', True)}, chr(0), 2) caller_qualname, {_CALLEE} callee, obs_id seq from observed_calls
  where file is not null and caller is not null and callee is not null),
region as materialized (select seq, file caller_file, split_part({_key_sql('source')}, chr(0), 2) caller_qualname, regexp_replace(target, '^[^:/]*://', '') callee, line
  from e where type = 'CALLS' and file in (select caller_file from l) and {_key_sql('source')} is not null),
known as materialized (select distinct regexp_replace(id, '^[^:/]*://', '') k from s where file is not null),
mine as materialized (select caller_file, caller_qualname, callee, callee in (select k from known) resolved from region group by 1, 2, 3),
hand as materialized (select distinct caller_file, caller_qualname, callee from l)
"""
_LK = "caller_file, caller_qualname, callee"


@query(_L + f"select {_LK} from mine join hand using ({_LK})")
def sample_confirmed(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    return accuracy.sample_confirmed(accuracy.sample_region(from_tables(spark, d), labels), labels)


@query(_L + f"select {_LK} from mine where not exists (select 1 from hand h where h.caller_file = mine.caller_file and h.caller_qualname = mine.caller_qualname and h.callee = mine.callee)")
def sample_unconfirmed(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    return accuracy.sample_unconfirmed(accuracy.sample_region(from_tables(spark, d), labels), labels)


@query(_L + f"select {_LK} from hand h where not exists (select 1 from mine where h.caller_file = mine.caller_file and h.caller_qualname = mine.caller_qualname and h.callee = mine.callee)")
def sample_missing(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    return accuracy.sample_missing(accuracy.sample_region(from_tables(spark, d), labels), labels)


@query(_L + f"""select c n_confirmed, n - c n_unconfirmed, u n_unresolved, coalesce(c * 10000 // nullif(n, 0), 0) precision_bp
from (select (select count(*) from mine join hand using ({_LK})) c, (select count(*) from mine) n, (select count(*) from mine where not resolved) u)""")  # fmt: skip
def sample_precision(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    return accuracy.sample_summary(accuracy.sample_region(from_tables(spark, d), labels), labels)


@query("select file caller_file, min(obs_id) as first from observed_calls where file is not null and caller is not null and callee is not null group by 1", graph=False)
def labelled_files(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.ordered_files(_labels(spark, d))


@query(f"select upper(trim(type, {_SPACE})) as type, confidence, repo, count(*) n from edges group by all", graph=False)
def edges_by_repo(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "edges")
    return e.groupBy(edge_type(e["type"]).alias("type"), "confidence", "repo").agg(F.count("*").alias("n"))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the extractors give for the stored contents of all files."""
    f = t(spark, d, "source_files").filter("content is not null and rel is not null").select("rel", F.lit(0).cast("long").alias("file_seq"), paths.language(F.col("rel")).alias("lang"), F.col("content").cast("binary").alias("content"))
    return extract_all(f.filter("lang is not null").distinct())


@query()
def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).filter("kind = 's'").select("rel", "emit", "id", "type", "language", "name", "file", "line", "metadata")


@query()
def extracted_edges(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).filter("kind = 'e'").select("rel", "emit", "type", "source", "target", "language", "confidence", "file", "line")


@query("""with f as (select distinct rel, content from source_files where content is not null and rel is not null),
j as (select rel, unnest(regexp_extract_all(content, '(?m)^import (?:static )?([A-Za-z_][\\w.]*\\w)', 1)) target from f where rel like '%.java'),
g as (select rel, unnest(regexp_extract_all(content, '(?m)^import "([^"\\n]+)"', 1)) target from f where rel like '%.go')
select rel, 'java://' || target as target, count(*) n from j group by all union all select rel, 'go://' || replace(target, '/', '.'), count(*) from g group by all""", graph=False)  # fmt: skip
def extracted_imports(spark: SparkSession, d: str) -> DataFrame:
    e = _extracted(spark, d).filter("kind = 'e' and type = 'IMPORTS' and language in ('go', 'java')")
    return e.groupBy("rel", "target").agg(F.count("*").alias("n"))


@query("select source, target, count(*) n from e where type = 'IMPORTS' group by all order by n desc, source, target limit 50")
def top_imports(spark: SparkSession, d: str) -> DataFrame:
    e = lookup.edges_by_type(from_tables(spark, d), "IMPORTS")
    return e.groupBy("source", "target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "target").limit(50)
