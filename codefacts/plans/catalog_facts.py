"""Queries over the facts of the derived code corpus, its symbols, graph and endpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codefacts.operators import cxx
from codefacts.operators import endpoints as ep
from codefacts.operators import facts as fx
from codefacts.operators import graph as gr
from codefacts.operators import nameindex as nx
from codefacts.operators import symbols as sy
from codefacts.plans import adapters as ad
from codefacts.plans.registry import query
from codefacts.profile import Profile
from codefacts.session import materialize

#: the corpus in SQL: one row per supplier / customer / part with everything the oracles need
CORPUS = """
with n as (select n_nationkey, lower(replace(n_name, ' ', '_')) as repo from nation),
s as (select repo, s_suppkey as k, s_name as name, s_nationkey as nk, s_acctbal as bal,
  coalesce(lead(s_suppkey) over (partition by repo, s_suppkey // 100 order by s_suppkey), min(s_suppkey) over (partition by repo, s_suppkey // 100)) as nx
  from supplier join n on s_nationkey = n_nationkey),
c as (select repo, c_custkey as k, c_name as name, c_acctbal as bal, c_acctbal <= 9500 as ok, 'core/c' || c_custkey || '.py' as path
  from customer join n on c_nationkey = n_nationkey),
p as (select 'parts' as repo, p_partkey as k, p_name as name, 'lib/' || lower(replace(p_brand, '#', '')) || '/p' || p_partkey || '.h' as path,
  p_partkey + case when p_partkey % 2 = 0 then 1 else -1 end as other, p_size as sz from part)
"""


def facts_of(spark, sf):
    return fx.extract_facts(ad.code_corpus(spark, sf))


@query(
    "python_facts",
    "C1 C2 C3 C11 U5",
    CORPUS + """select repo, 'plugins/s' || k || '/__init__.py' as path, true as ok, 'Component of ' || name || '.' as doc, 15 as loc_total, 11 as loc_code, 3 as n_defs from s
    union all select repo, 'plugins/s' || k || '/routes.py', true, null, 26, 20, 4 from s
    union all select repo, path, ok, null, 15, case when bal < 0 or not ok then 10 else 9 end, case when ok then 2 else 0 end from c
    union all select repo, 'shared/base.py', true, 'Shared helpers.', 18, 11, 4 from n""",
)
def python_facts(spark, sf):
    return facts_of(spark, sf).select(
        "repo", "path", "ok", "doc", F.col("loc_total").cast("int"), F.col("loc_code").cast("int"), F.size("defs").alias("n_defs")
    )


@query(
    "parse_failures",
    "C2",
    CORPUS + "select repo, path, 'SyntaxError: invalid syntax (line 4)' as error from c where not ok",
)
def parse_failures(spark, sf):
    return fx.failures(facts_of(spark, sf))


_FUNCTIONS = """
fun as (select repo, 'plugins/s' || k || '/routes.py' as path, 'view_' || k as name, 'def view_' || k || '(req)' as signature, 'View of ' || name || '.' as docstring, 7 as lineno, 12 as endline from s
  union all select repo, 'plugins/s' || k || '/routes.py', 'register', 'def register(app2)', null, 15, 18 from s
  union all select repo, 'plugins/s' || k || '/routes.py', 'save_' || k, 'def save_' || k || '(req)', null, 22, 26 from s
  union all select repo, path, 'load_' || k, 'def load_' || k || '(x, y=2)', 'Load ' || name || '.', 9, 11 from c where ok
  union all select repo, path, 'run_' || k, 'def run_' || k || '()', null, 14, 15 from c where ok
  union all select repo, 'shared/base.py', 'pooled', 'def pooled(x)', null, 13, 14 from n
  union all select repo, 'shared/base.py', 'helper', 'def helper(x)', null, 17, 18 from n),
cls as (select repo, 'plugins/s' || k || '/__init__.py' as path, 'S' || k as name, 'BasePlugin' as bases, 'Acts for ' || name || '.' as docstring, true as inherits_base, 7 as lineno from s
  union all select repo, 'shared/base.py', 'BasePlugin', 'ABC', 'Base of all components.', false, 5 from n),
meth as (select repo, 'plugins/s' || k || '/__init__.py' as path, 'S' || k as class_name, 'run' as name, 'run(self, n: int=1, *rest)' as signature, 'Run it.' as docstring, false as abstract, 10 as lineno, 12 as endline from s
  union all select repo, 'plugins/s' || k || '/__init__.py', 'S' || k, '_hidden', '_hidden(self)', null, false, 14, 15 from s
  union all select repo, 'shared/base.py', 'BasePlugin', 'run', 'run(self, n)', 'Do the work.', true, 9, 10 from n),
rt as (select repo, 'plugins/s' || k || '/routes.py' as path, 'bp' as bp, 'route' as via, '''/n' || nk || '''' as rule, '/n' || nk as rule_value,
    'GET,POST' as methods, 'view_' || k as endpoint, 7 as lineno, 'View of ' || name || '.' as purpose,
    case when bal < 0 then '/open/s' else '/admin/s' end || k as prefix, k from s
  union all select repo, 'plugins/s' || k || '/routes.py', 'bp', 'shorthand', '''/p' || k || '''', '/p' || k, 'POST', 'save_' || k, 22, null,
    case when bal < 0 then '/open/s' else '/admin/s' end || k, k from s)
"""
DEFS = CORPUS + "," + _FUNCTIONS


@query("function_facts", "C4", DEFS + "select repo, path, name, signature, docstring, true as public, lineno from fun")
def function_facts(spark, sf):
    return fx.functions(facts_of(spark, sf)).drop("decorators")


@query("class_facts", "C4", DEFS + "select * from cls")
def class_facts(spark, sf):
    return fx.classes(facts_of(spark, sf)).withColumn("bases", F.array_join("bases", ","))


@query("method_facts", "C4", DEFS + "select repo, path, class_name, name, signature, docstring, abstract, lineno from meth")
def method_facts(spark, sf):
    return fx.methods(facts_of(spark, sf)).drop("decorators", "seq", "class_line")


@query(
    "function_spans",
    "C10 R15 R21",
    DEFS + """select repo, path, name, lineno, endline as end_lineno from fun union all select repo, path, name, lineno, endline from meth
    union all select repo, 'plugins/s' || k || '/routes.py', 'lost', 17, 18 from s""",
)
def function_spans(spark, sf):
    return fx.function_spans(facts_of(spark, sf))


IMPORTS = """
imp as (select repo, 'plugins/s' || k || '/__init__.py' as path, unnest(['shared.base', 'plugins.s' || nx, 'os.path']) as module from s
  union all select repo, 'plugins/s' || k || '/routes.py', 'flask' from s
  union all select repo, path, unnest(['os', 'json', 'shared.base'] || case when bal < 0 then ['plugins.s1'] else [] end) from c where ok
  union all select repo, 'shared/base.py', 'abc' from n)
"""


@query("import_modules", "C6", CORPUS + "," + IMPORTS + "select * from imp")
def import_modules(spark, sf):
    return fx.imports(facts_of(spark, sf))


@query(
    "import_statements",
    "C6 F3",
    CORPUS + """select repo, path, f.kind as kind, f.module as module, f.level as level, f.name as name, f.alias as alias from (
      select repo, 'plugins/s' || k || '/__init__.py' as path, unnest([
        {kind: 'from', module: 'shared.base', level: 0, name: 'BasePlugin', alias: null}, {kind: 'from', module: 'shared.base', level: 0, name: 'helper', alias: 'h'},
        {kind: 'from', module: 'plugins.s' || nx, level: 0, name: 'S' || nx, alias: null}, {kind: 'import', module: 'os.path', level: 0, name: null, alias: null}]) as f from s
      union all select repo, 'plugins/s' || k || '/routes.py', unnest([{kind: 'from', module: 'flask', level: 0, name: 'Blueprint', alias: null},
        {kind: 'from', module: null, level: 1, name: 'S' || k, alias: null}]) from s
      union all select repo, path, unnest([{kind: 'import', module: 'os', level: 0, name: null, alias: null}, {kind: 'import', module: 'json', level: 0, name: null, alias: 'js'},
        {kind: 'from', module: 'shared.base', level: 0, name: 'pooled', alias: 'p'}]) from c where ok
      union all select repo, path, {kind: 'from', module: 'plugins.s1', level: 0, name: 'S1', alias: null} from c where ok and bal < 0
      union all select repo, 'shared/base.py', unnest([{kind: 'from', module: 'abc', level: 0, name: 'ABC', alias: null}, {kind: 'from', module: 'abc', level: 0, name: 'abstractmethod', alias: null}]) from n)""",
)
def import_statements(spark, sf):
    return fx.import_facts(facts_of(spark, sf))


_CALLS = """
cl as (select repo, path, x.c as caller, x.t as target from (
  select repo, 'plugins/s' || k || '/__init__.py' as path, unnest([{c: 'S' || k || '.run', t: 'h'}, {c: 'S' || k || '._hidden', t: 'os.path.join'}, {c: 'S' || k || '._hidden', t: 'S' || nx}]) as x from s
  union all select repo, 'plugins/s' || k || '/routes.py', unnest([{c: '@module', t: 'Blueprint'}, {c: 'view_' || k, t: 'eval'}, {c: 'view_' || k, t: 'bp.route'},
    {c: 'register.lost', t: 'app2.get'}, {c: 'save_' || k, t: 'subprocess.run'}, {c: 'save_' || k, t: 'bp.post'}]) from s
  union all select repo, path, unnest([{c: 'load_' || k, t: 'p'}, {c: 'run_' || k, t: 'load_' || k}, {c: 'run_' || k, t: 'js.dumps'}]) from c where ok
  union all select repo, 'shared/base.py', {c: 'pooled', t: 'helper'} from n))
"""


@query("call_sites", "C7", CORPUS + "," + _CALLS + "select * from cl")
def call_sites(spark, sf):
    return fx.calls(facts_of(spark, sf))


@query(
    "single_name_calls",
    "C8",
    CORPUS + """select repo, path, x.f as f, x.a as a from (
    select repo, 'plugins/s' || k || '/__init__.py' as path, unnest([{f: 'h', a: 'n'}, {f: 'S' || nx, a: 'self'}]) as x from s
    union all select repo, 'plugins/s' || k || '/routes.py', {f: 'eval', a: 'req'} from s
    union all select repo, path, unnest([{f: 'p', a: 'x'}, {f: 'js.dumps', a: 'x'}]) from c where ok
    union all select repo, 'shared/base.py', {f: 'helper', a: 'x'} from n)""",
)
def single_name_calls(spark, sf):
    return fx.single_name_calls(facts_of(spark, sf))


@query(
    "risky_calls",
    "C10 R8 R9",
    CORPUS + """select repo, 'plugins/s' || k || '/routes.py' as path, 'eval' as name, 10 as lineno, null as shell from s
    union all select repo, 'plugins/s' || k || '/routes.py', 'subprocess.run', 24, 'True' from s""",
)
def risky_calls(spark, sf):
    rows = fx.rule_calls(facts_of(spark, sf)).where("name in ('eval', 'exec') or startswith(name, 'subprocess.')")
    return rows.select("repo", "path", "name", "lineno", F.try_element_at("kwargs", F.lit("shell")).alias("shell"))


@query("route_facts", "C5 B16", DEFS + "select repo, path, bp, via, rule, rule_value, methods, endpoint, lineno, purpose from rt")
def route_facts(spark, sf):
    rows = fx.routes(facts_of(spark, sf)).withColumn("methods", F.array_join("methods", ","))
    return rows.select("repo", "path", "bp", "via", "rule", "rule_value", "methods", "endpoint", "lineno", "purpose")


@query(
    "blueprint_facts",
    "C5 B16",
    CORPUS + """select repo, 'plugins/s' || k || '/routes.py' as path, 'bp' as var, 's' || k as name,
    case when bal < 0 then '/open/s' else '/admin/s' end || k as prefix, true as prefix_literal from s""",
)
def blueprint_facts(spark, sf):
    return fx.blueprints(facts_of(spark, sf)).select("repo", "path", "var", "name", "prefix", "prefix_literal")


@query(
    "c_file_facts",
    "C9 C11",
    CORPUS + "select repo, path, 13 as loc_total, 9 as loc_code, 1 as defines, 'Part ' || k as docstring from p",
)
def c_file_facts(spark, sf):
    return cxx.file_facts(ad.code_corpus(spark, sf))


@query(
    "c_includes",
    "C9",
    CORPUS + """select repo, path, 0 as seq, 'p' || other || '.h' as target, false as system from p
    union all select repo, path, 1, 'vector', true from p""",
)
def c_includes(spark, sf):
    return cxx.includes(ad.code_corpus(spark, sf))


@query(
    "c_symbols",
    "C9 F8",
    CORPUS + """select repo, path, 'P' || k as name, 'struct' as kind, 6 as lineno from p
    union all select repo, path, 'size_of_p' || k, 'function', 10 from p
    union all select repo, path, 'P' || k || '.size_of_p' || k, 'method', 7 from p""",
)
def c_symbols(spark, sf):
    facts = materialize(cxx.extract(ad.code_corpus(spark, sf)))
    members = cxx.methods(facts).withColumn("name", F.concat_ws(".", "class_name", "name"))
    rows = cxx.classes(facts).select("repo", "path", "name", "kind", "lineno")
    for df, kind in ((cxx.functions(facts), "function"), (members, "method")):
        rows = rows.unionByName(df.select("repo", "path", "name", F.lit(kind).alias("kind"), "lineno"))
    return rows


# ------------------------------------------------------------------ symbols
_SYMBOLS = DEFS + """, sym as (
  select repo, name, 'class' as kind, path as file, lineno as line from cls
  union all select repo, name, 'function', path, lineno from fun
  union all select repo, rule_value, 'route', path, lineno from rt),
so as (select *, case when file like 'plugins/%' then split_part(file, '/', 2) else split_part(file, '/', 1) end as owner from sym)
"""


def symbols_of(spark, sf):
    return symbols_in(materialize(facts_of(spark, sf)))


def symbols_in(facts):
    return sy.symbol_table(fx.classes(facts), fx.functions(facts), fx.routes(facts))


@query("symbol_index", "D23 A21 B9 B15 H1", _SYMBOLS + "select * from so")
def symbol_index(spark, sf):
    return symbols_of(spark, sf)


@query(
    "symbol_postings",
    "D23 M7",
    _SYMBOLS + "select repo, name, file, line, kind, owner from so",
)
def symbol_postings(spark, sf):
    return sy.postings(symbols_of(spark, sf))


_SEARCH = """, h as (select *, name = '{q}' as exact from so where contains(lower(name), lower('{q}'))),
w as (select * from h where exact = (select bool_or(exact) from h))
select repo, name as symbol, file, line, kind, owner, case when exact then 'exact' else 'substring' end as match,
  (select count(*) from w) as total, (select count(*) from w) > {n} as truncated from w order by file, line, kind, name, repo limit {n}
"""


@query("symbol_search_exact", "B8 G8", _SYMBOLS + _SEARCH.format(q="register", n=500))
def symbol_search_exact(spark, sf):
    return sy.search(symbols_of(spark, sf), "register", 500)


@query("symbol_search_substring", "B8 G8", _SYMBOLS + _SEARCH.format(q="VIEW_", n=50))
def symbol_search_substring(spark, sf):
    """Through the index of triples: rows of ``vie``, ``iew`` and ``ew_`` are read, not all names."""
    root = _name_index(spark, sf)
    return nx.search_index(spark, root, "VIEW_")


def _name_index(spark, sf):
    from codefacts.streaming.jobs import scratch

    root = scratch(spark, "names")
    nx.write_index(symbols_of(spark, sf), root)
    return root


@query("symbol_search_exact_indexed", "B8 G8 A21", _SYMBOLS + _SEARCH.format(q="helper", n=30))
def symbol_search_exact_indexed(spark, sf):
    return nx.search_index(spark, _name_index(spark, sf), "helper", 30)


@query("names_with_triples", "B8", _SYMBOLS + "select distinct name from so where contains(lower(name), 'ave_1')")
def names_with_triples(spark, sf):
    return nx.matching_names(spark, _name_index(spark, sf), "ave_1")


# ------------------------------------------------------------------ graph
_GRAPH = CORPUS + """, se as (
  select repo, 'plugins/s' || k || '/__init__.py' as src_path, 'S' || k || '._hidden' as caller, 'plugins/s' || nx || '/__init__.py' as dst_path, 'S' || nx as callee from s
  union all select repo, path, 'run_' || k, path, 'load_' || k from c where ok
  union all select repo, 'shared/base.py', 'pooled', 'shared/base.py', 'helper' from n),
edge as (select repo, src_path || '::' || caller as src, dst_path || '::' || callee as dst, src_path, dst_path, 1::bigint as weight from se),
inc as (select repo, a.path, 'p' || a.other || '.h' as target, b.path as dst_path from p a left join p b using (repo) where b.k = a.other
  union all select repo, path, 'p' || other || '.h', null from p where other not in (select k from p)),
fe as (select repo, 'call' as kind, src_path as src, dst_path as dst, weight from edge where src_path <> dst_path
  union all select repo, 'include', path, dst_path, 1 from inc where dst_path is not null),
oe as (select repo, a as src, b as dst, sum(weight)::bigint as weight from (select *,
  case when src like 'plugins/%' then split_part(src, '/', 2) else split_part(src, '/', 1) end as a,
  case when dst like 'plugins/%' then split_part(dst, '/', 2) else split_part(dst, '/', 1) end as b from fe) where a <> b group by all)
"""


def _graph(spark, sf):
    facts = materialize(facts_of(spark, sf))
    defs = gr.definitions(fx.classes(facts), fx.methods(facts), fx.functions(facts))
    resolved = gr.resolve_calls(fx.calls(facts), fx.import_facts(facts), defs, facts.select("repo", "path"))
    return gr.symbol_edges(resolved), defs, facts


def _include_rows(spark, sf):
    files = ad.code_corpus(spark, sf)
    return gr.resolve_includes(cxx.includes(files), cxx.sources(files).select("repo", "path"))


def _file_edges(spark, sf):
    return gr.file_edges(_graph(spark, sf)[0], _include_rows(spark, sf))


@query("call_graph", "E2 E3 D21", _GRAPH + "select * from edge")
def call_graph(spark, sf):
    return _graph(spark, sf)[0]


@query("heaviest_call_edges", "G2", _GRAPH + """select repo, src, dst, weight, rank from (select *, row_number() over
  (partition by repo order by weight desc, src, dst) as rank from edge)""")
def heaviest_call_edges(spark, sf):
    return gr.heaviest_edges(_graph(spark, sf)[0]).select("repo", "src", "dst", "weight", "rank")


@query(
    "call_graph_nodes",
    "D21",
    _GRAPH + """, ends as (select repo, src as id, src_path as file from edge union all select repo, dst, dst_path from edge)
    select repo, id, file, substr(id, length(file) + 3) as symbol,
      case when file like 'plugins/%' then split_part(file, '/', 2) else split_part(file, '/', 1) end as owner,
      case when id like '%.\\_hidden' escape '\\' then 'method' when file like 'plugins/%' then 'class' else 'function' end as kind,
      count(*)::bigint as uses from ends group by all""",
)
def call_graph_nodes(spark, sf):
    edges, defs, _ = _graph(spark, sf)
    return gr.node_table(edges, defs)


@query("include_resolution", "E4", _GRAPH + "select * from inc")
def include_resolution(spark, sf):
    return _include_rows(spark, sf)


@query("file_graph", "D21", _GRAPH + "select * from fe")
def file_graph(spark, sf):
    return _file_edges(spark, sf)


@query("owner_graph", "I5 D21 H7", _GRAPH + "select * from oe")
def owner_graph(spark, sf):
    return gr.owner_edges(_file_edges(spark, sf))


@query(
    "file_degrees",
    "I3 D21",
    _GRAPH + """select repo, node, sum(i)::bigint as in_deg, sum(o)::bigint as out_deg, sum(i)::bigint as in_w, sum(o)::bigint as out_w from (
    select repo, src as node, 0 as i, 1 as o from fe union all select repo, dst, 1, 0 from fe) group by all""",
)
def file_degrees(spark, sf):
    return gr.degrees(_file_edges(spark, sf))


@query(
    "graph_stats",
    "D22",
    _GRAPH + """, fl as (select repo, 'i' || k from s union all select repo, 'r' || k from s union all select repo, path from c union all select repo, 'b' from n)
    select f.repo, f.files, coalesce(e.x, 0) as edges_total, coalesce(g.x, 0) as file_edges, coalesce(o.x, 0) as owner_edges
    from (select repo, count(*) as files from fl group by repo) f
    left join (select repo, count(*) as x from edge group by repo) e using (repo)
    left join (select repo, count(*) as x from fe group by repo) g using (repo)
    left join (select repo, count(*) as x from oe group by repo) o using (repo)""",
)
def graph_stats(spark, sf):
    edges, _, facts = _graph(spark, sf)
    files = gr.file_edges(edges)
    return gr.graph_stats(facts.select("repo", "path"), edges, files, gr.owner_edges(files))


@query(
    "component_ring_cycles",
    "I1 G7 R36",
    _GRAPH + """, ring as (select repo, min(k) as lo, list('plugins/s' || k || '/__init__.py' order by 'plugins/s' || k || '/__init__.py') as names, count(*) as length
      from s group by repo, k // 100),
    walk as (with recursive w as (select s.repo, k as start, k, 0 as hop, 'plugins/s' || k || '/__init__.py' as chain, nx from s
        where ('plugins/s' || k || '/__init__.py') in (select names[1] from ring where ring.repo = s.repo)
      union all select w.repo, start, w.nx, hop + 1, chain || ' -> plugins/s' || w.nx || '/__init__.py', s.nx from w join s on s.repo = w.repo and s.k = w.nx where w.nx <> start)
      select repo, start, max(hop) + 1 as length, max_by(chain, hop) as chain from w group by repo, start)
    select repo, length, chain || ' -> plugins/s' || start || '/__init__.py' as chain from walk where length > 1""",
)
def component_ring_cycles(spark, sf):
    return gr.cycles(gr.file_edges(_graph(spark, sf)[0])).select("repo", F.col("length").cast("long").alias("length"), "chain")


@query(
    "include_cycles",
    "I2 R37",
    _GRAPH + """select repo, 2 as length, least(path, dst_path) || ' -> ' || greatest(path, dst_path) || ' -> ' || least(path, dst_path) as chain
    from inc where dst_path is not null and path < dst_path""",
)
def include_cycles(spark, sf):
    return gr.cycles(gr.file_edges(_graph(spark, sf)[0], _include_rows(spark, sf)).where("kind = 'include'"), self_loops=False).drop("cycle")


def _event_graph(spark, sf):
    """Which kind of event follows which, in buckets of users: a small graph out of the whole event log."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = ad.table(spark, sf, "events").withColumn("after", F.lead("event_type").over(w)).where("after is not null")
    repo = F.concat(F.lit("u"), F.floor(F.col("user_id") / 50).cast("string"))
    return ev.groupBy(repo.alias("repo"), F.col("event_type").alias("src"), F.col("after").alias("dst")).agg(F.count("*").alias("weight"))


_EVENT_GRAPH = """
with recursive eg as (select repo, src, dst, count(*) as weight from (select 'u' || (user_id // 50) as repo, event_type as src,
  lead(event_type) over (partition by user_id order by ts, event_id) as dst from events) where dst is not null group by all)
"""


_EVENT_COMPONENTS = _EVENT_GRAPH + """, reach as (select repo, src, dst from eg union select r.repo, r.src, eg.dst from reach r join eg on eg.repo = r.repo and eg.src = r.dst),
    own as (select a.repo, a.src as node, min(least(a.src, a.dst)) as component from reach a join reach b on a.repo = b.repo and a.src = b.dst and a.dst = b.src
      group by all having max(a.src <> a.dst))
"""


@query("event_components", "I1", _EVENT_COMPONENTS + "select * from own")
def event_components(spark, sf):
    """Kinds of events that lead to one another again."""
    return gr.strong_components(_event_graph(spark, sf))


@query(
    "event_succession_cycles",
    "I1 G7",
    _EVENT_GRAPH + """, walk as (select repo, src as start, dst as node, [src, dst] as path from eg where dst > src
      union all select w.repo, start, dst, list_append(path, dst) from walk w join eg on eg.repo = w.repo and eg.src = w.node
      where dst > start and not list_contains(path, dst)),
    closed as (select w.repo, start, node, path, row_number() over (partition by w.repo, start, node order by len(path), path) as r
      from walk w join eg on eg.repo = w.repo and eg.src = w.node and eg.dst = w.start)
    select repo, len(path) as length, array_to_string(list_append(path, path[1]), ' -> ') as chain from closed where r = 1
    union all select repo, 1, src || ' -> ' || src from eg where src = dst""",
)
def event_succession_cycles(spark, sf):
    return gr.closing_cycles(_event_graph(spark, sf)).select("repo", F.col("length").cast("long").alias("length"), "chain")


@query(
    "core_subgraph",
    "E25",
    _EVENT_GRAPH + """, d as (select repo, node, count(*) as deg from (select repo, src as node from eg union all select repo, dst from eg) group by all),
    k as (select repo, node from (select *, row_number() over (partition by repo order by deg desc, node) as r from d) where r <= 3)
    select eg.* from eg where (repo, src) in (select repo, node from k) and (repo, dst) in (select repo, node from k)""",
)
def core_subgraph(spark, sf):
    return gr.core_subgraph(_event_graph(spark, sf), k=3)


@query(
    "ego_network",
    "E25 E11",
    _EVENT_GRAPH + "select *, case when src = 'error' then 'out' else 'in' end as direction from eg where src = 'error' or dst = 'error'",
)
def ego_network(spark, sf):
    return gr.ego_network(_event_graph(spark, sf), "error")


@query(
    "reachable_components",
    "I4",
    CORPUS + """, walk as (with recursive w as (select repo, 's' || k as start, k as node, 0 as hops from s
      union all select w.repo, start, s.nx, hops + 1 from w join s on s.repo = w.repo and s.k = w.node where hops < 3)
      select repo, start, 's' || node as node, min(hops) as hops from w group by all)
    select * from walk""",
)
def reachable_components(spark, sf):
    edges = _supplier_edges(spark, sf)
    starts = edges.select("repo", F.col("src").alias("start"), F.col("src").alias("node"))
    return gr.reachable(starts, edges, max_hops=3)


def _supplier_edges(spark, sf):
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return ad.suppliers(spark, sf).select("repo", name("s_suppkey").alias("src"), name("next_key").alias("dst"))


@query(
    "spread_from_first",
    "I4",
    CORPUS + """, first as (select repo, min('s' || k) as node from s group by repo),
    walk as (with recursive w as (select repo, node, 0::bigint as hops from first
      union all select w.repo, 's' || s.nx, hops + 1 from w join s on s.repo = w.repo and 's' || s.k = w.node where hops < 200)
      select repo, node, min(hops) as hops from w group by all)
    select * from walk""",
)
def spread_from_first(spark, sf):
    """What the first component of every repository leads to, however far: one row for each component, not for each pair."""
    edges = _supplier_edges(spark, sf)
    starts = edges.groupBy("repo").agg(F.min("src").alias("node"))
    return gr.spread(starts, edges)


# ------------------------------------------------------------------ endpoints
def endpoints_of(facts, profile=Profile()):
    return ep.resolve_endpoints(
        fx.routes(facts), fx.blueprints(facts), fx.single_name_calls(facts), fx.import_facts(facts), facts.select("repo", "path"), profile
    )


@query(
    "endpoint_paths",
    "E5 E6 E7 E8 F2",
    DEFS + "select repo, path, endpoint, prefix, prefix || rule_value as endpoint_path, 's' || k as bp_name, 'blueprint' as resolution from rt",
)
def endpoint_paths(spark, sf):
    rows = endpoints_of(materialize(facts_of(spark, sf)))
    return rows.select("repo", "path", "endpoint", "prefix", "endpoint_path", "bp_name", "resolution")


@query("endpoint_resolutions", "E8", DEFS + "select repo, 'blueprint' as resolution, count(*) as routes from rt group by repo")
def endpoint_resolutions(spark, sf):
    return ep.resolution_stats(endpoints_of(materialize(facts_of(spark, sf))))


@query("route_prefixes", "D29", DEFS + "select repo, prefix, count(*) as routes from rt group by all")
def route_prefixes(spark, sf):
    return ep.prefix_distribution(fx.routes(materialize(facts_of(spark, sf))))
