"""Queries over components, modules, the restricted query and snapshot differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import diff as df_
from codefacts.operators import query as rq
from codefacts.operators import structure as st
from codefacts.plans import adapters as ad
from codefacts.plans.analysis import load_corpus
from codefacts.plans.catalog_facts import CORPUS, DEFS, IMPORTS
from codefacts.plans.registry import query
from codefacts.profile import Profile
from codefacts.session import materialize
from codefacts.sources import manifests as mf

_COMP = """, co as (select repo, 's' || k as dir, 's' || k as identifier, name, case when bal < 0 then '1.0' else '1.0.0' end as version,
  case when bal > 9000 then 'chief' else 'business' end as agent_role, case when bal > 5000 then 'sell' else '' end as capabilities,
  's' || nx as depends_on, case when bal <= 5000 then 'missing field: capabilities;' else '' end || case when bal < 0 then 'version is not X.Y.Z: 1.0;' else '' end as errs,
  2 as py_files, 41 as loc, 31 as loc_code, 1 as base_classes, 2 as route_count, k, bal from s)
"""


def _corpus(spark, sf):
    return load_corpus(ad.stored_corpus(spark, sf))


def _components(c):
    return st.components(c.files, c.tables, c.profile)


def _modules(c):
    return st.modules(c.files, c.tables, c.profile)


@query(
    "component_manifests",
    "A5 A6 E21 V2 R34",
    CORPUS + _COMP + "select repo, dir, identifier, name, version, agent_role, capabilities, depends_on, errs as errors, errs = '' as manifest_valid from co",
)
def component_manifests(spark, sf):
    files = ad.code_corpus(spark, sf)
    rows = mf.manifest_columns(mf.read_manifests(files), mf.read_manifest_contract(files))
    errors = F.array_join(F.transform("manifest_errors", lambda e: F.concat(e, F.lit(";"))), "")
    return rows.select(
        "repo", "dir", "identifier", "name", "version", "agent_role", F.array_join("capabilities", ",").alias("capabilities"),
        F.array_join(F.map_keys("depends_on"), ",").alias("depends_on"), errors.alias("errors"), "manifest_valid",
    )


@query("component_dirs", "D12", CORPUS + "select repo, 's' || k as dir, true as valid, '' as reasons from s")
def component_dirs(spark, sf):
    return st.component_dirs(ad.code_corpus(spark, sf)).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "components",
    "D11 M5",
    CORPUS + _COMP + """select repo, dir, identifier, version, manifest_valid, py_files, loc, loc_code, base_classes, route_count, docs,
    'Component of ' || name || '.' as entry_docstring from (select *, errs = '' as manifest_valid, 'README.md' as docs from co)""",
)
def components(spark, sf):
    return _components(_corpus(spark, sf)).select(
        "repo", "dir", "identifier", "version", "manifest_valid", "py_files", "loc", "loc_code", "base_classes", "route_count",
        F.array_join("docs", ",").alias("docs"), "entry_docstring",
    )


@query(
    "core_modules",
    "D7 D8 M6",
    CORPUS + """, roots as (select repo, 'core' as name, unnest([{r: 'os', n: 1}, {r: 'json', n: 1}, {r: 'shared', n: 1}]) as x from c where ok
      union all select repo, 'core', {r: 'plugins', n: 1} from c where ok and bal < 0 union all select repo, 'shared', {r: 'abc', n: 1} from n
      union all select repo, 'lib', {r: 'p' || other, n: 1} from p),
    rc as (select repo, name, x.r as r, count(*) as n from roots group by all),
    ri as (select repo, name, count(*) as roots_listed from rc group by all),
    m as (select repo, 'core' as name, count(*) as py_files, sum(15) as loc, sum(case when bal < 0 or not ok then 10 else 9 end) as loc_code, 0 as class_total,
        count(*) filter (ok) * 2 as function_total, null as package_docstring from c group by repo
      union all select repo, 'shared', 1, 18, 11, 1, 2, null from n
      union all select repo, 'lib', count(*), count(*) * 13, count(*) * 9, count(*), count(*), null from p group by repo)
    select m.repo, m.name, py_files, loc::bigint as loc, loc_code::bigint as loc_code, class_total, function_total, roots_listed from m left join ri using (repo, name)""",
)
def core_modules(spark, sf):
    c = _corpus(spark, sf)
    roots = st.module_children(c.tables)["import_roots"].groupBy("repo", "name").agg(F.count("*").alias("roots_listed"))
    rows = _modules(c).join(roots, ["repo", "name"], "left")
    return rows.select("repo", "name", "py_files", "loc", "loc_code", "class_total", "function_total", "roots_listed")


@query(
    "core_module_functions",
    "D7 G4",
    DEFS + """, every as (select repo, path, name, signature, docstring, lineno from fun
      union all select repo, path, 'size_of_p' || k, 'int size_of_p' || k || '(int a,' || chr(10) || '  int b)', null, 10 from p)
    select repo, split_part(path, '/', 1) as name, row_number() over (partition by repo, split_part(path, '/', 1) order by docstring is null, lower(name), path, lineno) as rank,
      name as symbol, signature, path, lineno from every""",
)
def core_module_functions(spark, sf):
    return st.module_children(_corpus(spark, sf).tables)["functions"].select("repo", "name", "rank", "symbol", "signature", "path", "lineno")


@query(
    "core_module_classes",
    "D7 G3",
    DEFS + """, every as (select repo, path, name, docstring, inherits_base, lineno from cls union all select repo, path, 'P' || k, null, false, 6 from p)
    select repo, split_part(path, '/', 1) as name, row_number() over (partition by repo, split_part(path, '/', 1)
      order by inherits_base desc, docstring is null, starts_with(name, '_'), lower(name), path, lineno) as rank, name as symbol, path from every""",
)
def core_module_classes(spark, sf):
    return st.module_children(_corpus(spark, sf).tables)["classes"].select("repo", "name", "rank", "symbol", "path")


@query(
    "core_module_import_roots",
    "D7",
    CORPUS + "," + IMPORTS + """, every as (select repo, split_part(path, '/', 1) as name, split_part(module, '.', 1) as root from imp
      union all select repo, 'lib', 'p' || other from p)
    select repo, name, root, count(*) as imports from every group by all""",
)
def core_module_import_roots(spark, sf):
    return st.module_children(_corpus(spark, sf).tables)["import_roots"]


@query(
    "module_descriptions",
    "E23 D8 M6",
    CORPUS + """select repo, 'core' as name, 'Customers' as description, true as known from c group by repo union all select repo, 'shared', '(source module)', false from n
    union all select repo, 'lib', '(source module)', false from p group by repo""",
)
def module_descriptions(spark, sf):
    """A profile that knows ``core``, and a folder that no repository has; all others are found by their files."""
    c = load_corpus(ad.stored_corpus(spark, sf), Profile(core_modules={"core": "Customers", "gone": "Nowhere"}))
    return st.modules(c.files, c.tables, c.profile).select("repo", "name", "description", "known")


@query(
    "module_methods",
    "D7 C4 C9",
    DEFS + "select repo, split_part(path, '/', 1) as name, class_name, name as symbol, abstract, path from meth union all select repo, 'lib', 'P' || k, 'size_of_p' || k, false, path from p",
)
def module_methods(spark, sf):
    rows = st.module_children(_corpus(spark, sf).tables)["methods"]
    return rows.select("repo", "name", "class_name", "symbol", "abstract", "path")


@query(
    "module_routes",
    "D7 C5",
    CORPUS + """select repo, 'plugins' as name, 'plugins/s' || k || '/routes.py' as path, unnest(['''/n' || nk || '''', '''/p' || k || '''']) as rule from s""",
)
def module_routes(spark, sf):
    """Routes and blueprints of every top folder; the components' folder is one of them here."""
    return st.module_children(_corpus(spark, sf).tables)["routes"].select("repo", "name", "path", "rule")


@query("component_blueprints", "D11", CORPUS + "select repo, 's' || k as dir, 'plugins/s' || k || '/routes.py' as path, 'bp' as var, 's' || k as name from s")
def component_blueprints(spark, sf):
    c = _corpus(spark, sf)
    return st.component_children(c.tables, c.profile)["blueprints"].select("repo", "dir", "path", "var", "name")


@query("component_classes", "D11 C4", CORPUS + "select repo, 's' || k as dir, 'plugins/s' || k || '/__init__.py' as path, 'S' || k as name, true as inherits_base from s")
def component_classes(spark, sf):
    c = _corpus(spark, sf)
    return st.component_children(c.tables, c.profile)["classes"].select("repo", "dir", "path", "name", "inherits_base")


_CI = CORPUS + "," + IMPORTS + """, ci as (select *, split_part(path, '/', 2) as dir, split_part(module, '.', 1) as root,
  regexp_extract(module, '^plugins\\.([a-z0-9_]+)', 1) as target from imp where path like 'plugins/%/%')
"""


def _component_imports(c):
    return st.component_imports(c.tables.imports, c.profile)


@query("component_core_usage", "D14", _CI + "select repo, root as module, count(*) as imports, row_number() over (partition by repo order by count(*) desc, root) as rank from ci where root in ('plugin_manager', 'shared', 'i18n') group by repo, root")
def component_core_usage(spark, sf):
    return st.core_usage(_component_imports(_corpus(spark, sf)))


@query("component_base_ratio", "D14", CORPUS + "select repo, count(*) as with_base_class, count(*) as components from s group by repo")
def component_base_ratio(spark, sf):
    return st.base_class_ratio(_components(_corpus(spark, sf)))


@query(
    "component_edges",
    "E9 H2",
    CORPUS + "select distinct repo, 's' || k as src, 's' || nx as dst from s",
)
def component_edges(spark, sf):
    c = _corpus(spark, sf)
    return st.component_edges(st.component_index(c.files, c.profile), _component_imports(c))


@query(
    "boundary_violations",
    "E10 R10 R35",
    CORPUS + "select c.repo, 'core' as module, path as file, 'plugins.s1' as imports from c where ok and bal < 0 and repo in (select repo from s where k = 1)",
)
def boundary_violations(spark, sf):
    c = _corpus(spark, sf)
    return st.boundary_violations(c.tables.imports, st.component_index(c.files, c.profile), st.module_dirs(c.files, c.profile), c.profile)


@query("component_dependents", "E11", CORPUS + "select repo, 's' || k as dependent from s where nx = 1")
def component_dependents(spark, sf):
    c = _corpus(spark, sf)
    return st.dependents(st.component_edges(st.component_index(c.files, c.profile), _component_imports(c)), "s1")


@query("target_by_name", "B12", CORPUS + "select distinct repo, 'module' as kind, 'core' as name from c")
def target_by_name(spark, sf):
    c = _corpus(spark, sf)
    return st.resolve_target(st.component_index(c.files, c.profile), st.module_dirs(c.files, c.profile), "core")


@query(
    "target_context_routes",
    "B13",
    DEFS + "select repo, path, endpoint, lineno from rt where k = 1",
)
def target_context_routes(spark, sf):
    rows = st.context_slice(_corpus(spark, sf).tables, "plugin", "s1")["routes"]
    return rows.select("repo", "path", "endpoint", "lineno")


@query(
    "target_context_functions",
    "B13 D36",
    DEFS + """select repo, path, name, lineno from (select *, row_number() over (partition by repo order by path, lineno) as r from fun where path like 'core/%')""",
)
def target_context_functions(spark, sf):
    rows = st.context_slice(_corpus(spark, sf).tables, "module", "core")["functions"]
    return rows.select("repo", "path", "name", "lineno")


@query(
    "deep_dive_totals",
    "D36",
    CORPUS + """select repo, count(*) as files, (count(*) * 15)::bigint as loc_total, sum(case when bal < 0 or not ok then 10 else 9 end)::bigint as loc_code, 0::bigint as classes,
    (count(*) filter (ok) * 2)::bigint as functions, 0::bigint as routes from c group by repo""",
)
def deep_dive_totals(spark, sf):
    return st.target_totals(st.target_files(_corpus(spark, sf).tables, "core/"))


@query(
    "global_context_components",
    "B14",
    CORPUS + _COMP + """select repo, identifier, version, agent_role, loc_code, route_count, errs = '' as manifest_valid, rank from (
    select *, row_number() over (partition by repo order by identifier) as rank from co)""",
)
def global_context_components(spark, sf):
    c = _corpus(spark, sf)
    comps = _components(c)
    docs = c.files.where("path = 'README.md'").select("repo", "path")
    return st.global_context(_modules(c), comps, docs)["components"]


# ------------------------------------------------------------------ restricted query
def _order_docs(spark, sf):
    """Orders with their lines nested: the shape the path language is made for."""
    item = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("qty"), "l_returnflag")
    lines = ad.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    orders = ad.table(spark, sf, "orders")
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    return {
        "orders": rows.select(
            F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("code"), (F.col("o_orderstatus") == "F").alias("final")).alias("status"),
            F.transform("items", lambda x: x["l_returnflag"]).alias("flags"), "items",
        )
    }


_NESTED = """with i as (select l_orderkey, list({ln: l_linenumber, pk: l_partkey, q: l_quantity::bigint, f: l_returnflag} order by l_linenumber, l_partkey, l_quantity, l_returnflag) as items from lineitem group by all),
o as (select o_orderkey as id, o_orderstatus as code, o_orderstatus = 'F' as fin, items, list_transform(items, lambda x: x.f) as flags from orders left join i on l_orderkey = o_orderkey)
"""


@query(
    "nested_query_flags",
    "B1 B2 B3 B4 B5",
    _NESTED + """select id, code as "status.code", array_to_string(list_transform(items, lambda x: x.pk), ',') as "items[].l_partkey", items[1].q as "items[0].qty", items[6].q as "items[5].qty"
    from o where fin and coalesce(list_contains(flags, 'R'), false)""",
)
def nested_query_flags(spark, sf):
    rows = rq.run_query(
        _order_docs(spark, sf), ["orders[].id", "status.code", "items[].l_partkey", "items[0].qty", "items[5].qty"],
        "status.final=yes,flags=R", scope="orders",
    )
    return rows.withColumn("items[].l_partkey", F.array_join(F.col("`items[].l_partkey`").cast("array<string>"), ","))


@query(
    "nested_query_negation",
    "B3 B4",
    _NESTED + "select id, code as \"status.code\" from o where code <> 'F' and not coalesce(list_contains(list_transform(items, lambda x: x.ln), 2), false)",
)
def nested_query_negation(spark, sf):
    return rq.run_query(_order_docs(spark, sf), ["id", "status.code"], "status.code!=F,items[].l_linenumber!=2,missing=null", scope="orders")


# ------------------------------------------------------------------ snapshots
def _halves(spark, sf):
    """Two states of every customer: what was ordered before and from 1995 on."""
    rows = ad.table(spark, sf, "orders").join(ad.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("late", F.col("o_orderdate") >= F.lit("1995-01-01"))
    agg = rows.groupBy(F.col("c_mktsegment").alias("repo"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), "late").agg(
        F.count("*").alias("loc_code"), F.count_if(F.col("o_orderstatus") == "F").alias("routes"),
        F.min("o_orderpriority").alias("version"), F.array_sort(F.collect_set("o_orderpriority")).alias("depends_on"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("manifest_errors"),
    ).withColumn("entity_kind", F.lit("plugins"))
    return agg.where(~F.col("late")), agg.where("late")


_HALVES = """with h as (select c_mktsegment as repo, 'c' || o_custkey as entity, o_orderdate >= timestamp '1995-01-01' as late, count(*) as loc, count(*) filter (o_orderstatus = 'F') as routes,
    min(o_orderpriority) as version, list_sort(list(distinct o_orderpriority)) as deps, list_sort(list(distinct o_orderstatus)) as errs
  from orders join customer on o_custkey = c_custkey group by all),
b as (select * from h where not late), u as (select * from h where late),
d as (select coalesce(b.repo, u.repo) as repo, coalesce(b.entity, u.entity) as entity,
  case when b.repo is null then 'added' when u.repo is null then 'removed' else 'common' end as status,
  b.version as base_version, u.version as cur_version, coalesce(b.loc, 0) as base_loc, coalesce(u.loc, 0) as cur_loc, coalesce(u.loc, 0) - coalesce(b.loc, 0) as loc_delta,
  coalesce(b.routes, 0) as base_routes, coalesce(u.routes, 0) as cur_routes, coalesce(u.routes, 0) - coalesce(b.routes, 0) as route_delta,
  list_sort(list_filter(coalesce(u.deps, []), lambda x: not list_contains(coalesce(b.deps, []), x))) as deps_added,
  list_sort(list_filter(coalesce(b.deps, []), lambda x: not list_contains(coalesce(u.deps, []), x))) as deps_removed,
  list_sort(list_filter(coalesce(u.errs, []), lambda x: not list_contains(coalesce(b.errs, []), x))) as new_errors,
  list_sort(list_filter(coalesce(b.errs, []), lambda x: not list_contains(coalesce(u.errs, []), x))) as fixed_errors
  from b full join u on b.repo = u.repo and b.entity = u.entity)
"""


def _diff(spark, sf):
    return df_.snapshot_diff(*_halves(spark, sf))


@query(
    "snapshot_diff",
    "E12 A13 D38",
    _HALVES + """select repo, entity, status, base_loc, cur_loc, loc_delta, base_routes, cur_routes, route_delta, status = 'common' and base_version is distinct from cur_version as version_changed,
    array_to_string(deps_added, ',') as deps_added, array_to_string(deps_removed, ',') as deps_removed from d""",
)
def snapshot_diff(spark, sf):
    return _diff(spark, sf).select(
        "repo", "entity", "status", "base_loc", "cur_loc", "loc_delta", "base_routes", "cur_routes", "route_delta", "version_changed",
        F.array_join("deps_added", ",").alias("deps_added"), F.array_join("deps_removed", ",").alias("deps_removed"),
    )


@query(
    "snapshot_loc_changes",
    "E12 G6",
    _HALVES + """select * from (select repo, 'plugins/' || entity as target, base_loc as base, cur_loc as cur, loc_delta as delta,
    row_number() over (partition by repo order by abs(loc_delta) desc, 'plugins/' || entity) as rank from d where loc_delta <> 0 or status <> 'common')""",
)
def snapshot_loc_changes(spark, sf):
    return df_.loc_changes(_diff(spark, sf))


@query(
    "snapshot_manifest_changes",
    "E12 H4",
    _HALVES + """select repo, entity, array_to_string(new_errors, ',') as new_errors, array_to_string(fixed_errors, ',') as fixed_errors from d
    where status <> 'removed' and (len(new_errors) > 0 or len(fixed_errors) > 0)""",
)
def snapshot_manifest_changes(spark, sf):
    rows = df_.manifest_changes(_diff(spark, sf))
    return rows.withColumn("new_errors", F.array_join("new_errors", ",")).withColumn("fixed_errors", F.array_join("fixed_errors", ","))


@query(
    "snapshot_diff_summary",
    "E12",
    _HALVES + """select repo, count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed, count(*) filter (loc_delta <> 0) as loc_changed,
    count(*) filter (status = 'common' and base_version is distinct from cur_version) as versions_changed, sum(loc_delta)::bigint as loc_delta, true as has_changes from d group by repo""",
)
def snapshot_diff_summary(spark, sf):
    return df_.diff_summary(_diff(spark, sf))


@query(
    "catalogue_diff",
    "E14",
    """with a as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem where l_shipdate < timestamp '1997-01-01'),
    b as (select l_orderkey, l_linenumber, case when l_discount > 0.05 then 'X' else l_returnflag end as l_returnflag, l_linestatus from lineitem where l_shipdate >= timestamp '1995-01-01')
    select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) as l_linenumber,
    case when a.l_orderkey is null then 'added' when b.l_orderkey is null then 'removed' else 'changed' end as status,
    case when a.l_orderkey is null or b.l_orderkey is null then '' else array_to_string(list_filter([
      case when a.l_returnflag <> b.l_returnflag then 'l_returnflag' end, case when a.l_linestatus <> b.l_linestatus then 'l_linestatus' end], lambda x: x is not null), ',') end as fields
    from a full join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber
    where a.l_orderkey is null or b.l_orderkey is null or a.l_returnflag <> b.l_returnflag or a.l_linestatus <> b.l_linestatus""",
)
def catalogue_diff(spark, sf):
    lines = ad.table(spark, sf, "lineitem")
    flag = F.when(F.col("l_discount") > 0.05, "X").otherwise(F.col("l_returnflag"))
    old = lines.where(F.col("l_shipdate") < F.lit("1997-01-01"))
    new = lines.where(F.col("l_shipdate") >= F.lit("1995-01-01")).withColumn("l_returnflag", flag)
    rows = df_.diff_tables(old, new, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])
    return rows.withColumn("fields", F.array_join("fields", ","))


# ------------------------------------------------------------------ component framework
def _framework(spark, sf):
    return load_corpus(materialize(ad.framework_corpus(spark, sf)))


@query(
    "framework_contract",
    "D10",
    """select 'w' || s_suppkey as repo, p.part, p.name, p.abstract from supplier, lateral (select 'base' as part, 'run_' || s_suppkey as name, true as abstract
    union all select 'base', 'stop', false union all select 'manager', 'list_all', false) p""",
)
def framework_contract(spark, sf):
    return st.framework_contract(_framework(spark, sf).tables).select("repo", "part", "name", "abstract")


@query(
    "framework_hooks",
    "D10",
    """select 'w' || s_suppkey as repo, 'hooks' as label, 1 as rank, 'Hook' || s_nationkey as name from supplier union all select 'w' || s_suppkey, 'hooks', 2, 'emit' from supplier""",
)
def framework_hooks(spark, sf):
    return st.hook_names(_framework(spark, sf).tables)


@query(
    "discovery_rules",
    "D10",
    "select 'w' || s_suppkey as repo, l.n as line_no, l.line from supplier, lateral (select 0 as n, 'Rules.' as line union all select 1, '' union all select 2, '1. init ' || s_suppkey) l",
)
def discovery_rules(spark, sf):
    return st.discovery_rules(_framework(spark, sf).tables)


@query(
    "framework_resources",
    "D13 D10",
    """select 'w' || s_suppkey as repo, x.kind, x.name, x.about from supplier, lateral (select 'helper' as kind, 'plugins._base.db' as name, 'Pool.' as about
    union all select 'template', 'plugins/_templates/basic', 'T' || s_suppkey union all select 'support', 'plugin_manager.hooks', '1 classes, 2 functions') x""",
)
def framework_resources(spark, sf):
    c = _framework(spark, sf)
    helpers = st.framework_helpers(c.tables).select("repo", F.lit("helper").alias("kind"), F.col("module").alias("name"), F.col("docstring").alias("about"))
    templates = st.component_templates(c.files).select("repo", F.lit("template").alias("kind"), F.col("dir").alias("name"), F.col("name").alias("about"))
    counts = F.format_string("%d classes, %d functions", "classes", "functions")
    support = st.support_modules(c.tables).select("repo", F.lit("support").alias("kind"), F.col("module").alias("name"), counts.alias("about"))
    return helpers.unionByName(templates).unionByName(support)


@query(
    "entry_scripts",
    "D9",
    "select 'w' || s_suppkey as repo, 'main.py' as path, 'Entry of ' || s_name || '.' as docstring, 6::bigint as loc, 1::bigint as route_count from supplier",
)
def entry_scripts(spark, sf):
    return st.entry_scripts(_framework(spark, sf).tables)


@query(
    "undocumented_components",
    "R4 R3",
    """select 'w' || s_suppkey as repo, r.rule_id, 'c' as target from supplier, (select unnest(['SPEC003', 'SPEC004']) as rule_id) r""",
)
def undocumented_components(spark, sf):
    from codefacts.operators import rules as ru

    c = _framework(spark, sf)
    comps = _components(c)
    x = ru.RuleInput(c.files, c.py_facts, comps, c.tables.routes, comps, comps, comps)
    return ru.spec_rules(x).select("repo", "rule_id", "target")
