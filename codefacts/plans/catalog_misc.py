"""Queries over caches, contracts, branches, scripts, documents, packages and key figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import census as ce
from codefacts.operators import contract as co
from codefacts.operators import divergence as dv
from codefacts.operators import documents as dc
from codefacts.operators import facts as fx
from codefacts.operators import graph as gr
from codefacts.operators import overview as ov
from codefacts.operators import structure as st
from codefacts.plans import adapters as ad
from codefacts.plans.analysis import load_corpus
from codefacts.plans.catalog_facts import CORPUS, DEFS, symbols_in
from codefacts.plans.registry import query
from codefacts.session import materialize
from codefacts.sources import corpus as sc
from codefacts.sources import gitlog as gl
from codefacts.sources import sinks

# ------------------------------------------------------------------ cache
@query(
    "parse_cache_judgement",
    "E19",
    f"""select source as repo, {ad.DOC_PATH_SQL} as path, case when lang = 'en' then 'sig' when lang = 'fr' then 'hash' when lang = 'de' then 'changed' else 'new' end as reason,
    lang in ('en', 'fr') as reused from documents""",
)
def parse_cache_judgement(spark, sf):
    files = ad.document_files(spark, sf)
    lang = F.substring_index("path", "/", 1)
    known = files.where(lang != "es").select(
        "repo", "path", F.when(lang == "en", F.col("mtime")).otherwise(F.col("mtime") - 1).alias("mtime"), "size",
        F.when(lang == "de", "0" * 12).otherwise(fx.content_key("content")).alias("code_hash"),
    )
    reused, todo = fx.split_by_cache(files, known)
    rows = reused.withColumn("reused", F.lit(True)).unionByName(todo.withColumn("reused", F.lit(False)))
    return rows.select("repo", "path", "reason", "reused")


@query(
    "stored_facts",
    "E19 C3",
    """select c_mktsegment as repo, 'c' || c_custkey || '.py' as path, case c_nationkey % 4 when 0 then 0 else 1 end as mtime, case c_nationkey % 4 when 1 then 2 else 1 end as loc_total
    from customer where c_nationkey % 5 <> 4""",
)
def stored_facts(spark, sf):
    """Two runs over a store: files that stay, are edited (two lines now), touched (a new signature only), new, and deleted."""
    from codefacts.sources import factstore
    from codefacts.streaming.jobs import scratch

    cust = ad.table(spark, sf, "customer", spread=True)
    kind, folder = F.col("c_nationkey") % 4, scratch(spark, "store")
    later = F.when(kind == 0, 0).otherwise(1)

    def files(rows, mtime, text):
        named = rows.select(F.col("c_mktsegment").alias("repo"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), mtime.cast("long").alias("mtime"), text.alias("content"))
        return named.withColumn("size", F.octet_length("content").cast("long"))

    one = F.concat(F.lit("x = "), F.col("c_custkey").cast("string"), F.lit("\n"))
    factstore.refresh(files(cust.where(kind != 3), F.lit(0), one), folder, 8)
    now = files(cust.where(F.col("c_nationkey") % 5 != 4), later, F.when(kind == 1, F.concat(one, one)).otherwise(one))
    return factstore.refresh(now, folder).select("repo", "path", F.col("mtime").cast("int").alias("mtime"), F.col("loc_total").cast("int").alias("loc_total"))


# ------------------------------------------------------------------ contract
EVENT_CONTRACT = {
    "type": "object", "required": ["k", "label"],
    "properties": {"k": {"type": "integer", "enum": list(range(50))}, "label": {"type": ["string", "null"]}, "list": {"type": "array", "items": {"$ref": "#/definitions/item"}}},
    "definitions": {"item": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "on": {"type": "boolean"}}}},
}


def _event_docs(spark, sf):
    """Event properties with members added from the other columns, some of them of the wrong type."""
    ev = ad.table(spark, sf, "events")
    base = F.regexp_replace("props", r"\}$", "")
    label = F.when(F.col("event_type") == "view", ', "label": 7').when(F.col("event_type") == "click", ', "label": null').when(F.col("event_type") == "error", "").otherwise(', "label": "x"')
    items = F.when(F.col("event_type") == "signup", F.concat(F.lit(', "list": [{"id": '), F.col("user_id").cast("string"), F.lit('}, {"on": 1}, 3]'))).otherwise("")
    tail = F.when(F.col("event_type") == "purchase", "").otherwise("}")
    return ev.select(F.col("event_id").alias("doc_id"), F.concat(base, label, items, tail).alias("payload"))


@query(
    "contract_errors",
    "V1",
    """with e as (select event_id as doc_id, event_type as t, json_extract(props, '$.k')::int as k from events)
    select doc_id, '$' as path, 'not valid JSON' as error from e where t = 'purchase'
    union all select doc_id, '$.k', 'value is not in the enumeration' from e where t <> 'purchase' and k >= 50
    union all select doc_id, '$', 'missing required field label' from e where t = 'error'
    union all select doc_id, '$.label', 'expected string or null' from e where t = 'view'
    union all select doc_id, '$.list[1]', 'missing required field id' from e where t = 'signup'
    union all select doc_id, '$.list[1].on', 'expected boolean' from e where t = 'signup'
    union all select doc_id, '$.list[2]', 'expected object' from e where t = 'signup'""",
)
def contract_errors(spark, sf):
    return co.validate(_event_docs(spark, sf), EVENT_CONTRACT)


# ------------------------------------------------------------------ branches
def _history(spark, sf):
    """Each customer's orders in groups of six are the commits of a repository, each the parent of the next.

    The fourth order of a group also branches off the second; the local branch ends at the third, the remote at the last.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = ad.table(spark, sf, "orders").withColumn("n", F.row_number().over(w) - 1)
    return rows.select(
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.floor(F.col("n") / 6).cast("string")).alias("repo"),
        F.col("o_orderkey").cast("string").alias("sha"), (F.col("n") % 6).alias("i"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("message"),
    )


_HISTORY = """with h as (select o_custkey || '-' || (n // 6) as repo, o_orderkey::varchar as sha, n % 6 as i, ts, message from (
  select *, o_orderdate as ts, o_orderstatus as message, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as n from orders)),
m as (select repo, max(i) as last from h group by repo),
x as (select h.repo, h.sha, ts, message, case when i = 2 and last > 2 then 'ahead' when i > 2 then 'behind' when last <= 1 then null end as side from h join m using (repo))
"""


def _exclusive(spark, sf):
    h = materialize(_history(spark, sf))
    child, parent = h.select("repo", F.col("sha").alias("sha"), "i"), h.select("repo", F.col("sha").alias("parent"), F.col("i").alias("pi"))
    pairs = child.join(parent, "repo")
    linked = ((F.col("pi") == F.col("i") - 1) & (F.col("i") != 3)) | ((F.col("i") == 3) & (F.col("pi") == 1))
    parents = pairs.where(linked).select("repo", "sha", "parent")
    last = h.groupBy("repo").agg(F.max_by("sha", "i").alias("sha"))
    local = h.where("i <= 2").groupBy("repo").agg(F.max_by("sha", "i").alias("sha"))
    return h, dv.exclusive_commits(local, last, parents)


@query("branch_divergence", "A16 E15 D41 I4", _HISTORY + """select repo, count(*) filter (side = 'ahead') as ahead, count(*) filter (side = 'behind') as behind,
    case when max(side) is null then 'synced' when min(side) <> max(side) then 'diverged' else max(side) end as status, 'low' as merge_risk from x group by repo""")
def branch_divergence(spark, sf):
    h, exclusive = _exclusive(spark, sf)
    return dv.divergence(h, exclusive)


@query("pending_commits", "E15", _HISTORY + """select repo, side, sha, ts, message, row_number() over (partition by repo, side order by ts desc, sha) as rank from x where side is not null""")
def pending_commits(spark, sf):
    h, exclusive = _exclusive(spark, sf)
    return dv.pending_commits(exclusive, h)


@query(
    "merge_risk_grades",
    "D41",
    "select o_custkey, case when count(*) > 20 then 'high' when count(*) > 5 then 'medium' else 'low' end as risk from orders group by o_custkey",
)
def merge_risk_grades(spark, sf):
    from codefacts.operators.churn import merge_risk

    n = ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", merge_risk("n").alias("risk"))


@query(
    "new_remote_tags",
    "E15 H6 A16",
    """select * from (select c_mktsegment as repo, 'v' || c_custkey as tag, row_number() over (partition by c_mktsegment order by 'v' || c_custkey) as rank
    from customer where c_acctbal < 0)""",
)
def new_remote_tags(spark, sf):
    cust = ad.table(spark, sf, "customer")
    listing = cust.select(
        F.col("c_mktsegment").alias("repo"),
        F.explode(F.array(F.concat(F.lit("abc\trefs/tags/v"), F.col("c_custkey").cast("string")), F.concat(F.lit("abc\trefs/tags/v"), F.col("c_custkey").cast("string"), F.lit("^{}")))).alias("value"),
    )
    tags = cust.where("c_acctbal >= 0").select(F.col("c_mktsegment").alias("repo"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("tag")).distinct()
    return dv.new_remote_tags(tags, gl.remote_tags(listing))


@query(
    "commit_log_text",
    "A3 A4 F4",
    """select 'log' as repo, l_orderkey::varchar as sha, 'src/p' || l_partkey || '.py' as path, case when l_returnflag = 'N' then null else l_quantity::int end as added,
    case when l_returnflag = 'N' then null else l_linenumber end as deleted from lineitem""",
)
def commit_log_text(spark, sf):
    """Orders and their lines as one exported log per task, read back as numstat rows of their commits."""
    import uuid

    from codefacts.session import ensure_checkpoint_dir

    none = F.col("l_returnflag") == "N"
    stat = F.concat_ws("\t", F.when(none, "-").otherwise(F.col("l_quantity").cast("int").cast("string")), F.when(none, "-").otherwise(F.col("l_linenumber").cast("string")),
                       F.concat(F.lit("src/{old => p"), F.col("l_partkey").cast("string"), F.lit("}.py")))
    head = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.lit("ab|n|e|2024-01-01 00:00:00|subject"))
    lines = ad.table(spark, sf, "lineitem")
    heads = lines.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("o"), head.alias("value"))
    body = lines.select("l_orderkey", F.lit(1).alias("o"), stat.alias("value"))
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/logs/{uuid.uuid4().hex}"
    heads.unionByName(body).repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "o").select("value").write.text(out)
    return gl.parse_numstat(gl.read_log_lines(spark, out), F.lit("log"))


# ------------------------------------------------------------------ scripts
@query(
    "script_census",
    "B17 C13 C14 C15 E20",
    CORPUS + """select repo, path, lines, funcs, nonstd, v, quality, reuse, cost, v + quality + reuse + cost as score, category, false as in_registry from (
      select repo, 'plugins/s' || k || '/__init__.py' as path, 16 as lines, 2 as funcs, 'plugins,shared' as nonstd, 1 as v, 2 as quality, 4 as reuse, 3 as cost, 'misc' as category from s
      union all select repo, 'plugins/s' || k || '/routes.py', 27, 4, 'flask', 1, 1, 4, 3, 'misc' from s where bal >= 0
      union all select repo, 'plugins/s' || k || '/routes.py', 27, 4, 'flask', 1, 1, 4, 3, 'misc' from s where bal < 0
      union all select repo, path, 16, 2, case when bal < 0 then 'plugins,shared' else 'shared' end, 1, 1, 4, 2, 'misc' from c where ok
      union all select repo, path, 16, 0, '', 0, 0, 5, 2, 'misc' from c where not ok
      union all select repo, 'shared/base.py', 19, 3, '', 1, 2, 5, 3, 'misc' from n)""",
)
def script_census(spark, sf):
    c = load_corpus(ad.stored_corpus(spark, sf))
    registry = spark.createDataFrame([("tool",)], "id string")
    rows = ce.script_census(c.files, c.py_facts, registry)
    return rows.select("repo", "path", "lines", "funcs", F.array_join("nonstd", ",").alias("nonstd"), "v", "quality", "reuse", "cost", "score", "category", "in_registry")


# ------------------------------------------------------------------ documents
@query(
    "key_documents",
    "C16",
    "select split_part(source, 'c', 1) || 'c' || substr(source, 4) || '-' || doc_id as repo, 'README.md' as path, 'doc ' || doc_id as title, strlen('## a' || chr(10) || ' # doc ' || doc_id || chr(10) || text) as bytes from documents",
)
def key_documents(spark, sf):
    return dc.key_documents(_readmes(spark, sf))


def _readmes(spark, sf):
    docs = ad.table(spark, sf, "documents", spread=True)
    key = F.col("doc_id").cast("string")
    body = F.concat(F.lit("## a\n # doc "), key, F.lit("\n"), F.col("text"))
    return docs.select(F.concat_ws("-", "source", key).alias("repo"), F.lit("README.md").alias("path"), body.alias("content"), F.octet_length(body).alias("size"))


@query(
    "document_sections",
    "C16",
    """with l as (select source || '-' || doc_id as repo, unnest(ls) as s, generate_subscripts(ls, 1) as i from (select source, doc_id, list_transform(string_split('## a' || chr(10) || text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) as ls from documents)),
    h as (select repo, trim(substr(s, 4)) as heading, row_number() over (partition by repo order by i) - 1 as pos from l where s like '## %')
    select repo, 'README.md' as path, pos, heading from h""",
)
def document_sections(spark, sf):
    return dc.headings(_readmes(spark, sf), 2)


# ------------------------------------------------------------------ frontends
def _frontends(spark, sf):
    """One package per customer: its dependencies and sources follow from the customer's columns."""
    cust = ad.table(spark, sf, "customer", spread=True)
    dep = F.when(F.col("c_acctbal") > 5000, "react").when(F.col("c_acctbal") > 0, "vue").otherwise("left-pad")
    pkg = F.format_string('{"name": "%s", "version": 1, "dependencies": {"%s": "1", "vite": "2"}, "devDependencies": {"typescript": "5"}, "scripts": {"a": "x", "b": "DISABLED y"}}', F.col("c_name"), dep)
    bad = F.when(F.col("c_mktsegment") == "BUILDING", "{broken").otherwise(pkg)
    files = F.array(
        F.struct(F.lit("package.json").alias("path"), bad.alias("content")),
        F.struct(F.concat(F.lit("src/pages/"), F.col("c_custkey").cast("string"), F.lit(".tsx")).alias("path"), F.lit("").alias("content")),
        F.struct(F.lit("src/stores/s.ts").alias("path"), F.lit("").alias("content")),
        F.struct(F.concat(F.lit("src/i18n/"), F.lower("c_mktsegment"), F.lit(".json")).alias("path"), F.lit("").alias("content")),
        F.struct(F.lit("tests/e2e/a.spec.ts").alias("path"), F.lit("").alias("content")),
    )
    return cust.select(F.concat(F.lit("fe"), F.col("c_custkey").cast("string")).alias("repo"), F.explode(files).alias("f")).select("repo", "f.*")


@query(
    "package_facts",
    "A7 C17 C19",
    """select 'fe' || c_custkey as repo, case when c_mktsegment = 'BUILDING' then 'fe' || c_custkey else c_name end as name, case when c_mktsegment = 'BUILDING' then '' else '1' end as version,
    case when c_mktsegment <> 'BUILDING' and c_acctbal > 0 then 'web-frontend' else 'node-project' end as kind,
    case when c_mktsegment = 'BUILDING' then '' when c_acctbal > 5000 then 'React,Vite,TypeScript' when c_acctbal > 0 then 'Vue,Vite,TypeScript' else 'Vite,TypeScript' end as stack,
    case when c_mktsegment = 'BUILDING' then 0 else 2 end as deps_count, case when c_mktsegment = 'BUILDING' then '' else 'b' end as disabled from customer""",
)
def package_facts(spark, sf):
    from codefacts.sources.manifests import read_package_json

    files = _frontends(spark, sf)
    rows = dc.package_facts(read_package_json(files), files)
    return rows.select("repo", "name", "version", "kind", F.array_join("stack", ",").alias("stack"), "deps_count", F.array_join("scripts_disabled", ",").alias("disabled"))


@query(
    "frontend_metrics",
    "C18",
    "select 'fe' || c_custkey as repo, 1 as pages, 0 as components, 1 as stores, 1 as tests_e2e, lower(c_mktsegment) as locales from customer",
)
def frontend_metrics(spark, sf):
    rows = dc.frontend_metrics(_frontends(spark, sf))
    return rows.select("repo", "pages", "components", "stores", "tests_e2e", F.array_join("i18n_locales", ",").alias("locales"))


# ------------------------------------------------------------------ figures
_SIZES = CORPUS + """, cnt as (select repo, count(*) filter (ok) as okc, count(*) as nc, count(*) filter (bal < 0 or not ok) as plus from c group by repo),
k as (select n.repo, coalesce(ns, 0) as plugins, coalesce(bad, 0) as plugins_manifest_invalid, coalesce(ns, 0) * 2 as routes_total,
  coalesce(ns, 0) * 41 + coalesce(nc, 0) * 15 + 18 as lines_total, coalesce(ns, 0) * 31 + coalesce(nc, 0) * 9 + coalesce(plus, 0) + 11 as lines_code, coalesce(ns, 0) * 4 + coalesce(nc, 0) + 1 as files
  from n left join cnt using (repo) left join (select repo, count(*) as ns, count(*) filter (bal <= 5000) as bad from s group by repo) x using (repo)
  union all select 'parts', 0, 0, 0, count(*) * 13, count(*) * 9, count(*) from p)
"""


def _kpis(spark, sf):
    files = ad.stored_corpus(spark, sf)
    c = load_corpus(files)
    comps, mods = st.components(files, c.tables, c.profile), st.modules(files, c.tables, c.profile)
    violations = st.boundary_violations(c.tables.imports, comps, mods, c.profile)
    return dc.kpis(ov.totals(ov.file_sizes(files, c.profile)), mods, comps, violations, st.entry_scripts(c.tables))


@query(
    "kpi_pairs",
    "D31",
    _SIZES + """, w as (select repo, files::bigint as files, lines_total::bigint as lines_total, lines_code::bigint as lines_code, plugins::bigint as plugins,
      plugins_manifest_invalid::bigint as plugins_manifest_invalid, routes_total::bigint as routes_total from k)
    unpivot w on files, lines_total, lines_code, plugins, plugins_manifest_invalid, routes_total into name metric value value""",
)
def kpi_pairs(spark, sf):
    rows = _kpis(spark, sf).select("repo", "files", "lines_total", "lines_code", "plugins", "plugins_manifest_invalid", "routes_total")
    return dc.kpi_pairs(rows)


@query(
    "project_summary",
    "D32 D37",
    _SIZES + """, pr as (select 'region' || n_regionkey as project, lower(replace(n_name, ' ', '_')) as repo from nation union all select 'region' || r_regionkey, 'gone' || r_regionkey from region),
    j as (select pr.*, k.files, k.lines_code from pr left join k using (repo))
    select project, repo, grouping_id(project, repo) as level, count(*) as members, count(*) filter (files is null) as missing, sum(coalesce(files, 0))::bigint as files, sum(coalesce(lines_code, 0))::bigint as lines_code,
      case when count(*) filter (files is null) = count(*) then 'not_analyzed' when count(*) filter (files is null) > 0 then 'partial' else 'analyzed' end as status from j group by rollup (project, repo)""",
)
def project_summary(spark, sf):
    nation = ad.table(spark, sf, "nation").select(
        F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("project"), F.lower(F.translate("n_name", " ", "_")).alias("repo")
    )
    gone = ad.table(spark, sf, "region").select(
        F.concat(F.lit("region"), F.col("r_regionkey").cast("string")).alias("project"), F.concat(F.lit("gone"), F.col("r_regionkey").cast("string")).alias("repo")
    )
    files = ad.stored_corpus(spark, sf)
    totals = ov.totals(ov.file_sizes(files)).select("repo", "files", F.col("code").alias("lines_code"))
    return dc.project_summary(nation.unionByName(gone), totals)


@query(
    "role_distribution",
    "D30 F10",
    CORPUS + """, r as (select repo, case when bal > 9000 then 'chief' else 'business' end as value from s)
    select repo, value, count(*) as n, round(count(*) / sum(count(*)) over (partition by repo), 4) as share from r group by repo, value""",
)
def role_distribution(spark, sf):
    from codefacts.sources import manifests as mf

    files = ad.code_corpus(spark, sf)
    return dc.distribution(mf.manifest_columns(mf.read_manifests(files), mf.read_manifest_contract(files)), "agent_role")


@query(
    "dependency_diagram",
    "A28",
    CORPUS + """, use as (select repo, 'shared' as node from s union select repo, 'shared' from s),
    pick as (select repo, 's' || k as node from s union select repo, 's' || nx from s)
    select repo, 1 as part, '    ' || node as value from use union all select repo, 3, '  PLG ==> ' || node from use
    union all select repo, 2, '    ' || node from pick union all select distinct repo, 4, '  s' || k || ' --> s' || nx from s""",
)
def dependency_diagram(spark, sf):
    c = load_corpus(ad.stored_corpus(spark, sf))
    comps, imps = st.components(c.files, c.tables, c.profile), st.component_imports(c.tables.imports, c.profile)
    return dc.dependency_diagram(st.core_usage(imps, c.profile), comps, st.component_edges(comps, imps))


@query(
    "violation_overlay",
    "E24",
    CORPUS + """select o.repo, o.node, o.node = 'core' and exists (select 1 from c where c.repo = o.repo and ok and bal < 0 and c.repo in (select repo from s where k = 1)) as violation
    from (select repo, 'core' as node from c union select repo, 'shared' from n union select 'parts', 'lib' from p) o""",
)
def violation_overlay(spark, sf):
    c = load_corpus(ad.stored_corpus(spark, sf))
    comps, mods = st.component_index(c.files, c.profile), st.module_dirs(c.files, c.profile)
    bad = st.boundary_violations(c.tables.imports, comps, mods, c.profile).select("repo", F.col("module").alias("node"))
    return gr.mark_violations(mods.select("repo", F.col("name").alias("node")), "node", bad)


# ------------------------------------------------------------------ mirror and runs
@query(
    "mirror_files",
    "A22 A23 M16",
    CORPUS + """select repo, 'plugins/s' || k || '/' || f as relpath, l as loc, lang, 's' || k as plugin from s, (values ('__init__.py', 15, 'python'), ('routes.py', 26, 'python'), ('plugin.json', 0, 'json'), ('README.md', 0, 'markdown')) t(f, l, lang)
    union all select repo, path, 15, 'python', null from c union all select repo, 'shared/base.py', 18, 'python', null from n union all select repo, path, 13, 'h', null from p""",
)
def mirror_files(spark, sf):
    files = ad.stored_corpus(spark, sf)
    c = load_corpus(files)
    comps, mods = st.components(files, c.tables, c.profile), st.modules(files, c.tables, c.profile)
    tables = sinks.mirror_tables(comps, c.tables.routes, symbols_in(c.py_facts), ov.file_sizes(files, c.profile), mods)
    return tables["files"]


@query(
    "mirror_routes",
    "A22",
    DEFS + "select repo, rule, methods, 's' || k as plugin, path as file, lineno from rt",
)
def mirror_routes(spark, sf):
    files = ad.stored_corpus(spark, sf)
    c = load_corpus(files)
    comps, mods = st.components(files, c.tables, c.profile), st.modules(files, c.tables, c.profile)
    return sinks.mirror_tables(comps, c.tables.routes, symbols_in(c.py_facts), ov.file_sizes(files, c.profile), mods)["routes"]


@query(
    "latest_runs",
    "A14 A26",
    """with r as (select o_orderpriority as repo, o_orderdate::date as run_date, o_orderkey from orders)
    select repo, run_date, o_orderkey from r where (repo, run_date) in (select repo, max(run_date) from r group by repo)""",
)
def latest_runs(spark, sf):
    rows = ad.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), F.to_date("o_orderdate").alias("run_date"), "o_orderkey")
    return sc.latest_run(rows)


@query(
    "role_catalogue",
    "A15",
    "select distinct source as repo, 'doc_' || doc_id as role from documents where lang = 'en'",
)
def role_catalogue(spark, sf):
    return sc.role_names(ad.document_files(spark, sf), "en", ".py")
