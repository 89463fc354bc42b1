"""Queries that write a result, read it back and return what was read; scopes and frontends of projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import audit as au
from codefacts.operators import diff as df_
from codefacts.operators import documents as dc
from codefacts.operators import overview as ov
from codefacts.operators import structure as st
from codefacts.plans import adapters as ad
from codefacts.plans.analysis import load_corpus
from codefacts.plans.catalog_facts import _SYMBOLS, CORPUS, symbols_of
from codefacts.plans.catalog_misc import _SIZES
from codefacts.plans.registry import query
from codefacts.session import materialize
from codefacts.sources import corpus as sc
from codefacts.sources import sinks
from codefacts.streaming import jobs

_LISTED = CORPUS + """, fl as (select repo, 'plugins/s' || k || '/' || unnest(['__init__.py', 'routes.py', 'plugin.json', 'README.md']) as path from s
  union all select repo, path from c union all select repo, 'shared/base.py' from n union all select repo, path from p)
"""


def _sizes(spark, sf):
    return ov.file_sizes(ad.stored_corpus(spark, sf))


@query("sections_written", "A20", _LISTED + "select 'two' as snapshot, repo, path, 'kept' as note from fl union all select 'one', repo, path, 'first' from fl")
def sections_written(spark, sf):
    """Two snapshots of a section; the second one is written twice, and only what was written last is there."""
    root, rows = jobs.scratch(spark, "sections"), _sizes(spark, sf).select("repo", "path")
    for snapshot, note in (("one", "first"), ("two", "lost"), ("two", "kept")):
        sinks.write_sections({"files": rows.withColumn("note", F.lit(note)), "other": rows}, root, snapshot, only=["files"], packed=True)
    return spark.read.parquet(f"{root}/files").select("snapshot", "repo", "path", "note")


@query("symbol_index_written", "A21", _SYMBOLS + "select * from so")
def symbol_index_written(spark, sf):
    path = jobs.scratch(spark, "symbols")
    sinks.write_symbol_index(symbols_of(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "snapshot_written",
    "A24 A13 D38",
    CORPUS + """, cnt as (select repo, count(*) filter (bal < 0 or not ok) as plus, count(*) as nc from c group by repo), pc as (select count(*) as np from p)
    select 'plugins' as entity_kind, repo, 's' || k as entity, 31 as loc_code, 2 as routes, bal > 5000 and bal >= 0 as manifest_valid, 's' || nx as depends_on from s
    union all select 'core', repo, 'core', nc * 9 + plus, 0, null, '' from cnt union all select 'core', repo, 'shared', 11, 0, null, '' from n union all select 'core', 'parts', 'lib', np * 9, 0, null, '' from pc where np > 0""",
)
def snapshot_written(spark, sf):
    """Built from components and modules, stored under a name beside another one, and read back by its name."""
    c = load_corpus(ad.stored_corpus(spark, sf))
    built = materialize(df_.build_snapshot(st.components(c.files, c.tables, c.profile), st.modules(c.files, c.tables, c.profile), "now"))
    path = jobs.scratch(spark, "snapshots")
    sinks.save_snapshot(built.where("entity = 'shared'").withColumn("snapshot", F.lit("before")), path)
    sinks.save_snapshot(built, path)
    rows = sc.read_snapshot(spark, path, "now")
    return rows.select("entity_kind", "repo", "entity", "loc_code", "routes", "manifest_valid", F.array_join("depends_on", ",").alias("depends_on"))


@query(
    "fingerprint_written",
    "A25 D39",
    """with f as (select l_returnflag as repo, l_shipmode as rule, l_linenumber as n from (select l_returnflag, 'R' || (l_suppkey % 4) as l_shipmode, l_linenumber from lineitem))
    select 'later' as snapshot, repo, 'not_releasable' as decision, 'quality/R0,quality/R1,quality/R2,quality/R3' as hit_rules, count(*) filter (n = 1) as blocking, count(*) filter (n > 1) as minor from f group by repo""",
)
def fingerprint_written(spark, sf):
    lines = ad.table(spark, sf, "lineitem")
    severity = F.when(F.col("l_linenumber") == 1, "blocking").otherwise("minor")
    findings = lines.select(
        F.col("l_returnflag").alias("repo"), F.concat(F.lit("R"), (F.col("l_suppkey") % 4).cast("string")).alias("rule_id"), F.lit("quality").alias("dimension"),
        severity.alias("severity"), F.lit("rule_only").alias("coverage"),
    )
    repos = findings.select("repo").distinct()
    verdicts = au.verdict(au.coverage(repos, findings), findings)
    path = jobs.scratch(spark, "fingerprints")
    for name in ("sooner", "later"):
        sinks.save_fingerprint(df_.audit_fingerprint(verdicts, findings), path, name)
    rows = spark.read.parquet(path).where("snapshot = 'later'")
    return rows.select("snapshot", "repo", "decision", F.array_join("hit_rules", ",").alias("hit_rules"), "blocking", "minor")


@query(
    "run_written",
    "A26 A14",
    "select c_mktsegment as repo, c_custkey as k, case when c_mktsegment = 'BUILDING' then date '2024-01-02' else date '2024-01-01' end as run_date from customer",
)
def run_written(spark, sf):
    """Two runs by date, the second of one repository only; per repository the latest is read."""
    rows = ad.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("repo"), F.col("c_custkey").alias("k"))
    path = jobs.scratch(spark, "runs")
    sinks.write_run(rows, path, "2024-01-01")
    sinks.write_run(rows.where("repo = 'BUILDING'"), path, "2024-01-02")
    return sc.latest_run(spark.read.parquet(path)).select("repo", "k", "run_date")


@query(
    "scanned_files",
    "A1 A2",
    "select 'n' || c_nationkey as repo, count(*) as n, sum(strlen('x = ' || c_custkey || ' # ' || c_name) + 1)::bigint as bytes, count(*)::bigint as lines from customer group by c_nationkey",
)
def scanned_files(spark, sf):
    """Customers as lines of text files in one folder for each nation, found again by a scan of the folders."""
    cust = ad.table(spark, sf, "customer")
    root = jobs.scratch(spark, "files")
    named = cust.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo"), F.concat(F.lit("x = "), F.col("c_custkey").cast("string"), F.lit(" # "), "c_name").alias("value"))
    named.repartitionByRange(4, "repo").write.partitionBy("repo").text(root)
    found = sc.scan_files(spark, root, glob="*.txt")
    rows = found.groupBy(F.regexp_replace("repo", "^repo=", "").alias("repo")).agg(F.sum("size").alias("bytes"), F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n")))).alias("lines"))
    return rows.select("repo", F.col("lines").cast("long").alias("n"), F.col("bytes").cast("long").alias("bytes"), F.col("lines").cast("long").alias("lines"))


# ------------------------------------------------------------------ projects
_UI = """, ui as (select 'ui' || (p_partkey % 7) as repo, p_partkey % 7 as u, 'src/pages/p' || p_partkey || '.ts' as path, 'let p = ' || p_partkey || ';' || chr(10) || '// ' || p_name || chr(10) as text from part
  union all select distinct 'ui' || (p_partkey % 7), p_partkey % 7, 'package.json', '{"name": "ui"}' from part),
  fe as (select 'region' || u as project, count(distinct repo) as frontend_repos, count(*) as frontend_files, count(*) as frontend_code, sum(strlen(text)) as frontend_bytes from ui where u < 5 and path <> 'package.json' group by u)
"""


def _frontend_files(spark, sf):
    """Seven frontend repositories; five of them belong to a project."""
    part = ad.table(spark, sf, "part", spread=True)
    repo = F.concat(F.lit("ui"), (F.col("p_partkey") % 7).cast("string"))
    page = F.format_string("let p = %s;\n// %s\n", "p_partkey", "p_name")
    pages = part.select(repo.alias("repo"), F.concat(F.lit("src/pages/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), page.alias("content"))
    packages = part.select(repo.alias("repo"), F.lit("package.json").alias("path"), F.lit('{"name": "ui"}').alias("content")).distinct()
    return pages.unionByName(packages).withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))


@query("frontend_repos", "C19", CORPUS + _UI + "select distinct repo from ui where u in (0, 1, 3)")
def frontend_repos(spark, sf):
    """Listed ones, one named by the profile, and one that is listed but has no package file."""
    from codefacts.profile import Profile

    files = _frontend_files(spark, sf).unionByName(ad.code_corpus(spark, sf).select("repo", "path", "content", "size", "mtime"))
    return dc.frontend_repos(files, ("ui0", "ui3", "parts"), Profile(frontend_names=("ui1",)))


@query(
    "project_scopes",
    "D32 D37 D31",
    _SIZES + _UI + """, pr as (select 'region' || n_regionkey as project, lower(replace(n_name, ' ', '_')) as repo from nation union all select 'region' || r_regionkey, 'gone' || r_regionkey from region),
    fl as (select repo, 'plugins/s' || k as folder, unnest([{x: 15, c: 11}, {x: 26, c: 20}, {x: 0, c: 0}, {x: 0, c: 0}]) as z from s
      union all select repo, 'core', {x: 15, c: case when bal < 0 or not ok then 10 else 9 end} from c union all select repo, 'shared', {x: 18, c: 11} from n),
    sc as (select project, repo, unnest(['plugins', 'core', 'nowhere']) as scope from pr union all select project, repo, 'plugins/s' || k from pr join s using (repo) where k % 10 = 0),
    fig as (select repo, scope, count(*) as files, sum(z.x) as lines, sum(z.c) as code from (select distinct repo, scope from sc) w join fl using (repo) where folder = scope or folder like scope || '/%' group by all),
    whole as (select repo, count(*) as files, sum(z.x) as lines, sum(z.c) as code from fl group by repo),
    rows as (select project, repo, scope, 'scope' as level, case when files is null then 'not_analyzed' else 'analyzed' end as status, coalesce(files, 0) as files, coalesce(lines, 0) as lines, coalesce(code, 0) as code
        from sc left join fig using (repo, scope)
      union all select project, repo, '', 'repo', case when files is null then 'not_analyzed' else 'analyzed' end, coalesce(files, 0), coalesce(lines, 0), coalesce(code, 0) from pr left join whole using (repo)
      union all select project, null, null, 'project', case when count(files) = 0 then 'not_analyzed' when count(files) < count(*) then 'partial' else 'analyzed' end, coalesce(sum(files), 0), coalesce(sum(lines), 0), coalesce(sum(code), 0)
        from pr left join whole using (repo) group by project)
    select r.project, r.repo, r.scope, r.level, r.status, r.files::bigint as files, r.lines::bigint as lines, r.code::bigint as code, coalesce(case when r.level = 'project' then fe.frontend_repos end, 0) as frontend_repos,
      coalesce(case when r.level = 'project' then fe.frontend_files end, 0) as frontend_files, coalesce(case when r.level = 'project' then fe.frontend_code end, 0) as frontend_code,
      coalesce(case when r.level = 'project' then fe.frontend_bytes end, 0)::bigint as frontend_bytes from rows r left join fe using (project)""",
)
def project_scopes(spark, sf):
    """Regions as projects, nations as members, folders as scopes, and frontends that belong to a region."""
    files = materialize(sc.spread_rows(ad.code_corpus(spark, sf).unionByName(_frontend_files(spark, sf))))
    named = ad.table(spark, sf, "nation").select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("project"), F.lower(F.translate("n_name", " ", "_")).alias("repo"))
    region = ad.table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("k"))
    project = F.concat(F.lit("region"), "k")
    members = named.unionByName(region.select(project.alias("project"), F.concat(F.lit("gone"), "k").alias("repo")))
    one = ad.suppliers(spark, sf).where("s_suppkey % 10 = 0").select("repo", F.concat(F.lit("/plugins/s"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("scope"))
    scopes = members.select("project", "repo", F.explode(F.array(F.lit("plugins"), F.lit("core"), F.lit("nowhere"))).alias("scope")).unionByName(members.join(one, "repo").select("project", "repo", "scope"))
    frontends = region.select(project.alias("project"), F.concat(F.lit("ui"), "k").alias("repo"))
    return dc.project_scopes(members, scopes, ov.file_sizes(files), frontends).drop("bytes")


@query("stream_freshness", "K6", "select event_type as repo, count(*) as n from events group by event_type")
def stream_freshness(spark, sf):
    """A query that goes on by its interval, is waited for until it has caught up, and stopped."""
    schema = ad.table(spark, sf, "events").schema
    counts = jobs.table_stream(spark, f"{sf.rstrip('/')}/events.parquet", schema).groupBy(F.col("event_type").alias("repo")).agg(F.count("*").alias("n"))
    out = jobs.scratch(spark, "fresh")
    running = jobs.write_changelog(counts, out, jobs.scratch(spark, "ck"))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return jobs.changelog_state(spark, out, ["repo"])
