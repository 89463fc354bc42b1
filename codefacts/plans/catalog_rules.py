"""Queries over CI rules, rule findings, gates and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import audit as au
from codefacts.operators import ci
from codefacts.operators import facts as fx
from codefacts.operators import gates as gt
from codefacts.operators import graph as gr
from codefacts.operators import overview as ov
from codefacts.operators import rules as ru
from codefacts.operators import structure as st
from codefacts.plans import adapters as ad
from codefacts.plans.analysis import load_corpus
from codefacts.plans.catalog_facts import CORPUS, DEFS
from codefacts.plans.registry import query
from codefacts.session import materialize
from codefacts.sources import corpus as sc
from codefacts.sources import manifests as mf

# ------------------------------------------------------------------ CI
_CI = """
with w as (select lower(replace(n_name, ' ', '_')) as repo, n_nationkey % 2 = 0 as github, s_suppkey as k, s_acctbal as b,
  case when n_nationkey % 2 = 0 then '.github' else '.gitee' end || '/workflows/w' || s_suppkey || '.yml' as file
  from supplier join nation on s_nationkey = n_nationkey),
f as (select repo, file, 'CI001' as rule_id, 'warning' as severity, 8 as line from w where github
  union all select repo, file, 'CI001', 'warning', 7 from w where github and b <= 2000
  union all select repo, file, 'CI002', 'warning', null from w where github and (b <= 8000)
  union all select repo, file, case when github then 'CI003' else 'GG002' end, 'error', 14 from w
  union all select repo, file, 'CI004', 'info', null from w where github and b <= 5000
  union all select repo, file, 'CI005', 'warning', null from w where github and b < 0
  union all select repo, file, 'GG001', 'info', null from w where not github and b >= 0 and b <= 8000)
"""


def _workflows(spark, sf):
    return sc.workflow_files(ad.workflow_corpus(spark, sf))


@query("ci_findings", "A8 F4 F9 R27 R28 R29 R30 R31 R32 R33", _CI + "select * from f")
def ci_findings(spark, sf):
    return ci.workflow_findings(_workflows(spark, sf)).select("repo", "file", "rule_id", "severity", "line")


@query(
    "ci_summary",
    "D33",
    _CI + """select w.repo, w.platform, coalesce(n, 0) as total, coalesce(e, 0) as errors, coalesce(wa, 0) as warnings, coalesce(i, 0) as infos
    from (select distinct repo, case when github then 'github' else 'gitee' end as platform from w) w left join
    (select repo, count(*) as n, count(*) filter (severity = 'error') as e, count(*) filter (severity = 'warning') as wa, count(*) filter (severity = 'info') as i from f group by repo) using (repo)""",
)
def ci_summary(spark, sf):
    workflows = _workflows(spark, sf)
    return ci.ci_summary(workflows, ci.workflow_findings(workflows))


# ------------------------------------------------------------------ rules
def _rule_input(spark, sf):
    return _judged_corpus(spark, sf)[0]


def _judged_corpus(spark, sf):
    """What the rules read, and the corpus it comes from."""
    files = ad.stored_corpus(spark, sf)
    c = load_corpus(files)
    comps = materialize(st.components(files, c.tables, c.profile))
    mods = st.module_dirs(files, c.profile)
    edges = st.component_edges(comps, st.component_imports(c.tables.imports, c.profile))
    violations = st.boundary_violations(c.tables.imports, comps, mods, c.profile)
    roles = files.select("repo").distinct().select("repo", F.lit("business").alias("role"))
    return ru.RuleInput(files, c.py_facts, comps, c.tables.routes, edges, violations, ov.file_sizes(files, c.profile), roles, c.profile), c


_FINDINGS = CORPUS + """, rings as (select repo, k // 100 as ring, list('s' || k order by k) as ks, count(*) as n, min('s' || k) as lo from s group by all),
  f as (select repo, 'SPEC001' as rule_id, 'error' as severity, 's' || k as target, null as file, null::int as line from s where bal > 9000
  union all select repo, 'SPEC002', 'error', 's' || k, null, null from s where bal <= 5000
  union all select repo, 'SPEC003', 'warning', 's' || k, null, null from s
  union all select repo, 'SPEC005', 'error', 's' || k, null, null from s where bal < 0
  union all select repo, 'SEC002', 'warning', 'plugins/s' || k || '/routes.py', null, 10 from s
  union all select repo, 'SEC003', 'warning', 'plugins/s' || k || '/routes.py', null, 24 from s
  union all select repo, 'ARCH001', 'error', 'core', path, null from c where ok and bal < 0 and repo in (select repo from s where k = 1)),
  cyc as (with recursive w as (select r.repo, r.ring, r.lo, s.k, 's' || s.k as chain, 1 as n, r.n as total from rings r join s on r.repo = s.repo and 's' || s.k = r.lo
      union all select w.repo, w.ring, w.lo, s.nx, w.chain || ' -> s' || s.nx, w.n + 1, w.total from w join s on s.repo = w.repo and s.k = w.k where w.n <= w.total)
    select repo, chain as target from w where n = total + 1),
  allf as (select * from f union all select repo, 'ARCH002', 'error', target, null, null from cyc)
"""


@query("rule_findings", "R1 R2 R3 R5 R8 R9 R10 R11 R12 R13 U1 E22 M12", _FINDINGS + "select * from allf")
def rule_findings(spark, sf):
    return ru.run_rules(spark, _rule_input(spark, sf)).select("repo", "rule_id", "severity", "target", "file", "line")


@query(
    "rule_summary",
    "D24",
    _FINDINGS + """select repo, count(*) as total, count(*) filter (severity = 'error') as error, count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'info') as info
    from allf group by repo""",
)
def rule_summary(spark, sf):
    return ru.severity_summary(ru.run_rules(spark, _rule_input(spark, sf)))


@query(
    "secret_and_sql_text",
    "R6 R7",
    why_no_oracle="the secret pattern needs a back-reference and a look-ahead, which RE2 lacks; checked against Python's re in the tests",
)
def secret_and_sql_text(spark, sf):
    docs = ad.document_files(spark, sf)
    files = docs.select("repo", F.concat(F.lit("plugins/"), F.regexp_replace("path", r"\.[a-z]+$", ".py")).alias("path"), "content")
    empty = spark.createDataFrame([], "repo string, path string")
    x = ru.RuleInput(files, fx.extract_facts(empty.withColumn("content", F.lit(""))), empty, empty, empty, empty, empty)
    return ru.security_rules(x).select("repo", "rule_id", "target", "evidence")


@query(
    "long_functions_and_files",
    "R14 R15",
    CORPUS + """select repo, 'CMP001' as rule_id, path as target, null::int as line from c where bal < 0 or not ok
    union all select repo, 'CMP001', 'plugins/s' || k || '/' || f, null from s, (values ('__init__.py'), ('routes.py')) t(f)
    union all select repo, 'CMP001', 'shared/base.py', null from n
    union all select repo, 'CMP002', 'plugins/s' || k || '/routes.py', 7 from s union all select repo, 'CMP002', 'plugins/s' || k || '/routes.py', 22 from s""",
)
def long_functions_and_files(spark, sf):
    from dataclasses import replace

    x = _rule_input(spark, sf)
    rows = ru.complexity_rules(replace(x, profile=replace(x.profile, max_file_lines=9, max_function_lines=4)))
    return rows.select("repo", "rule_id", "target", "line")


_AST_RULES = """, rule as (select repo, unnest([{id: 'F-' || n_nationkey, what: 'long_function', most: case when n_nationkey % 2 = 0 then 3 else 4 end}, {id: 'G', what: 'long_function', most: 80},
    {id: 'H', what: 'unused_imports', most: null}, {id: 'P', what: 'bare_except', most: 9}, {id: 'R', what: 'except_return_fallback', most: null}]) as r from n),
  span as (select repo, path, lineno, endline - lineno as amount, 'long_function' as what from fun union all select repo, path, lineno, endline - lineno, 'long_function' from meth
    union all select repo, 'plugins/s' || k || '/routes.py', 17, 1, 'long_function' from s),
  m as (select * from span union all select repo, path, 4, null, 'unused_imports' from c where ok and bal < 0
    union all select repo, 'plugins/s' || k || '/routes.py', 11, null, 'bare_except' from s
    union all select repo, 'plugins/s' || k || '/routes.py', 25, null, 'except_return_fallback' from s)
"""


@query(
    "repo_ast_rules",
    "A9 U2 R21",
    DEFS + _AST_RULES + """select m.repo, m.path, m.lineno, rule.r.id as rule_id from m join rule on m.repo = rule.repo and m.what = rule.r.what
    where m.amount is null or m.amount >= rule.r.most""",
)
def repo_ast_rules(spark, sf):
    """Every repository brings rules of its own, with thresholds that differ between repositories."""
    files = ad.code_corpus(spark, sf)
    most = F.when(F.col("n_nationkey") % 2 == 0, 3).otherwise(4)
    text = F.format_string(
        """{"rules": [{"rule_id": "F-%s", "title": "t", "matcher": {"type": "ast", "check": "long_function", "threshold": %s}},
        {"rule_id": "G", "matcher": {"type": "ast", "check": "long_function"}}, {"rule_id": "H", "matcher": {"type": "ast", "check": "unused_imports"}},
        {"rule_id": "P", "matcher": {"type": "ast", "check": "bare_except", "threshold": 9}}, {"rule_id": "R", "matcher": {"type": "ast", "check": "except_return_fallback"}},
        {"rule_id": "U", "matcher": {"type": "ast", "check": "nobody_knows"}}, {"rule_id": "X", "matcher": {"type": "regex_line", "pattern": "import"}}]}""",
        F.col("n_nationkey"), most,
    )
    brought = ad.repo_names(spark, sf).select("repo", F.lit("audit_rules.json").alias("path"), text.alias("content"))
    measured = au.measures(fx.extract_facts(files))
    return au.repo_ast_hits(measured, mf.read_rules(brought)).select("repo", "path", "lineno", "rule_id")


# ------------------------------------------------------------------ gates
def _gates(spark, sf, names):
    x, c = _judged_corpus(spark, sf)
    findings = ru.run_rules(spark, x, only=["spec"])
    # the C texts have been read for the corpus
    edges = gr.file_edges(_no_symbol_edges(spark), gr.resolve_includes(c.tables.includes, c.tables.c_files))
    g = gt.GateInput(x.components, x.routes, x.violations, x.component_edges, edges, x.sizes, findings, x.profile)
    return x, gt.gate_hits(g, names)


def _no_symbol_edges(spark):
    return spark.createDataFrame([], "repo string, src string, dst string, src_path string, dst_path string, weight long")


_GATES = _FINDINGS + """, h as (select repo, 'manifest-invalid' as gate from s where bal <= 5000
  union all select repo, 'boundary-violation' from f where rule_id = 'ARCH001' union all select repo, 'plugin-cycle' from cyc
  union all select 'parts', 'include-cycle' from p a join p b on a.other = b.k and a.k < b.k
  union all select repo, 'route-unprefixed' from s where bal < 0 union all select repo, 'route-unprefixed' from s where bal < 0
  union all select repo, 'findings' from f where severity = 'error' and rule_id like 'SPEC%')
"""


@query(
    "gate_results",
    "D28 U4 H5 R34 R35 R36 R37 R38 R39 R40 M15",
    _GATES + """select r.repo, g.gate, coalesce(n, 0) as hits, coalesce(n, 0) = 0 as passed
    from (select repo from n union select 'parts') r, (select unnest(['manifest-invalid', 'boundary-violation', 'plugin-cycle', 'include-cycle', 'route-unprefixed', 'file-too-large', 'findings']) as gate) g
    left join (select repo, gate, count(*) as n from h group by all) x on x.repo = r.repo and x.gate = g.gate""",
)
def gate_results(spark, sf):
    names = gt.choose_gates(["all"])
    x, hits = _gates(spark, sf, names)
    return gt.gate_results(x.files, hits, names)


# ------------------------------------------------------------------ audit
_AUDIT = _FINDINGS + """, a as (
  select repo, 'QLT002' as rule_id, 'quality' as dimension, 'minor' as severity, 'scanner' as provider, 'plugins/s' || k || '/routes.py' as file, 11 as line from s
  union all select repo, 'AIB001', 'ai_business', 'major', 'scanner', 'plugins/s' || k || '/routes.py', 25 from s
  union all select repo, 'QLT004', 'quality', 'info', 'scanner', path, 4 from c where ok and bal < 0
  union all select repo, 'ARC001', 'architecture', 'blocking', 'gate', 's' || k, null from s where bal <= 5000
  union all select repo, 'ARC002', 'architecture', 'blocking', 'gate', file, null from f where rule_id = 'ARCH001'
  union all select repo, 'ARC003', 'architecture', 'major', 'gate', target, null from cyc
  union all select repo, 'ARC004', 'architecture', 'major', 'gate', 's' || k, null from s, range(2) where bal < 0)
"""


def _audit(spark, sf):
    x, hits = _gates(spark, sf, gt.choose_gates(["manifest-invalid", "boundary-violation", "plugin-cycle", "route-unprefixed", "file-too-large"]))
    found = au.scanner_findings(x.files, x.py_facts, x.profile).unionByName(au.gate_findings(hits))
    return x.files.select("repo").distinct(), materialize(found)


@query("audit_findings", "H1 H3 R20 R21 R22 R23 R25 U2 M13", _AUDIT + "select * from a")
def audit_findings(spark, sf):
    return _audit(spark, sf)[1].select("repo", "rule_id", "dimension", "severity", "provider", "file", "line")


@query(
    "audit_summary",
    "D25",
    _AUDIT + """select repo, 'severity' as kind, severity as key, count(*) as findings from a group by all
    union all select repo, 'dimension', dimension, count(*) from a group by all""",
)
def audit_summary(spark, sf):
    return au.audit_summary(_audit(spark, sf)[1])


@query(
    "audit_coverage",
    "D26",
    _AUDIT + """select r.repo, d.dimension, ch.channel, ch.channel = 'rule_only' as ran, case when ch.channel = 'rule_only' then coalesce(n, 0) else 0 end as findings
    from (select repo from n union select 'parts') r, (select unnest(['security', 'architecture', 'quality', 'ai_business']) as dimension) d, (select unnest(['rule_only', 'semantic']) as channel) ch
    left join (select repo, dimension, count(*) as n from a group by all) x on x.repo = r.repo and x.dimension = d.dimension""",
)
def audit_coverage(spark, sf):
    repos, found = _audit(spark, sf)
    return au.coverage(repos, found).drop("reason")


@query(
    "audit_verdict",
    "D27 M14",
    _AUDIT + """select r.repo, case when coalesce(b, 0) > 0 then 'not_releasable' else 'releasable' end as decision, coalesce(b, 0) as blocking
    from (select repo from n union select 'parts') r left join (select repo, count(*) filter (severity = 'blocking') as b from a group by repo) using (repo)""",
)
def audit_verdict(spark, sf):
    repos, found = _audit(spark, sf)
    return au.verdict(au.coverage(repos, found), found).select("repo", "decision", "blocking")


@query(
    "audit_of_one_dimension",
    "B18 D26 D27",
    _AUDIT + """, x as (select repo, count(*) as findings, count(*) filter (severity = 'blocking') as b from a where dimension = 'architecture' group by repo)
    select r.repo, coalesce(findings, 0) as findings, case when coalesce(b, 0) > 0 then 'not_releasable' else 'releasable' end as decision
    from (select repo from n union select 'parts') r left join x using (repo)""",
)
def audit_of_one_dimension(spark, sf):
    repos, found = _audit(spark, sf)
    dims = ("architecture",)
    chosen = au.of_dimensions(found, dims)
    matrix = au.coverage(repos, chosen, dims)
    counts = matrix.groupBy("repo").agg(F.sum("findings").alias("findings"))
    return au.verdict(matrix, chosen).join(counts, "repo").select("repo", "findings", "decision")


@query(
    "audit_annotations",
    "A27",
    _AUDIT + """select repo, '::' || case severity when 'blocking' then 'error' when 'info' then 'notice' else 'warning' end || ' file=' || file || case when line is null then '' else ',line=' || line end
      || '::[' || rule_id || '/' || dimension || '] ' || case rule_id when 'QLT002' then 'swallowed exception' when 'AIB001' then 'fallback value hides the cause' when 'QLT004' then 'unused import'
      when 'ARC001' then 'invalid component manifest' when 'ARC002' then 'core module imports a component' when 'ARC003' then 'components depend on each other in a cycle'
      else 'component route without the agreed prefix' end as value from a""",
)
def audit_annotations(spark, sf):
    return au.annotations(_audit(spark, sf)[1])


@query(
    "audit_fingerprint_diff",
    "D39 E13 A25",
    _AUDIT + """, fp as (select repo, count(*) filter (severity = 'blocking') as blocking, count(*) filter (severity = 'major') as major from a group by repo),
    q as (select repo, list_sort(list(distinct dimension || '/' || rule_id)) as rules, list_sort(list(distinct dimension || '/' || rule_id) filter (severity <> 'blocking')) as old from a group by repo)
    select r.repo, coalesce(b, 0) > 0 as decision_changed, coalesce(array_to_string(list_filter(rules, lambda x: not list_contains(old, x)), ','), '') as rules_added, '' as rules_removed
    from (select repo from n union select 'parts') r left join (select repo, count(*) filter (severity = 'blocking') as b from a group by repo) using (repo) left join q using (repo)""",
)
def audit_fingerprint_diff(spark, sf):
    from codefacts.operators import diff as df_

    repos, found = _audit(spark, sf)

    def state(findings):
        return df_.audit_fingerprint(au.verdict(au.coverage(repos, findings), findings), findings)

    rows = df_.fingerprint_diff(state(found.where("severity <> 'blocking'")), state(found))
    return rows.select("repo", "decision_changed", F.array_join("rules_added", ",").alias("rules_added"), F.array_join("rules_removed", ",").alias("rules_removed"))


@query(
    "external_findings",
    "A12 R24",
    """with i as (select source as repo, doc_id as seq, case lang when 'en' then 'AIB002' when 'fr' then 'SEC004' else 'X1' end as rule_id,
      case when doc_id % 5 = 0 then '' else 'd' || doc_id || '.py' end as file from documents)
    select repo, seq, rule_id, case when rule_id = 'X1' then 'unknown rule X1' when file = '' then rule_id || ': no file given' else 'kept' end as outcome from i""",
)
def external_findings(spark, sf):
    docs = ad.table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    items = docs.select(
        F.col("source").alias("repo"), F.col("doc_id").alias("seq"),
        F.when(F.col("lang") == "en", "AIB002").when(F.col("lang") == "fr", "SEC004").otherwise("X1").alias("rule_id"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py"))).alias("file"),
        F.col("doc_id").cast("int").alias("line"), none.alias("severity"), none.alias("title"), none.alias("why"), none.alias("confidence"),
    )
    good, bad = au.external_findings(items)
    kept = good.select("repo", F.col("line").cast("long").alias("seq"), "rule_id", F.lit("kept").alias("outcome"))
    return kept.unionByName(bad.withColumnRenamed("reason", "outcome"))


@query(
    "worst_findings",
    "G5",
    _FINDINGS + """select repo, rule_id, severity, target, rank from (select *, row_number() over (partition by repo order by case severity when 'error' then 0 when 'warning' then 1 else 2 end,
      rule_id, target, coalesce(file, ''), coalesce(line, 0)) as rank from allf) where rank <= 5""",
)
def worst_findings(spark, sf):
    return ru.worst(ru.run_rules(spark, _rule_input(spark, sf)), 5).select("repo", "rule_id", "severity", "target", "rank")


@query(
    "ci_audit_findings",
    "R26",
    _CI + "select repo, file, rule_id, 'architecture' as dimension, case severity when 'error' then 'blocking' when 'warning' then 'minor' else 'info' end as severity, line from f",
)
def ci_audit_findings(spark, sf):
    return au.ci_findings(ci.workflow_findings(_workflows(spark, sf))).select("repo", "file", "rule_id", "dimension", "severity", "line")
