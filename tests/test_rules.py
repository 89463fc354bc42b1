"""Rules, gates and the audit on one corpus with known defects."""

from dataclasses import replace

import pytest
from conftest import rows

from codefacts.operators import audit as au
from codefacts.operators import diff as df_
from codefacts.operators import facts as fx
from codefacts.operators import gates as gt
from codefacts.operators import graph as gr
from codefacts.operators import overview as ov
from codefacts.operators import rules as ru
from codefacts.operators import structure as st
from codefacts.plans.analysis import load_corpus
from codefacts.profile import GENERIC, Profile
from codefacts.sources import manifests as mf


def manifest(ident, role="business", caps='["c"]', version="1.0.0", deps="{}"):
    return (f'{{"identifier": "{ident}", "name": "n", "version": "{version}", "description": "d", "author": "a", "min_app_version": "1.0.0",'
            f' "agent_role": "{role}", "capabilities": {caps}, "depends_on": {deps}}}')


BP = "from flask import Blueprint\nbp = Blueprint('b', n, url_prefix='{}')\n@bp.route('/x')\ndef x(): pass\n@bp.route('/y')\ndef y(): pass\n"
FILES = {
    "plugins/one/__init__.py": "", "plugins/one/plugin.json": manifest("one", deps='{"two": ""}'), "plugins/one/i18n/en.yml": "", "plugins/one/README.md": "# d",
    "plugins/one/r.py": BP.format("/admin/wrong"), "plugins/one/ok.py": BP.format("/admin/one/sub"), "plugins/one/pub.py": BP.format("/shop"),
    "plugins/two/__init__.py": "import plugins.one.x\neval(x)\nsubprocess.run(c, shell=True)\nsubprocess.run(c, shell=False)\npsycopg2.connect()\n",
    "plugins/two/plugin.json": manifest("two", role="Boss", caps="[]", version="1"),
    "plugins/two/s.py": 'password = "s3cretvalue"\nq = "SELECT * FROM t WHERE a=" + x\n' + "def long():\n" + "    a = 1\n" * 130,
    "core/a.py": "import plugins.two\n" + "x = 1\n" * 2100, "plugin_manager/load.py": "import plugins.one\n",
    "h/a.h": '#include "b.h"\n', "h/b.h": '#include "a.h"\n',
}


@pytest.fixture(scope="module")
def x(spark, make_files):
    c = load_corpus(make_files(FILES))
    comps = st.components(c.files, c.tables, c.profile).cache()
    mods = st.modules(c.files, c.tables, c.profile)
    edges = st.component_edges(comps, st.component_imports(c.tables.imports))
    violations = st.boundary_violations(c.tables.imports, comps, mods, c.profile)
    roles = spark.createDataFrame([("r", "business")], "repo string, role string")
    return ru.RuleInput(c.files, c.py_facts, comps, c.tables.routes, edges, violations, ov.file_sizes(c.files), roles)


@pytest.fixture(scope="module")
def findings(spark, x):
    return ru.run_rules(spark, x).cache()


def test_findings(findings):
    got = rows(findings, "rule_id", "target", "line")
    assert got == sorted([
        ("ARCH001", "core", None), ("ARCH002", "one -> two -> one", None), ("ARCH003", "plugins/two/__init__.py", 5), ("ARCH004", "one", None),
        ("CMP001", "core/a.py", None), ("CMP002", "plugins/two/s.py", 3), ("SEC001", "plugins/two/s.py", None), ("SEC002", "plugins/two/__init__.py", 2),
        ("SEC003", "plugins/two/__init__.py", 3), ("SEC004", "plugins/two/s.py", None), ("SPEC001", "two", None), ("SPEC002", "two", None),
        ("SPEC003", "two", None), ("SPEC004", "two", None), ("SPEC005", "two", None)], key=repr)
    s = ru.severity_summary(findings).first()
    assert (s.total, s.error, s.warning, s.info) == (15, 6, 7, 2)
    assert [r.severity for r in ru.ordered(findings).collect()] == ["error"] * 6 + ["warning"] * 7 + ["info"] * 2


def test_roles_unknown_means_no_judgement(spark, x):
    assert ru.spec_rules(replace(x, roles=None)).where("rule_id = 'SPEC001'").count() == 0
    other = spark.createDataFrame([("another", "business")], "repo string, role string")
    assert ru.spec_rules(replace(x, roles=other)).where("rule_id = 'SPEC001'").count() == 0


def test_broken_rule_set_is_isolated(spark, x):
    def broken(_):
        raise RuntimeError("no")

    found = ru.run_rules(spark, x, rules={"broken": broken, "spec": ru.spec_rules})
    assert found.where("rule_id <> 'ENGINE'").count() == 5
    assert [(r.target, r.severity, r.evidence) for r in found.where("rule_id = 'ENGINE'").collect()] == [("broken", "error", "no")]


@pytest.fixture(scope="module")
def gate_input(x, findings):
    inc = gr.resolve_includes
    from codefacts.operators import cxx

    rows_ = inc(cxx.includes(x.files), cxx.sources(x.files).select("repo", "path"))
    none = x.files.sparkSession.createDataFrame([], "repo string, src string, dst string, src_path string, dst_path string, weight long")
    return gt.GateInput(x.components, x.routes, x.violations, x.component_edges, gr.file_edges(none, rows_), x.sizes, findings)


def test_gates(x, gate_input):
    names = gt.choose_gates(["all"])
    hits = gt.gate_hits(gate_input, names).cache()
    got = {r.gate: (r.hits, r.passed) for r in gt.gate_results(x.files, hits, names).collect()}
    # /shop, /admin/wrong and /admin/one/sub each have two routes and none is /admin/one
    assert got == {"manifest-invalid": (1, False), "boundary-violation": (1, False), "plugin-cycle": (1, False), "include-cycle": (1, False),
                   "route-unprefixed": (6, False), "file-too-large": (1, False), "findings": (6, False)}
    clean = gt.gate_results(x.files, hits.where("gate = 'none'"), names)
    assert clean.where("passed").count() == len(names)


def test_choice_of_gates():
    assert gt.choose_gates(None, GENERIC) == ["file-too-large"]
    assert gt.choose_gates(["findings", "manifest-invalid"]) == ["manifest-invalid", "findings"]
    for bad in (["nope"], ["include-cycle"]):
        with pytest.raises(ValueError):
            gt.choose_gates(bad, GENERIC)


def test_no_prefix_rule_in_profile(gate_input):
    assert gt.route_unprefixed(replace(gate_input, profile=replace(Profile(), route_prefix_pattern=None))).count() == 0


def test_audit(x, gate_input):
    hits = gt.gate_hits(gate_input, list(au.GATE_RULES))
    found = au.scanner_findings(x.files, x.py_facts).unionByName(au.gate_findings(hits)).cache()
    repos = x.files.select("repo")
    matrix = au.coverage(repos, found)
    v = au.verdict(matrix, found).first()
    assert v.decision == "not_releasable" and v.blocking == found.where("severity = 'blocking'").count() == 2
    mild = found.where("severity in ('minor', 'info')")
    assert au.verdict(au.coverage(repos, mild), mild).first().decision == "releasable"
    assert au.verdict(au.coverage(repos, mild), mild, fail_on="minor").first().decision == "not_releasable"
    none = found.limit(0)
    weak = au.verdict(au.coverage(repos, none, rule_dims=("security",)), none).first()
    assert weak.decision == "not_releasable" and weak.insufficient == ["ai_business", "architecture", "quality"]
    by = {(r.kind, r.key): r.findings for r in au.audit_summary(found).collect()}
    assert by["severity", "blocking"] == 2 and sum(n for (k, _), n in by.items() if k == "dimension") == found.count()
    lines = {r.value for r in au.annotations(found).collect()}
    assert "::error file=two::[ARC001/architecture] invalid component manifest" in lines
    assert au.verdict_annotations(au.verdict(matrix, found)).first().value == "::error::audit verdict: not releasable (2 blocking)"


def test_external_findings(spark, x):
    items = spark.createDataFrame([("r", 0, "AIB002", "a\\b.py", 3, None, None, "w", None), ("r", 1, "NOPE", "a", 1, None, None, None, None), ("r", 2, "SEC004", "", None, None, None, None, None)],
                                  "repo string, seq int, rule_id string, file string, line int, severity string, title string, why string, confidence string")
    good, bad = au.external_findings(items)
    assert rows(good, "rule_id", "dimension", "severity", "file", "coverage") == [("AIB002", "ai_business", "major", "a/b.py", "semantic")]
    assert rows(bad, "seq") == [(1,), (2,)]
    repos = x.files.select("repo")
    worse = good.withColumn("severity", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("blocking"))
    assert au.verdict(au.coverage(repos, worse), worse).first().decision == "releasable"
    assert au.verdict(au.coverage(repos, worse), worse, external_blocks=True).first().decision == "not_releasable"


def test_fingerprints(x, gate_input):
    repos = x.files.select("repo")
    found = au.scanner_findings(x.files, x.py_facts).cache()

    def state(f):
        return df_.audit_fingerprint(au.verdict(au.coverage(repos, f), f), f)

    d = df_.fingerprint_diff(state(found.where("rule_id <> 'QLT003'")), state(found)).first()
    assert not d.decision_changed and d.rules_added == ["quality/QLT003"] and d.rules_removed == []
    assert d.severity_changes and d.severity_changes[0].startswith("minor:")


def test_rules_of_type_ast(make_files, spark):
    """Two repositories, two thresholds; what is there without a threshold; unknown checks and bad thresholds find nothing or the default."""
    long = "def f():\n" + "    x = 1\n" * 6 + "def g():\n" + "    x = 1\n" * 90 + "try:\n    f()\nexcept E:\n    pass\n"
    facts = fx.extract_facts(make_files({"a.py": long, "bad.py": "def ("}, "one").unionByName(make_files({"a.py": long}, "two")).unionByName(make_files({"a.py": long}, "none")))
    rule = '{{"rule_id": "{}", "matcher": {{"type": "ast", "check": "{}"{}}}}}'
    brought = {
        "one": [("L", "long_function", ', "threshold": 6'), ("D", "long_function", ', "threshold": 0'), ("B", "bare_except", ""), ("U", "unknown", "")],
        "two": [("L", "long_function", ', "threshold": 7'), ("S", "long_function", ', "threshold": "x"')],
    }
    files = None
    for repo, rules in brought.items():
        one = make_files({"audit_rules.json": "[" + ",".join(rule.format(*r) for r in rules) + "]"}, repo)
        files = one if files is None else files.unionByName(one)
    rules = mf.read_rules(files)
    got = rows(au.repo_ast_hits(au.measures(facts), rules), "repo", "rule_id", "lineno")
    assert got == sorted([("one", "L", 1), ("one", "L", 8), ("one", "D", 8), ("one", "B", 101), ("two", "L", 8), ("two", "S", 8)], key=repr)
    sources = make_files({"a.py": long}, "one").unionByName(make_files({"a.py": long}, "two"))
    whole = rows(au.scanner_findings(sources, facts.where("repo <> 'none'"), repo_rules=rules).where("rule_id in ('L', 'D', 'B', 'S')"), "repo", "rule_id", "line", "confidence")
    assert whole == [(a, b, c, "high") for a, b, c in got]
