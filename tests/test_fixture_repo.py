"""The whole analysis over one small repository, against known numbers."""

import pytest
from conftest import rows
from fixture_repo import FILES
from pyspark.sql import functions as F

from codefacts.operators import documents as dc
from codefacts.operators import digest as dg
from codefacts.operators import overview as ov
from codefacts.operators import structure as st
from codefacts.operators import symbols as sy
from codefacts.plans.analysis import load_corpus
from codefacts.sources import manifests as mf


@pytest.fixture(scope="module")
def corpus(make_files):
    return load_corpus(make_files(FILES))


@pytest.fixture(scope="module")
def comps(corpus):
    return st.components(corpus.files, corpus.tables, corpus.profile).cache()


@pytest.fixture(scope="module")
def mods(corpus):
    return st.modules(corpus.files, corpus.tables, corpus.profile).cache()


def test_overview_counts(corpus):
    sizes = ov.file_sizes(corpus.files).cache()
    t = ov.totals(sizes).first()
    # counted by hand: docs/, debug_me.py and out.log stay out
    assert (t.files, t.assets, t.lines, t.code) == (17, 6, 64, 44)
    tops = {r.top: (r.files, r.lines, r.code) for r in ov.by_top_dir(sizes).collect()}
    assert tops == {"plugin_manager": (4, 27, 19), "plugins": (10, 25, 17), "core": (1, 6, 4), "<root>": (2, 6, 4)}
    assert rows(ov.extension_histogram(sizes), "ext", "files") == [(".json", 3), (".md", 2), (".py", 11), (".yml", 1)]
    big = ov.largest_files(sizes, 2).orderBy("rank").collect()
    assert [(r.path, r.lines, r.code) for r in big] == [("plugin_manager/base.py", 16, 11), ("plugins/billing/views.py", 13, 8)]


def test_symbols(corpus):
    table = sy.symbol_table(corpus.tables.classes, corpus.tables.functions, corpus.tables.routes)
    got = {(r.name, r.kind, r.file, r.line, r.owner) for r in table.collect()}
    assert got == {
        ("/open", "route", "plugins/billing/views.py", 7, "billing"), ("/<int:n>", "route", "plugins/billing/views.py", 12, "billing"),
        ("open_bills", "function", "plugins/billing/views.py", 7, "billing"), ("drop", "function", "plugins/billing/views.py", 12, "billing"),
        ("Billing", "class", "plugins/billing/__init__.py", 7, "billing"), ("post", "function", "plugins/ledger/__init__.py", 1, "ledger"),
        ("BasePlugin", "class", "plugin_manager/base.py", 5, "plugin_manager"), ("ComponentManager", "class", "plugin_manager/manager.py", 4, "plugin_manager"),
        ("main", "function", "core/run.py", 5, "core"), ("up", "function", "main.py", 5, "<root>"), ("/up", "route", "main.py", 5, "<root>"),
    }


def test_components(comps):
    by_dir = {r.dir: r for r in comps.collect()}
    assert set(by_dir) == {"billing", "ledger"}
    good, bad = by_dir["billing"], by_dir["ledger"]
    assert good.manifest_valid and good.manifest_errors == [] and good.route_count == 2 and good.base_classes == 1
    assert set(good.depends_on) == {"ledger", "mail"} and good.hooks_keys == ["a", "b"] and good.i18n_locales == ["en"] and good.docs == ["README.md"]
    assert (good.py_files, good.loc, good.loc_code, good.entry_docstring) == (2, 21, 14, "Billing component.")
    assert bad.manifest_errors == ["missing field: capabilities", "identifier is not [a-z0-9_]+: Ledger!", "version is not X.Y.Z: 2"]


def test_component_children(corpus):
    parts = {k: v.where("dir = 'billing'") for k, v in st.component_children(corpus.tables, corpus.profile).items()}
    assert [r.endpoint for r in parts["routes"].orderBy("path", "seq").collect()] == ["open_bills", "drop"]
    assert parts["classes"].where("inherits_base").count() == 1 and parts["blueprints"].count() >= 1


def test_contract_source(corpus):
    row = mf.read_manifest_contract(corpus.files).first()
    assert row.required == ["identifier", "version", "capabilities"] and row.enums == {"kind": ["a", "b"]}


def test_rejected_component_dirs(corpus):
    got = {r.dir: (r.valid, r.reasons) for r in st.component_dirs(corpus.files).collect()}
    assert got == {"billing": (True, []), "ledger": (True, []), "half": (False, ["no plugin.json"])}


def test_modules(mods):
    got = {r.name: (r.py_files, r.class_total, r.function_total, r.route_count) for r in mods.collect()}
    assert got == {"plugin_manager": (4, 2, 0, 0), "core": (1, 0, 1, 0)}


def test_module_children(corpus):
    parts = {k: v.where("name = 'plugin_manager'") for k, v in st.module_children(corpus.tables).items()}
    assert rows(parts["classes"], "rank", "symbol") == [(1, "BasePlugin"), (2, "ComponentManager")]
    assert rows(parts["import_roots"], "root", "imports") == [("abc", 1), ("base", 1)]
    assert ("BasePlugin", "start", True) in rows(parts["methods"], "class_name", "symbol", "abstract")


def test_framework_contract(corpus):
    got = [(r.part, r.name, r.abstract) for r in st.framework_contract(corpus.tables).orderBy("part", "seq").collect()]
    assert got == [("base", "start", True), ("base", "label", False), ("manager", "names", False)]
    assert [r.line for r in st.discovery_rules(corpus.tables).orderBy("line_no").collect()] == ["How components are found.", "", "One folder each."]
    assert rows(st.framework_helpers(corpus.tables), "module", "docstring") == [("plugins._base.http", "HTTP helpers.")]
    assert rows(st.support_modules(corpus.tables), "module") == [("plugin_manager.util",)]
    assert rows(st.component_templates(corpus.files), "dir", "name") == [("plugins/_templates/shop", "Shop template")]
    assert rows(st.entry_scripts(corpus.tables), "path", "docstring", "route_count") == [("main.py", "Entry.", 1)]


def test_interactions(corpus, comps, mods):
    imports = st.component_imports(corpus.tables.imports)
    assert rows(st.core_usage(imports), "module", "imports") == [("plugin_manager", 1)]
    assert rows(st.helper_usage(imports), "helper", "imports") == [("http", 1)]
    assert rows(st.component_edges(comps, imports), "src", "dst") == [("billing", "ledger"), ("billing", "mail")]
    assert rows(st.dependents(st.component_edges(comps, imports), "ledger"), "dependent") == [("billing",)]
    assert rows(st.boundary_violations(corpus.tables.imports, comps, mods), "module", "file", "imports") == [("core", "core/run.py", "plugins.ledger")]
    assert rows(st.base_class_ratio(comps), "with_base_class", "components") == [(1, 2)]


def test_headings_and_kpis(corpus, comps, mods):
    md = corpus.files.where("path = 'AGENTS.md'")
    assert [r.heading for r in dc.headings(md, 3).orderBy("pos").collect()] == ["Naming", "Tests"]
    assert rows(dc.key_documents(corpus.files), "path", "title") == [("AGENTS.md", "Agents")]
    violations = st.boundary_violations(corpus.tables.imports, comps, mods)
    k = dc.kpis(ov.totals(ov.file_sizes(corpus.files)), mods, comps, violations, st.entry_scripts(corpus.tables)).first()
    assert (k.core_modules, k.plugins, k.plugins_manifest_invalid, k.routes_total, k.routes_core, k.boundary_violations, k.files) == (2, 2, 1, 2, 1, 1, 17)


def test_shape_and_target(corpus, comps, mods):
    from codefacts.profile import EMBEDDED, GENERIC, Profile

    assert ov.infer_shape(corpus.files, [EMBEDDED, GENERIC, Profile()]).first().profile == "default"
    assert rows(st.resolve_target(comps, mods, "billing"), "kind", "name") == [("plugin", "billing")]
    assert rows(st.resolve_target(comps, mods, "module:core"), "kind", "name") == [("module", "core")]
    parts = st.context_slice(corpus.tables, "plugin", "billing", "full")
    assert parts["routes"].count() == 2 and parts["files"].count() == 2


def test_templates(make_files):
    files = make_files({"plugins/_templates/t1/plugin.json": '{"name": "T", "version": "2.0.0"}', "plugins/_templates/t2/x.py": ""})
    assert rows(st.component_templates(files), "dir", "name", "version") == [
        ("plugins/_templates/t1", "T", "2.0.0"), ("plugins/_templates/t2", "t2", "")]


def test_scope_rules(spark):
    names = ["a.py", "debug_x.py", "version.py", "x.json", "sub/x.json", ".github/w.yml", "a/.gitignore_dir/b.py", "a/.gitx/b.py", "docs/a.md",
             "src/docs/a.md", "img.png", "verify_all.py", "sub/verify_all.py", "data/a.py", "mydata/a.py"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kept = [r.path for r in df.where(ov.in_scope("path")).collect()]
    assert kept == ["a.py", "version.py", "sub/x.json", "sub/verify_all.py", "mydata/a.py"]
    assert [r.path for r in df.where(ov.churn_relevant("path")).collect()] == [
        "a.py", "version.py", "a/.gitignore_dir/b.py", "a/.gitx/b.py", "sub/verify_all.py", "mydata/a.py"]


def test_fingerprint_changes_with_any_file(spark, make_files):
    files = make_files({f"f{i}.py": "x" * i for i in range(50)})
    a = dg.corpus_fingerprint(files).first()
    b = dg.corpus_fingerprint(files.repartition(7, "content")).first()
    c = dg.corpus_fingerprint(files.withColumn("mtime", F.when(F.col("path") == "f7.py", 1).otherwise(F.col("mtime")))).first()
    d = dg.corpus_fingerprint(files.where("path <> 'f7.py'")).first()
    assert a == b and len({a.fingerprint, c.fingerprint, d.fingerprint}) == 3 and a.files == 50


def test_package_root_is_a_module_only_with_sources(make_files):
    files = make_files({"lib/a.h": "", "assets/x.css": "", "tests/t.py": ""})
    assert rows(st.module_dirs(files), "name") == [("lib",), ("tests",)]


def test_whole_analysis(corpus, tmp_path):
    from codefacts.plans.analysis import analyze
    from codefacts.sources import sinks

    sections = analyze(corpus)
    gates = {r.gate: r.passed for r in sections["gate_results"].collect()}
    assert gates == {"manifest-invalid": False, "boundary-violation": False, "plugin-cycle": True, "include-cycle": True,
                     "route-unprefixed": True, "file-too-large": True, "findings": False}
    assert rows(sections["findings"].where("severity = 'error'"), "rule_id", "target") == [("ARCH001", "core"), ("SPEC002", "Ledger!"), ("SPEC005", "Ledger!")]
    assert {r.endpoint_path for r in sections["endpoints"].collect()} == {"/admin/billing/open", "/admin/billing/<int:n>", "/up"}
    written = sinks.write_sections(sections, str(tmp_path / "out"), "s1", only=["overview", "components", "findings"])
    assert sorted(written) == ["components", "findings", "overview"]
