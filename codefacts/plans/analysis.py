"""The full analysis of a corpus as one plan: files -> facts -> sections, findings and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from codefacts.operators import endpoints as ep
from codefacts.operators import facts as fx
from codefacts.operators import gates as gt
from codefacts.operators import graph as gr
from codefacts.operators import overview as ov
from codefacts.operators import rules as ru
from codefacts.operators import structure as st
from codefacts.operators import symbols as sy
from codefacts.profile import Profile
from codefacts.session import materialize


@dataclass(frozen=True)
class Corpus:
    """A listing of files, their parsed facts (written once, read by every section) and the views over them."""

    files: DataFrame
    py_facts: DataFrame
    tables: st.FactTables
    profile: Profile


def load_corpus(files: DataFrame, profile: Profile = Profile(), py_facts: DataFrame | None = None) -> Corpus:
    """Parse once: the facts are written to the shared folder, and all sections read the columns they need from there."""
    facts = py_facts if py_facts is not None else materialize(fx.extract_facts(files.where(ov.in_scope("path", profile))))
    return Corpus(files, facts, st.fact_tables(files, facts, profile), profile)


def call_edges(c: Corpus) -> DataFrame:
    """Symbol edges of a corpus: calls of the Python files, to symbols of any file."""
    t, facts = c.tables, c.py_facts
    defs = gr.definitions(t.classes, t.methods, t.functions)
    return gr.symbol_edges(gr.resolve_calls(fx.calls(facts), fx.import_facts(facts), defs, facts.select("repo", "path")))


def analyze(c: Corpus, roles: DataFrame | None = None) -> dict[str, DataFrame]:
    """All sections of the analysis by name, ready for ``sources.sinks.write_sections``.

    Sections that others build on (components, edges, findings) are written to the shared folder first, so nothing is
    computed twice.
    """
    t, profile, files = c.tables, c.profile, c.files
    sizes = ov.file_sizes(files, profile)
    comps = materialize(st.components(files, t, profile))
    names = st.module_dirs(files, profile)
    comp_imports = st.component_imports(t.imports, profile)
    comp_edges = materialize(st.component_edges(comps, comp_imports))
    violations = st.boundary_violations(t.imports, comps, names, profile)
    symbol_edges = materialize(call_edges(c))
    includes = gr.resolve_includes(t.includes, t.c_files)
    file_edges = materialize(gr.file_edges(symbol_edges, includes))
    rule_input = ru.RuleInput(files, c.py_facts, comps, t.routes, comp_edges, violations, sizes, roles, profile)
    findings = materialize(ru.run_rules(files.sparkSession, rule_input))
    gates = gt.choose_gates(None, profile)
    hits = materialize(gt.gate_hits(gt.GateInput(comps, t.routes, violations, comp_edges, file_edges, sizes, findings, profile), gates))
    return {
        "overview": ov.overview(sizes), "files": sizes, "modules": st.modules(files, t, profile), "components": comps,
        "component_edges": comp_edges, "violations": violations, "symbols": sy.symbol_table(t.classes, t.functions, t.routes, profile.component_dir),
        "symbol_edges": symbol_edges, "file_edges": file_edges, "owner_edges": gr.owner_edges(file_edges, profile.component_dir),
        "endpoints": ep.resolve_endpoints(t.routes, t.blueprints, fx.single_name_calls(c.py_facts), fx.import_facts(c.py_facts), c.py_facts.select("repo", "path"), profile),
        "findings": findings, "gate_hits": hits, "gate_results": gt.gate_results(files, hits, gates),
    }
