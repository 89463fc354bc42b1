"""Components, core modules and how they depend on each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths, text
from codefacts.functions.ranking import first_per_group, top_k, top_k_array
from codefacts.operators import cxx
from codefacts.operators import facts as fx
from codefacts.operators.overview import in_scope
from codefacts.profile import CXX_EXTS, PY_EXTS, Profile
from codefacts.session import materialize
from codefacts.sources import manifests as mf


@dataclass(frozen=True)
class FactTables:
    """Views of one facts table, Python and C family together, that the rollups read."""

    files: DataFrame
    functions: DataFrame
    classes: DataFrame
    methods: DataFrame
    imports: DataFrame
    routes: DataFrame
    blueprints: DataFrame
    includes: DataFrame
    c_files: DataFrame


def fact_tables(files: DataFrame, py_facts: DataFrame, profile: Profile = Profile()) -> FactTables:
    """One set of tables for both front ends; missing columns of the C family are null."""
    scoped = files.where(in_scope("path", profile))
    based = F.filter("defs", lambda d: (d["kind"] == "class") & (d["container"] == "") & F.exists(d["bases"], lambda b: b.endswith(profile.base_class)))
    py_files = py_facts.select(
        "repo", "path", "loc_total", "loc_code", text.first_line("doc").alias("docstring"), F.col("doc").alias("doc_full"), F.size(based).alias("base_classes")
    )
    c_facts = materialize(cxx.extract(scoped))  # one reading of every C text, however many tables take from it
    c_files = cxx.file_facts(c_facts).drop("defines").withColumn("doc_full", F.lit(None).cast("string")).withColumn("base_classes", F.lit(0))
    c_classes = cxx.classes(c_facts)
    classes = fx.classes(py_facts, profile.base_class).unionByName(
        c_classes.select("repo", "path", "name", "bases", F.lit(None).cast("string").alias("docstring"), F.lit(False).alias("inherits_base"), "lineno")
    )
    return FactTables(
        files=py_files.unionByName(c_files),
        functions=fx.functions(py_facts).unionByName(cxx.functions(c_facts), allowMissingColumns=True),
        classes=classes,
        methods=fx.methods(py_facts).unionByName(cxx.methods(c_facts), allowMissingColumns=True),
        imports=fx.imports(py_facts).unionByName(cxx.include_modules(cxx.includes(c_facts)).distinct()),
        routes=fx.routes(py_facts),
        blueprints=fx.blueprints(py_facts),
        includes=cxx.includes(c_facts),
        c_files=c_facts.select("repo", "path"),
    )


def _dir(path: str = "path") -> Column:
    return F.get(paths.segments(path), F.lit(1))


def _below(profile: Profile) -> Column:
    return F.col("path").startswith(profile.component_dir + "/") & (F.size(paths.segments("path")) >= 3)


# ------------------------------------------------------------------ components
def component_dirs(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Directories below the component directory, valid when both marker files are there, else with reasons."""
    rows = files.where(_below(profile)).withColumn("dir", _dir()).where("not (startswith(dir, '_') or startswith(dir, '.'))")
    here = F.concat(F.lit(profile.component_dir + "/"), F.col("dir"), F.lit("/"))
    seen = rows.groupBy("repo", "dir").agg(
        F.bool_or(F.col("path") == F.concat(here, F.lit("__init__.py"))).alias("has_init"),
        F.bool_or(F.col("path") == F.concat(here, F.lit(profile.manifest_name))).alias("has_manifest"),
    )
    reasons = F.array_compact(F.array(
        F.when(~F.col("has_init"), "no __init__.py"), F.when(~F.col("has_manifest"), f"no {profile.manifest_name}")
    ))
    return seen.select("repo", "dir", (F.col("has_init") & F.col("has_manifest")).alias("valid"), reasons.alias("reasons"))


def component_index(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Valid components with their manifest columns only, for everything that needs no size or route."""
    dirs = component_dirs(files, profile).where("valid").select("repo", "dir")
    manifest = mf.manifest_columns(mf.read_manifests(files, profile), mf.read_manifest_contract(files, profile), profile)
    return dirs.join(manifest, ["repo", "dir"])


def component_children(facts: FactTables, profile: Profile = Profile()) -> dict[str, DataFrame]:
    """Routes, classes and blueprints of each component, a row each, with the component's directory."""
    inside = lambda df: df.where(_below(profile)).withColumn("dir", _dir())
    return {
        "routes": inside(facts.routes).select("repo", "dir", "path", "seq", "bp", "rule", "url_prefix", "methods", "endpoint", "lineno"),
        "classes": inside(facts.classes).select("repo", "dir", "path", "name", "bases", "docstring", "inherits_base", "lineno"),
        "blueprints": inside(facts.blueprints).select("repo", "dir", "path", "seq", "var", "name", "url_prefix"),
    }


def components(files: DataFrame, facts: FactTables, profile: Profile = Profile(), max_routes: int | None = None) -> DataFrame:
    """One row per valid component: manifest columns, sizes, counts, markers and documents.

    The routes themselves are rows of ``component_children``; ``max_routes`` also puts the first few into a list.
    """
    key = ["repo", "dir"]
    is_py = paths.extension("path").isin(*PY_EXTS)

    def inside(df: DataFrame) -> DataFrame:
        return df.where(_below(profile)).withColumn("dir", _dir())

    depth = F.size(paths.segments("path"))
    base = paths.basename("path")
    loc = inside(facts.files.where(is_py)).groupBy(*key).agg(
        F.count("*").alias("py_files"), F.sum("loc_total").alias("loc"), F.sum("loc_code").alias("loc_code"),
        F.max(F.when((base == "__init__.py") & (depth == 3), F.col("docstring"))).alias("entry_docstring"),
        F.sum("base_classes").alias("base_classes"),
    )
    routes = inside(facts.routes)
    route_n = routes.groupBy(*key).agg(F.count("*").alias("route_count"))
    route_item = F.struct("path", "rule", "url_prefix", "methods", "endpoint", "lineno")
    route_rows = top_k_array(routes, key, [F.col("path"), F.col("seq")], max_routes, route_item, "routes") if max_routes else None
    below = F.get(paths.segments("path"), F.lit(2))
    counted = F.col("counted")
    marks = inside(files.withColumn("counted", in_scope("path", profile)).select("repo", "path", "counted")).groupBy(*key).agg(
        F.bool_or((below == "templates") & (depth >= 4)).alias("has_templates"),
        F.bool_or((below == "static") & (depth >= 4)).alias("has_static"),
        F.bool_or(((below == "tests") & (depth >= 4)) | (is_py & counted & F.lower(base).contains("test"))).alias("has_tests"),
        F.array_sort(F.collect_set(F.when((below == "i18n") & (depth == 4) & base.rlike(r"\.ya?ml$"), paths.stem("path")))).alias("i18n_locales"),
        F.array_sort(F.collect_set(F.when((depth == 3) & counted & paths.extension("path").isin(".md", ".txt"), base))).alias("docs"),
    )
    rows = component_index(files, profile)
    for part in (loc, route_n, *([route_rows] if route_rows is not None else []), marks):
        rows = rows.join(part, key, "left")
    for name in ("py_files", "loc", "loc_code", "base_classes", "route_count"):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    rows = rows.withColumn("path", F.concat(F.lit(profile.component_dir + "/"), "dir"))
    return rows.withColumn("route_truncated", F.col("route_count") > max_routes) if max_routes else rows


def framework_helpers(facts: FactTables, profile: Profile = Profile()) -> DataFrame:
    """Helper modules of the component framework with their first doc line."""
    pattern = f"^\\Q{profile.component_dir}/_base/\\E[^/]+\\.py$"
    rows = facts.files.where(F.col("path").rlike(pattern) & (paths.basename("path") != "__init__.py"))
    return rows.select("repo", F.concat(F.lit(f"{profile.component_dir}._base."), paths.stem("path")).alias("module"), "docstring")


def component_templates(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Template directories with what their manifest says."""
    root = f"{profile.component_dir}/_templates/"
    rows = files.where(F.col("path").startswith(root) & (F.size(paths.segments("path")) >= 4))
    dirs = rows.select("repo", F.get(paths.segments("path"), F.lit(2)).alias("dir")).distinct()
    members, _ = mf.json_object("content")
    meta = rows.where(F.col("path").rlike(f"^\\Q{root}\\E[^/]+/\\Q{profile.manifest_name}\\E$")).select(
        "repo", F.get(paths.segments("path"), F.lit(2)).alias("dir"), members.alias("m")
    )
    joined = dirs.join(meta, ["repo", "dir"], "left")
    return joined.select(
        "repo", F.concat(F.lit(root), "dir").alias("dir"), F.coalesce(mf._member(F.col("m"), "name"), F.col("dir")).alias("name"),
        mf._text(F.col("m"), "version").alias("version"), mf._text(F.col("m"), "description").alias("description"),
    )


# ------------------------------------------------------------------ core modules
def module_dirs(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Top directories with a source file, minus exclusions, plus the known ones that exist."""
    top = paths.top_dir("path")
    rows = files.where(F.instr("path", "/") > 0).select("repo", top.alias("name"), paths.extension("path").isin(*PY_EXTS, *CXX_EXTS).alias("src"))
    seen = rows.groupBy("repo", "name").agg(F.bool_or("src").alias("has_source"))
    known = F.col("name").isin(*profile.core_modules) if profile.core_modules else F.lit(False)
    skip = [*profile.excluded_dirs, *profile.auto_core_exclude, *([profile.component_dir] if profile.component_dir else [])]
    auto = F.col("has_source") & ~F.col("name").isin(*skip) & ~F.col("name").startswith(".git")
    return seen.where(known | auto).select("repo", "name", known.alias("known"))


def _by_module(df: DataFrame) -> DataFrame:
    below = df.where(F.instr("path", "/") > 0).withColumnRenamed("name", "symbol")
    return below.withColumn("name", paths.top_dir("path"))


def module_children(facts: FactTables) -> dict[str, DataFrame]:
    """What each core module consists of, a row each; classes and public functions ranked by weight."""
    key = ["repo", "name"]
    weight = [F.desc("inherits_base"), F.col("docstring").isNull(), F.col("symbol").startswith("_"), F.lower("symbol"), F.col("path"), F.col("lineno")]
    order = [F.col("docstring").isNull(), F.lower("symbol"), F.col("path"), F.col("lineno")]
    roots = _by_module(facts.imports.withColumn("root", F.substring_index("module", ".", 1)).drop("module"))
    return {
        "classes": top_k(_by_module(facts.classes), key, weight, None).select(*key, "rank", "symbol", "bases", "docstring", "path", "lineno"),
        "methods": _by_module(facts.methods).select(*key, "class_name", "symbol", "signature", "docstring", "abstract", "path", "lineno"),
        "functions": top_k(_by_module(facts.functions.where("public")), key, order, None).select(*key, "rank", "symbol", "signature", "docstring", "path", "lineno"),
        "routes": _by_module(facts.routes).select(*key, "bp", "rule", "url_prefix", "methods", "endpoint", "path", "seq", "lineno"),
        "blueprints": _by_module(facts.blueprints).select(*key, "symbol", "var", "url_prefix", "path", "seq"),
        "import_roots": roots.groupBy(*key, "root").agg(F.count("*").alias("imports")),
    }


def modules(files: DataFrame, facts: FactTables, profile: Profile = Profile()) -> DataFrame:
    """Sizes and counts of each core module; what they count are the rows of ``module_children``."""
    key = ["repo", "name"]
    names = module_dirs(files, profile)
    init = F.col("path") == F.concat(F.col("name"), F.lit("/__init__.py"))
    rows = names.join(
        _by_module(facts.files).groupBy(*key).agg(
            F.count("*").alias("py_files"), F.sum("loc_total").alias("loc"), F.sum("loc_code").alias("loc_code"),
            F.max(F.when(init, F.col("docstring"))).alias("package_docstring"),
        ),
        key, "left",
    )
    counted = ((facts.classes, "class_total"), (facts.functions.where("public"), "function_total"), (facts.routes, "route_count"), (facts.blueprints, "blueprint_count"))
    for df, name in counted:
        rows = rows.join(_by_module(df).groupBy(*key).agg(F.count("*").alias(name)), key, "left")
    for name in ("py_files", "loc", "loc_code", "class_total", "function_total", "route_count", "blueprint_count"):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    described = F.coalesce(_known_description(profile), F.col("package_docstring"), F.lit("(source module)"))
    return rows.withColumn("description", described)


def _known_description(profile: Profile) -> Column:
    """Description of a known module, else null."""
    expr = F.lit(None).cast("string")
    for name, description in profile.core_modules.items():
        expr = F.when(F.col("name") == name, description).otherwise(expr)
    return expr


def entry_scripts(facts: FactTables) -> DataFrame:
    """Python files in the repository root with their routes, largest first."""
    rows = facts.files.where((F.instr("path", "/") == 0) & F.col("path").endswith(".py"))
    counts = facts.routes.groupBy("repo", "path").agg(F.count("*").alias("route_count"))
    joined = rows.join(counts, ["repo", "path"], "left")
    return joined.select("repo", "path", "docstring", F.col("loc_total").alias("loc"), F.coalesce("route_count", F.lit(0).cast("long")).alias("route_count"))


def framework_contract(facts: FactTables, profile: Profile = Profile()) -> DataFrame:
    """Public methods of the base class and of the manager class (the first class that matches)."""
    core, names = profile.core_dir, profile.framework_files
    wanted = facts.classes.where(
        ((F.col("path") == f"{core}/{names['base']}") & (F.col("name") == profile.base_class))
        | ((F.col("path") == f"{core}/{names['manager']}") & F.col("name").contains(profile.manager_class_pattern))
    )
    role = F.when(F.col("path") == f"{core}/{names['base']}", "base").otherwise("manager")
    first = first_per_group(wanted.withColumn("part", role), ["repo", "part"], [F.col("lineno")])
    picked = first.select("repo", "part", "path", F.col("name").alias("class_name"), F.col("lineno").alias("class_line"))
    rows = facts.methods.where("not startswith(name, '_')").join(picked, ["repo", "path", "class_name", "class_line"])
    return rows.select("repo", "part", "path", "class_name", "seq", "name", "signature", "docstring", "abstract")


def discovery_rules(facts: FactTables, profile: Profile = Profile()) -> DataFrame:
    """Lines of the documentation of the discovery module."""
    path = f"{profile.core_dir}/{profile.framework_files['discovery']}"
    rows = facts.files.where(F.col("path") == path)
    return rows.select("repo", F.posexplode(text.split_lines(F.coalesce("doc_full", F.lit("")))).alias("line_no", "line"))


def support_modules(facts: FactTables, profile: Profile = Profile()) -> DataFrame:
    """Other modules of the framework directory with class and function counts."""
    names = [profile.framework_files[k] for k in ("base", "manager", "discovery")]
    here = F.col("path").rlike(f"^\\Q{profile.core_dir}/\\E[^/]+\\.py$") & ~paths.basename("path").isin(*names)
    rows = facts.files.where(here)
    for df, name in ((facts.classes, "classes"), (facts.functions, "functions")):
        rows = rows.join(df.where(here).groupBy("repo", "path").agg(F.count("*").alias(name)), ["repo", "path"], "left")
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    module = F.concat(F.lit(profile.core_dir + "."), paths.stem("path"))
    return rows.select("repo", module.alias("module"), "docstring", "classes", "functions")


def hook_names(facts: FactTables, profile: Profile = Profile(), k: int | None = None) -> DataFrame:
    """Class and public function names of the hook and event modules."""
    label = F.when(F.col("path") == f"{profile.core_dir}/{profile.framework_files['hooks']}", "hooks").when(
        F.col("path") == f"{profile.core_dir}/{profile.framework_files['events']}", "events"
    )
    rows = facts.classes.select("repo", label.alias("label"), "name", F.lit(0).alias("kind"), "lineno").unionByName(
        facts.functions.where("public").select("repo", label.alias("label"), "name", F.lit(1).alias("kind"), "lineno")
    )
    ranked = top_k(rows.where("label is not null"), ["repo", "label"], [F.col("kind"), F.col("lineno"), F.col("name")], k)
    return ranked.select("repo", "label", "rank", "name")


# ------------------------------------------------------------------ interactions
def component_imports(imports: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Imports written inside components, with the component's directory and what they point at."""
    target = F.regexp_extract("module", f"^\\Q{profile.component_dir}\\E\\.([a-z0-9_]+)", 1)
    rows = imports.where(_below(profile)).withColumn("dir", _dir())
    return rows.select("repo", "path", "dir", "module", F.substring_index("module", ".", 1).alias("root"), target.alias("target"))


def core_usage(comp_imports: DataFrame, profile: Profile = Profile(), k: int | None = None) -> DataFrame:
    """How often components import each core module."""
    names = [*profile.core_modules, *profile.core_dir_names]
    counts = comp_imports.where(F.col("root").isin(*names)).groupBy("repo", F.col("root").alias("module")).agg(F.count("*").alias("imports"))
    return top_k(counts, ["repo"], [F.desc("imports"), F.col("module")], k)


def helper_usage(comp_imports: DataFrame, profile: Profile = Profile(), k: int | None = None) -> DataFrame:
    """How often components import each framework helper."""
    prefix = f"{profile.component_dir}._base."
    rows = comp_imports.where(F.col("module").startswith(prefix))
    helper = F.get(F.split("module", r"\."), F.lit(2))
    return top_k(rows.groupBy("repo", helper.alias("helper")).agg(F.count("*").alias("imports")), ["repo"], [F.desc("imports"), F.col("helper")], k)


def base_class_ratio(comps: DataFrame) -> DataFrame:
    """Components with a subclass of the base class, of all components."""
    return comps.groupBy("repo").agg(F.count_if(F.col("base_classes") > 0).alias("with_base_class"), F.count("*").alias("components"))


def component_edges(comps: DataFrame, comp_imports: DataFrame) -> DataFrame:
    """Component -> component: manifest dependencies, and imports of other known components."""
    known = comps.select("repo", F.col("dir").alias("target")).distinct()
    declared = comps.select("repo", F.col("dir").alias("src"), F.explode(F.array_union(F.map_keys("depends_on"), F.col("dependencies"))).alias("dst"))
    used = comp_imports.where("target <> '' and target <> dir").join(known, ["repo", "target"], "left_semi")
    used = used.join(comps.select("repo", "dir"), ["repo", "dir"], "left_semi").select("repo", F.col("dir").alias("src"), F.col("target").alias("dst"))
    return declared.unionByName(used).distinct()


def boundary_violations(imports: DataFrame, comps: DataFrame, module_rows: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Core files that import a component; the framework's own loader directory is exempt.

    Only the names are read: ``component_index`` and ``module_dirs`` are enough.
    """
    target = F.regexp_extract("module", f"^\\Q{profile.component_dir}\\E\\.([a-z0-9_]+)", 1)
    rows = imports.where((F.instr("path", "/") > 0) & F.col("path").endswith(".py")).select(
        "repo", "path", paths.top_dir("path").alias("module_name"), F.col("module").alias("imports"), target.alias("dir")
    )
    rows = rows.where((F.col("dir") != "") & (F.col("module_name") != profile.core_dir))
    rows = rows.join(comps.select("repo", "dir"), ["repo", "dir"], "left_semi")
    cores = module_rows.select("repo", F.col("name").alias("module_name"))
    return rows.join(cores, ["repo", "module_name"], "left_semi").select("repo", F.col("module_name").alias("module"), F.col("path").alias("file"), "imports")


def dependents(edges: DataFrame, target: str) -> DataFrame:
    """Who depends on a component."""
    return edges.where(F.col("dst") == target).select("repo", F.col("src").alias("dependent"))


# ------------------------------------------------------------------ one target
def resolve_target(comps: DataFrame, module_rows: DataFrame, target: str) -> DataFrame:
    """``plugin:x``, ``module:x`` or a bare name, for which a component goes before a module."""
    kind, _, name = target.rpartition(":")
    rows = comps.where((F.col("identifier") == name) | (F.col("dir") == name)).select("repo", F.lit("plugin").alias("kind"), F.col("dir").alias("name"), F.lit(0).alias("prio"))
    rows = rows.unionByName(module_rows.where(F.col("name") == name).select("repo", F.lit("module").alias("kind"), "name", F.lit(1).alias("prio")))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return first_per_group(rows, ["repo"], [F.col("prio"), F.col("name")]).drop("prio")


#: How many routes, classes and functions each depth of a context shows
DEPTHS = {"brief": (20, 5, 8), "normal": (60, 8, 20), "full": (None, None, None)}


def context_slice(facts: FactTables, kind: str, name: str, depth: str = "full", profile: Profile = Profile()) -> dict[str, DataFrame]:
    """What one component or module consists of, cut to the depth; ``full`` is complete."""
    if depth not in DEPTHS:
        raise ValueError(f"unknown depth {depth!r}: one of {', '.join(DEPTHS)}")
    root = f"{profile.component_dir}/{name}/" if kind == "plugin" else f"{name}/"
    here = F.col("path").startswith(root)
    n_routes, n_classes, n_functions = DEPTHS[depth]

    def cut(df: DataFrame, k: int | None) -> DataFrame:
        rows = df.where(here)
        return rows if k is None else top_k(rows, ["repo"], [F.col("path"), F.col("lineno")], k, rank_col=None)

    roots = facts.imports.where(here).groupBy("repo", F.substring_index("module", ".", 1).alias("root")).agg(F.count("*").alias("imports"))
    return {
        "files": target_files(facts, root),
        "routes": cut(facts.routes, n_routes),
        "classes": cut(facts.classes, n_classes),
        "functions": cut(facts.functions.where("public"), n_functions),
        "imports": top_k(roots, ["repo"], [F.desc("imports"), F.col("root")], None),
    }


def target_files(facts: FactTables, root: str) -> DataFrame:
    """Per file of a target, sizes and counts."""
    here = F.col("path").startswith(root)
    rows = facts.files.where(here).select("repo", "path", "loc_total", "loc_code")
    for df, name in ((facts.classes, "classes"), (facts.functions, "functions"), (facts.routes, "routes")):
        rows = rows.join(df.where(here).groupBy("repo", "path").agg(F.count("*").alias(name)), ["repo", "path"], "left")
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return rows


def target_totals(rows: DataFrame) -> DataFrame:
    """Sums over the files of a target."""
    sums = [F.sum(c).alias(c) for c in ("loc_total", "loc_code", "classes", "functions", "routes")]
    return rows.groupBy("repo").agg(F.count("*").alias("files"), *sums)


def global_context(module_rows: DataFrame, comps: DataFrame, docs: DataFrame, max_components: int | None = None) -> dict[str, DataFrame]:
    """The overview slice: modules, components by name (the first few if ``max_components`` says so), documents."""
    cols = ["repo", "identifier", "version", "agent_role", "loc_code", "route_count", "manifest_valid"]
    return {
        "modules": module_rows.select("repo", "name", "description", "py_files", "loc_code", "route_count"),
        "components": top_k(comps.select(*cols), ["repo"], [F.col("identifier")], max_components),
        "documents": top_k(docs, ["repo"], [F.col("path")], None),
    }
