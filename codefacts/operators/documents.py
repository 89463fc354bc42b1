"""Markdown facts and frontend packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths, text
from codefacts.functions.ranking import top_k
from codefacts.profile import Profile

# ---------------------------------------------------------------- fixed values
STACK_MARKERS = (
    ("electron", "Electron"), ("react", "React"), ("vue", "Vue"), ("vite", "Vite"), ("antd", "Ant Design"), ("zustand", "Zustand"),
    ("i18next", "i18next"), ("echarts", "ECharts"), ("typescript", "TypeScript"), ("playwright-core", "Playwright"),
    ("better-sqlite3", "SQLite"), ("ssh2", "SSH2"),
)
# ----------------------------------------------------------- end of fixed values


def headings(files: DataFrame, level: int, k: int | None = None) -> DataFrame:
    """The headings of a level in each document (the first ``k`` if given), whole, evaluated inside the row of the document."""
    mark = "#" * level
    stripped = F.transform(text.split_lines("content"), text.strip)
    if level == 2:
        hits = F.filter(stripped, lambda s: s.startswith("## "))
        shown = F.transform(hits, lambda s: text.strip(F.substr(s, F.lit(4))))
    else:
        hits = F.filter(stripped, lambda s: s.startswith(mark))
        shown = F.transform(hits, lambda s: text.strip(F.regexp_replace(s, "^#+", "")))
    return files.select("repo", "path", F.posexplode(shown if k is None else F.slice(shown, 1, k)).alias("pos", "heading"))


def title(content: Column | str) -> Column:
    """The first ``# `` heading, empty when there is none."""
    stripped = F.transform(text.split_lines(content), text.strip)
    first = F.get(F.filter(stripped, lambda s: s.startswith("# ")), F.lit(0))
    return F.coalesce(text.strip(F.substr(first, F.lit(3))), F.lit(""))


def standard_document(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """The newest standard document of each repository (the last by path) with its title."""
    rows = files.where(F.col("path").rlike(profile.standard_doc_pattern)) if profile.standard_doc_pattern else files.where(F.lit(False))
    named = rows.select("repo", "path", title("content").alias("title"))
    return named.groupBy("repo").agg(F.max("path").alias("path"), F.max_by("title", "path").alias("title"))


def key_documents(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Title and size of the key documents that exist."""
    rows = files.where(F.col("path").isin(*profile.key_docs))
    name = F.when(title("content") != "", title("content")).otherwise(paths.basename("path"))
    return rows.select("repo", "path", name.alias("title"), F.col("size").alias("bytes"))


# ------------------------------------------------------------------ frontends
def frontend_repos(files: DataFrame, listed: tuple[str, ...] = (), profile: Profile = Profile()) -> DataFrame:
    """Repositories with a package file that are listed or named in the profile."""
    names = [*listed, *profile.frontend_names]
    rows = files.where("path = 'package.json'").select("repo").distinct()
    return rows.where(F.col("repo").isin(*names)) if names else rows.where(F.lit(False))


def package_facts(packages: DataFrame, files: DataFrame) -> DataFrame:
    """C17: kind, stack labels, dependency counts and disabled scripts of each package."""
    has_shell = files.groupBy("repo").agg(F.bool_or(F.col("path").startswith("electron/")).alias("has_shell"))
    keys = F.array_union(F.map_keys("deps"), F.map_keys("dev_deps"))
    stack = F.array_compact(F.array(*[F.when(F.array_contains(keys, key), label) for key, label in STACK_MARKERS]))
    disabled = F.map_filter("scripts", lambda k, v: F.coalesce(v.contains("DISABLED"), F.lit(False)))
    kind = (
        F.when(F.array_contains(keys, "electron") | F.coalesce("has_shell", F.lit(False)), "electron-desktop")
        .when(F.array_contains(keys, "react") | F.array_contains(keys, "vue"), "web-frontend")
        .otherwise("node-project")
    )
    return packages.join(has_shell, "repo", "left").select(
        "repo", "name", "version", "description", "main", kind.alias("kind"), stack.alias("stack"),
        F.size("deps").alias("deps_count"), F.size("dev_deps").alias("dev_deps_count"), F.size("scripts").alias("scripts_count"),
        F.array_sort(F.map_keys(disabled)).alias("scripts_disabled"),
    )


def frontend_metrics(files: DataFrame) -> DataFrame:
    """Counters by path pattern, all in one aggregation; locales from the first directory that has any."""
    p = F.col("path")

    def count(pattern: str) -> Column:
        return F.count_if(p.rlike(pattern))

    def names(pattern: str) -> Column:
        return F.sort_array(F.collect_set(F.when(p.rlike(pattern), paths.stem(p))))

    rows = files.groupBy("repo").agg(
        count(r"(?i)^src/pages/.*\.tsx?$").alias("pages"),
        count(r"(?i)^src/components/.*\.tsx?$").alias("components"),
        count(r"^src/stores/[^/]*\.ts$").alias("stores"),
        count(r"^src/services/[^/]*\.ts$").alias("services"),
        count(r"(?i)^electron/.*\.ts$").alias("electron_main_ts"),
        count(r"(?i)^electron/services/native/.*\.py$").alias("native_py"),
        count(r"^tests/unit/[^/]*\.test\.ts$").alias("tests_unit"),
        count(r"^tests/.*\.spec\.ts$").alias("tests_e2e"),
        count(r"^scripts/[^/]*\.mjs$").alias("tool_scripts"),
        F.sort_array(F.collect_set(F.when(p.rlike(r"^electron-builder[^/]*\.yml$"), p))).alias("build_editions"),
        names(r"^src/i18n/locales/[^/]*\.json$").alias("l1"),
        F.bool_or(p.startswith("src/i18n/")).alias("has2"),
        names(r"^src/i18n/[^/]*\.json$").alias("l2"),
        names(r"^locales/[^/]*\.json$").alias("l3"),
    )
    locales = F.when(F.size("l1") > 0, F.col("l1")).when(F.col("has2"), F.col("l2")).otherwise(F.col("l3"))
    return rows.withColumn("i18n_locales", locales).drop("l1", "l2", "l3", "has2")


# ------------------------------------------------------------------ figures
def distribution(rows: DataFrame, col: str) -> DataFrame:
    """How often each value occurs and its share of the repository."""
    counts = rows.groupBy("repo", F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("(none)")).alias("value")).agg(F.count("*").alias("n"))
    total = counts.groupBy("repo").agg(F.sum("n").alias("total"))
    return counts.join(total, "repo").select("repo", "value", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def kpis(totals: DataFrame, module_rows: DataFrame, comps: DataFrame, violations: DataFrame, entry_rows: DataFrame | None = None) -> DataFrame:
    """One row of figures per repository."""
    mods = module_rows.groupBy("repo").agg(F.count("*").alias("core_modules"), F.sum("route_count").alias("routes_core"))
    comp = comps.groupBy("repo").agg(
        F.count("*").alias("plugins"), F.count_if(~F.col("manifest_valid")).alias("plugins_manifest_invalid"), F.sum("route_count").alias("routes_total")
    )
    bad = violations.groupBy("repo").agg(F.count("*").alias("boundary_violations"))
    base = totals.select("repo", "files", F.col("lines").alias("lines_total"), F.col("code").alias("lines_code"),
                         F.col("bytes").alias("bytes_total"), F.col("code_bytes").alias("bytes_code"))
    if entry_rows is not None:
        entries = entry_rows.groupBy("repo").agg(F.sum("route_count").alias("entry_routes"))
        mods = mods.join(entries, "repo", "full_outer").withColumn("routes_core", F.coalesce("routes_core", F.lit(0)) + F.coalesce("entry_routes", F.lit(0))).drop("entry_routes")
    for part in (mods, comp, bad):
        base = base.join(part, "repo", "left")
    return base.na.fill(0)


def kpi_pairs(kpi_rows: DataFrame) -> DataFrame:
    """The same figures in long form."""
    cols = [c for c in kpi_rows.columns if c != "repo"]
    return kpi_rows.select("repo", *[F.col(c).cast("long") for c in cols]).unpivot("repo", cols, "metric", "value")


def project_summary(projects: DataFrame, kpi_rows: DataFrame) -> DataFrame:
    """Members of projects with their figures; members without any are ``not_analyzed``.

    ``projects``: project, repo. Rollup rows have a null repo (per project) and a null project (all).
    """
    joined = projects.join(kpi_rows.select("repo", "files", "lines_code"), "repo", "left")
    rows = joined.rollup("project", "repo").agg(
        F.grouping_id().alias("level"), F.count("*").alias("members"), F.count_if(F.col("files").isNull()).alias("missing"),
        F.sum(F.coalesce("files", F.lit(0))).alias("files"), F.sum(F.coalesce("lines_code", F.lit(0))).alias("lines_code"),
    )
    status = F.when(F.col("missing") == F.col("members"), "not_analyzed").when(F.col("missing") > 0, "partial").otherwise("analyzed")
    return rows.withColumn("status", status)


def frontend_figures(frontends: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of each frontend repository: files, code lines and bytes (``sizes`` as ``overview.file_sizes`` gives them)."""
    own = sizes.join(frontends.select("repo").distinct(), "repo", "left_semi")
    return own.groupBy("repo").agg(F.count("*").alias("frontend_files"), F.sum("code").alias("frontend_code"), F.sum("bytes").alias("frontend_bytes"))


_SIZE_FIGURES = ("files", "lines", "code", "bytes")
_FRONTEND_FIGURES = ("frontend_repos", "frontend_files", "frontend_code", "frontend_bytes")


def project_scopes(members: DataFrame, scopes: DataFrame, sizes: DataFrame, frontends: DataFrame) -> DataFrame:
    """Figures of projects, their repositories and the folders that are scopes of their own.

    ``members``: project, repo; ``scopes``: project, repo, scope (a folder at any depth; they may lie in each other);
    ``frontends``: project, repo of the frontends that belong to a project. A row's ``level`` is ``project``, ``repo`` or
    ``scope``; without a file it is ``not_analyzed``, a project with some such members ``partial``. Files are summed up by folder
    first; each folder then counts for the scopes among its parents, itself and the whole repository, which is the empty scope.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    by_folder = sizes.groupBy("repo", folder.alias("folder")).agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in _SIZE_FIGURES[1:]])
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    asked = scopes.select("project", "repo", F.regexp_replace("scope", "^/+|/+$", "").alias("scope")).where("scope <> ''").unionByName(members.select("project", "repo", F.lit("").alias("scope"))).distinct()
    wanted = asked.select("repo", "scope").distinct()
    below = by_folder.select("repo", *_SIZE_FIGURES, F.explode(prefixes).alias("scope")).groupBy("repo", "scope").agg(*[F.sum(c).alias(c) for c in _SIZE_FIGURES])
    figures = wanted.join(below, ["repo", "scope"], "left")
    per_frontend = frontends.select("project", "repo").distinct().join(frontend_figures(frontends, sizes), "repo")
    frontend = per_frontend.groupBy("project").agg(F.count("*").alias("frontend_repos"), *[F.sum(c).alias(c) for c in _FRONTEND_FIGURES[1:]])
    rows = asked.join(figures, ["repo", "scope"], "left").withColumn("is_repo", F.col("scope") == "")
    # a project is the sum of its repositories; a scope counts for itself only
    sums = [F.sum(c).alias(f"all_{c}") for c in _SIZE_FIGURES] + [F.sum(F.when(F.col("is_repo"), F.col(c))).alias(f"repo_{c}") for c in _SIZE_FIGURES]
    grouped = rows.groupingSets([["project", "repo", "scope"], ["project"]], "project", "repo", "scope").agg(
        F.grouping("repo").alias("whole"), F.count_if("is_repo").alias("members"), F.count_if(F.col("is_repo") & F.col("files").isNull()).alias("missing"), *sums
    )
    whole = F.col("whole") == 1
    figure = lambda c: F.coalesce(F.when(whole, F.col(f"repo_{c}")).otherwise(F.col(f"all_{c}")), F.lit(0).cast("long")).alias(c)
    status = (
        F.when(whole & (F.col("missing") == F.col("members")), "not_analyzed").when(whole & (F.col("missing") > 0), "partial")
        .when(whole | F.col("all_files").isNotNull(), "analyzed").otherwise("not_analyzed")
    )
    level = F.when(whole, "project").when(F.col("scope") == "", "repo").otherwise("scope")
    out = grouped.select("project", "repo", "scope", level.alias("level"), status.alias("status"), *[figure(c) for c in _SIZE_FIGURES])
    joined = out.join(frontend.withColumn("level", F.lit("project")), ["project", "level"], "left")
    return joined.select(*out.columns, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _FRONTEND_FIGURES])


def dependency_diagram(core_use: DataFrame, comps: DataFrame, edges: DataFrame, modules_k: int | None = None, components_k: int | None = None) -> DataFrame:
    """Diagram lines: imported modules, components and their dependencies; a ``k`` keeps the most imported or largest."""
    hot = top_k(core_use, ["repo"], [F.desc("imports"), F.col("module")], modules_k, "pos").select("repo", F.col("module").alias("node"))
    big = top_k(comps, ["repo"], [F.desc("loc"), F.col("identifier")], components_k, "pos").select("repo", F.col("identifier").alias("node"))
    ends = edges.select("repo", F.explode(F.array("src", "dst")).alias("node"))
    picked = big.unionByName(ends).distinct()
    group = lambda df, n, prefix, suffix: df.select("repo", F.lit(n).alias("part"), F.concat(F.lit(prefix), F.col("node"), F.lit(suffix)).alias("value"))
    lines = group(hot, 1, "    ", "").unionByName(group(picked, 2, "    ", "")).unionByName(group(hot, 3, "  PLG ==> ", ""))
    return lines.unionByName(edges.select("repo", F.lit(4).alias("part"), F.concat(F.lit("  "), "src", F.lit(" --> "), "dst").alias("value")))
