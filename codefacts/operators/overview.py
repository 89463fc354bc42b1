"""Which files count, and size totals by repository, language and directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths, text
from codefacts.functions.ranking import top_k
from codefacts.profile import BINARY_EXTS, CODE_EXTS, ROOT_SCRIPT_PREFIXES, ROOT_TEMP_EXTS, TEXT_ASSET_EXTS, Profile


def _starts_with_any(col: Column, prefixes: tuple[str, ...]) -> Column:
    return col.rlike("^(?:" + "|".join(prefixes) + ")") if prefixes else F.lit(False)


def root_local_script(path: Column | str, profile: Profile = Profile()) -> Column:
    """Scratch scripts and temporary output that sit in the repository root."""
    p = paths._c(path)
    ext = paths.extension(p)
    scratch = ext.isin(*ROOT_TEMP_EXTS) | ((ext == ".py") & _starts_with_any(F.lower(p), ROOT_SCRIPT_PREFIXES))
    return (F.instr(p, "/") == 0) & ~p.isin(*profile.root_entry_scripts) & scratch


def in_scope(path: Column | str, profile: Profile = Profile()) -> Column:
    """Not below an excluded directory at any depth, no root scratch file, no binary extension."""
    p = paths._c(path)
    names = "|".join(f"\\Q{d}\\E" for d in profile.excluded_dirs)
    excluded = p.rlike(f"(?:^|/)(?:(?:{names})|\\.git[^/]*)/") if names else p.rlike(r"(?:^|/)\.git[^/]*/")
    return ~excluded & ~root_local_script(p, profile) & ~paths.extension(p).isin(*BINARY_EXTS)


def churn_relevant(path: Column | str, profile: Profile = Profile()) -> Column:
    """Code files whose top directory is neither excluded nor hidden; no root scratch scripts."""
    p = paths._c(path)
    top = paths.top_dir(p)
    in_root = top == paths.ROOT
    scratch = in_root & ~p.isin(*profile.root_entry_scripts) & _starts_with_any(F.lower(p), ROOT_SCRIPT_PREFIXES)
    hidden = ~in_root & (top.isin(*profile.excluded_dirs) | top.startswith("."))
    return paths.extension(p).isin(*CODE_EXTS) & ~hidden & ~scratch


def file_sizes(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """One row per counted file with its extension, top directory, bytes, lines and code lines."""
    ext = paths.extension("path")
    is_code = ext.isin(*CODE_EXTS)
    zero = F.lit(0).cast("long")
    return files.where(in_scope("path", profile)).select(
        "repo",
        "path",
        paths.top_dir("path").alias("top"),
        ext.alias("ext"),
        F.col("size").cast("long").alias("bytes"),
        F.when(is_code, text.total_lines("content")).otherwise(zero).alias("lines"),
        F.when(is_code, text.code_lines("content")).otherwise(zero).alias("code"),
        is_code.alias("is_code"),
        ext.isin(*TEXT_ASSET_EXTS).alias("is_asset"),
    )


def _measures() -> list[Column]:
    return [
        F.count("*").alias("files"),
        F.count_if("is_asset").alias("assets"),
        F.count_if("is_code").alias("code_files"),
        F.sum("lines").alias("lines"),
        F.sum("code").alias("code"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.when(F.col("is_code"), F.col("bytes")).otherwise(0)).alias("code_bytes"),
    ]


def totals(sizes: DataFrame) -> DataFrame:
    """One row of totals per repository."""
    return sizes.groupBy("repo").agg(*_measures()).drop("code_files")


def by_language(sizes: DataFrame) -> DataFrame:
    """Code files by extension."""
    return (
        sizes.where("is_code")
        .groupBy("repo", "ext")
        .agg(F.count("*").alias("files"), F.sum("code").alias("code"), F.sum("bytes").alias("bytes"))
    )


def by_top_dir(sizes: DataFrame) -> DataFrame:
    """D3: totals per top directory, with its extension histogram as a map.

    The first aggregation is on (repo, top, ext); the map holds one entry per extension, not per file.
    """
    per_ext = sizes.groupBy("repo", "top", "ext").agg(
        F.count("*").alias("n"), F.sum("lines").alias("lines"), F.sum("code").alias("code"), F.sum("bytes").alias("bytes")
    )
    return per_ext.groupBy("repo", "top").agg(
        F.sum("n").alias("files"),
        F.sum("lines").alias("lines"),
        F.sum("code").alias("code"),
        F.sum("bytes").alias("bytes"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "n")))).alias("exts"),
    )


def extension_histogram(sizes: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent extensions of each repository."""
    counts = sizes.groupBy("repo", "ext").agg(F.count("*").alias("files"))
    return top_k(counts, ["repo"], [F.desc("files"), F.col("ext")], k)


def overview(sizes: DataFrame) -> DataFrame:
    """Totals, by-extension and by-directory rows in one pass; ``level`` tells them apart."""
    grouped = sizes.groupingSets(
        [["repo"], ["repo", "ext"], ["repo", "top"]], F.col("repo"), F.col("ext"), F.col("top")
    ).agg(F.grouping_id().alias("gid"), *_measures())
    level = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "ext").otherwise("top")
    return grouped.select(
        "repo", level.alias("level"), F.coalesce("ext", "top", F.lit("")).alias("key"),
        "files", "assets", "code_files", "lines", "code", "bytes", "code_bytes",
    )


def largest_files(sizes: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` files with most code lines per repository."""
    ranked = top_k(sizes, ["repo"], [F.desc("code"), F.col("path")], k)
    return ranked.select("repo", "rank", "path", "bytes", "lines", "code")


def infer_shape(files: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Per repository, the first profile whose signature directories and files are all present."""
    p = F.col("path")
    probes = {}
    for prof in profiles:
        for d in prof.signature_dirs:
            probes.setdefault(("dir", d), F.bool_or(p.startswith(d + "/")))
        for f in prof.signature_files:
            probes.setdefault(("file", f), F.bool_or(p == f))
    names = {key: f"probe_{i}" for i, key in enumerate(probes)}
    seen = files.groupBy("repo").agg(F.count("*").alias("files"), *[e.alias(names[k]) for k, e in probes.items()])
    choice = None
    for prof in profiles:
        need = [F.col(names["dir", d]) for d in prof.signature_dirs]
        need += [F.col(names["file", f]) for f in prof.signature_files]
        cond = F.lit(True)
        for c in need:
            cond = cond & c
        choice = F.when(cond, prof.name) if choice is None else choice.when(cond, prof.name)
    return seen.select("repo", choice.alias("profile"))


# ------------------------------------------------------------ stray-file report
# fixed values: extension -> category, and the build-output names
CATEGORY_OF = {
    ".py": "source_code", ".js": "source_code", ".ts": "source_code", ".jsx": "source_code", ".tsx": "source_code",
    ".go": "source_code", ".rs": "source_code", ".java": "source_code", ".c": "source_code", ".cpp": "source_code",
    ".h": "source_code", ".cs": "source_code", ".rb": "source_code", ".php": "source_code", ".swift": "source_code",
    ".env": "config", ".yaml": "config", ".yml": "config", ".toml": "config", ".ini": "config", ".cfg": "config",
    ".conf": "config", ".properties": "config",
    ".csv": "data", ".json": "data", ".db": "data", ".sqlite": "data", ".xlsx": "data", ".xls": "data",
    ".parquet": "data",
    ".log": "logs", ".out": "logs",
    ".md": "docs", ".rst": "docs", ".txt": "docs", ".doc": "docs", ".docx": "docs", ".pdf": "docs",
}
BUILD_DIRS = ("__pycache__", "dist", "build", ".venv", "venv", "node_modules", ".next", ".nuxt", "target", "out")
BUILD_SUFFIXES = (".pyc", ".pyo", ".egg-info")


def classify_stray(files: DataFrame) -> DataFrame:
    """Category of each file; build output is recognised by whole path segments."""
    p = F.col("path")
    dirs = "|".join(f"\\Q{d}\\E" for d in BUILD_DIRS)
    is_build = p.rlike(f"(?:^|/)(?:{dirs})(?:/|$)") | p.rlike(r"(?:\.pyc|\.pyo|\.egg-info)(?:/|$)")
    lookup = F.create_map(*[F.lit(x) for kv in CATEGORY_OF.items() for x in kv])
    by_ext = F.coalesce(F.try_element_at(lookup, paths.extension(p)), F.lit("other"))
    return files.select("repo", "path", F.when(is_build, "build_artifacts").otherwise(by_ext).alias("category"))


def stray_counts(classified: DataFrame) -> DataFrame:
    """Files per category."""
    return classified.groupBy("repo", "category").agg(F.count("*").alias("files"))


def ignore_suggestions(classified: DataFrame) -> DataFrame:
    """Distinct ignore patterns for build output, logs and local databases."""
    p = F.col("path")
    build = (
        F.when(p.contains("__pycache__"), F.array(F.lit("__pycache__/")))
        .when(p.rlike(r"\.py[co]$"), F.array(F.lit("*.pyc")))
        .when(p.contains("dist/"), F.array(F.lit("dist/")))
        .when(p.contains("build/"), F.array(F.lit("build/")))
        .when(p.contains("venv/"), F.array(F.lit(".venv/")))
        .when(p.contains("node_modules/"), F.array(F.lit("node_modules/")))
        .when(p.contains(".egg-info"), F.array(F.lit("*.egg-info/")))
    )
    logs = F.when(p.endswith(".log"), F.array(F.lit("*.log"))).when(p.endswith(".out"), F.array(F.lit("*.out")))
    data = F.when(p.rlike(r"\.(?:db|sqlite)$"), F.array(F.lit("*.db"), F.lit("*.sqlite")))
    picked = (
        F.when(F.col("category") == "build_artifacts", build)
        .when(F.col("category") == "logs", logs)
        .when(F.col("category") == "data", data)
    )
    return classified.select("repo", F.explode(picked).alias("pattern")).distinct()
