"""Script census: signals, category and score of stand-alone scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths, text

# ---------------------------------------------------------------- fixed values
NOISE_DIR = (
    r"(?i)(^|[/\\])(uploads|node_modules|\.venv|venv|__pycache__|site-packages|\.git|"
    r"fixture[^/\\]*|\.pytest_cache|wt-[\w\-]+)([/\\]|$)"
)
ARGUMENTS = r"\bargparse\b|\bfire\b|\bclick\b|sys\.argv"
NETWORK = r"\b(requests|httpx|urllib3|aiohttp|socket|http\.client|paramiko|fabric)\b"
ABSOLUTE_PATH = r"['\"][A-Za-z]:\\\\|['\"]/[A-Za-z0-9_./\-]{6,}|/home/|/var/|/opt/"
HOST = r"\b(\d{1,3}(?:\.\d{1,3}){3}|https?://[\w.\-]+|ssh://[\w.\-]+)\b"
CREDENTIAL = r"(?i)(password|passwd|secret|token|api_?key|access_key)\s*="
DATABASE = r"\b(psycopg2|pymysql|sqlalchemy|sqlite3|redis|pymongo|elasticsearch)\b"
COMMON_MODULES = (
    "ast", "os", "sys", "re", "json", "pathlib", "collections", "datetime", "argparse",
    "subprocess", "typing", "textwrap", "io", "math", "itertools", "hashlib", "csv",
    "statistics", "functools", "enum", "dataclasses", "time", "__future__", "abc", "os.path",
)
CATEGORIES = (
    ("code_analysis", r"分析|扫描|ast|依赖|架构|指标|度量|sloc|热点|bloat|attribution|diff|loc|复杂度|churn"),
    ("test_verify", r"test|verify|retest|assert|regression|探针|冒烟|harness|spotcheck|probe|roundtrip|复测"),
    ("git_repo", r"git|commit|push|pull|sync|remote|repo|branch|changelog"),
    ("report_gen", r"report|dashboard|html|图表|chart|markdown|生成|导出|export|可视化|snapshot|manual"),
    ("deploy_ops", r"deploy|ssh|systemctl|service|运维|部署|重启|supervisor|copy|patchset"),
    ("data_db", r"sql|\bdb\b|database|query|csv|excel|xlsx|pandas|migration|forensic"),
    ("net_probe", r"接口|api|http|curl|health|ping|请求|endpoint|webhook|mcp|rpc"),
    ("patch_tool", r"patch|anchor|apply|replace|convert|迁移|改写|rewrite|stub"),
)
# ----------------------------------------------------------- end of fixed values


def census_files(files: DataFrame) -> DataFrame:
    """Scripts worth a look: not below a noise directory, of any size."""
    return files.where(paths.extension("path").isin(".py") & ~F.col("path").rlike(NOISE_DIR))


def text_signals(files: DataFrame) -> DataFrame:
    """Signals that come from the text alone."""
    body = F.col("content")
    return files.select(
        "repo", "path",
        (text.count_breaks(body) + 1).alias("lines"),
        body.contains("__main__").alias("has_main"),
        F.rlike(body, F.lit(ARGUMENTS)).alias("has_argparse"),
        F.rlike(body, F.lit(NETWORK)).alias("net"),
        F.regexp_count(body, F.lit(ABSOLUTE_PATH)).alias("abs_path"),
        F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(HOST), F.lit(1)))).alias("n_hosts"),
        F.rlike(body, F.lit(CREDENTIAL)).alias("cred"),
        F.rlike(body, F.lit(DATABASE)).alias("db"),
    )


def syntax_signals(py_facts: DataFrame) -> DataFrame:
    """Signals that need the parsed file: errors, functions, doc line, modules beyond the common ones."""
    tops = F.transform("imports.module", lambda m: F.substring_index(m, ".", 1))
    others = F.filter(F.array_distinct(tops), lambda m: (m != "") & ~m.isin(*COMMON_MODULES))
    return py_facts.select(
        "repo", "path", (~F.col("ok")).alias("syntax_error"),
        F.size(F.filter("defs", lambda d: d["kind"] == "def")).alias("funcs"),
        F.coalesce(text.first_line("doc"), F.lit("")).alias("doc"),
        F.array_sort(others).alias("nonstd"),
    )


def category(doc: Column, path: Column) -> Column:
    """C14: the first keyword group that matches the doc line or the path."""
    hay = F.lower(F.concat(doc, F.lit(" "), path))
    expr = None
    for name, pattern in CATEGORIES:
        cond = F.rlike(hay, F.lit(pattern))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("misc")


def _points(cond: Column | str, n: int = 1) -> Column:
    return F.when(F.col(cond) if isinstance(cond, str) else cond, n).otherwise(0)


def score(signals: DataFrame) -> DataFrame:
    """Value, quality, reuse and cost points and their sum."""
    lines, hosts, others, absolute = F.col("lines"), F.col("n_hosts"), F.size("nonstd"), F.col("abs_path")
    value = F.when(lines.between(40, 400), 2).when(lines > 400, 1).otherwise(0) + _points(F.col("funcs") >= 2)
    quality = _points(~F.col("syntax_error")) + _points(F.col("doc") != "") + _points("has_main")
    reuse = (
        F.when(hosts == 0, 2).when(hosts <= 2, 1).otherwise(0) + F.when(others == 0, 2).when(others <= 2, 1).otherwise(0)
        + _points("has_argparse") + _points(absolute <= 2)
    )
    cost = _points(~F.col("net")) + _points(~F.col("db")) + _points(~F.col("cred"))
    rows = signals.withColumn("v", value).withColumn("quality", quality).withColumn("reuse", reuse).withColumn("cost", cost)
    return rows.withColumn("score", F.col("v") + F.col("quality") + F.col("reuse") + F.col("cost"))


def script_census(files: DataFrame, py_facts: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Scored scripts with their category; ``in_registry`` when the file name is a registered id."""
    rows = text_signals(census_files(files)).join(syntax_signals(py_facts), ["repo", "path"])
    rows = score(rows).withColumn("category", category(F.col("doc"), F.col("path")))
    if registry is None:
        return rows.withColumn("in_registry", F.lit(False))
    known = registry.select(F.col("id").alias("stem")).distinct().withColumn("__known", F.lit(True))
    joined = rows.withColumn("stem", paths.stem("path")).join(known, "stem", "left")
    return joined.withColumn("in_registry", F.col("__known").isNotNull()).drop("__known", "stem")


def ranked(census: DataFrame, min_score: int = 6, k: int = 40) -> DataFrame:
    """Best scripts of each repository."""
    from codefacts.functions.ranking import top_k

    return top_k(census.where(F.col("score") >= min_score), ["repo"], [F.desc("score"), F.desc("reuse"), F.col("path")], k)
