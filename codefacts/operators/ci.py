"""CI workflow rules (A8, D33, F4, R26-R33). Input: rows of ``sources.corpus.workflow_files``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import text
from codefacts.functions.matches import match_positions

# ---------------------------------------------------------------- fixed values
ACTION_USE = r"uses:\s+\S+/\S+@([a-f0-9]{40}|\S+)"
SECRET_PATTERNS = {
    "github": (
        r"(?i)(password|passwd|pwd)\s*[:=]\s*['\"]?\w+",
        r"(?i)(secret|token|api_key|apikey)\s*[:=]\s*['\"]?[a-zA-Z0-9_\-]{16,}",
        r"(?i)(access_token)\s*[:=]\s*['\"]?ghp_[a-zA-Z0-9]{36}",
    ),
    "gitee": (
        r"(?i)(password|passwd|pwd)\s*[:=]\s*['\"]?\w+",
        r"(?i)(secret|token|api_key)\s*[:=]\s*['\"]?[a-zA-Z0-9_\-]{16,}",
    ),
}
# ----------------------------------------------------------- end of fixed values

_EMPTY = "array<struct<rule_id:string,severity:string,line:int,message:string>>"


def _finding(rule: str, severity: str, message: str, line: Column | None = None) -> Column:
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), at.alias("line"), F.lit(message).alias("message"))


def _when(cond: Column, finding: Column) -> Column:
    return F.when(cond, F.array(finding)).otherwise(F.array().cast(_EMPTY))


def _unpinned(body: Column) -> Column:
    """Actions not pinned to a full commit hash."""
    uses = F.filter(match_positions(body, ACTION_USE), lambda m: F.length(F.regexp_extract(m["match"], ACTION_USE, 1)) != 40)
    return F.transform(uses, lambda m: _finding("CI001", "warning", "action is not pinned to a commit hash", m["line"]))


def _secrets(body: Column, rule: str, patterns: tuple[str, ...]) -> Column:
    """Per pattern, the first match that is not on a comment line."""
    parts = []
    for pattern in patterns:
        open_ = F.filter(match_positions(body, pattern), lambda m: ~text.strip(m["before"]).startswith("#"))
        parts.append(F.transform(F.slice(open_, 1, 1), lambda m: _finding(rule, "error", "value that looks like a secret", m["line"])))
    return F.concat(*parts)


def workflow_findings(workflows: DataFrame) -> DataFrame:
    """All findings of all workflow files, each evaluated inside its own row."""
    body = F.col("content")
    github = F.concat(
        _unpinned(body),
        _when(body.contains("shell: bash") & ~body.contains("set -e"), _finding("CI002", "warning", "bash without set -e")),
        _secrets(body, "CI003", SECRET_PATTERNS["github"]),
        _when(~body.contains("timeout-minutes"), _finding("CI004", "info", "no timeout-minutes")),
        _when(body.contains("::set-output"), _finding("CI005", "warning", "deprecated set-output command")),
    )
    gitee = F.concat(
        _when(body.contains("registry.npmjs.org"), _finding("GG001", "info", "default package registry")),
        _secrets(body, "GG002", SECRET_PATTERNS["gitee"]),
    )
    found = F.when(F.col("platform") == "github", github).otherwise(gitee)
    return workflows.select("repo", "platform", F.col("path").alias("file"), F.explode(found).alias("f")).select("repo", "platform", "file", "f.*")


def ci_summary(workflows: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per severity for every repository with workflows."""
    repos = workflows.select("repo", "platform").distinct()
    counts = findings.groupBy("repo").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(name) for s, name in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))],
    )
    rows = repos.join(counts, "repo", "left")
    for name in ("total", "errors", "warnings", "infos"):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return rows
