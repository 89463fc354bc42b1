"""Findings of the rule engine."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions import paths, text
from codefacts.functions.ranking import first_per_group, top_k
from codefacts.operators import facts as fx
from codefacts.operators import graph as gr
from codefacts.operators.overview import in_scope
from codefacts.profile import SEMVER_PATTERN, Profile
from codefacts.schemas import FINDINGS

log = logging.getLogger(__name__)

# ---------------------------------------------------------------- fixed values
SECRET_TEXT = r"(?i)(api[_-]?key|secret|token|access[_-]?key|passwd|password)\s*[:=]\s*([\"'])(?!\{|\$\{|<\|%\{)[^\"']{6,}\2"
SQL_TEXT = (
    r"(?Ui)(f[\"'][^\"']*\b(SELECT|INSERT|UPDATE|DELETE)\b[^\"']*[\"'])"
    r"|([\"'][^\"']*\b(SELECT|INSERT|UPDATE|DELETE)\b[^\"']*[\"']\s*[%\+])"
)
PRIVATE_CONNECTIONS = ("psycopg2.connect", "create_engine")
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}
# ----------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class RuleInput:
    """What the rules read: files, parsed facts, component rows, edges, violations, sizes and known roles."""

    files: DataFrame
    py_facts: DataFrame
    components: DataFrame
    routes: DataFrame
    component_edges: DataFrame
    violations: DataFrame
    sizes: DataFrame
    roles: DataFrame | None = None
    profile: Profile = Profile()


def _s(value: Column | str | None) -> Column:
    return F.lit(value).cast("string") if value is None or isinstance(value, str) else value.cast("string")


def _findings(df: DataFrame, rule: str, severity: str, category: str, target: Column, message: Column | str, evidence: Column | str,
              file: Column | None = None, line: Column | None = None) -> DataFrame:
    return df.select(
        "repo", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), target.alias("target"),
        _s(file).alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"),
        _s(message).alias("message"), _s(evidence).alias("evidence"),
    )


def spec_rules(x: RuleInput) -> DataFrame:
    """Manifest conventions of components."""
    comps, ident = x.components, F.col("identifier")
    out = _findings(comps.where("size(capabilities) = 0"), "SPEC002", "error", "spec", ident, "no capabilities", "capabilities=[]")
    out = out.unionByName(_findings(comps.where("coalesce(size(i18n_locales), 0) <= 0"), "SPEC003", "warning", "spec", ident, "no translations", "i18n_locales=[]"))
    out = out.unionByName(_findings(comps.where("coalesce(size(docs), 0) <= 0"), "SPEC004", "warning", "spec", ident, "no documents", "docs=[]"))
    for col in ("version", "min_app_version"):
        bad = comps.where((F.col(col) != "") & ~F.col(col).rlike(SEMVER_PATTERN))
        out = out.unionByName(_findings(bad, "SPEC005", "error", "spec", ident, f"{col} is not X.Y.Z", F.concat(F.lit(f"{col}="), col)))
    if x.roles is not None:
        # a repository without a role catalogue is not judged
        judged = comps.join(x.roles.select("repo").distinct(), "repo", "left_semi").withColumn("role", F.lower(text.strip("agent_role")))
        unknown = judged.where("role <> ''").join(x.roles, ["repo", "role"], "left_anti")
        out = out.unionByName(_findings(unknown, "SPEC001", "error", "spec", ident, "unknown role", F.concat(F.lit("agent_role="), "agent_role")))
    return out


def _component_sources(x: RuleInput) -> DataFrame:
    inside = F.col("path").startswith(x.profile.component_dir + "/") & F.col("path").endswith(".py")
    return x.files.where(inside & in_scope("path", x.profile))


def _inside(df: DataFrame, x: RuleInput) -> DataFrame:
    return df.where(F.col("path").startswith(x.profile.component_dir + "/"))


def _tagged_hits(pattern: str, rule: str, severity: str, message: str) -> Column:
    tags = [F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message")]
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda hit: F.struct(*tags, hit.alias("hit")))


def security_rules(x: RuleInput) -> DataFrame:
    """Secrets and SQL in texts, eval and shell calls in facts."""
    found = []
    for rule, severity, pattern, message in (
        ("SEC001", "error", SECRET_TEXT, "value that looks like a hard-coded secret"),
        ("SEC004", "warning", SQL_TEXT, "SQL put together from strings"),
    ):
        found.append(_tagged_hits(pattern, rule, severity, message))
    texts = _component_sources(x).select("repo", "path", F.explode(F.concat(*found)).alias("f")).select("repo", "path", "f.*")
    out = texts.select(
        "repo", F.col("rule").alias("rule_id"), "severity", F.lit("security").alias("category"), F.col("path").alias("target"), F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("int").alias("line"), "message", text.strip("hit").alias("evidence"),
    )
    name = F.col("name")
    evals = name.isin("eval", "exec")
    shell = name.startswith("subprocess.") & (F.try_element_at("kwargs", F.lit("shell")) == "True")
    calls = _inside(fx.rule_calls(x.py_facts), x).where(evals | shell)
    at = F.concat(name, F.lit("() @L"), F.col("lineno").cast("string"))
    message = F.when(evals, "eval or exec").otherwise("subprocess with shell=True")
    risky = _findings(calls, "", "warning", "security", F.col("path"), message, at, line=F.col("lineno"))
    return out.unionByName(risky.withColumn("rule_id", F.when(F.col("message") == "eval or exec", "SEC002").otherwise("SEC003")))


def architecture_rules(x: RuleInput) -> DataFrame:
    """Layering, component cycles, private connections, admin prefixes."""
    v = x.violations
    out = _findings(v, "ARCH001", "error", "architecture", F.col("module"), F.concat(F.lit("core module imports component "), "imports"),
                    F.concat(F.lit("import "), "imports"), file=F.col("file"))
    cyc = gr.cycles(x.component_edges)
    out = out.unionByName(_findings(cyc, "ARCH002", "error", "architecture", F.col("chain"), F.concat(F.lit("component cycle: "), "chain"), "dependencies form a cycle"))
    calls = _inside(fx.rule_calls(x.py_facts), x).where(F.col("name").isin(*PRIVATE_CONNECTIONS))
    at = F.concat("name", F.lit("() @L"), F.col("lineno").cast("string"))
    out = out.unionByName(_findings(calls, "ARCH003", "warning", "architecture", F.col("path"), "private database connection", at, line=F.col("lineno")))
    return out.unionByName(_admin_prefixes(x))


def _admin_prefixes(x: RuleInput) -> DataFrame:
    """Admin prefixes that do not name their component, one finding per (component, prefix)."""
    routes = _inside(x.routes, x).withColumn("dir", F.get(paths.segments("path"), F.lit(1)))
    prefix = F.regexp_replace(F.trim("url_prefix"), "^['\"]+|['\"]+$", "")
    rows = routes.join(x.components.select("repo", "dir", "identifier"), ["repo", "dir"]).withColumn("prefix", prefix)
    rows = rows.where(F.col("prefix").startswith("/admin"))
    norm = F.concat(F.lit("/"), F.translate(F.regexp_replace("prefix", "^/+|/+$", ""), "-", "_"))
    rows = rows.withColumn("norm", norm)
    by_id, by_dir = F.concat(F.lit("/admin/"), "identifier"), F.concat(F.lit("/admin/"), "dir")
    fits = F.lit(False)
    for allowed in (by_id, by_dir):
        fits = fits | (F.col("norm") == allowed) | F.startswith("norm", F.concat(allowed, F.lit("/")))
    first = first_per_group(rows.where(~fits), ["repo", "identifier", "norm"], [F.col("path"), F.col("lineno")])
    return _findings(first, "ARCH004", "warning", "architecture", F.col("identifier"), F.concat(F.lit("prefix does not name the component: "), "prefix"),
                     F.concat(F.lit("expected "), F.least(by_id, by_dir)), file=F.col("path"))


def complexity_rules(x: RuleInput) -> DataFrame:
    """Long files (all of them) and long functions."""
    big = x.sizes.where(F.col("code") > x.profile.max_file_lines)
    out = _findings(big, "CMP001", "info", "complexity", F.col("path"), F.format_string("%d code lines", "code"), F.format_string("code_lines=%d", "code"))
    spans = _inside(fx.function_spans(x.py_facts), x).withColumn("span", F.col("end_lineno") - F.col("lineno") + 1)
    long_ = spans.where(F.col("span") > x.profile.max_function_lines)
    return out.unionByName(_findings(long_, "CMP002", "info", "complexity", F.col("path"), F.format_string("function %s has %d lines", "name", "span"),
                                     F.format_string("%s() @L%d-%d", "name", "lineno", "end_lineno"), line=F.col("lineno")))


#: The rule registry; each entry maps the input to a findings table
RULES: dict[str, Callable[[RuleInput], DataFrame]] = {
    "spec": spec_rules, "security": security_rules, "architecture": architecture_rules, "complexity": complexity_rules,
}


def run_rules(spark: SparkSession, x: RuleInput, only: list[str] | None = None, rules: dict[str, Callable[[RuleInput], DataFrame]] | None = None) -> DataFrame:
    """Union of all rule sets.

    A rule set whose plan cannot be built gives an error finding for every repository instead, so that no gate passes
    for want of evidence; the others still run. Failures of execution are not caught.
    """
    out = spark.createDataFrame([], FINDINGS)
    for name, rule in (rules or RULES).items():
        if only is None or name in only:
            try:
                out = out.unionByName(rule(x))
            except (PySparkException, Py4JError) as e:
                if not isinstance(e, AnalysisException):
                    raise
                out = out.unionByName(_did_not_run(x, name, e))
            except Exception as e:  # a rule set is a plug-in: whatever it raises while building, the result says so
                out = out.unionByName(_did_not_run(x, name, e))
    return out


def _did_not_run(x: RuleInput, name: str, error: Exception) -> DataFrame:
    log.error("rule set %s did not run: %s", name, error)
    return _findings(x.files.select("repo").distinct(), "ENGINE", "error", "engine", F.lit(name), "rule set did not run", str(error).splitlines()[0] if str(error) else type(error).__name__)


def severity_rank(col: str = "severity") -> Column:
    expr = F.lit(9)
    for name, rank in SEVERITY_RANK.items():
        expr = F.when(F.col(col) == name, rank).otherwise(expr)
    return expr


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, rule, target, file, line."""
    return findings.orderBy("repo", severity_rank(), "rule_id", "target", "file", "line")


def worst(findings: DataFrame, k: int) -> DataFrame:
    """The first ``k`` findings of each repository in that order."""
    order = [severity_rank(), F.col("rule_id"), F.col("target"), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0))]
    return top_k(findings, ["repo"], order, k)


def severity_summary(findings: DataFrame) -> DataFrame:
    """Findings per severity."""
    return findings.groupBy("repo").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK]
    )
