"""Audit: findings of all providers, coverage and release verdict."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions.skew import salted_join
from codefacts.operators import facts as fx
from codefacts.operators import matching as mt
from codefacts.operators.overview import in_scope
from codefacts.profile import Profile

# ---------------------------------------------------------------- fixed values
DIMENSIONS = ("security", "architecture", "quality", "ai_business")
SEVERITY_RANK = {"info": 0, "minor": 1, "major": 2, "blocking": 3}
CI_SEVERITY = {"error": "blocking", "warning": "minor", "info": "info"}
ANNOTATION_LEVEL = {"blocking": "error", "major": "warning", "minor": "warning", "info": "notice"}
#: gate -> rule id, dimension, severity, title
GATE_RULES = {
    "manifest-invalid": ("ARC001", "architecture", "blocking", "invalid component manifest"),
    "boundary-violation": ("ARC002", "architecture", "blocking", "core module imports a component"),
    "plugin-cycle": ("ARC003", "architecture", "major", "components depend on each other in a cycle"),
    "route-unprefixed": ("ARC004", "architecture", "major", "component route without the agreed prefix"),
    "file-too-large": ("QLT001", "quality", "minor", "file with too many code lines"),
}
#: rules only an outside reviewer can judge: id -> dimension, severity, title
EXTERNAL_RULES = {
    "AIB002": ("ai_business", "major", "configuration is written and read in different places"),
    "AIB004": ("ai_business", "major", "a rule that can be configured is not read at run time"),
    "SEC004": ("security", "major", "sensitive endpoint without an access check"),
}
LONG_FUNCTION = 80
# ----------------------------------------------------------- end of fixed values


def _lookup(col: Column | str, table: dict[str, str], default: str | None = None) -> Column:
    key = F.col(col) if isinstance(col, str) else col
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


# ------------------------------------------------------------------ syntax checks
def _measure(check: str, lineno: Column, amount: Column, snippet: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), lineno.cast("long").alias("lineno"), amount.cast("long").alias("amount"), snippet.alias("snippet"))


def _handlers(check: str, wanted: Callable[[Column], Column], snippet: str) -> Column:
    return F.transform(F.filter("handlers", wanted), lambda h: _measure(check, h["lineno"], F.lit(None), F.lit(snippet)))


def _only_passes(h: Column) -> Column:
    return (F.size(h["body"]) == 1) & (F.get(h["body"], F.lit(0)) == "Pass")


def _returns_silently(h: Column) -> Column:
    """Returns a constant or literal and neither uses nor re-raises the error."""
    literal = F.exists(h["returns"], lambda kind: kind.isin("Constant", "List", "Dict", "Tuple"))
    uses_error = h["caught"].isNotNull() & F.array_contains(h["names"], h["caught"])
    return literal & ~uses_error & ~F.array_contains(h["body"], F.lit("Raise"))


def _spans() -> Column:
    length = lambda d: d["end_lineno"] - d["lineno"]
    return F.transform(
        F.filter("defs", lambda d: d["kind"] == "def"),
        lambda d: _measure("long_function", d["lineno"], length(d), F.format_string("def %s() has %d lines", d["name"], length(d))),
    )


def _unused() -> Column:
    """H3: names bound by top-level imports, except the used and the exported ones."""
    top = F.filter(
        "imports",
        lambda i: i["top"] & ~((i["kind"] == "from") & (F.coalesce(i["module"], F.lit("")) == "__future__")) & (F.coalesce(i["name"], F.lit("")) != "*"),
    )
    first_part = lambda i: F.substring_index(i["module"], ".", 1)
    bound = F.transform(top, lambda i: F.struct(F.coalesce(i["alias"], i["name"], first_part(i)).alias("name"), i["lineno"].alias("lineno")))
    # of several imports of a name, the last one is its binding
    names = F.array_except(F.array_distinct(F.transform(bound, lambda b: b["name"])), F.array_union(F.col("used"), fx.exported("listed")))
    last = lambda n: F.element_at(F.filter(bound, lambda b: b["name"] == n), -1)["lineno"]
    return F.transform(names, lambda n: _measure("unused_imports", last(n), F.lit(None), F.concat(F.lit("unused import "), n)))


#: Named checks: what each one measures in the row of a parsed file
AST_CHECKS: dict[str, Callable[[], Column]] = {
    "bare_except": lambda: _handlers("bare_except", _only_passes, "except ...: pass"),
    "except_return_fallback": lambda: _handlers("except_return_fallback", _returns_silently, "except returns a constant"),
    "long_function": _spans,
    "unused_imports": _unused,
}
#: rule id -> dimension, severity, confidence, title, check
BUILTIN_AST_RULES = (
    ("QLT002", "quality", "minor", "high", "swallowed exception", "bare_except"),
    ("QLT003", "quality", "minor", "high", "long function", "long_function"),
    ("QLT004", "quality", "info", "medium", "unused import", "unused_imports"),
    ("AIB001", "ai_business", "major", "medium", "fallback value hides the cause", "except_return_fallback"),
)


def measures(py_facts: DataFrame, checks: tuple[str, ...] = tuple(AST_CHECKS)) -> DataFrame:
    """Repo, path, check, lineno, amount and snippet: all that the checks measure, in one pass over the files.

    ``amount`` is what a threshold is compared with; null where a check only says that something is there.
    """
    rows = py_facts.where("ok").select("repo", "path", F.explode(F.concat(*[AST_CHECKS[c]() for c in checks])).alias("m"))
    return rows.select("repo", "path", "m.*")


def _reaches(amount: Column, threshold: Column) -> Column:
    """No threshold, or 0, stands for the default."""
    return amount.isNull() | (amount >= F.coalesce(F.when(threshold != 0, threshold), F.lit(LONG_FUNCTION)))


def ast_check(py_facts: DataFrame, check: str, threshold: int | None = None) -> DataFrame:
    """The hits of one check: repo, path, lineno and snippet."""
    return measures(py_facts, (check,)).where(_reaches(F.col("amount"), F.lit(threshold).cast("int"))).select("repo", "path", "lineno", "snippet")


def bare_except(py_facts: DataFrame) -> DataFrame:
    """Handlers that only pass."""
    return ast_check(py_facts, "bare_except")


def except_return_fallback(py_facts: DataFrame) -> DataFrame:
    """Handlers that return a constant or literal and neither use nor re-raise the error."""
    return ast_check(py_facts, "except_return_fallback")


def long_function(py_facts: DataFrame, threshold: int | None = LONG_FUNCTION) -> DataFrame:
    """Functions that span ``threshold`` lines or more."""
    return ast_check(py_facts, "long_function", threshold)


def unused_imports(py_facts: DataFrame) -> DataFrame:
    """Top-level imports whose name is neither used nor exported."""
    return ast_check(py_facts, "unused_imports")


_RULE_COLUMNS = ("rule_id", "dimension", "severity", "title", "confidence")


def builtin_ast_hits(measured: DataFrame) -> DataFrame:
    """What the built-in rules find in a table of measures; a constant of the plan, nothing is joined."""
    rules = F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(rule).alias("rule_id"), F.lit(dim).alias("dimension"), F.lit(sev).alias("severity"), F.lit(title).alias("title"), F.lit(conf).alias("confidence"))
        for rule, dim, sev, conf, title, check in BUILTIN_AST_RULES
    ])
    hits = measured.where(_reaches(F.col("amount"), F.lit(None).cast("int")))
    rows = hits.select("repo", "path", "lineno", "snippet", F.explode(F.filter(rules, lambda r: r["check"] == F.col("check"))).alias("r"))
    return rows.select("repo", "path", "lineno", "snippet", *[F.col(f"r.{c}").alias(c) for c in _RULE_COLUMNS])


def repo_ast_hits(measured: DataFrame, repo_rules: DataFrame) -> DataFrame:
    """What rules of type ``ast`` of a repository find in its own measures, each with its own threshold.

    A rule table is joined with the measures on (repo, check), so a file is measured once however many rules ask. Rules with
    an unknown check find nothing.
    """
    rules = repo_rules.where(F.col("matcher") == "ast").where(F.col("check").isin(*AST_CHECKS)).select(
        "repo", "check", "threshold", "rule_id", "dimension", "severity", "title", F.coalesce("confidence", F.lit("high")).alias("confidence")
    )
    rows = salted_join(measured, rules, ["repo", "check"], ["path", "lineno"]).where(_reaches(F.col("amount"), F.col("threshold")))
    return rows.select("repo", "path", "lineno", "snippet", *_RULE_COLUMNS)


def _audit_rows(df: DataFrame, rule: Column, dim: Column, sev: Column, title: Column, provider: str, confidence: Column, coverage: str = "rule_only") -> DataFrame:
    return df.select(
        "repo", rule.alias("rule_id"), dim.alias("dimension"), sev.alias("severity"), title.alias("title"), F.lit(provider).alias("provider"),
        F.lit(coverage).alias("coverage"), "file", F.col("line").cast("int").alias("line"), "snippet", confidence.alias("confidence"),
    )


def scanner_findings(files: DataFrame, py_facts: DataFrame, profile: Profile = Profile(), repo_rules: DataFrame | None = None,
                     line_rules: tuple[mt.LineRule, ...] = mt.BUILTIN_LINE_RULES) -> DataFrame:
    """Line rules over code files and syntax checks over their facts, built in and brought along by a repository.

    Rules whose pattern does not compile find nothing here; ``matching.rejected_rules`` names them.
    """
    sources = mt.code_files(files.where(in_scope("path", profile)))
    hits = mt.line_rule_hits(sources, line_rules)
    if repo_rules is not None:
        hits = hits.unionByName(mt.repo_rule_hits(sources, repo_rules))
    lines = hits.select("repo", "path", F.col("line_no").alias("lineno"), "snippet", *_RULE_COLUMNS)
    measured = measures(py_facts)
    lines = lines.unionByName(builtin_ast_hits(measured))
    if repo_rules is not None:
        lines = lines.unionByName(repo_ast_hits(measured, repo_rules))
    rows = lines.withColumnRenamed("path", "file").withColumnRenamed("lineno", "line")
    return _audit_rows(rows, F.col("rule_id"), F.col("dimension"), F.col("severity"), F.col("title"), "scanner", F.col("confidence"))


def gate_findings(hits: DataFrame) -> DataFrame:
    """Gate hits as audit findings; gates without an audit rule stay gates."""
    col = lambda i: _lookup("gate", {g: r[i] for g, r in GATE_RULES.items()})
    rows = hits.where(F.col("gate").isin(*GATE_RULES)).select(
        "repo", "gate", F.coalesce("target", "file").alias("file"), F.lit(None).alias("line"), F.col("detail").alias("snippet")
    )
    return _audit_rows(rows, col(0), col(1), col(2), col(3), "gate", F.lit("high"))


def ci_findings(findings: DataFrame) -> DataFrame:
    """Workflow findings as audit findings."""
    rows = findings.withColumn("snippet", F.col("message"))
    return _audit_rows(rows, F.col("rule_id"), F.lit("architecture"), _lookup("severity", CI_SEVERITY, "info"), F.col("message"), "ci", F.lit("high"))


def external_findings(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(findings, rejects)`` of findings written elsewhere: the rule must be known and a file named.

    ``items``: repo, seq, rule_id, file, line, severity, title, why, confidence.
    """
    known = F.col("rule_id").isin(*EXTERNAL_RULES)
    reason = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown rule "), F.coalesce("rule_id", F.lit("null")))).when(
        F.coalesce("file", F.lit("")) == "", F.concat(F.col("rule_id"), F.lit(": no file given"))
    )
    judged = items.withColumn("reason", reason)
    pick = lambda i: _lookup("rule_id", {r: v[i] for r, v in EXTERNAL_RULES.items()})
    good = judged.where("reason is null").withColumn("snippet", F.coalesce("why", F.lit(""))).withColumn("file", F.translate("file", "\\", "/"))
    rows = _audit_rows(good, F.col("rule_id"), pick(0), F.coalesce("severity", pick(1)), F.coalesce("title", pick(2)), "external",
                       F.coalesce("confidence", F.lit("medium")), coverage="semantic")
    return rows, judged.where("reason is not null").select("repo", "seq", "rule_id", "reason")


# ------------------------------------------------------------------ coverage and verdict
def audit_summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and by dimension in one pass over grouping sets."""
    sets = findings.groupingSets([["repo", "severity"], ["repo", "dimension"]], "repo", "severity", "dimension").agg(F.count("*").alias("findings"))
    by_sev = F.col("severity").isNotNull()
    return sets.select("repo", F.when(by_sev, "severity").otherwise("dimension").alias("kind"), F.coalesce("severity", "dimension").alias("key"), "findings")


def of_dimensions(findings: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """The findings of some dimensions; give the same ``dims`` to ``coverage``, and the verdict judges only those."""
    unknown = [d for d in dims if d not in DIMENSIONS]
    if unknown or not dims:
        raise ValueError(f"unknown dimensions: {', '.join(unknown) or 'none given'}")
    return findings.where(F.col("dimension").isin(*dims))


def coverage(repos: DataFrame, findings: DataFrame, dims: tuple[str, ...] = DIMENSIONS, rule_dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Per repository, dimension and channel: did it run, and how many findings.

    The rule channel ran for every dimension with a deterministic check; the external one where it delivered something.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("channel")) for d in dims for c in ("rule_only", "semantic")])
    matrix = repos.select("repo").distinct().select("repo", F.explode(pairs).alias("p")).select("repo", "p.*")
    counts = findings.groupBy("repo", "dimension", F.col("coverage").alias("channel")).agg(F.count("*").alias("findings"))
    rows = matrix.join(counts, ["repo", "dimension", "channel"], "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("long")))
    ran = F.when(F.col("channel") == "rule_only", F.col("dimension").isin(*rule_dims)).otherwise(F.col("findings") > 0)
    reason = F.when(ran, "").when(F.col("channel") == "rule_only", "no deterministic check").otherwise("no external findings")
    return rows.select("repo", "dimension", "channel", ran.alias("ran"), "findings", reason.alias("reason"))


def verdict(matrix: DataFrame, findings: DataFrame, fail_on: str = "blocking", external_blocks: bool = False) -> DataFrame:
    """Releasable unless a finding reaches the threshold or a dimension had no channel at all."""
    rank = reduce(lambda e, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(e), SEVERITY_RANK.items(), F.lit(0))
    counts_in = F.col("coverage") == "rule_only"
    if external_blocks:
        counts_in = F.lit(True)
    blocking = findings.groupBy("repo").agg(F.count_if((rank >= SEVERITY_RANK[fail_on]) & counts_in).alias("blocking"))
    per_dim = matrix.groupBy("repo", "dimension").agg(F.bool_or("ran").alias("ran"))
    weak = per_dim.groupBy("repo").agg(F.sort_array(F.collect_list(F.when(~F.col("ran"), F.col("dimension")))).alias("insufficient"))
    rows = weak.join(blocking, "repo", "left").withColumn("blocking", F.coalesce("blocking", F.lit(0).cast("long")))
    bad = (F.col("blocking") > 0) | (F.size("insufficient") > 0)
    reasons = F.array_compact(F.array(
        F.when(F.col("blocking") > 0, F.format_string(f"%d findings at or above {fail_on}", "blocking")),
        F.when(F.size("insufficient") > 0, F.concat(F.lit("no evidence for: "), F.array_join("insufficient", ", "))),
    ))
    return rows.select("repo", F.when(bad, "not_releasable").otherwise("releasable").alias("decision"), "blocking", "insufficient", reasons.alias("reasons"))


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow annotation lines, one per finding."""
    where = F.when(F.col("file").isNotNull(), F.concat(F.lit(" file="), F.col("file"), F.coalesce(F.concat(F.lit(",line="), F.col("line").cast("string")), F.lit("")))).otherwise("")
    line = F.concat(F.lit("::"), _lookup("severity", ANNOTATION_LEVEL, "notice"), where, F.lit("::["), F.col("rule_id"), F.lit("/"), F.col("dimension"), F.lit("] "),
                    F.translate("title", "\n", " "))
    return findings.select("repo", line.alias("value"))


def verdict_annotations(verdicts: DataFrame) -> DataFrame:
    """The closing annotation line of each repository."""
    blocked = F.format_string("::error::audit verdict: not releasable (%d blocking)", "blocking")
    return verdicts.select("repo", F.when(F.col("decision") == "releasable", "::notice::audit verdict: releasable").otherwise(blocked).alias("value"))
