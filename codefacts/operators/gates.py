"""Gates: named checks with hits and a pass flag per repository."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.operators import graph as gr
from codefacts.profile import Profile

GATES = ("manifest-invalid", "boundary-violation", "plugin-cycle", "include-cycle", "route-unprefixed", "file-too-large", "findings")


@dataclass(frozen=True)
class GateInput:
    components: DataFrame
    routes: DataFrame
    violations: DataFrame
    component_edges: DataFrame
    file_edges: DataFrame
    sizes: DataFrame
    findings: DataFrame
    profile: Profile = Profile()


def _hits(df: DataFrame, gate: str, target: Column | None, file: Column | None, detail: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("repo", F.lit(gate).alias("gate"), (none if target is None else target).alias("target"), (none if file is None else file).alias("file"), detail.alias("detail"))


def manifest_invalid(x: GateInput) -> DataFrame:
    """Components whose manifest has errors."""
    return _hits(x.components.where("not manifest_valid"), "manifest-invalid", F.col("identifier"), None, F.array_join("manifest_errors", "; "))


def boundary_violation(x: GateInput) -> DataFrame:
    """Core files that import a component."""
    return _hits(x.violations, "boundary-violation", None, F.col("file"), F.concat(F.col("module"), F.lit(" imports "), F.col("imports")))


def plugin_cycle(x: GateInput) -> DataFrame:
    """Cycles of components."""
    return _hits(gr.cycles(x.component_edges), "plugin-cycle", F.col("chain"), None, F.col("chain"))


def include_cycle(x: GateInput) -> DataFrame:
    """Cycles of includes; call edges do not count."""
    found = gr.cycles(x.file_edges.where("kind = 'include'"), self_loops=False)
    return _hits(found, "include-cycle", None, F.get("cycle", F.lit(0)), F.col("chain"))


def route_unprefixed(x: GateInput) -> DataFrame:
    """Component routes whose literal prefix is not the agreed one; prefixes that cannot be told are skipped."""
    pattern = x.profile.route_prefix_pattern
    rows = x.routes.where(F.col("path").startswith(x.profile.component_dir + "/")).withColumn("dir", F.get(paths.segments("path"), F.lit(1)))
    rows = rows.join(x.components.select("repo", "dir", "identifier"), ["repo", "dir"])
    prefix = F.regexp_replace(F.trim("url_prefix"), "^['\"]+|['\"]+$", "")
    if not pattern:
        return _hits(rows.where(F.lit(False)), "route-unprefixed", F.col("identifier"), F.col("path"), prefix)
    rows = rows.withColumn("prefix", prefix)

    def expected(col: str) -> Column:
        return F.replace(F.lit(pattern), F.lit("{identifier}"), F.col(col))

    bare = F.regexp_replace("prefix", "/+$", "")
    bad = rows.where(F.col("prefix").startswith("/") & (bare != expected("identifier")) & (bare != expected("dir")))
    detail = F.concat(F.col("endpoint"), F.lit(" has prefix "), F.col("prefix"), F.lit(", expected "), F.least(expected("identifier"), expected("dir")))
    return _hits(bad, "route-unprefixed", F.col("identifier"), F.col("path"), detail)


def file_too_large(x: GateInput) -> DataFrame:
    """Code files above the line limit."""
    limit = x.profile.max_file_lines
    return _hits(x.sizes.where(F.col("is_code") & (F.col("code") > limit)), "file-too-large", None, F.col("path"), F.format_string(f"%d code lines > {limit}", "code"))


def error_findings(x: GateInput) -> DataFrame:
    """Findings of level error; warnings and notes do not fail a gate."""
    detail = F.concat_ws(" ", "rule_id", "severity", "message")
    return _hits(x.findings.where("severity = 'error'"), "findings", F.col("target"), F.col("file"), detail)


#: U4: the gate registry
BUILDERS: dict[str, Callable[[GateInput], DataFrame]] = {
    "manifest-invalid": manifest_invalid, "boundary-violation": boundary_violation, "plugin-cycle": plugin_cycle, "include-cycle": include_cycle,
    "route-unprefixed": route_unprefixed, "file-too-large": file_too_large, "findings": error_findings,
}


def choose_gates(requested: list[str] | None, profile: Profile = Profile()) -> list[str]:
    """H5: requested gates that the profile has switched on; one asked for by name that it has not is an error."""
    active = [g for g in GATES if g in profile.gates]
    if not requested or "all" in requested:
        return active
    unknown = [g for g in requested if g not in GATES]
    if unknown:
        raise ValueError(f"unknown gates: {', '.join(unknown)}")
    off = [g for g in requested if g not in active]
    if off:
        raise ValueError(f"gates not active in profile {profile.name}: {', '.join(off)}")
    return [g for g in active if g in requested]


def gate_hits(x: GateInput, gates: list[str]) -> DataFrame:
    """All hits of the chosen gates."""
    out = None
    for gate in gates:
        part = BUILDERS[gate](x)
        out = part if out is None else out.unionByName(part)
    return out


def gate_results(repos: DataFrame, hits: DataFrame, gates: list[str]) -> DataFrame:
    """One row per repository and chosen gate; a gate without hits has passed."""
    asked = repos.select("repo").distinct().select("repo", F.explode(F.array(*[F.lit(g) for g in gates])).alias("gate"))
    counts = hits.groupBy("repo", "gate").agg(F.count("*").alias("hits"))
    rows = asked.join(counts, ["repo", "gate"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return rows.withColumn("passed", F.col("hits") == 0)
