"""Differences between two states: snapshots, audit fingerprints, keyed catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions.ranking import top_k


def _long(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(0).cast("long"))


def _errors(col: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast("array<string>"))


def snapshot_diff(base: DataFrame, cur: DataFrame) -> DataFrame:
    """One full outer join of two snapshots on (repo, kind, entity); one row per entity with all deltas.

    ``status`` is added, removed or common. The views below are filters of this table.
    """
    keys = ["repo", "entity_kind", "entity"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        cols = ["version", "loc_code", "routes", "manifest_errors", "depends_on"]
        return df.select(*keys, F.lit(True).alias(f"{tag}_here"), *[F.col(c).alias(f"{tag}_{c}") for c in cols])

    both = side(base, "base").join(side(cur, "cur"), keys, "full_outer")
    status = F.when(F.col("base_here").isNull(), "added").when(F.col("cur_here").isNull(), "removed").otherwise("common")
    common = status == "common"
    return both.select(
        *keys,
        status.alias("status"),
        F.col("base_version"),
        F.col("cur_version"),
        (common & ~F.col("base_version").eqNullSafe(F.col("cur_version"))).alias("version_changed"),
        _long("base_loc_code").alias("base_loc"),
        _long("cur_loc_code").alias("cur_loc"),
        (_long("cur_loc_code") - _long("base_loc_code")).alias("loc_delta"),
        _long("base_routes").alias("base_routes"),
        _long("cur_routes").alias("cur_routes"),
        (_long("cur_routes") - _long("base_routes")).alias("route_delta"),
        F.array_sort(F.array_except(_errors("cur_manifest_errors"), _errors("base_manifest_errors"))).alias("new_errors"),
        F.array_sort(F.array_except(_errors("base_manifest_errors"), _errors("cur_manifest_errors"))).alias("fixed_errors"),
        F.array_sort(F.array_except(_errors("cur_depends_on"), _errors("base_depends_on"))).alias("deps_added"),
        F.array_sort(F.array_except(_errors("base_depends_on"), _errors("cur_depends_on"))).alias("deps_removed"),
    )


def loc_changes(diff: DataFrame, k: int | None = None) -> DataFrame:
    """Size changes, largest absolute change first; added and removed components count from or to zero."""
    rows = diff.where("entity_kind <> 'frontend' and (loc_delta <> 0 or (status <> 'common' and entity_kind = 'plugins'))")
    rows = rows.select("repo", F.concat_ws("/", "entity_kind", "entity").alias("target"), F.col("base_loc").alias("base"),
                       F.col("cur_loc").alias("cur"), F.col("loc_delta").alias("delta"))
    return top_k(rows, ["repo"], [F.desc(F.abs("delta")), F.col("target")], k)


def frontend_changes(diff: DataFrame) -> DataFrame:
    """Size changes of frontend repositories."""
    rows = diff.where("entity_kind = 'frontend' and loc_delta <> 0")
    return rows.select("repo", F.concat_ws("/", "entity_kind", "entity").alias("target"), F.col("base_loc").alias("base"),
                       F.col("cur_loc").alias("cur"), F.col("loc_delta").alias("delta"))


def route_changes(diff: DataFrame) -> DataFrame:
    """Route count changes of components that exist on both sides and of all modules."""
    rows = diff.where("route_delta <> 0 and (status = 'common' or entity_kind <> 'plugins') and entity_kind <> 'frontend'")
    return rows.select("repo", F.concat_ws("/", "entity_kind", "entity").alias("target"), F.col("base_routes").alias("base"),
                       F.col("cur_routes").alias("cur"), F.col("route_delta").alias("delta"))


def version_changes(diff: DataFrame) -> DataFrame:
    return diff.where("version_changed and entity_kind = 'plugins'").select(
        "repo", "entity", "base_version", "cur_version", "loc_delta", "route_delta"
    )


def manifest_changes(diff: DataFrame) -> DataFrame:
    """Manifest errors that are new and those that are gone (a removed component fixes nothing)."""
    rows = diff.where("entity_kind = 'plugins' and status <> 'removed' and (size(new_errors) > 0 or size(fixed_errors) > 0)")
    return rows.select("repo", "entity", "new_errors", "fixed_errors")


def dependency_changes(diff: DataFrame) -> DataFrame:
    rows = diff.where("entity_kind = 'plugins' and status = 'common' and (size(deps_added) > 0 or size(deps_removed) > 0)")
    return rows.select("repo", "entity", "deps_added", "deps_removed")


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts per repository and whether anything changed."""
    changed = F.expr(
        "loc_delta <> 0 or route_delta <> 0 or version_changed or size(new_errors) > 0 or size(fixed_errors) > 0"
        " or size(deps_added) > 0 or size(deps_removed) > 0 or status <> 'common'"
    )
    return diff.groupBy("repo").agg(
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "removed").alias("removed"),
        F.count_if(F.col("loc_delta") != 0).alias("loc_changed"),
        F.count_if("version_changed").alias("versions_changed"),
        F.sum("loc_delta").alias("loc_delta"),
        F.bool_or(changed).alias("has_changes"),
    )


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Added, removed and changed keys of two tables; ``fields`` names the columns that differ."""
    left = a.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in cols])
    right = b.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in cols])
    both = left.join(right, keys, "full_outer")
    named = [F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in cols]
    fields = F.array_compact(F.array(*named))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(fields) > 0, "changed")
    rows = both.select(*keys, status.alias("status"), fields.alias("fields")).where("status is not null")
    none = F.array().cast("array<string>")
    return rows.withColumn("fields", F.when(F.col("status") == "changed", F.col("fields")).otherwise(none))


def build_snapshot(components: DataFrame, modules: DataFrame, name: str, frontends: DataFrame | None = None) -> DataFrame:
    """The scalars of components, modules and frontends in one long table, no timestamps."""
    none = F.array().cast("array<string>")
    rows = components.select(
        "repo", F.lit("plugins").alias("entity_kind"), F.col("identifier").alias("entity"), "version", "loc_code",
        F.col("route_count").alias("routes"), "manifest_valid", F.array_sort("manifest_errors").alias("manifest_errors"),
        F.array_sort(F.map_keys("depends_on")).alias("depends_on"),
    )

    def plain(df: DataFrame, kind: str, entity: str, routes: Column) -> DataFrame:
        return df.select(
            "repo", F.lit(kind).alias("entity_kind"), F.col(entity).alias("entity"), F.lit(None).cast("string").alias("version"),
            F.col("loc_code"), routes.cast("long").alias("routes"), F.lit(None).cast("boolean").alias("manifest_valid"),
            none.alias("manifest_errors"), none.alias("depends_on"),
        )

    rows = rows.unionByName(plain(modules, "core", "name", F.col("route_count")))
    if frontends is not None:
        rows = rows.unionByName(plain(frontends, "frontend", "root", F.lit(0)))
    return rows.withColumn("snapshot", F.lit(name))


def audit_fingerprint(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """Decision, counts per severity and the sorted distinct rules that hit; bounded by the rule catalogue."""
    rules = findings.groupBy("repo").agg(
        F.sort_array(F.collect_set(F.concat_ws("/", "dimension", "rule_id"))).alias("hit_rules"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("blocking", "major", "minor", "info")],
    )
    joined = verdicts.select("repo", "decision", F.col("blocking").alias("blocking_hits")).join(rules, "repo", "left")
    zero = F.lit(0).cast("long")
    filled = reduce(lambda df, s: df.withColumn(s, F.coalesce(s, zero)), ("blocking", "major", "minor", "info"), joined)
    return filled.withColumn("hit_rules", F.coalesce("hit_rules", F.array().cast("array<string>")))


def fingerprint_diff(base: DataFrame, cur: DataFrame) -> DataFrame:
    """Decision change, rules that appeared or went away, and severity counts on both sides."""
    sevs = ("blocking", "major", "minor", "info")
    cols = ("decision", "hit_rules", *sevs)
    a = base.select("repo", *[F.col(c).alias(f"base_{c}") for c in cols])
    b = cur.select("repo", *[F.col(c).alias(f"cur_{c}") for c in cols])
    both = a.join(b, "repo", "full_outer")
    moved = F.array_compact(F.array(*[
        F.when(_long(f"base_{s}") != _long(f"cur_{s}"),
               F.concat(F.lit(f"{s}:"), _long(f"base_{s}").cast("string"), F.lit("->"), _long(f"cur_{s}").cast("string")))
        for s in sevs
    ]))
    return both.select(
        "repo", "base_decision", "cur_decision",
        (~F.col("base_decision").eqNullSafe(F.col("cur_decision"))).alias("decision_changed"),
        F.array_except(_errors("cur_hit_rules"), _errors("base_hit_rules")).alias("rules_added"),
        F.array_except(_errors("base_hit_rules"), _errors("cur_hit_rules")).alias("rules_removed"),
        moved.alias("severity_changes"),
    )
