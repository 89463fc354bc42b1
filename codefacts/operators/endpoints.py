"""Where a route is mounted: prefixes followed through imports and registrar calls."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.functions.ranking import first_per_group
from codefacts.operators.graph import relative_base
from codefacts.profile import APP_LIKE_OWNERS, Profile
from codefacts.session import cut_lineage, materialize


def import_edges(import_facts: DataFrame, file_paths: DataFrame) -> DataFrame:
    """E5, F2: (file, bound name) -> (source file, original name); the first candidate path that exists wins."""
    rows = import_facts.where("kind = 'from' and coalesce(name, '') <> ''")
    dotted = F.when(F.coalesce("module", F.lit("")) != "", F.split("module", r"\.")).otherwise(F.array("name"))
    absolute = F.col("level") == 0
    near = F.concat(F.when(absolute, paths.package_parts("path")).otherwise(relative_base("path", F.col("level"))), dotted)
    # an absolute import means the repository root; the importing directory is the second guess
    bases = F.when(absolute, F.array_distinct(F.array(dotted, near))).otherwise(F.array(near))
    both = F.transform(bases, lambda b: F.array_join(b, "/"))
    candidates = F.flatten(F.transform(both, lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")))))
    order = F.struct(F.coalesce("module", F.lit("")), "level", "name", F.coalesce("alias", F.lit("")))
    tried = rows.select(
        "repo", "path", F.coalesce("alias", "name").alias("var"), F.col("name").alias("src_var"), order.alias("o"),
        F.posexplode(candidates).alias("pos", "src_path"),
    )
    known = file_paths.select("repo", F.col("path").alias("src_path")).distinct()
    hits = tried.join(known.hint("merge"), ["repo", "src_path"])
    best = F.min_by(F.struct("src_path", "src_var"), F.struct("o", "pos")).alias("e")
    return hits.groupBy("repo", "path", "var").agg(best).select("repo", "path", "var", "e.*")


def follow(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Every (file, name) that leads to a target through any number of imports, with the target it leads to.

    Runs backwards from the targets, so only imports that end at one are ever touched. A name has one import edge and a
    target is not followed further, so each (file, name) appears once; a loop of re-exports never reaches a target.
    """
    goals = cut_lineage(targets.select("repo", "path", "var").distinct())
    level = goals.select("repo", "path", "var", F.col("path").alias("hit_path"), F.col("var").alias("hit_var"))
    found = level.withColumn("hops", F.lit(0))
    open_edges = edges.join(goals.hint("merge"), ["repo", "path", "var"], "left_anti")
    for hop in count(1):  # ends: a name has one import edge, so nothing is reached twice
        ahead = level.select("repo", F.col("path").alias("src_path"), F.col("var").alias("src_var"), "hit_path", "hit_var")
        step = open_edges.join(ahead.hint("merge"), ["repo", "src_path", "src_var"]).select("repo", "path", "var", "hit_path", "hit_var")
        level = cut_lineage(step)
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("hops", F.lit(hop)))
    return found


def registrar_bindings(routes: DataFrame, single_calls: DataFrame, bps: DataFrame, edges: DataFrame, bp_follow: DataFrame) -> DataFrame:
    """For routes declared on a parameter of a registrar function, the blueprint passed by the first known call."""
    registrars = routes.where("owner_is_param and registrar is not null").select("repo", "path", F.col("registrar").alias("var"))
    func_follow = follow(edges, registrars).select("repo", "path", F.col("var").alias("f"), "hit_path", "hit_var")
    sites = single_calls.where(F.instr("f", ".") == 0).join(func_follow.hint("merge"), ["repo", "path", "f"])
    sites = sites.where((F.col("path") != F.col("hit_path")) | (F.col("f") == F.col("hit_var")))
    given = bp_follow.select("repo", "path", F.col("var").alias("a"), F.col("hit_path").alias("bp_path"), F.col("hit_var").alias("bp_var"))
    args = sites.join(given.hint("merge"), ["repo", "path", "a"])
    first = F.min_by(F.struct("bp_path", "bp_var"), F.struct("path", "f", "a")).alias("b")
    chosen = args.groupBy("repo", "hit_path", "hit_var").agg(first).select("repo", "hit_path", "hit_var", "b.*")
    info = bps.select("repo", F.col("path").alias("bp_path"), F.col("var").alias("bp_var"), F.col("name").alias("reg_name"),
                      F.col("prefix").alias("reg_prefix"), F.col("prefix_literal").alias("reg_literal"))
    out = chosen.join(info.hint("merge"), ["repo", "bp_path", "bp_var"])
    return out.select("repo", F.col("hit_path").alias("path"), F.col("hit_var").alias("registrar"), "reg_name", "reg_prefix", "reg_literal")


def _join_path(prefix: Column, rule: Column) -> Column:
    base = F.regexp_replace(prefix, "/+$", "")
    whole = F.when(rule == "", base).otherwise(F.concat(base, F.when(rule.startswith("/"), rule).otherwise(F.concat(F.lit("/"), rule))))
    return F.when(whole == "", "/").otherwise(whole)


def resolve_endpoints(routes: DataFrame, bps: DataFrame, single_calls: DataFrame, import_facts: DataFrame,
                      file_paths: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Routes with ``prefix``, ``endpoint_path``, ``bp_name`` and how they were resolved.

    ``resolution`` is one of blueprint, noprefix, imported, registrar, app, default, nonliteral, unresolved. All sides grow with the
    files, and facts pack far below the size of their rows, so they are merged and none is sent through the driver.
    """
    last_bp = first_per_group(bps, ["repo", "path", "var"], [F.desc("seq")])
    edges = materialize(import_edges(import_facts, file_paths))
    bp_follow = follow(edges, last_bp)
    regs = registrar_bindings(routes, single_calls, last_bp, edges, bp_follow)
    owners = bp_follow.join(
        last_bp.select("repo", F.col("path").alias("hit_path"), F.col("var").alias("hit_var"), F.col("name").alias("own_name"),
                       F.col("prefix").alias("own_prefix"), F.col("prefix_literal").alias("own_literal")).hint("merge"),
        ["repo", "hit_path", "hit_var"],
    ).select("repo", "path", F.col("var").alias("bp"), "hit_path", "own_name", "own_prefix", "own_literal")

    rows = routes.join(owners.hint("merge"), ["repo", "path", "bp"], "left").join(regs.hint("merge"), ["repo", "path", "registrar"], "left")
    by_param = F.col("owner_is_param") & F.col("registrar").isNotNull()
    reg_known, own_known = F.col("reg_literal").isNotNull(), F.col("own_literal").isNotNull()
    how = (
        F.when(by_param & ~reg_known, "unresolved")
        .when(by_param, F.when(F.col("reg_literal"), "registrar").otherwise("nonliteral"))
        .when(own_known & ~F.col("own_literal"), "nonliteral")
        .when(own_known & (F.col("hit_path") == F.col("path")), "blueprint")
        .when(own_known, "imported")
        .when(F.col("bp").isin(*APP_LIKE_OWNERS), "app")
    )
    mounted = how.isin("blueprint", "imported", "registrar")
    raw = F.when(by_param, F.col("reg_prefix")).when(own_known, F.col("own_prefix")).when(how == "app", "")
    raw = F.when(mounted | (how == "app"), F.coalesce(raw, F.lit("")))
    segs = paths.segments("path")
    template = profile.default_component_prefix
    inside = F.col("path").startswith(f"{profile.component_dir}/") & (F.size(segs) >= 3) if template and profile.component_dir else F.lit(False)
    below = F.col("path").startswith(f"{profile.component_dir}/") if template and profile.component_dir else F.lit(False)
    bare = mounted & (raw == "")
    prefix = F.when(bare & inside, F.replace(F.lit(template), F.lit("{identifier}"), segs[1])).otherwise(raw)
    kind = F.when(bare & inside, "default").when(bare & ~below, "noprefix").otherwise(how)
    done = rows.withColumn("prefix", prefix).withColumn("resolution", F.coalesce(kind, F.lit("unresolved")))
    usable = F.col("rule_value").isNotNull() & kind.isNotNull() & F.col("prefix").isNotNull()
    name = F.when(by_param, F.col("reg_name")).otherwise(F.col("own_name"))
    done = done.withColumn("bp_name", F.coalesce(name, F.lit("")))
    done = done.withColumn("endpoint_path", F.when(usable, _join_path(F.col("prefix"), F.col("rule_value"))))
    return done.drop("hit_path", "own_name", "own_prefix", "own_literal", "reg_name", "reg_prefix", "reg_literal")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Routes per resolution."""
    return resolved.groupBy("repo", "resolution").agg(F.count("*").alias("routes"))


def prefix_distribution(routes: DataFrame) -> DataFrame:
    """Routes per declared prefix."""
    text = F.regexp_replace("url_prefix", "^['\"]|['\"]$", "")
    key = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("(none)"))
    return routes.groupBy("repo", key.alias("prefix")).agg(F.count("*").alias("routes"))
