"""Dependency graphs: call and include resolution, rollups, cycles, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.functions.ranking import top_k
from codefacts.functions.skew import counted_join, salted_join
from codefacts.operators.contraction import spread  # noqa: F401 - part of this module's interface
from codefacts.operators.cycles import closing_cycles, cycles, strong_components  # noqa: F401 - likewise
from codefacts.session import cut_lineage, grow, materialize


# ------------------------------------------------------------------ name binding
def relative_base(path: Column | str, level: Column) -> Column:
    """Package a relative import starts from: the containing package, ``level - 1`` steps up."""
    parts = paths.package_parts(path)
    keep = F.greatest(F.size(parts) - (level - 1), F.lit(0))
    return F.slice(parts, F.lit(1), keep)


def bindings(import_facts: DataFrame) -> DataFrame:
    """Local name -> dotted source per file. Of several imports of a name, the last in statement order wins."""
    module_parts = F.when(F.coalesce("module", F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split("module", r"\.")
    )
    base = F.when(F.col("level") > 0, F.concat(relative_base("path", F.col("level")), module_parts)).otherwise(module_parts)
    dotted = F.array_join(F.concat(base, F.array("name")), ".")
    is_import = F.col("kind") == "import"
    bound = F.when(is_import, F.coalesce("alias", module_parts[0])).otherwise(F.coalesce("alias", "name"))
    target = F.when(is_import & F.col("alias").isNotNull(), F.col("module")).when(is_import, module_parts[0]).otherwise(dotted)
    order = F.struct("kind", F.coalesce("module", F.lit("")), "level", F.coalesce("name", F.lit("")), F.coalesce("alias", F.lit("")))
    rows = import_facts.select("repo", "path", bound.alias("bind"), target.alias("target"), order.alias("o"))
    return rows.where("bind <> ''").groupBy("repo", "path", "bind").agg(F.max_by("target", "o").alias("target"))


def module_files(file_paths: DataFrame) -> DataFrame:
    """Dotted module name -> file, one file per name."""
    rows = file_paths.select("repo", "path", paths.module_name("path").alias("module"))
    return rows.groupBy("repo", "module").agg(F.min("path").alias("module_path"))


def definitions(classes: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """Symbols a file defines: classes, functions, and methods as ``Class.method``."""
    rows = classes.select("repo", "path", F.col("name").alias("symbol"), F.lit("class").alias("kind")).unionByName(
        functions.select("repo", "path", F.col("name").alias("symbol"), F.lit("function").alias("kind"))
    )
    named = F.concat_ws(".", "class_name", "name")
    return rows.unionByName(methods.select("repo", "path", named.alias("symbol"), F.lit("method").alias("kind"))).distinct()


def _few_files(defs: DataFrame) -> DataFrame:
    """Per symbol, its defining files if there are at most two; more can never be unique, so none are kept."""
    agg = defs.groupBy("repo", "symbol").agg(
        F.count_distinct("path").alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi")
    )
    files = F.when(F.col("n") == 1, F.array("lo")).when(F.col("n") == 2, F.array("lo", "hi"))
    return agg.select("repo", "symbol", files.alias("files"))


def resolve_calls(calls: DataFrame, import_facts: DataFrame, defs: DataFrame, file_paths: DataFrame) -> DataFrame:
    """The file that defines each call target, where that can be told.

    A: the first name is an import: the longest prefix of its source that is a module defining the target, else the only
    other file that defines it. B: the file itself. C: for a bare name, the only file that defines it. Ambiguous targets
    resolve to nothing. Resolution depends on (file, target) only, so callers are dropped first and joined back last.
    """
    targets = calls.where("target <> '' and not startswith(target, '<expr>')").select("repo", "path", "target").distinct()
    segs = F.split("target", r"\.")
    targets = targets.select(
        "repo", "path", "target", segs[0].alias("bind"), F.element_at(segs, -1).alias("last"),
        F.array_join(F.slice(segs, F.greatest(F.size(segs) - 1, F.lit(1)), F.lit(2)), ".").alias("dotted"),
        (F.size(segs) == 1).alias("bare"),
    )
    binds = bindings(import_facts).withColumnRenamed("target", "source")
    named = materialize(targets.join(binds, ["repo", "path", "bind"], "left"), true_size=True)
    key = ["repo", "path", "target"]

    # A: module prefixes, longest first, that exist and define the target
    steps = named.where("source is not null").select(*key, "last", "dotted", F.posexplode(paths.dotted_prefixes("source")).alias("pos", "module"))
    in_module = steps.join(module_files(file_paths), ["repo", "module"])
    wanted = in_module.select(*key, "pos", "module_path", F.explode(F.array_distinct(F.array("last", "dotted"))).alias("symbol"))
    own = defs.select("repo", F.col("path").alias("module_path"), "symbol").distinct()
    by_import = wanted.join(own, ["repo", "module_path", "symbol"]).groupBy(*key).agg(F.min_by("module_path", "pos").alias("a_file"))

    # B: defined in the calling file
    local = named.where("source is null").select(*key, F.explode(F.array_distinct(F.array("last", "dotted"))).alias("symbol"))
    by_self = local.join(defs.select("repo", "path", "symbol").distinct(), ["repo", "path", "symbol"]).select(*key).distinct()
    by_self = by_self.withColumn("b_file", F.col("path"))

    # unique definitions of the last name and of the last two: one join by symbol; a common name may be the target of a third of all calls
    few = _few_files(defs).withColumn("known", F.lit(True))
    symbols = named.select(*key, "last", "bare", F.col("source").isNotNull().alias("bound"), F.explode(F.array_distinct(F.array("last", "dotted"))).alias("symbol"))
    met = counted_join(symbols, few, ["repo", "symbol"], ["path", "target"], "left")
    pooled = met.groupBy(*key).agg(
        F.bool_or("bare").alias("bare"), F.bool_or("bound").alias("bound"), F.bool_or(F.col("known") & F.col("files").isNull()).alias("too_many"),
        F.array_distinct(F.flatten(F.collect_list("files"))).alias("pool"), F.max(F.when(F.col("symbol") == F.col("last"), F.col("files"))).alias("last_files"),
    )
    found = pooled.join(by_import, key, "left").join(by_self, key, "left")
    others = F.array_except("pool", F.array("path"))
    unique_other = F.when(~F.coalesce("too_many", F.lit(False)) & (F.size(others) == 1), others[0])
    unique_bare = F.when(F.col("bare") & (F.size("last_files") == 1), F.get("last_files", F.lit(0)))
    dest = F.when(F.col("bound"), F.coalesce("a_file", unique_other)).otherwise(F.coalesce("b_file", unique_bare))
    resolved = found.select(*key, dest.alias("dst_path")).where("dst_path is not null")
    return calls.join(resolved, key).select("repo", "path", "caller", "target", "dst_path")


# ------------------------------------------------------------------ includes
def resolve_includes(includes: DataFrame, file_paths: DataFrame) -> DataFrame:
    """Local includes -> file: the exact path, else the only path that ends with it, else the only equal file name.

    Every path suffix becomes a key, so "ends with" is an equi join. A suffix shared by many files collapses to a count. All sides
    grow with the files, and sizes of aggregates are guessed too small, so none is sent through the driver.
    """
    suffixes = file_paths.select("repo", "path", F.explode(paths.path_suffixes("path")).alias("suffix"))
    unique = suffixes.groupBy("repo", "suffix").agg(
        F.count_distinct("path").alias("n"), F.min("path").alias("hit"), F.max((F.col("path") == F.col("suffix"))).alias("whole")
    )
    targets = includes.where(~F.col("system")).select(
        "repo", "path", "target", F.regexp_replace(paths.posix(F.trim("target")), r"^[./]+", "").alias("clean")
    ).where("clean <> ''")
    wanted = targets.select("repo", "clean").distinct().withColumn("base", paths.basename("clean"))
    exact = unique.select("repo", F.col("suffix").alias("clean"), "n", "hit", "whole")
    named = unique.where("n = 1").select("repo", F.col("suffix").alias("base"), F.col("hit").alias("base_hit"))
    joined = wanted.join(exact.hint("merge"), ["repo", "clean"], "left").join(named.hint("merge"), ["repo", "base"], "left")
    dest = F.when(F.col("whole"), F.col("clean")).when(F.col("n") == 1, F.col("hit")).otherwise(F.col("base_hit"))
    found = joined.select("repo", "clean", dest.alias("dst_path"))
    # one header may be the target of a third of all includes
    return salted_join(targets, found.hint("merge"), ["repo", "clean"], ["path"], "left").select("repo", "path", "target", "dst_path")


# ------------------------------------------------------------------ rollups
def symbol_edges(resolved: DataFrame) -> DataFrame:
    """Caller symbol -> callee symbol with the number of distinct call spellings; no self edges."""
    src = F.concat_ws("::", "path", "caller")
    dst = F.concat_ws("::", "dst_path", F.element_at(F.split("target", r"\."), -1))
    rows = resolved.select("repo", src.alias("src"), dst.alias("dst"), F.col("path").alias("src_path"), "dst_path")
    return rows.where("src <> dst").groupBy("repo", "src", "dst", "src_path", "dst_path").agg(F.count("*").alias("weight"))


def file_edges(symbol_edge_rows: DataFrame, include_rows: DataFrame | None = None) -> DataFrame:
    """File -> file edges; ``kind`` keeps calls and includes apart."""
    calls = symbol_edge_rows.where("src_path <> dst_path").select(
        "repo", F.lit("call").alias("kind"), F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), "weight"
    )
    if include_rows is not None:
        inc = include_rows.where("dst_path is not null and dst_path <> path").select(
            "repo", F.lit("include").alias("kind"), F.col("path").alias("src"), F.col("dst_path").alias("dst"),
            F.lit(1).cast("long").alias("weight"),
        )
        calls = calls.unionByName(inc)
    return calls.groupBy("repo", "kind", "src", "dst").agg(F.sum("weight").alias("weight"))


def owner_edges(file_edge_rows: DataFrame, component_dir: str = "plugins") -> DataFrame:
    """Files contracted to their owners; edges inside an owner vanish."""
    rows = file_edge_rows.select(
        "repo", paths.owner("src", component_dir).alias("src"), paths.owner("dst", component_dir).alias("dst"), "weight"
    )
    return rows.where("src <> dst").groupBy("repo", "src", "dst").agg(F.sum("weight").alias("weight"))


def heaviest_edges(edges: DataFrame, k: int | None = None) -> DataFrame:
    """Edges ranked by weight within each repository; only the ``k`` heaviest if given."""
    return top_k(edges, ["repo"], [F.desc("weight"), F.col("src"), F.col("dst")], k)


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours and weights in and out, from one aggregation over both edge ends."""
    pairs = edges.groupBy("repo", "src", "dst").agg(F.sum("weight").alias("weight"))
    one = F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("node"), one.alias("out_deg"), none.alias("in_deg"), F.col("weight").alias("out_w"), none.alias("in_w")),
            F.struct(F.col("dst").alias("node"), none.alias("out_deg"), one.alias("in_deg"), none.alias("out_w"), F.col("weight").alias("in_w")),
        )
    )
    rows = pairs.select("repo", ends.alias("e")).select("repo", "e.*")
    return rows.groupBy("repo", "node").agg(*[F.sum(c).alias(c) for c in ("in_deg", "out_deg", "in_w", "out_w")])


def node_table(symbol_edge_rows: DataFrame, defs: DataFrame, component_dir: str = "plugins") -> DataFrame:
    """Nodes of the symbol graph with file, owner, kind and number of uses."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("id"), F.col("src_path").alias("file"), F.col("weight").alias("uses")),
            F.struct(F.col("dst").alias("id"), F.col("dst_path").alias("file"), F.col("weight").alias("uses")),
        )
    )
    nodes = symbol_edge_rows.select("repo", ends.alias("e")).select("repo", "e.*").groupBy("repo", "id", "file").agg(F.sum("uses").alias("uses"))
    nodes = nodes.withColumn("symbol", F.substr("id", F.length("file") + 3))
    last = F.element_at(F.split("symbol", r"\."), -1)
    rank = F.expr("case kind when 'function' then 0 when 'class' then 1 else 2 end")
    kinds = defs.groupBy("repo", F.col("path").alias("file"), "symbol").agg(F.min_by("kind", rank).alias("kind"))
    nodes = nodes.withColumn("last", last)
    by_last = kinds.select("repo", "file", F.col("symbol").alias("last"), F.col("kind").alias("k1"))
    by_full = kinds.select("repo", "file", "symbol", F.col("kind").alias("k2"))
    joined = nodes.join(by_last, ["repo", "file", "last"], "left").join(by_full, ["repo", "file", "symbol"], "left")
    return joined.select(
        "repo", "id", "file", "symbol", paths.owner("file", component_dir).alias("owner"),
        F.coalesce("k1", "k2", F.lit("symbol")).alias("kind"), "uses",
    )


def graph_stats(file_paths: DataFrame, symbol_edge_rows: DataFrame, file_edge_rows: DataFrame, owner_edge_rows: DataFrame) -> DataFrame:
    """Sizes of the graph per repository."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("repo").agg(F.count("*").alias(name))

    stats = count(file_paths, "files")
    for df, name in ((symbol_edge_rows, "edges_total"), (file_edge_rows, "file_edges"), (owner_edge_rows, "owner_edges")):
        stats = stats.join(count(df, name), "repo", "left")
    for name in ("edges_total", "file_edges", "owner_edges"):
        stats = stats.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return stats


def mark_violations(rows: DataFrame, node: str, violations: DataFrame) -> DataFrame:
    """Flag nodes (owners or files) that occur in a violation."""
    marked = violations.select("repo", F.col("node").alias(node)).distinct().withColumn("__hit", F.lit(True))
    return rows.join(marked, ["repo", node], "left").withColumn("violation", F.col("__hit").isNotNull()).drop("__hit")


def core_subgraph(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the ``k`` nodes of highest degree of each repository."""
    rank = degrees(edges).withColumn("degree", F.col("in_deg") + F.col("out_deg"))
    kept = top_k(rank, ["repo"], [F.desc("degree"), F.col("node")], k).select("repo", "node")
    inner = edges.join(kept.withColumnRenamed("node", "src"), ["repo", "src"], "left_semi")
    return inner.join(kept.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_semi").select(*edges.columns)


def ego_network(edges: DataFrame, node: str) -> DataFrame:
    """Edges into and out of one node."""
    return edges.where((F.col("src") == node) | (F.col("dst") == node)).withColumn(
        "direction", F.when(F.col("src") == node, "out").otherwise("in")
    )


# ------------------------------------------------------------------ reachability
def reachable(starts: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """I4: nodes reachable from each start, the start included, with the least number of hops.

    ``starts`` has ``repo, start, node``. One frontier join per hop; visited nodes never re-enter, so cycles end.
    """
    seen = cut_lineage(starts.select("repo", "start", "node").distinct().withColumn("hops", F.lit(0)))
    frontier, hop = seen, 0
    steps = edges.select("repo", F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    while (max_hops is None or hop < max_hops) and not frontier.isEmpty():
        hop += 1
        nxt = frontier.join(steps, ["repo", "node"]).select("repo", "start", F.col("next").alias("node")).distinct()
        frontier = cut_lineage(nxt.join(seen, ["repo", "start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = grow(seen, frontier, hop)
    return seen
