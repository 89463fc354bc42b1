"""Cycles of directed graphs by strongly connected components.

All state is a row for each node or edge, never one for each pair of nodes. Straight stretches (nodes with one edge in and one
out) are contracted by pointer doubling, so a ring or a line of n nodes takes about log2(n) rounds. On what is left, smallest
labels run forward and marks run back from the nodes that kept their own label; what both reach is a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators.contraction import contract, materialize, straight

_NODE = ["repo", "node"]


def _trim(edges: DataFrame) -> DataFrame:
    """Edges left after dropping, again and again, nodes without an edge in or out."""
    rest, left = edges, edges.count()
    while left:
        has_in = rest.select("repo", F.col("dst").alias("src")).distinct()
        has_out = rest.select("repo", F.col("src").alias("dst")).distinct()
        kept = materialize(rest.join(has_in, ["repo", "src"], "left_semi").join(has_out, ["repo", "dst"], "left_semi").select(*edges.columns))
        rest, now = kept, kept.count()
        if now == left:
            break
        left = now
    return rest


def _colour(edges: DataFrame) -> DataFrame:
    """node and label: nodes of one strongly connected component have one label, if it has several nodes."""
    members, rest = None, _trim(edges)
    while not rest.isEmpty():
        start = rest.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct()
        labels = start.select(*_NODE, F.col("node").alias("label"), F.lit(True).alias("new"))
        while True:  # the smallest node from which each one is reached
            told = labels.where("new").join(rest.withColumnRenamed("src", "node"), _NODE).groupBy("repo", F.col("dst").alias("node")).agg(F.min("label").alias("told"))
            heard = labels.select(*_NODE, "label").join(told, _NODE, "left")
            labels = materialize(heard.select(*_NODE, F.least("label", "told").alias("label"), F.coalesce(F.col("told") < F.col("label"), F.lit(False)).alias("new")))
            if labels.where("new").isEmpty():
                break
        of = lambda end: labels.select("repo", F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        inner = rest.join(of("src"), ["repo", "src"]).join(of("dst"), ["repo", "dst"]).where("src_label = dst_label")
        inner = materialize(inner.select("repo", "src", "dst", F.col("src_label").alias("label")))
        reached = frontier = labels.where("node = label").select(*_NODE, "label")
        round_ = 0
        while True:  # of those, the nodes from which the label's own node is reached again
            back = frontier.join(inner.select("repo", F.col("dst").alias("node"), "src"), _NODE).select("repo", F.col("src").alias("node"), "label").distinct()
            frontier = materialize(back.join(reached.select(*_NODE), _NODE, "left_anti"))
            if frontier.isEmpty():
                break
            round_ += 1
            reached = reached.unionByName(frontier)
            reached = materialize(reached) if round_ % 16 == 0 else reached
        members = reached if members is None else members.unionByName(reached)
        out = inner.join(reached.select("repo", F.col("node").alias("src")), ["repo", "src"], "left_anti")
        rest = _trim(out.join(reached.select("repo", F.col("node").alias("dst")), ["repo", "dst"], "left_anti").select("repo", "src", "dst"))
    return edges.select("repo", F.col("src").alias("node"), F.col("src").alias("label")).limit(0) if members is None else members


def strong_components(edges: DataFrame) -> DataFrame:
    """Repo, node and component, the smallest node of the strongly connected component; only components of several nodes."""
    return _components(materialize(edges.where("src <> dst").select("repo", "src", "dst").distinct()))


def _components(plain: DataFrame) -> DataFrame:
    """``strong_components`` of edges that are written, distinct and no loops."""
    line, rings = straight(plain)
    short = materialize(contract(plain, line, line.select(*_NODE).unionByName(rings.select(*_NODE))))
    labels = _colour(short.where("src <> dst").select("repo", "src", "dst").distinct())
    # a way that leaves a node and returns to it is a component too
    own = short.where("src = dst").select("repo", F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    labels = materialize(labels.unionByName(own.join(labels.select(*_NODE), _NODE, "left_anti")))
    # a stretch between two nodes of a component belongs to it
    of = lambda end: labels.select("repo", F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    inside = short.where("tail is not null").join(of("src"), ["repo", "src"]).join(of("dst"), ["repo", "dst"]).where("src_label = dst_label")
    between = line.join(inside.select("repo", "tail", F.col("src_label").alias("label")), ["repo", "tail"]).select(*_NODE, "label")
    every = labels.unionByName(between).unionByName(rings.select(*_NODE, F.col("low").alias("label")))
    names = every.groupBy("repo", "label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return every.join(names, ["repo", "label"]).select(*_NODE, "component")


def shortest_cycles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Repo and cycle, for each component the shortest cycle through its smallest node, as an array that starts there.

    Of several, the one whose last node is smallest, then the one before it, and so on. Distances run over the contracted
    component, one row for each node.
    """
    of = lambda end: members.select("repo", F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    both = edges.where("src <> dst").select("repo", "src", "dst").distinct().join(of("src"), ["repo", "src"]).join(of("dst"), ["repo", "dst"]).where("src_c = dst_c")
    inner = materialize(both.select("repo", "src", "dst", F.col("src_c").alias("component")))
    roots = members.where("node = component").select(*_NODE)
    line, _ = straight(inner.select("repo", "src", "dst"), roots)
    short = contract(inner, line, line)
    way = F.min(F.struct("steps", F.coalesce("tail", "src").alias("last")))
    short = materialize(short.groupBy("repo", "component", "src", "dst").agg(way.alias("w")).select("repo", "component", "src", "dst", "w.steps", "w.last"))
    onward = short.where("dst <> component").select("repo", F.col("src").alias("node"), "dst", "steps", "last")
    no_way = [F.lit(None).cast("string").alias(c) for c in ("last", "prev")]
    state = roots.select(*_NODE, F.lit(0).cast("long").alias("far"), *no_way, F.lit(True).alias("new"))
    while True:
        told = state.where("new").select(*_NODE, "far").join(onward, _NODE).groupBy("repo", F.col("dst").alias("node")).agg(
            F.min(F.struct((F.col("far") + F.col("steps")).alias("far"), "last", F.col("node").alias("prev"))).alias("t")
        )
        known = state.select(*_NODE, F.struct("far", "last", "prev").alias("s"))
        both = told.join(known, _NODE, "full_outer")
        better = F.col("t").isNotNull() & (F.col("s").isNull() | (F.col("t") < F.col("s")))
        state = materialize(both.select(*_NODE, F.coalesce(better, F.lit(False)).alias("new"), F.when(better, F.col("t")).otherwise(F.col("s")).alias("v")).select(*_NODE, "v.far", "v.last", "v.prev", "new"))
        if state.where("new").isEmpty():
            break
    ends = short.where("dst = component").join(state.select("repo", F.col("node").alias("src"), "far"), ["repo", "src"])
    last_step = F.min(F.struct((F.col("far") + F.col("steps")).alias("stop"), "last", F.col("src").alias("node"), F.col("far").alias("start")))
    # back along the nodes before, one row for each component and round
    step = materialize(ends.groupBy("repo", "component").agg(last_step.alias("e")).select("repo", "component", "e.node", "e.start", "e.stop", "e.last"))
    walked, round_ = step, 0
    while True:
        here = state.select(*_NODE, F.col("far").alias("stop"), "last", "prev")
        back = step.where("node <> component").select("repo", "component", "node").join(here, _NODE)
        back = back.select("repo", "component", F.col("prev").alias("node"), "stop", "last")
        step = materialize(back.join(state.select(*_NODE, F.col("far").alias("start")), _NODE).select("repo", "component", "node", "start", "stop", "last"))
        if step.isEmpty():
            break
        round_ += 1
        walked = walked.unionByName(step)
        walked = materialize(walked) if round_ % 16 == 0 else walked
    on_line = _stretches(walked, line)
    places = walked.select("repo", "component", F.col("start").alias("at"), "node").unionByName(on_line)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda p: p["node"])
    return places.groupBy("repo", "component").agg(listed.alias("cycle")).select("repo", "cycle")


def _stretches(walked: DataFrame, line: DataFrame) -> DataFrame:
    """The nodes of the contracted stretches that a cycle runs along, with their places in it."""
    runs = walked.where("last <> node").select("repo", "component", F.col("last").alias("tail"), F.col("stop").alias("end"))
    return runs.join(line.select("repo", "tail", "node", "steps"), ["repo", "tail"]).select("repo", "component", (F.col("end") - F.col("steps")).alias("at"), "node")


def cycles(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """One shortest cycle for each strongly connected component, and edges from a node to itself.

    repo, cycle (nodes, the smallest first), length and chain (text). A repository without rows here is free of cycles; all
    nodes that are on any cycle are rows of ``strong_components``.
    """
    edges = materialize(edges.select("repo", "src", "dst").distinct())  # whatever made them is not done again
    members = materialize(_components(edges.where("src <> dst")))
    found = edges.select("repo", F.array("src").alias("cycle")).limit(0) if members.isEmpty() else shortest_cycles(edges, members)
    return _described(found, edges, self_loops)


def _described(found: DataFrame, edges: DataFrame, self_loops: bool) -> DataFrame:
    if self_loops:
        found = found.unionByName(edges.where("src = dst").select("repo", F.array("src").alias("cycle")))
    return found.select("repo", "cycle", F.size("cycle").alias("length"), F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), " -> ").alias("chain"))


def closing_cycles(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """For every edge that leads back to the smallest node of a cycle, the shortest such cycle; of several the first in node order.

    Columns as in ``cycles``, which has one cycle for each component; these are up to one for each edge. Paths grow breadth first from
    every node through larger nodes of its component, one path for each (start, node), however long: for graphs of few nodes.
    """
    edges = materialize(edges.select("repo", "src", "dst").distinct())
    members = materialize(_components(edges.where("src <> dst")))
    of = lambda end: members.select("repo", F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    inner = edges.where("src <> dst").join(of("src"), ["repo", "src"]).join(of("dst"), ["repo", "dst"]).where("src_c = dst_c")
    inner = materialize(inner.select("repo", "src", "dst"))
    pair, round_ = ["repo", "start", "node"], 0
    seen = frontier = materialize(inner.where("dst > src").select("repo", F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path")))
    while not frontier.isEmpty():
        step = frontier.join(inner.withColumnRenamed("src", "node"), _NODE).where("dst > start")
        grown = step.select("repo", "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = grown.join(seen.select(*pair), pair, "left_anti")
        frontier = materialize(fresh.groupBy(*pair).agg(F.min("path").alias("path")))
        round_ += 1
        seen = seen.unionByName(frontier)
        seen = materialize(seen) if round_ % 16 == 0 else seen
    back = inner.where("dst < src").select("repo", F.col("dst").alias("start"), F.col("src").alias("node"))
    found = seen.join(back, pair).select("repo", F.col("path").alias("cycle"))
    return _described(found, edges, self_loops)
