"""Straight stretches of directed graphs as single edges, and walks over what is left.

A node with one edge in and one out only passes things on. Pointer doubling finds where each stretch of such nodes ends, so a
line of n nodes takes about log2(n) rounds, and a walk afterwards has one round for each branching on its way. State is a row
for each node or edge.

Both sides of these joins have a row for each node, and sizes of aggregates are guessed too small: none is sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.session import materialize as _materialize

_NODE = ["repo", "node"]


def materialize(df: DataFrame) -> DataFrame:
    """State of one round; it is joined in the next one, so its size is told as it is."""
    return _materialize(df, true_size=True)


def straight(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of straight stretches and of rings without a way in or out; ``edges`` are distinct, without loops.

    First: node, stop (the node after the stretch), steps to it and tail (the last node of the stretch). Second: node and low, the
    smallest node of its ring. Nodes in ``keep`` are no part of a stretch.
    """
    after = edges.groupBy("repo", F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("stop")).where("n = 1")
    before = edges.groupBy("repo", F.col("dst").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select(*_NODE)
    line = after.join(before.hint("merge"), _NODE).select(*_NODE, "stop", F.lit(1).cast("long").alias("steps"), F.col("node").alias("tail"), F.col("node").alias("low"))
    if keep is not None:
        line = line.join(keep.select(*_NODE), _NODE, "left_anti")
    line = materialize(line.withColumn("open", F.lit(True)))
    while not line.where("open").isEmpty():
        further = line.select("repo", F.col("node").alias("stop"), F.col("stop").alias("s"), F.col("steps").alias("k"), F.col("tail").alias("t"), F.col("low").alias("l"))
        doubled = line.join(further.hint("merge"), ["repo", "stop"], "left")
        line = materialize(
            doubled.select(
                *_NODE, F.coalesce("s", "stop").alias("stop"), (F.col("steps") + F.coalesce("k", F.lit(0))).alias("steps"), F.coalesce("t", "tail").alias("tail"),
                F.least("low", "l").alias("low"), F.col("s").isNotNull().alias("open"), (F.col("low") != F.col("l")).alias("apart"),
            )
        )
        # two stretches that follow one another have different smallest nodes, unless each is a whole ring; once that holds for
        # all that are still open, only rings are, and every node has met all of its ring
        if line.where("open and apart").isEmpty():
            break
    return line.where("not open").select(*_NODE, "stop", "steps", "tail"), line.where("open").select(*_NODE, "low")


def contract(edges: DataFrame, line: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges between the nodes that are in no stretch (``gone`` has those that are): src, dst, steps and tail, null for plain edges."""
    rest = edges.join(gone.select("repo", F.col("node").alias("src")), ["repo", "src"], "left_anti")
    rows = rest.join(line.withColumnRenamed("node", "dst"), ["repo", "dst"], "left")
    others = [F.col(c) for c in edges.columns if c not in ("repo", "src", "dst")]
    return rows.select("repo", "src", F.coalesce("stop", "dst").alias("dst"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), "tail", *others)


def spread(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """I4: repo, node and hops, the least number of edges from any start (repo, node) of the repository; starts have 0.

    One row for each node, however many starts there are; ``graph.reachable`` tells starts apart.
    """
    begin = materialize(starts.select(*_NODE).distinct())
    plain = materialize(edges.where("src <> dst").select("repo", "src", "dst").distinct())
    line, _ = straight(plain, begin)
    # rings that have no start cannot be entered, and their edges lead nowhere else
    short = materialize(contract(plain, line, line))
    onward = short.select("repo", F.col("src").alias("node"), "dst", "steps")
    state = frontier = materialize(begin.withColumn("hops", F.lit(0).cast("long")))
    while True:
        told = frontier.join(onward, _NODE).groupBy("repo", F.col("dst").alias("node")).agg(F.min(F.col("hops") + F.col("steps")).alias("told"))
        better = told.join(state, _NODE, "left").where("hops is null or told < hops")
        frontier = materialize(better.select(*_NODE, F.col("told").alias("hops")))
        if frontier.isEmpty():
            break
        state = materialize(state.join(frontier.select(*_NODE), _NODE, "left_anti").unionByName(frontier))
    return state.unionByName(on_stretches(short, line, state).select(*_NODE, (F.col("hops") + F.col("whole") - F.col("steps")).alias("hops")))


def on_stretches(short: DataFrame, line: DataFrame, state: DataFrame) -> DataFrame:
    """The nodes of the stretches behind the nodes of ``state`` (repo, node, others): node, steps, whole length and the others."""
    behind = short.where("tail is not null").select("repo", F.col("src").alias("node"), "tail", F.col("steps").alias("whole"))
    entered = behind.join(state, _NODE).drop("node")
    return entered.join(line.select("repo", "tail", "node", "steps"), ["repo", "tail"]).drop("tail")
