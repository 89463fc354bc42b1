"""How far two branches are apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions.ranking import top_k
from codefacts.operators.churn import merge_risk
from codefacts.operators.contraction import contract, on_stretches, straight
from codefacts.session import materialize


def exclusive_commits(local: DataFrame, remote: DataFrame, parents: DataFrame) -> DataFrame:
    """Commits reachable from one head only; ``side`` is ahead (local) or behind (remote).

    ``local``/``remote``: repo, sha. ``parents``: repo, sha, parent. Stretches of commits with one parent and one child are
    contracted first, so a line of n commits takes about log2(n) rounds; then both histories are walked together, one frontier
    join for each branching, and each commit knows which heads reach it. A commit enters the frontier again only when it
    gains a side, so at most twice. A repository is left as soon as none of its commits is on one side only.
    """
    def start(df: DataFrame, side: int) -> DataFrame:
        return df.select("repo", F.col("sha").alias("node"), F.lit(side).alias("mask"))

    key = ["repo", "node"]
    heads = materialize(start(local, 1).unionByName(start(remote, 2)).groupBy(*key).agg(F.bit_or("mask").alias("mask")))
    edges = parents.select("repo", F.col("sha").alias("src"), F.col("parent").alias("dst")).where("src <> dst").distinct()
    # a repository whose heads are the same has nothing on one side
    unlike = heads.where("mask < 3").select("repo").distinct()
    edges = materialize(edges.join(unlike, "repo", "left_semi"))
    line, _ = straight(edges, heads)
    short = materialize(contract(edges, line, line))
    onward = short.select("repo", F.col("src").alias("node"), "dst").distinct()
    seen = frontier = heads
    while True:
        reached = frontier.join(onward, key).groupBy("repo", F.col("dst").alias("node")).agg(F.bit_or("mask").alias("mask"))
        total = F.col("mask").bitwiseOR(F.coalesce("old", F.lit(0)))
        grown = reached.join(seen.withColumnRenamed("mask", "old"), key, "left").where(F.coalesce("old", F.lit(0)) != total)
        fresh = materialize(grown.select(*key, total.alias("mask")))
        if fresh.isEmpty():
            break
        seen = materialize(seen.join(fresh.select(*key), key, "left_anti").unionByName(fresh))
        frontier = fresh.join(seen.where("mask < 3").select("repo").distinct(), "repo", "left_semi")
    every = seen.unionByName(on_stretches(short, line, seen).select(*key, "mask"))
    one_side = every.where("mask in (1, 2)")
    return one_side.select("repo", F.col("node").alias("sha"), F.when(F.col("mask") == 1, "ahead").otherwise("behind").alias("side"))


def divergence(repos: DataFrame, exclusive: DataFrame) -> DataFrame:
    """Ahead and behind counts, status and merge risk per repository."""
    counts = exclusive.groupBy("repo").agg(F.count_if(F.col("side") == "ahead").alias("ahead"), F.count_if(F.col("side") == "behind").alias("behind"))
    rows = repos.select("repo").distinct().join(counts, "repo", "left")
    for c in ("ahead", "behind"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    status = (
        F.when((F.col("ahead") > 0) & (F.col("behind") > 0), "diverged")
        .when(F.col("ahead") > 0, "ahead").when(F.col("behind") > 0, "behind").otherwise("synced")
    )
    return rows.withColumn("status", status).withColumn("merge_risk", merge_risk("behind"))


def pending_commits(exclusive: DataFrame, commits: DataFrame, k: int | None = None) -> DataFrame:
    """The commits that wait on either side, newest first; only the first ``k`` if given."""
    rows = exclusive.join(commits.select("repo", "sha", "ts", "message"), ["repo", "sha"])
    return top_k(rows, ["repo", "side"], [F.desc("ts"), F.col("sha")], k)


def new_remote_tags(local_tags: DataFrame, remote_tags: DataFrame, k: int | None = None) -> DataFrame:
    """Tags the remote has and the local side has not, by name; only the first ``k`` if given."""
    missing = remote_tags.select("repo", "tag").distinct().join(local_tags.select("repo", "tag"), ["repo", "tag"], "left_anti")
    return top_k(missing, ["repo"], [F.col("tag")], k)
