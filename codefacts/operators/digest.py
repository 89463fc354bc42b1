"""A tree of digests over the files of a corpus, and its comparison from the root down.

Every directory has a digest of all files below it that does not depend on their order: their number and the sums of four slices of
their MD5. So one aggregation with partial sums gives all levels, and no directory is ever listed in one place. Two trees are
compared level by level; only the children of directories that differ are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.session import materialize

_SLICES = 4


def file_digest() -> Column:
    """MD5 over path, time and size of a file."""
    return F.md5(F.concat_ws("|", "path", F.col("mtime").cast("string"), F.col("size").cast("string")).cast("binary"))


def _slices(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(_SLICES)]


def _combined() -> list[Column]:
    sums = [F.sum(f"p{i}").cast("string") for i in range(_SLICES)]
    return [F.count("*").alias("files"), F.md5(F.concat_ws("|", F.count("*").cast("string"), *sums).cast("binary")).alias("digest")]


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """Repo, files and fingerprint, the digest of the root; any added, removed or touched file changes it."""
    rows = files.select("repo", *_slices(file_digest())).groupBy("repo").agg(*_combined())
    return rows.withColumnRenamed("digest", "fingerprint")


def digest_tree(files: DataFrame) -> DataFrame:
    """repo, level, path, parent, is_file, files and digest: every directory and file; the root has the empty path and level 0."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("node"), (k == F.size(parts)).alias("is_file")))
    rows = files.select("repo", *_slices(file_digest()), F.explode(ancestors).alias("a"))
    nodes = rows.groupBy("repo", F.col("a.level").alias("level"), F.col("a.node").alias("path"), F.col("a.is_file").alias("is_file")).agg(*_combined())
    parent = F.when(F.col("level") > 0, F.regexp_replace("path", "/?[^/]*$", ""))
    return nodes.select("repo", "level", "path", parent.alias("parent"), "is_file", "files", "digest")


def write_tree(files: DataFrame, path: str) -> None:
    """A tree with a folder for each level, so that a comparison reads the levels it gets to."""
    digest_tree(files).write.mode("overwrite").partitionBy("level").parquet(path)


def corpus_difference(spark: SparkSession, base: str, current: str) -> DataFrame:
    """repo, path and status (``added``, ``removed``, ``changed``) of the files in which two written trees differ.

    One round for each level in which anything differs; a round reads one level of both trees and keeps the children of the
    directories that the round before found to differ. Where roots agree nothing further is read.
    """
    key = ["repo", "path", "is_file"]

    def level(path: str, number: int, side: str) -> DataFrame:
        rows = spark.read.schema("repo string, path string, parent string, is_file boolean, files long, digest string, level int").parquet(path)
        return rows.where(F.col("level") == number).select(*key, F.col("parent").alias(f"{side}_parent"), F.col("digest").alias(side))

    out, frontier, number = None, None, 0
    while True:
        both = level(base, number, "base").join(level(current, number, "current"), key, "full_outer")
        unlike = both.where(~F.col("base").eqNullSafe(F.col("current"))).withColumn("parent", F.coalesce("base_parent", "current_parent"))
        if frontier is not None:
            unlike = unlike.join(frontier, ["repo", "parent"], "left_semi")
        unlike = materialize(unlike.select(*key, "base", "current"))
        status = F.when(F.col("base").isNull(), "added").when(F.col("current").isNull(), "removed").otherwise("changed")
        found = unlike.where("is_file").select("repo", "path", status.alias("status"))
        out = found if out is None else out.unionByName(found)
        frontier = unlike.where("not is_file").select("repo", F.col("path").alias("parent"))
        if frontier.isEmpty():
            return out
        number += 1
