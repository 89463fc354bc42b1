"""Exported ``git log --numstat`` text and reference listings as tables.

A log may be one huge file, so no step handles a file as a whole. Lines carry their input split and their order within
it; the commit a line belongs to is the last header of its split, or, for the lines before the first header of a split,
the last header of the splits before it - one row per split is enough to know that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``--pretty=format:%H|%h|%an|%ae|%ad|%s``
HEADER_FIELDS = ("sha", "short_sha", "author_name", "author_email", "date", "message")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with ``file``, ``split`` (byte offset of the input split) and ``pos`` (order inside the split)."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos")
    )
    return raw.where(F.trim("value") != "")


def is_header(value: Column) -> Column:
    """A header has a pipe and no tab, and all six fields."""
    return value.contains("|") & ~value.contains("\t") & (F.size(F.split(value, r"\|")) >= 6)


def attach_commit(lines: DataFrame) -> DataFrame:
    """Carry the commit id forward over the lines below its header."""
    head = F.when(is_header(F.col("value")), F.substring_index("value", "|", 1))
    within = Window.partitionBy("file", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", head).withColumn("own_sha", F.last("head", ignorenulls=True).over(within))
    last_of_split = rows.where("head is not null").groupBy("file", "split").agg(F.max_by("head", "pos").alias("last_sha"))
    splits = rows.select("file", "split").distinct().join(last_of_split, ["file", "split"], "left")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.withColumn("carried", F.last("last_sha", ignorenulls=True).over(before)).drop("last_sha")
    return rows.join(carried, ["file", "split"]).withColumn("sha", F.coalesce("own_sha", "carried")).drop("own_sha", "carried")


def new_path(path: Column) -> Column:
    """Renames as their new path: ``a => b`` and ``dir/{a => b}/c``."""
    braced = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    return F.regexp_replace(braced, r"^.* => ", "")


def parse_commits(lines: DataFrame, repo: Column) -> DataFrame:
    """A3: one row per header; ``date`` stays text, ``ts`` is set when it is ISO."""
    parts = F.split(F.col("value"), r"\|", 6)
    rows = lines.where(is_header(F.col("value")))
    fields = [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(HEADER_FIELDS)]
    return rows.select(repo.alias("repo"), *fields).withColumn("ts", F.try_to_timestamp("date"))


def parse_numstat(lines: DataFrame, repo: Column) -> DataFrame:
    """A3, A4: ``added<TAB>deleted<TAB>path`` rows of known commits; ``-`` (binary) gives null counts."""
    parts = F.split("value", "\t")
    rows = attach_commit(lines).where("head is null and sha is not null").where(F.size(parts) == 3)
    return rows.select(
        repo.alias("repo"), "sha", new_path(F.get(parts, F.lit(2))).alias("path"),
        F.get(parts, F.lit(0)).try_cast("int").alias("added"), F.get(parts, F.lit(1)).try_cast("int").alias("deleted"),
    )


def read_commit_log(spark: SparkSession, path: str, repo: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A3: ``(commits, numstat)``; the repository is the log's file name without extension unless given."""
    lines = read_log_lines(spark, path)
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "") if repo is None else repo
    return parse_commits(lines, name), parse_numstat(lines, name)


def remote_tags(lines: DataFrame) -> DataFrame:
    """Tag names out of ``ls-remote --tags`` lines ``(repo, value)``; peeled entries are left out."""
    ref = F.get(F.split(F.trim("value"), r"\s+"), F.lit(1))
    return lines.where(ref.startswith("refs/tags/") & ~ref.endswith("^{}")).select("repo", F.substr(ref, F.lit(11)).alias("tag")).distinct()
