"""Files of a corpus as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions import paths, text
from codefacts.schemas import SCHEMA_VERSION


def spread_scan(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a plain scan to as many partitions as it has splits, at least one for every core.

    A row group is read by one task, however many splits its file is cut into: the others are empty. Their number does not
    show it, and parsing and regex stages cost far more than moving their rows once.
    """
    return scan.repartition(max(scan.rdd.getNumPartitions(), scan.sparkSession.sparkContext.defaultParallelism))


def spread_rows(rows: DataFrame) -> DataFrame:
    """Deal out few narrow rows that a costly stage follows, where the exchange before them was sized by their bytes."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def scan_files(spark: SparkSession, root: str, repo: Column | str | None = None, glob: str | None = None) -> DataFrame:
    """A1, A2: every file below ``root`` as ``(repo, path, content, size, mtime)``, text decoded safely.

    Without ``repo`` the first directory below ``root`` names the repository. Excluded files are filtered by
    ``operators.overview.in_scope``; ``glob`` is applied by the file index, before anything is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    base = root.rstrip("/").removeprefix("file:")
    inside = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^\\Q{base}/\\E", "")
    rows = raw.select(inside.alias("rel"), "content", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
    if repo is None:
        name, rel = F.substring_index("rel", "/", 1), F.regexp_replace("rel", r"^[^/]+/", "")
    else:
        name, rel = (F.lit(repo) if isinstance(repo, str) else repo), F.col("rel")
    return rows.select(name.alias("repo"), rel.alias("path"), text.decode_text("content").alias("content"), "size", "mtime")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A1: a corpus kept as parquet with a binary or text ``content`` column."""
    df = spark.read.parquet(path)
    if dict(df.dtypes).get("content") == "binary":
        df = df.withColumn("content", text.decode_text("content"))
    return df


def workflow_files(files: DataFrame) -> DataFrame:
    """CI workflow files of the platform each repository uses; one platform per repository, the first that exists."""
    platform = F.when(F.col("path").startswith(".github/workflows/"), "github").when(F.col("path").startswith(".gitee/workflows/"), "gitee")
    rows = files.withColumn("platform", platform).where("platform is not null")
    chosen = rows.groupBy("repo").agg(F.min(F.when(F.col("platform") == "github", 0).otherwise(1)).alias("prio"))
    chosen = chosen.select("repo", F.when(F.col("prio") == 0, "github").otherwise("gitee").alias("platform"))
    flat = rows.where(F.col("path").rlike(r"^\.[a-z]+/workflows/[^/]+\.ya?ml$"))
    return flat.join(chosen, ["repo", "platform"])


def role_names(files: DataFrame, directory: str, suffix: str = "", strip_pattern: str = "") -> DataFrame:
    """Role names from the file names of a directory, the captured part of ``strip_pattern`` when it matches."""
    here = F.col("path").rlike(f"^\\Q{directory.rstrip('/')}/\\E[^/]+\\Q{suffix}\\E$")
    name = paths.stem("path")
    if strip_pattern:
        captured = F.regexp_extract(name, f"^(?:{strip_pattern})", 1)
        name = F.when(captured != "", captured).otherwise(name)
    return files.where(here).select("repo", F.lower(text.strip(name)).alias("role")).distinct()


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One stored snapshot; the partition filter prunes all others.

    An unknown name is an error, as is a snapshot written under another schema version: compared with either, everything
    would seem added.
    """
    rows = spark.read.parquet(path).where(F.col("snapshot") == name)
    first = rows.limit(1).collect()
    if not first:
        raise ValueError(f"no snapshot {name!r} below {path}")
    if "schema_version" in rows.columns and first[0].schema_version != SCHEMA_VERSION:
        raise ValueError(f"snapshot {name!r} has schema version {first[0].schema_version}, this is {SCHEMA_VERSION}")
    return rows


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Names of the stored snapshots."""
    return spark.read.parquet(path).select("snapshot").distinct()


def latest_run(df: DataFrame) -> DataFrame:
    """Per repository, the rows of its latest ``run_date``."""
    newest = df.groupBy("repo").agg(F.max("run_date").alias("run_date"))
    return df.join(newest, ["repo", "run_date"])
