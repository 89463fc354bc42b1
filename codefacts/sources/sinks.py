"""Writers: section tables, symbol index, relational mirror, snapshots, run partitions, text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.profile import LANGUAGE_LABELS
from codefacts.schemas import SCHEMA_VERSION

#: rows of a file that several small repositories share
ROWS_PER_FILE = 1_000_000


def _overwrite(df: DataFrame, path: str, parts: list[str], cluster_by: list[str] | None = None) -> None:
    """Replace only the partitions that occur in ``df``.

    Rows are dealt out by ranges of the partition columns first, so a partition is written by the few tasks that hold it,
    and a large one by several; not by every task of the job.
    """
    order = [*parts, *(cluster_by or [])]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_packed(df: DataFrame, path: str, parts: list[str], rows_per_file: int = ROWS_PER_FILE) -> None:
    """Replace the partitions ``parts`` that occur in ``df``; inside, files of about even size in the order of repositories.

    Small repositories share a file and a large one has several, so a corpus of a million small repositories is not a million
    files; the ranges are quantiles of a sample of (repository, row). The statistics of a file name its first and last
    repository, so a reader of one repository skips the others.
    """
    rows = df.withColumn("__row", F.xxhash64(*df.columns))
    files = max(1, -(-df.count() // rows_per_file))
    packed = rows.repartitionByRange(files, *parts, "repo", "__row").sortWithinPartitions(*parts, "repo").drop("__row")
    packed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_sections(tables: dict[str, DataFrame], root: str, snapshot: str, only: list[str] | None = None, packed: bool = False) -> list[str]:
    """One parquet table per section below ``root``, partitioned by snapshot and repository; ``only`` selects.

    ``packed`` is for corpora of many small repositories: partitioned by snapshot only, see ``write_packed``.
    """
    unknown = set(only or []) - set(tables)
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    written = []
    for name, df in tables.items():
        if only is None or name in only:
            rows = df.withColumn("snapshot", F.lit(snapshot)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
            if packed:
                write_packed(rows, f"{root.rstrip('/')}/{name}", ["snapshot"])
            else:
                _overwrite(rows, f"{root.rstrip('/')}/{name}", ["snapshot", "repo"])
            written.append(name)
    return written


def write_symbol_index(symbols: DataFrame, path: str) -> None:
    """The flat index range-partitioned by name, so a lookup reads few row groups; a frequent name spans several files."""
    rows = symbols.repartitionByRange(F.col("name"), F.col("file"), F.col("line")).sortWithinPartitions("name", "file", "line")
    rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#name", "true").parquet(path)


def mirror_tables(comps: DataFrame, routes: DataFrame, symbols: DataFrame, files: DataFrame, modules: DataFrame, component_dir: str = "plugins") -> dict[str, DataFrame]:
    """The relational mirror: plugins, routes, symbols, files and core modules."""
    component = F.when(F.col("path").startswith(component_dir + "/"), F.get(paths.segments("path"), F.lit(1)))
    payload = F.to_json(F.struct(*[F.col(c) for c in comps.columns])).alias("payload")
    module_payload = F.to_json(F.struct(*[F.col(c) for c in modules.columns])).alias("payload")
    return {
        "plugins": comps.select("repo", "identifier", "version", "agent_role", F.col("route_count").alias("routes"), payload),
        "routes": routes.select("repo", "rule", F.array_join("methods", ",").alias("methods"), component.alias("plugin"), F.col("path").alias("file"), "lineno"),
        "symbols": symbols.select("repo", "name", "kind", "file", "line", "owner"),
        "files": files.select("repo", F.col("path").alias("relpath"), F.col("lines").alias("loc"), paths.language_label("path", LANGUAGE_LABELS).alias("lang"), component.alias("plugin")),
        "core_modules": modules.select("repo", F.col("name").alias("module"), module_payload),
    }


def save_mirror(tables: dict[str, DataFrame], database: str) -> None:
    """Save the mirror as catalogue tables; each one appears when its write has committed."""
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")


def save_snapshot(rows: DataFrame, path: str) -> None:
    """Store one snapshot as a partition; saving a name again replaces it."""
    _overwrite(rows, path, ["snapshot"])


def save_fingerprint(rows: DataFrame, path: str, name: str) -> None:
    """Store an audit fingerprint under a name."""
    _overwrite(rows.withColumn("snapshot", F.lit(name)), path, ["snapshot"])


def write_run(df: DataFrame, path: str, run_date: str) -> None:
    """Store a result under its run date."""
    _overwrite(df.withColumn("run_date", F.lit(run_date).cast("date")), path, ["repo", "run_date"])


def write_lines(df: DataFrame, path: str) -> None:
    """Text lines, one directory per repository."""
    df.select("repo", "value").repartitionByRange("repo").write.mode("overwrite").partitionBy("repo").text(path)
