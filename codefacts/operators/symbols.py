"""Symbol index and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.functions.skew import salted_join
from codefacts.operators import facts as fx


def symbol_table(classes: DataFrame, functions: DataFrame, routes: DataFrame, component_dir: str = "plugins") -> DataFrame:
    """Flat index ``(repo, name, kind, file, line, owner)`` of classes, functions and route rules."""

    def part(df: DataFrame, name, kind: str) -> DataFrame:
        return df.select(
            "repo", name.alias("name"), F.lit(kind).alias("kind"), paths.posix("path").alias("file"),
            F.col("lineno").alias("line"),
        )

    rows = (
        part(classes, F.col("name"), "class")
        .unionByName(part(functions, F.col("name"), "function"))
        .unionByName(part(routes, fx.route_symbol("rule"), "route"))
    )
    return rows.where("name <> ''").withColumn("owner", paths.owner("file", component_dir))


def inverted_index(symbols: DataFrame, block: int = 1000) -> DataFrame:
    """Name -> sorted entries; every name in blocks of about ``block`` entries, numbered from 0.

    A name may be defined in a third of all files, so its entries are spread over as many blocks as its count asks for
    before any list is built. The shape is the same for all names: one row for each (name, block).
    """
    counts = symbols.groupBy("repo", "name").agg(F.count("*").alias("total"))
    counts = counts.withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    placed = salted_join(symbols, counts, ["repo", "name"], ["file", "line"]).withColumn(
        "block", F.pmod(F.xxhash64("file", "line", "kind"), F.col("blocks"))
    )
    entry = F.struct("file", "line", "kind", "owner")
    return placed.groupBy("repo", "name", "block").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(entry)).alias("entries")
    )


def postings(symbols: DataFrame) -> DataFrame:
    """D23 as a flat table, sorted within its files: what a lookup by (repo, name) reads; no list is built."""
    order = ["repo", "name", "file", "line", "kind"]
    return symbols.select("repo", "name", "file", "line", "kind", "owner").repartitionByRange(*order).sortWithinPartitions(*order)


def search(symbols: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Exact hits, else case-insensitive substring hits; first ``limit`` by (file, line, kind, name).

    ``total`` is the number of hits before the limit and ``truncated`` tells whether rows are missing.
    """
    query = (text or "").strip()
    cap = max(1, limit)
    # one pass: a row qualifies as substring hit, and is ranked after every exact hit
    hits = symbols.where(F.lower("name").contains(query.lower()) if query else F.lit(False))
    hits = hits.withColumn("exact", F.col("name") == query)
    stats = hits.groupBy("exact").agg(F.count("*").alias("total"))
    best = stats.agg(F.bool_or("exact").alias("exact"), F.max_by("total", F.col("exact").cast("int")).alias("total"))
    chosen = hits.join(best, "exact")
    ordered = chosen.orderBy("file", "line", "kind", "name", "repo").limit(cap)
    return ordered.select(
        "repo", F.col("name").alias("symbol"), "file", "line", "kind", "owner",
        F.when(F.col("exact"), "exact").otherwise("substring").alias("match"),
        "total", (F.col("total") > cap).alias("truncated"),
    )
