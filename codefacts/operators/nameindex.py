"""Substring search over symbol names without a scan of all names.

An index has two parquet tables: ``entries``, the symbols in the order of their names, and ``triples``, one row for each three
letters (lower case) and name that has them, in the order of the letters. A search reads the row groups of its own triples,
keeps the names that have all of them, verifies those, and reads their entries. Texts of less than three letters have no
triple; they look through the distinct names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
_ENTRY = ["repo", "name", "kind", "file", "line", "owner"]


def triples_of(name: Column) -> Column:
    """The distinct three-letter pieces of a text in lower case."""
    low = F.lower(name)
    last = F.char_length(low) - GRAM + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM))))


def write_index(symbols: DataFrame, root: str) -> None:
    """Both tables; a name or triple that a third of all rows have is spread over several files."""
    entries = symbols.select(*_ENTRY).repartitionByRange("name", "file", "line").sortWithinPartitions("name", "file", "line")
    entries.write.mode("overwrite").option("parquet.bloom.filter.enabled#name", "true").parquet(f"{root}/entries")
    names = symbols.select("name").distinct()
    triples = names.select(F.explode(triples_of(F.col("name"))).alias("gram"), "name").repartitionByRange("gram", "name").sortWithinPartitions("gram", "name")
    triples.write.mode("overwrite").option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{root}/triples")


def matching_names(spark: SparkSession, root: str, text: str) -> DataFrame:
    """The names that contain ``text``, whatever the case; only rows of its triples are read."""
    low = text.lower()
    grams = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
    if grams:
        read = spark.read.parquet(f"{root}/triples").where(F.col("gram").isin(grams))
        found = read.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("name")
    else:
        found = spark.read.parquet(f"{root}/entries").select("name").distinct()
    return found.where(F.lower("name").contains(low))


def search_index(spark: SparkSession, root: str, text: str, limit: int = 50) -> DataFrame:
    """What ``symbols.search`` gives for the same symbols: exact hits, else substring hits in any case."""
    query, cap = (text or "").strip(), max(1, limit)
    entries = spark.read.parquet(f"{root}/entries")
    hits, match = entries.where(F.col("name") == query), "exact"
    if query and hits.isEmpty():
        hits, match = entries.join(matching_names(spark, root, query), "name", "left_semi"), "substring"
    hits = hits.where(F.lit(bool(query)))
    total = hits.count()
    first = hits.orderBy("file", "line", "kind", "name", "repo").limit(cap)
    return first.select(
        "repo", F.col("name").alias("symbol"), "file", "line", "kind", "owner", F.lit(match).alias("match"), F.lit(total).cast("long").alias("total"), F.lit(total > cap).alias("truncated")
    )
