"""Top-k per group and other order-dependent picks, in forms that shrink data before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spark prunes ``row_number() <= k`` before the shuffle up to this k (spark.sql.optimizer.windowGroupLimitThreshold)
_PRUNED_K = 1000


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None, rank_col: str | None = "rank", salts: int = 64
) -> DataFrame:
    """the first ``k`` rows per group under a total order; all rows, ranked, if ``k`` is None.

    Up to 1000, Spark's group-limit cuts every input partition to ``k`` rows per group before the exchange, so a
    group with a third of all rows sends little. Beyond it, a salted first round does the same work spread over tasks.
    """
    by = list(by)
    rank = rank_col or "__rank"
    if k is None:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if rank_col else df
    if k > _PRUNED_K:
        spread = [c for c in df.columns if c not in by]
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        first = Window.partitionBy(*by, "__salt").orderBy(*order)
        df = salted.withColumn("__first", F.row_number().over(first)).where(F.col("__first") <= k)
        df = df.drop("__salt", "__first")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
    return ranked if rank_col else ranked.drop(rank)


def top_k_array(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, item: Column, name: str
) -> DataFrame:
    """One bounded array per group: top-k first, so no more than ``k`` rows are ever collected for a group."""
    ranked = top_k(df.withColumn("__item", item), by, order, k, "__pos")
    picked = F.sort_array(F.collect_list(F.struct(F.col("__pos"), F.col("__item").alias("item"))))
    return ranked.groupBy(*by).agg(F.transform(picked, lambda x: x["item"]).alias(name))


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """keep one row per group, the first under a total order."""
    return top_k(df, by, order, 1, rank_col=None)
