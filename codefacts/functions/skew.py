"""Joins whose left side may hold one key in a third of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.session import materialize

#: how many tasks a hot key is spread over
SALTS = 16
#: rows from which on a key counts as hot; and one key in so many rows is hot at most, so hot keys are few at any size
HOT_ROWS, HOT_SHARE = 200_000, 500


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join a skewed ``left`` to a ``right`` with few rows per key, spreading each key over ``salts`` tasks.

    ``spread`` names left columns that vary within a hot key. The right side is repeated ``salts`` times, which pays off
    where it is a summary (one row per key) too large to broadcast. Small right sides are left to adaptive execution.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join keeps left rows once: {how} is not supported")
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def counted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``salted_join`` that spreads hot keys only: ``left`` (a written table: it is counted first) is grouped by its keys.

    Hot keys are those with at least ``hot_rows`` rows and a five-hundredth of all rows, so there are at most 500, and they are sent
    to both sides. The right side is repeated for them alone; without a hot key this is a plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join keeps left rows once: {how} is not supported")
    least = max(hot_rows, left.count() // HOT_SHARE)
    hot = materialize(left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*on))
    if hot.isEmpty():
        return left.join(right, list(on), how)
    marked = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    spread_over = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = left.join(marked, list(on), "left").withColumn("__salt", F.when(F.col("__hot"), spread_over).otherwise(0)).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(marked, list(on), "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")
