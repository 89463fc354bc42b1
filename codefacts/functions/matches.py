"""Regex matches of a text with their line and what precedes them on it, as one in-row expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codefacts.functions import text


def match_positions(body: Column, pattern: str) -> Column:
    """Array of ``(match, line, before)`` in text order; ``before`` is the part of the line left of the match.

    For small files such as workflow definitions: the line of a match is counted from the text before it.
    """
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    between = F.split(body, pattern, -1)
    pieces = F.concat(F.slice(between, 1, 1), F.zip_with(found, F.slice(between, F.lit(2), F.size(found)), lambda m, rest: F.concat(m, rest)))

    def one(i: Column) -> Column:
        ahead = F.array_join(F.slice(pieces, F.lit(1), i), "")
        return F.struct(
            F.get(found, i - 1).alias("match"),
            (text.count_breaks(ahead) + 1).cast("int").alias("line"),
            F.substring_index(ahead, "\n", -1).alias("before"),
        )

    n = F.size(found)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one)).otherwise(F.array().cast("array<struct<match:string,line:int,before:string>>"))
