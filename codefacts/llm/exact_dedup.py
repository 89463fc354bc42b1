"""Exact duplicates by a heavy-hitter split, in DataFrame functions only.

A frequent-items sketch of the Misra-Gries family (``approx_top_k``) names digests that may be frequent; they are counted
exactly, and those that are frequent are broadcast, at most ``TRACKED`` of them: their rows are decided where they lie.
The other digests go through an ordinary shuffle, in which no digest is frequent any more. The sketch only decides the
way a row takes, so the result is exact.

Null texts are empty texts. Of equal texts the row with the largest ``doc_id`` stays. Rows that repeat a ``doc_id`` and
its text share one decision and count as rows; null ids lose to others, and where a group has only null ids all are kept.
``keep_one`` cannot name a row without an id and leaves it. An empty table gives an empty result. Other columns are
ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.session import materialize

#: digests that the sketch keeps apart, and so the most that are ever broadcast (64 bytes each)
TRACKED = 1000
#: partial sketches before the last one
FAN_IN = 32


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def frequent(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(digest, keep_id, group_size) of digests that more than one row in ``tracked`` has; at most ``tracked`` rows."""
    capacity = 1 << (tracked * 4 - 1).bit_length()
    partial = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(FAN_IN)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(digest, {capacity})").alias("sketch"))
    # grouped, if by a constant: a task without sketches must not begin one
    top = partial.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {capacity}), {tracked})").alias("top"))
    candidates = top.select(F.explode("top").alias("item")).select(F.col("item.item").alias("digest"))
    counted = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    total = rows.agg(F.count("*").alias("n"))
    least = int(total.first().n) // tracked + 1
    return counted.filter(F.col("group_size") > F.lit(max(1, least)))


def groups(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    rows = materialize(docs.select("doc_id", text_digest(F.col("text")).alias("digest")))  # texts are read once
    heavy = materialize(frequent(rows, tracked))
    marked = rows.join(F.broadcast(heavy), "digest", "left")  # heavy: at most ``tracked`` rows
    decided = marked.filter(F.col("group_size").isNotNull())
    rest = marked.filter(F.col("group_size").isNull()).select("digest", "doc_id")
    several = rest.groupBy("digest").agg(F.max("doc_id").alias("most"), F.count("*").alias("n")).filter("n > 1")
    shuffled = rest.join(several, "digest", "left").select(
        "digest", "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("most")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size")
    )
    both = decided.select("digest", "doc_id", "keep_id", "group_size").unionByName(shuffled)
    return both.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns."""
    gone = groups(docs).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["__gone"], "left_anti")
