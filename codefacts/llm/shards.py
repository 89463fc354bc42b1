"""Shards by sampled splitters, in DataFrame functions only.

Records are ordered by a key (a hash of the text, then the id), so equal texts lie side by side. A sample that draws each
record with a chance in proportion to its size, and any record with a small one, gives quantiles of the key; they bound
ranges of bounded bytes and rows. A key that is itself a boundary has a range of its own, and ranges that still hold too many
bytes or rows are divided again, by sampled quantiles of the key or, where the range is one key, of the id. Running sums inside the ranges, plus what lies before
each range, give every record its exact place in the order, and shards are cut from the order at equal numbers of bytes.
Every shard's bytes are therefore within the size of one record of the even share.

Null texts are empty; size is the bytes of the text plus one. Null ids come first among equal texts. Repeated rows are
records of their own with equal keys, in either order. Any length of text is one record. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.arrays import place
from codefacts.session import materialize

#: sampled records for each range
SAMPLES = 40
#: rows that one range is meant for, and how many ranges there are at least and at most
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 250_000, 64, 4096
#: a range that holds this many times its share is divided
OVERFULL = 2.0


def text_key(text: Column) -> Column:
    """52 bits of a hash of the text, so that sums of doubles hold it exactly."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 12)


def _quantiles(value: str, parts: int) -> Column:
    return F.array_sort(F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(50 * parts))))


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (its number within the shard, without gaps from 0) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    records = materialize(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("key"))
    )
    total = records.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if not total.n:
        return records.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(MOST_RANGES, max(LEAST_RANGES, total.n // RANGE_ROWS))
    share = total.bytes / ranges

    # draws in proportion to size: the hash of the id is the coin, so a lost task draws the same records again
    coin = F.pmod(F.xxhash64(F.lit(17), "key", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = float(total.bytes / (ranges * SAMPLES))
    # and some are drawn whatever their size, so that a key of many tiny records is a boundary too
    row_share, by_row = total.n / ranges, ranges * SAMPLES / total.n
    is_drawn = (coin * F.lit(rate) < F.col("size")) | (coin < F.lit(by_row))
    drawn = records.filter(is_drawn)
    bounds = drawn.agg(_quantiles("key", ranges).alias("bounds")).first().bounds or []  # at most ``ranges`` numbers
    sorted_bounds = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    below = place(sorted_bounds, F.col("key"))
    own = F.coalesce(F.try_element_at(sorted_bounds, below + 1) == F.col("key"), F.lit(False))
    ranged = records.withColumn("range", below * 2 + own.cast("int"))  # odd: the range of one boundary key

    # ranges that hold too much: bounded by the number of ranges, so their description may go through the driver
    overfull = ((F.col("bytes") > OVERFULL * share) | (F.col("n") > OVERFULL * row_share)) & (F.col("n") > 1)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter(overfull).collect()
    ranged = ranged.withColumn("sub", F.lit(0))
    if sums:
        parts = {r["range"]: min(2 * ranges, int(max(r["bytes"] / share, r["n"] / row_share)) + 2) for r in sums}
        # inside a range that is one key the id tells records apart; elsewhere the key does
        finer = F.when(F.col("range") % 2 == 1, F.col("doc_id")).otherwise(F.col("key"))
        full = F.col("range").isin(sorted(parts))
        again = ranged.filter(full).withColumn("finer", finer).filter(is_drawn)
        cuts = {}
        for row in again.groupBy("range").agg(_quantiles("finer", max(parts.values())).alias("cut")).collect():
            wide, want = row["cut"] or [], parts[row["range"]]
            cuts[row["range"]] = sorted({int(wide[(i * len(wide)) // want]) for i in range(1, want)}) if wide else []
        sub = F.lit(0)
        for number, cut in cuts.items():
            if cut:
                sub = F.when(F.col("range") == number, place(F.array(*[F.lit(c) for c in cut]), finer)).otherwise(sub)
        ranged = ranged.withColumn("sub", F.when(F.col("doc_id").isNull() & (F.col("range") % 2 == 1), F.lit(0)).otherwise(sub))

    # exact places: sums of whole ranges on the driver (their number is bounded), running sums inside each range
    ranged = materialize(ranged)
    held = ranged.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    held.sort(key=lambda r: (r["range"], r["sub"]))
    before = list(accumulate((r["bytes"] for r in held), initial=0))
    spark = docs.sparkSession
    starts = spark.createDataFrame([(r["range"], r["sub"], b) for r, b in zip(held, before, strict=False)], "range int, sub int, start long")
    inside = Window.partitionBy("range", "sub").orderBy("key", F.col("doc_id").asc_nulls_first())
    placed = ranged.join(F.broadcast(starts), ["range", "sub"]).withColumn(
        "middle", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") / 2
    )
    shard = F.least(F.floor(F.col("middle") * shards / F.lit(float(total.bytes))), F.lit(shards - 1)).cast("int")
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "key", "range", "sub", shard.alias("shard")))
    # slots: the same again with counts; a range can reach over several shards
    counts = placed.groupBy("shard", "range", "sub").agg(F.count("*").alias("n")).collect()
    counts.sort(key=lambda r: (r["shard"], r["range"], r["sub"]))
    rows, last, at = [], None, 0
    for r in counts:
        at = at if r["shard"] == last else 0
        rows.append((r["shard"], r["range"], r["sub"], at))
        last, at = r["shard"], at + r["n"]
    firsts = spark.createDataFrame(rows, "shard int, range int, sub int, first long")
    number = F.row_number().over(Window.partitionBy("shard", "range", "sub").orderBy("key", F.col("doc_id").asc_nulls_first())) - 1
    return placed.join(F.broadcast(firsts), ["shard", "range", "sub"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + number).cast("long").alias("slot")
    )
