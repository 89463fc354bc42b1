"""Column functions over long arrays that cost neither the square of their length nor a row for each element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sums are taken in blocks of so many elements
BLOCK = 256


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For an array of numbers: at each place the sum of those before it. The array is worked out once."""
    add = lambda total, x: total + x
    zero = F.lit(0).cast("long")

    def within(from_: Column):
        return lambda part: F.transform(part, lambda _, i: from_ + F.aggregate(F.slice(part, F.lit(1), i), zero, add))

    def in_blocks(all_: Column) -> Column:
        block = lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))
        blocks = F.when(F.size(all_) > 0, F.sequence(F.lit(0), ((F.size(all_) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(block(b), zero, add).alias("sum")))
        running = F.aggregate(
            sums,
            F.struct(F.array().cast("array<bigint>").alias("done"), zero.alias("total")),
            lambda acc, s: F.struct(F.concat(acc["done"], F.array(acc["total"])).alias("done"), (acc["total"] + s["sum"]).alias("total")),
            lambda acc: acc["done"],
        )
        return F.flatten(F.zip_with(blocks, running, lambda b, from_: once(block(b), within(from_))))

    return once(lengths, lambda all_: F.when(F.size(all_) <= BLOCK, within(zero)(all_)).otherwise(in_blocks(all_)))


def place(bounds: Column, value: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``value``: a binary search."""
    mid = lambda span: ((span["lo"] + span["hi"]) / 2).cast("int")
    at = lambda span: F.element_at(bounds, mid(span) + 1)
    steps = F.ceil(F.log2(F.size(bounds) + 2)).cast("int") + 1
    return F.aggregate(
        F.array_repeat(F.lit(0), steps),
        F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")),
        lambda span, _: F.when(span["lo"] >= span["hi"], span)
        .when(at(span) < value, F.struct((mid(span) + 1).alias("lo"), span["hi"].alias("hi")))
        .otherwise(F.struct(span["lo"].alias("lo"), mid(span).alias("hi"))),
        lambda span: span["lo"],
    )
