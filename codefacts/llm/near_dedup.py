"""Near duplicates: ProbMinHash signatures, banding, and exact verification of five-word shingles.

Two texts are linked if the Jaccard similarity of their sets of shingles is at least 0.8; a class is a connected part of
the links. Equal texts are one text from the start. Texts whose signatures agree in a whole band share a bucket. Signatures
give every distinct shingle the weight 1, however often it occurs, so with 20 bands of 4 registers a pair of similarity 0.8
shares one with probability 0.99997.

Buckets are never expanded into all their pairs. First every text of a bucket is compared with the bucket's smallest id,
so a bucket of copies costs one comparison for each text, and linked texts share a label. Then texts that are not in the
largest label of their bucket are held against those of other labels by sketches of 512 registers (the comparison is part
of the join): a sixteenth of the pairs whose sketches agree like 0.8 is compared first, which joins nearly all labels that
belong together, and then all pairs of different labels whose sketches do not rule out 0.8 (four standard errors). Each
such pair is met in one bucket only.

Null and empty texts and texts without words are only alike if they are equal (null is empty). Texts of one to four
words are one shingle. Rows without an id are left out of ``classes`` and kept by ``keep_one``; repeated rows of an id
are one document. Texts of any length are read whole. An empty table gives an empty result. Other columns are ignored
by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm import exact_dedup, grams, minhash
from codefacts.llm.batches import bounded
from codefacts.session import materialize

#: similarity from which on two texts are linked
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: registers of a sketch, four bits of each; in two steps: similarity of sketches from which on pairs are compared, and one
#: in how many of those pairs; the last step takes all
REGISTERS, STEPS = 512, ((0.80, 16), (0.72, 1))


def band_table(texts: DataFrame) -> DataFrame:
    """doc, keys (one for each band) and sketch of the texts that have words."""

    def lists(values: np.ndarray) -> pa.Array:
        each = values.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, each), pa.int32()), pa.array(values.ravel(), pa.int64()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
        for batch in batches:
            for lo, hi in grams.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                rows, values, counts = minhash.shingles(part.column("text"))
                # sets are what is verified, so each distinct shingle weighs the same here too
                owner, has = minhash.signatures(rows, values, np.ones_like(counts), hi - lo, REGISTERS)
                owner = owner[has]
                sketch = np.bitwise_or.reduce((owner & np.uint64(15)).reshape(len(owner), REGISTERS // 16, 16) << shifts, axis=2)
                keys = minhash.band_keys(owner[:, : BANDS * ROWS], BANDS)
                yield pa.RecordBatch.from_arrays([part.column("doc").filter(pa.array(has)), lists(keys), lists(sketch.view(np.int64))], names=["doc", "keys", "sketch"])

    return bounded(texts).mapInArrow(work, "doc long, keys array<long>, sketch array<long>")


def sketches_agree(mine: Column, other: Column, similarity: float) -> Column:
    """Whether two sketches agree in as many registers as texts of that similarity do on average."""
    differ = F.lit(0)
    for k in range(REGISTERS // 16):
        x = F.get(mine, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= int(REGISTERS * 15 / 16 * (1 - similarity))


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have similar sets of shingles."""
    other = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    mine = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(other, "b").join(mine, "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in grams.slices(batch.column("text_a")):
                part = batch.slice(lo, hi - lo)
                n = hi - lo
                row_a, value_a, _ = minhash.shingles(part.column("text_a"))
                row_b, value_b, _ = minhash.shingles(part.column("text_b"))
                row, value = np.r_[row_a, row_b], np.r_[value_a, value_b]
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                common = np.bincount(row[1:][twice], minlength=n)
                union = np.bincount(row, minlength=n) - common
                linked = pa.array((common >= SIMILARITY * union - 1e-9) & (union > 0))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(linked), part.column("b").filter(linked)], names=["a", "b"])

    return bounded(both.select("a", "b", "text_a", "text_b")).mapInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc, class) of all ends of ``links`` (a, b); the class is the smallest id of the connected part.

    Alternating stars: larger neighbours are hung on the smallest neighbour, then smaller ones, until nothing changes.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    while True:
        # every node takes its larger neighbours to its smallest one
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select("v", F.col("m").alias("u")).filter("u < v").distinct()
        large = materialize(large)
        # every node takes its smaller neighbours to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = materialize(small.unionByName(least.select("v", F.col("m").alias("u"))).filter("u < v").distinct())
        same = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        next_ = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        edges = new
        if same == next_:
            break
    roots = edges.select(F.col("u").alias("doc"), F.col("u").alias("class"))
    return materialize(edges.select(F.col("v").alias("doc"), F.col("u").alias("class")).unionByName(roots).groupBy("doc").agg(F.min("class").alias("class")))


def _between(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(class_a, class_b): different labels that links connect."""
    name = lambda end: labels.select(F.col("doc").alias(end), F.col("class").alias(f"class_{end}"))
    return links.join(name("a"), "a").join(name("b"), "b").filter("class_a <> class_b").select("class_a", "class_b").distinct()


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (doc, class) after hanging every class on the smallest class it is linked to, followed up twice.

    Texts of one label are connected; connected texts may still have several labels.
    """
    between = materialize(_between(labels, links))
    both = between.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).unionByName(between.select(F.col("class_b").alias("u"), F.col("class_a").alias("v")))
    hung = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")))
    for _ in range(2):
        hung = hung.join(hung.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"))
    return materialize(labels.join(hung.select(F.col("u").alias("class"), F.col("v").alias("new")), "class", "left").select("doc", F.coalesce("new", "class").alias("class")))


def _cross_pairs(buckets: DataFrame, bands: DataFrame, labels: DataFrame, similarity: float, one_in: int) -> DataFrame:
    """Pairs (a, b) of one bucket with different labels and sketches like ``similarity``, each once, or one in so many."""
    member = buckets.join(labels, "doc")
    counted = member.groupBy("key", "class").agg(F.count("*").alias("n"))
    open_keys = counted.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.count("*").alias("classes")).filter("classes > 1")
    member = materialize(member.join(open_keys.select("key", "largest"), "key").join(bands, "doc"))
    outside = member.filter("class <> largest").select("key", F.col("doc").alias("a"), F.col("class").alias("of"), F.col("keys").alias("own"), F.col("sketch").alias("mine"))
    # a pair counts in the first bucket it shares, and there from one side: keys of different bands never agree
    earlier = F.size(F.array_intersect(F.slice("keys", F.lit(1), F.col("band")), F.col("own")))
    once = (F.col("class") == F.col("largest")) | (F.col("a") < F.col("doc"))
    chosen = F.pmod(F.xxhash64("a", "doc"), F.lit(one_in)) == 0 if one_in > 1 else F.lit(True)
    alike = sketches_agree(F.col("mine"), F.col("sketch"), similarity)
    met = outside.join(member, [outside["key"] == member["key"], F.col("of") != F.col("class"), once, chosen, alike, earlier == 0])
    return materialize(met.select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")))


def linked_classes(texts: DataFrame) -> DataFrame:
    """(doc, class) of the texts that share a bucket with another; ``texts`` has doc and text, no text twice."""
    bands = materialize(band_table(texts))
    entries = bands.select("doc", F.posexplode("keys").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader")
    buckets = materialize(entries.join(shared, "key"))
    labels = materialize(buckets.select("doc").distinct().withColumn("class", F.col("doc")))
    held = materialize(texts.join(labels.select("doc").hint("shuffle_hash"), "doc"))

    pairs = buckets.filter("leader <> doc").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    links = [materialize(similar(pairs, held))]
    labels = _relabel(labels, links[0])
    buckets = buckets.drop("leader")
    for similarity, one_in in STEPS:
        links.append(materialize(similar(_cross_pairs(buckets, bands, labels, similarity, one_in), held)))
        if one_in > 1:
            labels = _relabel(labels, links[-1])
    # a link may have joined one of its ends to something smaller only, so all links count again, between labels
    every = reduce(DataFrame.unionByName, links)
    parts = components(_between(labels, every).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    return labels.join(parts.select(F.col("doc").alias("class"), F.col("class").alias("joined")), "class", "left").select("doc", F.coalesce("joined", "class").alias("class"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per id: doc_id, class_id (the smallest id of its class), class_size and kept (true for that id)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    mixed = F.min("digest") != F.max("digest")  # rows of an id have several texts
    equal = materialize(exact_dedup.groups(named).groupBy("doc_id").agg(F.max("keep_id").alias("rep"), F.min("group_size").alias("size"), mixed.alias("mixed")))
    if not equal.filter("mixed").isEmpty():
        return _classes_of_rows(named)
    copies = equal.filter("doc_id <> rep").select(F.col("doc_id").alias("doc"))
    texts = named.select(F.col("doc_id").alias("doc"), "text").join(copies.hint("shuffle_hash"), "doc", "left_anti")
    linked = linked_classes(texts)
    # the classes of texts, then of their equal copies
    of_rep = equal.join(linked.select(F.col("doc").alias("rep"), "class"), "rep", "left").select("doc_id", F.coalesce("class", "rep").alias("class"))
    of_rep = materialize(of_rep)
    size = of_rep.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    several = size.filter("class_size > 1")
    joined = of_rep.join(several, "class", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), (class_id == F.col("doc_id")).alias("kept"))


def _classes_of_rows(named: DataFrame) -> DataFrame:
    """``classes`` where an id may have several texts: classes of rows, joined where they share an id."""
    rows = materialize(named.dropDuplicates(["doc_id", "text"]).withColumn("row", F.monotonically_increasing_id()))
    found = classes(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("class_id").alias("part"))
    of_id = materialize(rows.select("row", "doc_id").join(found, "row").select("doc_id", "part").distinct())
    first = of_id.groupBy("doc_id").agg(F.min("part").alias("first"))
    joined = components(of_id.join(first, "doc_id").select(F.col("part").alias("a"), F.col("first").alias("b")))
    whole = of_id.join(joined.select(F.col("doc").alias("part"), "class"), "part", "left").select("doc_id", F.coalesce("class", "part").alias("class")).distinct()
    whole = materialize(whole)
    size = whole.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return whole.join(size, "class").select("doc_id", "class_id", "class_size", (F.col("class_id") == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with all columns."""
    gone = classes(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["__gone"], "left_anti")
