"""Ranked lexical search of a set of query items over all documents by dual-tree search.

Terms are runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z. A document's score for an item is
the inner product of the item's term weights and the document's saturated term frequencies, in 64-bit integers. Items and
documents both stand in hierarchies whose nodes hold the largest value of each coordinate below them. The product of two
nodes' maxima bounds every score between them; where it is below the weakest k-th score among the node's items, the whole
batch of pairs is left out, which changes no result. Else both nodes are opened, down to leaves that are scored exactly.

Items go in blocks of bounded size, one block after another; only a block's terms, weights and thresholds are on the driver
and sent to tasks. For each block documents are read once and become sparse vectors of the block's terms, which are written
to the shared folder. Every task builds hierarchies over its own documents and passes on at most k results for each item;
first thresholds come from a bounded sample of documents (they only ever leave out what a better k-th score leaves out
anyway). Partial results are cut to k in salted groups before they meet. Terms are told apart by 64 bits of hash.

Null and empty texts have no terms: such a document is not counted and never found, such an item finds nothing. Texts of any
length count whole. Rows that repeat a ``doc_id`` are documents of their own; equal scores go by ascending id, ids that are
null last. Every row of the items is an item of its own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm import words as W
from codefacts.llm.batches import bounded
from codefacts.session import ensure_checkpoint_dir, materialize

#: results for each item
TOP = 20
#: items and bytes of item text that are searched together, at most; a single longer item is a block of its own
ITEMS, TEXT = 2048, 1 << 20
#: items of one hierarchy, and cells of its dense matrices
GROUP, CELLS = 256, 1 << 22
#: documents of one hierarchy; rows of leaves
TREE, LEAF_DOCS, LEAF_ITEMS = 4096, 32, 8
#: documents that give the first thresholds
SAMPLE = 4096
#: groups in which partial results of an item are cut before they meet
SALTS = 32
#: saturation: SCALE * tf div (1000 * tf + SLOPE * m), where m is 100 - SHARE + (SHARE * length * documents) div all lengths
SCALE, SLOPE, SHARE = 1_000_000_000, 12, 25


class Sparse(NamedTuple):
    """Rows of (column, value), row r at ``at[r]:at[r + 1]``; columns of a row are distinct and rise."""

    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def rows(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some rows, one after another: (place in ``order``, column, value)."""
        size = self.at[order + 1] - self.at[order]
        place = np.repeat(np.arange(len(order)), size)
        index = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[order], size)
        return place, self.columns[index], self.values[index]


# ---------------------------------------------------------------- terms


def sparse_counts(texts: pa.Array, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, Sparse]:
    """Number of terms of each text, and how often it has which term; columns are hashes, or places in a sorted vocabulary."""
    lengths, found = np.zeros(len(texts), np.int64), []
    for hashes, rows in W.row_words(texts):
        lengths += np.bincount(rows, minlength=len(texts))
        if vocabulary is not None:
            place = np.searchsorted(vocabulary, hashes)
            place[place == len(vocabulary)] = 0
            known = vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            hashes, rows = place[known].astype(np.uint64), rows[known]
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, np.int64)
        found.append((rows[first], hashes[first], np.diff(np.r_[first, len(rows)])))
    if not found:
        return lengths, Sparse(np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows, columns, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((columns, rows))  # a long text goes on from one piece to the next: its counts are added up
    rows, columns, counts = rows[order], columns[order], counts[order]
    first = np.flatnonzero(np.r_[True, (columns[1:] != columns[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts, first) if len(first) else counts
    return lengths, Sparse(np.searchsorted(rows[first], np.arange(len(texts) + 1)), columns[first], total)


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, length and, as packed 32-bit numbers, terms of the vocabulary and their frequencies; documents without terms have no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, counts = sparse_counts(batch.column("text"), vocabulary)
            rows = np.flatnonzero(lengths)
            terms, tf = counts.columns.astype(np.int32), counts.values.astype(np.int32)
            pack = lambda x, counts=counts, rows=rows: pa.array([x[counts.at[r] : counts.at[r + 1]].tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(lengths[rows]), pack(terms), pack(tf)], names=["doc_id", "length", "terms", "tf"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(work, "doc_id long, length long, terms binary, tf binary")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents have each term of a vocabulary of ``size`` terms; a partial sum for each task, ``size`` sums on the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            packed = b"".join(batch.column("terms").to_pylist())
            total += np.bincount(np.frombuffer(packed, np.int32), minlength=size)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    if size:
        for r in rows.select("terms").mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[r.term] = r.n
    return out


# ---------------------------------------------------------------- hierarchies


class Tree(NamedTuple):
    """Rows in ``order``; node i covers ``order[lo[i]:hi[i]]`` and has two children or -1. Node 0 is the root; children come later."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray


def build(rows: Sparse, weight: np.ndarray, leaf: int) -> Tree:
    """Halves rows again and again by whether they have the column that parts them best; ``weight`` tells what a column matters."""
    order = np.arange(len(rows.at) - 1)
    spans, left, right = [(0, len(order))], [-1], [-1]
    k = 0
    while k < len(spans):
        lo, hi = spans[k]
        if hi - lo > leaf:
            mine = order[lo:hi]
            place, column, _ = rows.rows(mine)
            has = np.bincount(column, minlength=len(weight))
            gain = np.minimum(has, len(mine) - has) * weight
            best = int(gain.argmax()) if len(gain) else -1
            cut = int(has[best]) if best >= 0 else 0
            if best >= 0 and min(cut, len(mine) - cut) * 16 >= len(mine):
                with_it = np.zeros(len(mine), bool)
                with_it[place[column == best]] = True
                order[lo:hi] = np.r_[mine[with_it], mine[~with_it]]
            else:  # nothing parts them well: the longer rows first
                size = rows.at[mine + 1] - rows.at[mine]
                order[lo:hi] = mine[np.argsort(-size, kind="stable")]
                cut = len(mine) // 2
            left[k], right[k] = len(spans), len(spans) + 1
            spans += [(lo, lo + cut), (lo + cut, hi)]
            left += [-1, -1]
            right += [-1, -1]
        k += 1
    lo, hi = np.array(spans).T
    return Tree(order, lo, hi, np.array(left), np.array(right))


def maxima(rows: Sparse, tree: Tree) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, largest values) of every node, from the leaves up."""
    out: list = [None] * len(tree.lo)
    for k in range(len(out) - 1, -1, -1):
        if tree.left[k] < 0:
            _, column, value = rows.rows(tree.order[tree.lo[k] : tree.hi[k]])
        else:
            (a, x), (b, y) = out[tree.left[k]], out[tree.right[k]]
            column, value = np.r_[a, b], np.r_[x, y]
        by = np.argsort(column, kind="stable")
        column, value = column[by], value[by]
        first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
        out[k] = column[first], np.maximum.reduceat(value, first) if len(first) else value
    return out


class Group(NamedTuple):
    """Items of one hierarchy: their numbers, which terms of the vocabulary are its columns, and dense weights."""

    numbers: np.ndarray
    terms: np.ndarray
    tree: Tree
    weights: np.ndarray  # items in tree order x columns
    node_weights: np.ndarray  # nodes x columns


def group_items(items: Sparse) -> list[Group]:
    """Hierarchies over items (rows of term and weight), each of bounded size. Numbers are exact in whichever type is used."""
    out, lo, n = [], 0, len(items.at) - 1
    while lo < n:
        hi = lo + 1
        while hi < n and hi - lo < GROUP and (items.at[hi + 1] - items.at[lo]) * (hi + 1 - lo) <= CELLS:
            hi += 1
        numbers = np.arange(lo, hi)
        place, term, weight = items.rows(numbers)
        terms, column = np.unique(term, return_inverse=True)
        own = Sparse(np.searchsorted(place, np.arange(len(numbers) + 1)), column, weight)
        tree = build(own, np.bincount(column, weight, len(terms)) / np.maximum(1, np.bincount(column, minlength=len(terms))), LEAF_ITEMS)
        most = np.zeros(len(terms), np.int64)
        np.maximum.at(most, column, weight)
        kind = np.float64 if int(most.sum()) * (SCALE // 1000) < 1 << 53 else np.int64
        weights = np.zeros((len(numbers), len(terms)), kind)
        spot = np.empty(len(numbers), np.int64)
        spot[tree.order] = np.arange(len(numbers))
        weights[spot[place], column] = weight
        nodes = np.stack([weights[a:b].max(0) for a, b in zip(tree.lo, tree.hi, strict=True)])
        out.append(Group(numbers[tree.order], terms, tree, weights, nodes))
        lo = hi
    return out


# ---------------------------------------------------------------- search


class Best:
    """The k best results so far for each item, and the score from which on a document may still be one of them."""

    def __init__(self, numbers: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.numbers, self.k = numbers, k
        self.least = np.maximum(floor[numbers], 1)
        none = np.zeros(0, np.int64)
        self.found = [(none, none, np.zeros(0, bool)) for _ in numbers]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = (np.r_[a, b] for a, b in zip(self.found[item], (scores, ids, missing), strict=True))
        if len(scores) > self.k:
            first = np.lexsort((ids, missing, -scores))[: self.k]
            scores, ids, missing = scores[first], ids[first], missing[first]
        self.found[item] = scores, ids, missing
        if len(scores) == self.k:
            self.least[item] = max(self.least[item], int(scores.min()))


def dual_search(group: Group, docs: Sparse, ids: np.ndarray, missing: np.ndarray, best: Best) -> int:
    """Adds the documents (columns as those of the group) that belong to the best; returns how many pairs were scored."""
    tree = build(docs, group.node_weights[0].astype(float), LEAF_DOCS)
    doc_max = maxima(docs, tree)
    items, scored = group.tree, 0
    need = np.array([best.least[a:b].min() for a, b in zip(items.lo, items.hi, strict=True)])
    open_pairs = [(0, np.zeros(1, np.int64))]  # a node of documents and the nodes of items that it is still compared with
    while open_pairs:
        node, active = open_pairs.pop()
        columns, value = doc_max[node]
        active = active[group.node_weights[active][:, columns] @ value >= need[active]]
        if not len(active):
            continue
        opened = items.left[active] >= 0
        below = np.r_[active[~opened], items.left[active[opened]], items.right[active[opened]]]
        if tree.left[node] >= 0:
            open_pairs += [(tree.left[node], below), (tree.right[node], below)]
            continue
        if opened.any():  # the same leaf of documents with smaller nodes of items
            open_pairs.append((node, below))
            continue
        mine = tree.order[tree.lo[node] : tree.hi[node]]
        place, column, value = docs.rows(mine)
        dense = np.zeros((len(columns), len(mine)), group.weights.dtype)
        dense[np.searchsorted(columns, column), place] = value
        at = np.concatenate([np.arange(items.lo[k], items.hi[k]) for k in active])
        scores = group.weights[at][:, columns] @ dense
        scored += scores.size
        hits = scores >= best.least[at][:, None]
        hit_rows = np.flatnonzero(hits.any(1))
        for r in hit_rows:
            some = np.flatnonzero(hits[r])
            best.add(int(at[r]), scores[r, some].astype(np.int64), ids[mine[some]], missing[mine[some]])
        if len(hit_rows):
            need = np.array([best.least[a:b].min() for a, b in zip(items.lo, items.hi, strict=True)])
    return scored


def _results(rows: DataFrame, items: Sparse, floor: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """number, doc_id and score: for every task and item up to ``k`` results."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = group_items(items)
        bests = [Best(g.numbers, floor, k) for g in groups]
        size = 1 + max((int(g.terms.max(initial=-1)) for g in groups), default=-1)

        def flush(kept: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(kept).combine_chunks()
            ids = table.column("doc_id")
            missing = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            length = np.asarray(table.column("length"))
            terms = [np.frombuffer(b, np.int32) for b in table.column("terms").to_pylist()]
            counts = np.frombuffer(b"".join(table.column("tf").to_pylist()), np.int32).astype(np.int64)
            row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            term = np.concatenate(terms)
            m = 100 - SHARE + SHARE * length * n // total
            value = SCALE * counts // (1000 * counts + SLOPE * m[row])
            for group, best in zip(groups, bests, strict=True):
                column = np.full(size, -1)
                column[group.terms] = np.arange(len(group.terms))
                mine = np.flatnonzero(column[term] >= 0)
                if not len(mine):
                    continue
                docs = Sparse(np.searchsorted(row[mine], np.arange(len(terms) + 1)), column[term[mine]], value[mine].astype(group.weights.dtype))
                dual_search(group, docs, ids, missing, best)

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) >= TREE:
                flush(kept)
                kept = []
        if kept and sum(map(len, kept)):
            flush(kept)
        for best in bests:
            for number, (scores, ids, missing) in zip(best.numbers, best.found, strict=True):
                if len(scores):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(scores), number, np.int32)), pa.array(ids, mask=missing), pa.array(scores)], names=["number", "doc_id", "score"]
                    )

    return rows.mapInArrow(work, "number int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each number with their ranks; first within salted groups, so that no task meets all of an item's."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)


def item_blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive items; the driver holds one partition of them at a time, tasks one block."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).toLocalIterator():
        if ids and (len(ids) == ITEMS or size + len(r.text) > TEXT):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield ids, texts


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents (doc_id, text) with a score above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/tables/{uuid.uuid4().hex}"
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(root)
    for ids, texts in item_blocks(items):
        _, counts = sparse_counts(pa.array(texts, pa.large_string()))
        vocabulary, place = np.unique(counts.columns, return_inverse=True)
        rows = materialize(vectors(docs, vocabulary))
        sums = rows.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
        if not sums.n or not len(vocabulary):
            continue
        df = document_frequencies(rows, len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * sums.n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        queries = Sparse(counts.at, place, counts.values * weight[place])
        floor = np.zeros(len(ids), np.int64)
        # about so many rows, drawn where they lie and brought together; whichever they are, no result depends on them
        sample = rows.where(F.rand(17) < F.lit(min(1.0, SAMPLE / sums.n))).repartition(1)
        for r in _results(sample, queries, floor, sums.n, sums.total, k).groupBy("number").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect():
            if r.n == k:  # at most one row for each item of the block
                floor[r.number] = r.least
        best = _ranked(_results(rows, queries, floor, sums.n, sums.total, k), k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"number int, item_id {kind}"))
        best.join(names, "number").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(root)
    return spark.read.schema(schema).parquet(root)
