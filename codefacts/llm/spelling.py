"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the frequent form of each.

Dense prefix-suffix tiling. Two unlike words are one edit apart exactly if their common prefix and common suffix together
reach the longer length minus one, ``m``. So one of the two is at least half of ``m``: words meet in blocks of equal
length class that share half of ``m`` at the front or at the back. A block of more than ``BLOCK`` words is divided again by
half of what is left, at the front or at the back, until it is small or nothing is left (then its words differ in one
place only, and there are no more of them than letters); no partner is ever left out. In every block, words become padded
code-point matrices, and tiles of them are compared with one another, all pairs of a tile at once. A pair that several
blocks hold counts in the first one only, the one with the front in common. What leaves a block is a count and the best
partner for each of its words, never its pairs.

Null texts have no words; texts and words of any length count whole. A null ``doc_id`` is written as nothing. Rows that
repeat count as often as they stand there. Ties between partners go to the smaller word in code-point order. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions.skew import salted_join
from codefacts.llm.batches import bounded
from codefacts.session import materialize

#: code points of a word, occurrences, and times the word's own count that its form must have, at least
LETTERS, OCCURRENCES, RATIO = 7, 2, 10
#: of so many runs one loses a code point
NOISE = 31
#: words of a block that is not divided any more, and cells that are compared at once
BLOCK, CELLS = 512, 1 << 22
#: different words that a task counts before it passes them on
HELD = 200_000
#: rows of blocks that are compared together, at least
ROWS = 1 << 15
#: the front that a pair of a block must not share, where any will do
_ANY = 1 << 30


# ---------------------------------------------------------------- words


def noisy_words(text: str, doc_id: str, letters: int = LETTERS, noise: int = NOISE) -> Counter:
    """The words of a text by number; runs whose hash with the id is divisible by ``noise`` have lost a code point."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % letters)
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, so only A-Z change
    found = Counter(runs.findall(low)) if len(low) < 1 << 22 else Counter(m.group() for m in runs.finditer(low))
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < letters:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word and n of all words of whole texts."""

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    total.update(noisy_words(text.as_py(), doc_id.as_py(), letters))
                if len(total) > HELD:
                    yield table(total)
                    total = Counter()
        yield table(total)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return bounded(rows).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# ---------------------------------------------------------------- blocks


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of the block: length class, what is shared at the front and at the back, and its limit."""
    front = F.substr(F.col("word"), F.lit(1), F.col("front"))
    back = F.substr(F.col("word"), F.char_length("word") - F.col("back") + 1, F.col("back"))
    parts = [F.col(c).cast("string") for c in ("width", "below", "front", "back")]
    return rows.withColumn("key", F.concat_ws(":", *parts, front, back))


def _divide(rows: DataFrame) -> DataFrame:
    """Each word once for half of what is left at the front, once for half of it at the back."""
    left = F.col("width") - 1 - F.col("front") - F.col("back")
    half = F.ceil(left / 2).cast("int")
    by_front = F.struct((F.col("front") + half).alias("front"), F.col("back"), F.col("below"))
    by_back = F.struct(F.col("front"), (F.col("back") + half).alias("back"), F.least("below", F.col("front") + half).alias("below"))
    return rows.select("word", "n", "width", F.explode(F.array(by_front, by_back)).alias("s")).select("word", "n", "width", "s.front", "s.back", "s.below")


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """key, width, below, word and n: every word in all blocks in which a word one edit apart may stand."""
    classes = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1))
    rows = words.select("word", "n", classes.alias("width"), F.lit(0).alias("front"), F.lit(0).alias("back"), F.lit(_ANY).alias("below"))
    rows, done = _keyed(_divide(rows)), None
    while True:
        left = F.col("width") - 1 - F.col("front") - F.col("back")
        sizes = rows.where(left > 0).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most)
        hot = materialize(sizes.select("key"))
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = materialize(salted_join(rows, hot.withColumn("hot", F.lit(True)), ["key"], ["word"], "left"))
        small = marked.where("hot is null").drop("hot")
        done = small if done is None else done.unionByName(small)
        rows = _keyed(_divide(marked.where("hot")))


# ---------------------------------------------------------------- tiles


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the front, code points from the back, both padded with zeros to ``width``, and lengths."""
    front = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    at = lengths[:, None] - 1 - np.arange(width)[None, :]
    back = np.where(at >= 0, np.take_along_axis(front, np.maximum(at, 0), 1), 0)
    small = np.uint8 if not len(words) or front.max() < 256 else np.uint32
    return front.astype(small), back.astype(small), lengths


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For stacks of tiles (stack, rows, width): how many leading columns the rows of one and of the other share."""
    unlike = a[:, :, None, :] != b[:, None, :, :]
    first = unlike.argmax(-1)
    return np.where(np.take_along_axis(unlike, first[..., None], -1)[..., 0], first, unlike.shape[-1])


def near(tile, other, width: int, below: np.ndarray) -> np.ndarray:
    """Which rows of two stacks of tiles are one edit apart: common prefix and suffix reach the longer length minus one."""
    (front, back, length), (front_b, back_b, length_b) = tile, other
    longer = np.maximum(length[:, :, None], length_b[:, None, :])
    real = np.minimum(length[:, :, None], length_b[:, None, :]) > 0
    prefix = common(front, front_b)
    fits = real & (longer == width) & (prefix < below[:, None, None]) & (prefix < longer)
    if not fits.any():
        return fits
    return fits & (prefix + common(back, back_b) >= longer - 1)


def _block_results(words: list[str], counts: np.ndarray, starts: np.ndarray, width: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of consecutive blocks of one width: number of near words, and the row of the best of them or -1.

    ``starts`` are the first rows of the blocks and the end of the last. Words of a block are sorted.
    """
    front, back, lengths = matrices(words, width)
    number, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    sizes = np.diff(starts)
    # in each block, rows by falling count, then word: the smallest rank is the best partner
    block_of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((np.arange(len(words)), -counts, block_of))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words)) - starts[:-1][block_of]
    none = len(words)
    found = np.full(len(words), none, np.int64)

    def compare(rows: np.ndarray, others: np.ndarray, limit: np.ndarray) -> None:
        """``rows`` and ``others`` (stack, k) are row numbers, -1 where a block has fewer words."""
        def tile(at: np.ndarray):
            safe = np.maximum(at, 0)
            return front[safe], back[safe], np.where(at >= 0, lengths[safe], 0)

        hit = near(tile(rows), tile(others), width, limit)
        if hit.any():
            at = np.where(hit.any(2))
            number[rows[at]] += hit.sum(2)[at]
            ranks = np.where(hit, rank[np.maximum(others, 0)][:, None, :], none).min(2)
            found[rows[at]] = np.minimum(found[rows[at]], ranks[at])

    several = np.flatnonzero(sizes > 1)
    for k in np.unique(1 << np.ceil(np.log2(sizes[several])).astype(int)) if len(several) else ():
        mine = several[(sizes[several] <= k) & (sizes[several] > k // 2)]
        side = int(max(1, min(k, (CELLS // max(1, width)) ** 0.5)))  # rows of a tile
        stack = int(max(1, CELLS // (side * side * width)))  # blocks that are stacked
        for lo in range(0, len(mine), stack):
            part = mine[lo : lo + stack]
            at = starts[part][:, None] + np.arange(k)[None, :]
            at = np.where(np.arange(k)[None, :] < sizes[part][:, None], at, -1)
            tiles = [at[:, j : j + side] for j in range(0, k, side)]
            for a in tiles:  # block pairs: every tile with every tile
                for b in tiles:
                    compare(a, b, below[part])
    has = found < none
    best[has] = order[starts[:-1][block_of[has]] + found[has]]  # a rank names a row of the same block
    return number, best


def summaries(rows: DataFrame) -> DataFrame:
    """word, n, n_near and best (-n and word of the best partner in the block) for words that have partners, block by block."""

    def results(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of whole blocks; rows are sorted by key, so blocks of one width lie together."""
        key, widths = batch.column("key"), np.asarray(batch.column("width"))
        edge = np.r_[0, np.flatnonzero(np.asarray(pc.not_equal(key[1:], key[:-1]))) + 1, len(batch)] if len(batch) else np.zeros(1, np.int64)
        block_width = widths[edge[:-1]]
        cuts = np.r_[0, np.flatnonzero(np.diff(block_width)) + 1, len(block_width)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            width = int(block_width[lo])
            step_from = lo
            while step_from < hi:  # wide words in parts, so that the matrices stay small
                to = max(step_from + 1, int(np.searchsorted(edge[: hi + 1], edge[step_from] + max(1, 4 * CELLS // width), "right")) - 1)
                to = min(to, hi)
                part = batch.slice(edge[step_from], edge[to] - edge[step_from])
                words, counts = part.column("word").to_pylist(), np.asarray(part.column("n"))
                below = np.asarray(part.column("below"))[edge[step_from:to] - edge[step_from]]
                number, best = _block_results(words, counts, edge[step_from : to + 1] - edge[step_from], width, below)
                has = np.flatnonzero(number)
                if len(has):
                    at = pa.array(has)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("word").take(at), pa.array(counts[has]), pa.array(number[has]), pa.array(-counts[best[has]]), part.column("word").take(pa.array(best[has]))],
                        names=["word", "n", "n_near", "best_n", "best"],
                    )
                step_from = to

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the last block may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            kept.append(batch)
            last = batch.column("key")[len(batch) - 1]
            if sum(map(len, kept)) < ROWS or kept[0].column("key")[0] == last:
                continue
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            key = whole.column("key")
            cut = len(whole) - int(pc.sum(pc.equal(key, last)).as_py())
            yield from results(whole.slice(0, cut))
            kept = [whole.slice(cut)]
        if kept:
            yield from results(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    dealt = rows.select("key", "width", "below", "word", "n").repartition("key").sortWithinPartitions("key", "word")
    return dealt.mapInArrow(work, "word string, n long, n_near long, best_n long, best string")


# ---------------------------------------------------------------- forms


def variants(words: DataFrame, ratio: int = RATIO, most: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word (word, n; each word once)."""
    words = materialize(words)
    none = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    every = words.select("word", "n", *none).unionByName(summaries(blocks(words, most)))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct("best_n", "best")))
    summed = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    takes = -F.col("b.best_n") >= ratio * F.col("n")
    known = materialize(summed.select("word", "n", "n_near", F.when(takes, F.col("b.best")).alias("form"), F.when(takes, -F.col("b.best_n")).alias("form_n")))
    return known.join(roots(known.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where the forms of a word lead; each round doubles the steps that are taken."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now
