"""Benchmark decontamination with a full-text index for each shard of the documents.

A shard is a slice of the rows of a task. Its words are numbered by the words of the benchmark; runs of benchmark words
that are long enough to hold a phrase are indexed (no phrase can lie elsewhere), phrases are found by backward search,
their occurrences are located through sampled positions, and what they cover is merged into spans. Documents are never
moved. The benchmark is sent to the tasks in blocks of bounded size, one after another, each adding its spans; marks of a block
are written to the shared folder before the next one is fetched, so the driver and the tasks hold one block at a time.

Words: A-Z count as a-z; a word is a run of a-z, 0-9 and characters beyond ASCII. A phrase is 13 consecutive words of an
item, or a whole item of fewer words. Words are compared by 64-bit hashes. Null and empty texts have no words, no hits
and are kept; items without words are never found; items without an id mark words but are not listed; repeated items and
rows count as one and as each; an empty table on either side gives no hits. Other columns are passed on by ``drop``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm import grams
from codefacts.llm import words as W
from codefacts.llm.batches import bounded
from codefacts.llm.fmindex import FMIndex
from codefacts.session import materialize

#: words of a phrase
PHRASE = 13
#: bytes of benchmark text that are searched for at once
BLOCK = 16 << 20
#: a document is contaminated if at least one in so many of its words is hit
SHARE = 20


class Phrases:
    """The phrases of some items: words numbered from 2 on, phrases by length, and the items of each phrase."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        texts = pa.array([t for _, t in items], pa.string())
        found = [(h, r) for h, r in W.row_words(texts, 0)]
        hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        rows = np.concatenate([r for _, r in found]) if found else np.zeros(0, np.int64)
        self.ids = [i for i, _ in items]
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = numbers + 2
        first = np.searchsorted(rows, np.arange(len(items) + 1))
        by_length: dict[int, dict[bytes, set[int]]] = {}
        for i in range(len(items)):
            mine = numbers[first[i] : first[i + 1]].astype(np.int64)
            length = min(PHRASE, len(mine))
            for k in range(len(mine) - length + 1 if length else 0):
                by_length.setdefault(length, {}).setdefault(mine[k : k + length].tobytes(), set()).add(i)
        self.groups = [
            (n, np.frombuffer(b"".join(found), np.int64).reshape(-1, n), [sorted(x) for x in found.values()]) for n, found in sorted(by_length.items())
        ]
        self.shortest = min((n for n, _, _ in self.groups), default=0)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; 0 for words that the phrases do not have."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 0).astype(np.int32)


def find(texts: pa.Array, phrases: Phrases) -> list[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
    """For each text: number of words, hit spans (first word, end word, first byte, end byte), found items."""
    data, offsets = W.string_buffers(texts)
    numbers, rows, starts, ends = [], [], [], []
    for lo, hi in W.pieces(data, offsets):
        w = W.words_of(data, offsets, lo, hi)
        numbers.append(phrases.number(w.hashes))
        rows.append(w.rows.astype(np.int32))
        starts.append(w.starts)
        ends.append(w.ends)
    if not numbers:
        return [(0, [], []) for _ in range(len(offsets) - 1)]
    number, row, start, end = map(np.concatenate, (numbers, rows, starts, ends))
    total = np.bincount(row, minlength=len(offsets) - 1)
    first_word = np.concatenate([[0], np.cumsum(total)])
    out: list = [(int(n), [], []) for n in total]
    known = number > 0
    if not phrases.shortest or not known.any():
        return out
    # runs of known words within one text
    edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (row[1:] != row[:-1]), True])
    runs = np.flatnonzero(known[edge[:-1]] & (np.diff(edge) >= phrases.shortest))
    if not len(runs):
        return out
    first, length = edge[runs], np.diff(edge)[runs]
    # the index's text: the runs with a 1 after each, and where each of its words stands among all words
    place = np.concatenate([[0], np.cumsum(length + 1)])
    source = np.full(place[-1], -1, np.int64)
    body = np.ones(place[-1], bool)
    body[place[1:] - 1] = False
    source[body] = np.repeat(first - place[:-1], length) + np.flatnonzero(body)
    text = np.where(body, number[source], 1)
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    hit = np.zeros(len(number) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for size, table, owners in phrases.groups:
        lo, hi = index.search(table)
        counts = hi - lo
        got = np.flatnonzero(counts)
        if not len(got):
            continue
        which = np.repeat(got, counts[got])
        rows_found = np.arange(len(which)) - np.repeat(np.cumsum(counts[got]) - counts[got], counts[got]) + lo[which]
        at = source[index.locate(rows_found)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + size, -1)
        for r, p in np.unique(np.stack([row[at].astype(np.int64), which], 1), axis=0).tolist():
            items.setdefault(r, set()).update(owners[p])
    covered = np.cumsum(hit[:-1]) > 0
    edge = np.flatnonzero(np.r_[True, (covered[1:] != covered[:-1]) | (row[1:] != row[:-1]), True])
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if covered[a]:
            base, word = int(offsets[row[a]]), int(a - first_word[row[a]])
            out[row[a]][1].append((word, word + int(b - a), int(start[a]) - base, int(end[b - 1]) - base))
    for r, found in items.items():
        out[r][2].extend(sorted({phrases.ids[i] for i in found if phrases.ids[i] is not None}))
    return out


def _in_code_points(text: str, spans: list[tuple[int, int, int, int]]) -> list[dict]:
    raw, out, at, chars = text.encode(), [], 0, 0
    for first, end, a, b in spans:
        start = chars + len(raw[at:a].decode())
        at, chars = b, start + len(raw[a:b].decode())
        out.append({"first_word": first, "end_word": end, "start": start, "end": chars})
    return out


_PARTS = ("first_word", "end_word", "start", "end")
_SPANS = pa.list_(pa.struct([(name, pa.int64()) for name in _PARTS]))
_MARKED = f"n_words long, spans array<struct<{','.join(f'{name}:long' for name in _PARTS)}>>, items array<string>"


def blocks_of(benchmark: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """The items in parts of about ``block`` bytes; the larger the benchmark, the more parts."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    parts = int(size) // block + 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _with_block(docs: DataFrame, part: DataFrame, first: bool) -> DataFrame:
    """Adds n_words, spans and items of one block; spans and items of blocks before stay beside them, in lists."""
    items = [(r.item_id, r.text) for r in part.collect()]  # one block, of bounded size
    columns = docs.columns
    at = columns.index("text")
    made = ["n_words", "spans", "items"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items)
        for batch in batches:
            for lo, hi in grams.slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                found = find(part.column(at), phrases)
                texts = part.column(at)
                spans = [_in_code_points(texts[i].as_py(), s) if s else [] for i, (_, s, _) in enumerate(found)]
                items_found = [x for _, _, x in found]
                if not first:
                    spans = [a + b for a, b in zip(part.column("spans").to_pylist(), spans, strict=True)]
                    items_found = [a + b for a, b in zip(part.column("items").to_pylist(), items_found, strict=True)]
                kept = [part.column(i) for i in range(len(columns))]
                old = dict(zip(columns, kept, strict=True)) | {
                    "n_words": pa.array([n for n, _, _ in found], pa.int64()),
                    "spans": pa.array(spans, _SPANS),
                    "items": pa.array(items_found, pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays(list(old.values()), names=list(old))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in made)
    return bounded(docs).mapInArrow(work, f"{schema}, {_MARKED}")


def _merged(spans: Column) -> Column:
    """Spans that overlap or touch become one; blocks of the benchmark may each have found a part."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first_word"].alias("first_word"), F.greatest(last["end_word"], span["end_word"]).alias("end_word"),
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
        )
        return (
            F.when(F.size(done) == 0, F.array(span))
            .when(span["first_word"] <= last["end_word"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))
            .otherwise(F.concat(done, F.array(span)))
        )

    empty = F.array().cast(f"array<struct<{','.join(f'{name}:long' for name in _PARTS)}>>")
    return F.aggregate(F.array_sort(spans), empty, add)


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def _marked(docs: DataFrame, benchmark: DataFrame, block: int) -> tuple[DataFrame, int]:
    parts = blocks_of(benchmark, block)
    for k, part in enumerate(parts):
        docs = _with_block(docs, part, first=k == 0)
        if k + 1 < len(parts):  # its marks are written before the next block is fetched, so one block at a time is held
            docs = materialize(docs)
    return docs, len(parts)


def mark(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted), spans (in words and code points, ends exclusive), contaminated."""
    marked, parts = _marked(docs.select("doc_id", "text"), benchmark, block)
    marked = marked.select("doc_id", "n_words", F.array_sort(F.array_distinct("items")).alias("items"), (_merged(F.col("spans")) if parts > 1 else F.col("spans")).alias("spans"))
    marked = marked.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"]))
    return marked.select("doc_id", "n_words", "n_hit", "items", "spans", is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def drop(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; no row is moved."""
    at = docs.columns.index("text")  # their columns get other names meanwhile, so that none is taken for one of ours
    names = ["text" if k == at else f"own_{k}" for k in range(len(docs.columns))]
    marked, _ = _marked(docs.toDF(*names), benchmark, block)
    n_hit = F.aggregate(_merged(F.col("spans")), F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return marked.filter(~is_contaminated(F.col("n_words"), n_hit)).select(*names).toDF(*docs.columns)
