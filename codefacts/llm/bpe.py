"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts with one state that has an arc to itself for every byte, and the merges are put in
one after another: for a merge of u and v, states entered by u are replaced by a copy without the arc v, and wherever u
could be followed by v an arc labelled uv leads to where v led. In the end exactly the right token sequences have a path.
A state differs from its original by the arcs cut from it, so states are kept as versions: per token the arcs cut after
it with the number of the merge that did it, and per state the tokens whose cuts it has taken over, each up to a merge.
Transitions are looked up in a table that is filled as they are first needed.

A word is encoded by running over its bytes: from each position the labels that begin there are followed through a trie,
and an arc is taken if the table has it. Every prefix of a word has one right path, so each position keeps one state.
Texts are split into words by the pattern of byte-level tokenizers, words are encoded once and remembered (a bounded
number of them), and decoding joins the labels of the ids.

Null texts are empty and have no tokens. Texts of any length are split piece by piece. Equal texts have equal ids;
repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codefacts.llm import grams
from codefacts.llm.batches import bounded

#: remembered words and transitions of one worker, at most
WORDS, TRANSITIONS = 500_000, 250_000
#: characters that are split into words at once
PIECE = 1 << 20

# The pattern of byte-level tokenizers, and their characters for bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# End of fixed values.
_NEVER = 1 << 60


def byte_of_char() -> dict[str, int]:
    """The byte that a character of the vocabulary file stands for: itself if printable, else one from 256 on, in order."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The automaton of one vocabulary file (byte-level BPE, no normalizer, plain added tokens)."""

    def __init__(self, spec: dict) -> None:
        model, split = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are understood")
        if model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("dropout and ignore_merges are not understood")
        to_byte = byte_of_char()
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        vocab: dict[str, int] = model["vocab"]
        self.labels: dict[int, bytes] = {i: as_bytes(t) for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take white space along are not understood")
        self.added = added
        self.labels |= {i: t.encode() for t, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        single = {b: vocab[c] for c, b in to_byte.items() if c in vocab}
        # ends[t]: tokens that end t, with the merge that hid each of them; starts[t]: those that begin it
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {t: ((t, _NEVER),) for t in single.values()}
        self.starts = dict(self.ends)
        self.cut: dict[int, dict[int, int]] = {}
        self.table: dict[int, bool] = {}
        for number, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(number, vocab[left], vocab[right], vocab[left + right])
        self.table.clear()
        self.root: dict = {}
        for token in self.ends:
            node = self.root
            for b in self.labels[token]:
                node = node.setdefault(b, {})
            node[-1] = token
        self.words = _Words(self)
        self.pattern = regex.compile(PATTERN)

    def _gadget(self, number: int, u: int, v: int, made: int) -> None:
        if u not in self.ends or v not in self.starts or not self._arc(u, v):
            return  # after u there is no arc v left, so the merge never happens
        if made in self.ends:
            raise ValueError("two merges make the same token")
        self.cut.setdefault(u, {})[v] = number
        # the part itself was hidden by this merge, the parts of the part by earlier ones
        self.ends[made] = ((made, _NEVER), (v, number), *self.ends[v][1:])
        self.starts[made] = ((made, _NEVER), (u, number), *self.starts[u][1:])

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state entered by ``state`` has an arc ``token``: no part of the arc was cut while it was still open.

        On equal numbers the merge further left goes first.
        """
        for end, hidden in self.ends[state]:
            cuts = self.cut.get(end)
            if cuts:
                for start, closed in self.starts[token]:
                    when = cuts.get(start)
                    if when is not None and when < hidden and when <= closed:
                        return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        table, root, n = self.table, self.root, len(word)
        state: list[int] = [-1] * (n + 1)
        came: list[int] = [0] * (n + 1)
        for i in range(n):
            here, node = state[i], root
            if i and here < 0:
                continue
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                token = node.get(-1)
                if token is None:
                    continue
                if i:
                    key = here << 24 | token
                    has = table.get(key)
                    if has is None:
                        if len(table) >= TRANSITIONS:
                            table.clear()
                        has = table[key] = self._arc(here, token)
                    if not has:
                        continue
                state[j + 1], came[j + 1] = token, i
        out, at = [], n
        while at:
            if state[at] < 0:
                raise ValueError("a byte has no token")
            out.append(state[at])
            at = came[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.split_added is not None and any(t in text for t in self.added):
            parts = self.split_added.split(text)
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._encode_plain(p) for p in parts if p)
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        if len(text) <= PIECE:
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
        out, at = [], 0
        safe = regex.compile(r"(?<=\S) (?=\S)")  # no word reaches over such a place
        while at < len(text):
            found = safe.search(text, at + PIECE)
            end = found.start() if found else len(text)
            out += map(self.words.__getitem__, self.pattern.findall(text[at:end]))
            at = end
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Words(dict):
    """Encoded words; what is missing is encoded, and all is forgotten when there are too many."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode_word(word.encode()), "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


_built: dict[int, Automaton] = {}


def automaton(packed: bytes) -> Automaton:
    """The automaton of a packed vocabulary file, built once in each worker."""
    key = zlib.crc32(packed)
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(json.loads(zlib.decompress(packed)))
    return _built[key]


def packed_file(path: str) -> bytes:
    """The vocabulary file as it is sent to the workers; they need not see the path. Its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return zlib.compress(f.read(), 6)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) of every row; with ``decoded`` also the text of the ids."""
    packed = packed_file(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(packed)
        for batch in batches:
            for lo, hi in grams.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                ids = [machine.encode(text or "") for text in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decoded:
                    columns.append(pa.array([machine.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs.select("doc_id", "text")).mapInArrow(work, f"doc_id {kind}, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of the ids of every row; null ids have the empty text."""
    packed = packed_file(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(packed)
        for batch in batches:
            texts = [machine.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return bounded(encoded.select("doc_id", "ids")).mapInArrow(work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
