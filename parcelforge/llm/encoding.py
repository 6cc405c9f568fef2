"""Token ids of texts by a public byte-level BPE vocabulary, merged with a rank queue.

The merge ranks that are due form a set in a hierarchical bitmap (words of 64 ranks, words of 64 words,
and so on), where find-first-set gives the next rank; each rank has a linked list of the positions
where its pair was seen.  Entries that later merges have made stale are skipped.  A pre-token of n
bytes costs O(n) queue operations, however long it is.

Null and empty texts give an empty list; strings that look like special tokens are ordinary text.
Pre-tokens are remembered by the stretch of text between single spaces, up to ``REMEMBERED`` of them
per worker; forgetting changes speed only.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parcelforge.runtime import table

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: Stretches of text that a worker remembers.
REMEMBERED = 300_000
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Spaces before a character that no tokenizer takes for white space: pre-tokens always begin there.
_SAFE = re.compile(r" (?=[!-~¡-ᙿ])")
_UNSAFE = re.compile(r" (?![!-~¡-ᙿ])")


class RankQueue:
    """Priority queue of (rank, position) over a fixed range of ranks."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        n = ranks
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n == 1:
                break
        self.head = [-1] * ranks
        self.next: list[int] = []
        self.at: list[int] = []

    def push(self, rank: int, position: int) -> None:
        if self.head[rank] < 0:
            i = rank
            for level in self.levels:
                i, bit = i >> 6, i & 63
                before = level[i]
                level[i] = before | 1 << bit
                if before:
                    break
        self.next.append(self.head[rank])
        self.at.append(position)
        self.head[rank] = len(self.at) - 1

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and its positions in rising order; None when empty (which also frees the lists)."""
        i = 0
        for level in reversed(self.levels):
            word = level[i]
            if not word:
                self.next.clear()
                self.at.clear()
                return None
            i = i << 6 | (word & -word).bit_length() - 1
        positions, e = [], self.head[i]
        while e >= 0:
            positions.append(self.at[e])
            e = self.next[e]
        self.head[i] = -1
        j = i
        for level in self.levels:
            j, bit = j >> 6, j & 63
            level[j] &= ~(1 << bit)
            if level[j]:
                break
        positions.sort()
        return i, positions


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory(dict):
    """Ids of a stretch of text that follows a space."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        ids = self[stretch] = tuple(self.encoder.stretch(" " + stretch))
        return ids


class Encoder:
    def __init__(self, path: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        with open(f"{path}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.pattern = regex.compile(PATTERN)
        self.queue = RankQueue(len(model["merges"]))
        self.words: dict[str, list[int]] = {}
        self.memory = _Memory(self)

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges, push = self.merges, self.queue.push
        for i in range(n - 1):
            if m := merges.get(ids[i] << 20 | ids[i + 1]):
                push(m[0], i)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while due := self.queue.pop():
            rank, positions = due
            for i in positions:
                j = right[i] if ids[i] >= 0 else n
                if j >= n:
                    continue
                m = merges.get(ids[i] << 20 | ids[j])
                if m is None or m[0] != rank:
                    continue  # stale: one of the two has been merged since
                ids[i], ids[j] = m[1], -1
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    if m := merges.get(ids[i] << 20 | ids[k]):
                        push(m[0], i)
                h = left[i]
                if h >= 0 and (m := merges.get(ids[h] << 20 | ids[i])):
                    push(m[0], h)
        return [t for t in ids if t >= 0]

    def stretch(self, text: str) -> list[int]:
        out: list[int] = []
        for w in self.pattern.findall(text):
            ids = self.words.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8", "surrogatepass"))
                if len(w) < 40:
                    self.words[w] = ids
            out += ids
        return out

    def pieces(self, text: str):
        """Tuples of ids that make up the text."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        parts = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        first = tuple(self.stretch(parts[0]))
        if len(parts) == 1:
            return [first]
        got = list(map(self.memory.__getitem__, parts))
        got[0] = first
        return got

    def encode(self, text: str | None) -> array:
        return array("i", chain.from_iterable(self.pieces(text))) if text else array("i")

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, name: str) -> Encoder:
    """One per worker process."""
    if (path, name) not in _encoders:
        _encoders[path, name] = Encoder(path, name)
    return _encoders[path, name]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) of every row."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        enc = encoder(path, name)
        for b in batches:
            ids, ends = array("i"), array("i", [0])
            for t in b.column(1):
                ids += enc.encode(t.as_py())
                ends.append(len(ids))
            made = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(ids), pa.int32()) if ids else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), made], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, tokens) of every row; 0 for null and empty texts."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        enc = encoder(path, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.count(t.as_py()) for t in b.column(1)], pa.int64())], [key, "tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens bigint")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"))
