"""BPE encoding and decoding with a contiguous rank array per word (operator 9).

Texts are cut into words as byte-level BPE vocabularies of this kind expect. Each distinct word of
a chunk is one row of two dense arrays: the tokens between its part boundaries and the rank of
every adjacent pair. A round finds the smallest rank of each row, replaces the left part by the
merged token, deletes the boundary behind it (the rest of the row moves left by one) and refreshes
the two neighbouring ranks. Rows whose smallest rank is infinite are finished. Words are grouped by
length, so the arrays stay narrow. A word of more than ``WIDE`` bytes keeps its boundaries in place,
linked to their neighbours, and a heap of ranks stands for the scan, so its cost is n log n.

Results: null text counts as empty (no ids). Special tokens in the text become their id, as the
public library does by default. Invalid byte sequences decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.textbytes import Chunk, WordStore, chunks, encode_by_words, mix64, ragged, worker_cache

WIDE = 64
INFINITE = np.int32(2**31 - 1)

#: Fixed value: the word pattern of this vocabulary family.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTRACTION = re.compile(rb"'(?:s|t|re|ve|m|ll|d)")
_LETTER, _NUMBER, _OTHER, _WHITE = 1, 2, 3, 0


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


@lru_cache(1)
def _char_classes() -> np.ndarray:
    """Class of each code point, by the same character tables as the word pattern."""
    classes = np.full(0x110000, _OTHER, np.uint8)
    kinds = [(regex.compile(pattern), value) for pattern, value in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _WHITE))]
    for first in range(0, 0x110000, 1 << 12):  # small pieces, as lists of a million characters are large
        block = "".join(map(chr, (c for c in range(first, first + (1 << 12)) if not 0xD800 <= c < 0xE000)))
        for pattern, value in kinds:
            classes[[ord(c) for c in pattern.findall(block)]] = value
    return classes


class PairTable:
    """(left, right) -> (rank, merged id) by open addressing, probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, INFINITE, np.int32)
        self.ids = np.zeros(1 << self.bits, np.int32)
        todo, key = np.arange(len(left)), left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several keys for one slot one wins
            won = self.keys[slot] == key
            self.ranks[slot[won]], self.ids[slot[won]] = todo[won], merged[todo[won]]
            todo, key, slot = todo[~won], key[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        while True:
            seen = self.keys[slot]
            again = np.flatnonzero((seen != key) & (seen != -1))
            if not len(again):
                break
            slot[again] = (slot[again] + 1) & (len(self.keys) - 1)
        hit = self.keys[slot] == key
        return np.where(hit, self.ranks[slot], INFINITE), self.ids[slot]


class Vocabulary:
    """A byte-level BPE file of the public tokenizers format, read once per worker."""

    def __init__(self, content: str, with_specials: bool = True):
        spec = json.loads(content)
        model, symbols = spec["model"], byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.size = 1 + max(max(ids.values()), *self.specials.values(), -1)
        self.token_bytes = np.empty(self.size, object)
        self.token_bytes[:] = b""
        for text, i in ids.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in text)
        for text, i in self.specials.items():
            self.token_bytes[i] = text.encode()
        self.decimal = np.array([str(i) for i in range(self.size)], object)
        self.byte_ids = np.array([ids[s] for s in symbols], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(
            np.array([ids[a] for a, _ in merges], np.int64), np.array([ids[b] for _, b in merges], np.int64),
            np.array([ids[a + b] for a, b in merges], np.int32),
        )
        self.rank_of = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        if not with_specials:  # their texts are plain text then
            self.specials, self.special_pattern = {}, None
        self.word_pattern = regex.compile(WORD_PATTERN)
        self.store = WordStore(1 << 20)

    # encoding

    def encode_wide(self, word: bytes) -> list[int]:
        """One long word: the pair of smallest rank (of equal ones the leftmost) merges, its boundary
        is deleted and the two neighbouring ranks are refreshed. Old ranks are left in the heap and
        skipped when they come up."""
        parts = self.byte_ids[np.frombuffer(word, np.uint8)]
        n = len(parts)
        ranks, merged = self.pairs.find(parts[:-1].astype(np.int64), parts[1:].astype(np.int64))
        at = np.flatnonzero(ranks != INFINITE)
        heap = (ranks[at].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(heap)
        parts, ranks, merged = parts.tolist(), [*ranks.tolist(), int(INFINITE)], [*merged.tolist(), 0]
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (int(INFINITE), 0)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if ranks[i] != top >> 32:
                continue
            gone = behind[i]
            parts[i], parts[gone], ranks[gone] = merged[i], -1, int(INFINITE)
            behind[i] = after = behind[gone]
            if after < n:
                before[after] = i
            for left, right in ((before[i], i), (i, after)):
                if left >= 0 and (right < n or left != i):
                    ranks[left], merged[left] = self.rank_of.get((parts[left], parts[right]), none)
                    if ranks[left] != INFINITE:
                        heapq.heappush(heap, ranks[left] << 32 | left)
            if after >= n:
                ranks[i] = int(INFINITE)
        return [p for p in parts if p >= 0]

    def encode_words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids per word)."""
        counts = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        edges = [0, 4, 8, 12, 16, 24, 32, WIDE]
        for low, high in zip(edges, edges[1:]):
            rows = np.flatnonzero((length > low) & (length <= high))
            for part in np.array_split(rows, max(1, len(rows) // 65536)):
                if len(part):
                    ids, sizes = self._merge(data, start[part], length[part], high)
                    counts[part] = sizes
                    found.append((part, ids))
        for row in np.flatnonzero(length > WIDE):
            ids = np.array(self.encode_wide(data[start[row] : start[row] + length[row]].tobytes()), np.int32)
            counts[row] = len(ids)
            found.append((np.array([row]), ids))
        place = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for part, ids in found:
            flat[ragged(place[part], counts[part])] = ids
        return flat, counts

    def _merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        columns = np.arange(width)
        inside = columns < length[:, None]
        parts = self.byte_ids[data[np.where(inside, start[:, None] + columns, start[:, None])]]
        size = length.astype(np.int64).copy()
        ranks = np.full((len(start), width), INFINITE, np.int32)
        merged = np.zeros((len(start), width), np.int32)
        pair = columns < (length - 1)[:, None]
        left, right = parts[pair], np.roll(parts, -1, 1)[pair]
        ranks[pair], merged[pair] = self.pairs.find(left, right)
        live = np.arange(len(start))
        done_parts = parts
        while len(live):
            at = ranks[live].argmin(1)
            best = ranks[live, at]
            go = best != INFINITE
            live, at = live[go], at[go]
            if not len(live):
                break
            # Take the merged token, then delete the boundary: columns behind ``at`` move left.
            parts[live, at] = merged[live, at]
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts[live] = np.take_along_axis(parts[live], moved, 1)
            behind = np.minimum(columns + (columns >= at[:, None]), width - 1)
            ranks[live] = np.take_along_axis(ranks[live], behind, 1)
            merged[live] = np.take_along_axis(merged[live], behind, 1)
            size[live] -= 1
            ranks[live, np.maximum(size[live] - 1, 0)] = INFINITE
            # Refresh the pair that now starts at ``at`` and the one that ends there.
            for column, ok in ((at, at < size[live] - 1), (at - 1, at > 0)):
                row, column = live[ok], column[ok]
                ranks[row, column], merged[row, column] = self.pairs.find(parts[row, column], parts[row, column + 1])
        return done_parts[columns < size[:, None]], size

    # words of a chunk

    def split(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, special id or -1) of each word in byte positions of the chunk, in order."""
        raw = chunk.data.tobytes()
        text = raw.decode("utf-8", "surrogatepass")
        if _CONTRACTION.search(raw) or (self.special_pattern and self.special_pattern.search(text)):
            return self._split_by_pattern(chunk)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if n == 0:
            return (np.zeros(0, np.int64),) * 3
        at_byte = np.append(np.flatnonzero((chunk.data & 0xC0) != 0x80), len(chunk.data))
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(at_byte, chunk.offsets)] = True
        kind = _char_classes()[points]
        white = kind == _WHITE
        begins = edge[:n].copy()
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        blank_before = np.zeros(n, bool)
        blank_before[1:] = points[:-1] == 32
        blank_before &= ~edge[:n]
        begins |= ~white & change & ~blank_before
        begins |= white & change
        # The last white space before a non-white character stands alone or leads that word.
        last = white.copy()
        last[:-1] &= ~white[1:]
        last[-1] = False
        last &= ~edge[1:]
        begins |= last
        first = np.flatnonzero(begins)
        start = at_byte[first]
        return start, np.append(start[1:], len(chunk.data)), np.full(len(start), -1)

    def _split_by_pattern(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same words by the pattern itself, where contractions or special tokens occur."""
        start: list[int] = []
        special: list[int] = []
        for low, high in zip(chunk.offsets, chunk.offsets[1:]):
            text, at, byte = chunk.data[low:high].tobytes().decode("utf-8", "surrogatepass"), 0, int(low)
            cuts = [(m.start(), m.end()) for m in self.special_pattern.finditer(text)] if self.special_pattern else []
            for begin, end in [*cuts, (len(text), len(text))]:
                for word in self.word_pattern.findall(text[at:begin]):
                    start.append(byte)
                    special.append(-1)
                    byte += len(word.encode("utf-8", "surrogatepass"))
                if end > begin:
                    start.append(byte)
                    special.append(self.specials[text[begin:end]])
                    byte += len(text[begin:end].encode())
                at = end
        return np.array(start, np.int64), np.array([*start[1:], len(chunk.data)][: len(start)], np.int64), np.array(special, np.int64)

    def encode_chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, ids per row)."""
        start, end, special = self.split(chunk)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(chunk.rows, np.int64)

        def encode_new(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, counts = self.encode_words(chunk.data, start[words], (end - start)[words])
            place = np.cumsum(counts) - counts
            for word in np.flatnonzero(special[words] >= 0)[::-1]:
                at = place[word]
                ids = np.concatenate([ids[:at], [special[words[word]]], ids[at + counts[word] :]]).astype(np.int32)
                counts[word] = 1
            return ids, counts

        return encode_by_words(chunk, start, end, self.store, encode_new)

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.token_bytes[ids]).decode("utf-8", "replace")


def _vocabulary(content: str) -> Vocabulary:
    return worker_cache(("vocabulary", hash(content)), lambda: Vocabulary(content))


def _texts_with_ids(batches, content: str) -> Iterator[tuple[pa.RecordBatch, Chunk, np.ndarray, np.ndarray]]:
    vocabulary = _vocabulary(content)
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            ids, per_row = vocabulary.encode_chunk(chunk)
            yield batch, chunk, ids, per_row


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Add ``ids`` (array of int) to every row; ``docs`` needs a ``text`` column, other columns stay.

    The vocabulary file is read once by the driver and travels with the task.
    """
    content = _read(vocabulary_path)
    kept = [c for c in docs.columns if c != "ids"]

    def run(batches):
        for batch, chunk, ids, per_row in _texts_with_ids(batches, content):
            rows = batch.slice(chunk.first, chunk.rows).select(kept)
            offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [*kept, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept).mapInArrow(run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """Add ``decoded`` (string) from a column ``ids``; other columns stay."""
    content = _read(vocabulary_path)
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        vocabulary = _vocabulary(content)
        for batch in batches:
            texts = [None if row is None else vocabulary.decode(np.array(row, np.int64)) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema)
    return encoded.select(*kept).mapInArrow(run, f"{fields}, decoded string")


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encode, then decode those ids.

    Encoding and decoding share one pass, so the ids never leave the task.
    """
    content = _read(vocabulary_path)

    def run(batches):
        vocabulary = _vocabulary(content)
        for batch, chunk, ids, per_row in _texts_with_ids(batches, content):
            ends = np.cumsum(per_row)
            listed, decoded = [], []
            for begin, end in zip(ends - per_row, ends):
                own = ids[begin:end]
                listed.append(hashlib.sha256(",".join(vocabulary.decimal[own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(own).encode()).hexdigest())
            rows = batch.column("doc_id").slice(chunk.first, chunk.rows)
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(per_row), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()
