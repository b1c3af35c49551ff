"""Vectorised views of a text column inside a task: byte chunks, words, 64-bit hashes.

Texts are looked at as one byte array per chunk of rows, so no Python object is made per word.
A chunk holds whole texts and closes after ``CHUNK_BYTES``; a longer text is a chunk of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: Bytes that separate words in every contract of this package: space and \x09 to \x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


_SLOT: dict = {}


def worker_cache(key, make):
    """One object per Python worker, kept between tasks; asking for another key drops it, so what
    one operator has built does not stay in memory while the next one runs."""
    if key not in _SLOT:
        release()
        _SLOT[key] = make()
    return _SLOT[key]


def release() -> None:
    """Drop what the worker keeps, and hand freed memory back to the system: workers are reused from
    stage to stage, and what one stage has freed would count against the next one's limit."""
    _SLOT.clear()
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def _splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public domain): every input bit changes every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mix64 = _splitmix


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit constants."""
    return _splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BYTE_VALUE = seeds(256, 11)
_BASE = int(seeds(1, 12)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**n modulo 2**64; kept for chunk-sized texts, made anew for longer ones."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) <= n:
        values = np.full(max(n, CHUNK_BYTES) + 1, base, np.uint64)
        values[0] = 1
        kept = np.cumprod(values, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _POWERS[base] = kept
    return kept[: n + 1]


@dataclass
class Chunk:
    """Rows ``first`` to ``first + rows`` of a batch; text r is ``data[offsets[r]:offsets[r + 1]]``."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def row_sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array for each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
        n = len(self.data)
        if n == 0:
            return (np.zeros(0, np.int64),) * 3
        solid = ~IS_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:n]
        ends[:-1] &= ~solid[1:] | edge[1:n]
        start = np.flatnonzero(begins)
        return start, np.flatnonzero(ends) + 1, self.row_of(start)

    def hasher(self):
        """Function (starts, ends) -> 64-bit hashes of those byte ranges, equal for equal bytes."""
        n = len(self.data)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * _powers(_BASE, n)[:n], out=prefix[1:])
        back = _powers(_INVERSE, n)
        return lambda start, end: _splitmix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a string column (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield Chunk(first, bounds[first : last + 1] - bounds[first], content[bounds[first] : bounds[last]])
        first = last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def same_ranges(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[a_at : a_at + length] equals b[b_at : b_at + length], for each range.

    Short ranges are compared eight bytes at a time; both arrays need eight spare bytes at the end.
    """
    same = np.ones(len(length), bool)
    view = lambda x: np.ndarray((len(x) - 7,), np.uint64, x.data, strides=(1,))
    left, right = view(a), view(b)
    rows = np.arange(len(length))
    for k in range(0, 64, 8):
        rows = rows[length[rows] > k]
        if not len(rows):
            return same
        unused = (8 * np.maximum(8 - (length[rows] - k), 0)).astype(np.uint64)
        same[rows] &= (left[a_at[rows] + k] ^ right[b_at[rows] + k]) << unused == 0
    for row in rows[length[rows] > 64]:
        n = length[row]
        same[row] = same[row] and np.array_equal(a[a_at[row] : a_at[row] + n], b[b_at[row] : b_at[row] + n])
    return same


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def exact_numbers(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number per byte range, equal for equal bytes only: hashes find, the bytes decide."""
    if not len(start):
        return np.zeros(0, np.int64)
    _, first, number = np.unique(chunk.hasher()(start, end), return_index=True, return_inverse=True)
    data, length, model = padded(chunk.data), end - start, first[number]
    good = length == length[model]
    good[good] = same_ranges(data, start[good], data, start[model[good]], length[good])
    other: dict[bytes, int] = {}
    for i in np.flatnonzero(~good):
        number[i] = other.setdefault(chunk.data[start[i] : end[i]].tobytes(), len(first) + len(other))
    return number


class WordStore:
    """Ids of words, kept between chunks of a worker; emptied when ``limit`` words or
    ``BYTE_LIMIT`` bytes are reached.

    A 64-bit hash finds a word and its bytes decide: words that share a hash with another one are
    kept aside under their bytes. Only a store of computed values: a word that is not (or no
    longer) in it is encoded again.
    """

    BYTE_LIMIT = 1 << 26

    def __init__(self, limit: int = 1 << 21):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.words = self.used = self.used_bytes = 0
        self.odd: dict[bytes, int] = {}
        self._room(1 << 14)
        self.ids = np.zeros(1 << 16, np.int32)
        self.bytes = np.zeros(1 << 16, np.uint8)

    def _room(self, words: int) -> None:
        """Space for that many words; what is held stays."""
        old = self.words
        held = [getattr(self, c)[:old] for c in ("hashes", "place", "count", "byte_at", "size")] if old else []
        self.hashes, self.place, self.count, self.byte_at, self.size = (
            np.zeros(words, t) for t in (np.uint64, np.int64, np.int32, np.int64, np.int64)
        )
        for column, values in zip(("hashes", "place", "count", "byte_at", "size"), held):
            getattr(self, column)[:old] = values
        self.slots = np.full(1 << (2 * words - 1).bit_length(), -1, np.int32)
        aside = np.fromiter(self.odd.values(), np.int64, len(self.odd))
        self._insert(np.setdiff1d(np.arange(old), aside).astype(np.int32))

    def _insert(self, number: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.hashes[number] & np.uint64(mask)).astype(np.int64)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several words for one slot one wins
            lost = self.slots[slot] != number
            number, slot = number[lost], (slot[lost] + 1) & mask

    def by_hash(self, key: np.ndarray) -> np.ndarray:
        """Number of a word with each hash, -1 if there is none."""
        mask = len(self.slots) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        at = self.slots[slot]
        again = np.flatnonzero((at >= 0) & (self.hashes[at] != key))
        while len(again):
            slot[again] = (slot[again] + 1) & mask
            at[again] = self.slots[slot[again]]
            again = again[(at[again] >= 0) & (self.hashes[at[again]] != key[again])]
        return at

    def find(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each word (hash, and its bytes in the padded ``data``), -1 if unknown."""
        at = self.by_hash(key)
        hit = np.flatnonzero(at >= 0)
        good = self.size[at[hit]] == size[hit]
        alike = hit[good]
        good[good] = same_ranges(data, start[alike], self.bytes, self.byte_at[at[alike]], size[alike])
        for i in hit[~good]:
            at[i] = self.odd.get(data[start[i] : start[i] + size[i]].tobytes(), -1)
        return at

    def add(self, key, data, start, size, ids, count, aside: bool = False) -> None:
        """Distinct new words with their ids one after another; the caller keeps to ``limit``.
        ``aside`` is for words whose hash another word has."""
        if self.words + len(key) > len(self.hashes):
            self._room(1 << (self.words + len(key) - 1).bit_length())
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        total = int(size.sum())
        while self.used_bytes + total + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        number = np.arange(self.words, self.words + len(key), dtype=np.int32)
        self.ids[self.used : self.used + len(ids)] = ids
        self.bytes[self.used_bytes : self.used_bytes + total] = data[ragged(start, size)]
        self.hashes[number], self.count[number], self.size[number] = key, count, size
        self.place[number] = self.used + np.cumsum(count) - count
        self.byte_at[number] = self.used_bytes + np.cumsum(size) - size
        self.words, self.used, self.used_bytes = self.words + len(key), self.used + len(ids), self.used_bytes + total
        if aside:
            for i, n in enumerate(number):
                self.odd[data[start[i] : start[i] + size[i]].tobytes()] = int(n)
        else:
            self._insert(number)


def word_numbers(chunk: Chunk, start: np.ndarray, end: np.ndarray, store: WordStore, encode_new) -> np.ndarray:
    """Number in ``store`` of each word, where ``encode_new(words)`` is asked for the ids (and ids per
    word) of words (numbers into start/end) that the store does not hold yet."""
    key, size, data = chunk.hasher()(start, end), end - start, padded(chunk.data)

    def learn(words: np.ndarray, aside: bool) -> None:
        ids, count = encode_new(words)
        store.add(key[words], data, start[words], size[words], ids, count, aside)

    number = store.find(key, data, start, size)
    unknown = np.flatnonzero(number < 0)
    if not len(unknown):
        return number
    fresh = unknown[np.unique(key[unknown], return_index=True)[1]]
    if store.words + len(unknown) > store.limit or store.used_bytes + int(size[fresh].sum()) > store.BYTE_LIMIT:
        store.clear()
        unknown = np.arange(len(key))
        fresh = np.unique(key, return_index=True)[1]
        store.limit = max(store.limit, 1 << int(len(fresh)).bit_length())  # one very long text: a larger store for it
    learn(fresh[store.by_hash(key[fresh]) < 0], False)
    number[unknown] = store.find(key[unknown], data, start[unknown], size[unknown])
    left = unknown[number[unknown] < 0]
    if len(left):
        distinct: dict[bytes, int] = {}
        for i in left:
            distinct.setdefault(data[start[i] : end[i]].tobytes(), i)
        learn(np.array(list(distinct.values())), True)
        number[left] = store.find(key[left], data, start[left], size[left])
    return number


def encode_by_words(chunk: Chunk, start: np.ndarray, end: np.ndarray, store: WordStore, encode_new) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, ids per row)."""
    number = word_numbers(chunk, start, end, store, encode_new)
    count = store.count[number].astype(np.int64)
    flat = store.ids[ragged(store.place[number], count)]
    per_row = np.bincount(chunk.row_of(start), weights=count, minlength=chunk.rows).astype(np.int64)
    return flat, per_row
