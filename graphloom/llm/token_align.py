"""Cross-tokenizer alignment by divide and conquer at shared cuts (operator 12).

A text is encoded as a space and the text by a byte-level BPE vocabulary (A), and by a sentencepiece
model without normalization that adds the space itself (B); special tokens are plain text. Both give byte ends. An
interval between two shared ends is split at a shared end near its middle: candidates around the
middle end of A are looked up in B's ends by bisection, the radius doubles until one is shared, and
both halves go on with their own middles. An interval without a shared end inside is a leaf, one group. All intervals of a
chunk of texts take a step together, so a step is a few array operations.

Links are the pairs of an A and a B token with overlapping bytes. How often an id pair is linked in
the whole corpus is one grouping; per text the counts are looked up again: the ``FREQUENT`` most
frequent pairs, a bounded table, are broadcast, all other links are joined by pair.

Results: a null or empty text, and one whose joined tokens differ from space + text (such as one
that holds U+2581), has no tokens: zeros and empty groups. Every row of ``docs`` gives one row.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import Vocabulary, _read
from graphloom.llm.textbytes import Chunk, WordStore, chunks, encode_by_words, ragged, worker_cache
from graphloom.session import materialize

FREQUENT = 1 << 18
#: Bytes of text that are aligned together.
CHUNK = 1 << 18
MARK = "▁"


class Pieces:
    """A sentencepiece model whose pieces never continue behind a space or hold a line feed, so that
    a text is encoded run by run: a run begins with spaces or with a line feed."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        self.size = self.model.vocab_size()
        self.token_bytes = [self._bytes(i) for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.token_bytes])
        self.decimal = [str(i) for i in range(self.size)]
        self.whole_runs = all(MARK not in p.lstrip(MARK) and "\n" not in p for p in map(self.model.id_to_piece, range(self.size)))
        self.lone_space = self.model.encode("\n")[0]
        self.store = WordStore(1 << 18)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode()

    def encode_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs, ids per run); a run that its ids do not spell has the id -1."""
        # The model adds one space in front: it stands for a run's first one, or is taken off again.
        led = np.array([r[0] == 32 for r in runs])
        texts = [(r[1:] if spaced else r).decode("utf-8", "surrogatepass") for r, spaced in zip(runs, led)]
        found = [ids or [self.lone_space] for ids in self.model.encode(texts, num_threads=1)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
        begin = np.cumsum(count) - count
        keep = np.ones(len(flat), bool)
        keep[begin[~led]] = False
        flat, count = flat[keep], count - ~led
        row = np.repeat(np.arange(len(runs)), count)
        right = np.bincount(row, self.lengths[flat], len(runs)) == np.fromiter(map(len, runs), np.int64, len(runs))
        spelled = b"".join(map(self.token_bytes.__getitem__, flat.tolist()))
        if not right.all() or spelled != b"".join(runs):
            begin = np.cumsum(count) - count
            for i, run in enumerate(runs):
                right[i] = b"".join(map(self.token_bytes.__getitem__, flat[begin[i] : begin[i] + count[i]].tolist())) == run
            wrong = np.flatnonzero(~right[row])
            first = np.unique(row[wrong], return_index=True)[1]
            flat[wrong[first]] = -1
            keep = right[row]
            keep[wrong[first]] = True
            flat, count = flat[keep], np.where(right, count, 1)
        return flat, count

    def encode_chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids per row) of texts that begin with a space; -1 where B departs."""
        data = chunk.data
        space = data == 32
        begins = data == 10
        begins[0] = True
        begins[1:] |= space[1:] & ~space[:-1]
        begins[chunk.offsets[:-1]] = True
        start = np.flatnonzero(begins)
        if not self.whole_runs:
            start = chunk.offsets[:-1].copy()
        end = np.append(start[1:], len(data))

        def encode_new(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = data.tobytes()
            return self.encode_runs([raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())])

        return encode_by_words(chunk, start, end, self.store, encode_new)


class _Tokenizers:
    def __init__(self, a_content: str, b_content: bytes):
        self.a, self.b = Vocabulary(a_content, with_specials=False), Pieces(b_content)
        self.a.store.limit = self.b.store.limit
        self.a_lengths = np.array([len(x) for x in self.a.token_bytes])
        spelled = lambda decimal, mark: np.array([d + mark for d in decimal], object)
        self.a_texts = [spelled(self.a.decimal, m) for m in ",|"]
        self.b_texts = [spelled(self.b.decimal, m) for m in ",;"]


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, intervals: np.ndarray) -> np.ndarray:
    """Leaf groups of ``intervals``: rows a_from, a_to, b_from, b_to of token numbers, one column per
    interval whose A and B tokens begin and end at the same bytes.

    ``a_end`` and ``b_end`` are the ascending byte ends of all tokens.
    """
    leaves = []

    def divisible(parts: np.ndarray) -> np.ndarray:
        many = (parts[1] - parts[0] > 1) & (parts[3] - parts[2] > 1)
        leaves.append(parts[:, ~many])
        return parts[:, many]

    def halves(parts: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> np.ndarray:
        left, right = np.stack([parts[0], a_cut, parts[2], b_cut]), np.stack([a_cut, parts[1], b_cut, parts[3]])
        return np.concatenate([left, right], 1)

    fresh = divisible(intervals)
    waiting, tested = fresh[:, :0], np.zeros(0, np.int64)  # intervals without a shared end within that radius
    while fresh.shape[1] or waiting.shape[1]:
        middle = (fresh[0] + fresh[1] - 2) // 2
        found = np.searchsorted(b_end, a_end[middle])
        hit = b_end[found] == a_end[middle]
        split, missed = halves(fresh[:, hit], middle[hit] + 1, found[hit] + 1), fresh[:, ~hit]
        wide, a_cut, b_cut, waiting, tested, spent = _widen(a_end, b_end, waiting, tested)
        leaves.append(spent)
        fresh = divisible(np.concatenate([split, halves(wide, a_cut, b_cut)], 1))
        waiting = np.concatenate([waiting, missed], 1)
        tested = np.concatenate([tested, np.zeros(missed.shape[1], np.int64)])
    groups = np.concatenate(leaves, 1)
    return groups[:, np.argsort(groups[0])]


def _widen(a_end: np.ndarray, b_end: np.ndarray, parts: np.ndarray, tested: np.ndarray):
    """Search twice as far around the middles: (intervals with a shared end, its place in A and in B,
    those that go on, their radius, those without any)."""
    low, high = parts[0], parts[1] - 2  # the ends inside the interval
    middle = (low + high) // 2
    radius = np.maximum(2 * tested, 1)
    left, right = np.maximum(middle - radius, low), middle + tested + 1
    n_left, n_right = np.maximum(middle - tested - left, 0), np.maximum(np.minimum(middle + radius, high) + 1 - right, 0)
    candidate = np.concatenate([ragged(left, n_left), ragged(right, n_right)])
    owner = np.concatenate([np.repeat(np.arange(parts.shape[1]), n) for n in (n_left, n_right)])
    found = np.searchsorted(b_end, a_end[candidate])
    hit = np.flatnonzero(b_end[found] == a_end[candidate])
    # Of several shared ends the nearest to the middle, of two the left one.
    hit = hit[np.lexsort((candidate[hit], np.abs(candidate[hit] - middle[owner[hit]]), owner[hit]))]
    own, nearest = np.unique(owner[hit], return_index=True)
    missed = np.ones(parts.shape[1], bool)
    missed[own] = False
    spent = missed & (middle - radius <= low) & (middle + radius >= high)
    missed &= ~spent
    return parts[:, own], candidate[hit[nearest]] + 1, found[hit[nearest]] + 1, parts[:, missed], radius[missed], parts[:, spent]


def _with_space(chunk: Chunk) -> Chunk:
    offsets = chunk.offsets + np.arange(chunk.rows + 1)
    data = np.full(int(offsets[-1]), 32, np.uint8)
    inner = np.ones(len(data), bool)
    inner[offsets[:-1]] = False
    data[inner] = chunk.data
    return Chunk(chunk.first, offsets, data)


def _aligned(chunk: Chunk, tokenizers: _Tokenizers) -> dict:
    """Counts, links and group texts of the rows of a chunk."""
    spaced = _with_space(chunk)
    (a, n_a), (b, n_b) = tokenizers.a.encode_chunk(spaced), tokenizers.b.encode_chunk(spaced)
    rows = np.arange(chunk.rows)
    width = np.diff(spaced.offsets)
    row_a, row_b = np.repeat(rows, n_a), np.repeat(rows, n_b)
    size_a, size_b = tokenizers.a_lengths[a], np.where(b < 0, -1, tokenizers.b.lengths[b])
    right = (width > 1) & (np.bincount(row_a, size_a, chunk.rows) == width) & (np.bincount(row_b, size_b, chunk.rows) == width)
    right[row_b[b < 0]] = False
    a, size_a, row_a = (x[right[row_a]] for x in (a, size_a, row_a))
    b, size_b = (x[right[row_b]] for x in (b, size_b))
    n_a, n_b = np.where(right, n_a, 0), np.where(right, n_b, 0)
    a_end, b_end = np.cumsum(size_a), np.cumsum(size_b)
    a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
    groups = shared_cuts(a_end, b_end, np.stack([a_to - n_a, a_to, b_to - n_b, b_to])[:, right])
    # A token's links: the B tokens from the one that holds its first byte to the one with its last.
    first, last = np.searchsorted(b_end, a_end - size_a, "right"), np.searchsorted(b_end, a_end)
    per_a = last - first + 1
    pairs = np.repeat(a.astype(np.int64), per_a) * tokenizers.b.size + b[ragged(first, per_a)]
    # Texts of the groups: the A tokens of a group, then its B tokens.
    spelled = np.empty(len(a) + len(b), object)
    at_a = np.arange(len(a)) + np.repeat(groups[2], groups[1] - groups[0])
    at_b = np.arange(len(b)) + np.repeat(groups[1], groups[3] - groups[2])
    for at, ids, (inner, closing), end in ((at_a, a, tokenizers.a_texts, groups[1]), (at_b, b, tokenizers.b_texts, groups[3])):
        spelled[at] = inner[ids]
        spelled[at[end - 1]] = closing[ids[end - 1]]
    ends = a_to + b_to
    texts = ["".join(spelled[begin:end].tolist())[:-1] for begin, end in zip(ends - n_a - n_b, ends)]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(row_a[groups[0]], minlength=chunk.rows),
        "n_links": np.bincount(row_a, per_a, chunk.rows).astype(np.int64), "pairs": pairs, "texts": texts,
    }


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: row (its number), doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, links (a pair's number is A's id times B's size plus B's id), and with
    ``with_groups`` the groups themselves as ``a1,a2|b1;a3|b2,b3``."""
    a_content = _read(a_path)
    with open(b_path, "rb") as file:
        b_content = file.read()
    added = ["links", "groups"] if with_groups else ["links"]

    def run(batches):
        tokenizers = worker_cache(("align", hash(a_content), hash(b_content)), lambda: _Tokenizers(a_content, b_content))
        small = len(tokenizers.a.token_bytes) * tokenizers.b.size < 1 << 31
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK):
                found = _aligned(chunk, tokenizers)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found["texts"]]
                offsets = pa.array(np.append(0, np.cumsum(found["n_links"])).astype(np.int32))
                links = pa.ListArray.from_arrays(offsets, pa.array(found["pairs"], pa.int32() if small else pa.int64()).cast(pa.int64()))
                kept = batch.slice(chunk.first, chunk.rows).select(["row", "doc_id"]).columns
                columns = [*kept, *(pa.array(found[c].astype(np.int64)) for c in COUNTS), pa.array(digests, pa.string()), links]
                columns += [pa.array(found["texts"], pa.string())] if with_groups else []
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *COUNTS, "groups_sha256", *added])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    fields = ["row long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *[f"{c} long" for c in COUNTS], "groups_sha256 string", "links array<long>"]
    return rows.mapInArrow(run, ", ".join([*fields, *(["groups string"] if with_groups else [])]))


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): links of each id pair, and whether no pair of its B id has more."""
    counted = materialize(aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    most = counted.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))
    return materialize(counted.join(most, F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def link_counts(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of the rows of ``aligned`` with links, from the corpus-wide pair counts.

    Links of frequent pairs are looked up where they lie, in a broadcast table of ``frequent`` rows at
    most, and summed by row before anything moves; only links of other pairs are joined by pair.
    """
    known = materialize(counts.orderBy(F.desc("n"), "pair").limit(frequent))
    links = aligned.select("row", F.explode("links").alias("pair"))
    value = lambda times: (F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    near = links.join(F.broadcast(known), "pair").groupBy("row").agg(*value(F.lit(1)))
    others = links.join(F.broadcast(known.select("pair")), "pair", "left_anti").groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
    far = others.join(counts, "pair").groupBy("row").agg(*value(F.col("times")))
    return near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts of ``align``, n_best (links whose pair is the most
    frequent of its B id), count_sum (of the counts of all its links) and groups_sha256."""
    from sentencepiece import SentencePieceProcessor

    aligned = materialize(align(docs, a_path, b_path))
    counts = pair_counts(aligned, SentencePieceProcessor(model_file=b_path).vocab_size())
    found = aligned.drop("links").join(link_counts(aligned, counts, frequent), "row", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}).drop("row")
