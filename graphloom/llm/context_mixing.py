"""LM scoring by context-tree weighting over binary-decomposed bytes (operator 11).

A text is its bytes, A-Z in lower case, and one end symbol. A byte is eight binary decisions; each
has, for every context of 0 to ``DEPTH`` bytes before it, a node with the counts of zeros and ones
seen there. A node's own estimate is Krichevsky and Trofimov's; its weighted probability is half
its own and half the product of its children's, which are the nodes of contexts one byte longer. So
all depths are mixed, and each node keeps the share w of its own estimate after all training texts.
With these statistics frozen, the probability of a decision is w times the node's estimate plus
(1 - w) times that of the next longer context, and so on down.

Counting covers every training text: one grouping of (context, byte) with map-side combination,
which grows with the corpus. The tree is worked out on the distinct (context, byte) pairs: upwards
one grouping per depth, downwards one join per depth, where a node has at most 257 children, so no
key is hot. Pairs that only held-out texts have take part with count 0, which changes no other
node, so every pair of the corpus gets its exact probability. Texts then look up their pairs: the
``FREQUENT`` most frequent ones, a bounded table, travel with the task; all others are joined. Word
counts are looked up the same way. Nothing that grows with the corpus is sent to driver or tasks.

Results: null text counts as empty and is scored by its end symbol alone. Rows with a null doc_id
are training texts. Without training texts every byte costs 8 bits. Every row of ``docs`` gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textbytes import Chunk, WordStore, chunks, mix64, padded, ragged, release, worker_cache
from graphloom.session import materialize

DEPTH = 4
FREQUENT = 1 << 18
END = 0xFF  # no byte of UTF-8
#: A context is its bytes + 1 in this base, nearest byte lowest; 0 is before the text.
BASE = 257
SPACES = "[\\x20\\x09-\\x0D]+"
CHUNK = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def held_out(key: str, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


# ---- counting -------------------------------------------------------------------------------------

def lowered(chunk: Chunk) -> Chunk:
    data = chunk.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    return Chunk(chunk.first, chunk.offsets, data)


def context_bytes(chunk: Chunk, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context * 256 + byte of every byte and end symbol, its row)."""
    offsets = chunk.offsets + np.arange(chunk.rows + 1)
    symbols = np.full(int(offsets[-1]), END, np.int64)
    inner = np.ones(len(symbols), bool)
    inner[offsets[1:] - 1] = False
    symbols[inner] = chunk.data
    row = np.repeat(np.arange(chunk.rows), np.diff(offsets))
    place = np.arange(len(symbols)) - offsets[row]
    context = np.zeros(len(symbols), np.int64)
    for k in range(1, depth + 1):
        before = np.zeros(len(symbols), np.int64)
        before[k:] = symbols[:-k] + 1
        before[place < k] = 0
        context += before * BASE ** (k - 1)
    return context * 256 + symbols, row


def pair_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(pair, n, seen): how often each (context, byte) stands in training texts, and in all texts."""

    def run(batches):
        release()
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text"), CHUNK):
                pair, row = context_bytes(lowered(chunk), depth)
                apart = held[chunk.first : chunk.first + chunk.rows][row]
                for learned, own in ((1, pair[~apart]), (0, pair[apart])):
                    value, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n * learned), pa.array(n)], ["pair", "n", "seen"])

    found = docs.select("held_out", "text").mapInArrow(run, "pair long, n long, seen long")
    return materialize(found.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, seen): how often each word stands in training texts, and in all texts."""
    words = F.explode(F.split(F.translate("text", UPPER, LOWER), SPACES))
    counted = docs.select("held_out", words.alias("word")).filter("word <> ''").groupBy("word").agg(
        F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("n"), F.count(F.lit(1)).alias("seen")
    )
    return materialize(counted)


# ---- the tree -------------------------------------------------------------------------------------

def _log_gamma(x: Column) -> Column:
    """Stirling's series after moving the argument up by eight; for x >= 0.5 exact to 1e-12."""
    z, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * np.log(2 * np.pi) + series - F.log(product)


def _own_log() -> Column:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    value = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - float(np.log(np.pi))
    return F.when(a + b == 0, 0.0).otherwise(value)


def _decisions(byte: Column) -> list[tuple[Column, Column]]:
    """(prefix, bit) of the eight decisions of a byte; a prefix has a leading 1."""
    return [((F.lit(1 << k) + F.shiftright(byte, 8 - k)).cast("int"), F.shiftright(byte, 7 - k).bitwiseAND(1)) for k in range(8)]


def pair_costs(pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(pair, seen, cost): log10 of the mixed probability of the byte after its context."""
    byte = F.col("pair").bitwiseAND(255)
    split = pairs.select(F.shiftright("pair", 8).alias("context"), byte.alias("byte"), "pair", "n", "seen")
    steps = F.explode(F.array(*[F.struct(p.alias("prefix"), bit.alias("bit")) for p, bit in _decisions(F.col("byte"))])).alias("s")
    ones = F.col("n") * F.col("s.bit")
    level = (
        split.select("context", "n", steps).groupBy("context", "s.prefix")
        .agg(F.sum(F.col("n") - ones).alias("a"), F.sum(ones).alias("b"))
        .withColumn("weighted", _own_log()).withColumn("share", F.lit(1.0))
    )
    levels = [materialize(level)]
    for k in reversed(range(depth)):
        below = levels[-1].groupBy((F.col("context") % BASE**k).alias("context"), "prefix").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("longer")
        )
        own = below.withColumn("own", _own_log())
        more = F.greatest("own", "longer") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("longer")))) - float(np.log(2))
        share = 1 / (1 + F.exp(F.least(F.col("longer") - F.col("own"), F.lit(700.0))))
        levels.append(materialize(own.select("context", "prefix", "a", "b", more.alias("weighted"), share.alias("share"))))
    # Down again: the probability of a one from the contexts so far, and the weight left for longer ones.
    estimate = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    top = levels[depth]
    mixed = top.select("context", "prefix", (F.col("share") * estimate).alias("one"), (1 - F.col("share")).alias("left"))
    for k in range(1, depth + 1):
        shorter = mixed.select(F.col("context").alias("c"), F.col("prefix").alias("p"), "one", "left")
        joined = levels[depth - k].join(shorter, (F.col("context") % BASE ** (k - 1) == F.col("c")) & (F.col("prefix") == F.col("p")))
        mixed = joined.select(
            "context", "prefix", (F.col("one") + F.col("left") * F.col("share") * estimate).alias("one"), (F.col("left") * (1 - F.col("share"))).alias("left")
        )
    tables = mixed.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "one"))).alias("ones"))
    cost = F.lit(0.0)
    for prefix, bit in _decisions(F.col("byte")):
        one = F.element_at("ones", prefix)
        cost = cost + F.log10(F.when(bit == 1, one).otherwise(1 - one))
    return materialize(split.join(tables, "context").select("pair", "seen", cost.alias("cost")))


# ---- scoring --------------------------------------------------------------------------------------

class PairLookup:
    """Costs of the frequent pairs by open addressing, probed for whole arrays."""

    def __init__(self, pair: np.ndarray, cost: np.ndarray):
        self.bits = max(4, int(4 * len(pair) + 1).bit_length())
        self.keys, self.costs = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        todo, slot = np.arange(len(pair)), self._slot(pair)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = pair[todo[free]]  # of several pairs for one slot one wins
            won = self.keys[slot] == pair[todo]
            self.costs[slot[won]] = cost[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (mix64(pair.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, whether it is known) of each pair."""
        slot = self._slot(pair)
        seen = self.keys[slot]
        again = np.flatnonzero((seen != pair) & (seen != -1))
        while len(again):
            slot[again] = (slot[again] + 1) & (len(self.keys) - 1)
            seen[again] = self.keys[slot[again]]
            again = again[(seen[again] != pair[again]) & (seen[again] != -1)]
        return self.costs[slot], seen == pair


def _word_store(words: pa.Array) -> WordStore:
    """The frequent words, their ids being their places."""
    store = WordStore(len(words) + 1)
    for chunk in chunks(words):
        start, end = chunk.offsets[:-1], chunk.offsets[1:]
        key, data, size = chunk.hasher()(start, end), padded(chunk.data), end - start
        first = np.unique(key, return_index=True)[1]
        fresh = first[store.by_hash(key[first]) < 0]
        rest = np.setdiff1d(np.arange(chunk.rows), fresh)  # share a hash with another word
        for which, aside in ((fresh, False), (rest, True)):
            store.add(key[which], data, start[which], size[which], chunk.first + which, np.ones(len(which), np.int32), aside)
    return store


def _frequent(table: DataFrame, key: str, value: str, limit: int) -> pa.Table:
    return table.orderBy(F.desc("seen"), key).limit(limit).select(key, value).toArrow()


def _scored_parts(docs: DataFrame, words: DataFrame, costs: DataFrame, depth: int, frequent: int) -> DataFrame:
    """Per row the sums over frequent words and pairs, and the others as lists with their counts."""
    context = docs.sparkSession.sparkContext
    known_words, known_pairs = _frequent(words, "word", "n", frequent), _frequent(costs, "pair", "cost", frequent)
    shared = context.broadcast((
        known_words.column("word").combine_chunks(), known_words.column("n").to_numpy(), known_pairs.column("pair").to_numpy(), known_pairs.column("cost").to_numpy(),
    ))

    def tables():
        words, n, pair, cost = shared.value
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        return _word_store(words), n, PairLookup(pair, cost)

    def run(batches):
        _, (store, word_n, pairs) = worker_cache(("ctw", id(shared.value)), lambda: (shared.value, tables()))
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK):
                chunk = lowered(chunk)
                start, end, row = chunk.words()
                data, size = padded(chunk.data), end - start
                number = store.find(chunk.hasher()(start, end), data, start, size) if len(start) else np.zeros(0, np.int64)
                hit = number >= 0
                n = word_n[store.ids[store.place[number[hit]]]]
                known = np.bincount(row[hit][n > 0], minlength=chunk.rows)
                base = np.bincount(row[hit], np.log10(n + 1.0), chunk.rows)
                rest = np.flatnonzero(~hit)
                offsets = pa.py_buffer(np.append(0, np.cumsum(size[rest])).astype(np.int32))
                others = pa.StringArray.from_buffers(len(rest), offsets, pa.py_buffer(chunk.data[ragged(start[rest], size[rest])]))
                pair, owner = context_bytes(chunk, depth)
                cost, found = pairs.find(pair)
                score = np.bincount(owner, np.where(found, cost, 0.0), chunk.rows)
                lists = lambda per_row, values: pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(np.bincount(per_row, minlength=chunk.rows))).astype(np.int32)), values
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(chunk.first, chunk.rows).select(["row", "doc_id", "held_out"]).columns,
                     pa.array(np.bincount(row, minlength=chunk.rows)), pa.array(np.diff(chunk.offsets)), pa.array(known), pa.array(base.astype(float)), pa.array(score.astype(float)),
                     lists(row[rest], others), lists(owner[~found], pa.array(pair[~found]))],
                    ["row", "doc_id", "held_out", "n_words", "n_bytes", "known", "base", "score", "words", "pairs"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_words long, n_bytes long, known long, base double, score double, words array<string>, pairs array<long>"
    )


def score(docs: DataFrame, key: str = "doc_id", depth: int = DEPTH, frequent: int = FREQUENT) -> DataFrame:
    """Learn on the rows of ``docs`` (doc_id, text) that are not held out, score all: doc_id, held_out,
    n_tokens (words and one end), n_known (in training texts), train_tokens, base_score (log10 of the
    smoothed word frequencies), score (log10 of the model's probability of bytes and end) and
    bits_per_byte (its code length over the bytes and the end)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(key).alias("held_out"), "text")
    words, costs = word_counts(rows), pair_costs(pair_counts(rows, depth), depth)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    texts = rows.filter("not held_out").count()
    train_tokens, kinds = size.n + texts, size.v + (texts > 0)
    parts = materialize(_scored_parts(rows, words, costs, depth, frequent))
    word_rest = (
        parts.select("row", F.explode("words").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
        .join(words.select("word", "n"), "word").groupBy("row")
        .agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_base"))
    )
    pair_rest = (
        parts.select("row", F.explode("pairs").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
        .join(costs.select("pair", "cost"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("more_score"))
    )
    both = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    tokens = F.col("n_words") + 1
    total = both("score", "more_score")
    joined = parts.drop("words", "pairs").join(word_rest, "row", "left").join(pair_rest, "row", "left")
    return joined.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (both("known", "more_known") + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (both("base", "more_base") + float(np.log10(texts + 1.0)) - tokens * float(np.log10(train_tokens + kinds + 1.0))).alias("base_score"),
        total.alias("score"), (-total * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
