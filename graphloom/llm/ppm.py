"""Language identification by prediction by partial matching (operator 4).

Per language a tree of byte contexts of order 0 to ``max_order`` counts which byte follows. A byte
seen in a context costs -log2(c / (n + d)) bits there (n occurrences, d distinct followers); an
unseen byte costs the escape d / (n + d) and then its cost in the next shorter context, whose
probabilities are renormalised without the bytes already excluded; below order 0 all 256 bytes are
equal. Statistics are frozen after learning, so the cost of a byte depends on its context alone:
the trees of all languages are compiled into one table (longest known context x byte -> bits per
language) and a text's exact code length is a sum of table look-ups over all its bytes.

Learning reads at most ``sample_docs`` texts per language (those with the smallest hash of their
position in the key space), the only bound; counting runs in Spark, one row per (language, context,
byte). Every text is scored whole.

Results: ``und`` and score 0 if the text is null, empty or has no letter, or if nothing could be
learned. The score is the share of the best language in 2**-bits over all languages. Ties go to the
language first in code point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.textbytes import Chunk, chunks, release, worker_cache
from graphloom.session import materialize

MAX_ORDER = 3
SAMPLE_DOCS = 600
MIN_CONTEXT = 3
UNKNOWN = "und"
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def learning_rows(docs: DataFrame, key: Column, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``sample_docs`` rows (lang, text) per language: the smallest hashes of ``key``.

    Counts per language set a hash bound that keeps about twice the sample; only those rows are
    ranked, so no language gathers in one task.
    """
    rows = docs.filter("lang is not null and text is not null").withColumn("h", F.xxhash64(key.cast("string"), F.lit(4)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    bound = counts.select("lang", (F.lit(-(2.0**63)) + 2.0**64 * F.least(F.lit(1.0), (2.0 * sample_docs + 50) / F.col("n"))).alias("bound"))
    near = rows.join(F.broadcast(bound), "lang").filter(F.col("h").cast("double") <= F.col("bound"))
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    return near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample_docs).select("lang", "text")


def _contexts(chunk: Chunk, symbols: np.ndarray, max_order: int) -> list[np.ndarray]:
    """For each distance 1…max_order the symbol that far back, 0 before the start of the text."""
    own = symbols[chunk.data]
    back = []
    starts = chunk.offsets[:-1]
    for distance in range(1, max_order + 1):
        shifted = np.zeros(len(own), own.dtype)
        shifted[distance:] = own[:-distance] if distance < len(own) else own[:0]
        for step in range(distance):  # a position past a short text is as close to the next one's start
            at = starts + step
            shifted[at[at < len(own)]] = 0
        back.append(shifted)
    return back


def context_counts(rows: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """(lang, order, context, byte, n); a context is its bytes + 1 in base 257, nearest byte lowest."""
    plain = np.arange(256, dtype=np.int64) + 1

    def run(batches):
        release()
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for chunk in chunks(batch.column("text")):
                if not len(chunk.data):
                    continue
                back = _contexts(chunk, plain, max_order)
                row = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))
                for lang in set(langs[chunk.first : chunk.first + chunk.rows]):
                    own = (langs[chunk.first : chunk.first + chunk.rows] == lang)[row]
                    byte, context = chunk.data[own].astype(np.int64), np.zeros(int(own.sum()), np.int64)
                    for order in range(max_order + 1):
                        if order:
                            context = context + back[order - 1][own] * 257 ** (order - 1)
                        pair, n = np.unique(context * 256 + byte, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(pair), pa.string()), pa.array(np.full(len(pair), order)), pa.array(pair // 256), pa.array(pair % 256), pa.array(n)],
                            ["lang", "order", "context", "byte", "n"],
                        )

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, order long, context long, byte long, n long")
    return counted.groupBy("lang", "order", "context", "byte").agg(F.sum("n").alias("n"))


class Model:
    """Frozen counts of all languages; ``compiled`` turns them into look-up tables in a worker."""

    def __init__(self, langs: list[str], max_order: int, counts: np.ndarray):
        self.langs, self.max_order, self.counts = langs, max_order, counts  # rows: lang, order, context, byte, n

    def compiled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(symbol of a byte, node of a context, cost table [node, symbol, language], symbols)."""
        lang, order, context, byte, n = self.counts
        seen = np.unique(byte)
        width = len(seen) + 2  # 0: before the text; the last: bytes never learned
        symbols = np.full(256, width - 1, np.int64)
        symbols[seen] = np.arange(1, len(seen) + 1)
        digits = [np.where((d := context // 257**k % 257) > 0, symbols[np.maximum(d - 1, 0)], 0) for k in range(self.max_order)]
        packed = sum((d * width**k for k, d in enumerate(digits)), np.zeros(len(context), np.int64))
        langs = len(self.langs)
        node_of, tables, sizes = [], [], 0
        shorter_cost = np.full((1, width, langs), 1 / 256)
        shorter_nodes = np.zeros(1, np.int64)  # node number of each packed context of the shorter order
        for k in range(self.max_order + 1):
            rows = np.flatnonzero(order == k)
            total = np.bincount(packed[rows], weights=n[rows], minlength=width**k)
            known = np.flatnonzero(total >= (MIN_CONTEXT if k else 1))
            number = np.full(width**k, -1, np.int64)
            number[known] = np.arange(len(known))
            rows = rows[number[packed[rows]] >= 0]
            count = np.zeros((len(known), width, langs))
            np.add.at(count, (number[packed[rows]], symbols[byte[rows]], lang[rows]), n[rows])
            below = shorter_cost[shorter_nodes[known % width ** max(k - 1, 0)]] if k else np.broadcast_to(shorter_cost, (len(known), width, langs))
            distinct, n_all = (count > 0).sum(1, keepdims=True), count.sum(1, keepdims=True)
            left = np.maximum(1 - np.where(count > 0, below, 0).sum(1, keepdims=True), 1e-9)
            escape = np.where(n_all > 0, distinct / np.maximum(n_all + distinct, 1), 1.0)
            cost = np.where(count > 0, count / np.maximum(n_all + distinct, 1), escape * below / left)
            tables.append(cost)
            # A context that is not known acts as its longest known suffix.
            own = np.where(number >= 0, number + sizes, node_of[-1][np.arange(width**k) % width ** (k - 1)] if k else 0)
            shorter_nodes, shorter_cost, sizes = own, np.concatenate(tables), sizes + len(known)
            node_of.append(own)
        bits = -np.log2(np.maximum(shorter_cost, 1e-12)).astype(np.float32)
        return symbols, node_of[-1].astype(np.int32), bits.reshape(-1, langs), width


def learn(rows: DataFrame, max_order: int = MAX_ORDER) -> Model:
    """Count contexts of (lang, text) rows; the counts that reach the driver are bounded by the sample."""
    counted = context_counts(rows, max_order).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    index = {name: i for i, name in enumerate(langs)}
    lang = np.array([index[x] for x in counted.column("lang").to_pylist()], np.int64)
    return Model(langs, max_order, np.stack([lang, *(counted.column(c).to_numpy().astype(np.int64) for c in ("order", "context", "byte", "n"))]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score and bits_per_byte (of the best language; null without text) to ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [("lang_pred", "string"), ("score", "double"), ("bits_per_byte", "double")]
    kept = [c for c in docs.columns if c not in dict(added)]

    def run(batches):
        model = shared.value
        _, tables = worker_cache(("ppm", id(model)), lambda: (model, model.compiled() if model.langs else None))
        for batch in batches:
            for chunk in chunks(batch.column("text"), 1 << 20):
                lettered = chunk.row_sums(_LETTERS[chunk.data]) > 0
                for row in np.flatnonzero(~lettered):
                    text = chunk.data[chunk.offsets[row] : chunk.offsets[row + 1]].tobytes().decode("utf-8", "replace")
                    lettered[row] = any(map(str.isalpha, text))
                size = np.diff(chunk.offsets)
                names = np.full(chunk.rows, UNKNOWN, object)
                score, best = np.zeros(chunk.rows), np.full(chunk.rows, np.nan)
                if tables and len(chunk.data):
                    bits = _code_lengths(chunk, tables, model.max_order)
                    winner = bits.argmin(1)
                    share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                    names[lettered] = np.array(model.langs, object)[winner[lettered]]
                    score[lettered] = share[lettered]
                    best[size > 0] = bits.min(1)[size > 0] / size[size > 0]
                columns = batch.slice(chunk.first, chunk.rows).select(kept).columns
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(best, mask=np.isnan(best))], [*kept, *dict(added)]
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [f"{a} {b}" for a, b in added]
    return docs.select(*kept).mapInArrow(run, ", ".join(fields))


def _code_lengths(chunk: Chunk, tables, max_order: int) -> np.ndarray:
    """Bits of each row under each language."""
    symbols, node_of, bits, width = tables
    context = np.zeros(len(chunk.data), np.int64)
    for k, shifted in enumerate(_contexts(chunk, symbols, max_order)):
        context += shifted * width**k
    cost = bits[node_of[context] * np.int64(width) + symbols[chunk.data]]
    filled = np.flatnonzero(np.diff(chunk.offsets) > 0)
    total = np.zeros((chunk.rows, bits.shape[1]))
    total[filled] = np.add.reduceat(cost, chunk.offsets[filled], axis=0, dtype=np.float64)
    return total


def identify(docs: DataFrame, key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, folds: int = 5) -> DataFrame:
    """Learn on rows whose crc32(key) modulo ``folds`` is not 0, predict all: docs with held_out,
    lang_pred, score and bits_per_byte."""
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))
    rows = materialize(learning_rows(docs.filter(~held).select(*dict.fromkeys([key, "lang", "text"])), F.col(key), sample_docs))
    return predict(docs.withColumn("held_out", held), learn(rows))
