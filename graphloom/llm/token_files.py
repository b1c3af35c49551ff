"""Token ids written as frequency-ranked, byte-aligned variable-length files (operator 5).

Format: a Parquet table, one row per block of whole documents, in ascending ``doc_id`` order by
(part, block). Ids are replaced by their frequency rank over the whole corpus (0: most frequent;
ties by id), so the commonest take one byte. Each document is a run of control bytes and a run of
data bytes: a control byte holds the byte lengths (1 to 4) of four ranks in two bits each, lowest
bits first; a document is filled up with rank 0 to a multiple of four. Blocks keep control and data
bytes apart. The ranking lies beside them as ``ranks`` (rank, id). Reading looks lengths up by
control byte in a table of 256 rows and gathers the data bytes with numpy.

Spark's own writer commits the files, so a lost executor or a repeated task leaves no double rows,
and any file system Spark reaches will do.

Results: a null text counts as empty, so its document is the end id alone. Documents with equal
doc_id are put next to each other, ordered by the bytes of their ids. A null doc_id comes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import Vocabulary, _read, _vocabulary
from graphloom.llm.textbytes import WordStore, chunks, encode_by_words, ragged, worker_cache
from graphloom.session import scratch_dir

END_ID = 0
BLOCK_IDS = 1 << 16
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def _library(content: str):
    """The vocabulary's word splitter, the public library's tokenizer and a store of its results."""
    from tokenizers import Tokenizer

    return worker_cache(("library", hash(content)), lambda: (Vocabulary(content), Tokenizer.from_str(content), WordStore()))


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_ids, ids as little-endian unsigned binary, 2 or 4 bytes each by vocabulary size).

    The library encodes each distinct word of a worker once; words are the pieces it would cut
    itself, so the ids are those of the whole text.
    """
    content = _read(tokenizer_path)
    width = 2 if _vocabulary(content).size <= 1 << 16 else 4

    def run(batches):
        vocabulary, library, store = _library(content)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                start, end, _ = vocabulary.split(chunk)

                def encode_new(words):
                    pieces = [chunk.data[a:b].tobytes().decode() for a, b in zip(start[words], end[words])]
                    found = [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)]
                    return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

                if len(start):
                    ids, per_row = encode_by_words(chunk, start, end, store, encode_new)
                else:
                    ids, per_row = np.zeros(0, np.int32), np.zeros(chunk.rows, np.int64)
                ids = np.insert(ids, np.cumsum(per_row), end_id).astype(f"<u{width}")
                offsets = np.concatenate([[0], np.cumsum((per_row + 1) * width)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), chunk.rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, chunk.rows), pa.array(per_row + 1), packed], ["doc_id", "n_ids", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids binary")


def id_counts(ids: DataFrame, width: int) -> DataFrame:
    """(id, n) over all documents; each task sends at most one row per id of the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.column(0):
                own = np.bincount(np.frombuffer(row.as_py(), f"<u{width}"))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of one document's ranks."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint32)
    padded[: len(ranks)] = ranks
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    low = padded.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, low[np.arange(4) <= code[:, None]]


def decode_ranks(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All ranks (with the fill of each document) of a run of control and data bytes."""
    length = _LENGTHS[control].ravel()
    at = np.cumsum(length) - length
    value = data[at].astype(np.uint32)
    for byte in (1, 2, 3):
        wide = np.flatnonzero(length > byte)
        value[wide] |= data[at[wide] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return value


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Encode every document of ``docs`` (doc_id, text) and write ``path``/blocks and ``path``/ranks."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if _vocabulary(_read(tokenizer_path)).size <= 1 << 16 else 4
    token_ids(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.schema("doc_id long, n_ids long, ids binary").parquet(f"{path}/ids")
    # At most one row per id of the vocabulary reaches the driver.
    counted = id_counts(ids, width).orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(np.int64)
    spark.createDataFrame(list(enumerate(counted.tolist())), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(counted.max(initial=0)) + 1, np.uint32)
    rank_of[counted] = np.arange(len(counted))

    def pack(batches):
        part, block, base = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def row():
            doc_ids, lengths, control, data = zip(*held)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "block": block, "base": base, "n_ids": size, "doc_ids": doc_ids, "lengths": lengths, "control": b"".join(control), "data": b"".join(data)}],
                pa.schema([("part", pa.int32()), ("block", pa.int64()), ("base", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]),
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                own = np.frombuffer(ids.as_buffer(), f"<u{width}")
                held.append((doc_id, len(own), *(x.tobytes() for x in encode_ranks(rank_of[own]))))
                size += len(own)
                if size >= BLOCK_IDS:
                    yield row()
                    block, base, held, size = block + 1, base + size, [], 0
        if held:
            yield row()

    # The range sort reads written ids, so drawing its bounds costs no encoding.
    (
        ids.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
        .mapInArrow(pack, "part int, block long, base long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary")
        .write.option("compression", "zstd").parquet(f"{path}/blocks")
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; start counts the ids of all before it."""
    return _read_blocks(spark, path, "ids array<long>", lambda own, _: own.tolist())


def _read_blocks(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").toPandas()  # one row per id of the vocabulary
    id_of = np.zeros(len(ranks) + 1, np.uint32)
    id_of[ranks["rank"].to_numpy(np.int64)] = ranks["id"].to_numpy(np.int64)
    # One row per written part: its number of ids gives the offsets of the later parts.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ranked = decode_ranks(np.frombuffer(row["control"], np.uint8), np.frombuffer(row["data"], np.uint8))
                padded = -(-lengths // 4) * 4
                ids = id_of[ranked[ragged(np.cumsum(padded) - padded, lengths)]]
                ends = np.cumsum(lengths)
                start = row["offset"] + row["base"] + ends - lengths
                values = [value(ids[a:b], b - a) for a, b in zip(ends - lengths, ends)]
                name, kind = column.split(" ")
                kinds = {"array<long>": pa.list_(pa.int64()), "long": pa.int64()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(lengths), pa.array(values, kinds[kind])], ["doc_id", "start", "n_tokens", name]
                )

    wanted = blocks.select("part", "base", "doc_ids", "lengths", "control", "data").join(offsets, "part")
    return wanted.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def file_digests(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 per document."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/token-files/{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_path, path)
    return _read_blocks(spark, path, "ids_crc32 long", lambda own, _: zlib.crc32(own.astype("<u4").tobytes()))
