"""Bounded neighbourhoods of a global order, and groups as runs of sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize


def ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """Add ``rank`` (0, 1, …) in the order of ``keys``.

    A range sort deals the rows, each partition numbers its own, and the offsets are a running sum
    over one row per partition. Equal keys are dealt on by a hash of all columns, so a value that
    many rows share does not fill one partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("tie", F.xxhash64(*rows.columns))
    placed = materialize(
        spread.repartitionByRange(parts, *keys, "tie").sortWithinPartitions(*keys, "tie")
        .withColumn("slot", F.monotonically_increasing_id()).drop("tie")
    )
    part = F.shiftright("slot", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumns({"part": part, "row": F.expr("slot & 8589934591L")})
    return numbered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("row")).drop("part", "slot", "row", "offset")


def overlapping_blocks(rows: DataFrame, block: int, window: int, before: bool = False) -> DataFrame:
    """Rows with ``rank`` dealt into blocks of ``block``; the first ``window`` rows of a block are
    also guests (``host`` false) of the block before, so any two rows up to ``window`` apart meet.
    With ``before`` the last rows of a block are guests of the next one as well."""
    number, place = F.floor(F.col("rank") / block), F.col("rank") % block
    at = lambda shift, host: F.struct((number + shift).alias("block"), F.lit(host).alias("host"))
    places = [at(0, True), F.when((place < window) & (number > 0), at(-1, False))]
    if before:
        places.append(F.when(place >= block - window, at(1, False)))
    return rows.withColumn("p", F.explode(F.array_compact(F.array(*places)))).select("p.block", "p.host", *rows.columns)


def gathered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a group in one partition, one after another; groups are small by construction."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *order)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of ``gathered`` rows, one table each; holds one group and one batch at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            value = table.column(key).combine_chunks()
            codes = value.dictionary_encode(null_encoding="encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            change |= codes[1:] != codes[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
