"""Embedding near-duplicates by sorted projection passes (operator 7).

Equal vectors are one class first (by a 64-bit hash of their doubles). In every pass the classes are ordered by the concatenated signs
of ``BITS`` random projections (read as one number, so the order is lexicographic), and each is
compared with at least the next ``WINDOW`` of that order: the order is cut into blocks that
overlap by the window, a block is one small matrix product. Pairs found are verified in double
precision; of a block's verified links a spanning forest goes on, and the forests of all passes
are united into components.

Two vectors at the threshold agree in a projection with 1 - acos(threshold)/pi; they stay within a
window if they agree in about log2(n / WINDOW) leading ones on even data. The first passes are
sized for that, and what they reached is measured: every class learns how many leading signs
another one must share with it to be in its window for sure, which gives the probability that the
passes so far miss a link of the class. Classes where it is not below ``MISS``, as in dense groups
whose prefixes hold far more than a window, get further passes among themselves or, where that is
cheaper, are compared completely in tiles (``rest_links``). A link is missed only if both of its
ends would miss it.

The number of links of a vector is then counted exactly: links lie inside components only, a
component is dealt into tiles of about ``TILE`` classes, and each pair of tiles is one task that
returns counts, never pairs.

Results: vectors that are null, empty, zero or hold null or non-finite components link with nothing
and are kept. Vectors of different length do not link. Rows of one vec_id are one vector each;
copies link with each other. A null vec_id is a vector like any other; a component's id is its smallest non-null vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.ordering import gathered, local_components, overlapping_blocks, ranked, runs
from graphloom.operators.traverse import connected_components
from graphloom.session import materialize, union_all

THRESHOLD = 0.9
BITS = 48
WINDOW = 512
BLOCK = 1024
TILE = 512
REST_TILE = 2048
MISS = 1e-3


def passes_for(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with a probability below ``miss`` if sign
    words are spread evenly; ``all_links`` measures what they reached."""
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** max(0.0, math.log2(max(1, n) / window))
    return 1 if met >= 1 else math.ceil(math.log(miss) / math.log(1 - met))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of packed rows of equal length, in double precision."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    packed = packed / np.abs(packed).max(1, keepdims=True)
    return packed / np.linalg.norm(packed, axis=1, keepdims=True)


VALID = (
    "coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    " and exists(embedding, x -> x <> 0), false)"
)


def pack(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, node): valid vectors as packed doubles, and the number of their content."""

    def run(batches):
        for batch in batches:
            values = [(np.asarray(x, np.float64) + 0.0).tobytes() for x in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(values, pa.binary())], ["vec_id", "v"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    packed = vectors.filter(VALID).select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, v binary")
    return packed.withColumn("node", F.xxhash64("v"))


def projected(classes: DataFrame, passes: int, seed: int, first: int = 0) -> DataFrame:
    """(pass, dim, bits, node, v): each class once per pass, from number ``first`` on, with its sign word."""

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = np.array([len(x) // 8 for x in batch.column("v").to_pylist()])
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                unit = _matrix(rows.column("v"))
                for number in range(first, first + passes):
                    if (dim, number) not in planes:
                        planes[dim, number] = np.random.default_rng([seed, number, int(dim)]).standard_normal((dim, BITS))
                    signs = unit @ planes[dim, number] > 0
                    bits = signs.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(bits), rows.column("node"), rows.column("v")], ["pass", "dim", "bits", "node", "v"]
                    )

    return classes.select("node", "v").mapInArrow(run, "pass int, dim int, bits long, node long, v binary")


def pass_blocks(order: DataFrame) -> DataFrame:
    """Overlapping blocks of ``order``; of the rows before a block only the sign words are needed."""
    placed = overlapping_blocks(order, BLOCK, WINDOW, before=True)
    return placed.withColumn("v", F.when(F.col("rank") >= F.col("block") * BLOCK, F.col("v")))


def _depths(rank: np.ndarray, number: np.ndarray, bits: np.ndarray, host: np.ndarray, window: int) -> np.ndarray:
    """Leading signs that a class must share with each host to lie within ``window`` for sure;
    ``BITS`` + 1 if no number of them is enough."""
    depth = np.zeros(int(host.sum()), np.int64)
    for shift in (-window, window):
        at = np.searchsorted(rank, rank[host] + shift)
        inside = at < len(rank)
        at = np.minimum(at, len(rank) - 1)
        inside &= (rank[at] == rank[host] + shift) & (number[at] == number[host])
        # Sign words have at most 48 bits, so the binary exponent is the place of the first differing one.
        shared = BITS - np.frexp((bits[at] ^ bits[host]).astype(np.float64))[1]
        depth = np.maximum(depth, np.where(inside, shared + 1, 0))
    return depth


def forest(blocks: DataFrame, threshold: float) -> DataFrame:
    """(source_id, target_id, missed): a spanning forest of the verified links of every block, and,
    without a target, the logarithm of the probability that this pass misses a link of each class."""
    agree, window = 1 - math.acos(threshold) / math.pi, WINDOW
    with np.errstate(divide="ignore"):
        log_missed = np.append(np.log(1 - agree ** np.arange(BITS + 1)), 0.0)

    def run(batches):
        for group in runs(batches, ["block", "dim"]):
            rank, number, bits = (group.column(c).to_numpy() for c in ("rank", "pass", "bits"))
            host = group.column("host").to_numpy()
            if not host.any():
                continue
            missed = log_missed[_depths(rank, number, bits, host, window)]
            own = group.column("node").to_numpy()[host]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(missed)], ["source_id", "target_id", "missed"])
            group = group.filter(group.column("v").is_valid())
            unit = _matrix(group.column("v"))
            host = group.column("host").to_numpy()
            node = group.column("node").to_numpy()
            near = unit[host].astype(np.float32) @ unit.astype(np.float32).T >= threshold - 1e-4
            a, b = np.nonzero(near)
            a, b = _linked(unit, np.flatnonzero(host)[a], b, threshold)
            source, target = _spanning(node, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(target), pa.nulls(len(source), pa.float64())], ["source_id", "target_id", "missed"])

    return gathered(blocks, ["block", "dim"], ["rank"]).mapInArrow(run, "source_id long, target_id long, missed double")


def _linked(unit: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of different rows that reach ``threshold`` in double precision."""
    a, b = a[a != b], b[a != b]
    exact = np.concatenate([np.einsum("ij,ij->i", unit[a[i : i + 65536]], unit[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    return a[exact >= threshold], b[exact >= threshold]


def _spanning(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node with the first one of its component."""
    label = local_components(a, b, len(node))
    linked = np.flatnonzero(label != np.arange(len(node)))
    linked = linked[node[linked] != node[label[linked]]]
    return node[linked], node[label[linked]]


def rest_links(open_classes: DataFrame, threshold: float) -> DataFrame:
    """(source_id, target_id): links that unite components of ``open_classes`` (node, component, v).

    Every two classes of different components are compared: the classes are cut into tiles of
    ``REST_TILE`` in the order of their components, and two tiles meet in one task unless both hold
    the same single component. A task returns a spanning forest, never pairs.
    """
    placed = ranked(open_classes.withColumn("dim", F.octet_length("v")), "dim", "component", "node")
    own = materialize(placed.select("dim", "component", "node", "v", F.floor(F.col("rank") / REST_TILE).alias("t")))
    tiles = own.groupBy("t").agg(
        F.min("dim").alias("low_dim"), F.max("dim").alias("high_dim"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    tiles = materialize(tiles)
    other = tiles.select(*[F.col(c).alias(f"o_{c}") for c in tiles.columns])
    meeting = tiles.join(other, F.expr("low_dim <= o_high_dim and o_low_dim <= high_dim and not (low = high and o_low = o_high and low = o_low)"))
    meeting = materialize(meeting.select("t", F.col("o_t").alias("j")))
    dealt = own.join(meeting, "t").select(F.least("t", "j").alias("a"), F.greatest("t", "j").alias("b"), "dim", "t", "component", "node", "v")

    def run(batches):
        for group in runs(batches, ["a", "b", "dim"]):
            node, component, t = (group.column(c).to_numpy() for c in ("node", "component", "t"))
            unit = _matrix(group.column("v"))
            single = unit.astype(np.float32)
            left = np.flatnonzero(t == group.column("a")[0].as_py())
            right = np.flatnonzero(t == group.column("b")[0].as_py())
            found_a, found_b = [], []
            for i in range(0, len(left), 256):
                near = single[left[i : i + 256]] @ single[right].T >= threshold - 1e-4
                near &= component[left[i : i + 256], None] != component[right]
                a, b = np.nonzero(near)
                a, b = _linked(unit, left[i : i + 256][a], right[b], threshold)
                found_a.append(a)
                found_b.append(b)
            if found_a:
                source, target = _spanning(node, np.concatenate(found_a), np.concatenate(found_b))
                yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(target)], ["source_id", "target_id"])

    return gathered(dealt, ["a", "b", "dim"], ["node"]).mapInArrow(run, "source_id long, target_id long")


def all_links(classes: DataFrame, threshold: float, passes: int, seed: int) -> DataFrame:
    """(source_id, target_id): links that span the components of ``classes`` (node, v).

    Passes go on among the classes that may still miss a link with more than ``MISS``, as long as
    they move fewer rows than comparing these classes completely, which then ends the search.
    """
    found: list[DataFrame] = []
    missed, still, done = None, classes.select("node", "v"), 0
    while True:
        order = ranked(projected(still, passes, seed, done), "pass", "dim", "bits")
        out = materialize(forest(pass_blocks(order), threshold))
        found.append(out.filter("target_id is not null").select("source_id", "target_id"))
        done += passes
        measured = out.filter("target_id is null").groupBy(F.col("source_id").alias("id")).agg(F.sum("missed").alias("missed"))
        if missed is not None:
            measured = measured.unionByName(missed).groupBy("id").agg(F.sum("missed").alias("missed"))
            measured = measured.join(still.select(F.col("node").alias("id")), "id", "left_semi")
        missed = materialize(measured.filter(F.col("missed") > math.log(MISS)))
        # Passes that a class needs at the rate it gained so far; -0.0 and 0 never arrive.
        more = F.lit(float(done)) * (F.lit(math.log(MISS)) / F.least("missed", F.lit(-1e-9)) - 1)
        n, quarter = missed.agg(F.count(F.lit(1)), F.percentile_approx(more, 0.25)).first()
        if not n:
            return union_all(found)
        still = materialize(still.join(missed.select(F.col("id").alias("node")), "node", "left_semi"))
        passes = math.ceil(min(quarter, 1e9)) + 2
        if passes >= math.ceil(n / REST_TILE):
            break
    components = connected_components(classes.select(F.col("node").alias("id")), union_all(found)).withColumnRenamed("id", "node")
    found.append(materialize(rest_links(still.join(components, "node"), threshold)))
    return union_all(found)


def link_counts(members: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(node, links): copies of other classes linked with each class of (component, node, copies, v)."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    tiles = F.ceil(F.col("m") / tile)
    own = members.join(sizes, "component").withColumns({"tiles": tiles, "t": F.pmod(F.xxhash64("node"), tiles)})
    dealt = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "component", F.least("t", "j").alias("a"), F.greatest("t", "j").alias("b"), "t", "node", "copies", "v"
    )

    def run(batches):
        for group in runs(batches, ["component", "a", "b"]):
            node, copies, t = (group.column(c).to_numpy() for c in ("node", "copies", "t"))
            unit = _matrix(group.column("v"))
            near = unit @ unit.T >= threshold
            a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
            # Tile a against tile b; inside one tile every pair, but not a class with itself.
            near &= (t[:, None] != t[None, :]) if a != b else ~np.eye(len(node), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near.astype(np.int64) @ copies)], ["node", "links"])

    counted = gathered(dealt, ["component", "a", "b"], ["node"]).mapInArrow(run, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    packed = materialize(pack(vectors))
    classes = materialize(packed.groupBy("node").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")))
    links = all_links(classes, threshold, passes or passes_for(classes.count(), threshold), seed)
    components = connected_components(classes.select(F.col("node").alias("id")), links).withColumnRenamed("id", "node")
    members = materialize(classes.join(components, "node"))
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"))
    counted = members.drop("v").join(link_counts(members, threshold), "node", "left").join(smallest, "component")
    result = counted.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = packed.select("vec_id", "node").join(result, "node").select("vec_id", "n_links", "component_id")
    alone = vectors.filter(f"not {VALID}").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
