"""Near-duplicate documents by improved consistent weighted sampling (operator 6).

A document is the weighted set of its five-word shingles; a shingle weighs (1 + ln tf) * idf. The
idf is ln(1 + 1 / max(df / N, RARE)), so it tells apart shingles that at least ``RARE`` of all
documents hold, and every rarer one weighs alike. The number of such shingles is bounded by the
mean document length over ``RARE`` whatever the corpus; the df of each is exact.

``BANDS`` x ``ROWS`` consistent weighted samples per document (Ioffe, 2010) are the signature: two
documents share a sample with the probability of their weighted Jaccard similarity, so at 0.8 one
of the bands agrees with probability 0.999. Documents of equal text are one class first. In every
bucket of a band each class is paired with the bucket's leader (another hash order per band) and
with those of its neighbours in a bounded block whose signatures agree most; a pair is verified by
the exact weighted Jaccard similarity of the whole texts. Buckets that then still hold several
components are searched exhaustively in tiles, inside tasks: every pair of two components whose
signatures agree in at least half of the samples is verified too, so the bounds above cost no link.

Results: one row per row of the input. Documents without a word (null or empty too) link with
nothing but are one class if their texts are equal and not null. A text of one to four words is one
shingle. ``class_id`` is the smallest doc_id of the class; a null doc_id has a null class_id and is
kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.ordering import gathered, runs
from graphloom.llm.textbytes import Chunk, chunks, mix64, ragged, release, seeds
from graphloom.operators.traverse import connected_components
from graphloom.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 10
ROWS = 3
#: Share of all documents from which on a shingle loses weight. All that reach it are counted exactly;
#: these mean length / ``RARE`` ones, some hundred thousand, travel with the tasks.
RARE = 0.001
BLOCK = 128
NEAREST = 3
TILE = 256
#: Buckets of the first count, by the top bits of the hash: on average a fifth of the bound each at 450
#: shingles a document, whatever their number. They travel in slices.
BUCKET_BITS = 21
BUCKET_SHIFT = np.uint64(64 - BUCKET_BITS)
SLICE = 1 << 10


def _places(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingle at every place of each row, repeats included."""
    start, end, row = chunk.words()
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word, factor = chunk.hasher()(start, end), seeds(SHINGLE, 31)
    n = len(word)
    count = np.bincount(row, minlength=chunk.rows)
    first = np.cumsum(count) - count
    combined = np.zeros(n, np.uint64)
    for k in range(SHINGLE):  # words past the end of a row do not count
        at = np.minimum(np.arange(n) + k, n - 1)
        inside = (np.arange(n) + k < n) & (row[at] == row)
        combined += np.where(inside, word[at] * factor[k], np.uint64(0))
    place = np.arange(n) - first[row]
    whole = place <= np.maximum(count[row] - SHINGLE, 0)
    return row[whole], mix64(combined[whole])


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, number) of the distinct pairs, by row and hash."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, tf) of the distinct shingles of each row, by row and hash."""
    return _distinct(*_places(chunk))


def _full_buckets(docs: DataFrame, least: float) -> np.ndarray:
    """Which of the 2 ** ``BUCKET_BITS`` buckets of shingles hold at least ``least`` places of all texts.

    A task counts all its places in one array and hands it on in slices; the tasks behind add up slices
    as they come.
    """

    def count(batches):
        release()
        total, held, size = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                held.append((_places(chunk)[1] >> BUCKET_SHIFT).astype(np.int64))
                size += len(held[-1])
                if size >= 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        sliced = total.reshape(-1, SLICE)
        used = np.flatnonzero(sliced.any(1))
        for at in range(0, len(used), 256):
            part = used[at : at + 256]
            packed = pa.array([sliced[k].astype("<u4").tobytes() for k in part], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), packed], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                counts = np.frombuffer(packed.as_py(), "<u4")
                sums[k] = sums[k] + counts if k in sums else counts.astype(np.int64)
        full = [k * SLICE + np.flatnonzero(n >= least) for k, n in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(full) if full else np.zeros(0, np.int64), pa.int64())], ["bucket"])

    counted = docs.select("text").mapInArrow(count, "slice long, counts binary")
    found = counted.repartition("slice").mapInArrow(add, "bucket long").toArrow()
    full = np.zeros(1 << BUCKET_BITS, bool)
    full[found.column("bucket").to_numpy()] = True
    return full


def frequent_shingles(docs: DataFrame, rare: float = RARE) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, document counts, number of documents): shingles of at least ``rare`` of all rows.

    Two passes (Park, Chen and Yu, 1995): every place of every text is counted in its bucket first. A
    shingle cannot stand in more documents than its bucket has places, so only those of buckets that
    reach the bound are counted by themselves, exactly. At most mean length / rare reach the driver.
    """
    total = docs.count()
    least = max(2, rare * total)
    shared = docs.sparkSession.sparkContext.broadcast(_full_buckets(docs, least))

    def flush(held: list[np.ndarray]):
        value, n = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(value), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(value[part].view(np.int64)), pa.array(n[part])], ["h", "df"])

    def run(batches):
        release()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                row, value = _places(chunk)
                maybe = shared.value[(value >> BUCKET_SHIFT).astype(np.int64)]
                held.append(_distinct(row[maybe], value[maybe])[1])
                size += len(held[-1])
                if size >= 1 << 22:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    counted = docs.select("text").mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
    frequent = counted.filter(F.col("df") >= least).toArrow()
    hashes = frequent.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], frequent.column("df").to_numpy()[order], int(total)


class Weights:
    """Weights of shingles from the frequent ones; a look-up table of the top bits spares searches."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, total: int, rare: float = RARE):
        self.hashes, self.idf = hashes, np.log1p(1 / np.maximum(df / max(total, 1), rare))
        self.default = float(np.log1p(1 / max(rare, 1 / max(total, 1))))
        self.known = np.zeros(1 << 22, bool)
        self.known[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def of(self, value: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(value), self.default)
        if len(self.hashes):
            maybe = np.flatnonzero(self.known[(value >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, value[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == value[maybe]
            idf[maybe[hit]] = np.minimum(self.idf[at[hit]], self.default)
        return (1 + np.log(tf)) * idf


_TABLE_BITS = 16


def _gamma_table() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by Newton steps on 1 - (1 + x) exp(-x) = u."""
    u = (np.arange(1 << _TABLE_BITS) + 0.5) / (1 << _TABLE_BITS)
    x = np.where(u < 0.5, np.sqrt(2 * u), 1 - np.log1p(-u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x


_GAMMA = _gamma_table()
_LOG_GAMMA = np.log(_GAMMA)


def samples(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(rows present, n) consistent weighted samples as 64-bit codes of (shingle, level)."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    length = np.diff(np.append(first, len(row)))
    log_weight = np.log(weight)
    out = np.zeros((len(first), n), np.uint64)
    low = np.uint64((1 << _TABLE_BITS) - 1)
    for k, seed in enumerate(seeds(n, 41)):
        h = mix64(value ^ seed)
        r = _GAMMA[(h & low).astype(np.int64)]
        beta = (h >> np.uint64(32)).astype(np.float64) * 2.0**-32
        level = np.floor(log_weight / r + beta)
        log_a = _LOG_GAMMA[(h >> np.uint64(16) & low).astype(np.int64)] - r * (level - beta + 1)
        least = np.minimum.reduceat(log_a, first)
        hit = np.flatnonzero(log_a == np.repeat(least, length))
        at = hit[np.searchsorted(hit, first)]
        out[:, k] = mix64(value[at] + level[at].astype(np.int64).view(np.uint64) * seed)
    return out


def signatures(docs: DataFrame, weights: Weights, key: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, node, sig, bands): ``node`` is the md5 of the text (null for null), ``sig`` the packed
    32-bit samples, ``bands`` the code of each band; both null without a word."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                row, value, tf = shingles(chunk)
                sigs, codes = [None] * chunk.rows, [None] * chunk.rows
                if len(row):
                    drawn = samples(row, value, shared.value.of(value, tf), bands * rows)
                    banded = np.zeros((len(drawn), bands), np.uint64)
                    for k, seed in enumerate(seeds(rows, 51)):
                        banded += drawn[:, k::rows] * seed
                    banded = mix64(banded.ravel()).reshape(banded.shape).view(np.int64)
                    short = (drawn >> np.uint64(32)).astype("<u4")
                    for at, (s, c) in zip(np.unique(row), zip(short, banded)):
                        sigs[at], codes[at] = s.tobytes(), c.tolist()
                part = batch.slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column("node"), pa.array(sigs, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], [key, "node", "sig", "bands"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text", F.md5(F.col("text").cast("binary")).alias("node")).mapInArrow(run, f"`{key}` {kind}, node string, sig binary, bands array<long>")


def _agreement(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (sig[:, None, :] == other[None, :, :]).sum(2)


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def first_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of (band, code, node, sig): each class with its bucket's leader, and
    with the ``NEAREST`` best agreeing ones of a block of its bucket."""
    spread = F.xxhash64("node", "band")
    leaders = members.groupBy("band", "code").agg(F.min_by("node", F.struct(spread, F.col("node"))).alias("leader"), F.count(F.lit(1)).alias("m"))
    led = members.join(leaders, ["band", "code"])
    stars = led.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    blocks = F.ceil(F.col("m") / BLOCK)
    dealt = led.filter("m > 2").select("band", "code", F.pmod(F.xxhash64("sig"), blocks).alias("block"), "node", "sig")

    def run(batches):
        for group in runs(batches, ["band", "code", "block"]):
            node = np.array(group.column("node").to_pylist(), object)
            if len(node) < 2:
                continue
            same = _agreement(sig := _sig_matrix(group.column("sig")), sig).astype(np.int16)
            np.fill_diagonal(same, -1)
            near = np.argsort(-same, axis=1, kind="stable")[:, : min(NEAREST, len(node) - 1)]
            i, j = np.repeat(np.arange(len(node)), near.shape[1]), near.ravel()
            good = same[i, j] * 2 >= sig.shape[1]
            i, j = np.minimum(i, j)[good], np.maximum(i, j)[good]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j]), pa.string()), pa.array(np.maximum(node[i], node[j]), pa.string())], ["a", "b"])

    near = gathered(dealt, ["band", "code", "block"], ["node"]).mapInArrow(run, "a string, b string")
    return stars.unionByName(near).distinct()


def rest_links(members: DataFrame, components: DataFrame, texts: DataFrame, weights: Weights, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different components of a bucket; buckets of one component are left out.

    An open bucket of (band, code, node, sig, bands) is dealt into tiles of about ``tile`` classes,
    and every two tiles meet in one small group with their texts. All pairs of two components are
    looked at there: those whose signatures agree in at least half of the samples are verified by
    their exact similarity, each in the first band it shares. A group returns the links that unite
    components, never its pairs.
    """
    shared = members.sparkSession.sparkContext.broadcast(weights)
    placed = members.join(components.select(F.col("id").alias("node"), "component"), "node")
    open_buckets = placed.groupBy("band", "code").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).filter("low <> high")
    tiles = F.ceil(F.col("m") / tile)
    own = placed.join(open_buckets.select("band", "code", "m"), ["band", "code"]).withColumns({"tiles": tiles, "t": F.pmod(F.xxhash64("node"), tiles)})
    dealt = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).join(texts, "node").select(
        "band", "code", F.least("t", "j").alias("x"), F.greatest("t", "j").alias("y"), "t", "node", "component", "sig", "bands", "text"
    )

    def run(batches):
        for group in runs(batches, ["band", "code", "x", "y"]):
            node, component = (group.column(c).to_pylist() for c in ("node", "component"))
            kind = np.unique(np.array(component), return_inverse=True)[1]
            if kind.max() == 0:
                continue
            side, sig = group.column("t").to_numpy(), _sig_matrix(group.column("sig"))
            codes = np.array(group.column("bands").to_pylist(), np.int64)
            across, band = group.column("x")[0].as_py() != group.column("y")[0].as_py(), group.column("band")[0].as_py()
            row, vocabulary, weight = _flat_vectors(group.column("text"), shared.value)
            total = np.bincount(row, weights=weight, minlength=len(node))
            cut = np.searchsorted(row, np.arange(len(node) + 1))
            root = list(range(kind.max() + 1))
            found: list[tuple[str, str]] = []
            for i in range(len(node) - 1):
                good = ((sig[i + 1 :] == sig[i]).sum(1) * 2 >= sig.shape[1]) & (kind[i + 1 :] != kind[i])
                if across:
                    good &= side[i + 1 :] != side[i]
                good &= ~(codes[i + 1 :, :band] == codes[i, :band]).any(1)
                j = i + 1 + np.flatnonzero(good)
                if not len(j):
                    continue
                mine = np.zeros(vocabulary.max() + 1)
                mine[vocabulary[cut[i] : cut[i + 1]]] = weight[cut[i] : cut[i + 1]]
                at = ragged(cut[j], cut[j + 1] - cut[j])
                low = np.bincount(np.repeat(np.arange(len(j)), cut[j + 1] - cut[j]), weights=np.minimum(mine[vocabulary[at]], weight[at]), minlength=len(j))
                for k in j[low >= (threshold - 1e-12) * (total[i] + total[j] - low)]:
                    a, b = _find(root, kind[i]), _find(root, kind[k])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        found.append((min(node[i], node[k]), max(node[i], node[k])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([q for _, q in found], pa.string())], ["a", "b"])

    return gathered(dealt, ["band", "code", "x", "y"], ["node"]).mapInArrow(run, "a string, b string").distinct()


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _flat_vectors(texts, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the shingle among all of the group, weight), by row."""
    rows, values, heavy = [], [], []
    for chunk in chunks(texts):
        row, value, tf = shingles(chunk)
        rows.append(row + chunk.first)
        values.append(value)
        heavy.append(weights.of(value, tf))
    row, value, weight = np.concatenate(rows), np.concatenate(values), np.concatenate(heavy)
    return row, np.unique(value, return_inverse=True)[1], weight


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches ``threshold``, and it; ``texts``
    holds (node, text) once per node."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")

    def vectors(column):
        for chunk in chunks(column):
            row, value, tf = shingles(chunk)
            weight = shared.value.of(value, tf)
            cut = np.searchsorted(row, np.arange(chunk.rows + 1))
            for r in range(chunk.rows):
                yield value[cut[r] : cut[r + 1]], weight[cut[r] : cut[r + 1]]

    def run(batches):
        for batch in batches:
            similarity = np.zeros(batch.num_rows)
            for at, ((v, w), (u, x)) in enumerate(zip(vectors(batch.column("a_text")), vectors(batch.column("b_text")))):
                _, i, j = np.intersect1d(v, u, assume_unique=True, return_indices=True)
                low = np.minimum(w[i], x[j]).sum()
                similarity[at] = low / max(w.sum() + x.sum() - low, 1e-300)
            keep = pa.array(similarity >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(similarity).filter(keep)], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a string, b string, similarity double")


def near_duplicates(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, rare: float = RARE) -> DataFrame:
    """(key, class_id, kept) for every row of ``docs`` (key, text); kept marks one id per class."""
    docs = docs.select(key, "text")
    weights = Weights(*frequent_shingles(docs, rare), rare)
    signed = materialize(signatures(docs, weights, key, bands, rows))
    nodes = signed.filter("sig is not null").groupBy("node").agg(F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"), F.min(key).alias("first"))
    nodes = materialize(nodes)
    codes = nodes.select("node", F.posexplode("bands").alias("band", "code"))
    shared = codes.groupBy("band", "code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = materialize(codes.join(shared, ["band", "code"]).join(nodes.select("node", "sig"), "node"))
    pairs = materialize(first_pairs(members))
    involved = members.select("node").distinct()
    # One row per node: among rows of equal text any will do, the smallest key is taken.
    chosen = nodes.select("node", F.col("first").alias("k")).join(involved, "node", "left_semi")
    hashed = docs.withColumn("node", F.md5(F.col("text").cast("binary")))
    texts = materialize(hashed.join(chosen.withColumnRenamed("node", "m"), F.expr(f"node = m and `{key}` <=> k"), "left_semi").groupBy("node").agg(F.any_value("text").alias("text")))
    links = materialize(verified(pairs, texts, weights, threshold))
    as_edges = lambda found: found.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    ids = nodes.select(F.col("node").alias("id"))
    components = materialize(connected_components(ids, as_edges(links)))
    banded = members.join(nodes.select("node", "bands"), "node")
    more = materialize(rest_links(banded, components, texts, weights, threshold))
    if more.take(1):
        components = materialize(connected_components(ids, as_edges(links.select("a", "b").unionByName(more))))
    labelled = signed.select(key, "node").join(components.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    # Written, so that the rows of a large class can be split in the join with their one class row.
    smallest = materialize(labelled.filter("c is not null").groupBy("c").agg(F.min(key).alias("class_id")).withColumnRenamed("c", "d"))
    result = labelled.join(smallest, F.expr("c = d"), "left").withColumn("class_id", F.when(F.col("c").isNull(), F.col(key)).otherwise(F.col("class_id")))
    return result.select(key, F.when(F.col(key).isNotNull(), F.col("class_id")).alias("class_id")).withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("class_id")))
