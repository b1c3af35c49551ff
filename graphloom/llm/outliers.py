"""Quality rules: robust multivariate outliers by minimum covariance determinant (operator 2).

Every document gets counts over its whole text and a vector of six transformed statistics. For
each (language, source) the mean and covariance of the ``share`` of documents with the smallest
determinant are estimated by concentration steps: distances to the present estimate, the closest
share, its mean and covariance, again. A step is one aggregation: documents are summed by (group,
start, distance bin), so a hot source is pre-aggregated in every task and only bins x sums per
group meet; the share is met up to one bin (2.2 % in squared distance). Two deterministic starts
(median with robust scales, median with equal scales) run side by side, the smaller determinant
wins. A document is rejected when its squared Mahalanobis distance passes the chi-square cut-off
of ``cutoff_z`` normal deviations.

Groups below ``MIN_GROUP`` documents use the estimate of their language, or of all documents.
Each covariance gets the floor ``FLOOR`` on its diagonal, so a statistic that is constant in the
core does not reject every deviation from it.

Results: null text counts as empty: all counts 0, base_failed true, kept false. Null lang or
source form groups of their own. Rows with base_failed take no part in the estimates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textbytes import Chunk, chunks, exact_numbers, mix64, release, seeds
from graphloom.session import materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SHARE = 0.75
STEPS = 6
MIN_GROUP = 60
CUTOFF_Z = 4.0
SMOOTHING = 50.0
FEATURES = ("word_length", "symbols", "repeats", "dup_lines", "capitals", "echoes")
#: Smallest standard deviation that counts, by feature.
FLOOR = (0.12, 0.45, 0.8, 0.8, 0.3, 0.8)
BINS_PER_OCTAVE = 32

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[range(65, 91)] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_echoes")


def text_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of every row of a chunk."""
    data, rows = chunk.data, chunk.rows
    start, end, row = chunk.words()
    solid = np.zeros(len(data), bool)
    if len(start):
        edges = np.zeros(len(data) + 1, np.int8)
        edges[start] += 1
        edges[end] -= 1
        solid = np.cumsum(edges[:-1], dtype=np.int8) > 0
    points = solid & ((data & 0xC0) != 0x80)
    counts = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": chunk.row_sums(points),
        "n_symbols": chunk.row_sums(_SYMBOL[data]),
        "n_capitals": chunk.row_sums(_CAPITAL[data]),
        "n_dup_lines": np.zeros(rows, np.int64), "n_repeat_words": np.zeros(rows, np.int64), "n_lines": np.zeros(rows, np.int64),
        "n_echoes": np.zeros(rows, np.int64),
    }
    if not len(start):
        return counts
    # Lines that hold a word; equal ones of a text meet in the sort.
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([chunk.offsets[:-1][np.diff(chunk.offsets) > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - ((data[line_end - 1] == 10) & (line_end > line_start))
    held = np.searchsorted(start, line_start) < np.searchsorted(start, line_end)
    line_start, line_end = line_start[held], line_end[held]
    line_row = chunk.row_of(line_start)
    counts["n_lines"] = np.bincount(line_row, minlength=rows)
    counts["n_dup_lines"] = _repeats(exact_numbers(chunk, line_start, line_end), line_row, rows)
    # Windows of eight words of one text, found again in it.
    word = exact_numbers(chunk, start, end)
    counts["n_echoes"] = np.bincount(row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])], minlength=rows)
    n = len(start) - WINDOW + 1
    if n > 0:
        whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
        twice = _found_twice(word, row, whole)
        cover = np.zeros(len(start) + 1, np.int32)
        np.add.at(cover, whole[twice], 1)
        np.add.at(cover, whole[twice] + WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        counts["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    return counts


def _found_twice(word: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the window of words that begins at each of ``at`` begins elsewhere in its text too.

    A hash brings equal windows together; the words themselves decide.
    """
    def parts(which: np.ndarray) -> list[np.ndarray]:
        return [row[which], *(word[which + k] for k in range(WINDOW))]

    key = np.zeros(len(at), np.uint64)
    for column, seed in zip(parts(at), seeds(WINDOW + 1, 21)):
        key = mix64(key + column.astype(np.uint64) * seed)
    order = np.argsort(key)
    meets = key[order][1:] == key[order][:-1]
    one, next_ = at[order[:-1][meets]], at[order[1:][meets]]
    if not all((a == b).all() for a, b in zip(parts(one), parts(next_))):
        # Different windows share a hash: sort by the words.
        columns = parts(at)
        order = np.lexsort(columns)
        meets = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    twice = np.zeros(len(at), bool)
    twice[order[1:][meets]] = True
    twice[order[:-1][meets]] = True
    return twice


def _repeats(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row the number of values equal to an earlier one of the row."""
    key = np.sort(value * rows + row)
    again = key[1:][key[1:] == key[:-1]]
    return np.bincount(again % rows, minlength=rows)


def document_counts(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Replace ``text`` by its counts, or add them to it; all other columns stay."""
    kept = [c for c in docs.columns if (with_text or c != "text") and c not in _COUNTS]

    def run(batches):
        release()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                counts = text_counts(chunk)
                columns = batch.slice(chunk.first, chunk.rows).select(kept).columns
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS)], [*kept, *_COUNTS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [f"{c} long" for c in _COUNTS]
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, ", ".join(fields))


def features() -> list:
    """The transformed statistics: logs of rates that are smoothed, as short texts vary more."""
    words = F.col("n_words") + SMOOTHING
    rate = lambda c, over, scale: F.log1p(F.lit(scale) * F.col(c) / over)
    return [
        F.log((F.col("word_chars") + 6.0 * SMOOTHING) / words),
        rate("n_symbols", words, 100.0),
        rate("n_repeat_words", words, 100.0),
        rate("n_dup_lines", F.col("n_lines") + 10.0, 100.0),
        rate("n_capitals", F.col("word_chars") + 6.0 * SMOOTHING, 100.0),
        rate("n_echoes", words, 100.0),
    ]


def _group_key(*columns: str) -> Column:
    """Text that tells null from any value."""
    parts = [F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(c), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws("|", *parts)


def _chi2_quantile(p: int, z: float) -> float:
    """Wilson–Hilferty: chi-square with p degrees at the normal deviation z."""
    return p * (1 - 2 / (9 * p) + z * np.sqrt(2 / (9 * p))) ** 3


def _normal_cdf(z: float) -> float:
    from math import erf, sqrt

    return 0.5 * (1 + erf(z / sqrt(2)))


def _consistency(p: int, share: float) -> float:
    """Factor that makes the covariance of the closest share consistent for normal data."""
    from statistics import NormalDist

    q = _chi2_quantile(p, NormalDist().inv_cdf(min(max(share, 1e-6), 1 - 1e-9)))
    df = p + 2
    z = ((q / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    return share / _normal_cdf(z)


def _state(group, start, n, mean, cov):
    """A row of the present estimate: the centre and a whitening matrix."""
    cov = cov + np.diag(np.square(FLOOR))
    white = np.linalg.inv(np.linalg.cholesky(cov))
    return group, start, float(n), float(np.linalg.slogdet(cov)[1]), mean.tolist(), white.ravel().tolist()


_STATE = "g string, start int, n double, logdet double, centre array<double>, white array<double>"


def _distance(p: int):
    """Squared Mahalanobis distance of column ``f`` to ``centre`` under ``white``."""
    z = [F.col("f")[i] - F.col("centre")[i] for i in range(p)]
    rows = [sum((F.col("white")[k * p + i] * z[i] for i in range(k + 1)), F.lit(0.0)) for k in range(p)]
    return sum((r * r for r in rows), F.lit(0.0))


def estimates(vectors: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant estimates: one row (g, n, logdet, centre, white) per group of
    ``vectors`` (g, f array of doubles). The number of documents of a group does not matter to any
    task: what meets per group is a bounded number of bins."""
    p = len(FEATURES)

    def starts(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for group, n, q in zip(frame.g, frame.n, frame.q):
            q = np.array([list(x) for x in q])
            scale = np.maximum((q[:, 2] - q[:, 0]) / 1.349, np.array(FLOOR))
            rows.append(_state(group, 0, n, q[:, 1], np.diag(scale**2)))
            rows.append(_state(group, 1, n, q[:, 1], np.eye(p) * np.mean(scale**2)))
        return pd.DataFrame(rows, columns=["g", "start", "n", "logdet", "centre", "white"])

    def over(batches):
        for batch in batches:
            yield starts(batch)

    quantiles = F.array(*[F.percentile_approx(F.col("f")[i], [0.25, 0.5, 0.75], 2000) for i in range(p)])
    state = materialize(vectors.groupBy("g").agg(F.count(F.lit(1)).alias("n"), quantiles.alias("q")).mapInPandas(over, _STATE))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(p)] + [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"s{i}_{j}") for i, j in pairs]

    def concentrate(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        n = frame["n"].to_numpy(float)
        wanted = share * n.sum()
        used = np.searchsorted(np.cumsum(n), wanted) + 1
        part = frame.iloc[:used]
        size = part["n"].sum()
        mean = np.array([part[f"s{i}"].sum() for i in range(p)]) / size
        cov = np.zeros((p, p))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = part[f"s{i}_{j}"].sum() / size - mean[i] * mean[j]
        cov *= _consistency(p, size / n.sum())
        cov = cov + np.eye(p) * 1e-9
        return pd.DataFrame([_state(frame["g"].iloc[0], int(frame["start"].iloc[0]), n.sum(), mean, cov)], columns=["g", "start", "n", "logdet", "centre", "white"])

    for _ in range(steps):
        near = vectors.join(state.select("g", "start", "centre", "white"), "g")
        bins = F.floor(F.log2(F.greatest(_distance(p), F.lit(1e-6))) * BINS_PER_OCTAVE).alias("bin")
        binned = near.select("g", "start", "f", bins).groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
        state = materialize(binned.groupBy("g", "start").applyInPandas(concentrate, _STATE))
    return state.groupBy("g").agg(F.min_by(F.struct("n", "logdet", "centre", "white"), F.struct("logdet", "start")).alias("e")).select("g", "e.*")


def judge(docs: DataFrame, cutoff_z: float = CUTOFF_Z) -> DataFrame:
    """Add counts, base_failed, distance (squared Mahalanobis; null if base_failed) and kept to the
    rows of ``docs`` (text, lang, source and any others; text itself is left out)."""
    counted = materialize(document_counts(docs))
    return _judged(counted, _chosen(counted), cutoff_z)


def keep(docs: DataFrame, cutoff_z: float = CUTOFF_Z) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns. Texts are counted twice, once
    for the estimates and once for the verdict, so that none is moved."""
    chosen = _chosen(materialize(document_counts(docs.select("text", "lang", "source"))))
    names = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang", "source")}
    rows = document_counts(docs.select("text", "lang", "source", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), with_text=True)
    return _judged(rows, chosen, cutoff_z).filter("kept").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _prepared(counted: DataFrame) -> DataFrame:
    """Counts with base_failed, the feature vector f and the groups gs, finest first."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    levels = F.array(_group_key("lang", "source"), F.concat(_group_key("lang"), F.lit("|*")), F.lit("*"))
    return counted.withColumns({"base_failed": failed, "f": F.array(*features()), "gs": levels})


def _chosen(counted: DataFrame) -> DataFrame:
    """(gs, centre, white): the estimate of every language and source."""
    good = _prepared(counted).filter(~F.col("base_failed"))
    found = materialize(estimates(good.select(F.explode("gs").alias("g"), "f"))).filter(F.col("n") >= MIN_GROUP)
    # The finest level with enough documents; in a corpus below that size nothing but the base rules.
    keys = good.select("gs").distinct()
    # Written, so that its real size (one row per language and source) decides how it is joined.
    return materialize(
        keys.select("gs", F.posexplode("gs").alias("level", "g")).join(found, "g", "left")
        .groupBy("gs").agg(F.min_by(F.struct("centre", "white"), F.when(F.col("centre").isNotNull(), F.col("level"))).alias("e"))
        .select("gs", "e.centre", "e.white")
    )


def _judged(counted: DataFrame, chosen: DataFrame, cutoff_z: float) -> DataFrame:
    p = len(FEATURES)
    judged = _prepared(counted).join(chosen, "gs", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(p)))
    cut = _chi2_quantile(p, cutoff_z)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return judged.withColumn("kept", kept).drop("gs", "f", "centre", "white")
