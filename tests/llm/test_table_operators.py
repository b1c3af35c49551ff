"""Audit, vectors, mixing and the pipeline against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle, mixing, vector_passes


def test_merkle_audit(spark):
    rows = [(f"f{i // 40}", i, f"body {i}" * (1 + i % 5)) for i in range(200)] + [("f9", None, None)]
    ours = spark.createDataFrame(rows, "file string, record_id long, body string")
    assert merkle.audit(merkle.tree(ours), merkle.tree(ours)).count() == 0
    changed = [(f, i, b.upper() if i == 7 else b) for f, i, b in rows if i not in (130,) and f != "f4"] + [("f3", 999, "new"), ("f8", 1, "other")]
    theirs = spark.createDataFrame(changed, "file string, record_id long, body string")
    got = {(r.file, r.record_id): r.kind for r in merkle.audit(merkle.tree(ours), merkle.tree(theirs)).collect()}
    expected = {("f0", 7): "corrupt", ("f3", 130): "missing", ("f3", 999): "extra", ("f8", 1): "extra"}
    expected |= {("f3", i): "moved" for i in range(131, 160)} | {("f4", i): "missing" for i in range(160, 200)}
    assert got == expected
    nothing = ours.limit(0)
    assert merkle.audit(merkle.tree(nothing), merkle.tree(nothing)).count() == 0
    assert merkle.audit(merkle.tree(ours), merkle.tree(nothing)).count() == len(rows)


def test_merkle_root_covers_every_record(spark):
    rows = [("f", i, f"r{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "file string, record_id long, body string")
    levels = merkle.tree(frame)
    assert [level.count() for level in levels] == [300, 19, 2, 1]
    root = merkle.roots(levels).first()
    assert (root.start, root.end) == (0, sum(len(b) for _, _, b in rows))
    other = merkle.tree(frame.withColumn("body", F.when(F.col("record_id") == 299, "R299").otherwise(F.col("body"))))
    assert merkle.roots(other).first().root != root.root


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a", "é"), (None, None, None)], "page_id long, url string, html string")
    body = {r.record_id: r.body for r in merkle.warc_records(pages).collect()}
    assert "Content-Length: 2\r\n\r\né\r\n\r\n" in body[1] and "Content-Length: 0" in body[None]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for group in range(120):
        base = rng.normal(size=16)
        for _ in range(1 + group % 6):
            rows.append((base + rng.normal(size=16) * rng.uniform(0, 0.35)).tolist())
    rows += rows[:5] + [[float("nan")] * 16, [0.0] * 16, [None] + [1.0] * 15, None, [], [1.0, 2.0], [2.0, 4.0], [float("inf")] * 16]
    return rows


def test_vector_links(spark, vectors):
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, v string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_passes.near_duplicates(frame).collect()}
    units = {}
    for i, v in enumerate(vectors):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            units[i] = np.array(v) / np.linalg.norm(v)
    links = {i: {j for j in units if j != i and len(units[j]) == len(units[i]) and units[i] @ units[j] >= 0.9} for i in units}
    label = {i: i for i in range(len(vectors))}
    changed = True
    while changed:
        changed = False
        for i in links:
            low = min([label[i], *(label[j] for j in links[i])])
            if low < label[i]:
                label[i], changed = low, True
    assert got == {i: (len(links.get(i, ())), label[i], label[i] == i) for i in range(len(vectors))}
    assert vector_passes.near_duplicates(frame.limit(0)).count() == 0


def test_passes_alone_find_the_pairs(spark, vectors, monkeypatch):
    """Small windows and blocks: recall over many blocks, against brute force."""
    monkeypatch.setattr(vector_passes, "BLOCK", 32)
    monkeypatch.setattr(vector_passes, "WINDOW", 16)
    monkeypatch.setattr(vector_passes, "TILE", 4)
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    few = vector_passes.near_duplicates(frame, passes=vector_passes.passes_for(len(vectors), 0.9, 16)).select("vec_id", "component_id")
    monkeypatch.undo()
    whole = vector_passes.near_duplicates(frame).select("vec_id", "component_id")
    assert few.intersect(whole).count() >= 0.99 * len(vectors)
    assert vector_passes.passes_for(500, 0.9) == 1 < vector_passes.passes_for(10**5, 0.9) < vector_passes.passes_for(10**9, 0.9) < 500


def test_dense_group_keeps_its_links(spark, monkeypatch):
    """A third of the vectors at pairwise cosine 0.8: their sign prefixes hold far more than a window."""
    monkeypatch.setattr(vector_passes, "BLOCK", 32)
    monkeypatch.setattr(vector_passes, "WINDOW", 16)
    monkeypatch.setattr(vector_passes, "REST_TILE", 128)
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(rng.normal(size=48))
    beside = rng.normal(size=(700, 48))
    beside = unit(beside - np.outer(beside @ axis, axis))
    dense = 0.8**0.5 * axis + 0.2**0.5 * beside
    turned = rng.normal(size=(100, 48))
    turned -= np.einsum("ij,ij->i", turned, dense[:100])[:, None] * dense[:100]
    planted = 0.905 * dense[:100] + (1 - 0.905**2) ** 0.5 * unit(turned)
    rows = np.concatenate([dense, planted, unit(rng.normal(size=(1400, 48)))])
    rows = unit(rows)[rng.permutation(len(rows))]
    near = rows @ rows.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        low = np.minimum(label, np.where(near, label[None, :], len(rows)).min(1))
        if (low == label).all():
            break
        label = low
    assert near.sum() >= 200
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    few = vector_passes.near_duplicates(frame, passes=vector_passes.passes_for(len(rows), 0.9, 16))
    got = {r.vec_id: (r.n_links, r.component_id) for r in few.collect()}
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(len(rows))}


def plain_targets(per):
    """Share by weight, stop at three times the source, share the rest again."""
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    fixed, total = {}, sum(per.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if level * weight[s] > 3 * per[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3 * per[s] for s in over}


def test_mixing(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        source = [None, "a", "b", "é", "tiny", "zero"][0 if i % 3 == 0 else 1 + i % 3 if i % 50 else 4]
        rows.append((i, " ".join(["w"] * int(rng.lognormal(3, 1.2))), source, 1))
    rows += [(9000, None, "zero", 1), (9001, "", "zero", 1), (None, "x y", "a", 1), (5, "again", "b", 1), (5, "again", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert [tuple(r)[:8] for r in sorted(out, key=key)][0] is not None
    assert [(r.doc_id, r.taken) for r in sorted(out, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in out)
    per = {}
    for _, text, source, _ in rows:
        per[source] = per.get(source, 0) + len((text or "").split())
    target, taken = plain_targets(per), {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
    for source, words in taken.items():
        assert abs(words - target[source]) <= max(5, 0.01 * target[source]), source
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rates_are_the_entropy_balance(spark):
    """One multiplier per source, found by plain bisection, gives the same rates."""
    sizes = [1, 2, 5, 9, 30, 200, 4, 7]
    rows = [(i, " ".join(["w"] * n), "a" if i % 2 else "b") for i, n in enumerate(sizes * 6)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        own = [r for r in out if r.source == source]
        x = np.array([r.size for r in own], float)
        low, high = -2000.0, 2000.0
        for _ in range(200):
            lam = (low + high) / 2
            if (np.minimum(3, np.exp(np.clip(lam * x / x.max(), -700, 50))) * x).sum() < own[0].target:
                low = lam
            else:
                high = lam
        assert np.allclose([r.rate for r in own], np.minimum(3, np.exp(np.clip(low * x / x.max(), -700, 50))), atol=1e-4)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8)))) for _ in range(300)]
    clean = [" ".join(rng.choice(vocabulary, int(rng.integers(30, 90)))) for _ in range(90)]
    texts = clean + clean[:10] + [None, "", "1 2 3", "short text", "x " * 60]
    rows = [(i, t, "en", "s%d" % (i % 3), len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    seen = []
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == p.COLUMNS, name
        seen.append({r.doc_id for r in kept.collect()})
    assert seen[0] == set(range(100)) | {103, 104} and seen[1] == set(range(100)) and seen[2] == set(range(90))
    assert seen[3] <= seen[2] and kept.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert p.run(spark, str(tmp_path)).count() == kept.count()
    nothing = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_near_dedup_judges_rows_not_ids(spark):
    """Id 7 holds a copy of 3's text and a text that represents 9; id 8 holds two texts of their own."""
    import corpus_pipeline as p

    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(3, words[0]), (7, words[0]), (7, words[1]), (9, words[1]), (8, words[2]), (8, words[3]), (8, words[3]), (None, words[4]), (None, words[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.near_dedup(spark, docs, "")
    assert kept.columns == p.COLUMNS
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()))
    assert got == sorted([(3, words[0]), (7, words[1]), (8, words[2]), (8, words[3]), (0, words[4]), (0, words[4])])


def test_stages_keep_extra_columns_and_hot_groups(spark, tmp_path):
    """Columns named like the operators' own come back as they were; one source and one text are hot."""
    import corpus_pipeline as p

    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8)))) for _ in range(300)]
    clean = [" ".join(rng.choice(vocabulary, int(rng.integers(30, 90)))) for _ in range(60)]
    names = ["row_key", "gone", "copies", "score", "lang_pred", "held_out", "k", "rows", "copy", "h", "bound", "place", "size", "n_words", "kept", "word", "a.b"]
    rows = []
    for i in range(90):
        text = clean[i] if i < 60 else clean[0]
        rows.append((None if i == 59 else i, text, "en", "hot" if i % 3 else None, len(text), *[float(i)] * len(names)))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` double" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        for row in kept.collect():
            own = row.asDict()
            assert all(own[n] == own["row_key"] for n in names) and (own["doc_id"] is None or own["doc_id"] == own["row_key"])
    assert {r.doc_id for r in p.near_dedup(spark, docs, "").collect()} == {*range(59), None}
    same = docs.limit(1).select("*").unionByName(docs.limit(1).withColumn("n_chars", F.lit(7).cast("long")))
    assert {r.n_chars for r in p.mix_sources(spark, same, "").collect()} <= {7, len(clean[0])}
