"""Operators on texts against plain versions of the same definitions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bpe, icws, licenses, outliers, page_diff, ppm, token_files
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.textbytes import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "a b c", "  lead\n\n  x \n", "it's we'll don't '' 's", "1½² 東京 éa'b  x", "x" * 300 + " aaaa" * 40,
    "<|endoftext|> in <|endoftext|>text", "tab\t\ttab\x0b\x0c\r\n", "same line\nsame line\n\nsame line", "w " * 50, "ÉCOLE école İK K", "a\x1fb\x85c",
    "under the MIT license, under the mit license under", "Apache License Version 2.0", "cc-by-nc 4", "All rights reserved.", "\U0001f600 emoji \U0001f600",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", "clash", 1.5) for i, t in enumerate(ODD_TEXTS)]
    rows += rows[3:6] + [(None, "null id text", "en", "s", "clash", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, word string, f double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def words(text):
    return WORD.findall(text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=5))
def test_words_and_hashes(texts):
    got = [[] for _ in texts]
    hashes = {}
    for chunk in chunks(pa.array(texts, pa.string()), 40):
        start, end, row = chunk.words()
        if not len(start):
            continue
        for s, e, r, h in zip(start, end, row, chunk.hasher()(start, end)):
            word = chunk.data[s:e].tobytes().decode()
            got[chunk.first + r].append(word)
            assert hashes.setdefault(word, h) == h
    assert got == [words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab '\n ts1.")), max_size=120))
def test_bpe_equals_the_library(text):
    from tokenizers import Tokenizer

    vocabulary = bpe._vocabulary(bpe._read(tokenizer_path()))
    expected = test_bpe_equals_the_library.library = getattr(test_bpe_equals_the_library, "library", None) or Tokenizer.from_file(tokenizer_path())
    ids = [int(i) for chunk in chunks(pa.array([text])) for i in vocabulary.encode_chunk(chunk)[0]]
    assert ids == expected.encode(text, add_special_tokens=False).ids
    assert vocabulary.decode(np.array(ids, np.int64)) == expected.decode(ids, skip_special_tokens=False)


def test_bpe_digests(odd, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, tokenizer_path()).collect()}
    expected = set()
    for doc_id, text in [(r.doc_id, r.text or "") for r in odd.collect()]:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.add((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == expected
    round_trip = bpe.decode(bpe.encode(odd, tokenizer_path()), tokenizer_path())
    assert {r.doc_id for r in round_trip.collect() if r.decoded != (r.text or "")} == set()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_variable_length_coding(values):
    control, data = token_files.encode_ranks(np.array(values, np.uint32))
    assert token_files.decode_ranks(control, data)[: len(values)].tolist() == values


def test_token_files(spark, odd, empty, library, tmp_path):
    got = token_files.file_digests(odd, tokenizer_path(), str(tmp_path / "files")).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = {(r.doc_id, r.text): library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows}
    start, expected = 0, []
    for r in rows:
        own = ids[r.doc_id, r.text]
        expected.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(tuple(g) for g in got if g[0] is not None) == sorted(e for e in expected if e[0] is not None)
    assert len(got) == len(rows)
    blocks = spark.read.parquet(str(tmp_path / "files" / "blocks"))
    assert blocks.agg(F.sum("n_ids")).first()[0] == start
    whole = {r.doc_id: r.ids for r in token_files.read_token_files(spark, str(tmp_path / "files")).collect()}
    assert whole[7] == ids[7, ODD_TEXTS[7]]
    assert token_files.file_digests(empty, tokenizer_path(), str(tmp_path / "none")).count() == 0


def plain_counts(text):
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\té", max_size=90), min_size=1, max_size=4))
def test_text_counts(texts):
    rows = []
    for chunk in chunks(pa.array(texts, pa.string())):
        c = outliers.text_counts(chunk)
        rows += zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    assert rows == [plain_counts(t) for t in texts]


def test_outliers(spark, odd, empty):
    judged = outliers.judge(odd)
    for r in judged.collect():
        text = ODD_TEXTS[r.doc_id] if r.doc_id is not None else "null id text"
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert judged.count() == odd.count() and {"word"} <= set(judged.columns)
    assert outliers.judge(empty).count() == 0


def test_outlier_estimates_are_robust(spark):
    """A fifth of planted junk does not move the estimate and is rejected, clean rows stay."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        size = int(rng.integers(30, 400))
        text = " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(size))
        rows.append((i, text if i % 5 else text.upper().replace(" ", "!! "), "en", "hot" if i % 3 else None))
    kept = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] == bool(i % 5) for i in range(600))


def test_mcd_against_numpy(spark):
    """The distributed steps find the centre that plain concentration on all rows finds."""
    rng = np.random.default_rng(5)
    p = len(outliers.FEATURES)
    x = np.vstack([rng.normal(0, 1, (400, p)), rng.normal(9, 0.5, (100, p))])
    frame = spark.createDataFrame([("g", row.tolist()) for row in x], "g string, f array<double>")
    found = outliers.estimates(frame).first()
    mean = np.median(x, 0)
    cov = np.eye(p)
    for _ in range(30):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        core = x[np.argsort(d)[: int(outliers.SHARE * len(x))]]
        mean, cov = core.mean(0), np.cov(core.T) + np.diag(np.square(outliers.FLOOR))
    assert np.abs(np.array(found.centre) - mean).max() < 0.1


def test_license_scan(spark, odd, empty):
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(odd).collect()}
    phrases = {tuple(k.split()): v for k, v in licenses.PHRASES.items()}
    for doc_id, text in [(r.doc_id, r.text) for r in odd.collect()]:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(i, v) for p, v in phrases.items() for i in range(len(found)) if tuple(found[i : i + len(p)]) == p]
        r = got[doc_id, len(found)]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({v for _, v in places}))
        blocks = [set(found[i : i + licenses.BLOCK]) for i in range(0, len(found), licenses.STEP)]
        shares = [(len(set(t.split()) & b) / len(set(t.split())), label) for label, t in licenses.TEMPLATES for b in blocks]
        labels = {label for share, label in shares if share >= licenses.THRESHOLD - 1e-9} | {v for _, v in places}
        assert r.labels == ",".join(sorted(labels)), text
    assert licenses.scan(empty).count() == 0


def test_licenses_of_any_length(spark):
    """Templates far longer than a block of short ones are found wherever they stand; all blocks are tried."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(900)]
    templates = [("short", "all rights reserved"), ("at-33", " ".join(vocabulary[:33])), ("whole", " ".join(vocabulary[:90])),
                 ("long", " ".join(vocabulary[100:550])), ("echo", "same words " * 60 + "again")]
    texts = []
    for label, text in templates:
        for before in (0, 31, 65, 500):
            body = [w for w in text.split() if rng.random() < 0.9]
            texts.append(" ".join([f"x{rng.integers(99)}" for _ in range(before)] + body + ["end"] * 40))
    texts += [" ".join(rng.choice(vocabulary, 700)), " ".join(vocabulary[:60]), "", None]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).collect()}
    for i, text in enumerate(texts):
        words, best = (text or "").split(), {}
        for label, template in templates:
            step, wanted = licenses.step_of(template), set(template.split())
            best[label] = max((len(wanted & set(words[k : k + 2 * step])) / len(wanted) for k in range(0, len(words), step)), default=0)
        found = {label for label, share in best.items() if share >= licenses.THRESHOLD - 1e-9}
        assert got[i].labels == ",".join(sorted(found))
        assert got[i].score == max((best[label] for label in found), default=0.0)
    assert "long" in got[15].labels and "whole" in got[9].labels


LANGUAGES = {"aa": "the cat and the dog went to the mat ", "bb": "der hund und die katze auf dem dach ", "cc": "el gato y el perro en la casa "}


def test_language_model_costs_are_a_distribution(spark):
    rows = [(lang, text * 5) for lang, text in LANGUAGES.items()]
    model = ppm.learn(spark.createDataFrame(rows, "lang string, text string"))
    symbols, node_of, bits, width = model.compiled()
    share = np.exp2(-bits.astype(np.float64)).reshape(-1, width, len(model.langs))
    unseen = 256 - len(np.unique(symbols[symbols < width - 1]))
    total = share[:, 1 : width - 1].sum(1) + unseen * share[:, width - 1]
    assert np.abs(total - 1).max() < 1e-3
    # The exact code length of a text, context by context, in plain Python.
    text = b"the dog"
    chunk = next(chunks(pa.array([text.decode()])))
    assert np.allclose(ppm._code_lengths(chunk, (symbols, node_of, bits, width), model.max_order)[0], plain_bits(rows, model, text), rtol=1e-4)


def plain_bits(rows, model, text):
    out = []
    for lang in model.langs:
        counts = {}
        known = Counter()
        for other, t in rows:
            raw = t.encode()
            for i, b in enumerate(raw):
                for k in range(model.max_order + 1):
                    context = tuple(raw[i - d] if i - d >= 0 else None for d in range(1, k + 1))
                    known[context] += 1
                    if other == lang:
                        counts.setdefault(context, Counter())[b] += 1

        def cost(context, b):
            below = (lambda s: cost(context[:-1], s)) if context else (lambda s: 1 / 256)
            if context and known[context] < ppm.MIN_CONTEXT:
                return below(b)
            seen = counts.get(context, Counter())
            n, d = sum(seen.values()), len(seen)
            if seen[b]:
                return seen[b] / (n + d)
            return (d / (n + d) if n else 1.0) * below(b) / max(1 - sum(below(s) for s in seen), 1e-9)

        out.append(-sum(np.log2(cost(tuple(text[i - d] if i - d >= 0 else None for d in range(1, model.max_order + 1)), b)) for i, b in enumerate(text)))
    return out


def test_language_identification(spark, odd, empty):
    rows = [(i, LANGUAGES[lang] * (1 + i % 4), lang) for i, lang in enumerate(list(LANGUAGES) * 60)]
    docs = spark.createDataFrame(rows + [(1000, "1234 !!", "aa"), (1001, None, "bb"), (1002, "dach", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in ppm.identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und", "und", "bb"]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert ppm.identify(empty).count() == 0
    assert ppm.identify(odd).count() == odd.count()


def weighted_similarity(a, b, df, total):
    def vector(text):
        found = words(text)
        grams = Counter(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else Counter()
        return {g: (1 + np.log(n)) * np.log1p(1 / max(df[g] / total, icws.RARE, 1 / total)) for g, n in grams.items()}

    u, v = vector(a), vector(b)
    low = sum(min(w, v.get(g, 0)) for g, w in u.items())
    return low / max(sum(u.values()) + sum(v.values()) - low, 1e-300) if u and v else 0.0


def test_near_duplicates(spark, odd, empty):
    rng = np.random.default_rng(11)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for group in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(6, 120))))
        for copy in range(1 + group % 4):
            changed = list(base)
            for _ in range(copy * len(base) // 80):
                changed[int(rng.integers(len(base)))] = "edit%d" % rng.integers(999)
            texts.append(" ".join(changed))
    texts += texts[:7] + ["", "", None, None, "one two", "one two", "one  two"]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    total = len(texts)
    df = Counter(g for t in texts for g in {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t))
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and (a == b and a is not None or weighted_similarity(a, b, df, total) >= 0.8):
                low, high = sorted((find(i), find(j)))
                label[high] = low
    assert got == {i: find(i) for i, _ in rows}
    assert icws.near_duplicates(empty).count() == 0
    assert icws.near_duplicates(odd).count() == odd.count()


def test_samples_are_consistent_and_unbiased():
    rng = np.random.default_rng(2)
    value = rng.integers(1, 2**62, 400).astype(np.uint64)
    value.sort()
    w, v = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    same = np.mean(icws.samples(np.zeros(400, int), value, w, 600) == icws.samples(np.zeros(400, int), value, v, 600))
    assert abs(same - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.06


PAGE = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>Home</a></nav>{pre}{main}{post}<footer>&copy; site</footer></body></html>"


def page(article, pre="", post="", wrap=True):
    return PAGE.format(pre=pre, main=f"<article><h1>T</h1><p><b>{article}<br>x &amp; y<p>z</article>" if wrap else f"<div><p>{article}</p></div>", post=post)


def test_pages(spark):
    slogan = "<div class='box'>Buy now at our shop</div>"
    rows = [(i, f"http://h{i % 2}.com/en/{i}?q=1", page(f"story {i}", slogan, wrap=i % 3 == 0)) for i in range(12)]
    rows += [(50, None, None), (51, "http://lone.com/a", page("alone", slogan, wrap=False)), (52, "http://h0.com/en/0", ""), (53, "http://h1.com/en/1?q=1", rows[1][2])]
    rows.append(rows[4])
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = page_diff.extract(docs).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for i in range(12):
        assert texts[i] == (f"T story {i} x & y z" if i % 3 == 0 else f"story {i}"), i
    assert texts[50] == texts[52] == "" and texts[53] == texts[1] and texts[51] == "Buy now at our shop alone"
    assert page_diff.extract(docs.limit(0)).count() == 0


def test_page_behind_a_run_of_copies(spark):
    """The only other page of the host lies behind more copies than a page has neighbours."""
    slogan = "<div class='box'>Buy now at our shop</div>"
    rows = [(i, f"http://h.com/en/a{i:02}", page("told again", slogan, f"<nav>{i}</nav>", wrap=False)) for i in range(12)]
    rows.append((20, "http://h.com/en/z", page("another story", slogan, wrap=False)))
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: "told again" for i in range(12)} | {20: "another story"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_lines(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    found = page_diff.common_lines(a, b)
    picked = iter(b)
    assert len(found) == best[n][m] and found == sorted(set(found)) and all(a[i] in picked for i in found)


def test_page_markup():
    lines = page_diff.page_lines(
        "<div id=x>Hi <b>the</b>re &#233;<!-- no --><div class='cookie-notice'>c</div>tail<p>a<p>b<ul><li>1<li>2</ul><form>f<input></form>"
        "<div class='has-sidebar'><article><header><h1>T</h1></header>x<section class=comments>zz</section></article></div>"
    )
    assert [t for t, cut, _ in lines if not cut] == ["Hi there é", "tail", "a", "b", "1", "2", "T", "x"]
    assert [t for t, _, main in lines if main] == ["T", "x", "zz"]


def _colliding_words():
    """Two different words of 1,024 letters that any polynomial hash modulo 2**64 maps to one value."""
    sign = [0]
    for _ in range(10):
        sign += [1 - s for s in sign]
    return "".join("ab"[s] for s in sign), "".join("ba"[s] for s in sign)


def test_words_that_share_a_hash(spark, library):
    x, y = _colliding_words()
    chunk = next(chunks(pa.array([f"{x} {y}"])))
    start, end, _ = chunk.words()
    assert len(set(chunk.hasher()(start, end))) == 1
    texts = [f"{x} {y} {x} {y}", f"{y} end {x}", f"{x}\n{y}\n{x}", f"{y} {x} " + " ".join([*"abcdef", x, *"abcdef", y])]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1)
    for row in bpe.digests(docs, tokenizer_path()).collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    for row in token_files.file_digests(docs, tokenizer_path()).collect():
        ids = np.array([*library.encode(texts[row.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert row.ids_crc32 == zlib.crc32(ids.tobytes())
    counts = {r.doc_id: r for r in outliers.document_counts(docs).collect()}
    assert [counts[i].n_dup_lines for i in range(4)] == [0, 0, 1, 0]
    assert [counts[i].n_repeat_words for i in range(4)] == [0, 0, 0, 0]


def test_long_words_and_texts_above_a_chunk(spark, library):
    import random
    import time

    rng = random.Random(3)
    letters = "".join(rng.choice("etaoinshr") for _ in range(1 << 20))
    for word in ("ab" * 40_000, "a" * 70_000 + "b", letters[:200_000], letters):
        began = time.time()
        own = [int(i) for chunk in chunks(pa.array([word])) for i in bpe._vocabulary(bpe._read(tokenizer_path())).encode_chunk(chunk)[0]]
        assert own == library.encode(word, add_special_tokens=False).ids
        assert time.time() - began < 60
    text = " ".join(letters[i : i + 5] for i in range(0, len(letters), 5)) + "\nsame line\nsame line"
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, "short", "en", "s")], "doc_id long, text string, lang string, source string")
    ids = library.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: r for r in bpe.digests(docs, tokenizer_path()).collect()}
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    counts = {r.doc_id: r for r in outliers.document_counts(docs).collect()}
    assert counts[1].n_words == len(words(text)) and counts[1].n_dup_lines == 1


def test_common_lines_of_long_pages():
    import time

    began = time.time()
    assert len(page_diff.common_lines([5] * 20_000, [7, *[5] * 19_000, 8])) == 19_000
    assert len(page_diff.common_lines([*[5] * 20_000, 1, *[5] * 500], [2, *[5] * 20_000, 3])) == 20_000
    assert time.time() - began < 10


def test_rare_shingles_are_counted_too(spark):
    rows = [(f"common words stand in every text here and then w{i} x{i} y{i} z{i} v{i}" + (" a b c d e" if i % 50 == 0 else ""),) for i in range(400)]
    hashes, df, total = icws.frequent_shingles(spark.createDataFrame(rows, "text string").repartition(3))
    assert total == 400 and sorted(df.tolist())[0] == 8 and df.max() == 400


def test_only_full_buckets_of_shingles_are_counted_one_by_one(spark):
    """Rows of 2,000 texts reach no grouping unless their bucket holds enough places for the bound."""
    rows = [(i, " ".join(f"w{(i * k * k) % (3 + k % 11)}" for k in range(40 + i % 7)) + f" a{i} b{i} c{i} d{i} e{i}") for i in range(2000)]
    docs = spark.createDataFrame([*rows, (-1, None), (-2, "")], "doc_id long, text string").repartition(5)
    full = icws._full_buckets(docs, 100)
    hashes, df, total = icws.frequent_shingles(docs, 100 / 2002)
    grams = Counter()
    for _, text in rows:
        words = text.split()
        grams.update({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    assert total == 2002 and sorted(df.tolist()) == sorted(n for n in grams.values() if n >= 100)
    assert full[(hashes >> icws.BUCKET_SHIFT).astype(int)].all() and len(hashes) // 2 < full.sum() < len(grams) // 10


def test_marked_pages_are_compared_too(spark):
    page = "<body><p>site line</p><article><p>text {}</p><p>shared note</p></article></body>"
    rows = [(i, f"http://h.example/a/{i}", page.format(i)) for i in range(4)]
    got = {r.page_id: r for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"text {i} shared note" and got[i].n_shared == 2 for i in range(4))


def test_page_texts_are_not_stored(spark, monkeypatch):
    """No written table holds the texts; the result keeps odd characters, copies, null and unmarked pages."""
    written = []
    keep = page_diff.materialize
    monkeypatch.setattr(page_diff, "materialize", lambda df, *a: written.append(df.schema) or keep(df, *a))
    page = "<body><p>menu line</p><article><p>a\U0001f600 &lt;&quot;{}&#9;x</p></article></body>"
    rows = [(i, f"http://h.example/a/{i}", page.format(i)) for i in range(4)] + [(3, "http://h.example/a/3", page.format(3))]
    rows += [(10 + i, f"http://u.example/b/{i}", f"<body><p>every page says</p><p>only {i}</p></body>") for i in range(3)] + [(20, None, None)]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    expected = [(i, f'a\U0001f600 <"{i} x') for i in (0, 1, 2, 3, 3)] + [(10 + i, f"only {i}") for i in range(3)] + [(20, "")]
    assert sorted((r.page_id, r.text) for r in got) == expected
    assert all(r.n_chars == len(r.text) for r in got)
    assert written and not any({"text", "lines", "html", "packed"} & set(schema.names) for schema in written)
