"""Alignment of two tokenizers against the libraries and a plain walk over the bytes."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from graphloom.llm import bpe, token_align
from graphloom.llm.queries import tokenizer_path

B_PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", " \n", "a", "Hello  world\n\nfoo bar ", " lead", "tab\ta\x00b", "x▁y", "<s> hi </s> <|endoftext|>", "it's we'll don't",
    "thnd 日本 😀 Ａ ﬁ ½", "def f(x):\n    return x  # no\n", "a" * 500, "日本語の文章です。" * 20, "word " * 300, "\n\n\n   \n x", "é́ combining", "  line", "<0x41> \r\n",
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_PATH)


def plain(text, libraries):
    """(A ids, B ids, groups, links) of a text; None where it has no tokens."""
    if not text:
        return None
    a_model, b_model = libraries
    own = (" " + text).encode()
    symbols = {c: i for i, c in enumerate(bpe.byte_symbols())}
    a = a_model.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(symbols[c] for c in a_model.id_to_token(i)) for i in a]
    b = b_model.encode(text)
    b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_model.id_to_piece, b))]
    if b"".join(a_bytes) != own or b"".join(b_bytes) != own:
        return None
    a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    groups, i, j = [], 0, 0
    a_place, b_place = ({end: k + 1 for k, end in enumerate(ends)} for ends in (a_end, b_end))
    for cut in sorted(set(a_end) & set(b_end)):
        k, m = a_place[cut], b_place[cut]
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    at_a = [i for i, x in enumerate(a_bytes) for _ in x]
    at_b = [i for i, x in enumerate(b_bytes) for _ in x]
    return a, b, groups, [(a[i], b[j]) for i, j in dict.fromkeys(zip(at_a, at_b))]


def plain_rows(texts, libraries):
    found = {i: plain(t, libraries) for i, t in texts.items()}
    count = Counter(link for f in found.values() if f for link in f[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    rows = {}
    for i, f in found.items():
        if not f:
            rows[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows[i] = (len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest())
    return rows


def answers(frame):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r.doc_id: tuple(r[c] for c in names) for r in frame.collect()}


@pytest.mark.parametrize("frequent", [0, 7, token_align.FREQUENT])
def test_alignment_equals_plain_walk(spark, libraries, frequent):
    texts = dict(enumerate(TEXTS)) | {len(TEXTS) + i: t for i, t in enumerate(TEXTS[7:14])}
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in texts.items()], "doc_id long, text string, row int, links string")
    assert answers(token_align.alignment(docs, tokenizer_path(), B_PATH, frequent)) == plain_rows(texts, libraries)


def test_given_documents_and_long_text(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    long = " ".join(r.text for r in docs.limit(60).collect()) * 10
    docs = docs.unionByName(spark.createDataFrame([(-1, long)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(long) > 1 << 20
    assert answers(token_align.alignment(docs, tokenizer_path(), B_PATH)) == plain_rows(texts, libraries)


def test_empty_table_and_groups(spark, libraries):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.alignment(nothing, tokenizer_path(), B_PATH).count() == 0
    row = token_align.align(spark.createDataFrame([(None, "Hello world")], "doc_id long, text string"), tokenizer_path(), B_PATH, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(0, 10**6))
def test_shared_cuts_are_all_found(sizes, seed):
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    a_end = np.cumsum(sizes)
    inner = np.arange(1, total)
    b_end = np.append(inner[rng.random(len(inner)) < rng.random()], total)
    groups = token_align.shared_cuts(a_end, b_end, np.array([[0], [len(a_end)], [0], [len(b_end)]]))
    assert a_end[groups[1] - 1].tolist() == sorted(set(a_end.tolist()) & set(b_end.tolist()))
    assert (a_end[groups[1] - 1] == b_end[groups[3] - 1]).all()
    assert groups[0].tolist() == [0, *groups[1][:-1].tolist()] and groups[2].tolist() == [0, *groups[3][:-1].tolist()]
