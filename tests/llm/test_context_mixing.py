"""Context-tree weighting against a plain recursion over the whole tree."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm import context_mixing as cm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "Hello hello world.", None, "", " \n", "the cat sat on the mat. the cat sat.", "éa É ÀÀ", "The Dog sat on THE mat", "x" * 50, "zzz unseen qq",
    "a b c a b c", "同じ 文 同じ", "tab\tand\x0bmore", "the cat sat on the mat. the cat sat.",
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain(texts, depth):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    nodes = defaultdict(lambda: [0, 0])

    def decisions(text):
        symbols = [*text.encode(), 255]
        for i, s in enumerate(symbols):
            context = tuple(symbols[i - k] if i >= k else None for k in range(1, depth + 1))
            for k in range(8):
                yield context, (1 << k) + (s >> (8 - k)), s >> (7 - k) & 1

    for i, text in texts.items():
        if not held[i]:
            for context, prefix, bit in decisions(lower(text)):
                for d in range(depth + 1):
                    nodes[context[:d], prefix][bit] += 1
    children = defaultdict(list)
    for context, prefix in nodes:
        if context:
            children[context[:-1], prefix].append((context, prefix))

    def own(node):
        a, b = nodes.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}
    for node in sorted(nodes, key=lambda n: -len(n[0])):
        if len(node[0]) == depth:
            weighted[node] = own(node)
        else:
            x, y = own(node), sum(weighted[c] for c in children[node])
            weighted[node] = max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)

    def one(context, prefix, d):
        node = (context[:d], prefix)
        a, b = nodes.get(node, (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        share = math.exp(own(node) - math.log(2) - weighted.get(node, 0.0))
        return share * estimate + (1 - share) * one(context, prefix, d + 1)

    counts = Counter(w for i, t in texts.items() if not held[i] for w in WORD.findall(lower(t)))
    ends = sum(not h for h in held.values())
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    rows = {}
    for i, text in texts.items():
        score = sum(math.log10(p if bit else 1 - p) for c, prefix, bit in decisions(lower(text)) for p in [one(c, prefix, 0)])
        own_words = WORD.findall(lower(text))
        c = [counts[w] for w in own_words] + [ends]
        rows[i] = (held[i], len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c), score)
    return rows


def check(got, expected):
    assert got.keys() == expected.keys()
    for i, row in expected.items():
        assert got[i][:4] == row[:4]
        assert got[i][4:] == pytest.approx(row[4:], rel=1e-9, abs=1e-9)


def answers(frame):
    return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in frame.collect()}


@pytest.mark.parametrize("depth, frequent", [(0, 5), (2, 1), (4, 7), (4, cm.FREQUENT)])
def test_score_equals_plain_tree(spark, depth, frequent):
    texts = dict(enumerate(TEXTS))
    assert any(zlib.crc32(str(i).encode()) % 7 == 2 for i in texts)
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in texts.items()], "doc_id long, text string, word string, row int")
    check(answers(cm.score(docs, depth=depth, frequent=frequent)), plain(texts, depth))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(answers(cm.score(docs, frequent=500)), plain(texts, cm.DEPTH))


def test_null_ids_repeats_empty_and_long(spark):
    schema = "doc_id long, text string"
    assert cm.score(spark.createDataFrame([], schema)).count() == 0
    rows = cm.score(spark.createDataFrame([(None, "some text"), (None, "some text"), (5, "some " * 700_000)], schema)).collect()
    assert len(rows) == 3 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows} == {3, 700_001}
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = cm.score(spark.createDataFrame([(only_held, "ab")], schema)).first()
    assert row.bits_per_byte == pytest.approx(8.0) and row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0.0
