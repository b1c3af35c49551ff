"""Conversation repair against a memoised search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from graphloom.llm import dialogue_repair as dr

SOLID = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(key.encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        out += [] if harm == 0 else [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def plain_repair(rows, ids):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {i: plain_one(groups[i]) for i in ids | set(groups)}


def plain_one(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        kinds.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserts=0):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 2:
            for role in ("user", "assistant"):
                if (to := step(state, role[0])):
                    cost, audit, out = best(i, to, inserts + 1)
                    options.append((cost + 5, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, state)
            options.append((cost + 2, "D" + audit, out))
            if kinds[i] not in (1, 2):
                for letter, price, named in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (to := step(state, named[:1])):
                        cost, audit, out = best(i + 1, to)
                        options.append((cost + price + 5 * (kinds[i] == 3), letter + audit, ((named, text), *out)))
        return min(options) if options else (10**9, "", ())

    cost, audit, out = best(0, "")
    said = "\n".join(f"{r}:{t}" for r, t in out)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, kinds.count(1), kinds.count(2), kinds.count(3), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest + 1)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "usher"])
            text = rng.choice(["Fine.", "Fine.", "cut off", "", " \t\n", "Why?", "é…", "ok! ", "same", None, f"turn {turn}.", f"t{turn}"])
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn + rng.randrange(3), role, text))
    return rows


def answers(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


@pytest.mark.parametrize("block", [1, 3, 7, dr.BLOCK])
def test_repair_equals_search(spark, block):
    rows = random_rows(block, 40, 14)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = answers(dr.repair(frame, frame, block))
    assert got == plain_repair(rows, {r[0] for r in rows})


def test_damage_and_whole_conversations(spark):
    rows = random_rows(99, 150, 9) + [(7, None, "user", "Twice."), (7, None, "user", "Twice."), (1007, 0, "user", "Dropped.")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", rank string, edit long")
    hurt = dr.damaged(frame)
    assert sorted(map(repr, (tuple(r) for r in hurt.collect()))) == sorted(map(repr, plain_damage(rows)))
    got = answers(dr.repair(hurt, frame))
    assert got == plain_repair(plain_damage(rows), {r[0] for r in rows})
    assert got[1007] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation_spans_blocks(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"n{i}."])) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20000)
    expected = plain_repair(rows, {1})
    sys.setrecursionlimit(limit)
    assert answers(dr.repair(frame, frame, 64)) == expected


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi?"), (2, 0, "assistant", "x" * 3_000_000 + ".")]
    frame = spark.createDataFrame(rows, SCHEMA)
    turns = [tuple(r) for r in dr.repaired_turns(frame).orderBy("rank", "part").select("conv_id", "role", "text").collect()]
    by_id = answers(dr.repair(frame, frame))
    for conv in (1, 2):
        said = "\n".join(f"{r}:{t}" for c, r, t in turns if c == conv)
        assert by_id[conv][-1] == hashlib.sha256(said.encode()).hexdigest()
    assert by_id == plain_repair(rows, {1, 2})
    nothing = spark.createDataFrame([], SCHEMA)
    assert dr.repair(nothing, nothing).count() == 0
    assert dr.repair(nothing, frame).count() == 2
