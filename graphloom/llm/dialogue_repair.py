"""Conversation structure repair by prefix-doubling path ranking (operator 13).

A conversation is repaired by edits of its rows: Keep (0), Rerole to user or assistant (1), Delete
(2, required for blank and duplicate rows), Insert an empty user or assistant turn anywhere (5);
a truncated row that stays adds 5. The role initials left must read ``(s?(ua)+)?``. Among the
cheapest edits the audit, their initials in order, is the least in ASCII order (D < I < K < R).

Which initials may follow is an automaton of four states, so a row is a 4 x 4 matrix of costs in
the (min, +) algebra. Suffix products by doubling give the cost from every (row, state) to the end.
The arcs that keep to that cost are the nodes of a graph: each is ranked by its letter, then by its
first 2, 4, 8, ... letters, where the second half is the rank at a pointer that doubles with the
length. The least rank among the arcs of a state selects the path; the arcs of one state have
different letters, so the doubled pointer leads to one node. Letters are read off by pointer jumps.

Rows are cut into blocks of ``BLOCK`` by their place in the order of all conversations, whatever
conversation they belong to, so a conversation of any length is spread over tasks. Pieces of a
conversation that spans blocks meet only as one matrix and one state map per piece. Only the last
step, one digest over a conversation's text, follows it row by row, as a digest is sequential; it
streams and holds no more than the audit.

Rows of a conversation are taken by turn (nulls first), then role and text. Faults, first one
counts: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate (role and text of an earlier row),
truncated (last other character not one of ``.!?``). Null role and text count as one space; rows
without conv_id form a conversation of their own. Extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.ordering import gathered, overlapping_blocks, ranked, runs
from graphloom.session import materialize

BLOCK = 8192
SPACES = " \t\n\x0b\x0c\r"
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
RETELL, REMOVE, ADD, CUT = 1, 2, 5, 5
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
NEXT = np.array([2, 2, 3, 2])
#: State after keeping a row with initial s, u, a or another one (-1: not allowed).
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
FINAL = np.array([0, 2 * ADD, ADD, 0], np.int64)
NEVER = np.int64(1) << 40
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
ROLES = {"u": "user", "a": "assistant"}

_INSERTS = np.full((4, 4), NEVER)
_INSERTS[range(4), range(4)] = 0
_INSERTS[range(4), NEXT] = ADD
_INSERTS[[0, 1, 3], 3] = np.minimum(_INSERTS[[0, 1, 3], 3], 2 * ADD)


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with planted damage by crc32(``conv_id:turn``) % 20 (nulls: one space): 0
    drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), harm.alias("harm")).filter("harm <> 0")
    return hurt.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


# ---- faults ---------------------------------------------------------------------------------------

def placed_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rank): all rows in order, numbered from 0."""
    plain = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text")
    )
    return ranked(plain, "conv_id", "turn", "role", "text")


def faults(placed: DataFrame) -> DataFrame:
    """(rank, conv_id, initial, fault): the narrow rows that all steps but the last work on.

    Equal rows meet by a cryptographic digest in a pre-aggregated grouping; the first one's place
    is joined back by place, so a text that a third of all rows repeat makes no hot key.
    """
    solid = F.rtrim("text", F.lit(SPACES))
    marks = placed.select(
        "rank", "conv_id", F.substring("role", 1, 1).alias("initial"),
        F.when(solid == "", BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN).alias("own"),
        F.sha2(F.concat_ws("", F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )
    first = marks.groupBy("conv_id", "digest").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("first"))
    fault = F.when((F.col("own") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("own"))
    return materialize(marks.join(first, "rank", "left").select("rank", "conv_id", "initial", fault.cast("int").alias("fault")))


# ---- costs and paths of one block -----------------------------------------------------------------

def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product of stacked matrices."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), NEVER)


class Block:
    """Consecutive rows, cut into pieces of one conversation each."""

    def __init__(self, table: pa.Table):
        codes = table.column("conv_id").combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        host = table.column("host").to_numpy()
        own = np.flatnonzero(host)
        self.table = table.slice(own[0], len(own)) if len(own) else table.slice(0, 0)
        self.n = n = len(own)
        if not n:
            return
        begin, end = own[0], own[-1] + 1
        code = codes[begin:end]
        self.first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.last = np.append(self.first[1:], n) - 1
        self.pieces = len(self.first)
        self.opens, self.closes = np.ones(self.pieces, bool), np.ones(self.pieces, bool)
        if begin and codes[begin - 1] == code[0]:
            self.opens[0] = False
        if end < len(codes) and codes[end] == code[-1]:
            self.closes[-1] = False
        self.piece = np.repeat(np.arange(self.pieces), self.last - self.first + 1)
        initial = {"s": 0, "u": 1, "a": 2}
        kind = np.array([initial.get(x, 3) for x in self.table.column("initial").to_pylist()])
        fault = self.table.column("fault").to_numpy()
        self.stays = (fault == CLEAN) | (fault == TRUNCATED)
        self.extra = np.where(fault == TRUNCATED, CUT, 0).astype(np.int64)
        self.kept = KEPT[kind]
        step = np.full((n, 4, 4), NEVER)
        step[:, range(4), range(4)] = REMOVE
        at = np.flatnonzero(self.stays)
        for state in range(4):
            step[at, state, NEXT[state]] = np.minimum(step[at, state, NEXT[state]], RETELL + self.extra[at])
            go = at[self.kept[at, state] >= 0]
            target = self.kept[go, state]
            step[go, state, target] = np.minimum(step[go, state, target], self.extra[go])
        self.suffix = self._suffixes(_product(_INSERTS, step))

    def _suffixes(self, matrix: np.ndarray) -> np.ndarray:
        """Product of every row's matrix with those behind it in its piece, by doubling."""
        reach, end = 1, self.last[self.piece]
        place = np.arange(self.n)
        while reach < (self.last - self.first + 1).max():
            more = np.flatnonzero(place + reach <= end)
            joined = matrix.copy()
            joined[more] = _product(matrix[more], matrix[more + reach])
            matrix, reach = joined, 2 * reach
        return matrix

    def paths(self, exits: np.ndarray) -> None:
        """Rank the optimal arcs and read off the least path of every piece and entry state; ``exits``
        has the cost from each state behind each piece to the conversation's end."""
        n, pieces = self.n, self.pieces
        at, end = np.arange(n) + self.piece, self.last + np.arange(pieces) + 1
        size = n + pieces
        cost = np.empty((size, 4), np.int64)
        cost[end] = exits
        cost[at] = (self.suffix + exits[self.piece][:, None, :]).min(2)
        # Optimal arcs (from, letter, to); a state's place is 4 * position + state.
        starts, letters, heads = [], [], []

        def add(letter, position, state, target, price):
            tight = cost[position, state] == price
            starts.append(4 * position[tight] + state)
            letters.append(np.full(int(tight.sum()), letter))
            heads.append(target[tight])

        closing = end[self.closes]
        for state in range(4):
            add(1, at, state, 4 * (at + 1) + state, REMOVE + cost[at + 1, state])
            for positions in (at, closing):
                add(2, positions, state, 4 * positions + NEXT[state], ADD + cost[positions, NEXT[state]])
            rows = np.flatnonzero(self.stays & (self.kept[:, state] >= 0))
            target = self.kept[rows, state]
            add(3, at[rows], state, 4 * (at[rows] + 1) + target, self.extra[rows] + cost[at[rows] + 1, target])
            rows = np.flatnonzero(self.stays)
            add(4, at[rows], state, 4 * (at[rows] + 1) + NEXT[state], RETELL + self.extra[rows] + cost[at[rows] + 1, NEXT[state]])
        start, letter, head = (np.concatenate(x) for x in (starts, letters, heads))
        order = np.lexsort((letter, start))
        start, letter, head = start[order], letter[order], head[order]
        stop = len(start)  # the empty audit: a node that follows itself
        least = np.full(4 * size, stop)
        least[start[::-1]] = np.arange(stop)[::-1]
        pointers = [np.append(least[head], stop)]
        rank, length = np.append(letter, 0), np.append(np.ones(stop, np.int64), 0)
        while (pointers[-1] != stop).any():
            jump = pointers[-1]
            _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
            length = length + length[jump]
            pointers.append(jump[jump])
        # The least rank of the arcs that leave an entry state selects its path.
        best = np.lexsort((rank[:stop], start))
        chosen = np.full(4 * size, stop)
        chosen[start[best][::-1]] = best[::-1]
        self.entries = np.where(self.opens, 1, 4)
        self.path_piece = np.repeat(np.arange(pieces), self.entries)
        self.base = np.cumsum(self.entries) - self.entries
        entry = np.arange(len(self.path_piece)) - self.base[self.path_piece]
        origin = chosen[4 * at[self.first[self.path_piece]] + entry]
        count = length[origin]
        path = np.repeat(np.arange(len(origin)), count)
        step = np.arange(len(path)) - np.repeat(np.cumsum(count) - count, count)
        arc = origin[path]
        for k, jump in enumerate(pointers):
            on = (step >> k & 1).astype(bool)
            arc[on] = jump[arc[on]]
        self.exit_state = head[arc[np.cumsum(count) - 1]] % 4
        # Letters of one path and position are one text; each path has its piece's rows and the end.
        places = self.last[self.path_piece] - self.first[self.path_piece] + 2
        self.text_base = np.cumsum(places) - places
        slot = self.text_base[path] + start[arc] // 4 - at[self.first[self.path_piece]][path]
        offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=int(places.sum())))]).astype(np.int32))
        turned = np.isin(letter[arc], (2, 4))
        told = np.where(turned, np.where(head[arc] % 4 == 2, ord("u"), ord("a")), ord("-")).astype(np.uint8)
        text = lambda data: pa.StringArray.from_buffers(int(places.sum()), offsets, pa.py_buffer(np.ascontiguousarray(data)))
        self.audits, self.told = text(LETTERS[letter[arc]]), text(told)

    def lists(self, values: pa.Array, at_end: bool) -> pa.Array:
        """Per row the texts of all entry states (``at_end``: of the piece's end, on its last row)."""
        sizes = self.entries[self.piece]
        row = np.repeat(np.arange(self.n), sizes)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = row - self.first[self.piece[row]]
        index = self.text_base[self.base[self.piece[row]] + entry] + place + int(at_end)
        texts = values.take(pa.array(index))
        if at_end:
            inner = row != self.last[self.piece[row]]
            texts = pa.compute.if_else(pa.array(inner), pa.scalar(""), texts)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), texts)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    return gathered(overlapping_blocks(rows, block, 1, before=True), ["block"], ["rank"])


def _open_pieces(batches):
    """(conv_id, at, matrix) of the pieces whose conversation goes on in another block."""
    for table in runs(batches, ["block"]):
        block = Block(table)
        if not block.n:
            continue
        open_ = np.flatnonzero(~(block.opens & block.closes))
        first = pa.array(block.first[open_])
        matrices = block.suffix[block.first[open_]].reshape(-1, 16)
        yield pa.RecordBatch.from_arrays(
            [block.table.column("conv_id").combine_chunks().take(first), block.table.column("rank").combine_chunks().take(first),
             pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(open_) + 1, 16, dtype=np.int32)), pa.array(matrices.ravel()))],
            ["conv_id", "at", "matrix"],
        )


def _exit_costs(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("at")
    after, exits = FINAL, []
    for matrix in pieces["matrix"].iloc[::-1]:
        exits.append(after)
        after = (np.array(matrix, np.int64).reshape(4, 4) + after).min(1)
    return pd.DataFrame({"rank": pieces["at"], "exit": exits[::-1]})


def _block_edits(batches):
    for table in runs(batches, ["block"]):
        block = Block(table)
        if not block.n:
            continue
        given = block.table.column("exit").to_pylist()
        exits = np.array([FINAL if given[i] is None else given[i] for i in block.first], np.int64)
        block.paths(exits)
        spans = ~(block.opens & block.closes)
        leads: list = [None] * block.n
        for piece in np.flatnonzero(spans):
            base = block.base[piece]
            leads[block.first[piece]] = block.exit_state[base : base + block.entries[piece]].tolist()
        at = block.table.column("rank").to_numpy()[block.first][block.piece]
        yield pa.RecordBatch.from_arrays(
            [*(block.table.column(c).combine_chunks() for c in ("rank", "conv_id", "fault")), pa.array(at, mask=~spans[block.piece]), pa.array(leads, pa.list_(pa.int64())),
             block.lists(block.audits, False), block.lists(block.told, False), block.lists(block.audits, True), block.lists(block.told, True)],
            ["rank", "conv_id", "fault", "at", "leads", "edit", "told", "tail", "tail_told"],
        )


def _entry_states(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("at")
    state, entries = 0, []
    for lead in pieces["leads"]:
        entries.append(state if len(lead) == 4 else 0)
        state = int(lead[state if len(lead) == 4 else 0])
    return pd.DataFrame({"at": pieces["at"], "entry": entries})


def edits(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rank, conv_id, fault, edit, told, tail, tail_told) of every row: the letters of its edits, with
    inserts before it, and per letter the role it gives (u, a, or - for none); ``tail`` holds the
    inserts behind a conversation's last row."""
    kind = marks.schema["conv_id"].dataType.simpleString()
    pieces = _blocks(marks, block).mapInArrow(_open_pieces, f"conv_id {kind}, at long, matrix array<long>")
    exits = materialize(pieces.groupBy("conv_id").applyInPandas(_exit_costs, "rank long, exit array<long>"))
    found = materialize(_blocks(marks.join(exits, "rank", "left"), block).mapInArrow(
        _block_edits,
        f"rank long, conv_id {kind}, fault int, at long, leads array<long>, edit array<string>, told array<string>, tail array<string>, tail_told array<string>",
    ))
    entries = found.filter("leads is not null").select("conv_id", "at", "leads").groupBy("conv_id").applyInPandas(_entry_states, "at long, entry int")
    chosen: Column = F.coalesce("entry", F.lit(0))
    return found.join(entries, "at", "left").select(
        "rank", "conv_id", "fault", *[F.get(c, chosen).alias(c) for c in ("edit", "told", "tail", "tail_told")]
    )


# ---- results --------------------------------------------------------------------------------------

def _stream(placed: DataFrame, edited: DataFrame, conversations: DataFrame) -> DataFrame:
    """Edits and texts of a conversation one after another; only this shuffle moves the texts."""
    parts = [
        conversations.select("conv_id", F.lit(-1).alias("rank"), F.lit(0).alias("kind")).distinct(),
        edited.select("conv_id", "rank", F.lit(1).alias("kind"), "fault", "edit", "told", "tail", "tail_told"),
        placed.select("conv_id", "rank", F.lit(2).alias("kind"), "turn", "role", "text"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return gathered(rows, ["conv_id"], ["rank", "kind"])


def _turns(edit: dict, role: str, text: str):
    """The turns that stand for one row after its edits."""
    for letter, told in zip(edit["edit"] + edit["tail"], edit["told"] + edit["tail_told"]):
        if letter == "I":
            yield ROLES[told], ""
        elif letter != "D":
            yield (role if letter == "K" else ROLES[told]), text


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: (conv_id, rank, part, role, text) in the order of rank and part."""
    placed = placed_rows(rows)

    def run(batches):
        edit = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    edit = row
                elif row["kind"] == 2:
                    out += [(row["conv_id"], row["rank"], i, *turn) for i, turn in enumerate(_turns(edit, row["role"], row["text"]))]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "rank", "part", "role", "text"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    edited = edits(faults(placed), block)
    return _stream(placed, edited, rows.limit(0)).mapInArrow(run, f"conv_id {kind}, rank long, part long, role string, text string")


class _Summary:
    def __init__(self, conv_id):
        self.conv_id, self.faults, self.illegal, self.cost = conv_id, [0, 0, 0, 0], 0, 0
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.kept = 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def add(self, edit: dict, turn, role: str, text: str) -> None:
        self.faults[edit["fault"]] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        letters = edit["edit"] + edit["tail"]
        self.audit.append(letters)
        stays = letters.count("K") + letters.count("R") > 0
        self.cost += REMOVE * letters.count("D") + ADD * letters.count("I") + RETELL * letters.count("R")
        self.cost += CUT * (stays and edit["fault"] == TRUNCATED)
        for named, said in _turns(edit, role, text):
            self.digest.update(("\n" * (self.kept > 0) + f"{named}:{said}").encode("utf-8", "surrogatepass"))
            self.kept += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``conversations`` or ``rows``: gaps in the turns, faults, illegal
    neighbours, the least cost, the audit and a digest of the repaired ``role:text`` lines.

    A conversation without rows has zeros, an empty audit and the digest of an empty text.
    """
    placed = placed_rows(rows)

    def run(batches):
        now, edit, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now:
                        done.append(now.row())
                    now = _Summary(row["conv_id"])
                if row["kind"] == 1:
                    edit = row
                elif row["kind"] == 2:
                    now.add(edit, row["turn"], row["role"], row["text"])
            yield table(done, kind)
        if now:
            yield table([now.row()], kind)

    def table(done, kind):
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = list(zip(*done)) if done else [[]] * len(SUMMARY)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(SUMMARY))

    fields = [f"conv_id {rows.schema['conv_id'].dataType.simpleString()}", *[f"{c} long" for c in SUMMARY[1:7]], "audit string", "repaired_sha256 string"]
    edited = edits(faults(placed), block)
    return _stream(placed, edited, conversations).mapInArrow(run, ", ".join(fields))
