"""Repair of damaged conversations: the cheapest edits to a legal order of roles, the least audit among equals.

A conversation is legal if its role initials read ``(s?(ua)+)?``.  Rows are kept, given another role, or deleted, and
empty rows are inserted; the audit is the string of the edits' initials.

1. Rows are sorted over all tasks by conversation and turn and cut into blocks of at most ``BLOCK_ROWS`` rows.
2. Cost DP: a node is a place between rows and a state of the automaton.  A block is a 4 x 4 matrix of least costs between
   the states at its ends; conversations of several blocks combine those from the end, so every block knows what
   the rest costs from each state.
3. Path ranking by prefix doubling: optimal arcs are ranked by their edit, then by the first 2, 4, 8, ... edits from them
   on, out of the ranks of an arc and of the arc its pointer reaches, and the pointers double along.  (The arcs of a
   node have different edits, so the least arc behind an arc is known from the start.)  Ranks choose the arc to
   begin with, doubled pointers read the least path off.
4. One ordered pass per conversation strings blocks together; it keeps a hash state and the audit, no rows.
   (A SHA-256 over a whole conversation is sequential by its nature.)
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import land

BLOCK_ROWS = 4096
# Rows whose arcs are ranked at a time.
ROWS_AT_ONCE = 50_000
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
NULL = " "
DAMAGES = 20
DROP, EMPTY, NO_ENDS, REPEAT, TO_USER = range(5)
LEGAL = {"su", "ua", "au"}

# States: nothing yet, after a system row, after a user row, after an assistant row.
N_STATES = 4
START, ENDS = 0, (0, 3)
_FAR = 1 << 50
# The state after a row with initial s, u, a, or none if it may not follow.
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
# The role that may be inserted, or given to a row, in each state, and the state after it.
_NEXT = ("u", "u", "a", "u")
_TO = tuple(_AFTER[role][state] for state, role in enumerate(_NEXT))
_ROLES = {"u": "user", "a": "assistant"}
# Edits in the order of their initials.
_EDITS = "DIKR"


def damaged(rows: DataFrame) -> DataFrame:
    """key, turn, role, text after damage (nulls as one space; a null turn stays null), and ``copy``, 1 for a repeat."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL))
    kind = F.crc32(F.concat(key, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(NULL))).cast("binary")) % DAMAGES
    text = F.coalesce(F.col("text").cast("string"), F.lit(NULL))
    text = F.when(F.col("_kind") == EMPTY, "").when(F.col("_kind") == NO_ENDS, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_kind") == TO_USER, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(NULL)))
    copies = F.when(F.col("_kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).where(F.col("_kind") != DROP) \
        .select(key.alias("key"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


_FACES = "key string, kind int, part int, block int, at int, turn bigint, role string, text string, codes binary, figures array<bigint>, ends array<string>"
# What a block's figures are.
BLANK, DUPLICATE, TRUNCATED, ILLEGAL, TURNS, FIRST_TURN, LAST_TURN = range(7)
_NO_TURN = -(1 << 63)


def _cut(block_rows: int):
    """Sorted rows with their block and place, and one row of codes and figures per block.

    A code is the number of the role's initial in "sua" (3 if none), plus 4 for a row to delete, plus 8 for a truncated one.
    """
    def run(batches):
        part = TaskContext.get().partitionId()
        key = None
        block = -1
        codes: bytearray = bytearray()
        figures: list[int] = []
        ends: list[str] = []
        before: tuple | None = None

        def closed():
            return {"key": key, "kind": 0, "part": part, "block": block, "codes": bytes(codes), "figures": list(figures), "ends": list(ends)}

        for batch in batches:
            n = batch.num_rows
            column = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name not in ("role", "text")}
            blocks, places, done = [], [], []
            for k, turn, tie, initial, blank, again, cut in zip(*(column[c] for c in ("key", "turn", "tie", "initial", "blank", "again", "cut"))):
                if k != key or len(codes) == block_rows:
                    if codes:
                        done.append(closed())
                    block = block + 1 if k == key else 0
                    before = before if k == key else None
                    key, codes, figures, ends = k, bytearray(), [0, 0, 0, 0, 0, _NO_TURN, _NO_TURN], [initial, initial]
                elif ends[1] + initial not in LEGAL:
                    figures[ILLEGAL] += 1
                # Rows equal in turn and tie lie side by side; the first of them may be the first of its kind.
                duplicate = again or before == (turn, tie)
                before = (turn, tie)
                code = "sua".find(initial) if initial in ("s", "u", "a") else 3
                if blank:
                    figures[BLANK] += 1
                elif duplicate:
                    figures[DUPLICATE] += 1
                elif cut:
                    figures[TRUNCATED] += 1
                    code += 8
                if turn is not None:
                    if turn != figures[LAST_TURN] or not figures[TURNS]:
                        figures[TURNS] += 1
                    figures[FIRST_TURN] = turn if figures[FIRST_TURN] == _NO_TURN else figures[FIRST_TURN]
                    figures[LAST_TURN] = turn
                ends[1] = initial
                blocks.append(block)
                places.append(len(codes))
                codes.append(code + 4 if blank or duplicate else code)
            none = pa.nulls(n)
            by = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_arrays(
                [by["key"], pa.array(np.ones(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(blocks, pa.int32()),
                 pa.array(places, pa.int32()), by["turn"], by["role"], by["text"], none.cast(pa.binary()), none.cast(pa.list_(pa.int64())),
                 none.cast(pa.list_(pa.string()))], schema=_ARROW)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_ARROW)
        if codes:
            yield pa.RecordBatch.from_pylist([closed()], schema=_ARROW)
    return run


_ARROW = pa.schema([("key", pa.string()), ("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("at", pa.int32()), ("turn", pa.int64()),
                    ("role", pa.string()), ("text", pa.string()), ("codes", pa.binary()), ("figures", pa.list_(pa.int64())), ("ends", pa.list_(pa.string()))])


def blocks_of(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows after damage in their order (kind 1) and their blocks (kind 0).

    Rows of one turn are ordered by the SHA-256 of ``role:text``.
    """
    marked = rows.withColumn("tie", F.sha2(F.concat("role", F.lit(":"), "text").cast("binary"), 256))
    # Null turns come first, so the least struct is the first row of its kind.  Only what occurs again is joined back.
    first = marked.groupBy("key", "role", "tie").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    mine = marked.join(first, ["key", "role", "tie"], "left")
    trimmed = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    faced = mine.select(
        "key", "turn", "tie", "role", "text", F.left("role", F.lit(1)).alias("initial"), (trimmed == "").alias("blank"),
        (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("again"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    order = ["key", "turn", "tie"]
    return faced.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(block_rows), _FACES)


def _closure(cost: list[int]) -> list[int]:
    """Costs from each state once inserts are allowed; two in a row are the most that ever help."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[_TO[s]]) for s, c in enumerate(cost)]
    return cost


END_COSTS = _closure([0 if s in ENDS else _FAR for s in range(N_STATES)])


def _arcs(code: int, state: int):
    """(edit, cost, state after) of every way to use up a row."""
    yield "D", DELETE, state
    if not code & 4:
        cut = CUT if code & 8 else 0
        initial = "sua?"[code & 3]
        after = _AFTER[initial][state] if initial != "?" else None
        if after is not None:
            yield "K", KEEP + cut, after
        yield "R", REROLE + cut, _TO[state]


_STEPS = {code: [list(_arcs(code, s)) for s in range(N_STATES)] for code in range(16)}


def block_costs(codes: bytes, end: list[int]) -> list[list[int]]:
    """Least cost to the end from every state before each row, and after the last."""
    costs = [end]
    for code in reversed(codes):
        after = costs[-1]
        costs.append(_closure([min(c + after[t] for _, c, t in _STEPS[code][s]) for s in range(N_STATES)]))
    return costs[::-1]


def _matrix(codes: bytes) -> list[int]:
    """Least cost from each state before a block (rows) to each after it (columns)."""
    columns = [block_costs(codes, [0 if s == e else _FAR for s in range(N_STATES)])[0] for e in range(N_STATES)]
    return [min(columns[e][s], _FAR) for s in range(N_STATES) for e in range(N_STATES)]


def _matrices(batches):
    for batch in batches:
        rows = [_matrix(c.as_py()) for c in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int64()))], names=["key", "part", "block", "matrix"])


def _rests(batches):
    """From the matrices of a conversation's blocks, what remains to be paid after each block from every state."""
    for batch in batches:
        out = []
        for key, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cost = END_COSTS
            for b in reversed(blocks):
                out.append((key, b["part"], b["block"], cost))
                cost = [min(b["matrix"][N_STATES * s + e] + cost[e] for e in range(N_STATES)) for s in range(N_STATES)]
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
                                          pa.array(columns[3], pa.list_(pa.int64()))], names=["key", "part", "block", "rest"])


def ranked_paths(first: np.ndarray, following: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rank of every optimal arc by the edits from it on, and the doubled pointers.

    ``first`` is the edit of an arc (0 for the end, which follows itself), ``following`` the least arc behind it.  The rank by
    2n edits comes from the rank by n of an arc and of the arc its pointer reaches.
    """
    rank, pointers, length = first.astype(np.int64), [following], 1
    while length < longest:
        here = pointers[-1]
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[here], return_inverse=True)[1]
        pointers.append(here[here])
        length *= 2
    return rank, pointers


def _path(start: np.ndarray, pointers: list[np.ndarray], length: int) -> np.ndarray:
    """The first ``length`` arcs from each start, every place reached by its binary digits."""
    arcs = np.repeat(start[:, None], length, axis=1)
    places = np.arange(length)
    for k, pointer in enumerate(pointers):
        digit = (places >> k) & 1 == 1
        if digit.any():
            arcs[:, digit] = pointer[arcs[:, digit]]
    return arcs


def block_edits(blocks: list[tuple[bytes, list[int], bool]]) -> list[list[tuple[str, int]]]:
    """For each block (codes, costs after it, whether it is the last) and each entry state: its least edits and the exit state.

    Inserts at the end of a block belong to the next one; at the end of the last one they are its own.
    """
    edit: list[int] = []     # of each optimal arc
    target: list[int] = []   # the node it leads to
    begin: list[int] = []    # the first arc of each node; a node's arcs lie in the order of their edits
    offsets, sizes, longest = [], [], 1
    for codes, rest, is_last in blocks:
        base, n = len(begin), len(codes)
        offsets.append(base)
        sizes.append(n)
        costs = block_costs(codes, rest)
        # A place is followed by one edit of its row and by two inserts once, by one otherwise.
        longest = max(longest, 2 * n + 4)
        for i in range(n + 1):
            for s in range(N_STATES):
                cost, row = costs[i][s], base + N_STATES * i
                found = []
                over = cost >= _FAR or (i == n and (not is_last or cost == 0))
                if not over:
                    arcs = [(e, c, t, 1) for e, c, t in _STEPS[codes[i]][s]] if i < n else []
                    arcs.append(("I", INSERT, _TO[s], 0))
                    found = sorted((1 + _EDITS.index(e), row + N_STATES * step + t) for e, c, t, step in arcs if c + costs[i + step][t] == cost)
                begin.append(len(edit))
                for e, t in found or [(0, row + s)]:
                    edit.append(e)
                    target.append(t)
    edits, starts = np.array(edit, np.int64), np.array(begin, np.int64)
    rank, pointers = ranked_paths(edits, starts[np.array(target, np.int64)], longest)
    # Of the arcs of every node the one of least rank.
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(edits))))
    least = np.lexsort((rank, owner))[starts]
    letters = np.frombuffer(b"\x00" + _EDITS.encode(), np.uint8)
    out = []
    for base, n in zip(offsets, sizes):
        arcs = _path(least[base:base + N_STATES], pointers, 2 * n + 4)
        text = letters[edits[arcs]]
        out.append([(bytes(t[t > 0]).decode(), int(owner[a[-1]] - base) % N_STATES) for t, a in zip(text, arcs)])
    return out


def _bounded(blocks: list[tuple[bytes, list[int], bool]]):
    """Blocks in lists of at most ``ROWS_AT_ONCE`` rows, one block at least."""
    held, rows = [], 0
    for block in blocks:
        if held and rows + len(block[0]) > ROWS_AT_ONCE:
            yield held
            held, rows = [], 0
        held.append(block)
        rows += len(block[0])
    if held:
        yield held


def _edits(batches):
    for batch in batches:
        codes = [c.as_py() for c in batch.column("codes")]
        rests = batch.column("rest").to_pylist()
        lasts = batch.column("is_last").to_pylist()
        done = [d for some in _bounded(list(zip(codes, rests, lasts))) for d in block_edits(some)]
        costs = [block_costs(c, r)[0][START] for c, r in zip(codes, rests)]
        by = dict(zip(batch.schema.names, batch.columns))
        yield pa.RecordBatch.from_arrays(
            [by["key"], by["part"], by["block"], by["figures"], by["ends"], pa.array(costs, pa.int64()),
             pa.array([[t for t, _ in d] for d in done], pa.list_(pa.string())), pa.array([[s for _, s in d] for d in done], pa.list_(pa.int64()))],
            names=["key", "part", "block", "figures", "ends", "cost", "audits", "exits"])


_WALKED = "key string, part int, block int, kind int, at int, role string, text string, figures array<bigint>, ends array<string>, cost bigint, " \
          "audits array<string>, exits array<bigint>"
_RESULT = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Walk:
    """One conversation as it passes: blocks, each followed by its rows."""

    def __init__(self, key: str):
        self.key, self.state, self.cost = key, START, 0
        self.figures = [0, 0, 0, 0]
        self.turns, self.first, self.last = 0, None, None
        self.initial: str | None = None
        self.audit: list[str] = []
        self.edits, self.place, self.edit_state = "", 0, START
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def inserts(self) -> None:
        while self.place < len(self.edits) and self.edits[self.place] == "I":
            self.line(_ROLES[_NEXT[self.edit_state]], "")
            self.edit_state = _TO[self.edit_state]
            self.place += 1

    def block(self, row: dict) -> None:
        self.inserts()
        if self.initial is None:
            self.cost = row["cost"]
        elif self.initial + row["ends"][0] not in LEGAL:
            self.figures[ILLEGAL] += 1
        self.initial = row["ends"][1]
        figures = row["figures"]
        for i in range(4):
            self.figures[i] += figures[i]
        if figures[TURNS]:
            self.turns += figures[TURNS] - (self.last == figures[FIRST_TURN])
            self.first = figures[FIRST_TURN] if self.first is None else self.first
            self.last = figures[LAST_TURN]
        self.edits, self.place, self.edit_state = row["audits"][self.state], 0, self.state
        self.state = row["exits"][self.state]
        self.audit.append(self.edits)

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.edits[self.place]
        self.place += 1
        if edit == "K":
            self.line(role, text)
            self.edit_state = _AFTER[role[0]][self.edit_state]
        elif edit == "R":
            self.line(_ROLES[_NEXT[self.edit_state]], text)
            self.edit_state = _TO[self.edit_state]

    def result(self) -> tuple:
        self.inserts()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *self.figures, self.cost, "".join(self.audit), self.hash.hexdigest())


def _walk(batches):
    names = [c.split(" ")[0] for c in _RESULT.split(", ")]
    now: _Walk | None = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if now is None or row["key"] != now.key:
                if now is not None:
                    done.append(now.result())
                now = _Walk(row["key"])
            if row["kind"] == 0:
                now.block(row)
            elif row["kind"] == 1:
                now.row(row["role"], row["text"])
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=_RESULT_ARROW)
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, now.result()))], schema=_RESULT_ARROW)


_RESULT_ARROW = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in _RESULT.split(", ")])


def _filled(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema``; null where ``df`` has none."""
    kinds = [c.split(" ", 1) for c in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (columns conv_id, turn, role, text as they stand, others are ignored): gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Every null is read as one space where text is wanted; null turns come first and count for no gap; rows without conv_id
    are one conversation, returned with a null id.  Rows of one turn are ordered by the SHA-256 of ``role:text``; repeated rows
    are duplicates.  Empty texts are blank, texts may be of any length.  A conversation without rows left has zeros, an empty
    audit and the hash of nothing.  An empty table gives an empty one.
    """
    lines = rows.select("conv_id", "turn", "role", "text")
    return repaired(damaged(lines), lines.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL)).alias("key")).distinct(), block_rows) \
        .select(F.when(F.col("key") != NULL, F.col("key")).cast("bigint").alias("conv_id"), "*").drop("key")


def repaired(rows: DataFrame, keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repair of rows key, turn, role, text as given; one row per key of ``keys``."""
    cut = land(blocks_of(rows, block_rows), "rows")
    blocks = cut.where("kind = 0").select("key", "part", "block", "codes", "figures", "ends")
    long = blocks.groupBy("key").agg(F.count("*").alias("c"), F.max(F.struct("part", "block")).alias("last")).where("c > 1").drop("c")
    many = blocks.join(long, "key")
    # One matrix of 16 costs per BLOCK_ROWS rows meets in a task; the rows themselves must pass one hash in order anyway.
    rests = many.select("key", "part", "block", "codes").mapInArrow(_matrices, "key string, part int, block int, matrix array<bigint>") \
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "block", "matrix"))).alias("blocks")) \
        .mapInArrow(_rests, "key string, part int, block int, rest array<bigint>")
    ends = F.array(*[F.lit(c).cast("bigint") for c in END_COSTS])
    ready = blocks.join(rests, ["key", "part", "block"], "left").join(long, "key", "left").select(
        "key", "part", "block", "codes", "figures", "ends", F.coalesce("rest", ends).alias("rest"),
        (F.col("last").isNull() | (F.col("last") == F.struct("part", "block"))).alias("is_last"))
    edited = ready.mapInArrow(_edits, "key string, part int, block int, figures array<bigint>, ends array<string>, cost bigint, "
                                      "audits array<string>, exits array<bigint>")
    parts = [_filled(edited.withColumn("kind", F.lit(0)), _WALKED),
             _filled(cut.where("kind = 1").select("key", "part", "block", "kind", "at", "role", "text"), _WALKED),
             _filled(keys.withColumn("kind", F.lit(-1)), _WALKED)]
    order = ["key", "part", "block", "kind", "at"]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return together.repartition("key").sortWithinPartitions(*order).mapInArrow(_walk, _RESULT)
