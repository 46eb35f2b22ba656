import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.llm import conversations as C
from adlens.llm.ship import send_package

WHITE = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(lines):
    """lines: (turn, role, text) in order.  Tries all edits, keeping the least (cost, audit) of each state reached."""
    if not lines:
        return (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    seen, faults = set(), []
    for _, role, text in lines:
        last = text.rstrip(WHITE)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for (s, o), t in moves.items():
                if o in full and s in best:
                    cost, audit, out = best[s]
                    best[t] = min(best.get(t, (1 << 60,)), (cost + 2, audit + "I", (*out, full[o] + ":")))
        return best
    best = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(lines, faults):
        after = {}

        def reach(state, entry):
            after[state] = min(after.get(state, (1 << 60,)), entry)
        for s, (cost, audit, out) in best.items():
            reach(s, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cut = fault == "truncated"
            if (s, role[:1]) in moves:
                reach(moves[s, role[:1]], (cost + cut, audit + "K", (*out, f"{role}:{text}")))
            for o, name in full.items():
                if (s, o) in moves:
                    reach(moves[s, o], (cost + 2 + cut, audit + "R", (*out, f"{name}:{text}")))
        best = inserted(after)
    cost, audit, out = min(best[s] for s in (0, 3) if s in best)
    turns = [t for t, _, _ in lines if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in lines]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{r[2]}:{r[3]}".encode()).hexdigest()))


def made(seed, n=60, longest=12):
    own = random.Random(seed)
    texts = ["Hello.", "What now?", "cut off", "", " \n", "Done! ", "same.", None, "a. ", "é…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unit"]
    return [(c, own.choice([t, t, t, None, t + 3]), own.choice(roles), f"{own.choice(texts)}" if own.random() < .9 else None)
            for c in [None, *range(n)] for t in range(own.randrange(longest))]


def check(spark, rows, block_rows, partitions=4):
    send_package(spark)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, block int").repartition(partitions)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df, block_rows).collect()}
    kept = damage(rows)
    want = {c: brute([r[1:] for r in ordered([k for k in kept if k[0] == c])]) for c in {r[0] for r in rows}}
    assert got == want
    return got


def test_repair_equals_brute_force(spark):
    got = check(spark, made(1), C.BLOCK_ROWS)
    assert {letter for g in got.values() for letter in g[6]} == set("DIKR")


def test_blocks_and_partitions_do_not_matter(spark):
    rows = made(2, 12, 40)
    assert check(spark, rows, 3) == check(spark, rows, 7, 1)


def test_ties_repeated_rows_and_a_very_long_text(spark):
    long = "word " * 400_000 + "end."
    rows = [(1, 1, "user", long), (1, 1, "user", long), (1, 2, "assistant", "b."), (1, 2, "assistant", "a."), (1, 2, "user", "a."),
            (2, None, "user", "x."), (2, None, "assistant", "y."), (2, None, "user", "x.")]
    check(spark, rows, 2)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert check(spark, [(gone, 0, "user", "a.")], 4) == {gone: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}
    assert C.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_one_hot_conversation_is_cut_into_blocks(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"line {t % 50}.") for t in range(900)] + [(c, 0, "user", "x") for c in range(20, 60)]
    check(spark, rows, 16)


codes = st.lists(st.integers(0, 15), max_size=9)


@settings(max_examples=200, deadline=None)
@given(st.lists(codes, min_size=1, max_size=4))
def test_ranks_order_paths_and_pointers_read_them(blocks):
    """Cut anywhere, the audit is the least of the cheapest ones."""
    whole = bytes(c for b in blocks for c in b)
    rests, cost = [], C.END_COSTS
    for b in reversed(blocks):
        rests.append(cost)
        matrix = C._matrix(bytes(b))
        cost = [min(matrix[4 * s + e] + cost[e] for e in range(4)) for s in range(4)]
    assert cost[0] == C.block_costs(whole, C.END_COSTS)[0][0]
    state, audit = C.START, ""
    cut = C.block_edits([(bytes(b), r, i == len(blocks) - 1) for i, (b, r) in enumerate(zip(blocks, rests[::-1]))])
    for found in cut:
        audit, state = audit + found[state][0], found[state][1]
    assert audit == C.block_edits([(whole, C.END_COSTS, True)])[0][C.START][0] and state in C.ENDS


def test_ranks_of_arcs():
    first, following = np.array([2, 3, 0, 2, 1]), np.array([1, 2, 2, 0, 2])
    rank, _ = C.ranked_paths(first, following, 8)

    def path(a):
        out = []
        while first[a]:
            out.append(int(first[a]))
            a = following[a]
        return out
    assert sorted(range(5), key=lambda a: rank[a]) == sorted(range(5), key=path)
