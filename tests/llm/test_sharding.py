import hashlib
from collections import Counter

import pytest

from adlens.llm import sharding

NAMES = [f"s{i}" for i in range(7)]


def brute(names, size):
    """The table by whole preference lists."""
    def number(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    lists = []
    for n in names:
        offset, skip = number(f"offset:{n}") % size, number(f"skip:{n}") % (size - 1) + 1
        lists.append([(offset + j * skip) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for s, own in enumerate(lists):
            if len(owner) < size:
                owner[next(x for x in own if x not in owner)] = s
    return [owner[i] for i in range(size)]


def test_table_equals_brute_force():
    assert sharding.fill_table(NAMES, 101) == brute(NAMES, 101)
    assert sharding.fill_table(["only"], 2) == [0, 0]


def test_shares_differ_by_one_slot():
    size = sharding.table_size(64)
    share = Counter(sharding.fill_table([f"n{i}" for i in range(64)], size))
    assert max(share.values()) - min(share.values()) <= 1


def test_a_lost_shard_moves_little_else():
    size = sharding.table_size(len(NAMES))
    before, after = sharding.fill_table(NAMES, size), sharding.fill_table(NAMES[:-1], size)
    moved = sum(a != b for a, b in zip(before, after) if b != -1 and a != len(NAMES) - 1)
    assert moved < 0.3 * size


@pytest.mark.parametrize("names,size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_wrong_parameters_are_refused(names, size):
    with pytest.raises(ValueError):
        sharding.fill_table(names, size)


def test_placement(docs):
    rows = [(i, "t") for i in range(50)] + [(None, None), (7, "again")]
    table = docs(rows).selectExpr("doc_id", "text AS slot", "lang")
    placed = sharding.place(table, "doc_id", NAMES)
    owner = brute(NAMES, sharding.table_size(len(NAMES)))
    assert placed.columns == ["doc_id", "lang", "slot", "shard"]
    out = placed.collect()
    assert len(out) == 52
    for r in out:
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % len(owner)
        assert (r.slot, r.shard) == (slot, owner[slot])
    assert sharding.place(docs([]), "doc_id", NAMES).count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan
