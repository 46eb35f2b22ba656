import random

from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.llm import tiling


def naive(text, pattern, least):
    """Greedy tiling by looking for the longest unmarked match again and again."""
    marked_t, marked_p, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(pattern)):
            for i in range(len(text)):
                k = 0
                while i + k < len(text) and j + k < len(pattern) and text[i + k] == pattern[j + k] \
                        and i + k not in marked_t and j + k not in marked_p:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered
        marked_t |= set(range(i, i + k))
        marked_p |= set(range(j, j + k))
        covered += k


def test_reordered_passages_are_covered():
    pattern = list(range(30))
    text = [99] * 5 + pattern[20:] + [98] * 3 + pattern[:10] + [97] + pattern[10:20]
    assert sum(k for _, _, k in tiling.tile(text, pattern)) == 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=25), st.integers(1, 5))
def test_tiles_are_disjoint_equal_and_long(text, pattern, least):
    tiles = tiling.tile(text, pattern, least)
    in_text = [x for i, _, k in tiles for x in range(i, i + k)]
    in_pattern = [x for _, j, k in tiles for x in range(j, j + k)]
    assert len(in_text) == len(set(in_text)) and len(in_pattern) == len(set(in_pattern))
    assert all(k >= least and text[i:i + k] == pattern[j:j + k] for i, j, k in tiles)
    if naive(text, pattern, least):
        assert tiles


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25),
       st.lists(st.tuples(st.integers(0, 24), st.integers(1, 9)), max_size=6), st.integers(1, 5))
def test_coverage_equals_naive_tiling(text, pattern, slices, least):
    assert sum(k for _, _, k in tiling.tile(text, pattern, least)) == naive(text, pattern, least)
    distinct = list(range(24))
    taken = [x for start, n in slices for x in [*distinct[start:start + n], 99]]
    assert sum(k for _, _, k in tiling.tile(distinct, taken, least)) == naive(distinct, taken, least)


def test_rest_of_an_overlapped_match_is_covered():
    # Lengths 20, 10, 5: both matches come up in the last pass; the longer one leaves five words of the other.
    text = [*range(1, 14), *range(50, 57)]
    pattern = [*range(6, 14), 99, *range(1, 8), *range(70, 74)]
    assert sum(k for _, _, k in tiling.tile(text, pattern)) == naive(text, pattern, 5) == 13


def test_pairs_equal_brute_force(docs, words, spark):
    items = [(i, " ".join(words(20 + i, i, 400))) for i in range(8)] + [(8, "too short"), (9, None), (10, ""), (None, " ".join(words(30, 77)))]
    rows = [(0, None), (1, "")]
    for n in range(60):
        own = random.Random(n)
        text = words(80, 1000 + n, 400)
        if n % 3 == 0:
            passage = (items[n % 8][1]).split()
            cut = own.randrange(len(passage))
            parts = [passage[cut:], passage[:cut]] if n % 2 else [passage[:max(3, cut)]]
            for part in parts:
                at = own.randrange(len(text))
                text[at:at] = [w.upper() if own.random() < 0.3 else w for w in part]
        rows.append((n + 2, " ".join(text)))
    rows.append((500, "Quote: " + items[-1][1] + "."))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.covered_words) for r in tiling.contaminated_pairs(docs(rows), benchmark).collect()), key=str)
    want = []
    for d, t in rows:
        ids = tiling.word_ids(t).tolist()
        for i, p in items:
            own = tiling.word_ids(p).tolist()
            covered = naive(ids, own, tiling.MIN_MATCH) if len(own) >= tiling.MIN_MATCH else 0
            if own and covered and 100 * covered >= tiling.COVER_PERCENT * len(own):
                want.append((d, i, covered))
    assert len(want) > 10
    assert got == sorted(want, key=str)
    clean = tiling.drop_contaminated(docs(rows), benchmark)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _, _ in want}
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_items_that_repeat_a_phrase_are_found(docs, spark):
    items = [(0, " ".join(["la"] * 12)), (1, " ".join(["la"] * 15)), (2, " ".join(["tick tock"] * 15)),
             (3, " ".join(["one two three four five"] * 12))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, f"before it {t} after it") for i, t in items[1:]] + [(9, "la la la la la only this")]
    got = sorted((r.doc_id, r.item_id, r.covered_words) for r in tiling.contaminated_pairs(docs(rows), benchmark).collect())
    assert got == [(1, 0, 12), (1, 1, 15), (2, 2, 30), (3, 3, 60)]


def test_blocks_give_the_same_pairs(docs, words, spark, monkeypatch):
    items = [(i, " ".join(words(25, i))) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, f"x {t} y") for i, t in items]
    whole = sorted(tuple(r) for r in tiling.contaminated_pairs(docs(rows), benchmark).collect())
    blocks = list(tiling.item_blocks(benchmark, 200))
    assert len(blocks) > 2 and sorted(i for b in blocks for i in b.ids) == list(range(6))
    found = sorted((d, i, c, n) for d, t in rows for b in blocks for i, c, n in b.matches(t, 50))
    assert found == whole and len(whole) == 6


def test_empty_tables(docs, spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert tiling.contaminated_pairs(docs([(1, "a b c d e f")]), empty).collect() == []
    assert tiling.contaminated_pairs(docs([]), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).collect() == []
    assert tiling.drop_contaminated(docs([(1, "a")]), empty).count() == 1
