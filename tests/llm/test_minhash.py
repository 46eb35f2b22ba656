import random

import numpy as np
import pytest

from adlens.llm import minhash
from adlens.llm.common import shingle_set
from adlens.llm.components import components


def brute(rows, percent=75):
    """Component and set size of each row by comparing all pairs of full shingle sets."""
    def shingles(text):
        w = (text or "").encode().lower().split()
        if not w:
            return set()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def changed(words, share, seed):
    own = random.Random(seed)
    return [w if own.random() > share else f"x{own.randrange(10**6)}" for w in words]


def test_near_duplicates_equal_brute_force(docs, words):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, "É a b c d e"), (7, "é a b c d e")]
    for group in range(6):
        base = words(120, group)
        for copy in range(14):
            # Shares around the threshold: some copies are linked only through others, some not at all.
            rows.append((100 * (group + 1) + copy, " ".join(changed(base, 0.012 * copy / 2, 31 * group + copy))))
    rows += [(900, " ".join(words(4000, 99))), (901, " ".join(words(4000, 99) + ["end"]))]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(rows)).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_large_group_of_copies_around_the_threshold(docs, words):
    base = words(80, 5)
    rows = [(i, " ".join(changed(base, (i % 9) * 0.006, i))) for i in range(160)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_pages_of_one_template_do_not_meet(docs, spark, words):
    from pyspark.sql import functions as F
    template = words(84, 1)
    rows = [(i, " ".join([*template[:40], *words(16, 1000 + i), *template[40:]])) for i in range(300)]
    sets = docs(rows).select("doc_id", "text").mapInArrow(minhash._shingle_sets, "doc_id bigint, shingles array<bigint>")
    left = sets.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp"), F.size("shingles").cast("bigint").alias("n"),
                       F.array(*[F.lit(0).cast("bigint")] * 4).alias("bits"))
    probe, index = minhash._prefix_sides(left, sets, 75)
    met = probe.groupBy("shingle", "class").count().join(index.groupBy("shingle", "class").agg(F.count("*").alias("m")), ["shingle", "class"])
    assert (met.agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0) <= len(rows)
    assert {r.component_id for r in minhash.near_duplicates(docs(rows)).collect()} == {i for i, _ in rows}


@pytest.mark.parametrize("percent", [75, 60])
def test_prefixes_find_every_similar_pair(spark, percent):
    from pyspark.sql import functions as F
    own = random.Random(8)
    base = [own.randrange(2**60) for _ in range(70)]
    sets = {}
    for i in range(150):
        kept = [x for x in base if own.random() > 0.02 * (i % 12)]
        sets[i] = set(kept) | {own.randrange(2**60) for _ in range(own.randrange(14))}
    sets |= {200: {1}, 201: {1}, 202: {1, 2}, 203: {1, 2, 3}, 204: {1, 2, 3, 4}}
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id bigint, shingles array<bigint>")
    # Equal signatures, so that no pair is dropped by its estimate.
    active = table.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp"), F.size("shingles").cast("bigint").alias("n"),
                          F.array(*[F.lit(0).cast("bigint")] * 4).alias("bits"))
    got = {(r.a, r.b) for r in minhash._prefix_pairs(active, table, percent).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert want and want <= got


def test_null_ids_repeated_rows_and_empty_table(docs):
    text = "one two three four five six seven"
    got = minhash.near_duplicates(docs([(None, text), (5, text), (5, text), (3, text)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert minhash.near_duplicates(docs([])).collect() == []
    kept = minhash.keep_one_per_group(docs([(None, text), (4, text), (4, text), (7, "other words")]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 4, 7]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_texts_that_share_an_id_stay_unless_near_duplicates(docs, words):
    one, two, three = (words(60, seed) for seed in (1, 2, 3))
    near = " ".join([*one[:-1], "changed"])
    one, two, three = " ".join(one), " ".join(two), " ".join(three)
    rows = [(2, one), (5, near), (5, two), (5, three), (5, two), (8, three), (None, two)]
    kept = minhash.keep_one_per_group(docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(2, one), (5, two), (5, three), (None, two)], key=str)


def test_clashing_columns_are_ignored(docs):
    from pyspark.sql import functions as F
    table = docs([(1, "a b c d e f"), (2, "a b c d e f")])
    for name in ("bucket", "id", "kept", "n_shingles", "comp"):
        table = table.withColumn(name, F.lit("x"))
    assert sorted(r.component_id for r in minhash.near_duplicates(table).collect()) == [1, 1]


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(3)
    import pyspark.sql.functions as F
    rows = []
    for share in (0.0, 0.3, 0.75, 1.0):
        for _ in range(60):
            common = rng.integers(0, 2**63, 400, dtype=np.uint64)
            n = int(400 * 2 * share / (1 + share))
            a = np.unique(np.concatenate([common[:n], rng.integers(0, 2**63, 400 - n, dtype=np.uint64)]))
            b = np.unique(np.concatenate([common[:n], rng.integers(0, 2**63, 400 - n, dtype=np.uint64)]))
            rows.append((share, *[minhash.packed(minhash.minima(s)).view(np.int64).tolist() for s in (a, b)]))
    df = spark.createDataFrame(rows, "share double, a array<bigint>, b array<bigint>")
    mean = {r.share: r.m for r in df.groupBy("share").agg(
        F.avg(minhash.estimated_similarity(F.col("a"), F.col("b"))).alias("m")).collect()}
    assert all(abs(mean[s] - s) < 0.03 for s in mean)
    assert mean[1.0] == 1.0


def test_shingle_set_of_few_words():
    assert len(shingle_set(None, 5)) == 0 and len(shingle_set("a b", 5)) == 1
    assert np.array_equal(shingle_set("a B\tc", 5), shingle_set("A b\nC", 5))


def test_components_against_union_find(spark):
    own = random.Random(1)
    links = [(own.randrange(300), own.randrange(300)) for _ in range(260)] + [(1000, i) for i in range(1001, 1200)]
    links += [(i, i + 1) for i in range(2000, 2040)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(root) if find(x) != x}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("percent", [75, 90])
def test_cut_lies_under_the_threshold(percent):
    assert 0 < minhash.estimate_cut(percent) < percent / 100 - 0.1
