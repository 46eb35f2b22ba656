import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.llm import divergence
from adlens.llm.ship import send_package

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n string, digest int"


def brute(rows, least=divergence.MIN_DOCS, top=divergence.TOP):
    """rows: (text, lang, source)."""
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), lang or "", source or "") for t, lang, source in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for words, lang, source in docs:
        held[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()

    def chances(count, kept):
        total = sum(count[t] for t in kept) + len(kept)
        return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

    def weight(p, q):
        return (p - q) * (p - q) // q
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for g, s in counts if g == lang]
        p = {s: chances(counts[lang, s], kept) for s in sources}
        q = chances(sum((counts[lang, s] for s in sources), Counter()), kept)
        for s in sources:
            pairs = [(-sum(weight(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-weight(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(sorted(found)[:most], 1)}
    return out


def table(spark, rows, partitions=3):
    send_package(spark)
    full = [(i, t, lang, source, "x", "y", 3) for i, (t, lang, source) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def corpus(seed, n=90):
    own = random.Random(seed)
    words = [f"{a}{b}" for a in ("Alpha", "be", "Çà", "ñ", "d") for b in ("one", "Two", "É", "x", "yy", "zed")]
    rows = [(" ".join(own.choice(words[:4 + own.randrange(26)]) + own.choice(["", "-", "1", "'s"]) for _ in range(own.randrange(40))),
             own.choice(["en", "de"]), own.choice(["s0", "s0", "s0", "s1", "s2", "é"])) for _ in range(n)]
    # A third language without a kept term, groups without terms, nulls, repeated rows and a very long text.
    return rows + [("solo", "xx", "a"), ("", "xx", "b"), (None, "en", "bare"), (None, None, None), ("Alphaone beTwo", None, None), ("1 2 3", "de", None),
                   *[rows[0]] * 3, (" ".join(own.choice(words) for _ in range(30_000)), "en", "s1")]


@pytest.mark.parametrize("bits", [64, 3])
def test_audit_equals_brute_force_and_collisions_are_split(spark, bits):
    rows = corpus(1)
    got = divergence.divergence_audit(table(spark, rows), digest_bits=bits).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len({tuple(r) for r in got})
    assert divergence.divergence_audit(table(spark, rows)).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_ties_are_cut_by_the_bytes_of_the_term(spark):
    # All terms of s0 weigh the same, more of them than are wanted.
    terms = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(" ".join(terms), "en", "s0")] * 3 + [("other " * 50, "en", "s1")] * 3
    got = divergence.divergence_audit(table(spark, rows)).where("source = 's0' and part = 'term'").orderBy("rank").collect()
    assert [r.item for r in got] == sorted(terms)[:divergence.TOP] and [r.rank for r in got] == list(range(1, 201))
    few = divergence.divergence_audit(table(spark, rows), top=5)
    assert {tuple(r) for r in few.collect()} == brute(rows, top=5)


def test_a_task_that_writes_in_parts_counts_the_same(monkeypatch):
    rows = corpus(2, 40)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(rows)), pa.array([hash(r[2]) for r in rows]), pa.array([None if r[0] is None else r[0].encode() for r in rows])],
                                       names=["lang_key", "group_key", "text"])

    def counted(**limits):
        for name, value in limits.items():
            monkeypatch.setattr(divergence, name, value)
        sums, parts = Counter(), 0
        for part in divergence._counter(64, True)([batch]):
            parts += 1
            for r in part.to_pylist():
                sums[r["group_key"], r["term"], "n"] += r["n"]
                sums[r["group_key"], r["term"], "df"] += r["df"]
        return sums, parts
    whole, few = counted()
    for limits in ({"HELD_WORDS": 5}, {"HELD_WORDS": 10**6, "HELD_TOKENS": 30}, {"HELD_TOKENS": 10**6, "PIECE": 7}):
        parts, many = counted(**limits)
        assert whole == parts and (many > few or "PIECE" in limits)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_terms_are_those_of_the_pattern(text):
    lower = text.translate({i: i + 32 for i in range(65, 91)})
    clean = lower.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in divergence.terms_of(text.encode("utf-8", "ignore"))] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", clean)


def test_probabilities_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F
    rows = [(c, m) for c, m in [(0, 1), (5, 7), (9_999_999_999_999, 10_000_000_000_000), (1, 90_000_000_000_000), (123_456_789_012, 7_777_777_777_777)]]
    df = spark.createDataFrame(rows, "c bigint, m bigint").select("c", "m", divergence._probability(F.col("c"), F.col("m")).alias("p"))
    assert {(r.c, r.m): r.p for r in df.collect()} == {(c, m): 1 + 10**9 * (c + 1) // m for c, m in rows}


def test_only_digests_are_shuffled_to_be_counted(spark):
    counted = divergence._kept(spark.createDataFrame([], "lang_key bigint, group_key bigint, digest bigint, term string, part int, n bigint, df bigint"), 3)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    moved = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert "Project [" in lines[moved + 1] and "term" not in lines[moved + 1]


def test_empty_table(spark):
    assert divergence.divergence_audit(table(spark, [])).count() == 0
