import math
import re
from collections import Counter

import numpy as np
import pytest

from adlens.operators import scale, tfidf, vocab

TEXTS = [(1, "Gitar til salgs, gitar!"), (2, "BASS og gitar på  Bryne"), (3, "Ørnes"), (4, ""), (5, None), (6, "7-strengs x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id INT, text STRING")


def test_vocabulary(docs):
    words = sorted({w for _, t in TEXTS if t for w in re.sub("[^a-z0-9]+", " ", t.lower()).split()})
    want = {w: i for i, w in enumerate(["<PAD>", "<UNK>", *words])}
    assert {r.word: r.token_id for r in vocab.fit_vocabulary(docs, "text").collect()} == want


def test_encode_uses_raw_words(docs):
    table = vocab.fit_vocabulary(docs, "text")
    ids = {r.word: r.token_id for r in table.collect()}
    got = {r.id: r.ids for r in vocab.encode_tokens(docs, ["id"], "text", table).collect()}
    assert got[1] == [ids["gitar"], ids["til"], 1, 1]           # "salgs," and "gitar!" keep their marks
    assert got[2] == [ids["bass"], ids["og"], ids["gitar"], 1, ids["bryne"]]
    assert got[3] == [1] and got[4] == [] and got[5] == []
    clean = {r.id: r.ids for r in vocab.encode_tokens(docs, ["id"], "text", table, normalise=True).collect()}
    assert clean[1] == [ids["gitar"], ids["til"], ids["salgs"], ids["gitar"]]


def test_large_vocabulary_path_gives_the_same(docs):
    table = vocab.fit_vocabulary(docs, "text")
    a = vocab.token_rows(docs, ["id"], "text", table).collect()
    docs.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = vocab.token_rows(docs, ["id"], "text", table).collect()
    finally:
        docs.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(a) == sorted(b)


def test_padding(spark):
    df = spark.createDataFrame([("a", [5, 6]), ("a", []), ("b", [7])], "split STRING, ids ARRAY<BIGINT>")
    assert sorted(r.ids for r in vocab.pad_sequences(df).collect()) == [[0, 0], [5, 6], [7, 0]]
    assert sorted(r.ids for r in vocab.pad_sequences(df, split=["split"]).collect()) == [[0, 0], [5, 6], [7]]
    with pytest.raises(Exception, match="exceeds maximum length 1"):
        vocab.pad_sequences(df, max_len=1).collect()


def reference_tfidf(texts, limit):
    grams = {}
    for key, text in texts:
        tokens = re.findall(r"\b\w\w+\b", (text or "").lower())
        grams[key] = Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
    total = sum(grams.values(), Counter())
    keep = sorted(total, key=lambda t: (-total[t], t))[:limit]
    df = {t: sum(t in g for g in grams.values()) for t in keep}
    out = {}
    for key, g in grams.items():
        row = {t: g[t] * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in keep if g[t]}
        norm = math.sqrt(sum(w * w for w in row.values()))
        out |= {(key, t): w / norm for t, w in row.items()}
    return out


@pytest.mark.parametrize("limit", [3, 8000])
def test_tfidf(docs, limit):
    got = {(r.id, r.term): r.weight for r in tfidf.tfidf_terms(docs, "id", "text", limit).collect()}
    want = reference_tfidf(TEXTS, limit)
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1, 0.0, 5.0, "a"), (2, 3.0, 5.0, None), (3, 8.0, 5.0, "b"), (4, None, 5.0, "a")],
                                 "id INT, x DOUBLE, c DOUBLE, s STRING")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_standard_scale(numbers):
    x = np.array([0.0, 3.0, 8.0])
    got = column(scale.standard_scale(numbers, "x", "z"), "z")
    assert got[:3] == pytest.approx(list((x - x.mean()) / x.std())) and got[3] is None
    assert column(scale.standard_scale(numbers, "c", "z"), "z") == [0.0] * 4


def test_log1p_minmax_round_trip(numbers):
    fit = scale.fit_log1p_minmax(numbers, "x")
    scaled = scale.log1p_minmax(numbers, "x", fit, "z")
    got = column(scaled, "z")
    assert got[:3] == pytest.approx([0.0, math.log(4) / math.log(9), 1.0])
    assert column(scale.log1p_minmax_inverse(scaled, "z", fit, "back"), "back")[:3] == pytest.approx([0.0, 3.0, 8.0])
    constant = scale.fit_log1p_minmax(numbers, "c").first()
    assert constant.hi - constant.lo == pytest.approx(1e-9, rel=1e-3)


def test_minmax(numbers):
    rows = scale.minmax_numeric(numbers, ["x", "c"]).orderBy("id").collect()
    assert [r.num_x for r in rows] == [0.0, 3 / 8, 1.0, 0.0] and [r.num_c for r in rows] == [0.0] * 4


def test_one_hot_and_levels(numbers, spark):
    known = scale.levels(numbers, ["s"])
    assert known == {"s": ["a", "b", "missing"]}
    rows = scale.one_hot(numbers, known).orderBy("id").collect()
    assert [(r.s_a, r.s_b, r.s_missing) for r in rows] == [(1, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)]
    other = spark.createDataFrame([("zzz",)], "s STRING")
    assert tuple(scale.one_hot(other, known).first()) == ("zzz", 0, 0, 0)
    many = spark.range(1500).selectExpr("CAST(id AS STRING) AS v", "'x' AS w")
    assert {c: len(v) for c, v in scale.levels(many, ["v", "w"]).items()} == {"v": 1500, "w": 1}


def test_label_encode(numbers):
    assert column(scale.label_encode(numbers, "s", "code"), "code") == [1, 0, 2, 1]     # Unknown < a < b


def test_levels_beyond_the_bound_are_refused(spark):
    many = spark.range(30).selectExpr("CAST(id AS STRING) AS v")
    with pytest.raises(ValueError, match="more than 20"):
        scale.levels(many, ["v"], most=20)
