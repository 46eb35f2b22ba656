import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.operators import neural


def softmax_pool(x, score):
    s = x @ score
    w = np.exp(s - s.max())
    return (x * (w / w.sum())[:, None]).sum(0)


def test_attention_pool(spark):
    rng = np.random.default_rng(0)
    score = [0.5, -2.0, 30.0]
    data = {g: rng.normal(0, 10, (n, 3)) for g, n in (("hot", 500), ("one", 1), (None, 4))}
    rows = [(g, [float(v) for v in r]) for g, m in data.items() for r in m]
    df = spark.createDataFrame(rows, "g STRING, e ARRAY<DOUBLE>")
    got = {r.g: r.pooled for r in neural.attention_pool(df, ["g"], "e", score).collect()}
    mean = {r.g: r.pooled for r in neural.attention_pool(df, ["g"], "e", score, uniform=True).collect()}
    for g, m in data.items():
        assert got[g] == pytest.approx(list(softmax_pool(m, np.array(score))))
        assert mean[g] == pytest.approx(list(m.mean(0)))
    masked = neural.attention_pool(df, ["g"], "e", score, mask=F.col("g") == "one").collect()
    assert {r.g: r.pooled is None for r in masked} == {"one": False, "hot": True, None: True}


def test_position_encode(spark):
    words = spark.createDataFrame([("<PAD>", 0), ("<UNK>", 1), ("a", 2)], "word STRING, token_id BIGINT")
    tokens = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 2, 0)], "id INT, pos INT, token_id BIGINT")
    table = neural.frozen_embeddings(words, 4)
    plain = {r.pos: r.vec for r in neural.position_encode(tokens, table, 4, "none").collect()}
    got = {r.pos: r.vec for r in neural.position_encode(tokens, table, 4).collect()}
    for pos in range(3):
        angles = [pos, pos, pos * 10_000 ** -0.5, pos * 10_000 ** -0.5]
        want = [f(a) for f, a in zip((math.sin, math.cos) * 2, angles)]
        assert np.subtract(got[pos], plain[pos]) == pytest.approx(want)
    assert plain[2] == [0.0] * 4
    foreign = spark.createDataFrame([(1, 0, 77)], "id INT, pos INT, token_id BIGINT")
    assert neural.position_encode(foreign, table, 4, "none").first().vec == plain[1]
    with pytest.raises(ValueError, match="no such position encoding"):
        neural.position_encode(tokens, table, 4, "learned")


def test_time2vec(spark):
    df = spark.createDataFrame([(0.5, 2.0)], "a DOUBLE, b DOUBLE")
    vec = neural.time2vec([F.col("a"), F.col("b")], [1.0, 2.0], 0.5, [[3.0, 0.0], [0.0, 1.0]], [0.1, 0.2])
    assert df.select(vec.alias("v")).first()["v"] == pytest.approx([5.0, math.sin(1.6), math.sin(2.2)])


def plain_forward(net, ids, times):
    """One row, written out: no batching and no padding."""
    dim = net.embedding.shape[1]
    rows = []
    for pos, t in enumerate(ids):
        enc = [math.sin(pos / 10_000 ** ((i - i % 2) / dim)) if i % 2 == 0 else
               math.cos(pos / 10_000 ** ((i - i % 2) / dim)) for i in range(dim)]
        rows.append(net.embedding[t] + enc)
    h = softmax_pool(np.array(rows), net.score)
    trend = np.dot(times, net.time_linear[0]) + net.time_linear[1]
    h = h + np.concatenate([[trend], np.sin(np.dot(times, net.time_periodic[0]) + net.time_periodic[1])])
    for i, (w, b) in enumerate(net.layers):
        h = h @ w + b
        if i < len(net.layers) - 1:
            h = (h - h.mean()) / math.sqrt(h.var() + 1e-5)
            if net.norms:
                h = h * net.norms[i][0] + net.norms[i][1]
            h = np.maximum(h, 0.01 * h)
    return h[0]


def test_score_frozen_network(spark):
    net = neural.FrozenNetwork.from_rule(20, dim=8, hidden=(6, 5))
    rows = [(1, [2, 3, 4], 0.1, 0.9), (2, [5], 0.4, 0.2), (3, [], 0.5, 0.5), (4, [19, 1, 3, 2, 2], 1.0, None)]
    df = spark.createDataFrame(rows, "id INT, ids ARRAY<BIGINT>, a DOUBLE, b DOUBLE").repartition(3)
    got = {r.id: r.score for r in neural.score_frozen_network(df, net, "ids", ["a", "b"], length=6).collect()}
    assert got[1] == pytest.approx(plain_forward(net, [2, 3, 4], [0.1, 0.9]))
    assert got[2] == pytest.approx(plain_forward(net, [5], [0.4, 0.2]))
    assert got[3] is None
    assert got[4] == pytest.approx(plain_forward(net, [19, 1, 3, 2, 2], [1.0, 0.0]))
    with pytest.raises(Exception, match="longer than 4"):
        neural.score_frozen_network(df, net, "ids", ["a", "b"], length=4).collect()
    foreign = spark.createDataFrame([(1, [2, 20], 0.1, 0.2)], "id INT, ids ARRAY<BIGINT>, a DOUBLE, b DOUBLE")
    with pytest.raises(Exception, match="beyond the 20 rows"):
        neural.score_frozen_network(foreign, net, "ids", ["a", "b"], length=6).collect()


def test_weights_from_a_table_and_a_long_title(spark):
    """Every part of the network from rows, layer-norm scale and shift included; 100 tokens fit."""
    rng = np.random.default_rng(2)
    shapes = {"embedding": (30, 8), "score": (1, 8), "time_linear": (2, 1), "time_linear_bias": (1, 1), "time_periodic": (2, 7),
              "time_periodic_bias": (1, 7), "weight_0": (8, 6), "bias_0": (1, 6), "scale_0": (1, 6), "shift_0": (1, 6),
              "weight_1": (6, 1), "bias_1": (1, 1)}
    rows = [(part, i, j, float(rng.normal())) for part, (a, b) in shapes.items() for i in range(a) for j in range(b)]
    table = spark.createDataFrame(rows, "part STRING, row INT, col INT, value DOUBLE")
    net = neural.FrozenNetwork.from_table(table, dim=8, hidden=(6,))
    ids = [2 + k % 28 for k in range(100)]
    df = spark.createDataFrame([(ids, 0.3, 0.6)], "ids ARRAY<BIGINT>, a DOUBLE, b DOUBLE")
    got = neural.score_frozen_network(df, net, "ids", ["a", "b"]).first().score
    assert got == pytest.approx(plain_forward(net, ids, [0.3, 0.6]))
    with pytest.raises(ValueError, match="bias_0"):
        neural.FrozenNetwork.from_table(table.where("part <> 'bias_0'"), dim=8, hidden=(6,))


def test_embedding_as_a_table_gives_the_same_scores(spark):
    net = neural.FrozenNetwork.from_rule(20, dim=8, hidden=(6, 5))
    rows = [(1, [2, 3, 4], 0.1, 0.9), (2, [5], 0.4, 0.2), (3, [], 0.5, 0.5), (4, [19, 1, 3, 2, 2], 1.0, None), (5, [0, 0], 0.1, 0.1)]
    df = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "id INT, a DOUBLE, b DOUBLE")
    tokens = spark.createDataFrame([(r[0], p, t) for r in rows for p, t in enumerate(r[1])] + [(6, 0, 99)], "id INT, pos INT, token_id BIGINT").repartition(3)
    words = spark.createDataFrame([(t, [float(x) for x in net.embedding[t]]) for t in range(20)], "token_id BIGINT, vec ARRAY<DOUBLE>")
    got = {r.id: r.score for r in neural.score_pooled_tokens(df, ["id"], tokens, words, net, ["a", "b"], length=6).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[3] is None and got[5] is None
    for r in (rows[0], rows[1], rows[3]):
        assert got[r[0]] == pytest.approx(plain_forward(net, r[1], [r[2], r[3] or 0.0]))
    # A token the table does not have counts as unknown.
    odd = neural.score_pooled_tokens(df.limit(1).withColumn("id", F.lit(6)), ["id"], tokens, words, net, ["a", "b"]).first()
    assert odd.score == pytest.approx(plain_forward(net, [1], [0.1, 0.9]))
    with pytest.raises(Exception, match="longer than 4"):
        neural.score_pooled_tokens(df, ["id"], tokens, words, net, ["a", "b"], length=4).collect()
