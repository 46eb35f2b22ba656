import math
import zlib
from collections import Counter

import pytest

from adlens.llm import lm


def brute(rows, order, prior):
    grams = [Counter() for _ in range(order + 1)]
    histories = [Counter() for _ in range(order + 1)]
    texts = []
    for doc, text in rows:
        tokens = ["<s>"] * (order - 1) + (text or "").encode().lower().split() + ["</s>"]
        out = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
        texts.append((doc, out, tokens))
        if not out:
            for i in range(order - 1, len(tokens)):
                for n in range(1, order + 1):
                    grams[n][tuple(tokens[i - n + 1:i + 1])] += 1
                    histories[n][tuple(tokens[i - n + 1:i])] += 1
    total, types = sum(grams[1].values()), len(grams[1])
    found = []
    for doc, out, tokens in texts:
        base = score = known = 0
        for i in range(order - 1, len(tokens)):
            count = grams[1][tokens[i],]
            p = (count + 1) / (total + types + 1)
            base += math.log10(p)
            known += count > 0
            for n in range(2, order + 1):
                size = histories[n][tuple(tokens[i - n + 1:i])]
                if size:
                    p = (grams[n][tuple(tokens[i - n + 1:i + 1])] + prior * p) / (size + prior)
            score += math.log10(p)
        found.append((doc, out, len(tokens) - order + 1, known, total, base, score))
    return sorted(found, key=str)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(docs, words, order):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A a B"), (None, "a b"), (5, "a b"), (5, "a b")]
    rows += [(10 + i, " ".join(words(40 + i, i % 11, 60))) for i in range(70)] + [(200, " ".join(words(9000, 7, 50)))]
    got = lm.score_texts(docs(rows), order=order, prior=3.0, block_bytes=6000).collect()
    same(sorted(map(tuple, got), key=str), brute(rows, order, 3.0))


def test_empty_table_and_no_training_text(docs):
    assert lm.score_texts(docs([])).count() == 0
    out = next(i for i in range(100) if lm.held_out(i))
    row = lm.score_texts(docs([(out, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_extra_columns_with_clashing_names(docs):
    from pyspark.sql import functions as F
    table = docs([(1, "a b")]).withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
    assert lm.score_texts(table).first().n_tokens == 3


def test_messages_come_back_whole():
    import numpy as np
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm.unsqueeze(lm.squeeze(keys)) == keys).all()
        counts = rng.integers(0, 600, len(keys))
        assert (lm.unpack_counts(lm.pack_counts(counts), len(keys)) == counts).all()


def test_a_model_of_copied_text_beats_single_words(docs, words):
    text = " ".join(words(200, 1, 150))
    rows = [(i, text) for i in range(60)]
    out = [r for r in lm.score_texts(docs(rows), prior=1.0).collect() if r.held_out]
    assert out and all(r.score > r.base_score * 0.2 for r in out)
