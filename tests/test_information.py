import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.operators import information


def psi(n):
    return -0.57721566490153286061 + math.fsum(1 / i for i in range(1, int(n)))


def brute_continuous(x, y, k=3):
    """The estimate from all distances, as scikit-learn states it, without noise."""
    gap = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(gap, np.inf)
    radius = np.nextafter(np.sort(gap, axis=1)[:, k - 1], 0)
    counts = [(np.abs(v[:, None] - v) <= radius[:, None]).sum(axis=1) for v in (x, y)]
    return max(0.0, psi(len(x)) + psi(k) - sum(np.mean([psi(n) for n in c]) for c in counts))


def brute_discrete(label, y, k=3):
    radius, near, count = np.empty(len(y)), np.empty(len(y)), np.empty(len(y))
    for value in set(label):
        mine = np.array([v == value for v in label])
        count[mine] = mine.sum()
        near[mine] = min(k, mine.sum() - 1)
        if mine.sum() > 1:
            gap = np.abs(y[mine][:, None] - y[mine])
            np.fill_diagonal(gap, np.inf)
            radius[mine] = np.nextafter(np.sort(gap, axis=1)[:, int(near[mine][0]) - 1], 0)
    kept = count > 1
    y, radius, near, count = y[kept], radius[kept], near[kept], count[kept]
    within = (np.abs(y[:, None] - y) <= radius[:, None]).sum(axis=1)
    mean = [np.mean([psi(n) for n in c]) for c in (near, count, within)]
    return max(0.0, psi(len(y)) + mean[0] - mean[1] - mean[2])


def test_digamma(spark):
    numbers = [1, 2, 3, 15, 16, 17, 100, 12345]
    got = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", information.digamma(F.col("n")).alias("d")).collect()
    assert all(abs(r.d - psi(r.n)) < 1e-12 for r in got)


@pytest.mark.parametrize("block_rows", [8, 50, 1024])
def test_continuous_equals_brute_force(spark, block_rows):
    own = np.random.default_rng(block_rows)
    n = 260
    y = own.normal(size=n)
    features = {"smooth": y + own.normal(size=n), "noise": own.normal(size=n), "whole": own.integers(0, 6, n) / 1.7,  # many ties
                "same": np.ones(n), "far": np.where(np.arange(n) < 5, 1e6, own.normal(size=n)), "copies": np.repeat(own.normal(size=n // 20), 20)}
    target = {f: np.repeat(y[:n // 20], 20) if f == "copies" else y for f in features}
    rows = [(f, float(a), float(b)) for f, x in features.items() for a, b in zip(x, target[f])]
    points = spark.createDataFrame(rows, "feature string, x double, y double").repartition(5)
    got = {r.feature: r.mi for r in information.continuous_information(points, block_rows=block_rows).collect()}
    assert set(got) == set(features)
    for f, x in features.items():
        assert abs(got[f] - brute_continuous(x, target[f])) < 1e-9, f


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_discrete_equals_brute_force(spark, block_rows):
    own = random.Random(block_rows)
    n = 240
    y = np.array([own.choice([own.gauss(0, 1), round(own.gauss(0, 1), 1)]) for _ in range(n)])
    labels = {"hot": ["a" if own.random() < .8 else own.choice("bcd") for _ in range(n)], "few": [str(i // 2) if i < 10 else "z" for i in range(n)],
              "once": [str(i) if i < 20 else own.choice("ab") for i in range(n)], "sign": ["+" if v > 0 else "-" for v in y]}
    rows = [(f, label, float(v)) for f, held in labels.items() for label, v in zip(held, y)]
    got = {r.feature: r.mi for r in information.discrete_information(
        spark.createDataFrame(rows, "feature string, label string, y double").repartition(5), block_rows=block_rows).collect()}
    for f, held in labels.items():
        assert abs(got[f] - brute_discrete(held, y)) < 1e-9, f


def test_all_features_of_a_table(spark):
    own = random.Random(5)
    rows = [(own.choice(["a", None]), own.random() < .5, own.choice([None, own.gauss(0, 3)]), own.gauss(5, 2)) for _ in range(90)]
    df = spark.createDataFrame(rows, "cat string, flag boolean, num double, log_price double")
    got = {r.feature: r.mi for r in information.neighbour_information(df, ["cat", "flag"], ["num"], block_rows=16).collect()}
    y, x = np.array([r[3] for r in rows]), np.array([r[2] or 0.0 for r in rows])
    y, x = y / round(y.std(), 9), x / round(x.std(), 9)
    want = {"cat": brute_discrete([r[0] or "Unknown" for r in rows], y), "flag": brute_discrete([r[1] for r in rows], y), "num": brute_continuous(x, y)}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)
    few = {r.feature: r.mi for r in information.neighbour_information(df.limit(3), [], ["num"]).collect()}
    assert few == {"num": None}


def test_counts_within_are_exact_at_the_ends(spark):
    values = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 3.0)] + [("b", 5.0)], "axis string, value double")
    asked = spark.createDataFrame([("a", "1", 2.0, 3.0), ("a", "2", 1.5, 2.0), ("a", "3", 7.0, 9.0), ("b", "1", 0.0, 5.0)], "axis string, id string, low double, high double")
    got = {(r.axis, r.id): r.n for r in information.counts_within(values, asked).collect()}
    assert got == {("a", "1"): 3, ("a", "2"): 2, ("a", "3"): 0, ("b", "1"): 1}


def test_no_cross_join(spark):
    points = spark.createDataFrame([("f", 1.0, 2.0)] * 5, "feature string, x double, y double")
    plan = information.neighbour_radii(points)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
