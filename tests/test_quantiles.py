import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from adlens.operators.quantiles import exact_percentiles, median_by, percentiles_wide
from adlens.operators.ranking import ordered_positions

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def check(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = {r.p: r.value for r in exact_percentiles(df, "v", PROBS).collect()}
    clean = np.array([v for v in values if v is not None and not np.isnan(v)])
    if len(clean) == 0:
        assert all(v is None for v in got.values())
        return
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(clean, p), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("values", [
    [], [None], [1.0], [3.0, 1.0], [5.0] * 100, [0.0, -0.0, None, float("nan"), 2.0],
    list(np.random.default_rng(1).lognormal(8, 2, 3000)),
    list(np.random.default_rng(2).normal(0, 1, 2000)) + [1e15, -1e15],
    list(1e9 + np.random.default_rng(3).integers(0, 1000, 2000) / 1e3),
], ids=["empty", "null", "one", "two", "constant", "zeros", "prices", "outliers", "narrow"])
def test_matches_numpy(spark, values):
    check(spark, [None if v is None else float(v) for v in values])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.integers(-3, 3).map(float)), max_size=60))
def test_matches_numpy_on_any_list(spark, values):
    check(spark, values)


@pytest.mark.parametrize("few", [True, False])
def test_groups_with_a_hot_and_a_null_group(spark, few):
    rng = np.random.default_rng(4)
    groups = ["hot"] * 3000 + [None] * 200 + [f"g{i}" for i in range(50) for _ in range(7)]
    pdf = pd.DataFrame({"g": groups, "v": rng.integers(0, 500, len(groups)).astype(float)})
    df = spark.createDataFrame(pdf.astype({"g": object}).where(pdf.notna(), None), "g STRING, v DOUBLE")
    got = {r.g: (r.lo, r.median) for r in percentiles_wide(
        df, "v", {"lo": 0.1, "median": 0.5}, ["g"], few_groups=few).collect()}
    want = pdf.fillna({"g": "none"}).groupby("g").v.quantile([0.1, 0.5]).unstack()
    assert len(got) == len(want)
    for g, row in want.iterrows():
        assert got[None if g == "none" else g] == pytest.approx((row[0.1], row[0.5]))


def test_approximate_is_close(spark):
    df = spark.range(100_001).selectExpr("CAST(id AS DOUBLE) AS v")
    assert median_by(df, "v", exact=False).first()["median"] == pytest.approx(50_000, abs=20)


def test_no_exchange_carries_all_rows(spark):
    """Near-unique microsecond times, all within a day: the rows are read twice and only histograms and the
    values of the chosen buckets are shuffled."""
    n = 200_000
    df = spark.range(0, n, 1, 4).selectExpr("1.7e15 + (id * 7919 % 200000) * 400000.0 * 1000 AS v")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}
    before = stages()
    got = exact_percentiles(df, "v", [0.25, 0.5, 0.9]).collect()
    want = np.quantile(1.7e15 + np.arange(n) * 4e8, [0.25, 0.5, 0.9])
    assert [r.value for r in sorted(got, key=lambda r: r.p)] == pytest.approx(list(want), rel=1e-12)
    moved = [records for stage, records in stages().items() if stage not in before]
    assert moved and max(moved) < 0.5 * n


def test_positions(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "hot"], 2000, p=[0.1, 0.1, 0.8]), "v": rng.permutation(2000)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = ordered_positions(df, ["v"], ["g"]).toPandas().sort_values("v").reset_index(drop=True)
    assert (got.position == got.groupby("g").cumcount()).all() and len(got) == 2000
    overall = ordered_positions(df, ["v"]).toPandas()
    assert (overall.position == overall.v).all()


def test_positions_null_group_and_empty(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g STRING, v INT")
    assert {(r.g, r.v, r.position) for r in ordered_positions(df, ["v"], ["g"]).collect()} == {
        (None, 1, 0), (None, 2, 1), ("a", 3, 0)}
    assert ordered_positions(df.where("false"), ["v"]).count() == 0
