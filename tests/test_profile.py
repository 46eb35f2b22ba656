import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adlens.operators import profile


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    n = 4000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "x": rng.lognormal(3, 1, n),
                        "k": rng.integers(0, 12, n), "flag": rng.random(n) < 0.3})
    pdf["y"] = np.log1p(pdf.x) + pdf.flag * 2
    pdf["const"] = 1.0
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("values, bins", [
    (list(np.arange(0, 101) / 10), 10), (list(np.random.default_rng(1).normal(0, 5, 2000)), 80), ([3.0, 3.0], 4), ([1.0], 2)])
def test_histogram_as_numpy(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v DOUBLE")
    rows = profile.histogram(df, "v", bins).collect()
    counts, edges = np.histogram(values, bins)
    assert [r.n for r in rows] == list(counts)
    assert [r.bin_start for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_nothing(spark):
    assert profile.histogram(spark.createDataFrame([(None,)], "v DOUBLE"), "v", 5).count() == 0


def test_unit_histogram(spark):
    df = spark.createDataFrame([(0,), (3,), (3,), (None,)], "v INT")
    assert [tuple(r) for r in profile.unit_histogram(df, "v").collect()] == [(0, 1), (1, 0), (2, 0), (3, 2)]


def test_describe(frame):
    pdf, df = frame
    got = profile.describe_numeric(df, ["x", "k"]).toPandas().set_index("column")
    want = pdf[["x", "k"]].describe()
    for c in ("x", "k"):
        assert got.loc[c, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float).tolist() == \
            pytest.approx(want[c].tolist())


def test_describe_all_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("a", "z"), ("b", "z"), ("c", "y")], "s STRING, t STRING")
    got = {r.column: (r["count"], r.unique, r.top, r.freq) for r in profile.describe_all(df, ["s", "t"]).collect()}
    assert got == {"s": (5, 3, "a", 2), "t": (3, 2, "z", 2)}


def test_group_statistics(frame):
    pdf, df = frame
    got = {r.g: (r.n, r.median) for r in profile.median_price_by(df, "g", "x").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == (len(part), pytest.approx(part.x.median()))
    box = {r.g: r for r in profile.boxplot_stats(df, "g", "x").collect()}
    for g, part in pdf.groupby("g"):
        q1, q3 = part.x.quantile([0.25, 0.75])
        reach = 1.5 * (q3 - q1)
        assert box[g].whisker_high == pytest.approx(part.x[part.x <= q3 + reach].max())
        assert box[g].whisker_low == pytest.approx(part.x[part.x >= q1 - reach].min())


def test_correlation(frame):
    pdf, df = frame
    got = {r.feature: r.r for r in profile.feature_correlation(df, ["x", "k", "flag", "const"], "y").collect()}
    assert got["const"] is None
    for c in ("x", "k", "flag"):
        assert got[c] == pytest.approx(pdf[c].astype(float).corr(pdf.y))


def test_correlation_is_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 100.0), (9.0, None)], "a DOUBLE, log_price DOUBLE")
    assert profile.feature_correlation(df, ["a"]).first()["r"] == pytest.approx(1.0)


def test_mutual_information_against_counts(frame):
    pdf, df = frame
    got = {r.feature: r.mi for r in profile.mutual_information(df, ["g", "flag"], ["x", "k", "const"], "y", bins=8).collect()}

    def cut(v):
        edges = np.unique(np.quantile(v, np.arange(1, 8) / 8))
        return (np.asarray(v)[:, None] > edges[None, :]).sum(axis=1)

    def mi(a, b):
        joint = pd.crosstab(a, b).to_numpy() / len(a)
        outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        mask = joint > 0
        return (joint[mask] * np.log(joint[mask] / outer[mask])).sum()

    y = cut(pdf.y)
    for name, codes in {"g": pdf.g, "flag": pdf.flag, "x": cut(pdf.x), "k": cut(pdf.k)}.items():
        assert got[name] == pytest.approx(mi(codes, y), abs=1e-9)
    assert got["const"] == 0.0 and got["x"] > got["g"] and got["flag"] > got["g"]


def test_shape_and_outliers(frame):
    pdf, df = frame
    row = profile.shape(df, ["x"]).first()
    z = (pdf.x - pdf.x.mean()) / pdf.x.std(ddof=0)
    assert (row.skewness, row.kurtosis) == (pytest.approx((z ** 3).mean()), pytest.approx((z ** 4).mean() - 3))
    logged = np.log1p(pdf.x)
    q1, q3 = logged.quantile([0.25, 0.75])
    outside = (logged < q1 - 1.5 * (q3 - q1)) | (logged > q3 + 1.5 * (q3 - q1))
    out = profile.iqr_outliers(df, "x").first()
    assert (out.n_outliers, out.share) == (outside.sum(), pytest.approx(outside.mean()))


def test_shape_of_a_constant_is_null(frame):
    row = profile.shape(frame[1], ["const"]).first()
    assert (row.skewness, row.kurtosis) == (None, None)


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2), (None, None)], "k STRING, v INT")
    assert profile.duplicate_count(df, "k").first()["duplicates"] == 2
    assert {r.column: r.missing for r in profile.missing_fraction(df).collect()} == {"k": 0.5, "v": 0.5}
    assert profile.duplicate_count(df.where("false"), "k").first()["duplicates"] == 0
    assert [(r.k, r.n) for r in profile.value_counts(df, "k").collect()] == [("a", 2)]


def test_time_counts(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-01-01 05:00:00', timestamp'2024-01-03 05:00:00', "
                   "timestamp'2024-01-03 23:59:59', NULL)) AS t")
    assert [(str(r.day), r.n) for r in profile.daily_counts(df, "t").collect()] == [
        ("2024-01-01", 1), ("2024-01-02", 0), ("2024-01-03", 2)]
    week = profile.weekday_counts(df, "t").collect()
    assert [(r.dow, r.n) for r in week][:3] == [("Monday", 1), ("Tuesday", None), ("Wednesday", 2)]
    assert [(r.hour, r.n) for r in profile.hour_counts(df, "t").collect()] == [(5, 2), (23, 1)]


def test_shortlist_kinds(frame):
    rows = {r.feature: r for r in profile.feature_shortlist(frame[1], ["g"], ["x", "flag"], ["flag"], "y").collect()}
    assert (rows["g"].kind, rows["g"].r) == ("categorical", None)
    assert rows["x"].kind == "numeric" and rows["flag"].r is not None and rows["x"].mi > 0


def test_median_ratio(spark):
    df = spark.createDataFrame([(True, 10.0), (True, 30.0), (False, 5.0), (None, 99.0)], "f BOOLEAN, price_amount DOUBLE")
    assert tuple(profile.median_ratio(df, "f").first()) == (20.0, 5.0, 4.0)
    assert profile.class_share(df.select(F.col("f")), "f").where("f").first()["share"] == 0.5


def test_edge_answers(spark):
    """Empty tables, a median of zero, negative whole numbers, and labels that do not vary."""
    from adlens.operators.models import regression_metrics
    empty = spark.createDataFrame([], "a BOOLEAN, v INT")
    assert [tuple(r) for r in profile.boolean_counts(empty, ["a"]).collect()] == [("a", 0, None)]
    assert profile.class_share(empty, "a").collect() == []
    assert profile.unit_histogram(empty, "v").collect() == []
    zero = spark.createDataFrame([(True, 4.0), (False, 0.0)], "f BOOLEAN, price_amount DOUBLE")
    assert tuple(profile.median_ratio(zero, "f").first()) == (4.0, 0.0, None)
    below = spark.createDataFrame([(-2,), (0,), (1,), (1,)], "v INT")
    assert [tuple(r) for r in profile.unit_histogram(below, "v").collect()] == [(-2, 1), (-1, 0), (0, 1), (1, 2)]
    schema = "price_amount DOUBLE, prediction DOUBLE"
    r2 = lambda rows: regression_metrics(spark.createDataFrame(rows, schema)).first().r2
    assert r2([(5.0, 5.0), (5.0, 5.0)]) == 1.0 and r2([(5.0, 4.0), (5.0, 5.0)]) == 0.0
    assert r2([(3.0, 3.0)]) == 1.0 and r2([(3.0, 2.0)]) == 0.0 and r2([]) is None
