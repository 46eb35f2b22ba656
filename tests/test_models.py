import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from adlens.operators import models
from adlens.operators.prepare import prepare_listings
from adlens.plans.jobs import evaluate_price_model, train_price_model
from adlens.sources.tables import EmptyInputError

FIVE = [("1", "Gitar", "Oslo", 1000.0, "2024-01-01T00:00:00Z"), ("2", "Bass", "Bergen", 1500.0, "2024-01-02T00:00:00Z"),
        ("3", "Forsterker", "Oslo", 2000.0, "2024-01-03T00:00:00Z"), ("4", "Pedal", "Hamar", 1200.0, None),
        ("5", "Gitar bass", "Bodø", 1800.0, "2024-01-05T00:00:00Z")]
SCHEMA = "ad_id STRING, heading STRING, location STRING, price_amount DOUBLE, timestamp_dt STRING"


@pytest.fixture(scope="module")
def listings(spark):
    rng = np.random.default_rng(0)
    kinds = ["gitar", "bass", "forsterker", "pedal"]
    rows = []
    for i in range(400):
        k = int(rng.integers(0, 4))
        price = 1000.0 * (k + 1) + float(rng.normal(0, 50))
        rows.append((str(i), f"{kinds[k]} nr{i % 7}", ["Oslo", "Bergen"][i % 2], price, f"2024-01-{i % 28 + 1:02d}T00:00:00Z"))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("solved_to", [4096, 2])
def test_ridge_equals_closed_form(spark, monkeypatch, solved_to):
    """By the normal equations and, beyond their width, by passes."""
    monkeypatch.setattr(models, "NORMAL_WIDTH", solved_to)
    rng = np.random.default_rng(1)
    x = rng.normal(0, [1.0, 20.0, 0.1], (200, 3))
    y = x @ [3.0, -0.5, 40.0] + 7 + rng.normal(0, 1, 200)
    df = spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x, y)], ["features", "price_amount"])
    for alpha in (1.0, 50.0):
        fit = models.ridge_estimator(df, alpha).fit(df)
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert fit.coefficients.toArray() == pytest.approx(want, rel=1e-4)
        assert fit.intercept == pytest.approx(y.mean() - x.mean(0) @ want, rel=1e-4)


def test_unknown_model_type(spark):
    df = spark.createDataFrame(FIVE, SCHEMA)
    with pytest.raises(ValueError, match="no such model: 'svm'"):
        models.fit_price_model(df, "svm")


def test_ridge_pipeline_equals_closed_form_on_tfidf(spark):
    """Whole feature vector (TF-IDF and time) and penalty against numpy."""
    prepared = prepare_listings(spark.createDataFrame(FIVE, SCHEMA))
    model = models.fit_price_model(prepared, "ridge")
    rows = model.stages.transform(prepared).select("features", "price_amount", "prediction").collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.price_amount for r in rows])
    assert np.linalg.norm(x[:, :-1], axis=1) == pytest.approx(np.ones(5))
    assert x[:, -1].mean() == pytest.approx(0, abs=1e-9) and x[:, -1].std() == pytest.approx(1)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    assert [r.prediction for r in rows] == pytest.approx(list(xc @ w + y.mean()))


def test_train_evaluate_round_trip(spark, listings, tmp_path):
    path = str(tmp_path / "deep" / "model")
    metrics = train_price_model(listings, path).first()
    holdout = spark.read.parquet(f"{path}.holdout")
    assert {"prediction", "text", "timestamp_val"} <= set(holdout.columns)
    assert metrics.n == holdout.count() and 40 < metrics.n < 130
    assert metrics.r2 > 0.9
    again, samples = evaluate_price_model(path, holdout.drop("prediction"))
    assert tuple(again.first()) == pytest.approx(tuple(metrics))
    assert samples.count() == 5 and samples.columns == ["price_amount", "prediction", "heading", "location"]


def test_feature_weights_and_tokens(spark, listings):
    prepared = prepare_listings(listings)
    weights = models.feature_weights(models.fit_price_model(prepared, "ridge"), spark)
    tops = models.top_tokens(weights, 3).collect()
    assert {"pedal"} <= {r.token for r in tops if r.side == "positive"}
    assert {"gitar"} <= {r.token for r in tops if r.side == "negative"}
    assert weights.where("feature = 'time__timestamp_val'").count() == 1


def test_boosted_trees_and_early_stop(spark, listings):
    prepared = models.with_split(prepare_listings(listings), "ad_id", 0.25, name="is_validation")
    small = {"max_terms": 30, "maxDepth": 3}
    model = models.fit_price_model(prepared, "gbt", maxIter=10, stepSize=0.5, **small)
    assert models.regression_metrics(model.predict(prepared)).first()["r2"] > 0.9
    stopped = models.fit_price_model(prepared, "gbt", validation="is_validation", maxIter=40, stepSize=0.5, **small)
    trees = stopped.stages.stages[-1]
    assert 1 <= trees.getNumTrees < 40
    kinds = {r.kind for r in models.feature_weights(stopped, spark).collect()}
    assert kinds == {"feature importance"}


def test_empty_training_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(EmptyInputError, match="to train on is empty"):
        train_price_model(empty, "/unused")
    unpriced = spark.createDataFrame([("1", "x", "y", None, None)], SCHEMA)
    with pytest.raises(EmptyInputError, match="no listing to train on"):
        train_price_model(unpriced, "/unused")


def test_metrics_match_the_evaluator(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 4.5), (9.0, 7.0), (None, 1.0), (2.0, None)],
                               "price_amount DOUBLE, prediction DOUBLE")
    row = models.regression_metrics(df).first()
    known = df.dropna()
    for name in ("mae", "rmse", "r2"):
        assert row[name] == pytest.approx(RegressionEvaluator(labelCol="price_amount", metricName=name).evaluate(known))


def test_split_is_stable(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS STRING) AS k")
    a = {r.k for r in models.with_split(df.repartition(3), "k").where("is_test").collect()}
    b = {r.k for r in models.with_split(df.repartition(8), "k").where("is_test").collect()}
    other = {r.k for r in models.with_split(df, "k", seed=7).where("is_test").collect()}
    assert a == b and a != other and 0.18 < len(a) / 20_000 < 0.22


def test_exact_split(spark):
    import math
    for n, share in [(5, 0.2), (5, 0.4), (10, 0.3), (7, 0.5), (101, 0.2), (1, 0.2)]:
        for start in (0, 50, 400):
            df = spark.range(start, start + n).selectExpr("CAST(id AS STRING) AS k", "id % 2 AS is_test")
            got = models.with_exact_split(df.repartition(3), "k", share)
            test = {r.k for r in got.where("is_test").collect()}
            assert got.count() == n and len(test) == math.ceil(round(share * n, 9)) and got.columns == ["k", "is_test"]
            assert test == {r.k for r in models.with_exact_split(df.repartition(2), "k", share).where("is_test").collect()}
    copies = spark.createDataFrame([("a", 1)] * 6 + [("a", 2)] * 4, "k STRING, v INT")
    assert models.with_exact_split(copies, "k", 0.5).where("is_test").count() == 5


def test_training_on_five_rows(spark, tmp_path):
    """Whatever the keys: model and holdout come out."""
    for n in range(3):
        rows = [(f"{n}-{i}", f"gitar {i}", "Oslo", 100.0 * i, None) for i in range(1, 6)]
        path = str(tmp_path / f"model{n}")
        assert train_price_model(spark.createDataFrame(rows, SCHEMA), path, test_size=0.4).first().n == 2
        assert spark.read.parquet(f"{path}.holdout").count() == 2


def test_residual_histogram_counts_every_row(spark):
    df = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS price_amount", "CAST(id % 7 AS DOUBLE) AS prediction")
    hist = models.residual_histogram(df, "price_amount", "prediction", 10)
    assert hist.agg(F.sum("n")).first()[0] == 100
