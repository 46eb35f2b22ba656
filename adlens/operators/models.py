"""Price models: split, features, fit, evaluate, explain, save."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, NGram, Normalizer,
                                RegexTokenizer, SQLTransformer, VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.constants import GBT_SETTINGS, RIDGE_ALPHA, SEED, TFIDF_TERMS
from adlens.operators.profile import histogram
from adlens.operators.ranking import ordered_positions
from adlens.operators.tfidf import TOKEN_PATTERN, term_table
from adlens.session import ensure_checkpoint_dir, materialize
from adlens.sources.tables import require_rows

MODEL_TYPES = ("ridge", "gbt")
TIME_FEATURE = "timestamp_val"


# ---- split -----------------------------------------------------------------------------

def hash_share(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on key and seed only, not on the partitioning."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def with_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED,
               name: str = "is_test") -> DataFrame:
    return df.withColumn(name, hash_share(F.col(key), seed) < test_size)


def with_exact_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED,
                     name: str = "is_test") -> DataFrame:
    """Split with exactly ``ceil(test_size * rows)`` test rows: those whose keys have the smallest hashes.

    Rows are compared by hash, then by key, then by a hash of all columns, so the split depends on the rows alone.  The last
    test row is found by position over range partitions; no task sorts the table.
    """
    marked = materialize(df.withColumns({
        "_share": hash_share(F.col(key), seed), "_key": F.col(key).cast("string"),
        "_row": F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), "_copy": F.monotonically_increasing_id()}))
    order = ["_share", "_key", "_row", "_copy"]
    wanted = F.ceil(F.round(F.lit(float(test_size)) * F.lit(marked.count()), 9))
    return ordered_positions(marked, order, name="_place").withColumn(name, F.col("_place") < wanted) \
        .select(*[c for c in df.columns if c != name], name)


# ---- features and estimators -----------------------------------------------------------

@dataclass
class PriceModel:
    """A fitted pipeline and the names of its feature vector, in order."""

    stages: PipelineModel
    features: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        extra = {"_tokens", "_pairs", "_grams", "_counts", "_weighted", "_text_vec", "_time", "features"}
        return self.stages.transform(df).drop(*extra)

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> PriceModel:
        stages = PipelineModel.load(path)
        terms = next(s for s in stages.stages if isinstance(s, CountVectorizerModel)).vocabulary
        return cls(stages, [f"text__{t}" for t in terms] + [f"time__{TIME_FEATURE}"])


def _feature_stages(train: DataFrame, max_terms: int) -> tuple[list, list[str]]:
    """Text and time branches with their state fitted on ``train``."""
    table = term_table(train, "text", max_terms).orderBy("term").collect()  # at most max_terms rows
    if not table:
        raise ValueError("no text to learn from")
    terms = [r["term"] for r in table]
    moments = train.agg(F.avg(TIME_FEATURE).alias("m"), F.stddev_pop(TIME_FEATURE).alias("s")).first()
    centre, spread = moments["m"] or 0.0, moments["s"] or 1.0
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False),
        NGram(n=2, inputCol="_tokens", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_tokens, _pairs) AS _grams FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_counts"),
        ElementwiseProduct(inputCol="_counts", outputCol="_weighted",
                           scalingVec=Vectors.dense([r["idf"] for r in table])),
        Normalizer(inputCol="_weighted", outputCol="_text_vec", p=2.0),
        SQLTransformer(statement=f"SELECT *, coalesce(({TIME_FEATURE} - CAST('{centre!r}' AS DOUBLE)) "
                                 f"/ CAST('{spread!r}' AS DOUBLE), 0D) AS _time FROM __THIS__"),
        VectorAssembler(inputCols=["_text_vec", "_time"], outputCol="features"),
    ]
    return stages, [f"text__{t}" for t in terms] + [f"time__{TIME_FEATURE}"]


# Spark solves the normal equations up to this many features.
NORMAL_WIDTH = 4096


def ridge_estimator(train: DataFrame, alpha: float = RIDGE_ALPHA, label: str = "price_amount",
                    features: str = "features", width: int | None = None) -> LinearRegression:
    """Ridge with an unpenalised intercept; ``width`` is the number of features (else read off a row).

    Spark divides the loss by the row count and scales the label, so the penalty that equals ``alpha`` in the plain
    least-squares form is ``alpha * deviation(label) / rows``.  Up to ``NORMAL_WIDTH`` features the normal equations are
    summed in one pass and solved (there Spark takes the population deviation); beyond, some hundred passes come near the
    same solution (there the sample deviation).
    """
    row = train.agg(F.stddev_samp(label).alias("sample"), F.stddev_pop(label).alias("population"), F.count(label).alias("n")).first()
    if not row["n"]:
        raise ValueError("no rows to fit on")
    if width is None:
        width = train.select(features).first()[0].size
    solver, deviation = ("normal", row["population"]) if width <= NORMAL_WIDTH else ("l-bfgs", row["sample"])
    return LinearRegression(
        featuresCol=features, labelCol=label, elasticNetParam=0.0, standardization=False,
        regParam=alpha * (deviation or 0.0) / row["n"], solver=solver, maxIter=1000, tol=1e-12)


def fit_price_model(train: DataFrame, model_type: str = "ridge", max_terms: int = TFIDF_TERMS,
                    validation: str | None = None, **settings) -> PriceModel:
    """Fit on a prepared table (``text``, ``timestamp_val``, ``price_amount``).

    ``validation`` names a boolean column: its true rows are not trained on, and boosting stops
    when the error on them no longer falls, keeping the trees up to the best round.
    """
    if model_type not in MODEL_TYPES:
        raise ValueError(f"no such model: {model_type!r}; known are {', '.join(MODEL_TYPES)}")
    rows = train.withColumn("price_amount", F.col("price_amount").cast("double"))
    fitted_on = rows if validation is None else rows.where(~F.col(validation))
    stages, names = _feature_stages(fitted_on, max_terms)
    if model_type == "ridge":
        estimator = ridge_estimator(fitted_on, width=len(names), **settings)
        rows = fitted_on
    else:
        ensure_checkpoint_dir(train.sparkSession)  # the lineage of hundreds of rounds is cut every few
        options = {**GBT_SETTINGS, "seed": SEED, **settings}
        if validation is not None:
            options["validationIndicatorCol"] = validation
        estimator = GBTRegressor(featuresCol="features", labelCol="price_amount", **options)
    return PriceModel(Pipeline(stages=[*stages, estimator]).fit(rows), names)


# ---- evaluation ------------------------------------------------------------------------

def regression_metrics(df: DataFrame, label: str = "price_amount",
                       prediction: str = "prediction") -> DataFrame:
    """One row: MAE, RMSE, R² and the number of rows with both values.

    R² comes from moments in one pass: label variance around its mean is ``n * var_pop``.  Labels that do not
    vary (a single row, too) give 1 for exact predictions, else 0; no rows give NULL.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    known = df.where(y.isNotNull() & p.isNotNull())
    error, spread = F.sum(e * e), F.count("*") * F.var_pop(y)
    flat = F.when(error == 0, 1.0).when(error > 0, 0.0)
    return known.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                     F.coalesce(1 - F.try_divide(error, spread), flat).alias("r2"),
                     F.count("*").alias("n"))


def residual_histogram(df: DataFrame, label: str, prediction: str, bins: int = 50) -> DataFrame:
    return histogram(df.select((F.col(label) - F.col(prediction)).alias("residual")), "residual", bins)


def sample_predictions(df: DataFrame, n: int = 5, key: str = "ad_id") -> DataFrame:
    return (df.orderBy(key, "price_amount", "prediction")
            .select("price_amount", "prediction", "heading", "location").limit(n))


def feature_weights(model: PriceModel, spark) -> DataFrame:
    """``feature, kind, token, weight`` of a fitted model: at most terms + 1 rows."""
    final = model.stages.stages[-1]
    if hasattr(final, "coefficients"):
        weights, kind = final.coefficients, "coefficient"
    elif hasattr(final, "featureImportances"):
        weights, kind = final.featureImportances, "feature importance"
    else:
        raise ValueError("the last stage has neither coefficients nor importances")
    rows = [(name, kind, name.split("__", 1)[1], float(w))
            for name, w in zip(model.features, weights.toArray())]
    return spark.createDataFrame(rows, "feature STRING, kind STRING, token STRING, weight DOUBLE")


def top_tokens(weights: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` text tokens with the largest and with the smallest weights."""
    text = weights.where(F.col("feature").startswith("text__"))
    high = text.orderBy(F.desc("weight"), "token").limit(n).withColumn("side", F.lit("positive"))
    low = text.orderBy("weight", "token").limit(n).withColumn("side", F.lit("negative"))
    return high.unionByName(low).select("side", "token", "weight")


# ---- jobs --------------------------------------------------------------------------------

def train_and_hold_out(prepared: DataFrame, key: str = "ad_id", test_size: float = 0.2,
                       model_type: str = "ridge", **options) -> tuple[PriceModel, DataFrame]:
    """Fit on the training part; return the model and the test rows with ``prediction``.

    The split has the exact size, so a table of a few rows can be trained on as well.
    """
    parts = with_exact_split(prepared, key, test_size)
    require_rows(parts.where(~F.col("is_test")), "the split leaves no listing to train on")
    require_rows(parts.where("is_test"), "the split leaves no listing to test on")
    model = fit_price_model(parts.where(~F.col("is_test")).drop("is_test"), model_type, **options)
    return model, model.predict(parts.where(F.col("is_test")).drop("is_test"))
