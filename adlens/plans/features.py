"""Queries on text features, scalers, encoders, models, the frozen network and streams."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from adlens.constants import (BINARY_FEATURES, CATEGORICAL_FEATURES, EMBEDDING_DIM, HIDDEN_DIMS, RIDGE_ALPHA, SEED,
                              MAX_PAGES, TFIDF_TERMS)
from adlens.operators import merge, models, neural, prepare, scale, stages, tfidf, vocab
from adlens.plans.analysis import histogram_sql, rounded, scope
from adlens.plans.jobs import evaluate_price_model, train_price_model
from adlens.plans.registry import D, L, P, S, query
from adlens.plans.search import _PER_PAGE
from adlens.session import scratch_path
from adlens.sources import fixtures, tables
from adlens.sources.fixtures import listings
from adlens.streaming import jobs as streams

# ---- words -------------------------------------------------------------------------------

_DOC_WORDS = """W AS (SELECT doc_id, unnest(list_filter(string_split(
    trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS word FROM documents)"""
_VOCAB = f"""{_DOC_WORDS}, V AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS token_id
    FROM (SELECT DISTINCT word FROM W))"""
# Words of the raw text: lower-case, split at any whitespace.
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"


def _documents(spark, d):
    return tables.read_table(spark, d, "documents")


def document_vocabulary(spark, d):
    """Vocabulary of the documents, written once like any fitted state."""
    return fixtures.landed_table(spark, d, "vocabulary",
                                 lambda: vocab.fit_vocabulary(_documents(spark, d), "text"))


@query("vocabulary", f"""WITH {_VOCAB} SELECT word, token_id FROM V
  UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1""")
def vocabulary(spark, d):
    return vocab.fit_vocabulary(_documents(spark, d), "text")


@query("word_counts", f"WITH {_DOC_WORDS} SELECT word, count(*) AS n FROM W GROUP BY 1")
def word_counts(spark, d):
    return vocab.word_counts(_documents(spark, d), "text")


_ENCODED = f"""WITH {_VOCAB}, X AS (SELECT doc_id, unnest({_TOKENS}) AS word,
    generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM documents),
  E AS (SELECT doc_id, pos, coalesce(token_id, 1) AS token_id FROM X LEFT JOIN V USING (word)),
  I AS (SELECT d.doc_id, count(pos) AS n_ids, coalesce(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos), '') AS ids
    FROM documents d LEFT JOIN E ON E.doc_id = d.doc_id GROUP BY 1)"""


@query("encode_tokens", f"{_ENCODED} SELECT doc_id, n_ids, md5(ids) AS digest FROM I")
def encode_tokens(spark, d):
    ids = vocab.encode_tokens(_documents(spark, d), ["doc_id"], "text", document_vocabulary(spark, d))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                      F.md5(F.array_join(F.transform("ids", lambda t: t.cast("string")), " ")).alias("digest"))


@query("pad_sequences", f"""{_ENCODED}, M AS (SELECT max(n_ids) AS m FROM I)
  SELECT doc_id, m AS padded_to, n_ids AS first_pad, md5(trim(concat(ids, repeat(' 0', CAST(m - n_ids AS INT))))) AS digest
  FROM I, M""")
def pad_sequences(spark, d):
    ids = vocab.encode_tokens(_documents(spark, d), ["doc_id"], "text", document_vocabulary(spark, d))
    padded = vocab.pad_sequences(ids)
    pad_from = F.array_position("ids", F.lit(0).cast("bigint"))
    return padded.select(
        "doc_id", F.size("ids").cast("bigint").alias("padded_to"),
        F.when(pad_from > 0, pad_from - 1).otherwise(F.size("ids")).cast("bigint").alias("first_pad"),
        F.md5(F.array_join(F.transform("ids", lambda t: t.cast("string")), " ")).alias("digest"))


def _tfidf_sql(table: str, key: str, column: str, limit: int) -> str:
    return f"""WITH T AS (SELECT {key}, regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]{{2,}}') AS w FROM {table}),
  G AS (SELECT {key}, unnest(w) AS term FROM T UNION ALL
    SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM T WHERE len(w) > 1),
  C AS (SELECT {key}, term, count(*) AS tf FROM G GROUP BY ALL),
  K AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM C GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}),
  R AS (SELECT {key}, C.term, C.tf * (ln((1.0 + (SELECT count(*) FROM T)) / (1 + K.df)) + 1) AS w FROM C JOIN K USING (term))
  SELECT {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 6) AS weight FROM R"""


@query("tfidf_terms", _tfidf_sql("part", "p_partkey", "p_name", TFIDF_TERMS))
def tfidf_terms(spark, d):
    return rounded(tfidf.tfidf_terms(tables.read_table(spark, d, "part"), "p_partkey", "p_name"), 6, "weight")


@query("tfidf_documents", _tfidf_sql("documents", "doc_id", "text", TFIDF_TERMS))
def tfidf_documents(spark, d):
    return rounded(tfidf.tfidf_terms(_documents(spark, d), "doc_id", "text"), 6, "weight")


# ---- scalers and encoders ----------------------------------------------------------------

KEYS = ["ad_id", "seq_part", "seq_supp"]
_KEYS = ", ".join(KEYS)


@query("standard_scale", f"""{L}, C AS (SELECT {_KEYS}, epoch_ms(timestamp_dt) / 1000.0 AS secs FROM L),
  F AS (SELECT avg(secs) AS m, stddev_pop(secs) AS s FROM C) SELECT {_KEYS}, round((secs - m) / s, 6) AS scaled FROM C, F""")
def standard_scale(spark, d):
    df = listings(spark, d)
    df = df.withColumn("secs", prepare.epoch_seconds(df, "timestamp_dt"))
    return rounded(scale.standard_scale(df, "secs", "scaled").select(*KEYS, "scaled"), 6, "scaled")


@query("log1p_minmax", f"""{S}, F AS (SELECT min(log_price) AS lo, max(log_price) AS hi FROM S)
  SELECT {_KEYS}, round((log_price - lo) / (hi - lo), 6) AS scaled FROM S, F""")
def log1p_minmax(spark, d):
    df = scope(spark, d)
    fit = scale.fit_log1p_minmax(df, "price_amount")
    return rounded(scale.log1p_minmax(df, "price_amount", fit, "scaled").select(*KEYS, "scaled"), 6, "scaled")


@query("log1p_minmax_inverse", f"{S} SELECT {_KEYS}, round(price_amount, 4) AS back FROM S")
def log1p_minmax_inverse(spark, d):
    df = scope(spark, d)
    fit = scale.fit_log1p_minmax(df, "price_amount")
    scaled = scale.log1p_minmax(df, "price_amount", fit, "scaled")
    return rounded(scale.log1p_minmax_inverse(scaled, "scaled", fit, "back").select(*KEYS, "back"), 4, "back")


def _reloaded(spark, stages, df):
    """The stages fitted on ``df``, saved, and read again."""
    path = scratch_path(spark, "stages")
    Pipeline(stages=stages).fit(df).write().overwrite().save(path)
    return PipelineModel.load(path)


@query("saved_scalers", f"""{S}, F AS (SELECT min(log_price) AS lo, max(log_price) AS hi, min(num_images) AS a, max(num_images) AS b FROM S)
  SELECT {_KEYS}, round((log_price - lo) / (hi - lo), 6) AS scaled, round(price_amount, 4) AS back,
    round((num_images - a) / CAST(b - a AS DOUBLE), 6) AS num_num_images, CAST(trade_type = 'Til salgs' AS INT) AS for_sale FROM S, F""")
def saved_scalers(spark, d):
    """Scalers and one-hot levels as pipeline stages, saved and read again; prices scaled and turned back."""
    df = scope(spark, d)
    model = _reloaded(spark, [stages.LogMinMaxScaler(inputCol="price_amount", outputCol="scaled"), stages.MinMaxColumns(inputCols=["num_images"]),
                              stages.OneHotLevels(inputCols=["trade_type"])], df)
    back = model.stages[0].untransform(model.transform(df), "scaled", "back")
    return rounded(rounded(back.select(*KEYS, "scaled", "back", "num_num_images", F.col("`trade_type_Til salgs`").alias("for_sale")), 6, "scaled", "num_num_images"), 4, "back")


@query("saved_vocabulary", f"""WITH W AS (SELECT p_partkey, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT p_partkey,
    list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM part)),
  V AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS token_id FROM (SELECT DISTINCT word FROM W))
  SELECT p_partkey, string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM W JOIN V USING (word) GROUP BY 1""")
def saved_vocabulary(spark, d):
    """The vocabulary of all part names as a pipeline stage, saved and read again."""
    parts = tables.read_table(spark, d, "part").select("p_partkey", "p_name")
    model = _reloaded(spark, [stages.TitleVocabulary(inputCol="p_name", outputCol="ids", keyCols=["p_partkey"])], parts)
    return model.transform(parts).select("p_partkey", F.array_join(F.transform("ids", lambda t: t.cast("string")), " ").alias("ids"))


@query("minmax_timestamp", """WITH M AS (SELECT epoch_us(min(o_orderdate)) AS a, epoch_us(max(o_orderdate)) AS b FROM orders)
  SELECT o_orderkey, round((epoch_us(o_orderdate) - a) / CAST(b - a AS DOUBLE), 6) AS scaled FROM orders, M""")
def minmax_timestamp(spark, d):
    orders = tables.read_table(spark, d, "orders")
    return rounded(scale.minmax_timestamp(orders, "o_orderdate", "scaled").select("o_orderkey", "scaled"), 6, "scaled")


_NUM = ["coordinates_lat", "coordinates_lon", "num_images"]


def _num_sql(c: str) -> str:
    x = f"coalesce(CAST({c} AS DOUBLE), 0)"
    return (f"round(({x} - (SELECT min({x}) FROM L)) / (SELECT max({x}) - min({x}) FROM L), 6) AS num_{c}")


_NUM_SQL = ", ".join(_num_sql(c) for c in _NUM)


@query("minmax_numeric", f"{L} SELECT {_KEYS}, {_NUM_SQL} FROM L")
def minmax_numeric(spark, d):
    names = [f"num_{c}" for c in _NUM]
    return rounded(scale.minmax_numeric(listings(spark, d), _NUM).select(*KEYS, *names), 6, *names)


_TRADE = ["Gis bort", "Til salgs", "Ønskes kjøpt"]
_BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))
_ONE_HOT_SQL = ", ".join([f"CAST(trade_type = '{t}' AS INT) AS \"trade_type_{t}\"" for t in _TRADE]
                         + [f"CAST(brand = '{b}' AS INT) AS \"brand_{b}\"" for b in _BRANDS])


def _levels(df):
    return scale.levels(df, CATEGORICAL_FEATURES)


@query("one_hot", f"{L} SELECT {_KEYS}, {_ONE_HOT_SQL} FROM L")
def one_hot(spark, d):
    df = listings(spark, d)
    known = _levels(df)
    return scale.one_hot(df, known).select(*KEYS, *[F.col(f"`{c}_{v}`") for c, vs in known.items() for v in vs])


_BINARY_SQL = ", ".join(f"CAST({c} AS INT) AS {c}" for c in BINARY_FEATURES)


@query("tabular_features", f"{L} SELECT {_KEYS}, {_BINARY_SQL}, {_NUM_SQL}, {_ONE_HOT_SQL} FROM L")
def tabular_features(spark, d):
    df = listings(spark, d)
    wide = scale.tabular_features(df, KEYS, BINARY_FEATURES, _NUM, _levels(df))
    return rounded(wide, 6, *[f"num_{c}" for c in _NUM])


# ---- models ------------------------------------------------------------------------------

def prepared(spark, d):
    """Prepared listings, one row per ad, written once: several fits read them."""
    return fixtures.landed_table(spark, d, "prepared", lambda: prepare.prepare_listings(
        fixtures.first_listings(spark, d)))


def _train_test(spark, d):
    parts = models.with_split(prepared(spark, d), "ad_id")
    return parts.where(~F.col("is_test")), parts.where(F.col("is_test"))


# Two numeric features, so that the penalised normal equations can be solved in SQL.
_RIDGE = f"""{S}, A AS (SELECT CAST(num_images AS DOUBLE) AS x, coordinates_lat AS z, CAST(price_amount AS DOUBLE) AS y FROM S),
  M AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM A),
  Q AS (SELECT sum((x - mx) * (x - mx)) + {RIDGE_ALPHA} AS xx, sum((z - mz) * (z - mz)) + {RIDGE_ALPHA} AS zz, sum((x - mx) * (z - mz)) AS xz,
    sum((x - mx) * (y - my)) AS xy, sum((z - mz) * (y - my)) AS zy, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my FROM A, M),
  W AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS wx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS wz, mx, mz, my FROM Q)"""


def _numeric_ridge(spark, d):
    rows = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(scope(spark, d).select(
        *KEYS, F.col("num_images").cast("double").alias("x"), F.col("coordinates_lat").alias("z"), "price_amount"))
    return rows, models.ridge_estimator(rows).fit(rows)


@query("ridge_fit", f"""{_RIDGE} SELECT 'num_images' AS feature, round(wx, 3) AS weight FROM W UNION ALL SELECT 'coordinates_lat', round(wz, 3) FROM W
  UNION ALL SELECT 'intercept', round(my - wx * mx - wz * mz, 2) FROM W""")
def ridge_fit(spark, d):
    _, fit = _numeric_ridge(spark, d)
    weights = [("num_images", round(float(fit.coefficients[0]), 3)), ("coordinates_lat", round(float(fit.coefficients[1]), 3)),
               ("intercept", round(fit.intercept, 2))]
    return spark.createDataFrame(weights, "feature STRING, weight DOUBLE")


@query("ridge_numeric_predictions", f"""{_RIDGE} SELECT {_KEYS}, round(my + wx * (num_images - mx) + wz * (coordinates_lat - mz), 2) AS prediction FROM S, W""")
def ridge_numeric_predictions(spark, d):
    rows, fit = _numeric_ridge(spark, d)
    return fit.transform(rows).select(*KEYS, F.round("prediction", 2).alias("prediction"))


@query("gbt_fit")
def gbt_fit(spark, d):
    train, _ = _train_test(spark, d)
    return models.feature_weights(models.fit_price_model(train, "gbt"), spark)


@query("gbt_early_stop")
def gbt_early_stop(spark, d):
    train, test = _train_test(spark, d)
    inner = models.with_split(train, "ad_id", 0.2, SEED + 1, "is_validation")
    model = models.fit_price_model(inner, "gbt", validation="is_validation")
    return models.regression_metrics(model.predict(test))


@query("predictions")
def predictions(spark, d):
    train, test = _train_test(spark, d)
    return models.fit_price_model(train, "ridge").predict(test).select("ad_id", "price_amount", "prediction")


@query("holdout_with_predictions")
def holdout_with_predictions(spark, d):
    path = scratch_path(spark, "model")
    train_price_model(prepared(spark, d), path)
    return spark.read.parquet(f"{path}.holdout")


@query("evaluate_saved_model")
def evaluate_saved_model(spark, d):
    path = scratch_path(spark, "model")
    train_price_model(prepared(spark, d), path)
    metrics, _ = evaluate_price_model(path, prepared(spark, d))
    return metrics


@query("sample_predictions")
def sample_predictions(spark, d):
    train, test = _train_test(spark, d)
    return models.sample_predictions(models.fit_price_model(train, "ridge").predict(test))


@query("feature_weights")
def feature_weights(spark, d):
    train, _ = _train_test(spark, d)
    return models.feature_weights(models.fit_price_model(train, "ridge"), spark)


@query("top_tokens")
def top_tokens(spark, d):
    train, _ = _train_test(spark, d)
    return models.top_tokens(models.feature_weights(models.fit_price_model(train, "ridge"), spark))


# A fixed linear predictor, so that the metrics have an exact answer in SQL.
_GUESS = "20000.0 + 1500.0 * num_images + 3000.0 * CAST(has_shipping AS INT)"


def _guessed(spark, d):
    return scope(spark, d).withColumn("prediction", F.expr(_GUESS).cast("double"))


def _metrics_sql(y: str, p: str, source: str) -> str:
    return f"""round(avg(abs({y} - {p})), 4) AS mae, round(sqrt(avg(pow({y} - {p}, 2))), 4) AS rmse,
    round(1 - sum(pow({y} - {p}, 2)) / (count(*) * var_pop({y})), 6) AS r2, count(*) AS n FROM {source}"""


@query("regression_metrics", f"{S}, G AS (SELECT *, CAST({_GUESS} AS DOUBLE) AS prediction FROM S) SELECT "
       + _metrics_sql("price_amount", "prediction", "G"))
def regression_metrics(spark, d):
    return rounded(rounded(models.regression_metrics(_guessed(spark, d)), 4, "mae", "rmse"), 6, "r2")


@query("residual_histogram", histogram_sql(f"""{S}, E AS (SELECT price_amount - CAST({_GUESS} AS DOUBLE) AS residual FROM S)""",
                                           "E", "residual", 50))
def residual_histogram(spark, d):
    return rounded(models.residual_histogram(_guessed(spark, d), "price_amount", "prediction"), 7, "bin_start", "bin_end")


def _two_spaces(spark, d):
    """Scaled target, a fixed guess in scaled space, and both back in price space."""
    df = scope(spark, d)
    fit = scale.fit_log1p_minmax(df, "price_amount")
    scaled = scale.log1p_minmax(df, "price_amount", fit, "y_scaled").withColumn(
        "p_scaled", 0.8 + 0.01 * F.col("num_images"))
    back = scale.log1p_minmax_inverse(scaled, "p_scaled", fit, "p_price")
    return scale.log1p_minmax_inverse(back, "y_scaled", fit, "y_price")


_TWO = f"""{S}, F AS (SELECT min(log_price) AS lo, max(log_price) AS hi FROM S),
  G AS (SELECT (log_price - lo) / (hi - lo) AS ys, 0.8::DOUBLE + 0.01::DOUBLE * num_images AS ps, price_amount AS yp,
    exp((0.8::DOUBLE + 0.01::DOUBLE * num_images) * (hi - lo) + lo) - 1 AS pp FROM S, F)"""


@query("metrics_two_spaces", f"""{_TWO} SELECT 'scaled' AS space, {_metrics_sql('ys', 'ps', 'G')}
  UNION ALL SELECT 'price' AS space, {_metrics_sql('yp', 'pp', 'G')}""")
def metrics_two_spaces(spark, d):
    df = _two_spaces(spark, d)
    scaled = models.regression_metrics(df, "y_scaled", "p_scaled").withColumn("space", F.lit("scaled"))
    price = models.regression_metrics(df, "y_price", "p_price").withColumn("space", F.lit("price"))
    return rounded(rounded(scaled.unionByName(price), 4, "mae", "rmse"), 6, "r2")


# ---- network parts -----------------------------------------------------------------------

_DIM = 8


def _conversation_words(table: str = "conversations") -> str:
    return f"""CW AS (SELECT conv_id, turn, unnest({_TOKENS}) AS word,
    generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM {table}),
  CN AS (SELECT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '),
    lambda w: w <> '')) AS word FROM {table}),
  CV AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS token_id FROM (SELECT DISTINCT word FROM CN)),
  CT AS (SELECT conv_id, turn, pos, coalesce(token_id, 1) AS token_id FROM CW LEFT JOIN CV USING (word))"""


def _encoded_place(i: int) -> str:
    angle = f"pos * {math.exp((i - i % 2) * (-math.log(10_000.0) / _DIM))!r}::DOUBLE"
    wave = f"0.5::DOUBLE * sin(token_id * 0.7::DOUBLE + {float(i)} * 1.3::DOUBLE)"
    return f"round({wave} + {'sin' if i % 2 == 0 else 'cos'}({angle}), 5) AS e{i}"


@query("position_encode", f"""WITH {_conversation_words()} SELECT conv_id, turn, pos, token_id,
  {", ".join(_encoded_place(i) for i in range(_DIM))} FROM CT""")
def position_encode(spark, d):
    talk = tables.read_table(spark, d, "conversations")
    words = fixtures.landed_table(spark, d, "talk-vocabulary", lambda: vocab.fit_vocabulary(talk, "text"))
    tokens = vocab.token_rows(talk, ["conv_id", "turn"], "text", words)
    encoded = neural.position_encode(tokens, neural.frozen_embeddings(words, _DIM), _DIM)
    return encoded.select("conv_id", "turn", "pos", "token_id",
                          *[F.round(F.col("vec")[i], 5).alias(f"e{i}") for i in range(_DIM)])


_SCORE = [round(math.sin(0.9 * i), 6) for i in range(64)]
_DOT = " + ".join(f"embedding[{i + 1}]::DOUBLE * {w}::DOUBLE" for i, w in enumerate(_SCORE))


def _pool_sql(weight: str) -> str:
    return f"""WITH A AS (SELECT label, embedding, {_DOT} AS s FROM embeddings),
  B AS (SELECT label, embedding, {weight} AS w FROM A),
  U AS (SELECT label, w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM B),
  N AS (SELECT label, sum(w) AS z FROM B GROUP BY 1)
  SELECT U.label, CAST(dim AS INT) AS dim, round(sum(x * w) / max(z), 6) AS value FROM U JOIN N ON N.label = U.label GROUP BY ALL"""


def _pool(spark, d, uniform):
    pooled = neural.attention_pool(tables.read_table(spark, d, "embeddings"), ["label"], "embedding", _SCORE, uniform)
    return rounded(pooled.select("label", F.posexplode("pooled").alias("dim", "value")), 6, "value")


@query("attention_pool", _pool_sql("exp(s - max(s) OVER (PARTITION BY label))"))
def attention_pool(spark, d):
    return _pool(spark, d, False)


@query("mean_pool", _pool_sql("1.0::DOUBLE"))
def mean_pool(spark, d):
    return _pool(spark, d, True)


_T2V_LINEAR, _T2V_BIAS = [0.5, -0.25], 0.1
_T2V_WAVES = [[round(math.sin(i + 0.5), 6), round(math.cos(i + 0.5), 6)] for i in range(7)]
_T2V_SHIFTS = [round(0.1 * i, 6) for i in range(7)]


def _affine(weights, bias) -> str:
    return f"({bias}::DOUBLE + a * {weights[0]}::DOUBLE + b * {weights[1]}::DOUBLE)"


@query("time2vec", f"""WITH M AS (SELECT epoch_us(min(o_orderdate)) AS lo, epoch_us(max(o_orderdate)) AS hi FROM orders),
  X AS (SELECT o_orderkey, (epoch_us(o_orderdate) - lo) / CAST(hi - lo AS DOUBLE) AS a, hour(o_orderdate) / 24.0::DOUBLE
    + isodow(o_orderdate) / 7.0::DOUBLE AS b FROM orders, M)
  SELECT o_orderkey, round({_affine(_T2V_LINEAR, _T2V_BIAS)}, 6) AS t0,
    {", ".join(f"round(sin({_affine(w, s)}), 6) AS t{i + 1}" for i, (w, s) in enumerate(zip(_T2V_WAVES, _T2V_SHIFTS)))} FROM X""")
def time2vec(spark, d):
    orders = scale.minmax_timestamp(tables.read_table(spark, d, "orders"), "o_orderdate", "a")
    raw = F.col("o_orderdate")
    timed = orders.withColumn("b", F.hour(raw) / F.lit(24.0) + (F.weekday(raw) + 1) / F.lit(7.0))
    vec = neural.time2vec([F.col("a"), F.col("b")], _T2V_LINEAR, _T2V_BIAS, _T2V_WAVES, _T2V_SHIFTS)
    return timed.select("o_orderkey", vec.alias("v")).select(
        "o_orderkey", *[F.round(F.col("v")[i], 6).alias(f"t{i}") for i in range(8)])


def _network_sql() -> str:
    """The whole network over titles and posting times, weights from the rule."""
    d, dims = EMBEDDING_DIM, [EMBEDDING_DIM, *HIDDEN_DIMS, 1]
    wave = lambda r, c, s: f"0.5 * sin(0.7 * {r} + 1.3 * {c} + {s})"
    place = "CASE WHEN i % 2 = 0 THEN sin(pos * exp(i * {0})) ELSE cos(pos * exp((i - 1) * {0})) END".format(-math.log(10_000.0) / d)
    sql = f"""X AS (SELECT ad_id, pos, coalesce(token_id, 1) AS t FROM E),
  Y AS (SELECT ad_id, list_transform(range({d}), lambda i: {wave("t", "i", "0.0")} + {place}) AS x FROM X),
  R AS (SELECT ad_id, x, list_dot_product(x, list_transform(range({d}), lambda i: {wave("0", "i", "0.3")})) AS s FROM Y),
  Q AS (SELECT ad_id, x, exp(s - max(s) OVER (PARTITION BY ad_id)) AS w FROM R),
  U AS (SELECT ad_id, i, sum(w * x[i + 1]) / sum(w) AS v FROM Q, range({d}) r(i) GROUP BY 1, 2),
  P AS (SELECT ad_id, list(v ORDER BY i) AS p FROM U GROUP BY 1),
  H0 AS (SELECT ad_id, list_transform(range({d}), lambda i: p[i + 1] + CASE WHEN i = 0 THEN a * {wave("0", "0", "0.5")} + b * {wave("1", "0", "0.5")} + 0.1
    ELSE sin(a * {wave("0", "(i - 1)", "0.9")} + b * {wave("1", "(i - 1)", "0.9")}) END) AS h FROM P JOIN TM USING (ad_id))"""
    for n, (rows, cols) in enumerate(zip(dims, dims[1:])):
        sql += f""",
  Z{n} AS (SELECT ad_id, list_transform(range({cols}), lambda c: list_dot_product(h, list_transform(range({rows}), lambda r: {wave("r", "c", repr(0.1 * n))}))) AS h FROM H{n})"""
        if n < len(dims) - 2:
            sql += f""",
  M{n} AS (SELECT ad_id, h, list_avg(h) AS m, sqrt(list_var_pop(h) + 1e-5) AS s FROM Z{n}),
  H{n + 1} AS (SELECT ad_id, list_transform(h, lambda v: CASE WHEN v > m THEN (v - m) / s ELSE 0.01 * (v - m) / s END) AS h FROM M{n})"""
    return sql + f""" SELECT D.ad_id, round(h[1], 6) AS score FROM D LEFT JOIN Z{len(dims) - 2} USING (ad_id)"""


@query("score_frozen_network", f"""{D}, TW AS (SELECT ad_id, heading, CAST(epoch(CAST(timestamp_dt AS TIMESTAMP)) AS DOUBLE) AS s FROM D),
  TR AS (SELECT min(s) AS lo, max(s) AS hi FROM TW),
  TM AS (SELECT ad_id, coalesce((s - lo) / (hi - lo), 0) AS a, coalesce((hi - s) / (hi - lo), 0) AS b FROM TW, TR),
  VW AS (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(lower(heading), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS word FROM D),
  V AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS token_id FROM VW),
  TT AS (SELECT ad_id, list_filter(regexp_split_to_array(lower(heading), '\\s+'), lambda w: w <> '') AS w FROM D),
  E AS (SELECT ad_id, pos - 1 AS pos, token_id FROM (SELECT ad_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM TT) LEFT JOIN V USING (word)), {_network_sql()}""")
def score_frozen_network(spark, d):
    """Whole network over the titles and posting times of all ads; the embedding is a table with a row for every word."""
    ads = fixtures.landed_table(spark, d, "titled-ads", lambda: fixtures.first_listings(spark, d, ["heading", "timestamp_dt"]))
    words = fixtures.landed_table(spark, d, "title-vocabulary", lambda: vocab.fit_vocabulary(ads, "heading"))
    network = neural.FrozenNetwork.from_rule(0, EMBEDDING_DIM, 2, HIDDEN_DIMS)
    tokens = vocab.token_rows(ads, ["ad_id"], "heading", words)
    seconds = prepare.epoch_seconds(ads, "timestamp_dt")
    times = scale.minmax(ads.select("ad_id", "timestamp_dt"), {"posted": seconds, "age": -seconds})
    scored = neural.score_pooled_tokens(times, ["ad_id"], tokens, neural.frozen_embeddings(words, EMBEDDING_DIM), network, ["posted", "age"])
    return rounded(scored.select("ad_id", "score"), 6, "score")


# ---- streams -----------------------------------------------------------------------------

@query("stream_dedupe", f"""{P}, F AS (SELECT *, row_number() OVER (PARTITION BY ad_id ORDER BY search_query, position)
    AS rn FROM P) SELECT ad_id, search_query, heading, location, price_amount, is_promoted, num_images,
  CAST(page_no + 1 AS INT) AS page_current, organisation_name FROM F WHERE rn = 1""")
def stream_dedupe(spark, d):
    """The stream gives what ``collect_listings`` gives, row for row."""
    pages = streams.page_stream(spark, fixtures.search_pages_path(spark, d))
    columns = ["search_query", "heading", "location", "price_amount", "is_promoted", "num_images", "page_current", "organisation_name"]
    table = streams.sightings_table(pages, scratch_path(spark, "sightings-table"), columns=columns)
    return streams.merge_sightings(pages, table, "sightings").select("ad_id", *columns)


@query("crawl_progress", f"""{_PER_PAGE}, T AS (SELECT search_query, range_no, max(page) AS last_page, count(*) AS n_pages FROM G
    WHERE n_docs > 0 GROUP BY ALL),
  M AS (SELECT search_query, range_no, CASE WHEN any_value(range_no) = 0 THEN 0 ELSE
    CAST(floor(min(price_amount)) AS BIGINT) END AS price_from FROM P GROUP BY search_query, range_no)
  SELECT T.search_query, T.range_no, M.price_from, T.last_page, CAST(floor(G.page_max) AS BIGINT) AS next_price_from,
    coalesce(floor(G.page_max) > M.price_from, false) AS advanced, CAST(n_pages AS INT) AS n_pages,
    T.last_page >= {MAX_PAGES} OR EXISTS (SELECT 1 FROM E WHERE E.search_query = T.search_query AND E.range_no = T.range_no) AS ended
  FROM T JOIN G ON G.search_query = T.search_query AND G.range_no = T.range_no AND G.page = T.last_page
  JOIN M ON M.search_query = T.search_query AND M.range_no = T.range_no""")
def crawl_progress(spark, d):
    """Cursors and ends of all price ranges, from state kept as the pages land."""
    return streams.crawl_progress(streams.page_stream(spark, fixtures.search_pages_path(spark, d)), "crawl-progress")


@query("merge_first_sightings", f"""{D} SELECT ad_id, search_query, heading, price_amount, seq_part, seq_supp FROM D""")
def merge_first_sightings(spark, d):
    """Three merges into a stored table leave what one batch over all rows gives."""
    columns = ["search_query", "heading", "price_amount", "seq_part", "seq_supp"]
    rows = listings(spark, d).withColumn("price_missing", F.col("price_amount").isNull())
    order = ["search_query", *fixtures.CRAWL_ORDER]
    wanted = rows.select(*dict.fromkeys(["ad_id", *columns, *order]))
    table = merge.MergedTable(spark, scratch_path(spark, "first-sightings"), wanted.schema, ["ad_id"], order, 16)
    for number in range(3):
        table.merge(wanted.where(F.pmod(F.xxhash64("seq_supp"), F.lit(3)) == number), number)
    return table.read().select("ad_id", *columns)


@query("stream_daily_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def stream_daily_counts(spark, d):
    events = tables.read_table(spark, d, "events")
    path = fixtures.landed_path(spark, d, "events", lambda: events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts")).repartition(4, "event_id"))
    stream = spark.readStream.schema("event_id BIGINT, ts TIMESTAMP").parquet(path)
    daily = streams.run_updates(streams.daily_counts_stream(stream, "ts"), "daily", ["day"])
    return daily.select(F.col("day").cast("string").alias("day"), "n")


