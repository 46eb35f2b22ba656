"""Parts of a text-and-time price network with frozen weights, as table operations.

Position encoding, attention pooling and the time encoding are DataFrame expressions.  Scoring
with the whole network runs in ``predict_batch_udf``: Spark partitions and batches the rows, the
small matrix products are numpy.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from adlens.constants import EMBEDDING_DIM, HIDDEN_DIMS, MAX_SEQUENCE
from adlens.operators.vocab import PAD_ID, UNK_ID

# The scoring function travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORE_BAND = 16.0     # width of the score bands of the softmax


def position_vector(pos: Column, dim: int) -> Column:
    """Sinusoidal position encoding: sine in even and cosine in odd places."""
    def place(i: int) -> Column:
        angle = pos * F.lit(math.exp((i - i % 2) * (-math.log(10_000.0) / dim)))
        return F.sin(angle) if i % 2 == 0 else F.cos(angle)
    return F.array(*[place(i) for i in range(dim)])


def frozen_weight(row: Column, place: Column) -> Column:
    """The rule that stands for trained weights in examples and tests: a fixed wave."""
    return F.sin(row * F.lit(0.7) + place * F.lit(1.3)) * F.lit(0.5)


def frozen_embeddings(vocabulary: DataFrame, dim: int) -> DataFrame:
    """``token_id, vec`` from the rule; the padding row is zero."""
    ident = F.col("token_id").cast("double")
    wave = F.array(*[frozen_weight(ident, F.lit(float(i))) for i in range(dim)])
    zero = F.array_repeat(F.lit(0.0), dim)
    return vocabulary.select("token_id", F.when(F.col("token_id") == PAD_ID, zero).otherwise(wave).alias("vec"))


def position_encode(tokens: DataFrame, embeddings: DataFrame, dim: int,
                    encoding: str = "sinusoidal") -> DataFrame:
    """Add ``vec``: the embedding of ``token_id`` plus the encoding of ``pos``.

    A token without a vector of its own gets that of unknown words; every token stays.
    """
    if encoding not in ("sinusoidal", "none"):
        raise ValueError(f"no such position encoding: {encoding!r}")
    unknown = embeddings.where(F.col("token_id") == UNK_ID).agg(F.first("vec").alias("_unknown"))
    joined = tokens.join(embeddings, "token_id", "left").crossJoin(F.broadcast(unknown)) \
        .withColumn("vec", F.coalesce("vec", "_unknown")).drop("_unknown")
    if encoding == "none":
        return joined
    return joined.withColumn("vec", F.zip_with(
        "vec", position_vector(F.col("pos").cast("double"), dim), lambda a, b: a + b))


def attention_pool(df: DataFrame, group: Sequence[str], vector: str, score: Sequence[float],
                   uniform: bool = False, mask: Column | None = None) -> DataFrame:
    """Softmax-weighted mean of the vectors of each group, one row per group with ``pooled``.

    One pass over the rows and no join.  Scores are cut into bands of ``SCORE_BAND``; inside a
    band the exponentials are taken relative to its lower end, so they cannot overflow, and one
    hash aggregate with map-side combine sums them per (group, band).  The few bands of a group
    are then put on the scale of its highest one.  Rows outside ``mask`` (padding) do not count; a group
    of such rows only has a NULL vector.  ``uniform`` gives the plain mean instead.
    """
    group = list(group)
    dim = len(score)
    counted = F.lit(True) if mask is None else mask
    v = F.col(vector)
    parts = [v.getItem(i).cast("double") for i in range(dim)]
    dot = sum((p * F.lit(float(w)) for p, w in zip(parts[1:], score[1:])), parts[0] * F.lit(float(score[0])))
    places = [f"_x{i}" for i in range(dim)]
    band = F.floor(F.col("_s") / SCORE_BAND)
    # Rows that do not count have no score, hence no band and no weight: all their sums are NULL.
    weighted = (df.select(*group, *[p.alias(n) for n, p in zip(places, parts)],
                          F.when(counted, F.lit(0.0) if uniform else dot).alias("_s"))
                .withColumn("_band", band)
                .withColumn("_w", F.exp(F.col("_s") - F.col("_band") * SCORE_BAND)))
    banded = weighted.groupBy(*group, "_band").agg(
        F.sum("_w").alias("_sum"), *[F.sum(F.col(n) * F.col("_w")).alias(n) for n in places])
    top = F.max("_band").over(Window.partitionBy(*group))
    scaled = banded.withColumn("_k", F.exp((F.col("_band") - top) * SCORE_BAND))
    sums = scaled.groupBy(*group).agg(
        F.sum(F.col("_sum") * F.col("_k")).alias("_sum"),
        *[F.sum(F.col(n) * F.col("_k")).alias(n) for n in places])
    return sums.select(*group, F.when(F.col("_sum").isNotNull(), F.array(
        *[F.col(n) / F.col("_sum") for n in places])).alias("pooled"))


def time2vec(inputs: Sequence[Column], linear: Sequence[float], linear_bias: float,
             periodic: Sequence[Sequence[float]], periodic_bias: Sequence[float]) -> Column:
    """One linear term and one sine term per row of ``periodic``, as an array."""
    def affine(weights: Sequence[float], bias: float) -> Column:
        total = F.lit(float(bias))
        for x, w in zip(inputs, weights):
            total = total + x * F.lit(float(w))
        return total
    return F.array(affine(linear, linear_bias),
                   *[F.sin(affine(w, b)) for w, b in zip(periodic, periodic_bias)])


# ---- whole network -----------------------------------------------------------------------

@dataclass
class FrozenNetwork:
    """Weights of the network: embeddings, attention score, time encoding, dense layers."""

    embedding: np.ndarray                       # vocabulary x dim
    score: np.ndarray                           # dim
    time_linear: tuple[np.ndarray, float]       # features, bias
    time_periodic: tuple[np.ndarray, np.ndarray]    # features x (dim - 1), biases
    layers: list[tuple[np.ndarray, np.ndarray]]     # (in x out, out)
    norms: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # scale, shift of each hidden layer

    @classmethod
    def from_table(cls, weights: DataFrame, dim: int = EMBEDDING_DIM, n_time: int = 2,
                   hidden: Sequence[int] = tuple(HIDDEN_DIMS)) -> FrozenNetwork:
        """Weights from rows ``part, row, col, value``.

        Parts: embedding (row = token), score, time_linear, time_linear_bias, time_periodic,
        time_periodic_bias, and for layer i: weight_i, bias_i, scale_i, shift_i.  A network is held whole by
        every task that scores with it, so its table is read whole here.  A missing entry is an error, but for
        the scales (1) and shifts (0).
        """
        parts: dict[str, dict[tuple[int, int], float]] = {}
        for r in weights.select("part", "row", "col", "value").collect():
            parts.setdefault(r["part"], {})[r["row"], r["col"]] = r["value"]

        def block(name: str, rows: int, cols: int, default: float | None = None) -> np.ndarray:
            found = parts.get(name, {})
            if default is None and len(found) != rows * cols:
                raise ValueError(f"{name} has {len(found)} weights and needs {rows * cols}")
            out = np.full((rows, cols), 0.0 if default is None else default)
            for (i, j), value in found.items():
                out[i, j] = value
            return out

        words = 1 + max((i for i, _ in parts.get("embedding", {})), default=-1)
        dims = [dim, *hidden, 1]
        layers = [(block(f"weight_{i}", a, b), block(f"bias_{i}", 1, b)[0]) for i, (a, b) in enumerate(zip(dims, dims[1:]))]
        norms = [(block(f"scale_{i}", 1, b, 1.0)[0], block(f"shift_{i}", 1, b, 0.0)[0]) for i, b in enumerate(hidden)]
        return cls(block("embedding", words, dim), block("score", 1, dim)[0],
                   (block("time_linear", n_time, 1)[:, 0], float(block("time_linear_bias", 1, 1)[0, 0])),
                   (block("time_periodic", n_time, dim - 1), block("time_periodic_bias", 1, dim - 1)[0]), layers, norms)

    @classmethod
    def from_rule(cls, vocab_size: int, dim: int = EMBEDDING_DIM, n_time: int = 2,
                  hidden: Sequence[int] = tuple(HIDDEN_DIMS)) -> FrozenNetwork:
        """Weights from a fixed wave, for examples and tests."""
        def wave(rows: int, cols: int, shift: float) -> np.ndarray:
            r, c = np.arange(rows)[:, None], np.arange(cols)[None, :]
            return 0.5 * np.sin(0.7 * r + 1.3 * c + shift)
        emb = wave(vocab_size, dim, 0.0)
        emb[PAD_ID:PAD_ID + 1] = 0.0
        dims = [dim, *hidden, 1]
        return cls(emb, wave(1, dim, 0.3)[0], (wave(n_time, 1, 0.5)[:, 0], 0.1),
                   (wave(n_time, dim - 1, 0.9), np.zeros(dim - 1)),
                   [(wave(a, b, 0.1 * i), np.zeros(b)) for i, (a, b) in enumerate(zip(dims, dims[1:]))])

    def forward(self, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        return _forward(vars(self), ids, times)


def _forward(net: dict, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``ids`` rows x length, ``times`` rows x features -> one number per row."""
    dim = net["embedding"].shape[1]
    steps = np.arange(ids.shape[1])[:, None]
    freq = np.exp(np.arange(0, dim, 2) * (-math.log(10_000.0) / dim))
    places = np.zeros((ids.shape[1], dim))
    places[:, 0::2] = np.sin(steps * freq)
    places[:, 1::2] = np.cos(steps * freq[: dim // 2])
    x = net["embedding"][ids] + places
    raw = np.where(ids == PAD_ID, -np.inf, x @ net["score"])
    top = raw.max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        weight = np.exp(raw - top)
        weight = weight / weight.sum(axis=1, keepdims=True)
    pooled = (x * weight[:, :, None]).sum(axis=1)
    return _head(net, pooled, times)


def _head(net: dict, pooled: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The layers above the pooled tokens; they are of one size whatever the vocabulary."""
    trend = times @ net["time_linear"][0] + net["time_linear"][1]
    waves = np.sin(times @ net["time_periodic"][0] + net["time_periodic"][1])
    h = pooled + np.concatenate([trend[:, None], waves], axis=1)
    for i, (w, b) in enumerate(net["layers"]):
        h = h @ w + b
        if i < len(net["layers"]) - 1:
            h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
            if net["norms"]:
                h = h * net["norms"][i][0] + net["norms"][i][1]
            h = np.where(h > 0, h, 0.01 * h)
    return h[:, 0]


def score_pooled_tokens(df: DataFrame, keys: Sequence[str], tokens: DataFrame, embeddings: DataFrame, network: FrozenNetwork,
                        times: Sequence[str], length: int = MAX_SEQUENCE, name: str = "score", batch_size: int = 4096) -> DataFrame:
    """Add the network's output to ``df``, whose ``keys`` identify a row; the embedding is a table and grows with the data.

    ``tokens`` has a row ``keys, pos, token_id`` per token, ``embeddings`` has ``token_id, vec``: they are joined by token, and
    the tokens are pooled by Spark.  Only the layers above, of fixed size, go to the tasks (``network.embedding`` is not
    used).  A token without a vector counts as unknown, padding does not count, a position from ``length`` on is an error,
    and a row without tokens has no score.
    """
    keys = list(keys)
    late = F.raise_error(F.lit(f"sequence longer than {length}")).cast("int")
    real = tokens.where(F.col("token_id") != PAD_ID).withColumn("pos", F.when(F.col("pos") >= length, late).otherwise(F.col("pos")))
    pooled = attention_pool(position_encode(real, embeddings, len(network.score)), keys, "vec", network.score.tolist())
    layers = {k: v for k, v in vars(network).items() if k != "embedding"}
    shared = df.sparkSession.sparkContext.broadcast(layers)
    head = _head

    def make():
        net = shared.value

        def run(vectors: np.ndarray, features: np.ndarray) -> np.ndarray:
            return head(net, vectors, features)
        return run

    infer = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size,
                              input_tensor_shapes=[[len(network.score)], [len(times)]])
    inputs = F.array(*[F.coalesce(F.col(t).cast("double"), F.lit(0.0)) for t in times])
    joined = df.join(pooled.withColumnRenamed("pooled", "_pooled"), keys, "left")
    known = F.coalesce("_pooled", F.array_repeat(F.lit(0.0), len(network.score)))
    return joined.withColumn(name, F.when(F.col("_pooled").isNotNull(), infer(known, inputs))).drop("_pooled")


def score_frozen_network(df: DataFrame, network: FrozenNetwork, ids: str, times: Sequence[str],
                         length: int = MAX_SEQUENCE, name: str = "score", batch_size: int = 4096) -> DataFrame:
    """Add the network's output.

    ``ids`` are token lists of at most ``length`` ids; a longer one is an error, and so is an id beyond the
    network's embedding table, which means that vocabulary and network do not belong together.  A list
    without tokens has no score.
    """
    shared = df.sparkSession.sparkContext.broadcast(dict(vars(network)))   # plain arrays
    known = len(network.embedding)

    def make():
        net = shared.value

        def run(tokens: np.ndarray, features: np.ndarray) -> np.ndarray:
            return _forward(net, tokens.astype(int), features)
        return run

    infer = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size,
                              input_tensor_shapes=[[length], [len(times)]])
    foreign = F.raise_error(F.lit(f"token id beyond the {known} rows of the embedding table")).cast("bigint")
    checked = F.transform(ids, lambda t: F.when(t < known, t).otherwise(foreign))
    padded = F.when(F.size(ids) > length, F.raise_error(F.lit(
        f"sequence longer than {length}")).cast("array<bigint>")).otherwise(
        F.concat(checked, F.array_repeat(F.lit(PAD_ID).cast("bigint"), length - F.size(ids))))
    inputs = F.array(*[F.coalesce(F.col(t).cast("double"), F.lit(0.0)) for t in times])
    return df.withColumn(name, F.nanvl(infer(padded, inputs), F.lit(None)))
