"""Word vocabulary, token ids and padded sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.constants import PAD_TOKEN, UNK_TOKEN
from adlens.functions.text import normalise_title, words
from adlens.operators.ranking import ordered_positions

PAD_ID, UNK_ID, FIRST_WORD_ID = 0, 1, 2


def title_words(text: Column) -> Column:
    return words(normalise_title(text))


def fit_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``word, token_id``: padding 0, unknown 1, then the distinct words in code-point order.

    The ids come from positions in a range-partitioned order, so no task sorts the whole list.
    """
    found = df.select(F.explode(title_words(F.col(text))).alias("word")).distinct()
    ids = ordered_positions(found, ["word"]).select(
        "word", (F.col("position") + FIRST_WORD_ID).alias("token_id"))
    special = df.sparkSession.range(1).select(F.inline(F.array(
        F.struct(F.lit(PAD_TOKEN).alias("word"), F.lit(PAD_ID).cast("bigint").alias("token_id")),
        F.struct(F.lit(UNK_TOKEN).alias("word"), F.lit(UNK_ID).cast("bigint").alias("token_id")))))
    return special.unionByName(ids)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return (df.select(F.explode(title_words(F.col(text))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word"))


def _with_ids(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Look up ``word``: broadcast if the vocabulary is below Spark's size limit in bytes, else by word."""
    return tokens.join(vocabulary, "word", "left").withColumn("token_id", F.coalesce("token_id", F.lit(UNK_ID)))


def _content(text: str, normalise: bool) -> Column:
    return words(normalise_title(F.col(text)) if normalise else F.lower(text))


def token_rows(df: DataFrame, keys: Sequence[str], text: str, vocabulary: DataFrame,
               normalise: bool = False) -> DataFrame:
    """``keys, pos, token_id``: one row per word, unknown words as 1.

    A vocabulary that Spark broadcasts (by its size in bytes) leaves the tokens where they are; beyond that
    the frequent words are split by the adaptive skew join.  Texts without words give no row.
    """
    tokens = df.select(*keys, F.posexplode(_content(text, normalise)).alias("pos", "word"))
    return _with_ids(tokens, vocabulary).select(*keys, "pos", "token_id")


def encode_tokens(df: DataFrame, keys: Sequence[str], text: str, vocabulary: DataFrame,
                  normalise: bool = False) -> DataFrame:
    """``keys, ids``: the token ids of each text in order; ``keys`` must identify a row.

    The texts are placed by key before they are split into words, so with a broadcast vocabulary
    the lists are put together where the words are.
    """
    placed = df.select(*keys, text).repartition(*keys)
    tokens = placed.select(*keys, F.posexplode_outer(_content(text, normalise)).alias("pos", "word"))
    lists = _with_ids(tokens, vocabulary).groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id")))).alias("_t"))
    return lists.select(*keys, F.transform("_t", lambda t: t["token_id"]).alias("ids"))


def pad_sequences(df: DataFrame, ids: str = "ids", split: Sequence[str] = (),
                  max_len: int | None = None) -> DataFrame:
    """Pad ``ids`` to the longest list, overall or per split.

    ``max_len`` is a check, not a cut: a longer list is an error.
    """
    longest = df.groupBy(*split).agg(F.max(F.size(ids)).alias("_m"))
    if split:
        side = df.join(longest, list(split))
    else:
        side = df.crossJoin(F.broadcast(longest))
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(PAD_ID).cast("bigint"),
                                                 F.col("_m") - F.size(ids)))
    if max_len is not None:
        padded = F.when(F.col("_m") > max_len, F.raise_error(F.concat(
            F.lit("sequence length "), F.col("_m").cast("string"),
            F.lit(f" exceeds maximum length {max_len}"))).cast("array<bigint>")).otherwise(padded)
    return side.withColumn(ids, padded).drop("_m")

