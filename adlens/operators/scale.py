"""Scalers, encoders and the tabular feature table.

Each scaler reads one aggregate row and broadcasts that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.operators.ranking import ordered_positions


def _with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(one_row))


def standard_scale(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    fit = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    scaled = (F.col(column) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return _with_row(df, fit).withColumn(name or column, scaled).drop("_m", "_s")


def fit_log1p_minmax(df: DataFrame, column: str) -> DataFrame:
    """One row ``lo, hi``: range of ``log1p``; a constant column gets a tiny range."""
    logged = F.log1p(column)
    return df.agg(F.min(logged).alias("lo"), F.max(logged).alias("hi")).select(
        "lo", F.when(F.col("lo") == F.col("hi"), F.col("hi") + 1e-9).otherwise(F.col("hi")).alias("hi"))


def log1p_minmax(df: DataFrame, column: str, fit: DataFrame, name: str | None = None) -> DataFrame:
    scaled = (F.log1p(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return _with_row(df, fit).withColumn(name or column, scaled).drop("lo", "hi")


def log1p_minmax_inverse(df: DataFrame, column: str, fit: DataFrame, name: str | None = None) -> DataFrame:
    back = F.expm1(F.col(column) * (F.col("hi") - F.col("lo")) + F.col("lo"))
    return _with_row(df, fit).withColumn(name or column, back).drop("lo", "hi")


def minmax(df: DataFrame, columns: dict[str, Column], constant: float | None = None) -> DataFrame:
    """Scale each expression to 0..1 under its name; a constant column gives ``constant``."""
    named = df.withColumns({f"_v_{n}": c for n, c in columns.items()})
    fit = named.agg(*[f(f"_v_{n}").alias(f"_{k}_{n}") for n in columns
                      for k, f in (("lo", F.min), ("hi", F.max))])
    scaled = {}
    for n in columns:
        lo, hi, v = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(f"_v_{n}")
        scaled[n] = F.when(hi > lo, (v - lo) / (hi - lo)).when(
            v.isNotNull(), F.lit(constant).cast("double"))
    return _with_row(named, fit).withColumns(scaled).select(
        *[c for c in df.columns if c not in columns], *columns)


def minmax_timestamp(df: DataFrame, column: str, name: str) -> DataFrame:
    """Min-max of a timestamp on its microseconds; NULL if all are equal."""
    return minmax(df, {name: F.unix_micros(F.col(column).cast("timestamp")).cast("double")})


def minmax_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``num_<column>``: missing as 0, then min-max; a constant column becomes 0."""
    return minmax(df, {f"num_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns},
                  constant=0.0)


# More distinct values than this are no levels.
MOST_LEVELS = 10_000


def levels(df: DataFrame, columns: Sequence[str], fill: str = "missing", most: int = MOST_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct values of each column, in one pass; they become column names, so the caller sees them all.

    With more than ``most`` in all columns together nothing is collected and an error says so: give the levels of such a
    column, or use ``label_encode``.
    """
    found = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias("v")) for c in columns])).alias("e"))
        .select("e.*").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} distinct values in {', '.join(columns)}")
    return {c: sorted(r["v"] for r in found if r["c"] == c) for c in columns}


def one_hot(df: DataFrame, known: dict[str, list[str]], fill: str = "missing") -> DataFrame:
    """One 0/1 column ``<column>_<level>`` per known level; an unknown level is all zeros."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(fill)) for c in known}
    return df.withColumns({f"{c}_{v}": (filled[c] == v).cast("int")
                           for c, values in known.items() for v in values})


def label_encode(df: DataFrame, column: str, name: str, fill: str = "Unknown") -> DataFrame:
    """Codes 0, 1, … in sorted order of the values, missing ones as ``fill``.

    The code table is joined as Spark sees fit: broadcast below its own size limit in bytes, else by value with
    frequent values split.
    """
    filled = df.withColumn("_level", F.coalesce(F.col(column).cast("string"), F.lit(fill)))
    codes = ordered_positions(filled.select("_level").distinct(), ["_level"], name=name)
    return filled.join(codes, "_level").drop("_level")


def tabular_features(df: DataFrame, key: Sequence[str], binary: Sequence[str], numeric: Sequence[str],
                     known_levels: dict[str, list[str]]) -> DataFrame:
    """Keys, 0/1 flags, scaled numbers and one-hot levels, all from the same row."""
    wide = one_hot(minmax_numeric(df, numeric), known_levels)
    return wide.select(*key, *[F.col(c).cast("int").alias(c) for c in binary],
                       *[f"num_{c}" for c in numeric],
                       *[F.col(f"`{c}_{v}`") for c, values in known_levels.items() for v in values])
