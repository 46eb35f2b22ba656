"""Listings to the prepared data set: priced rows, combined text, numeric time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.text import combined_text
from adlens.operators.ingest import missing_columns
from adlens.operators.quantiles import median_by

PREPARED_COLUMNS = ["text", "timestamp_val", "price_amount"]


def priced_rows(df: DataFrame, price: str = "price_amount") -> DataFrame:
    return df.where(F.col(price).isNotNull())


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Seconds since 1970 as DOUBLE, from a timestamp, ISO text or epoch milliseconds."""
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, T.StringType):
        c = F.try_to_timestamp(c)
    elif isinstance(dtype, T.NumericType):
        return c.cast("double") / 1000.0
    return F.unix_micros(c.cast("timestamp")) / 1e6


def fill_with_median(df: DataFrame, source: Column, name: str, exact: bool = True) -> DataFrame:
    """``source`` as column ``name``, missing values replaced by the median of the present ones.

    The median is one number and part of the fitted state, so it is computed here, once.  Kept
    lazy it would be found again by every action on the prepared rows.
    """
    valued = df.withColumn(name, source)
    middle = median_by(valued.select(name), name, exact=exact).first()["median"]
    return valued.withColumn(name, F.coalesce(name, F.lit(middle).cast("double")))


def prepare_listings(df: DataFrame, title_col: str = "heading", time_col: str = "timestamp_dt",
                     exact_median: bool = True) -> DataFrame:
    """Priced rows with ``text`` (title and place) and ``timestamp_val`` (seconds, gaps filled)."""
    clean = priced_rows(df).withColumn("text", combined_text(F.col(title_col), F.col("location")))
    return fill_with_median(clean, epoch_seconds(clean, time_col), "timestamp_val", exact_median)


def ensure_prepared(df: DataFrame, **options) -> DataFrame:
    """``df`` itself if it already has the prepared columns, else its prepared form."""
    return df if not missing_columns(df, PREPARED_COLUMNS) else prepare_listings(df, **options)
