"""Reading tables, listing files and landed pages; writing results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.schemas import LISTING_SCHEMA
from adlens.session import ensure_utc


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))


def read_listings_csv(spark: SparkSession, path: str,
                      schema: str | T.StructType = LISTING_SCHEMA) -> DataFrame:
    """Read a listings CSV with a declared schema, so no inference pass is needed.

    Nested columns are stored as JSON text.  ``multiLine`` is on because titles may hold line
    breaks; a writer that produced many part files keeps the read parallel.
    """
    target = _struct(schema)
    stored = T.StructType([
        T.StructField(f.name, T.StringType() if _nested(f) else f.dataType) for f in target])
    raw = (ensure_utc(spark).read.schema(stored).option("header", True)
           .option("multiLine", True).option("escape", '"')
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .csv(path))
    return raw.select(*[
        F.from_json(f.name, f.dataType).alias(f.name) if _nested(f) else F.col(f.name)
        for f in target])


def write_listings_csv(df: DataFrame, path: str) -> None:
    """Write as CSV part files; nested columns become JSON text."""
    flat = df.select(*[
        F.to_json(f.name).alias(f.name) if _nested(f) else F.col(f.name) for f in df.schema])
    (flat.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def scan_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed search pages: ``search_query, range_no, price_from, page, html, fetched_at``."""
    return ensure_utc(spark).read.parquet(path)


def scan_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages landed as one HTML file each: ``url`` (file path) and ``html``."""
    return (ensure_utc(spark).read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")))


def scan_item_pages(spark: SparkSession, path: str,
                    wanted: DataFrame | None = None) -> DataFrame:
    """Landed item pages ``ad_id, html``; ``wanted`` (a table of ad ids) keeps the requested ones."""
    pages = ensure_utc(spark).read.parquet(path)
    return pages if wanted is None else pages.join(wanted, "ad_id", "left_semi")


def combine_frames(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack frames whose columns differ; columns a frame lacks become NULL."""
    frames = list(frames)
    if not frames:
        raise ValueError("no frames to combine")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


class EmptyInputError(ValueError):
    """Raised before an expensive step when there is nothing to work on."""


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Return ``df``, or raise if it has no row.  Reads at most one row."""
    if df.isEmpty():
        raise EmptyInputError(message)
    return df


def present_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that exist in ``df``, in the order asked for."""
    have = set(df.columns)
    return [n for n in names if n in have]
