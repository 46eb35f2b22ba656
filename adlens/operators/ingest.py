"""Combining and de-duplicating landed rows, and the rules of the crawl."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], sequence: Column,
               columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the smallest ``sequence``.

    ``min_by`` combines on the map side, so a key with very many copies ships one row per task.
    NULL keys form one group.  ``sequence`` must be unique for a fixed answer.  ``columns`` names what
    is wanted besides the keys: the optimizer cannot look into the packed row, so only those are shipped.
    """
    wanted = [c for c in df.columns if columns is None or c in set(columns) or c in set(keys)]
    rest = [c for c in wanted if c not in set(keys)]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), sequence).alias("_row"))
    return first.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in wanted])


def without_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    return df.join(other, key, "left_anti")


def keep_where_in(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``values``."""
    return df.join(values, key, "left_semi")


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def pages_until_empty(pages: DataFrame, crawl: Sequence[str], max_pages: int | None = None) -> DataFrame:
    """Pages of each crawl before its first empty page; with ``max_pages`` no later ones than that.

    ``pages`` has one row per page with ``page`` and ``n_rows``.  The row counts usually come from
    parsing; placing them by page first lets both uses below read the same exchange, so the pages
    are parsed once.
    """
    if max_pages is not None:
        pages = pages.where(F.col("page") <= max_pages)
    pages = pages.repartition(*crawl, "page")
    first_empty = pages.groupBy(*crawl).agg(
        F.min(F.when(F.col("n_rows") == 0, F.col("page"))).alias("_first_empty"))
    match = [F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}")) for c in crawl]
    kept = pages.alias("p").join(first_empty.alias("e"), match)
    return kept.where(F.col("_first_empty").isNull()
                      | (F.col("page") < F.col("_first_empty"))).select("p.*")


def price_cursor(pages: DataFrame, crawl: Sequence[str]) -> DataFrame:
    """Where the next price range starts, per crawl.

    ``pages`` has one row per non-empty page with ``price_from, page, page_max``: the largest
    price among its organic rows.  The cursor is the whole part of that price on the last page;
    it is NULL when the last page has no price, which ends the crawl.  ``advanced`` is false when
    the same price came back, so that a caller cannot loop for ever.
    """
    last = pages.groupBy(*crawl, "price_from").agg(
        F.max("page").alias("last_page"),
        F.max_by("page_max", "page").alias("last_max"))
    cursor = F.col("last_max").cast("bigint")
    return last.select(*crawl, "price_from", "last_page", cursor.alias("next_price_from"),
                       F.coalesce(cursor > F.col("price_from"), F.lit(False)).alias("advanced"))
