"""Named queries over the test tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adlens.sources.fixtures import LISTINGS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under ``key``; ``sql`` is its equivalent over the same tables."""
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            CHECKS[key] = sql
        return fn
    return add


# ---- common table expressions of the checks ---------------------------------------------

LISTINGS = LISTINGS_SQL.format(lineitem="lineitem", part="part", supplier="supplier", nation="nation")
CRAWL = ("price_amount IS NULL, price_amount, ad_id, seq_part, seq_supp, num_images, trade_type, "
         "has_shipping, has_buy_now, timestamp_dt NULLS FIRST")

# L: listings.  S: modelling scope.  P: listings with their place in the landed search pages.
# D: first sighting of each ad.
L = f"WITH L AS ({LISTINGS})"
S = f"""{L}, S AS (SELECT *, ln(1 + price_amount) AS log_price FROM L
  WHERE trade_type = 'Til salgs' AND price_amount > 0)"""
P = f"""{L}, R AS (SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY {CRAWL}) - 1 AS position,
    count(*) OVER (PARTITION BY search_query) AS total FROM L),
  P0 AS (SELECT *, position // 50 AS page_no, is_promoted AND position % 50 = 0 AS is_top,
    CAST(ceil(total / 50.0) AS BIGINT) AS last_page FROM R),
  P AS (SELECT * EXCLUDE (is_promoted), is_top AS is_promoted, CAST(page_no // 50 AS INT) AS range_no,
    CAST(page_no % 50 + 1 AS INT) AS page, CAST(position % 50 AS INT) AS pos FROM P0)"""
D = f"""{L}, D AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY ad_id ORDER BY search_query, {CRAWL}) AS rn FROM L) WHERE rn = 1)"""
