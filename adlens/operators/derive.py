"""Row-wise columns and filters of the listing analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.constants import (BRANDS, CATEGORY_RULES, CONDITION_RULES, DEFAULT_BRAND,
                              DEFAULT_CATEGORY, DEFAULT_CONDITION, FOR_SALE, IMAGE_BIN_EDGES,
                              IMAGE_BIN_LABELS, SEED, WEEKDAYS, YEAR_PATTERN)
from adlens.functions.text import first_keyword, first_rule, mentions, word_count
from adlens.operators.quantiles import percentiles_wide


def paid_rows(df: DataFrame, price: str = "price_amount") -> DataFrame:
    return df.where(F.col(price) > 0)


def below_percentile(df: DataFrame, column: str, p: float, exact: bool = True) -> DataFrame:
    """Rows not above the percentile of their own column."""
    bound = percentiles_wide(df, column, {"_bound": p}, exact=exact)
    return df.crossJoin(F.broadcast(bound)).where(F.col(column) <= F.col("_bound")).drop("_bound")


def modelling_scope(df: DataFrame) -> DataFrame:
    """Listings for sale with a price above zero."""
    return df.where((F.col("trade_type") == FOR_SALE) & (F.col("price_amount") > 0))


def scope_exclusions(df: DataFrame) -> DataFrame:
    """How many rows the scope leaves out, by reason (a missing trade type counts as other)."""
    other = F.coalesce(F.col("trade_type") != FOR_SALE, F.lit(True))
    return df.agg(
        F.count_if(other).alias("other_trade_type"),
        F.count_if(F.col("price_amount") <= 0).alias("free"),
        F.count_if(~other & (F.col("price_amount") > 0)).alias("kept"),
        F.count("*").alias("total"))


def with_log_price(df: DataFrame) -> DataFrame:
    return df.withColumn("log_price", F.log1p("price_amount"))


def capped_sample(df: DataFrame, key: str, n: int = 2000, seed: int = SEED) -> DataFrame:
    """At most ``n`` rows, the same ones on every run: smallest hash of key and seed first."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return df.orderBy(order, *[c for c in df.columns]).limit(n)


def seller_type(is_retailer: Column) -> Column:
    return F.when(is_retailer, "Retailer").when(~is_retailer, "Private")


def image_bin(count: Column) -> Column:
    """Right-closed bins of the image count; 0 and more than the last edge stay NULL."""
    chain = None
    for low, high, label in zip(IMAGE_BIN_EDGES, IMAGE_BIN_EDGES[1:], IMAGE_BIN_LABELS):
        hit = (count > low) & (count <= high)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def price_label(price: Column, currency: str = "NOK") -> Column:
    return F.concat(F.format_number(price, 0), F.lit(f" {currency}"))


def with_title_features(df: DataFrame, title: str = "heading",
                        category_rules: Sequence[tuple[str, str]] = tuple(CATEGORY_RULES),
                        brands: Sequence[str] = tuple(BRANDS),
                        condition_rules: Sequence[tuple[str, str]] = tuple(CONDITION_RULES)) -> DataFrame:
    """Category, brand, condition, lengths and year mention from the title."""
    lowered = F.col("_title")
    return (df.withColumn("_title", F.lower(title)).withColumns({
        "item_category": first_rule(lowered, category_rules, DEFAULT_CATEGORY),
        "brand_from_title": first_keyword(lowered, brands, DEFAULT_BRAND),
        "condition": first_rule(lowered, condition_rules, DEFAULT_CONDITION),
        "title_len": F.char_length(title),
        "title_word_count": word_count(F.col(title)),
        "has_year_in_title": mentions(F.col(title), YEAR_PATTERN),
    }).drop("_title"))


def weekday_name(ts: Column) -> Column:
    """English weekday name, independent of the session locale."""
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ts) + 1)


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days from ``ts`` to ``as_of``, rounded down (a later ``ts`` gives -1 or less)."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000))


def micros_since(ts: Column, as_of: Column) -> Column:
    return F.unix_micros(as_of) - F.unix_micros(ts)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their counts; ties by value."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k))


def rows_of_top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is among the ``k`` most frequent; ``k`` values are broadcast."""
    return df.join(F.broadcast(top_values(df, column, k).select(column)), column, "left_semi")

