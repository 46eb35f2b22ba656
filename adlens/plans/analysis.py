"""Queries that filter, derive, join and profile the listing table."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.constants import (BOOLEAN_COLUMNS, BRANDS, CATEGORY_RULES, CONDITION_RULES, DEFAULT_BRAND,
                              DEFAULT_CATEGORY, DEFAULT_CONDITION, IMAGE_BIN_LABELS, PERCENTILES, WEEKDAYS, DISCRETE_PRICE_FEATURES, PRICE_FEATURES, TITLE_FEATURES)
from adlens.functions.text import combined_text, first_rule, normalise_title, word_count
from adlens.operators import derive, information, prepare, profile
from adlens.operators.models import hash_share, with_exact_split, with_split
from adlens.operators.scale import label_encode
from adlens.plans.registry import CRAWL, D, L, S, query
from adlens.sources import fixtures, tables
from adlens.sources.fixtures import listings

AS_OF = "2002-01-01 00:00:00"

# Title rules over the words of the test listings.
TOOL_RULES = [("Heavy", r"\b(anvil|gear)\b"), ("Flat", r"\b(plate|ring)\b"), ("Long", r"\b(rod|bolt)\b")]
TEST_BRANDS = ["brand#25", "brand#2", "brand#1"]       # the longer of two overlapping names first
SHORT_FIRST_BRANDS = ["brand#1", "brand#10", "brand#2"]  # the shorter one hides the longer one
STATE_RULES = [("Ny/ubrukt", r"\b(new)\b"), ("Brukt", r"\b(old|cold)\b")]


def _rule_sql(column: str, rules, default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in rules)
    return f"CASE {cases} ELSE '{default}' END"


def _keyword_sql(column: str, words, default: str) -> str:
    cases = " ".join(f"WHEN contains(lower({column}), '{w}') THEN '{w.title()}'" for w in words)
    return f"CASE {cases} ELSE '{default}' END"


CATEGORY_SQL = _rule_sql("heading", TOOL_RULES, DEFAULT_CATEGORY)
BRAND_SQL = _keyword_sql("heading", TEST_BRANDS, DEFAULT_BRAND)
CONDITION_SQL = _rule_sql("heading", STATE_RULES, DEFAULT_CONDITION)
YEAR_SQL = r"coalesce(regexp_matches(heading, '\b(19[5-9]\d|20[0-2]\d)\b'), false)"
WORDS_SQL = r"len(list_filter(regexp_split_to_array(heading, '\s+'), lambda w: w <> ''))"
DAY_MICROS = 86_400_000_000
AGE_SQL = (f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(timestamp_dt)) / {DAY_MICROS}.0) AS BIGINT)")

# T: scope with title and time features.
T = f"""{S}, T AS (SELECT *, {CATEGORY_SQL} AS item_category, {BRAND_SQL} AS brand_from_title,
  {CONDITION_SQL} AS condition, length(heading) AS title_len, {WORDS_SQL} AS title_word_count,
  {YEAR_SQL} AS has_year_in_title, {AGE_SQL} AS listing_age_days, hour(timestamp_dt) AS hour_posted FROM S)"""


def scope(spark, d):
    return derive.with_log_price(derive.modelling_scope(listings(spark, d)))


def titled(spark, d):
    """Scope with title and time features, under the test rules."""
    df = derive.with_title_features(scope(spark, d), category_rules=TOOL_RULES, brands=TEST_BRANDS,
                                    condition_rules=STATE_RULES)
    as_of = F.lit(AS_OF).cast("timestamp")
    return df.withColumn("listing_age_days", derive.age_days(F.col("timestamp_dt"), as_of)
                         ).withColumn("hour_posted", F.hour("timestamp_dt"))


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- flagship ----------------------------------------------------------------------------

@query("flagship", f"""{L}, Q AS (SELECT *, {CATEGORY_SQL} AS item_category FROM L
    WHERE price_amount IS NOT NULL)
  SELECT item_category, count(*) AS n, round(median(price_amount), 4) AS median FROM Q
  WHERE trade_type = 'Til salgs' AND price_amount > 0 GROUP BY ALL""")
def flagship(spark, d):
    prepared = prepare.prepare_listings(listings(spark, d))
    rows = derive.with_title_features(derive.modelling_scope(prepared), category_rules=TOOL_RULES)
    return rounded(profile.median_price_by(rows, "item_category", few_groups=True), 4, "median")


# ---- projections, filters, prepared data -------------------------------------------------

@query("priced_rows", f"{L} SELECT ad_id, seq_part, seq_supp, price_amount FROM L WHERE price_amount IS NOT NULL")
def priced_rows(spark, d):
    return prepare.priced_rows(listings(spark, d)).select("ad_id", "seq_part", "seq_supp", "price_amount")


@query("combined_text", f"""{L} SELECT ad_id, seq_part, seq_supp,
  trim(concat(coalesce(heading, ''), ' ', coalesce(location, ''))) AS text FROM L""")
def combined_text_query(spark, d):
    return listings(spark, d).select("ad_id", "seq_part", "seq_supp",
                                     combined_text(F.col("heading"), F.col("location")).alias("text"))


@query("timestamp_seconds", f"""{L} SELECT ad_id, seq_part, seq_supp, epoch_ms(timestamp_dt) / 1000.0 AS from_ts,
  epoch_ms(timestamp_dt) / 1000.0 AS from_iso, epoch_ms(timestamp_dt) / 1000.0 AS from_ms,
  CAST(NULL AS DOUBLE) AS from_bad FROM L""")
def timestamp_seconds(spark, d):
    df = listings(spark, d).withColumns({
        "iso": F.date_format("timestamp_dt", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "ms": F.unix_millis("timestamp_dt"), "bad": F.concat(F.lit("x"), "ad_id")})
    seconds = {n: prepare.epoch_seconds(df, c) for n, c in
               (("from_ts", "timestamp_dt"), ("from_iso", "iso"), ("from_ms", "ms"), ("from_bad", "bad"))}
    return df.select("ad_id", "seq_part", "seq_supp", *[c.alias(n) for n, c in seconds.items()])


@query("prepare_listings", f"""{L}, C AS (SELECT *, epoch_ms(timestamp_dt) / 1000.0 AS secs FROM L
    WHERE price_amount IS NOT NULL), M AS (SELECT median(secs) AS m FROM C)
  SELECT ad_id, seq_part, seq_supp, price_amount,
    trim(concat(coalesce(heading, ''), ' ', coalesce(location, ''))) AS text,
    round(coalesce(secs, m), 3) AS timestamp_val FROM C, M""")
def prepare_listings(spark, d):
    df = prepare.ensure_prepared(listings(spark, d))
    return rounded(df.select("ad_id", "seq_part", "seq_supp", "price_amount", "text", "timestamp_val"),
                   3, "timestamp_val")


@query("price_zoom_p95", f"""{L}, Q AS (SELECT * FROM L WHERE price_amount > 0),
  B AS (SELECT quantile_cont(price_amount, 0.95) AS b FROM Q)
  SELECT ad_id, seq_part, seq_supp, price_amount FROM Q, B WHERE price_amount <= b""")
def price_zoom_p95(spark, d):
    rows = derive.below_percentile(derive.paid_rows(listings(spark, d)), "price_amount", 0.95)
    return rows.select("ad_id", "seq_part", "seq_supp", "price_amount")


@query("modelling_scope", f"{S} SELECT ad_id, seq_part, seq_supp, trade_type, price_amount FROM S")
def modelling_scope(spark, d):
    return scope(spark, d).select("ad_id", "seq_part", "seq_supp", "trade_type", "price_amount")


@query("scope_exclusions", f"""{L} SELECT count(*) FILTER (WHERE trade_type IS DISTINCT FROM 'Til salgs') AS other_trade_type,
  count(*) FILTER (WHERE price_amount <= 0) AS free,
  count(*) FILTER (WHERE trade_type = 'Til salgs' AND price_amount > 0) AS kept, count(*) AS total FROM L""")
def scope_exclusions(spark, d):
    return derive.scope_exclusions(listings(spark, d))


@query("log_price", f"""{S} SELECT ad_id, seq_part, seq_supp, round(log_price, 6) AS log_price,
  round(price_amount, 4) AS back FROM S""")
def log_price(spark, d):
    return rounded(scope(spark, d).select("ad_id", "seq_part", "seq_supp", "log_price",
                                          F.expm1("log_price").alias("back")).withColumn(
        "back", F.round("back", 4)), 6, "log_price")


@query("geo_dropna", f"""{L} SELECT ad_id, seq_part, seq_supp, coordinates_lat, coordinates_lon FROM L
  WHERE coordinates_lat IS NOT NULL AND coordinates_lon IS NOT NULL""")
def geo_dropna(spark, d):
    rows = listings(spark, d).dropna(subset=["coordinates_lat", "coordinates_lon"])
    return rows.select("ad_id", "seq_part", "seq_supp", "coordinates_lat", "coordinates_lon")


@query("capped_sample", f"""{D} SELECT ad_id, price_amount FROM D WHERE coordinates_lon IS NOT NULL
  ORDER BY md5(concat(ad_id, '#42')) LIMIT 2000""")
def capped_sample(spark, d):
    rows = fixtures.first_listings(spark, d).dropna(subset=["coordinates_lat", "coordinates_lon"])
    return derive.capped_sample(rows.select("ad_id", "price_amount"), "ad_id")


@query("seller_type_counts", f"""{L} SELECT CASE WHEN is_retailer THEN 'Retailer' ELSE 'Private' END AS seller,
  count(*) AS n FROM L GROUP BY ALL""")
def seller_type_counts(spark, d):
    return profile.value_counts(listings(spark, d).select(
        derive.seller_type(F.col("is_retailer")).alias("seller")), "seller")


@query("fill_constants", f"""{L} SELECT ad_id, seq_part, seq_supp, coalesce(location, 'missing') AS location,
  coalesce(coordinates_lon, 0) AS coordinates_lon, coalesce(organisation_name, 'Unknown') AS organisation_name FROM L""")
def fill_constants(spark, d):
    return listings(spark, d).select("ad_id", "seq_part", "seq_supp", "location", "coordinates_lon",
                                     "organisation_name").fillna(
        {"location": "missing", "coordinates_lon": 0.0, "organisation_name": "Unknown"})


@query("image_bins", f"""{L}, B AS (SELECT CASE WHEN num_images > 0 AND num_images <= 1 THEN '1'
    WHEN num_images > 1 AND num_images <= 3 THEN '2-3' WHEN num_images > 3 AND num_images <= 5 THEN '4-5'
    WHEN num_images > 5 AND num_images <= 10 THEN '6-10' WHEN num_images > 10 AND num_images <= 100 THEN '10+' END
    AS img_group, price_amount FROM L)
  SELECT img_group, CASE img_group WHEN '1' THEN 0 WHEN '2-3' THEN 1 WHEN '4-5' THEN 2 WHEN '6-10' THEN 3
    WHEN '10+' THEN 4 END AS ordinal, count(*) AS n, count(price_amount) AS n_priced FROM B GROUP BY ALL""")
def image_bins(spark, d):
    grouped = listings(spark, d).groupBy(derive.image_bin(F.col("num_images")).alias("img_group")).agg(
        F.count("*").alias("n"), F.count("price_amount").alias("n_priced"))
    place = F.array_position(F.array(*[F.lit(x) for x in IMAGE_BIN_LABELS]), F.col("img_group")) - 1
    return grouped.select("img_group", place.cast("int").alias("ordinal"), "n", "n_priced")


@query("price_label", f"""{L} SELECT ad_id, seq_part, seq_supp,
  CASE WHEN price_amount IS NOT NULL THEN format('{{:,}}', CAST(round_even(price_amount, 0) AS BIGINT)) || ' NOK' END
  AS price_label FROM L""")
def price_label(spark, d):
    return listings(spark, d).select("ad_id", "seq_part", "seq_supp",
                                     derive.price_label(F.col("price_amount")).alias("price_label"))


# ---- joins in effect ---------------------------------------------------------------------

@query("top_brand_rows", f"""{T}, K AS (SELECT brand_from_title FROM T WHERE brand_from_title <> 'Unknown'
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
  SELECT ad_id, seq_part, seq_supp, brand_from_title FROM T WHERE brand_from_title IN (SELECT * FROM K)""")
def top_brand_rows(spark, d):
    known = titled(spark, d).where(F.col("brand_from_title") != DEFAULT_BRAND)
    return derive.rows_of_top_values(known, "brand_from_title", 2).select(
        "ad_id", "seq_part", "seq_supp", "brand_from_title")


@query("top_location_rows", f"""{S}, K AS (SELECT location FROM S WHERE location IS NOT NULL GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT 10)
  SELECT ad_id, seq_part, seq_supp, location FROM S WHERE location IN (SELECT * FROM K)""")
def top_location_rows(spark, d):
    return derive.rows_of_top_values(scope(spark, d), "location", 10).select(
        "ad_id", "seq_part", "seq_supp", "location")


# ---- counts and group statistics ---------------------------------------------------------

@query("value_counts_trade_type", f"{L} SELECT trade_type, count(*) AS n FROM L GROUP BY ALL")
def value_counts_trade_type(spark, d):
    return profile.value_counts(listings(spark, d), "trade_type")


@query("page_value_counts", f"""{L}, R AS (SELECT (row_number() OVER (PARTITION BY search_query ORDER BY {CRAWL}) - 1) // 50 + 1
    AS page_current FROM L) SELECT CAST(page_current AS INT) AS page_current, count(*) AS n FROM R GROUP BY ALL""")
def page_value_counts(spark, d):
    from adlens.operators.search_pages import parse_search_pages
    return profile.value_counts(parse_search_pages(fixtures.search_pages(spark, d)), "page_current")


def _median_sql(cte: str, source: str, group: str) -> str:
    return f"""{cte} SELECT {group}, count(*) AS n, round(median(price_amount), 4) AS median FROM {source}
  WHERE {group} IS NOT NULL GROUP BY ALL"""


@query("median_by_category", _median_sql(T, "T", "item_category"))
def median_by_category(spark, d):
    return rounded(profile.median_price_by(titled(spark, d), "item_category", few_groups=True), 4, "median")


@query("median_by_brand", f"""{T}, K AS (SELECT brand_from_title FROM T WHERE brand_from_title <> 'Unknown' GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT 10) SELECT brand_from_title, count(*) AS n, round(median(price_amount), 4) AS median
  FROM T WHERE brand_from_title IN (SELECT * FROM K) GROUP BY ALL""")
def median_by_brand(spark, d):
    known = titled(spark, d).where(F.col("brand_from_title") != DEFAULT_BRAND)
    rows = derive.rows_of_top_values(known, "brand_from_title", 10)
    return rounded(profile.median_price_by(rows, "brand_from_title", few_groups=True), 4, "median")


@query("median_by_location", _median_sql(S, "S", "location"))
def median_by_location(spark, d):
    return rounded(profile.median_price_by(scope(spark, d), "location"), 4, "median")


@query("median_by_condition", _median_sql(T, "T", "condition"))
def median_by_condition(spark, d):
    return rounded(profile.median_price_by(titled(spark, d), "condition", few_groups=True), 4, "median")


@query("median_by_flag", f"""{S} SELECT 'has_shipping' AS feature, has_shipping AS value, round(median(price_amount), 4) AS median
    FROM S GROUP BY ALL UNION ALL SELECT 'has_buy_now', has_buy_now, round(median(price_amount), 4) FROM S GROUP BY ALL""")
def median_by_flag(spark, d):
    from adlens.operators.quantiles import median_by
    long = scope(spark, d).select("price_amount", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("has_shipping", "has_buy_now")])))
    return rounded(median_by(long, "price_amount", ["feature", "value"], few_groups=True), 4, "median")


@query("price_stats_by_seller", f"""{S} SELECT CASE WHEN is_retailer THEN 'Retailer' ELSE 'Private' END AS seller,
  count(price_amount) AS count, round_even(median(price_amount), 0) :: DOUBLE AS median,
  round_even(avg(price_amount), 0) :: DOUBLE AS mean, round_even(min(price_amount), 0) :: DOUBLE AS min,
  round_even(max(price_amount), 0) :: DOUBLE AS max FROM S GROUP BY ALL""")
def price_stats_by_seller(spark, d):
    rows = scope(spark, d).withColumn("seller", derive.seller_type(F.col("is_retailer")))
    return profile.price_stats_by(rows, "seller", few_groups=True)


@query("price_summary", f"""{L} SELECT round(median(price_amount) FILTER (WHERE price_amount > 0), 4) AS median,
  round(quantile_cont(price_amount, 0.95) FILTER (WHERE price_amount > 0), 4) AS p95,
  round(quantile_cont(price_amount, 0.99) FILTER (WHERE price_amount > 0), 4) AS p99,
  round(avg(price_amount) FILTER (WHERE price_amount > 0), 4) AS mean,
  max(price_amount) FILTER (WHERE price_amount > 0) AS max,
  count(*) FILTER (WHERE price_amount > 0) AS n_paid, count(*) FILTER (WHERE price_amount = 0) AS n_free FROM L""")
def price_summary(spark, d):
    return rounded(profile.price_summary(listings(spark, d)), 4, "median", "p95", "p99", "mean")


@query("price_percentiles", S + " " + " UNION ALL ".join(
    f"SELECT {p} AS percent, round(quantile_cont(price_amount, {p / 100}), 4) AS value FROM S" for p in PERCENTILES))
def price_percentiles(spark, d):
    return rounded(profile.percentile_table(scope(spark, d), "price_amount"), 4, "value")


LISTING_TYPES = {
    "ad_id": "string", "seq_part": "bigint", "seq_supp": "bigint", "search_query": "string", "heading": "string",
    "location": "string", "price_amount": "double", "trade_type": "string", "is_private": "boolean",
    "is_retailer": "boolean", "has_shipping": "boolean", "has_buy_now": "boolean", "is_promoted": "boolean",
    "num_images": "int", "timestamp_dt": "timestamp", "brand": "string", "organisation_name": "string",
    "coordinates_lat": "double", "coordinates_lon": "double"}


@query("missing_fraction", L + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS missing FROM L"
    for c in LISTING_TYPES))
def missing_fraction(spark, d):
    return rounded(profile.missing_fraction(listings(spark, d)), 6, "missing")


@query("missing_summary", L + ", M AS (" + " UNION ALL ".join(
    f"SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS missing FROM L" for c in LISTING_TYPES)
    + """) SELECT count(*) FILTER (WHERE missing = 0) AS complete_columns,
  count(*) FILTER (WHERE missing > 0.5) AS mostly_missing_columns FROM M""")
def missing_summary(spark, d):
    return profile.missing_summary(listings(spark, d))


@query("table_profile", L + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS filled, count(*) AS rows FROM L"
    for c, t in LISTING_TYPES.items()))
def table_profile(spark, d):
    return profile.table_profile(listings(spark, d))


@query("duplicate_count", f"""{L}, K AS (SELECT ad_id FROM L GROUP BY 1)
  SELECT (SELECT count(*) FROM L) - (SELECT count(*) FROM K) AS duplicates""")
def duplicate_count(spark, d):
    return profile.duplicate_count(listings(spark, d), "ad_id")


_NUMERIC = ["price_amount", "coordinates_lat", "coordinates_lon", "num_images"]


@query("describe_numeric", L + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25,
  round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75 FROM L"""
    for c in _NUMERIC))
def describe_numeric(spark, d):
    return rounded(profile.describe_numeric(listings(spark, d), _NUMERIC), 4, "mean", "std", "q25", "q50", "q75")


_TEXT = ["search_query", "heading", "location", "trade_type", "organisation_name"]


@query("describe_all", L + ", V AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM L WHERE {c} IS NOT NULL GROUP BY ALL" for c in _TEXT)
    + """) SELECT col AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(value, (-n, value)) AS top, max(n) AS freq FROM V GROUP BY ALL""")
def describe_all(spark, d):
    return profile.describe_all(listings(spark, d), _TEXT)


def _shape_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 4) AS skewness,
  round(avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3, 4) AS kurtosis FROM S, (SELECT avg({c}) AS m FROM S)"""


@query("price_shape", f"{S} {_shape_sql('price_amount')} UNION ALL {_shape_sql('log_price')}")
def price_shape(spark, d):
    return rounded(profile.shape(scope(spark, d), ["price_amount", "log_price"]), 4, "skewness", "kurtosis")


@query("iqr_outliers", f"""{S}, Q AS (SELECT quantile_cont(log_price, 0.25) AS q1, quantile_cont(log_price, 0.75) AS q3 FROM S),
  B AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM Q)
  SELECT count(*) FILTER (WHERE log_price < lo OR log_price > hi) AS n_outliers,
    round(avg(CASE WHEN log_price < lo OR log_price > hi THEN 1 ELSE 0 END), 6) AS share,
    round(exp(max(lo)) - 1, 3) AS lower_price, round(exp(max(hi)) - 1, 1) AS upper_price FROM S, B""")
def iqr_outliers(spark, d):
    df = profile.iqr_outliers(scope(spark, d))
    return rounded(rounded(rounded(df, 6, "share"), 3, "lower_price"), 1, "upper_price")


@query("boolean_counts", L + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c}) AS n,
  round(count(*) FILTER (WHERE {c}) / count(*), 6) AS share FROM L""" for c in BOOLEAN_COLUMNS))
def boolean_counts(spark, d):
    return rounded(profile.boolean_counts(listings(spark, d), BOOLEAN_COLUMNS), 6, "share")


@query("class_share", f"""{T} SELECT item_category, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM T), 6) AS share FROM T GROUP BY ALL""")
def class_share(spark, d):
    return rounded(profile.class_share(titled(spark, d), "item_category"), 6, "share")


@query("detection_rate", f"""{T} SELECT count(*) FILTER (WHERE brand_from_title <> 'Unknown') AS detected, count(*) AS total,
  round(avg(CASE WHEN brand_from_title <> 'Unknown' THEN 1 ELSE 0 END), 6) AS rate,
  count(DISTINCT brand_from_title) FILTER (WHERE brand_from_title <> 'Unknown') AS n_values FROM T""")
def detection_rate(spark, d):
    return rounded(profile.detection_rate(titled(spark, d), "brand_from_title", DEFAULT_BRAND), 6, "rate")


@query("nunique_category", f"{T} SELECT count(DISTINCT item_category) AS n_distinct FROM T")
def nunique_category(spark, d):
    return profile.distinct_count(titled(spark, d), "item_category")


@query("median_ratio_year", f"""{T}, M AS (SELECT median(price_amount) FILTER (WHERE has_year_in_title) AS a,
    median(price_amount) FILTER (WHERE NOT has_year_in_title) AS b FROM T)
  SELECT round(a, 4) AS median_true, round(b, 4) AS median_false, round(a / b, 6) AS ratio FROM M""")
def median_ratio_year(spark, d):
    df = profile.median_ratio(titled(spark, d), "has_year_in_title")
    return rounded(rounded(df, 4, "median_true", "median_false"), 6, "ratio")


def histogram_sql(cte: str, source: str, column: str, bins: int) -> str:
    """Equal-width bins in SQL; edges decide the bin, as in numpy."""
    return f"""{cte}, X AS (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL),
  B0 AS (SELECT min(x) AS a, max(x) AS b FROM X),
  B AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM B0),
  G AS (SELECT x, lo, hi, least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS g FROM X, B),
  H AS (SELECT CASE WHEN x < lo + g * ((hi - lo) / {bins}) THEN g - 1
    WHEN g < {bins - 1} AND x >= lo + (g + 1) * ((hi - lo) / {bins}) THEN g + 1 ELSE g END AS bin FROM G),
  C AS (SELECT bin, count(*) AS n FROM H GROUP BY 1)
  SELECT r.bin AS bin, round(lo + r.bin * ((hi - lo) / {bins}), 7) AS bin_start,
    round(lo + (r.bin + 1) * ((hi - lo) / {bins}), 7) AS bin_end, coalesce(C.n, 0) AS n
  FROM (SELECT unnest(range({bins})) AS bin) r CROSS JOIN B LEFT JOIN C ON C.bin = r.bin"""


def _histogram(df, column, bins):
    return rounded(profile.histogram(df, column, bins), 7, "bin_start", "bin_end")


@query("price_histogram", histogram_sql(S, "S", "price_amount", 80))
def price_histogram(spark, d):
    return _histogram(scope(spark, d), "price_amount", 80)


@query("log_price_histogram", histogram_sql(S, "S", "log_price", 80))
def log_price_histogram(spark, d):
    return _histogram(scope(spark, d), "log_price", 80)


@query("price_zoom_histogram", histogram_sql(f"""{L}, Q AS (SELECT * FROM L WHERE price_amount > 0), Z AS (
    SELECT * FROM Q WHERE price_amount <= (SELECT quantile_cont(price_amount, 0.95) FROM Q))""", "Z", "price_amount", 60))
def price_zoom_histogram(spark, d):
    rows = derive.below_percentile(derive.paid_rows(listings(spark, d)), "price_amount", 0.95)
    return _histogram(rows, "price_amount", 60)


@query("age_histogram", histogram_sql(T, "T", "listing_age_days", 50))
def age_histogram(spark, d):
    return _histogram(titled(spark, d), "listing_age_days", 50)


@query("image_histogram", f"""{L}, C AS (SELECT num_images AS value, count(*) AS n FROM L GROUP BY 1)
  SELECT r.value, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT max(value) + 1 FROM C))) AS value) r
  LEFT JOIN C ON C.value = r.value""")
def image_histogram(spark, d):
    return profile.unit_histogram(listings(spark, d), "num_images")


def _boxplot_sql(cte: str, source: str, group: str) -> str:
    return f"""{cte}, Q AS (SELECT {group}, quantile_cont(price_amount, 0.25) AS q1, median(price_amount) AS med,
    quantile_cont(price_amount, 0.75) AS q3 FROM {source} WHERE {group} IS NOT NULL GROUP BY ALL)
  SELECT Q.{group}, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
    min(price_amount) FILTER (WHERE price_amount >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
    max(price_amount) FILTER (WHERE price_amount <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) AS n
  FROM {source} x JOIN Q ON x.{group} = Q.{group} GROUP BY ALL"""


def _boxplot(df, group, few):
    return rounded(profile.boxplot_stats(df, group, few_groups=few), 4, "q1", "median", "q3")


@query("boxplot_stats", _boxplot_sql(T, "T", "item_category"))
def boxplot_stats(spark, d):
    return _boxplot(titled(spark, d), "item_category", True)


@query("boxplot_by_location", _boxplot_sql(S, "S", "location"))
def boxplot_by_location(spark, d):
    return _boxplot(scope(spark, d), "location", False)


@query("age_summary", f"""{T} SELECT min(listing_age_days) AS min, max(listing_age_days) AS max,
  round(avg(listing_age_days), 4) AS mean, count(*) FILTER (WHERE listing_age_days = 0) AS zeros,
  round(median(listing_age_days), 4) AS median FROM T""")
def age_summary(spark, d):
    return rounded(profile.column_summary(titled(spark, d), "listing_age_days"), 4, "mean", "median")


@query("image_summary", f"""{L} SELECT min(num_images) AS min, max(num_images) AS max, round(avg(num_images), 4) AS mean,
  count(*) FILTER (WHERE num_images = 0) AS zeros, round(median(num_images), 4) AS median FROM L""")
def image_summary(spark, d):
    return rounded(profile.column_summary(listings(spark, d), "num_images"), 4, "mean", "median")


@query("top_retailers", f"""{L} SELECT organisation_name, count(*) AS n FROM L WHERE is_retailer AND organisation_name IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def top_retailers(spark, d):
    return derive.top_values(listings(spark, d).where("is_retailer"), "organisation_name", 15)


# ---- sorts, limits, top-k ----------------------------------------------------------------

@query("most_expensive", f"""{S} SELECT heading, price_amount, location, is_retailer FROM S
  ORDER BY price_amount DESC, ad_id, seq_part LIMIT 10""")
def most_expensive(spark, d):
    return (scope(spark, d).orderBy(F.desc("price_amount"), "ad_id", "seq_part").limit(10)
            .select("heading", "price_amount", "location", "is_retailer"))


@query("top_locations", f"""{L} SELECT location, count(*) AS n FROM L WHERE location IS NOT NULL GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 20""")
def top_locations(spark, d):
    return derive.top_values(listings(spark, d), "location", 20)


@query("top_brands", f"""{L} SELECT brand, count(*) AS n FROM L GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def top_brands(spark, d):
    return derive.top_values(listings(spark, d), "brand", 20)


# ---- text and time -----------------------------------------------------------------------

@query("item_category", f"{L} SELECT ad_id, seq_part, seq_supp, {CATEGORY_SQL} AS item_category FROM L")
def item_category(spark, d):
    return listings(spark, d).select("ad_id", "seq_part", "seq_supp", first_rule(
        F.lower("heading"), TOOL_RULES, DEFAULT_CATEGORY).alias("item_category"))


@query("brand_from_title", f"""{L} SELECT ad_id, seq_part, seq_supp, {BRAND_SQL} AS long_first,
  {_keyword_sql("heading", SHORT_FIRST_BRANDS, DEFAULT_BRAND)} AS short_first FROM L""")
def brand_from_title(spark, d):
    from adlens.functions.text import first_keyword
    low = F.lower("heading")
    return listings(spark, d).select(
        "ad_id", "seq_part", "seq_supp", first_keyword(low, TEST_BRANDS, DEFAULT_BRAND).alias("long_first"),
        first_keyword(low, SHORT_FIRST_BRANDS, DEFAULT_BRAND).alias("short_first"))


@query("condition_from_title", f"{L} SELECT ad_id, seq_part, seq_supp, {CONDITION_SQL} AS condition FROM L")
def condition_from_title(spark, d):
    return listings(spark, d).select("ad_id", "seq_part", "seq_supp", first_rule(
        F.lower("heading"), STATE_RULES, DEFAULT_CONDITION).alias("condition"))


@query("default_title_rules", f"""{L} SELECT ad_id, seq_part, seq_supp,
  {_rule_sql("heading", CATEGORY_RULES, DEFAULT_CATEGORY)} AS item_category,
  {_keyword_sql("heading", BRANDS, DEFAULT_BRAND)} AS brand_from_title,
  {_rule_sql("heading", CONDITION_RULES, DEFAULT_CONDITION)} AS condition FROM L""")
def default_title_rules(spark, d):
    return derive.with_title_features(listings(spark, d)).select(
        "ad_id", "seq_part", "seq_supp", "item_category", "brand_from_title", "condition")


# Titles made of words that the rules know, put together by key; several hold words of two rules.
_THINGS = ["Fender Stratocaster", "gibson les paul", "Western dreadnought", "spansk nylon", "Jazz bass", "Marshall combo", "rørforsterker",
           "Boss katana", "Strymon delay pedal", "gitar strenger", "notebok", "Lærebok med noter", "ukulele", "banjo", "Line 6 looper",
           "Harley Benton SG", "kassegitar", "electro-harmonix fuzz", "tc electronic reverb", "bøker og dvd", "kabel og jack", "orange stack"]
_STATES = ["", "ny", "pent brukt", "brukt", "defekt, til deler", "vintage 1972", "gammel men velholdt", "selges billig", "splitter ny 2021",
           "second hand", "samleobjekt", "used", "uåpnet"]
_TITLED_PARTS = (f"concat(element_at(array({', '.join(repr(x) for x in _THINGS)}), CAST(p_partkey % {len(_THINGS)} + 1 AS INT)), ' ', "
                 f"element_at(array({', '.join(repr(x) for x in _STATES)}), CAST(p_partkey % {len(_STATES)} + 1 AS INT)))")
_TITLED_PARTS_SQL = _TITLED_PARTS.replace("element_at(array(", "list_extract(list_value(")


@query("rule_titles", f"""WITH X AS (SELECT p_partkey, {_TITLED_PARTS_SQL} AS heading FROM part)
  SELECT p_partkey, heading, {_rule_sql("heading", CATEGORY_RULES, DEFAULT_CATEGORY)} AS item_category,
  {_keyword_sql("heading", BRANDS, DEFAULT_BRAND)} AS brand_from_title,
  {_rule_sql("heading", CONDITION_RULES, DEFAULT_CONDITION)} AS condition, {YEAR_SQL} AS has_year_in_title FROM X""")
def rule_titles(spark, d):
    """The real rule tables on titles in which every category, condition and many brands occur."""
    titles = tables.read_table(spark, d, "part").select("p_partkey", F.expr(_TITLED_PARTS).alias("heading"))
    return derive.with_title_features(titles).select("p_partkey", "heading", "item_category", "brand_from_title", "condition",
                                                     "has_year_in_title")


@query("title_len_words", f"""{L} SELECT ad_id, seq_part, seq_supp, length(heading) AS title_len, {WORDS_SQL} AS title_word_count
  FROM L""")
def title_len_words(spark, d):
    return listings(spark, d).select("ad_id", "seq_part", "seq_supp", F.char_length("heading").alias("title_len"),
                                     word_count(F.col("heading")).alias("title_word_count"))


@query("has_year", f"{L} SELECT ad_id, seq_part, seq_supp, {YEAR_SQL} AS has_year_in_title FROM L")
def has_year(spark, d):
    from adlens.constants import YEAR_PATTERN
    from adlens.functions.text import mentions
    return listings(spark, d).select("ad_id", "seq_part", "seq_supp",
                                     mentions(F.col("heading"), YEAR_PATTERN).alias("has_year_in_title"))


@query("normalise_title", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def normalise_title_query(spark, d):
    return tables.read_table(spark, d, "documents").select("doc_id", F.md5(normalise_title(F.col("text"))).alias("digest"))


@query("dow_counts", "WITH W AS (SELECT isodow(ts) - 1 AS o, count(*) AS n FROM events GROUP BY 1) SELECT "
       "CAST(r.o AS INT) AS ordinal, (" + str(WEEKDAYS) + ")[r.o + 1] AS dow, n FROM (SELECT unnest(range(7)) AS o) r "
       "LEFT JOIN W ON W.o = r.o")
def dow_counts(spark, d):
    return profile.weekday_counts(tables.read_table(spark, d, "events"), "ts")


@query("hour_counts", "SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_counts(spark, d):
    return profile.hour_counts(tables.read_table(spark, d, "events"), "ts")


def _daily_sql(table: str, ts: str) -> str:
    return f"""WITH C AS (SELECT CAST({ts} AS DATE) AS day, count(*) AS n FROM {table} GROUP BY 1),
  A AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM C)
  SELECT CAST(A.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM A LEFT JOIN C ON A.day = C.day"""


@query("daily_counts", _daily_sql("events", "ts"))
def daily_counts(spark, d):
    return profile.daily_counts(tables.read_table(spark, d, "events"), "ts").withColumn("day", F.col("day").cast("string"))


@query("daily_counts_orders", _daily_sql("orders", "o_orderdate"))
def daily_counts_orders(spark, d):
    orders = tables.read_table(spark, d, "orders")
    return profile.daily_counts(orders, "o_orderdate").withColumn("day", F.col("day").cast("string"))


_ORDER_AS_OF = "1998-06-15 12:00:00"


@query("listing_age_days", f"""SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '{_ORDER_AS_OF}') - epoch_us(o_orderdate))
  / {DAY_MICROS}.0) AS BIGINT) AS age_days FROM orders""")
def listing_age_days(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    return tables.read_table(spark, d, "orders").select(
        "o_orderkey", derive.age_days(ts, F.lit(_ORDER_AS_OF).cast("timestamp")).alias("age_days"))


@query("time_since_posted", f"""SELECT o_orderkey, epoch_us(TIMESTAMP '{_ORDER_AS_OF}') - epoch_us(o_orderdate) AS micros
  FROM orders""")
def time_since_posted(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    return tables.read_table(spark, d, "orders").select(
        "o_orderkey", derive.micros_since(ts, F.lit(_ORDER_AS_OF).cast("timestamp")).alias("micros"))


@query("label_encode", f"""{L}, C AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (
    SELECT DISTINCT coalesce(location, 'Unknown') AS v FROM L))
  SELECT ad_id, seq_part, seq_supp, code AS location_enc, CAST(is_retailer AS INT) AS is_retailer_enc
  FROM L JOIN C ON coalesce(location, 'Unknown') = v""")
def label_encode_query(spark, d):
    return label_encode(listings(spark, d), "location", "location_enc").select(
        "ad_id", "seq_part", "seq_supp", "location_enc", F.col("is_retailer").cast("int").alias("is_retailer_enc"))


@query("split_counts", f"""{L}, B AS (SELECT CAST(('0x' || substr(md5(concat(ad_id, '#42')), 1, 8)) AS UBIGINT) / 4294967296.0 < 0.2
    AS is_test FROM L) SELECT is_test, count(*) AS n FROM B GROUP BY ALL""")
def split_counts(spark, d):
    return with_split(listings(spark, d), "ad_id").groupBy("is_test").agg(F.count("*").alias("n"))


@query("exact_split", f"""{L}, B AS (SELECT *, CAST(('0x' || substr(md5(concat(ad_id, '#42')), 1, 8)) AS UBIGINT) AS h FROM L),
  C AS (SELECT row_number() OVER (ORDER BY h, ad_id) <= ceil(0.2 * count(*) OVER ()) AS is_test, h FROM B)
  SELECT is_test, count(*) AS n, min(h) / 4294967296.0 AS least, max(h) / 4294967296.0 AS most FROM C GROUP BY 1""")
def exact_split(spark, d):
    """Exactly a fifth of the rows, rounded up, by the smallest hashes."""
    parts = with_exact_split(listings(spark, d), "ad_id")
    share = hash_share(F.col("ad_id"))
    return parts.groupBy("is_test").agg(F.count("*").alias("n"), F.min(share).alias("least"), F.max(share).alias("most"))


# ---- association -------------------------------------------------------------------------

_FEATURES, _FLAGS, _TITLE = PRICE_FEATURES, DISCRETE_PRICE_FEATURES, TITLE_FEATURES
_CONTINUOUS = [f for f in _FEATURES if f not in _FLAGS]
_CORR = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr(CAST(CAST({f} AS INT) AS DOUBLE), log_price) AS r FROM T" if f in _FLAGS else
    f"SELECT '{f}' AS feature, corr(CAST({f} AS DOUBLE), log_price) AS r FROM T" for f in _FEATURES)


def _nan_free(c: str) -> str:
    return f"round(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, 6)"


@query("feature_correlation", f"{T} SELECT feature, {_nan_free('r')} AS r FROM ({_CORR})")
def feature_correlation(spark, d):
    return rounded(profile.feature_correlation(titled(spark, d), _FEATURES), 6, "r")


def _mi_sql(bins: int) -> str:
    probs = "[" + ", ".join(str(i / bins) for i in range(1, bins)) + "]"
    number = lambda c: f"coalesce(CAST({c} AS DOUBLE), 0)"
    numbers = [*_CONTINUOUS, "log_price"]
    edges = ", ".join(f"list_distinct(quantile_cont({number(c)}, {probs})) AS e_{c}" for c in numbers)
    cell = lambda c: f"len(list_filter(e_{c}, lambda e: e < {number(c)}))"
    parts = [f"SELECT '{c}' AS feature, coalesce({c}, 'Unknown') AS x, {cell('log_price')} AS y FROM T, E" for c in _TITLE]
    parts += [f"SELECT '{c}', CAST(CAST(coalesce({c}, false) AS INT) AS VARCHAR), {cell('log_price')} FROM T, E" for c in _FLAGS]
    parts += [f"SELECT '{c}', CAST({cell(c)} AS VARCHAR), {cell('log_price')} FROM T, E" for c in _CONTINUOUS]
    return f"""{T}, E AS (SELECT {edges} FROM T), C AS ({" UNION ALL ".join(parts)}),
  J AS (SELECT feature, x, y, count(*) AS nxy FROM C GROUP BY ALL),
  N AS (SELECT *, sum(nxy) OVER (PARTITION BY feature, x) AS nx, sum(nxy) OVER (PARTITION BY feature, y) AS ny,
    sum(nxy) OVER (PARTITION BY feature) AS n FROM J),
  MI AS (SELECT feature, greatest(sum(CAST(nxy AS DOUBLE) / n * ln(CAST(nxy AS DOUBLE) * n / (CAST(nx AS DOUBLE) * ny))), 0) AS mi
    FROM N GROUP BY 1)"""


@query("mutual_information", f"{_mi_sql(10)} SELECT feature, round(mi, 6) AS mi FROM MI")
def mutual_information(spark, d):
    return rounded(profile.mutual_information(titled(spark, d), [*_TITLE, *_FLAGS], _CONTINUOUS), 6, "mi")


@query("feature_shortlist", f"""{_mi_sql(10)}, CO AS ({_CORR})
  SELECT MI.feature, CASE WHEN CO.feature IS NULL THEN 'categorical' ELSE 'numeric' END AS kind, round(mi, 6) AS mi,
    {_nan_free('r')} AS r FROM MI LEFT JOIN CO ON CO.feature = MI.feature""")
def feature_shortlist(spark, d):
    return rounded(profile.feature_shortlist(titled(spark, d), _TITLE, _FEATURES, _FLAGS), 6, "mi", "r")


# In millionths, so that distances are whole numbers in both engines.
_MILLIONTHS = "CAST(round(log_price * 1000000) AS BIGINT)"


def _digamma_sql(n: str) -> str:
    table = [-0.57721566490153286061]
    for i in range(1, 15):
        table.append(table[-1] + 1 / i)
    x = f"CAST({n} AS DOUBLE)"
    q = f"(1 / ({x} * {x}))"
    return (f"CASE WHEN {n} < 16 THEN list_extract({table}, CAST({n} AS INT)) ELSE "
            f"ln({x}) - 0.5 / {x} - {q} * (1.0 / 12 - {q} * (1.0 / 120 - {q} * (1.0 / 252 - {q} * (1.0 / 240 - {q} / 132)))) END")


_LABELLED = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, coalesce({c}, 'Unknown') AS label, {_MILLIONTHS} AS y FROM T" for c in TITLE_FEATURES]
    + [f"SELECT '{c}', CAST(CAST(coalesce({c}, false) AS INT) AS VARCHAR), {_MILLIONTHS} FROM T" for c in DISCRETE_PRICE_FEATURES])
_GAP = "greatest(y - lag(y, {0}) OVER w, lead(y, {1}) OVER w - y)"
_ONE_SIDED = ("lead(y, {0}) OVER w - y", "y - lag(y, {0}) OVER w")


def _radius_sql(k: int) -> str:
    """Distance to the k-th nearest in a sorted partition; neighbours beyond its ends are null and do not count."""
    two_sided = ["CASE WHEN lag(y, {0}) OVER w IS NOT NULL AND lead(y, {1}) OVER w IS NOT NULL THEN {2} END".format(j, k - j, _GAP.format(j, k - j))
                 for j in range(1, k)]
    return f"least({', '.join([*(e.format(k) for e in _ONE_SIDED), *two_sided])})"


@query("neighbour_information_discrete", f"""{T}, V AS ({_LABELLED}), C AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS c FROM V),
  R AS (SELECT feature, y, c, least(3, c - 1) AS k, CASE WHEN c = 2 THEN {_radius_sql(1)} WHEN c = 3 THEN {_radius_sql(2)} ELSE {_radius_sql(3)} END AS r
    FROM C WHERE c > 1 WINDOW w AS (PARTITION BY feature, label ORDER BY y)),
  M AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY y RANGE BETWEEN greatest(r - 1, 0) PRECEDING AND greatest(r - 1, 0) FOLLOWING) AS m FROM R),
  N AS (SELECT feature, count(*) AS n, avg({_digamma_sql("k")}) AS a, avg({_digamma_sql("c")}) AS b, avg({_digamma_sql("m")}) AS d FROM M GROUP BY 1)
  SELECT feature, round(greatest({_digamma_sql("n")} + a - b - d, 0), 6) AS mi FROM N""")
def neighbour_information_discrete(spark, d):
    """Nearest-neighbour information of the discrete features, distances in millionths of the log price."""
    rows = titled(spark, d).select(F.expr(_MILLIONTHS).cast("double").alias("y"), F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit("Unknown")).alias("label")) for c in _TITLE],
        *[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("int").cast("string"), F.lit("0")).alias("label")) for c in _FLAGS])).alias("f"))
    return rounded(information.discrete_information(rows.select("f.*", "y")), 6, "mi")


@query("neighbour_information")
def neighbour_information(spark, d):
    """All features against the log price; in SQL every pair of rows would be compared."""
    return rounded(information.neighbour_information(titled(spark, d), [*_TITLE, *_FLAGS], _CONTINUOUS), 6, "mi")
