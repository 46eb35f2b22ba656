"""Queries over landed item pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.functions import payload
from adlens.functions.payload import hydration_texts
from adlens.operators import ingest, item_pages as ip
from adlens.plans.registry import D, query
from adlens.schemas import COMPANY_PROFILE
from adlens.sources import fixtures, tables


def _parsed(spark, d):
    return ip.parse_item_pages(fixtures.item_pages(spark, d))


def _items(spark, d):
    return ip.get_items(fixtures.item_pages(spark, d))


@query("scan_item_pages", f"{D} SELECT ad_id FROM D WHERE ad_id IN (SELECT ad_id FROM L WHERE has_buy_now)")
def scan_item_pages(spark, d):
    wanted = fixtures.listings(spark, d).where("has_buy_now").select("ad_id")
    return tables.scan_item_pages(spark, fixtures.item_pages_path(spark, d), wanted).select("ad_id")


@query("hydration_json", f"""{D} SELECT ad_id, 1 AS n_found, concat(heading, ' æøå') AS title FROM D""")
def hydration_json(spark, d):
    pages = fixtures.item_pages(spark, d)
    texts = pages.select("ad_id", hydration_texts(F.col("html")).alias("t"))
    title = F.regexp_extract(F.get("t", F.lit(0)), '"title":"([^"]*)"', 1)
    return texts.select("ad_id", F.size("t").alias("n_found"), title.alias("title"))


@query("item_section", f"""{D} SELECT ad_id, concat(heading, ' æøå') AS title, price_amount AS price,
  concat('https://ads.example.test/item/', ad_id) AS canonical FROM D""")
def item_section(spark, d):
    s = F.col("section")
    return _parsed(spark, d).select("ad_id", s["itemData"]["title"].alias("title"),
                                    s["itemData"]["price"].alias("price"),
                                    s["meta"]["canonical"].alias("canonical"))


@query("follower_count", f"{D} SELECT ad_id, CASE WHEN is_retailer THEN CAST(seq_supp AS INT) END AS followers FROM D")
def follower_count(spark, d):
    return fixtures.item_pages(spark, d).select("ad_id", payload.follower_count(F.col("html")).alias("followers"))


@query("company_profile", f"""{D} SELECT ad_id, CASE WHEN is_retailer THEN organisation_name END AS org_name,
  CASE WHEN is_retailer THEN CAST(seq_supp AS VARCHAR) END AS org_id FROM D""")
def company_profile(spark, d):
    profile = payload.company_profile(F.col("html"))
    return fixtures.item_pages(spark, d).select(
        "ad_id", F.try_variant_get(profile, "$", COMPANY_PROFILE).alias("c")).select(
        "ad_id", F.col("c.orgName").alias("org_name"), F.col("c.orgId").alias("org_id"))


@query("item_extras", f"""{D} SELECT ad_id, 'extra_brand' AS key, brand AS value FROM D
  UNION ALL SELECT ad_id, 'extra_brand_id', concat('b', CAST(seq_part AS VARCHAR)) FROM D
  UNION ALL SELECT ad_id, 'extra_condition', 'Pent brukt' FROM D""")
def item_extras(spark, d):
    return _items(spark, d).select("ad_id", F.explode("extras").alias("key", "value"))


@query("category_levels", f"""{D} SELECT ad_id, search_query AS category, 'c1' AS category_id, brand AS sub_category,
  'c2' AS sub_category_id, 'Torget' AS top_category, 'c3' AS top_category_id FROM D""")
def category_levels(spark, d):
    return _items(spark, d).select("ad_id", "category", "category_id", "sub_category", "sub_category_id",
                                   "top_category", "top_category_id")


@query("item_images", f"""{D} SELECT ad_id, num_images,
  CASE WHEN num_images > 0 THEN concat('https://img.example.test/', ad_id, '/1') END AS image_url,
  CASE WHEN num_images > 0 THEN concat('https://img.example.test/', ad_id, '/', num_images) END AS last_url FROM D""")
def item_images(spark, d):
    last = F.when(F.size("image_urls") > 0, F.element_at("image_urls", -1))
    return _items(spark, d).select("ad_id", "num_images", "image_url", last.alias("last_url"))


@query("item_location", f"""{D} SELECT ad_id, coordinates_lat AS latitude, coordinates_lon AS longitude,
  10.0 :: DOUBLE AS coord_accuracy, '0150' AS postal_code, location AS postal_name, 'NO' AS country_code FROM D""")
def item_location(spark, d):
    return _items(spark, d).select("ad_id", "latitude", "longitude", "coord_accuracy", "postal_code",
                                   "postal_name", "country_code")


@query("prefix_fields", f"""{D} SELECT ad_id AS "meta_adId", CAST(seq_supp AS VARCHAR) AS "meta_ownerId",
  CAST(NULL AS BOOLEAN) AS txn_transactable, has_shipping AS "txn_eligibleForShipping",
  has_buy_now AS "txn_buyNow" FROM D""")
def prefix_fields(spark, d):
    return _items(spark, d).select("meta_adId", "meta_ownerId", "txn_transactable",
                                   "txn_eligibleForShipping", "txn_buyNow")


@query("open_item_fields", f"""{D} SELECT ad_id, 'meta_edition' AS field, CAST(num_images AS VARCHAR) AS value FROM D
  UNION ALL SELECT ad_id, 'txn_carrier', concat('"carrier ', seq_part, '"') FROM D""")
def open_item_fields(spark, d):
    """Keys of the item sections that no schema declares."""
    items = _items(spark, d)
    parts = [items.select("ad_id", F.explode(f"{p}_rest").alias("field", "value")).withColumn("field", F.concat(F.lit(f"{p}_"), "field"))
             for p in ("meta", "txn")]
    return parts[0].unionByName(parts[1])


@query("seller_columns", f"""{D} SELECT ad_id, concat('https://ads.example.test/item/', ad_id) AS canonical_url,
  CASE WHEN is_retailer THEN CAST(seq_supp AS INT) END AS follower_count,
  CASE WHEN is_retailer THEN organisation_name END AS seller_org_name,
  CASE WHEN is_retailer THEN 'https://img.example.test/logo' END AS seller_logo_url,
  CASE WHEN is_retailer THEN concat('Contact ', CAST(seq_supp AS VARCHAR)) END AS seller_contact_name,
  CASE WHEN is_retailer THEN concat('+47 ', CAST(seq_supp AS VARCHAR)) END AS seller_contact_phone FROM D""")
def seller_columns(spark, d):
    return _items(spark, d).select("ad_id", "canonical_url", "follower_count", "seller_org_name",
                                   "seller_logo_url", "seller_contact_name", "seller_contact_phone")


@query("quarantine_split", f"""{D} SELECT CASE WHEN seq_part % 50 = 0 THEN 'no item section' ELSE 'good' END AS outcome,
  count(*) AS n FROM D GROUP BY ALL""")
def quarantine_split(spark, d):
    parsed = ip.parse_item_pages(fixtures.item_pages(spark, d, damaged=True))
    outcome = F.coalesce("parse_error", F.lit("good"))
    return parsed.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("unfetched_ids", f"""{D} SELECT concat(CAST(o_orderkey AS VARCHAR), '-1') AS ad_id FROM orders
  WHERE concat(CAST(o_orderkey AS VARCHAR), '-1') NOT IN (SELECT ad_id FROM D)""")
def unfetched_ids(spark, d):
    orders = tables.read_table(spark, d, "orders")
    wanted = orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("ad_id"))
    return ingest.without_match(wanted, fixtures.item_pages(spark, d).select("ad_id"), "ad_id")
