"""Queries over landed search pages, crawl rules, and the listing files."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.constants import MAX_PAGES
from adlens.functions.payload import (first_with, payload_queries, script_blobs, script_bodies, search_payload,
                                      tolerant_base64)
from adlens.functions.text import absolute_url
from adlens.operators import ingest, search_pages as sp
from adlens.operators.ranking import ordered_positions
from adlens.plans.jobs import collect_to_tables
from adlens.plans.registry import CRAWL, D, L, P, query
from adlens.session import scratch_path
from adlens.sources import fixtures, tables

PAGE_KEYS = ["search_query", "range_no", "page"]
BASE = "https://ads.example.test"


def _rows(spark, d):
    """Flat listing rows with their landing place."""
    pages = fixtures.search_pages(spark, d)
    return sp.parse_search_pages(
        pages.withColumnsRenamed({"search_query": "landed_query"}), ["landed_query", "range_no", "page"])


@query("read_listings_csv", f"""{L} SELECT ad_id, seq_part, seq_supp, search_query, heading, location,
  price_amount, trade_type, is_private, num_images, epoch_ms(timestamp_dt) AS ts_ms, coordinates_lon FROM L""")
def read_listings_csv(spark, d):
    df = fixtures.listings(spark, d)
    path = scratch_path(spark, "listings-csv")
    tables.write_listings_csv(df, path)
    back = tables.read_listings_csv(spark, path, df.schema)
    return back.select("ad_id", "seq_part", "seq_supp", "search_query", "heading", "location", "price_amount",
                       "trade_type", "is_private", "num_images",
                       F.unix_millis("timestamp_dt").alias("ts_ms"), "coordinates_lon")


@query("sink_raw_prepared", f"""{D}, C AS (SELECT ad_id, price_amount, concat(heading, ' ', location) AS text,
    trim(concat(heading, ' ', coalesce(location, ''))) AS full_text,
    epoch_ms(timestamp_dt) / 1000.0 AS secs FROM D),
  T AS (SELECT median(secs) AS m FROM C WHERE price_amount IS NOT NULL)
  SELECT ad_id, price_amount, full_text AS text, round(coalesce(secs, m), 3) AS timestamp_val
  FROM C, T WHERE price_amount IS NOT NULL""")
def sink_raw_prepared(spark, d):
    raw, prepared = scratch_path(spark, "raw"), scratch_path(spark, "prepared")
    collect_to_tables(fixtures.search_pages(spark, d), raw, prepared)
    return spark.read.parquet(prepared).select(
        "ad_id", "price_amount", "text", F.round("timestamp_val", 3).alias("timestamp_val"))


@query("scan_search_pages", f"""{P}, F AS (SELECT search_query, range_no, page, page_no, last_page FROM P
    GROUP BY ALL), E AS (SELECT DISTINCT search_query, last_page FROM P WHERE last_page % 50 <> 0)
  SELECT search_query, range_no, page, epoch_ms(TIMESTAMP '2024-01-01') + page_no * 60000 AS fetched_ms FROM F
  UNION ALL SELECT search_query, CAST(last_page // 50 AS INT), CAST(last_page % 50 + 1 AS INT),
    epoch_ms(TIMESTAMP '2024-01-01') + last_page * 60000 FROM E""")
def scan_search_pages(spark, d):
    pages = tables.scan_search_pages(spark, fixtures.search_pages_path(spark, d))
    return pages.where(F.length("html") > 0).select(*PAGE_KEYS, F.unix_millis("fetched_at").alias("fetched_ms"))


@query("concat_pages", f"""{P} SELECT ad_id, search_query, price_amount, is_private,
  organisation_name, CASE WHEN is_private THEN has_buy_now END AS has_buy_now FROM P""")
def concat_pages(spark, d):
    rows = _rows(spark, d).select("ad_id", "search_query", "price_amount", "is_private",
                                  "organisation_name", "has_buy_now")
    private = rows.where("is_private").drop("organisation_name")
    retail = rows.where("NOT is_private").drop("has_buy_now")
    return tables.combine_frames([private, retail])


@query("extract_script_blobs", f"""{P}, G AS (SELECT search_query, range_no, page, last_page FROM P GROUP BY ALL)
  SELECT search_query, range_no, page, 0 AS idx, 'eyJ' AS head, true AS names_query FROM G
  UNION ALL SELECT DISTINCT search_query, CAST(last_page // 50 AS INT), CAST(last_page % 50 + 1 AS INT), 0, 'eyJ', true
    FROM G WHERE last_page % 50 <> 0""")
def extract_script_blobs(spark, d):
    pages = fixtures.search_pages(spark, d)
    blobs = pages.select(*PAGE_KEYS, F.posexplode(script_blobs(F.col("html"))).alias("idx", "blob"))
    named = F.contains(tolerant_base64(F.col("blob")), F.concat(F.lit('"q":["'), "search_query", F.lit('"]')))
    return blobs.select(*PAGE_KEYS, "idx", F.substring("blob", 1, 3).alias("head"), named.alias("names_query"))


@query("safe_base64", """SELECT doc_id, md5(text) AS plain, md5(text) AS unpadded, md5(text) AS littered,
  true AS bad_is_null FROM documents""")
def safe_base64(spark, d):
    docs = tables.read_table(spark, d, "documents")
    code = F.base64(F.encode("text", "UTF-8"))
    digest = lambda c: F.md5(tolerant_base64(c).cast("binary"))
    return docs.select(
        "doc_id", digest(code).alias("plain"), digest(F.rtrim(code, F.lit("="))).alias("unpadded"),
        digest(F.concat(F.lit("!"), code, F.lit("*"))).alias("littered"),
        tolerant_base64(F.concat(F.replace(F.rtrim(code, F.lit("=")), F.lit("\r\n"), F.lit("")),
                                 F.lit("====="))).isNull().alias("bad_is_null"))


_PER_PAGE = f"""{P}, G AS (SELECT search_query, range_no, page, last_page, total,
    count(*) FILTER (WHERE NOT is_promoted) AS n_docs, bool_or(is_promoted) AS has_top,
    max(ad_id) FILTER (WHERE is_promoted) AS top_ad,
    max(price_amount) FILTER (WHERE NOT is_promoted) AS page_max FROM P GROUP BY ALL),
  E AS (SELECT DISTINCT search_query, CAST(last_page // 50 AS INT) AS range_no,
    CAST(last_page % 50 + 1 AS INT) AS page, last_page, total FROM P WHERE last_page % 50 <> 0)"""


@query("first_payload", f"""{_PER_PAGE} SELECT search_query, range_no, page,
    CASE WHEN has_top THEN 2 ELSE 1 END AS n_queries FROM G
  UNION ALL SELECT search_query, range_no, page, 1 FROM E""")
def first_payload(spark, d):
    pages = fixtures.search_pages(spark, d)
    return pages.select(*PAGE_KEYS, F.size(payload_queries(search_payload(F.col("html")))).alias("n_queries"))


@query("search_docs", f"""{_PER_PAGE} SELECT search_query, range_no, page, n_docs FROM G
  UNION ALL SELECT search_query, range_no, page, 0 FROM E""")
def search_docs(spark, d):
    pages = fixtures.search_pages(spark, d)
    queries = payload_queries(search_payload(F.col("html")))
    docs = F.try_variant_get(first_with(queries, "$.state.data.docs"), "$.state.data.docs", "array<variant>")
    return pages.select(*PAGE_KEYS, F.size(docs).alias("n_docs"))


@query("promoted_entry", f"""{_PER_PAGE} SELECT search_query, range_no, page, top_ad FROM G
  UNION ALL SELECT search_query, range_no, page, NULL FROM E""")
def promoted_entry(spark, d):
    parsed = sp.parse_pages(fixtures.search_pages(spark, d))
    return parsed.select(*PAGE_KEYS, F.try_variant_get("promoted", "$.ad_id", "string").alias("top_ad"))


@query("explode_listings", f"{P} SELECT search_query, range_no, page, pos, ad_id, is_promoted FROM P")
def explode_listings(spark, d):
    rows = sp.explode_listings(sp.parse_pages(fixtures.search_pages(spark, d)), PAGE_KEYS)
    return rows.select(*PAGE_KEYS, "pos", F.col("doc.ad_id").alias("ad_id"), "is_promoted")


@query("flatten_struct", f"""{P} SELECT ad_id, search_query, pos, range_no, page, price_amount, 'NOK' AS price_currency_code,
  coordinates_lat, coordinates_lon FROM P""")
def flatten_struct(spark, d):
    rows = sp.explode_listings(sp.parse_pages(fixtures.search_pages(spark, d)), PAGE_KEYS)
    flat = sp.flatten_struct(rows.select(*PAGE_KEYS, "pos", "doc.ad_id", "doc.price", "doc.coordinates"))
    return flat.drop("price_price_unit", "coordinates_accuracy")


@query("json_props_extract", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""")
def json_props_extract(spark, d):
    events = tables.read_table(spark, d, "events")
    return sp.flatten_struct(events.select("event_id", F.from_json("props", "k BIGINT").alias("props")))


@query("extras_map", f"{P} SELECT search_query, range_no, page, pos, 'brand' AS key, brand AS value FROM P")
def extras_map(spark, d):
    rows = _rows(spark, d)
    return rows.select("search_query", "range_no", "page", "pos", F.explode("extras").alias("key", "value"))


@query("extras_pivot", f"""{P} SELECT search_query, range_no, page, pos, brand AS extra_brand,
  CAST(NULL AS VARCHAR) AS extra_colour FROM P""")
def extras_pivot(spark, d):
    wide = sp.extras_columns(_rows(spark, d), ["brand", "colour"])
    return wide.select("search_query", "range_no", "page", "pos", "extra_brand", "extra_colour")


@query("labels_join", f"""{P} SELECT search_query, range_no, page, pos,
  CASE WHEN has_buy_now THEN 'fiks_ferdig' END AS label_ids,
  CASE WHEN has_buy_now THEN 'Fiks ferdig' END AS label_texts FROM P""")
def labels_join(spark, d):
    return _rows(spark, d).select("search_query", "range_no", "page", "pos", "label_ids", "label_texts")


@query("flag_booleans", f"""{P} SELECT search_query, range_no, page, pos, is_private, is_retailer, has_shipping,
  has_buy_now, nullif(concat_ws(', ', CASE WHEN is_private THEN 'private' END,
    CASE WHEN is_retailer THEN 'retailer' END, CASE WHEN has_shipping THEN 'shipping_exists' END,
    CASE WHEN has_buy_now THEN 'buy_now' END), '') AS flags FROM P""")
def flag_booleans(spark, d):
    return _rows(spark, d).select("search_query", "range_no", "page", "pos", "is_private", "is_retailer",
                                  "has_shipping", "has_buy_now", "flags")


@query("num_images", f"{P} SELECT search_query, range_no, page, pos, num_images FROM P")
def num_images(spark, d):
    return _rows(spark, d).select("search_query", "range_no", "page", "pos", "num_images")


@query("epoch_ms_to_ts", f"""{P} SELECT search_query, range_no, page, pos, epoch_ms(timestamp_dt) AS ms,
  strftime(timestamp_dt, '%Y-%m-%d %H:%M:%S') AS shown FROM P""")
def epoch_ms_to_ts(spark, d):
    return _rows(spark, d).select("search_query", "range_no", "page", "pos", F.col("timestamp").alias("ms"),
                                  F.date_format("timestamp_dt", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("page_metadata", f"""{P} SELECT search_query, range_no, page, pos, CAST(page_no + 1 AS INT) AS page_current,
  CAST(last_page AS INT) AS page_last, total AS total_match_count, last_page AS total_group_count FROM P""")
def page_metadata(spark, d):
    return _rows(spark, d).select("search_query", "range_no", "page", "pos", "page_current", "page_last",
                                  "total_match_count", "total_group_count")


@query("search_quarantine", f"""{P}, G AS (SELECT search_query, range_no, page, last_page FROM P GROUP BY ALL),
  A AS (SELECT search_query, range_no, page FROM G UNION ALL
    SELECT DISTINCT search_query, CAST(last_page // 50 AS INT), CAST(last_page % 50 + 1 AS INT) FROM G WHERE last_page % 50 <> 0)
  SELECT search_query, range_no, page, CASE WHEN page % 7 = 5 THEN 'no docs' ELSE 'no payload' END AS parse_error,
    CASE page % 7 WHEN 3 THEN 80 WHEN 5 THEN 37 ELSE 0 END AS html_chars FROM A WHERE page % 7 IN (3, 5, 6)""")
def search_quarantine(spark, d):
    """Every landed page that gives no documents, and why."""
    return sp.unreadable_pages(sp.parse_pages(fixtures.damaged_search_pages(spark, d)), PAGE_KEYS)


@query("page_scripts", r"""WITH S AS (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS s FROM pages)
  SELECT page_id, len(s) AS n_scripts, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS script_chars,
    md5(array_to_string(s, '|')) AS digest FROM S""")
def page_scripts(spark, d):
    """Script bodies of the crawled pages as they are given."""
    found = tables.read_table(spark, d, "pages").select("page_id", script_bodies(F.col("html")).alias("s"))
    chars = F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    return found.select("page_id", F.size("s").cast("bigint").alias("n_scripts"), chars.alias("script_chars"),
                        F.md5(F.array_join("s", "|")).alias("digest"))


_DECLARED = ["ad_id", "heading", "price", "image_urls", "extras", "labels", "flags", "coordinates"]


@query("open_fields", f"""{P}, E AS (SELECT search_query, range_no, page, pos, 'location' AS field, '"' || location || '"' AS value FROM P
    UNION ALL SELECT search_query, range_no, page, pos, 'trade_type', '"' || trade_type || '"' FROM P
    UNION ALL SELECT search_query, range_no, page, pos, 'organisation_name', '"' || organisation_name || '"' FROM P
    UNION ALL SELECT search_query, range_no, page, pos, 'canonical_url', '"/item/' || ad_id || '"' FROM P
    UNION ALL SELECT search_query, range_no, page, pos, 'timestamp', CAST(epoch_ms(timestamp_dt) AS VARCHAR) FROM P)
  SELECT * FROM E WHERE value IS NOT NULL""")
def open_fields(spark, d):
    """Fields of a document that a caller has not declared, by name."""
    rows = sp.explode_listings(sp.parse_pages(fixtures.search_pages(spark, d)), PAGE_KEYS, include_raw=True)
    return rows.select(*PAGE_KEYS, "pos", F.explode(sp.open_fields(F.col("raw"), _DECLARED)).alias("field", "value"))


@query("collect_listings", f"""{P}, F AS (SELECT *, row_number() OVER (PARTITION BY ad_id ORDER BY search_query, position)
    AS rn FROM P) SELECT ad_id, search_query, heading, location, price_amount, is_promoted, num_images,
  CAST(page_no + 1 AS INT) AS page_current, organisation_name FROM F WHERE rn = 1""")
def collect_listings(spark, d):
    columns = ["search_query", "heading", "location", "price_amount", "is_promoted", "num_images", "page_current", "organisation_name"]
    return sp.collect_listings(fixtures.search_pages(spark, d), columns=columns).select("ad_id", *columns)


@query("collect_one_query", f"""{P}, F AS (SELECT *, row_number() OVER (PARTITION BY ad_id ORDER BY search_query, position)
    AS rn FROM P WHERE search_query = 'PROMO' AND page <= 10) SELECT ad_id, heading, price_amount, true AS has_raw
  FROM F WHERE rn = 1""")
def collect_one_query(spark, d):
    rows = sp.collect_listings(fixtures.search_pages(spark, d), query="PROMO", max_pages=10, include_raw=True)
    same = F.try_variant_get("raw", "$.ad_id", "string") == F.col("ad_id")
    return rows.select("ad_id", "heading", "price_amount", same.alias("has_raw"))


# Every fifth price becomes one of tens of millions, some with a fraction.
_LARGE = "CASE WHEN seq_part % 5 = 0 THEN floor(price_amount) * 1000 + 10000000.5 WHEN seq_part % 5 = 1 THEN floor(price_amount) * 100000 ELSE price_amount END"


@query("price_display", f"""{L}, X AS (SELECT * REPLACE ({_LARGE} AS price_amount) FROM L) SELECT ad_id AS id, heading AS title, concat('{BASE}/item/', ad_id) AS url, location,
  CASE WHEN price_amount IS NULL THEN 'N/A' WHEN price_amount = floor(price_amount)
    THEN concat(CAST(CAST(price_amount AS BIGINT) AS VARCHAR), ' NOK')
    ELSE concat(rtrim(CAST(CAST(price_amount AS DECIMAL(30, 8)) AS VARCHAR), '0'), ' NOK') END AS price_display,
  CASE WHEN num_images > 0 THEN concat('https://img.example.test/', ad_id, '/1') END AS image_url,
  epoch_ms(timestamp_dt) AS ts_ms FROM X""")
def price_display(spark, d):
    df = fixtures.listings(spark, d).withColumn("price_amount", F.expr(_LARGE)).select(
        "*", F.concat(F.lit("/item/"), "ad_id").alias("canonical_url"), F.lit("NOK").alias("price_currency_code"),
        fixtures.image_urls(F.col("num_images"), F.col("ad_id")).alias("image_urls"))
    return sp.listing_cards(df, BASE).withColumn("ts_ms", F.unix_millis("timestamp")).drop("timestamp")


@query("absolute_url", f"""SELECT page_id, url AS full_url,
  concat('{BASE}', regexp_replace(url, '^https?://[^/]+', '')) AS from_relative FROM pages""")
def absolute_url_query(spark, d):
    pages = tables.read_table(spark, d, "pages")
    relative = F.regexp_replace("url", "^https?://[^/]+", "")
    return pages.select("page_id", absolute_url(F.col("url"), BASE).alias("full_url"),
                        absolute_url(relative, BASE).alias("from_relative"))


@query("page_summary", f"""{_PER_PAGE}, A AS (SELECT search_query, range_no, page, last_page, total, n_docs FROM G
    UNION ALL SELECT search_query, range_no, page, last_page, total, 0 FROM E)
  SELECT search_query, range_no, page, total AS total_matches, CAST(range_no * 50 + page AS INT) AS page_current,
    CAST(last_page AS INT) AS last_page, range_no * 50 + page >= last_page AS is_end, n_docs AS n_rows FROM A""")
def page_summary(spark, d):
    return sp.page_summary(sp.parse_pages(fixtures.search_pages(spark, d)), PAGE_KEYS)


@query("price_cursor", f"""{_PER_PAGE}, T AS (SELECT search_query, range_no, max(page) AS last_page FROM G
    WHERE n_docs > 0 GROUP BY ALL),
  M AS (SELECT search_query, range_no, CASE WHEN any_value(range_no) = 0 THEN 0 ELSE
    CAST(floor(min(price_amount)) AS BIGINT) END AS price_from FROM P GROUP BY search_query, range_no)
  SELECT T.search_query, T.range_no, M.price_from, T.last_page, CAST(floor(G.page_max) AS BIGINT) AS next_price_from,
    coalesce(floor(G.page_max) > M.price_from, false) AS advanced
  FROM T JOIN G ON G.search_query = T.search_query AND G.range_no = T.range_no AND G.page = T.last_page
  JOIN M ON M.search_query = T.search_query AND M.range_no = T.range_no""")
def price_cursor(spark, d):
    keys = ["search_query", "range_no"]
    pages = sp.page_price_max(sp.parse_pages(fixtures.search_pages(spark, d)), [*keys, "price_from", "page"])
    return ingest.price_cursor(pages, keys)


@query("pages_until_empty", f"""{_PER_PAGE} SELECT search_query, range_no, page, n_docs AS n_rows
  FROM G""")
def pages_until_empty(spark, d):
    summary = sp.page_summary(sp.parse_pages(fixtures.search_pages(spark, d)), PAGE_KEYS)
    return ingest.pages_until_empty(summary.select(*PAGE_KEYS, "n_rows"), ["search_query", "range_no"], MAX_PAGES)


@query("dedupe_keep_first", f"""{D} SELECT ad_id, search_query, heading, price_amount, seq_part, seq_supp FROM D""")
def dedupe_keep_first(spark, d):
    columns = ["search_query", "heading", "price_amount", "seq_part", "seq_supp"]
    return fixtures.first_listings(spark, d, columns).select("ad_id", *columns)


@query("price_asc_pages", f"""{L} SELECT search_query, ad_id, seq_part, seq_supp,
  row_number() OVER (PARTITION BY search_query ORDER BY {CRAWL}) - 1 AS position FROM L""")
def price_asc_pages(spark, d):
    df = fixtures.listings(spark, d).withColumn("price_missing", F.col("price_amount").isNull())
    return ordered_positions(df, fixtures.CRAWL_ORDER, ["search_query"]).select(
        "search_query", "ad_id", "seq_part", "seq_supp", "position")
