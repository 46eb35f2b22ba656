"""Listings, search pages and item pages derived from the star-schema test tables.

The listing view is a plain join.  Search pages and item pages are what a crawler would have
landed, so they are written once per session below the shared folder and then scanned like
any other landed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.constants import (CURRENCY, FLAG_BUY_NOW, FLAG_PRIVATE, FLAG_RETAILER,
                              FLAG_SHIPPING, MAX_PAGES, PAGE_SIZE)
from adlens.operators.ingest import keep_first
from adlens.operators.ranking import ordered_positions
from adlens.session import land, landings_dropped, scratch_path, write_scratch
from adlens.sources.tables import read_table

# The same text runs in Spark and in the SQL engine that checks the results.
LISTINGS_SQL = """
SELECT
  concat(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING)) AS ad_id,
  l.l_partkey AS seq_part, l.l_suppkey AS seq_supp,
  p.p_type AS search_query,
  concat(p.p_name, ' ', p.p_brand, CASE WHEN l.l_partkey % 7 = 0 THEN ' 1987' ELSE '' END) AS heading,
  CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE n.n_name END AS location,
  CASE WHEN l.l_orderkey % 20 = 0 THEN NULL WHEN l.l_orderkey % 20 = 1 THEN 0.0 ELSE l.l_extendedprice END AS price_amount,
  CASE l.l_returnflag WHEN 'N' THEN 'Til salgs' WHEN 'A' THEN 'Gis bort' ELSE 'Ønskes kjøpt' END AS trade_type,
  l.l_linestatus = 'O' AS is_private,
  l.l_linestatus = 'F' AS is_retailer,
  l.l_discount > 0.05 AS has_shipping,
  l.l_tax > 0.04 AS has_buy_now,
  l.l_linenumber = 1 AS is_promoted,
  CAST(l.l_quantity AS INT) % 15 AS num_images,
  CASE WHEN l.l_partkey % 25 = 0 THEN NULL ELSE l.l_shipdate END AS timestamp_dt,
  p.p_brand AS brand,
  CASE WHEN l.l_linestatus = 'F' THEN s.s_name END AS organisation_name,
  CAST(58 + n.n_nationkey * 0.5 AS DOUBLE) AS coordinates_lat,
  CASE WHEN l.l_suppkey % 13 = 0 THEN NULL ELSE CAST(5 + l.l_suppkey % 100 * 0.25 AS DOUBLE) END AS coordinates_lon
FROM {lineitem} l
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {nation} n ON s.s_nationkey = n.n_nationkey
"""

# Crawl order, made total by the columns that follow the price.
CRAWL_ORDER = ["price_missing", "price_amount", "ad_id", "seq_part", "seq_supp", "num_images",
               "trade_type", "has_shipping", "has_buy_now", "timestamp_dt"]

# Some hundred search pages, which are 30 KB each.
PAGE_ROW_GROUP = 2 << 20

_landed: dict[tuple[str, str, str], str] = {}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing view."""
    tables = {t: read_table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation")}
    return (spark.sql(LISTINGS_SQL, **tables)
            .withColumn("price_amount", F.col("price_amount").cast("double"))
            .withColumn("timestamp_dt", F.col("timestamp_dt").cast("timestamp")))


def crawl_sequence(df: DataFrame) -> Column:
    """Position in the crawl as a comparable struct: per query by price, priced rows first."""
    return F.struct("search_query", F.col("price_amount").isNull().alias("price_missing"),
                    *[c for c in CRAWL_ORDER if c != "price_missing"])


def first_listings(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """One row per ad: its first sighting in the crawl; ``columns`` are what is needed besides ``ad_id``."""
    df = listings(spark, sf_dir)
    return keep_first(df, ["ad_id"], crawl_sequence(df), columns)


def landed_path(spark: SparkSession, sf_dir: str, label: str, build) -> str:
    """Write ``build()`` as Parquet once per application and table folder; return its path."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _landed:
        path = scratch_path(spark, label)
        with landings_dropped(spark):
            write_scratch(build(), path, PAGE_ROW_GROUP)
        _landed[key] = path
    return _landed[key]


def landed_table(spark: SparkSession, sf_dir: str, label: str, build) -> DataFrame:
    return spark.read.parquet(landed_path(spark, sf_dir, label, build))


def image_urls(count: Column, ad_id: Column) -> Column:
    return F.transform(
        F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("https://img.example.test/"), ad_id, F.lit("/"), i.cast("string")))


# What a document is made of.
_DOC_COLUMNS = ["ad_id", "heading", "location", "trade_type", "organisation_name", "price_amount", "coordinates_lat",
                "coordinates_lon", "is_private", "is_retailer", "has_shipping", "has_buy_now", "brand", "num_images", "timestamp_dt"]


def _search_doc(ad: Column) -> Column:
    flag = lambda c, name: F.when(ad[c], F.array(F.lit(name))).otherwise(
        F.array().cast("array<string>"))
    return F.struct(
        *[ad[c].alias(c) for c in ("ad_id", "heading", "location", "trade_type", "organisation_name")],
        F.concat(F.lit("/item/"), ad["ad_id"]).alias("canonical_url"),
        F.struct(ad["price_amount"].alias("amount"),
                 F.lit(CURRENCY).alias("currency_code")).alias("price"),
        F.struct(ad["coordinates_lat"].alias("lat"),
                 ad["coordinates_lon"].alias("lon")).alias("coordinates"),
        F.concat(flag("is_private", FLAG_PRIVATE), flag("is_retailer", FLAG_RETAILER),
                 flag("has_shipping", FLAG_SHIPPING), flag("has_buy_now", FLAG_BUY_NOW)
                 ).alias("flags"),
        F.array(F.struct(F.lit("brand").alias("id"), F.lit("Merke").alias("label"),
                         F.array(ad["brand"]).alias("values"))).alias("extras"),
        F.when(ad["has_buy_now"], F.array(F.struct(
            F.lit("fiks_ferdig").alias("id"), F.lit("Fiks ferdig").alias("text")))).alias("labels"),
        image_urls(ad["num_images"], ad["ad_id"]).alias("image_urls"),
        F.unix_millis(ad["timestamp_dt"]).alias("timestamp"))


def _build_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ads are shuffled twice: into crawl order, and as bare columns to their page, where the documents are made."""
    df = listings(spark, sf_dir).where(F.col("search_query").isNotNull()) \
        .withColumn("price_missing", F.col("price_amount").isNull())
    df = df.select(*dict.fromkeys(["search_query", *CRAWL_ORDER, *_DOC_COLUMNS, "is_promoted"]))
    range_no = F.floor(F.col("page_no") / MAX_PAGES).cast("int")
    placed = (ordered_positions(df, CRAWL_ORDER, group_by=["search_query"])
              .withColumn("page_no", (F.col("position") / PAGE_SIZE).cast("bigint"))
              .withColumn("range_no", range_no)
              .withColumn("is_top", F.col("is_promoted") & (F.col("position") % PAGE_SIZE == 0)))
    # A row per price range of 50 pages.
    totals = placed.groupBy("search_query").agg(F.count("*").alias("total"))
    ranges = land(placed.groupBy("search_query", "range_no").agg(F.floor(F.min("price_amount")).alias("lowest"))
                  .join(totals, "search_query").select(
        "search_query", "range_no", F.when(F.col("range_no") == 0, 0).otherwise(F.col("lowest")).alias("price_from"),
        "total", F.ceil(F.col("total") / PAGE_SIZE).alias("last")), "ranges")
    of_range = ["search_query", "range_no", "price_from", "total", "last"]
    filled = placed.join(ranges, ["search_query", "range_no"]).groupBy(*of_range, "page_no").agg(
        F.sort_array(F.collect_list(F.struct("position", "is_top", *_DOC_COLUMNS))).alias("ads"))
    # A crawl ends each price range by fetching one empty page, unless the page cap ended it.
    empty = (ranges.where((F.col("last") % MAX_PAGES != 0) & (F.floor(F.col("last") / MAX_PAGES) == F.col("range_no")))
             .withColumn("page_no", F.col("last"))
             .withColumn("ads", F.array().cast(filled.schema["ads"].dataType)))
    allp = filled.unionByName(empty)
    first_top = F.try_element_at(F.filter("ads", lambda ad: ad["is_top"]), F.lit(1))
    metadata = F.struct(
        F.struct((F.col("page_no") + 1).alias("current"), F.col("last")).alias("paging"),
        F.struct(F.col("total").alias("match_count"),
                 F.col("last").alias("group_count")).alias("result_size"),
        F.struct(F.array("search_query").alias("q")).alias("params"),
        (F.col("page_no") + 1 >= F.col("last")).alias("is_end_of_paging"))
    docs = F.to_json(F.struct(F.transform(F.filter("ads", lambda ad: ~ad["is_top"]), _search_doc).alias("docs"),
                              metadata.alias("metadata")))
    entry = F.coalesce(F.concat(F.lit(',{"state":{"data":{"result":{"searchEntry":'),
                                F.when(first_top.isNotNull(), F.to_json(_search_doc(first_top))), F.lit("}}}}")), F.lit(""))
    payload = F.concat(F.lit('{"queries":[{"state":{"data":'), docs, F.lit("}}"), entry, F.lit("]}"))
    blob = F.base64(F.encode(payload, "UTF-8"))
    html = F.concat(F.lit("<html><body><script>var t=1;</script><script type=\"x\">"), blob,
                    F.lit("</script></body></html>"))
    return allp.select(
        "search_query", "range_no", "price_from",
        (F.col("page_no") % MAX_PAGES + 1).cast("int").alias("page"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_no") * 60).alias("fetched_at"),
        html.alias("html"))


def damaged_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed search pages with some payloads cut short, without documents, or missing, by page number."""
    cut = F.when(F.col("page") % 7 == 3, F.substring("html", 1, 80)).when(
        F.col("page") % 7 == 5, F.lit('<script>eyJxdWVyaWVzIjpbXX0=</script>')).when(F.col("page") % 7 == 6, None)
    return search_pages(spark, sf_dir).withColumn("html", F.when(F.col("page") % 7 < 3, F.col("html")).when(
        F.col("page") % 7 == 4, F.col("html")).otherwise(cut))


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed search pages, 50 ads each, in price ranges of at most 50 pages."""
    return landed_table(spark, sf_dir, "search-pages", lambda: _build_search_pages(spark, sf_dir))


def search_pages_path(spark: SparkSession, sf_dir: str) -> str:
    return landed_path(spark, sf_dir, "search-pages", lambda: _build_search_pages(spark, sf_dir))


def _build_item_pages(spark: SparkSession, sf_dir: str, damaged: bool) -> DataFrame:
    df = first_listings(spark, sf_dir)
    item = F.struct(
        F.concat("heading", F.lit(" æøå")).alias("title"),
        F.col("price_amount").alias("price"),
        F.array(F.struct(F.lit("brand").alias("id"), F.col("brand").alias("value"),
                         F.concat(F.lit("b"), "seq_part").alias("valueId")),
                F.struct(F.lit("condition").alias("id"), F.lit("Pent brukt").alias("value"),
                         F.lit(None).cast("string").alias("valueId"))).alias("extras"),
        F.struct(F.lit("c1").alias("id"), F.col("search_query").alias("value"),
                 F.struct(F.lit("c2").alias("id"), F.col("brand").alias("value"),
                          F.struct(F.lit("c3").alias("id"), F.lit("Torget").alias("value")
                                   ).alias("parent")).alias("parent")).alias("category"),
        F.transform(image_urls(F.col("num_images"), F.col("ad_id")),
                    lambda u: F.struct(u.alias("uri"))).alias("images"),
        F.struct(F.struct(F.col("coordinates_lat").alias("lat"),
                          F.col("coordinates_lon").alias("lng"),
                          F.lit(10.0).alias("accuracy")).alias("position"),
                 F.lit("0150").alias("postalCode"), F.col("location").alias("postalName"),
                 F.lit("NO").alias("countryCode")).alias("location"),
        F.struct(F.col("ad_id").alias("adId"),
                 F.col("seq_supp").cast("string").alias("ownerId"),
                 F.col("num_images").alias("edition")).alias("meta"))
    section = F.to_json(F.struct(
        item.alias("itemData"),
        F.struct(F.col("has_shipping").alias("eligibleForShipping"),
                 F.col("has_buy_now").alias("buyNow"),
                 F.concat(F.lit("carrier "), "seq_part").alias("carrier")).alias("transactableData"),
        F.struct(F.concat(F.lit("https://ads.example.test/item/"), "ad_id").alias("canonical")
                 ).alias("meta")))
    loader_key = F.when(F.col("is_retailer"), "item-bap").otherwise("item-recommerce")
    data = F.concat(F.lit('{"loaderData":{"root":{},"'), loader_key, F.lit('":'), section, F.lit("}}"))
    literal = F.replace(F.replace(data, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    if damaged:
        literal = F.when(F.col("seq_part") % 50 == 0,
                         F.substring(literal, 1, 60)).otherwise(literal)
    profile = F.to_json(F.struct(F.struct(
        F.col("organisation_name").alias("orgName"),
        F.col("seq_supp").cast("string").alias("orgId"),
        F.lit("https://img.example.test/logo").alias("logo"),
        F.array(F.struct(F.concat(F.lit("Contact "), "seq_supp").alias("name"),
                         F.concat(F.lit("+47 "), "seq_supp").alias("phone"))).alias("contacts")
    ).alias("extendedProfileRecommerce")))
    seller = F.when(F.col("is_retailer"), F.concat(
        F.lit("<p>"), F.col("seq_supp").cast("string"), F.lit(" følger</p>"),
        F.lit('<companyProfilePodlet-isolated a="1"><script>var x;</script><script>'),
        profile, F.lit("</script></companyProfilePodlet-isolated>"))).otherwise("")
    html = F.concat(
        F.lit("<html><body><script>var t=1;</script><script>window.__staticRouterHydrationData = "
              'JSON.parse("'), literal, F.lit('");</script>'), seller, F.lit("</body></html>"))
    return df.select("ad_id", html.alias("html"))


def item_pages(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """Landed item pages, one per ad; ``damaged`` cuts the payload of some of them short."""
    return landed_table(spark, sf_dir, "item-pages-damaged" if damaged else "item-pages",
                        lambda: _build_item_pages(spark, sf_dir, damaged))


def item_pages_path(spark: SparkSession, sf_dir: str) -> str:
    return landed_path(spark, sf_dir, "item-pages", lambda: _build_item_pages(spark, sf_dir, False))
