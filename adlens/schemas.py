"""Declared schemas: the listing table, search documents and item pages."""

# Flat listing table (one row per ad).
LISTING_SCHEMA = """
    ad_id STRING, heading STRING, canonical_url STRING, location STRING, trade_type STRING,
    type STRING, brand STRING, organisation_name STRING, price_amount DOUBLE,
    price_currency_code STRING, price_price_unit STRING, coordinates_lat DOUBLE,
    coordinates_lon DOUBLE, coordinates_accuracy DOUBLE, distance DOUBLE,
    image_urls ARRAY<STRING>, num_images INT, flags STRING, is_private BOOLEAN,
    is_retailer BOOLEAN, has_shipping BOOLEAN, has_buy_now BOOLEAN, is_promoted BOOLEAN,
    label_ids STRING, label_texts STRING, timestamp BIGINT, timestamp_dt TIMESTAMP,
    extras MAP<STRING,STRING>, page_current INT, page_last INT, total_match_count BIGINT,
    total_group_count BIGINT, search_query STRING
"""

# One search document as it stands inside the page payload.  Lists of mixed content stay
# VARIANT elements, so one odd element cannot void the whole document.
SEARCH_DOC = (
    "STRUCT<id: STRING, ad_id: STRING, heading: STRING, canonical_url: STRING, location: STRING,"
    " trade_type: STRING, type: STRING, brand: STRING, organisation_name: STRING,"
    " price: STRUCT<amount: DOUBLE, currency_code: STRING, price_unit: STRING>,"
    " coordinates: STRUCT<lat: DOUBLE, lon: DOUBLE, accuracy: DOUBLE>,"
    " distance: DOUBLE, image_urls: ARRAY<STRING>, flags: ARRAY<STRING>,"
    " labels: ARRAY<STRUCT<id: STRING, text: STRING>>,"
    " extras: ARRAY<STRUCT<id: STRING, label: STRING, values: ARRAY<STRING>>>,"
    " timestamp: STRING>"
)

PAGE_METADATA = (
    "STRUCT<paging: STRUCT<current: INT, last: INT>,"
    " result_size: STRUCT<match_count: BIGINT, group_count: BIGINT>,"
    " params: STRUCT<q: ARRAY<STRING>>, is_end_of_paging: BOOLEAN>"
)

ITEM_DATA = (
    "STRUCT<title: STRING, description: STRING, price: DOUBLE,"
    " extras: ARRAY<STRUCT<id: STRING, value: STRING, valueId: STRING>>,"
    " category: STRUCT<id: STRING, value: STRING, parent: STRUCT<id: STRING, value: STRING,"
    " parent: STRUCT<id: STRING, value: STRING>>>,"
    " images: ARRAY<STRUCT<uri: STRING>>,"
    " location: STRUCT<position: STRUCT<lat: DOUBLE, lng: DOUBLE, accuracy: DOUBLE>,"
    " postalCode: STRING, postalName: STRING, countryCode: STRING>,"
    " meta: STRUCT<adId: STRING, ownerId: STRING>>"
)

ITEM_SECTION = (
    f"STRUCT<itemData: {ITEM_DATA},"
    " transactableData: STRUCT<transactable: BOOLEAN, eligibleForShipping: BOOLEAN, buyNow: BOOLEAN>,"
    " profileData: VARIANT, meta: STRUCT<canonical: STRING, title: STRING>>"
)

COMPANY_PROFILE = (
    "STRUCT<orgName: STRING, orgId: STRING, logo: STRING, homepageUrl: STRING,"
    " moreAdsFromThisCompanyUrl: STRING, contacts: ARRAY<STRUCT<name: STRING, phone: STRING>>>"
)
