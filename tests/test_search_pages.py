from datetime import datetime

from pyspark.sql import functions as F

from adlens.operators import search_pages as sp
from adlens.operators.ingest import pages_until_empty, price_cursor

DOC = {"id": 123, "heading": "Test Item", "canonical_url": "/item/123", "location": "Oslo",
       "price": {"amount": 100, "currency_code": "NOK", "price_unit": None},
       "image_urls": ["https://img.test/1"], "timestamp": 1_700_000_000_000}
META = {"result_size": {"match_count": 1}, "paging": {"current": 1, "last": 1}, "is_end_of_paging": True}


def parse(spark, *htmls, **options):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page INT, html STRING")
    return sp.parse_search_pages(df, ["page"], **options).orderBy("page", "pos").collect()


def test_listing_fields(spark, page):
    df = spark.createDataFrame([(page([DOC], META),)], "html STRING")
    parsed = sp.parse_pages(df)
    summary = sp.page_summary(parsed).first()
    assert (summary.total_matches, summary.is_end, summary.page_current, summary.n_rows) == (1, True, 1, 1)
    card = sp.listing_cards(sp.parse_search_pages(df), "https://ads.example.test").first()
    assert card.id == "123" and card.title == "Test Item" and card.location == "Oslo"
    assert card.url == "https://ads.example.test/item/123"
    assert card.price_display == "100 NOK" and card.image_url == "https://img.test/1"
    assert card.timestamp == datetime.fromtimestamp(1_700_000_000)


def test_missing_price_shows_na(spark, page):
    doc = {k: v for k, v in DOC.items() if k != "price"} | {"canonical_url": "https://cdn.test/x"}
    card = sp.listing_cards(sp.parse_search_pages(
        spark.createDataFrame([(page([doc], META),)], "html STRING")), "https://ads.example.test").first()
    assert card.price_display == "N/A" and card.url == "https://cdn.test/x"


def test_promoted_entry_comes_first(spark, page):
    rows = parse(spark, page([{"ad_id": "a"}, {"ad_id": "b"}], META, entry={"ad_id": "p"}))
    assert [(r.pos, r.ad_id, r.is_promoted) for r in rows] == [(0, "p", True), (1, "a", False), (2, "b", False)]


def test_empty_promoted_entry_and_odd_docs_are_skipped(spark, page):
    rows = parse(spark, page([5, None, {"ad_id": "a"}, "x", [1]], META, entry={}))
    assert [r.ad_id for r in rows] == ["a"]


def test_one_odd_field_does_not_void_the_document(spark, page):
    rows = parse(spark, page([{"ad_id": "a", "price": "free", "image_urls": {"x": 1}, "heading": "h"}]))
    assert (rows[0].ad_id, rows[0].heading, rows[0].price_amount, rows[0].num_images) == ("a", "h", None, 0)


def test_unreadable_pages_give_no_rows_but_a_reason(spark, page):
    htmls = ["<html/>", page([], raw='{"queries":[{"state":{"data":{}}}]}'), page([], raw='[1]'), page([DOC])]
    df = spark.createDataFrame([(h,) for h in htmls], "html STRING")
    assert [r.parse_error for r in sp.parse_pages(df).collect()] == ["no payload", "no docs", "no payload", None]
    assert len(parse(spark, *htmls)) == 1


def test_extras_labels_flags(spark, page):
    docs = [
        {"ad_id": "a", "extras": [{"id": "brand", "values": ["x"]}, {"id": "brand", "values": ["y", "z"]},
                                  {"id": "", "values": ["n"]}, {"id": "size", "values": []}, {"id": "n", "values": [1]}],
         "labels": [{"id": "l1"}, {"text": "t2", "id": "l2"}], "flags": ["private", "buy_now"]},
        {"ad_id": "b", "extras": None, "flags": []},
        {"ad_id": "c", "labels": [], "flags": None, "image_urls": ["1", "2"]},
    ]
    a, b, c = parse(spark, page(docs))
    assert a.extras == {"brand": "y, z", "n": "1"}
    assert (a.label_ids, a.label_texts) == ("l1, l2", ", t2")
    assert (a.is_private, a.is_retailer, a.has_shipping, a.has_buy_now, a.flags) == (
        True, False, False, True, "private, buy_now")
    assert (b.extras, b.label_ids, b.flags, b.is_private, b.num_images) == (None, None, None, False, 0)
    assert (c.label_ids, c.flags, c.num_images) == ("", None, 2)


def test_timestamp_and_metadata(spark, page):
    meta = {"paging": {"current": 2, "last": 9}, "result_size": {"match_count": 5, "group_count": 4},
            "params": {"q": ["gitar", "bass"]}}
    good, bad = parse(spark, page([{"ad_id": "a", "timestamp": 1000}, {"ad_id": "b", "timestamp": "soon"}], meta))
    assert good.timestamp_dt == datetime.fromtimestamp(1) and bad.timestamp_dt is None
    assert (good.page_current, good.page_last, good.total_match_count, good.total_group_count,
            good.search_query) == (2, 9, 5, 4, "gitar")


def test_raw_is_kept_on_request(spark, page):
    df = spark.createDataFrame([(page([{"ad_id": "a", "unknown": {"deep": 7}}]),)], "html STRING")
    rows = sp.parse_search_pages(df, include_raw=True)
    assert rows.select(F.try_variant_get("raw", "$.unknown.deep", "int").alias("x")).first()["x"] == 7


def test_collect_keeps_first_sighting(spark, page):
    pages = [("q", 0, 2, page([{"ad_id": "a", "heading": "late"}, {"ad_id": "b", "heading": "b"}])),
             ("q", 0, 1, page([{"ad_id": "a", "heading": "early"}])),
             ("r", 0, 1, page([{"ad_id": "c", "heading": "c"}])),
             ("q", 1, 1, page([{"ad_id": "b", "heading": "again"}]))]
    df = spark.createDataFrame(pages, "search_query STRING, range_no INT, page INT, html STRING")
    got = {r.ad_id: r.heading for r in sp.collect_listings(df).collect()}
    assert got == {"a": "early", "b": "b", "c": "c"}
    assert {r.ad_id for r in sp.collect_listings(df, query="q").collect()} == {"a", "b"}
    assert {r.heading for r in sp.collect_listings(df, query="q", max_pages=1).collect()} == {"early", "again"}


def test_flatten_struct(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', 2, 'd', array(3))) AS x, 4 AS y")
    row = sp.flatten_struct(df).first()
    assert row.asDict() == {"x_a": 1, "x_b_c": 2, "x_b_d": [3], "y": 4}


def test_pages_until_empty(spark):
    rows = [("a", 1, 5), ("a", 2, 0), ("a", 3, 5), ("b", 1, 0), ("c", 1, 1), ("c", 2, 1), (None, 1, 1), (None, 2, 0)]
    df = spark.createDataFrame(rows, "q STRING, page INT, n_rows INT")
    got = {(r.q, r.page) for r in pages_until_empty(df, ["q"]).collect()}
    assert got == {("a", 1), ("c", 1), ("c", 2), (None, 1)}
    capped = {(r.q, r.page) for r in pages_until_empty(df, ["q"], max_pages=1).collect()}
    assert capped == {("a", 1), ("c", 1), (None, 1)}


def test_price_cursor(spark):
    rows = [("a", 0, 1, 10.0), ("a", 0, 2, 99.9), ("b", 50, 1, 50.7), ("c", 0, 1, 5.0), ("c", 0, 2, None)]
    df = spark.createDataFrame(rows, "q STRING, price_from INT, page INT, page_max DOUBLE")
    got = {r.q: (r.last_page, r.next_price_from, r.advanced) for r in price_cursor(df, ["q"]).collect()}
    assert got == {"a": (2, 99, True), "b": (1, 50, False), "c": (2, None, False)}


def test_page_price_max_ignores_promoted_and_missing(spark, page):
    htmls = [page([{"price": {"amount": 3}}, {"price": {"amount": 7}}, {}], entry={"price": {"amount": 99}}),
             page([{}]), page([])]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page INT, html STRING")
    got = {r.page: r.page_max for r in sp.page_price_max(sp.parse_pages(df), ["page"]).collect()}
    assert got == {0: 7.0, 1: None}


def test_prices_are_never_shown_with_an_exponent(spark):
    rows = [(12345678.5,), (98765432.0,), (1e12,), (0.5,), (100.0,), (None,), (1234567890.25,)]
    df = spark.createDataFrame(rows, "price_amount DOUBLE").selectExpr(
        "'1' AS ad_id", "'t' AS heading", "'/i' AS canonical_url", "'o' AS location", "price_amount",
        "'NOK' AS price_currency_code", "array() AS image_urls", "CAST(NULL AS TIMESTAMP) AS timestamp_dt")
    assert sorted(r.price_display for r in sp.listing_cards(df, "b").collect()) == sorted(
        ["12345678.5 NOK", "98765432 NOK", "1000000000000 NOK", "0.5 NOK", "100 NOK", "N/A", "1234567890.25 NOK"])


def test_more_than_fifty_landed_pages(spark):
    df = spark.range(1, 61).selectExpr("'a' AS q", "CAST(id AS INT) AS page", "IF(id = 60, 0, 5) AS n_rows")
    assert pages_until_empty(df, ["q"]).count() == 59


def test_unreadable_pages_and_open_fields(spark, page):
    htmls = [page([{"ad_id": "a", "heading": "h", "colour": "red", "size": {"w": 1}}]), "<html></html>", None, page(None, raw='{"queries": []}')]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page INT, html STRING")
    parsed = sp.parse_pages(df)
    lost = {r.page: (r.parse_error, r.html_chars) for r in sp.unreadable_pages(parsed, ["page"]).collect()}
    assert lost == {1: ("no payload", 13), 2: ("no payload", 0), 3: ("no docs", len(htmls[3]))}
    rows = sp.explode_listings(parsed, ["page"], include_raw=True)
    fields = rows.select(sp.open_fields(F.col("raw"), ["ad_id", "heading"]).alias("f")).first().f
    assert fields == {"colour": '"red"', "size": '{"w":1}'}
