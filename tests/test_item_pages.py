import json

from pyspark.sql import functions as F

from adlens.operators import item_pages as ip

ITEM = {"title": "Gitar æøå \"signert\"", "price": 1500, "description": "linje 1\nlinje 2",
        "extras": [{"id": "brand", "value": "Fender", "valueId": 7}, {"id": "condition", "value": "Brukt"},
                   {"id": "", "value": "x"}, {"id": "brand", "value": "Gibson"}],
        "category": {"id": 1, "value": "Gitar", "parent": {"id": 2, "value": "Musikk", "parent": {"id": 3, "value": "Torget"}}},
        "images": [{"uri": "u1"}, {"uri": "u2"}],
        "location": {"position": {"lat": 59.9, "lng": 10.7, "accuracy": 5}, "postalCode": "0150",
                     "postalName": "OSLO", "countryCode": "NO"},
        "meta": {"adId": 42, "ownerId": 9}}


def html(item=ITEM, key="item-recommerce", extra="", cut=None, **section):
    data = {"loaderData": {"root": None, key: {"itemData": item, **section}}}
    literal = json.dumps(data, ensure_ascii=False).replace("\\", "\\\\").replace('"', '\\"')
    literal = literal[:cut] if cut else literal
    return (f'<script>var a;</script><script nonce="1">window.__staticRouterHydrationData = JSON.parse("{literal}");'
            f"</script>{extra}")


def items(spark, *pages):
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(pages)], "ad_id STRING, html STRING")
    return {r.ad_id: r for r in ip.get_items(df).collect()}


def test_full_item(spark):
    row = items(spark, html(transactableData={"transactable": True, "buyNow": False},
                            meta={"canonical": "https://ads.test/42"}))["0"]
    assert row.title == ITEM["title"] and row.description == ITEM["description"] and row.price == 1500.0
    assert row.extras == {"extra_brand": "Gibson", "extra_brand_id": "7", "extra_condition": "Brukt"}
    assert (row.category, row.sub_category, row.top_category) == ("Gitar", "Musikk", "Torget")
    assert (row.category_id, row.sub_category_id, row.top_category_id) == ("1", "2", "3")
    assert (row.num_images, row.image_url, row.image_urls) == (2, "u1", ["u1", "u2"])
    assert (row.latitude, row.longitude, row.coord_accuracy, row.postal_code, row.postal_name, row.country_code) == (
        59.9, 10.7, 5.0, "0150", "OSLO", "NO")
    assert (row.meta_adId, row.meta_ownerId, row.txn_transactable, row.txn_buyNow) == ("42", "9", True, False)
    assert row.canonical_url == "https://ads.test/42" and row.follower_count is None and row.seller_org_name is None


def test_sparse_item(spark):
    row = items(spark, html({"title": "x", "extras": None, "images": None, "category": None}))["0"]
    assert (row.extras, row.num_images, row.image_url, row.image_urls, row.category, row.latitude) == (
        {}, 0, None, [], None, None)


def test_seller(spark):
    profile = {"extendedProfileRecommerce": {"orgName": "Lyd AS", "orgId": 5, "contacts": [
        {"name": "Kari", "phone": "1"}, {"name": "Ola", "phone": "2"}]}}
    extra = ("<p>31 følger</p><companyProfilePodlet-isolated><script>" + json.dumps(profile)
             + "</script></companyProfilePodlet-isolated>")
    row = items(spark, html(key="item-bap", extra=extra))["0"]
    assert (row.follower_count, row.seller_org_name, row.seller_org_id) == (31, "Lyd AS", "5")
    assert (row.seller_contact_name, row.seller_contact_phone) == ("Kari", "1")


def test_bad_pages_are_set_aside_with_a_reason(spark):
    pages = [html(), "<html/>", html(cut=30), html(key="root2")]
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(pages)], "ad_id STRING, html STRING")
    good, bad = ip.split_quarantine(ip.parse_item_pages(df))
    assert [r.ad_id for r in good.collect()] == ["0"]
    assert {r.ad_id: r.parse_error for r in bad.collect()} == {
        "1": "no hydration data", "2": "no item section", "3": "no item section"}


def test_wanted_ids(spark):
    df = spark.createDataFrame([("a", html()), ("b", html())], "ad_id STRING, html STRING")
    wanted = spark.createDataFrame([("b",), ("zz",)], "ad_id STRING")
    assert [r.ad_id for r in ip.get_items(df, wanted).collect()] == ["b"]


def test_page_is_parsed_once(spark):
    df = spark.createDataFrame([("a", html())], "ad_id STRING, html STRING")
    plan = ip.get_items(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__staticRouterHydrationData") == 1
    assert ip.parse_item_pages(df).select(F.col("followers")).first()["followers"] is None


def test_undeclared_keys_are_kept(spark):
    item = {**ITEM, "meta": {"adId": 42, "schema": "v2", "edited": {"by": 1}}}
    row = items(spark, html(item, transactableData={"buyNow": True, "carrier": "post"}))["0"]
    assert row.meta_rest == {"schema": '"v2"', "edited": '{"by":1}'} and row.txn_rest == {"carrier": '"post"'}
    assert row.meta_adId == "42" and row.txn_buyNow is True
