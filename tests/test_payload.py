import base64
import json

import pytest
from pyspark.sql import functions as F

from adlens.functions import payload as P


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v STRING").select(fn(F.col("v")).alias("x")).first()["x"]


def code(text):
    return base64.b64encode(text.encode()).decode()


@pytest.mark.parametrize("text", ["a", "ab", "abc", "abcd", "æøå 😀", '{"queries":[]}'])
def test_base64_padding_and_noise(spark, text):
    full = code(text)
    assert one(spark, full, P.tolerant_base64) == text
    assert one(spark, full.rstrip("="), P.tolerant_base64) == text
    assert one(spark, "\r\n".join(full), P.tolerant_base64) == text
    assert one(spark, "!" + full, P.tolerant_base64) == text


@pytest.mark.parametrize("bad", ["a", base64.b64encode(b"\xff\xfe\xfa").decode()])
def test_base64_failures_are_null(spark, bad):
    assert one(spark, bad, P.tolerant_base64) is None


def test_blobs_in_order_and_trimmed(spark):
    html = "<script>var t</script><script a='1'>eyJa\n </script><p/><script>eyJb</script><script> eyJc</script>"
    assert one(spark, html, P.script_blobs) == ["eyJa", "eyJb"]


@pytest.mark.parametrize("bodies, found", [
    ([{"a": 1}, {"queries": [1]}], 1),
    ([{"x": {"queries": [1]}}], None),
    ([{"queries": [1, 2]}, {"queries": [1]}], 2),
])
def test_first_payload(spark, bodies, found):
    html = "".join(f"<script>{code(json.dumps(b))}</script>" for b in bodies)
    assert one(spark, html, lambda h: F.size(P.payload_queries(P.search_payload(h)))) == found


def test_payload_skips_broken_json(spark):
    html = f"<script>{code('{' + chr(34) + 'queries')}</script><script>{code(json.dumps({'queries': []}))}</script>"
    assert one(spark, html, lambda h: P.search_payload(h).isNotNull()) is True


@pytest.mark.parametrize("literal, text", [
    (r'{\"a\":\"b\"}', '{"a":"b"}'),
    (r'{\"a\":\"æø \\u00e5\"}', '{"a":"æø \\u00e5"}'),
    (r'{\"a\":\"\u00e6\"}', '{"a":"æ"}'),
    (r'\x41\'\x42', "A'B"),
    (r'a\\x41', r'a\x41'),
    ("tab\there", "tab\there"),
])
def test_unescape_js(spark, literal, text):
    assert one(spark, literal, P.unescape_js) == text


def test_follower_count(spark):
    assert one(spark, "<p>12\u00a0følger</p><p>99 følger</p>", P.follower_count) == 12
    assert one(spark, "<p>følger</p>", P.follower_count) is None


def test_company_profile_takes_first_usable_script(spark):
    element = ("<companyProfilePodlet-isolated x='1'><script>var a;</script><script>{broken</script>"
               '<script>{"extendedProfileRecommerce": {}}</script>'
               '<script>{"extendedProfileRecommerce": {"orgName": "Lyd AS"}}</script>'
               "</companyProfilePodlet-isolated>")
    get = lambda h: F.try_variant_get(P.company_profile(h), "$.orgName", "string")
    assert one(spark, element, get) == "Lyd AS"
    assert one(spark, "<html/>", get) is None
    outside = '<script>{"extendedProfileRecommerce": {"orgName": "Lyd AS"}}</script>'
    assert one(spark, outside, get) is None


def test_loader_section_uses_json_key_order(spark):
    text = json.dumps({"loaderData": {"root": [1], "item-z": {"v": 1}, "item-a": {"v": 2}}})
    assert one(spark, text, lambda t: F.try_variant_get(P.loader_section(t), "$.v", "int")) == 1


def test_of_repeated_keys_the_last_counts(spark, page):
    """At the top, inside a document and inside a loader; the page is read."""
    from adlens.operators.search_pages import collect_listings
    doc = '{"ad_id": "a", "heading": "first", "price": {"amount": 1, "amount": 2}, "heading": "last"}'
    raw = f'{{"queries": [], "queries": [{{"state": {{"data": {{"docs": [], "docs": [{doc}, {{"ad_id": "b"}}]}}}}}}]}}'
    pages = spark.createDataFrame([("q", 0, 1, page(None, raw=raw))], "search_query STRING, range_no INT, page INT, html STRING")
    assert sorted((r.ad_id, r.heading, r.price_amount) for r in collect_listings(pages).collect()) == [("a", "last", 2.0), ("b", None, None)]
    loader = '{"loaderData": {"x": 1}, "loaderData": {"root": 1, "item-a": {"v": 1}, "item-b": {"v": 2}, "item-a": {"v": 3, "w": {"z": 1, "z": 9}}}}'
    section = P.loader_section(F.lit(loader))
    got = spark.range(1).select(F.try_variant_get(section, "$.v", "int").alias("v"), F.try_variant_get(section, "$.w.z", "int").alias("z")).first()
    assert tuple(got) == (3, 9)
